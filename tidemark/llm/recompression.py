"""Repeated passages by recompression.

Rounds of naming shorten every text: a run of one word gets one name; then, in each round, a
left symbol followed by a right one gets one name, where the side of a symbol is a bit of its
name.
Names are digests of what they stand for, so all tasks agree on them and equal substrings get
equal symbols inside, up to a margin that each symbol knows: the words its shape depends on.
Spark counts the names of the high level; only symbols that occur again can lie in a repeat,
and the windows around them are verified.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tidemark.llm import passages
from tidemark.llm.flat import Sequences, mix

WINDOW = 20
ROUNDS = 3
RUN = np.uint64(0xA24BAED4963EE407)
PAIR = np.uint64(0x9FB21C651E98DF25)


def _segments(fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(fresh)
    return first, np.diff(np.r_[first, len(fresh)])


def symbols(words: np.ndarray, bounds: np.ndarray, rounds: int = ROUNDS):
    """Names of the last level, and per symbol the words ``[low, high)`` that decide its shape.

    A row's edges count as unknown neighbours: what depends on them reaches over the edge and
    lies in no window.
    """
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    # Runs of one word.  Where a run ends depends on the words next to it.
    first, n = _segments(~np.r_[False, (words[1:] == words[:-1]) & (row[1:] == row[:-1])][: len(words)])
    name = np.where(n == 1, words[first], mix(words[first] * RUN + n.astype(np.uint64) * PAIR))
    row, low, high = row[first], first - 1, first + n + 1
    for level in range(rounds):
        side = (mix(name + np.uint64(level + 1)) & np.uint64(1)).astype(bool)
        next_too = np.r_[row[1:] == row[:-1], False][: len(name)]
        joins = np.r_[side[:-1] & ~side[1:], False][: len(name)] & next_too
        taken = np.r_[False, joins[:-1]][: len(name)]
        before = np.maximum(np.arange(len(name)) - 1, 0)
        after = np.minimum(np.arange(len(name)) + 1, max(len(name) - 1, 0))
        # A left symbol that stays alone depends on the one behind it, a right symbol on the one before.
        last_too = np.r_[False, next_too[:-1]][: len(name)]
        near_low = np.where(side, np.where(next_too, low[after], low), np.where(last_too, low[before], low - 1))
        near_high = np.where(side, np.where(next_too, high[after], high + 1), np.where(last_too, high[before], high))
        new_name, new_low, new_high = name.copy(), np.minimum(low, near_low), np.maximum(high, near_high)
        at = np.flatnonzero(joins)
        new_name[at] = mix(name[at] * PAIR + mix(name[at + 1]) * RUN + np.uint64(level))
        new_low[at] = np.minimum(low[at], low[at + 1])
        new_high[at] = np.maximum(high[at], high[at + 1])
        keep = ~taken
        name, row, low, high = new_name[keep], row[keep], new_low[keep], new_high[keep]
    return name, low, high


def high_symbols(size: int, rounds: int = ROUNDS) -> passages.Anchors:
    """The symbol of least name among those that a window decides; else the window itself."""

    def find(words: np.ndarray, runs: Sequences, at: np.ndarray, bounds: np.ndarray):
        name, low, high = symbols(words, bounds, rounds)
        fits = high - low <= size
        name, low, high = name[fits], low[fits], high[fits]
        rank = mix(name)
        order = np.lexsort((-low, rank))[::-1]
        name, low, high = name[order], low[order], high[order]
        # Windows from high - size to low decide the symbol; the least name is written last.
        n = size - (high - low) + 1
        ahead = np.cumsum(n) - n
        place = np.arange(n.sum()) - np.repeat(ahead - (high - size), n)
        inside = (place >= 0) & (place < len(words))
        best = np.full(len(words), -1)
        best[place[inside]] = np.repeat(np.arange(len(name)), n)[inside]
        best = best[at]
        found = best >= 0
        anchor = np.where(found, low[best] if len(low) else 0, -1 - at)
        key = runs.of(at, size)
        key[found] = runs.of(low[best[found]], (high - low)[best[found]])
        return anchor, mix(key + found.astype(np.uint64))

    return find


def repeats(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """``doc, tie, start, n``: runs of windows that also start earlier."""
    keyed = passages.keyed(docs)
    spans = passages.repeated_spans(keyed, size, high_symbols(size))
    return passages.repeated_windows(keyed, passages.first_of_equal(spans), size)


def remove_repeats(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per document ``doc_id, n_words, n_removed`` and the SHA-256 of the kept words.

    Removed are the words covered by a window of ``size`` words whose sequence also starts
    earlier (smaller doc_id, or same document, earlier start); windows are judged on the
    input.  A null text has no words; a null doc_id comes last; rows that repeat an id and
    text share one result; texts shorter than a window lose nothing; an empty table gives an
    empty result; other columns are ignored.
    """
    return passages.digests(passages.keyed(docs), repeats(docs, size), size)


def clean_documents(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """The documents themselves without the words that :func:`remove_repeats` removes."""
    return passages.cleaned(docs, repeats(docs, size), size)

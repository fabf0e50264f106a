"""Byte-pair encoding and decoding with a public vocabulary.

Texts are cut at white space; the distinct pieces of a batch are normalised, split into
words and encoded together.  The symbols of all words stand in one flat numpy array.  In
each round every word finds its lowest-ranked pair by binary search over the sorted pair
keys and merges it, until no word has a pair of the vocabulary left.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from tidemark.llm.words import in_small_batches

# The white space, split pattern and byte alphabet of this vocabulary family.
WHITE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]
ONLY_PYTHON_SPLITS = "\x1c\x1d\x1e\x1f"

KEPT_PIECES = 500_000


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()


FAR = np.int64(2**62)


def _byte_alphabet() -> list[str]:
    """The visible character that stands for each byte."""
    spare = iter(range(256, 512))
    return [chr(b) if b in set(PLAIN_BYTES) else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Tables of one tokenizer file and the merge rounds over them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.suffix = spec["model"]["end_of_word_suffix"]
        self.size = 1 + max([*ids.values(), *self.special.values()])
        self.tokens = [""] * self.size
        for token, i in [*ids.items(), *self.special.items()]:
            self.tokens[i] = token
        letters = _byte_alphabet()
        self.inner = np.array([ids[c] for c in letters], dtype=np.int64)
        self.final = np.array([ids[c + self.suffix] for c in letters], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        left = np.array([ids[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([ids[b] for _, b in pairs], dtype=np.int64)
        made = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        # A merge is alone in its round when its product takes part in a pair of lower rank.
        lowest = np.full(self.size, FAR)
        np.minimum.at(lowest, left, np.arange(len(pairs)))
        np.minimum.at(lowest, right, np.arange(len(pairs)))
        self.alone = lowest[self.made] < self.ranks
        self.white = regex.compile(WHITE)
        self.pieces = regex.compile(PIECES)
        self.specials = regex.compile("(" + "|".join(regex.escape(t) for t in self.special) + ")")

    def merged(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the flat ``symbols`` of numbered ``word``s until nothing can be merged."""
        done_symbols, done_words = [], []
        while len(symbols):
            pair = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            known = (self.keys[at] == pair) & (word[:-1] == word[1:])
            rank = np.where(known, self.ranks[at], FAR)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            number = np.cumsum(np.r_[False, word[1:] != word[:-1]])
            best = np.minimum.reduceat(np.r_[rank, FAR], starts)
            open_word = best < FAR
            if not open_word.all():
                ended = ~open_word[number]
                done_symbols.append(symbols[ended])
                done_words.append(word[ended])
            hit = np.flatnonzero(known & (rank == best[number[:-1]]))
            if not len(hit):
                break
            # Of occurrences that overlap, as in a run of one symbol, every second one merges.
            fresh = np.r_[True, np.diff(hit) > 1]
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            first = np.r_[True, number[hit][1:] != number[hit][:-1]]
            hit = hit[first | ~self.alone[at[hit]]]
            symbols[hit] = self.made[at[hit]]
            keep = open_word[number]
            keep[hit + 1] = False
            symbols, word = symbols[keep], word[keep]
        if not done_words:
            return symbols, word
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        data = [w.encode("utf-8", "replace") for w in words]
        sizes = np.array([len(d) for d in data], dtype=np.int64)
        flat = np.frombuffer(b"".join(data), dtype=np.uint8)
        symbols = self.inner[flat]
        last = np.cumsum(sizes) - 1
        symbols[last] = self.final[flat[last]]
        symbols, word = self.merged(symbols, np.repeat(np.arange(len(words)), sizes))
        return np.split(symbols, np.searchsorted(word, np.arange(1, len(words))))

    def words_of(self, piece: str) -> list[str]:
        """The words of a piece without white space, after NFC and lower case."""
        piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()
        return self.pieces.findall(piece)

    def split(self, text: str) -> list[str]:
        if any(c in text for c in ONLY_PYTHON_SPLITS):
            return [p for p in self.white.split(text) if p]
        return text.split()


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes batches; remembers at most ``KEPT_PIECES`` pieces between them."""

    def __init__(self, path: str):
        self.vocabulary = vocabulary(path)
        self.known: dict[str, tuple[int, str, str]] = {}

    def learn(self, fresh: list[str]) -> None:
        """Encode pieces not seen before: number of ids, ids as text, tokens as text."""
        v = self.vocabulary
        parts = [[p for p in v.specials.split(piece) if p] if "<|" in piece else [piece] for piece in fresh]
        words = [[[p] if p in v.special else v.words_of(p) for p in ps] for ps in parts]
        distinct = list(dict.fromkeys(w for ps in words for ws in ps for w in ws if w not in v.special))
        ids = dict(zip(distinct, self.vocabulary.encode_words(distinct))) if distinct else {}
        for piece, ps in zip(fresh, words):
            found = [i for ws in ps for w in ws for i in ([v.special[w]] if w in v.special else ids[w].tolist())]
            self.known[piece] = (len(found), " ".join(map(str, found)), " ".join(v.tokens[i] for i in found))

    def encode(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """Per text: number of ids, the ids and the decoded text, both joined by spaces."""
        pieces = [self.vocabulary.split(t) if t else [] for t in texts]
        fresh = {p for ps in pieces for p in ps if p not in self.known}
        if len(self.known) + len(fresh) > KEPT_PIECES:
            self.known.clear()
            fresh = {p for ps in pieces for p in ps}
        if fresh:
            self.learn(list(fresh))
        for ps in pieces:
            found = [x for x in map(self.known.__getitem__, ps) if x[0]]
            yield (
                sum(x[0] for x in found),
                " ".join([x[1] for x in found]),
                " ".join([x[2] for x in found]),
            )


def encoded_batches(path: str, kind: str):
    """A ``mapInPandas`` body over ``doc_id, text``; small slices bound what one batch holds."""

    def body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(path)
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.iloc[at : at + 200]
                rows = list(encoder.encode([t if isinstance(t, str) else None for t in part["text"]]))
                out = pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "n_tokens": [r[0] for r in rows]})
                if kind == "digests":
                    out["ids_sha256"] = [digest(r[1]) for r in rows]
                    out["decoded_sha256"] = [digest(r[2]) for r in rows]
                else:
                    out["ids"] = [list(map(int, r[1].split())) for r in rows]
                    if kind == "rows":
                        out["decoded_sha256"] = [digest(r[2]) for r in rows]
                    else:
                        out["decoded"] = [r[2] for r in rows]
                yield out.astype({"doc_id": "Int64", "n_tokens": "int64"})

    return body


def _narrow(docs: DataFrame) -> DataFrame:
    return in_small_batches(docs.selectExpr("cast(doc_id as long) as doc_id", "text"))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` for every whole text.

    A null or blank text has no ids and decodes to the empty text; special tokens in a text
    are single ids; repeated rows give repeated results; other columns are ignored.
    """
    return _narrow(docs).mapInPandas(
        encoded_batches(path, "ids"), "doc_id long, n_tokens long, ids array<int>, decoded string"
    )


def training_rows(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_sha256``: like :func:`encode`, the text as a digest."""
    return _narrow(docs).mapInPandas(
        encoded_batches(path, "rows"), "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string"
    )


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: like :func:`encode`, as digests."""
    return _narrow(docs).mapInPandas(
        encoded_batches(path, "digests"),
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )

"""Quality rules under weak supervision.

Every rule votes good, votes bad or abstains.  Expectation-maximisation over the counts of
the vote patterns estimates how each rule votes on good and on bad documents; a document is
kept by its posterior probability of being good, not by passing every rule.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.words import bound, count_of, words
from tidemark.settings import settle

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
LEAST_WORDS = 20
GOOD, NONE, BAD = 1, 0, -1


@dataclass(frozen=True)
class Rule:
    """Votes bad when ``bad`` holds, else good when ``good`` holds, else abstains."""

    name: str
    good: str
    bad: str

    def vote(self) -> Column:
        bad, good = F.coalesce(F.expr(self.bad), F.lit(False)), F.coalesce(F.expr(self.good), F.lit(False))
        return F.when(bad, BAD).when(good, GOOD).otherwise(NONE)


RULES = (
    Rule("symbols", "n_symbols <= 0.01 * word_chars", "n_symbols > 0.04 * word_chars"),
    Rule("symbol_words", "n_symbols <= 0.05 * n_words", "n_symbols > 0.25 * n_words"),
    Rule("letters", "n_letters >= 0.9 * word_chars", "n_letters < 0.75 * word_chars"),
    Rule("capitals", "n_capitals <= 0.15 * n_letters", "n_capitals > 0.4 * n_letters"),
    Rule("shouting", "n_shouts = 0", "n_shouts > 0.1 * n_words"),
    Rule("lines", "n_dup_lines = 0", "n_dup_lines > 0.2 * n_lines"),
    Rule("repeats", "n_repeat_words = 0", "n_repeat_words > 0.2 * n_words"),
    Rule("word_length", "word_chars between 3 * n_words and 9 * n_words", "word_chars > 15 * n_words or word_chars < 2 * n_words"),
)


def repeated_words(found: Column) -> Column:
    """Words inside windows of eight words that occur at least twice in the text."""

    def of_hashes(hashes: Column) -> Column:
        at = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

        def in_order(windows: Column) -> Column:
            twin = lambda w, j: F.try_element_at(windows, j)["h"].eqNullSafe(w["h"])
            again = F.filter(windows, lambda w, j: ((j > 0) & twin(w, F.greatest(j, F.lit(1)))) | twin(w, j + 2))
            starts = F.array_sort(F.transform(again, lambda w: w["i"]))

            def covered(starts: Column) -> Column:
                next_start = lambda j: F.coalesce(F.try_element_at(starts, j + 2), F.lit(2**31 - 1))
                spans = F.transform(
                    starts, lambda s, j: F.least(next_start(j).cast("long") - s, F.lit(WINDOW).cast("long"))
                )
                return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s)

            return bound(starts, covered)

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
            bound(F.array_sort(at), in_order)
        )

    def of_words(codes: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(codes) - (WINDOW - 1))
        return bound(F.transform(starts, lambda i: F.xxhash64(F.slice(codes, i, WINDOW))), of_hashes)

    return F.when(F.size(found) < WINDOW, F.lit(0).cast("long")).otherwise(
        bound(F.transform(found, lambda w: F.xxhash64(w)), of_words)
    )


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the base measures of each text; a null text measures 0 throughout."""
    text = F.coalesce(F.col("text"), F.lit(""))
    has_word = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    lines = bound(
        has_word,
        lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("again")),
    )
    by_words = bound(
        words(text),
        lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("again")),
    )
    return docs.select(
        "doc_id", by_words.alias("_w"), lines.alias("_l"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", ""))).cast("long").alias("word_chars"),
        count_of(text, SYMBOLS).alias("n_symbols"),
        F.length(F.regexp_replace(text, r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
        count_of(text, r"[\p{Lu}]").alias("n_capitals"),
        count_of(text, r"[!?]").alias("n_shouts"),
    ).select(
        "doc_id", F.col("_w.n").alias("n_words"), F.col("_w.again").alias("n_repeat_words"),
        F.col("_l.n").cast("long").alias("n_lines"), F.col("_l.again").cast("long").alias("n_dup_lines"),
        "word_chars", "n_symbols", "n_letters", "n_capitals", "n_shouts",
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class VoteModel:
    """Share of good documents, and per rule the chance of each vote given the class."""

    prior: float
    given_good: tuple[dict[int, float], ...]
    given_bad: tuple[dict[int, float], ...]

    def log_odds(self, votes: Sequence[Column]) -> Column:
        total = F.lit(math.log(self.prior / (1 - self.prior)))
        for vote, good, bad in zip(votes, self.given_good, self.given_bad):
            part = {v: math.log(good[v] / bad[v]) for v in (GOOD, NONE, BAD)}
            total = total + F.when(vote == GOOD, part[GOOD]).when(vote == BAD, part[BAD]).otherwise(part[NONE])
        return total


def fit_votes(patterns: Sequence[tuple[tuple[int, ...], int]], rules: int, rounds: int = 100) -> VoteModel:
    """Estimate the model from (votes, count) pairs; at most 3 ** rules pairs exist.

    Starts from the belief that a document with a bad vote is likely bad, which fixes which
    class is called good.  Without documents every vote stays equally likely.
    """
    belief = [0.1 if BAD in votes else 0.95 for votes, _ in patterns]
    prior, chances = 0.5, None
    for _ in range(rounds):
        mass = {True: 1.0, False: 1.0}
        seen = {side: [{GOOD: 1.0, NONE: 1.0, BAD: 1.0} for _ in range(rules)] for side in (True, False)}
        for (votes, n), p in zip(patterns, belief):
            for side, weight in ((True, n * p), (False, n * (1 - p))):
                mass[side] += weight
                for j, v in enumerate(votes):
                    seen[side][j][v] += weight
        prior = mass[True] / (mass[True] + mass[False])
        chances = {
            side: tuple({v: c / sum(row.values()) for v, c in row.items()} for row in seen[side])
            for side in (True, False)
        }
        fresh = []
        for votes, _ in patterns:
            odds = math.log(prior / (1 - prior)) + sum(
                math.log(chances[True][j][v] / chances[False][j][v]) for j, v in enumerate(votes)
            )
            fresh.append(1 / (1 + math.exp(-max(-700.0, min(700.0, odds)))))
        moved = max((abs(a - b) for a, b in zip(fresh, belief)), default=0.0)
        belief = fresh
        if moved < 1e-9:
            break
    return VoteModel(prior, chances[True], chances[False])


def judged(docs: DataFrame, rules: Sequence[Rule] = RULES, least: float = 0.5) -> DataFrame:
    """The measures of each document with ``base_failed``, ``p_good`` and ``kept``.

    The model is fitted on the documents that pass the base conditions.  Their vote patterns
    are counted in the cluster; the pattern table has at most 3 ** len(rules) rows.  Empty,
    null and very short texts fail the base conditions and are not kept; repeated rows are
    judged alike; an empty table gives an empty result.
    """
    names = [f"_vote_{r.name}" for r in rules]
    voted = settle(
        measured(docs).withColumns({n: r.vote() for n, r in zip(names, rules)}).withColumn("base_failed", base_failed()),
        "votes",
    )
    counted = voted.where(~F.col("base_failed")).groupBy(*names).agg(F.count("*").alias("n")).collect()
    patterns = sorted((tuple(row[n] for n in names), row["n"]) for row in counted)
    odds = fit_votes(patterns, len(names)).log_odds([F.col(n) for n in names])
    good = 1 / (1 + F.exp(-odds))
    return (
        voted.withColumn("p_good", good)
        .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= least))
        .drop(*names)
    )

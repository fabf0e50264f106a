"""Append-only logs: decisions, submission attempts, order states, and trials.

Append order has no meaning in a table, so every log row carries an explicit ``seq``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions import fixed, guards, spread
from tidemark.functions.exprs import blank, all_failures, canonical_json, iso_utc, sorted_map

ATTEMPT, STATE = "submission_attempt", "order_state"


def entry_id() -> Column:
    """Address of an entry's full content."""
    return F.sha2(
        canonical_json(
            {
                "subject_id": F.col("subject_id"),
                "kind": F.col("kind"),
                "payload": sorted_map(F.col("payload")),
                "recorded_at": iso_utc(F.col("recorded_at")),
            }
        ),
        256,
    )


def judged_decisions(raw: DataFrame) -> DataFrame:
    """Raw decisions with their address and every reason they cannot be recorded."""
    c = F.col
    checks = [
        (blank(c("subject_id")), "subject_id"),
        (blank(c("kind")), "kind"),
        (c("kind").isin(ATTEMPT, STATE), "kind_reserved"),
        (F.coalesce(F.size("payload") <= 0, F.lit(True)), "payload_empty"),
        (F.exists(F.map_keys("payload"), blank), "payload_key_blank"),
        (F.exists(F.map_values("payload"), lambda v: v.isNull()), "payload_value_missing"),
        (c("recorded_at").isNull(), "recorded_at"),
    ]
    return raw.withColumn("reasons", all_failures(checks)).withColumn("entry_id", entry_id())


def new_decisions(stored: DataFrame, raw: DataFrame) -> DataFrame:
    """The decisions to append: valid, each content once, none already stored.

    The same body at a later instant is a new entry; the same body again is none.  Of
    repeats within ``raw`` the first by ``seq`` is kept.
    """
    good = judged_decisions(raw).where(F.size("reasons") == 0).drop("reasons")
    body = [c for c in good.columns if c not in ("entry_id", "seq", "payload")]
    firsts = good.groupBy("entry_id").agg(
        F.min("seq").alias("seq"),
        *[F.min(c).alias(c) for c in body],
        F.map_from_entries(F.first(F.map_entries("payload"))).alias("payload"),
    )
    return firsts.join(stored.select("entry_id"), "entry_id", "left_anti").select(*good.columns)


def attempt_conflicts(attempts: DataFrame) -> DataFrame:
    """Client order ids whose attempts carry different payloads."""
    # A missing payload is a content of its own.
    digest = F.sha2(F.coalesce(F.to_json(sorted_map(F.col("payload"))), F.lit("none")), 256)
    return (
        attempts.groupBy("subject_id")
        .agg(F.min(digest).alias("_a"), F.max(digest).alias("_b"), F.count("*").alias("attempts"))
        .where("_a != _b")
        .select("subject_id", "attempts")
    )


def new_attempts(stored: DataFrame, raw: DataFrame) -> DataFrame:
    """Attempts to append: one per client order id.

    Two stored attempts for one id are a corrupt log; another payload is a conflict; both
    raise.  The same payload again adds nothing.
    """
    guards.refuse_repeats(stored, ["subject_id"], guards.IntegrityError, "more than one stored attempt")
    both = stored.select("subject_id", "payload").unionByName(raw.select("subject_id", "payload"))
    guards.refuse(
        attempt_conflicts(both), F.lit(True), guards.IntegrityError,
        "submission attempt conflict", ["subject_id", "attempts"],
    )
    fresh = raw.join(stored, "subject_id", "left_anti")
    first = fresh.groupBy("subject_id").agg(F.min("seq").alias("seq"))
    return fresh.join(first, ["subject_id", "seq"]).dropDuplicates(["subject_id"])


def coalesced_states(states: DataFrame) -> DataFrame:
    """Drop a state equal to the subject's previous one in append order; recurrences stay."""
    [heavy] = spread.is_heavy(states, ["subject_id"])
    placed = spread.numbered(states, ["subject_id"], ["seq"], heavy)
    laid, part = spread.in_blocks(placed, ["subject_id"], heavy, before=1)
    before = F.lag("state").over(W.partitionBy(*part).orderBy("pos"))
    kept = laid.withColumn("_before", before).where("_core")
    return kept.where("_before is null or _before != state").drop("_before", "_core", "_blk", "pos")


def latest_state(states: DataFrame) -> DataFrame:
    """The last appended state per subject, whatever its timestamp says."""
    bad = ~F.col("state").isin(*fixed.ORDER_STATES)
    guards.refuse(states, bad, guards.IntegrityError, "unknown order state", ["subject_id", "state"])
    return states.groupBy("subject_id").agg(
        F.max_by("state", "seq").alias("state"), F.max("seq").alias("seq"), F.count("*").alias("entries")
    )


def history(log: DataFrame, subject_id: str) -> DataFrame:
    return log.where(F.col("subject_id") == subject_id).orderBy("seq")


def trial_id() -> Column:
    """Address of (configuration, purpose, instant); configuration is a string map."""
    configuration = F.sha2(F.to_json(sorted_map(F.col("configuration"))), 256)
    return F.sha2(
        canonical_json(
            {
                "configuration_hash": configuration,
                "purpose": F.col("purpose"),
                "registered_at": iso_utc(F.col("registered_at")),
            }
        ),
        256,
    )


def new_trials(stored: DataFrame, raw: DataFrame) -> DataFrame:
    """Trials to append, each (configuration, purpose, instant) once."""
    guards.refuse(
        raw, blank(F.col("purpose")), guards.IntegrityError,
        "a trial must state its purpose", ["registered_at"],
    )
    made = raw.withColumn("trial_id", trial_id()).dropDuplicates(["trial_id"])
    return made.join(stored.select("trial_id"), "trial_id", "left_anti")


def new_results(trials: DataFrame, stored: DataFrame, raw: DataFrame) -> DataFrame:
    """Results to append: only for registered trials, and only one each."""
    guards.refuse(
        raw.join(trials, "trial_id", "left_anti"), F.lit(True), guards.IntegrityError,
        "result for an unregistered trial", ["trial_id"],
    )
    both = stored.select("trial_id").unionByName(raw.select("trial_id"))
    guards.refuse_repeats(both, ["trial_id"], guards.IntegrityError, "trial already has a result")
    return raw


def trial_history(trials: DataFrame, results: DataFrame) -> DataFrame:
    """Every registered trial with its result if any; an orphan or second result raises."""
    guards.refuse_repeats(results, ["trial_id"], guards.IntegrityError, "two results for one trial")
    guards.refuse(
        results.join(trials, "trial_id", "left_anti"), F.lit(True), guards.IntegrityError,
        "result without a registration", ["trial_id"],
    )
    return trials.join(results, "trial_id", "left")


def trial_count(trials: DataFrame) -> int:
    """How many trials are registered, worked or not."""
    return trials.select("trial_id").distinct().count()


def refuse_unregistered(trials: DataFrame, trial_id: str, configuration: str) -> None:
    """Refuse a result to come: no such trial, or one registered for another configuration.

    ``configuration`` is the version that the trial's configuration names as ``model``.
    """
    named = trials.where(F.col("trial_id") == trial_id).select(F.col("configuration")["model"].alias("model")).distinct()
    found = [row.model for row in named.limit(2).collect()]
    if found != [configuration]:
        raise guards.IntegrityError(
            f"trial {trial_id} is not registered" if not found
            else f"trial {trial_id} is registered for {found[0]}, not for {configuration}"
        )

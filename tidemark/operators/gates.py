"""Eligibility: every gate a forecast fails, not only the first."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.exprs import all_failures, sign


@dataclass(frozen=True)
class EligibilityConfig:
    p_up_floor: float = 0.55
    p_up_threshold: float = 0.58
    cost_hurdle: float = 0.01
    max_calibration_error: float = 0.05
    min_effective_sample_size: float = 100.0
    max_quantile_spread: float = 0.40
    required_family_count: int = 2

    def __post_init__(self) -> None:
        if not 0.0 <= self.p_up_floor <= self.p_up_threshold <= 1.0:
            raise ValueError("the threshold must be a probability not below the floor")
        if min(self.cost_hurdle, self.max_calibration_error, self.max_quantile_spread) < 0:
            raise ValueError("bounds must not be negative")
        if self.min_effective_sample_size < 0 or self.required_family_count < 2:
            raise ValueError("sample size must not be negative and two families are required")


def decide(
    forecasts: DataFrame, families: Sequence[str], config: EligibilityConfig = EligibilityConfig()
) -> DataFrame:
    """Settle ``eligible`` and ``rejection_reasons``.

    ``families`` names the columns with each family's signed view; zero or NULL is no view.
    A short is judged on its own confidence; a missing band fails the uncertainty gate.  A
    missing or NaN probability, return, calibration error or sample size is named.
    """
    c = F.col
    views = F.array(*[sign(F.coalesce(F.nanvl(c(f).cast("double"), F.lit(0.0)), F.lit(0.0))) for f in families])
    voters = F.filter(views, lambda v: v != 0)
    enough = F.size(voters) >= config.required_family_count
    confidence = F.when(c("expected_residual_return") >= 0, c("p_up")).otherwise(1.0 - c("p_up"))
    band = F.coalesce(c("q90") - c("q10"), F.lit(float("inf")))
    needed = ("p_up", "expected_residual_return", "calibration_error", "effective_sample_size")
    checks = [
        *[(c(n).isNull() | F.isnan(c(n).cast("double")), f"missing_{n}") for n in needed],
        (~enough, "gate_1_single_family_shadow_book"),
        (enough & (F.size(F.array_distinct(voters)) > 1), "gate_1_families_disagree_on_direction"),
        (confidence < config.p_up_floor, "gate_2_below_non_negotiable_floor"),
        (
            (confidence >= config.p_up_floor) & (confidence < config.p_up_threshold),
            "gate_2_below_calibrated_threshold",
        ),
        (F.abs("expected_residual_return") < config.cost_hurdle, "gate_3_expected_move_below_cost_hurdle"),
        (c("calibration_error") > config.max_calibration_error, "gate_4_calibration_error_above_limit"),
        (
            c("effective_sample_size") < config.min_effective_sample_size,
            "gate_4_effective_sample_size_below_floor",
        ),
        (band > config.max_quantile_spread, "gate_4_quantile_spread_above_limit"),
    ]
    judged = forecasts.withColumn("rejection_reasons", F.array_sort(all_failures(checks)))
    return judged.withColumn("eligible", F.size("rejection_reasons") == 0)

"""Pooled ridge and logistic models per fold, their calibration, and predictions.

Everything that touches rows is an aggregate or an expression.  What leaves the cluster is
one row of moments or coefficients per fold: folds times features squared, both set by
configuration.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import guards, spread
from tidemark.functions.exprs import config_version
from tidemark.operators import ledger
from tidemark.operators.folds import EDGES, membership_digest
from tidemark.settings import settle


class Uncalibrated(ValueError):
    """A fold has no usable training or calibration label, or only one outcome sign."""


@dataclass(frozen=True)
class ModelConfig:
    families: Mapping[str, Sequence[str]] = field(default_factory=dict)
    ridge_alpha: float = 1.0
    logistic_c: float = 1.0
    calibration_bins: int = 10
    horizon_sessions: int = 5

    def __post_init__(self) -> None:
        names = self.feature_names
        if not names or len(set(names)) != len(names):
            raise ValueError("every feature belongs to exactly one family")
        if self.ridge_alpha <= 0 or self.logistic_c <= 0 or self.calibration_bins <= 0:
            raise ValueError("ridge_alpha, logistic_c and calibration_bins must be positive")

    @property
    def feature_names(self) -> list[str]:
        return [name for names in self.families.values() for name in names]

    @property
    def version(self) -> str:
        return config_version(
            "cfg",
            {
                "families": {k: list(v) for k, v in self.families.items()},
                "ridge_alpha": repr(self.ridge_alpha),
                "logistic_c": repr(self.logistic_c),
                "calibration_bins": self.calibration_bins,
                "horizon_sessions": self.horizon_sessions,
            },
        )


def fold_features(assigned: DataFrame, features: DataFrame) -> DataFrame:
    """Hand each fold only the features it may see: its training and calibration labels."""
    usable = assigned.where(F.col("window").isin("train", "calibration")).select("fold", "label_id")
    return usable.join(features, "label_id")


def refuse_leaked_features(assigned: DataFrame, supplied: DataFrame) -> None:
    """Refuse a label in two windows, and features for test or unknown labels."""
    twice = assigned.where("window is not null").groupBy("fold", "label_id").agg(
        F.min("window").alias("_a"), F.max("window").alias("_b")
    )
    guards.refuse(
        twice, F.col("_a") != F.col("_b"), guards.LeakError, "label in two windows",
        ["fold", "label_id"],
    )
    placed = assigned.select("fold", "label_id", "window").where("window is not null")
    judged = supplied.select("fold", "label_id").join(placed, ["fold", "label_id"], "left")
    guards.refuse(
        judged, F.coalesce(F.col("window") == "test", F.lit(True)), guards.LeakError,
        "features supplied for a label the fold does not fit on", ["fold", "label_id"],
    )


def training_rows(
    assigned: DataFrame, supplied: DataFrame, outcomes: DataFrame, config: ModelConfig
) -> DataFrame:
    """Design rows: fold, window, label_id, y, w and the features.

    A label without features is a data gap and skipped.  Features without an outcome, with
    a missing value, or with a weight that is not positive are contradictions and raise.
    """
    refuse_leaked_features(assigned, supplied)
    names = config.feature_names
    rows = (
        assigned.where(F.col("window").isin("train", "calibration"))
        .select("fold", "window", "label_id")
        .join(supplied.select("fold", "label_id", *names), ["fold", "label_id"])
        .join(
            outcomes.select(
                "label_id", F.col("forward_residual_return").alias("y"), F.col("uniqueness").alias("w")
            ),
            "label_id", "left",
        )
    )
    broken = F.col("y").isNull() | F.col("w").isNull() | ~(F.col("w") > 0)
    for name in names:
        broken = broken | F.col(name).isNull()
    guards.refuse(
        rows, broken, guards.IntegrityError, "design row is incomplete or has no positive weight",
        ["fold", "label_id"],
    )
    return rows


def centred(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Training rows less their fold's weighted means, which come along as ``_my`` and ``_mx_<i>``.

    The means are one row per fold, written down so that their size decides how they join.
    """
    train, w = rows.where("window = 'train'"), F.col("w")
    mean = lambda c: F.sum(w * F.col(c)) / F.sum(w)
    means = settle(
        train.groupBy("fold").agg(
            mean("y").alias("_my"), *[mean(a).alias(f"_mx_{i}") for i, a in enumerate(names)]
        ),
        "means",
    )
    moved = {"y": F.col("y") - F.col("_my")} | {a: F.col(a) - F.col(f"_mx_{i}") for i, a in enumerate(names)}
    return train.join(means, "fold").withColumns(moved)


def moments(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Weighted means and centred second moments of the training rows, one row per fold."""
    w, y = F.col("w"), F.col("y")
    sums = [F.sum(w).alias("sw"), F.sum(w * w).alias("sww"), F.first("_my").alias("my")]
    sums += [F.first(f"_mx_{i}").alias(f"mx_{i}") for i in range(len(names))]
    sums += [F.sum(w * F.col(a) * y).alias(f"sxy_{i}") for i, a in enumerate(names)]
    sums += [
        F.sum(w * F.col(names[i]) * F.col(names[j])).alias(f"sxx_{i}_{j}")
        for i, j in combinations_with_replacement(range(len(names)), 2)
    ]
    return centred(rows, names).groupBy("fold").agg(*sums)


def ridge(rows: DataFrame, names: Sequence[str], alpha: float) -> DataFrame:
    """Weighted ridge with a free intercept: fold, intercept, coef, effective_sample_size.

    Two passes, means and centred moments, so that large means cancel nothing; a
    features-by-features system is solved per fold.
    """
    d = len(names)

    def solve(batches):
        for frame in batches:
            out = []
            for m in frame.to_dict("records"):
                gram = np.empty((d, d))
                for i, j in combinations_with_replacement(range(d), 2):
                    gram[i, j] = gram[j, i] = m[f"sxx_{i}_{j}"]
                coef = np.linalg.solve(gram + alpha * np.eye(d), np.array([m[f"sxy_{i}"] for i in range(d)]))
                intercept = m["my"] - np.array([m[f"mx_{i}"] for i in range(d)]) @ coef
                out.append((m["fold"], float(intercept), coef.tolist(), m["sw"] ** 2 / m["sww"]))
            yield pd.DataFrame(out, columns=["fold", "intercept", "coef", "effective_sample_size"])

    return moments(rows, names).mapInPandas(
        solve, "fold int, intercept double, coef array<double>, effective_sample_size double"
    )


def _curvature(train: DataFrame, names: Sequence[str], at: DataFrame) -> DataFrame:
    """Loss, gradient and Hessian of the weighted log loss of every fold, in one grouped aggregate.

    ``at`` has one row per fold with the coefficients, the intercept first.
    """
    x = [F.lit(1.0), *[F.col(n) for n in names]]
    z = F.lit(0.0)
    for i, value in enumerate(x):
        z = z + F.col("theta")[i] * value
    rows = train.join(at, "fold").withColumn("_z", z)
    z, up, w = F.col("_z"), (F.col("y") > 0).cast("double"), F.col("w")
    p = 1.0 / (1.0 + F.exp(-z))
    loss = w * (F.log1p(F.exp(-F.abs(z))) + F.greatest(z, F.lit(0.0)) - z * up)
    sums = [F.sum(loss).alias("loss"), F.min(up).alias("lo"), F.max(up).alias("hi")]
    sums += [F.sum(w * (p - up) * v).alias(f"g_{i}") for i, v in enumerate(x)]
    sums += [
        F.sum(w * p * (1.0 - p) * x[i] * x[j]).alias(f"h_{i}_{j}")
        for i, j in combinations_with_replacement(range(len(x)), 2)
    ]
    return rows.groupBy("fold").agg(*sums)


def logistic(rows: DataFrame, names: Sequence[str], c: float, steps: int = 60) -> DataFrame:
    """Weighted L2 logistic direction (y > 0) per fold: fold, direction_intercept, direction_coef.

    The optimum of ``0.5 |coef|^2 + c * sum of weighted log losses`` with a free intercept, by
    Newton's method for all folds at once: a step is one aggregate over the rows, and one row of
    sums per fold reaches the driver.  A step that does not lower a fold's loss is halved.
    """
    spark, d = rows.sparkSession, len(names) + 1
    train = rows.where("window = 'train'").select("fold", "y", "w", *names)
    penalty = np.diag([0.0] + [1.0 / c] * (d - 1))
    theta: dict[int, np.ndarray] = {}
    best: dict[int, tuple[float, np.ndarray]] = {}
    done: set[int] = set()
    schema = "fold int, theta array<double>"
    asked = train.select("fold").distinct().select("fold", F.array(*[F.lit(0.0)] * d).alias("theta"))
    for _ in range(steps):
        for m in _curvature(train, names, asked).collect():
            if m.lo == m.hi:
                raise Uncalibrated(f"fold {m.fold}: every training outcome has the same sign")
            at = theta.get(m.fold, np.zeros(d))
            loss = m.loss + 0.5 * at @ penalty @ at
            if m.fold in best and not loss <= best[m.fold][0] + 1e-12 * abs(best[m.fold][0]):
                theta[m.fold] = (at + best[m.fold][1]) / 2
                continue
            best[m.fold] = (loss, at)
            hessian = penalty.copy()
            for i, j in combinations_with_replacement(range(d), 2):
                hessian[i, j] += m[f"h_{i}_{j}"]
                hessian[j, i] = hessian[i, j]
            step = np.linalg.solve(hessian, np.array([m[f"g_{i}"] for i in range(d)]) + penalty @ at)
            theta[m.fold] = at - step
            if np.abs(step).max() <= 1e-10 * (1.0 + np.abs(at).max()):
                done.add(m.fold)
        left = [(k, v.tolist()) for k, v in theta.items() if k not in done]
        if not left:
            break
        asked = spark.createDataFrame(left, schema)
    out = [(k, float(v[0]), v[1:].tolist()) for k, v in sorted(theta.items())]
    return spark.createDataFrame(out, "fold int, direction_intercept double, direction_coef array<double>")


def dot(coef: str, names: Sequence[str]) -> Column:
    total = F.lit(0.0)
    for i, name in enumerate(names):
        total = total + F.col(coef)[i] * F.col(name)
    return total


def scored(rows: DataFrame, fitted: DataFrame, names: Sequence[str]) -> DataFrame:
    """Add magnitude and p_up.  ``fitted`` holds one row per fold; its size decides how it joins."""
    z = F.col("direction_intercept") + dot("direction_coef", names)
    return (
        rows.join(fitted, "fold")
        .withColumn("magnitude", F.col("intercept") + dot("coef", names))
        .withColumn("p_up", 1.0 / (1.0 + F.exp(-z)))
    )


def probability_bin(bins: int) -> Column:
    """Equal-width bin of p_up: how many interior edges are not above it.

    The edges are the doubles of an even division of [0, 1], compared as they are; a
    product such as ``p * bins`` would place some edge values differently.
    """
    placed = F.lit(0)
    for edge in np.linspace(0.0, 1.0, bins + 1)[1:-1]:
        placed = placed + (F.col("p_up") >= float(edge)).cast("int")
    return placed


def calibration_error(judged: DataFrame, bins: int) -> DataFrame:
    """Expected calibration error per fold from columns p_up and y, weighing rows equally."""
    per_bin = judged.groupBy("fold", probability_bin(bins).alias("bin")).agg(
        F.count("*").alias("n"), F.avg("p_up").alias("p"),
        F.avg((F.col("y") > 0).cast("double")).alias("hit"),
    )
    return per_bin.groupBy("fold").agg(
        (F.sum(F.col("n") * F.abs(F.col("p") - F.col("hit"))) / F.sum("n")).alias("calibration_error")
    )


def effective_sample_sizes(rows: DataFrame) -> DataFrame:
    """Kish's size and the plain weight sum, which other reports use, side by side."""
    w = F.col("w")
    return rows.where("window = 'train'").groupBy("fold").agg(
        F.coalesce(F.try_divide(F.sum(w) * F.sum(w), F.sum(w * w)), F.lit(0.0)).alias("kish_size"),
        F.sum(w).alias("weight_sum"),
        F.count("*").alias("n"),
    )


def fit(
    rows: DataFrame, folds: DataFrame, config: ModelConfig, trials: DataFrame, trial_id: str
) -> DataFrame:
    """One fitted model per fold as a table, each naming the trial it belongs to.

    ``rows`` are design rows that are cheap to read again; ``folds`` the fold table; ``trials``
    the registry.  Nothing is fitted before the registry is found to hold the trial, registered
    for this configuration.
    """
    ledger.refuse_unregistered(trials, trial_id, config.version)
    names = config.feature_names
    sizes = rows.groupBy("fold", "window").count()
    present = folds.select("fold", F.explode(F.array(F.lit("train"), F.lit("calibration"))).alias("window"))
    guards.refuse(
        present.join(sizes, ["fold", "window"], "left"), F.col("count").isNull(), Uncalibrated,
        "no usable label", ["fold", "window"],
    )
    fitted = settle(
        ridge(rows, names, config.ridge_alpha).join(logistic(rows, names, config.logistic_c), "fold"),
        "fitted",
    )
    held = scored(rows.where("window = 'calibration'"), fitted, names).select(
        "fold", "p_up", "y", (F.col("y") - F.col("magnitude")).alias("residual")
    )
    [heavy] = spread.is_heavy(rows, ["fold"])
    bands = spread.quantiles(
        held, ["fold"], "residual", heavy, {"low": 0.10, "middle": 0.50, "high": 0.90}
    ).drop("n")
    used = membership_digest(rows, ["fold"], F.concat_ws("|", "window", "label_id")).drop("members")
    version = F.concat(
        F.lit("mdl-"),
        F.substring(F.sha2(F.concat_ws("|", F.lit(config.version), F.col("fold").cast("string"), "digest", "_edges"), 256), 1, 16),
    )
    edges = F.concat_ws("|", *[F.unix_micros(e).cast("string") for e in EDGES if e in folds.columns])
    return (
        fitted.join(bands, "fold")
        .join(calibration_error(held, config.calibration_bins), "fold")
        .join(used, "fold")
        .join(folds.select("fold", F.col("calibration_end").alias("fitted_through"), edges.alias("_edges")), "fold")
        .withColumns({"model_version": version, "trial_id": F.lit(trial_id)})
        .drop("digest", "_edges")
    )


def predict(models: DataFrame, candidates: DataFrame, config: ModelConfig) -> DataFrame:
    """Forecast per candidate (fold, candidate_id, as_of, features).

    An instant before the end of the calibration window is one the model has already seen:
    it raises.  Eligibility is not decided here.
    """
    names = config.feature_names
    rows = scored(candidates, models, names)
    guards.refuse(
        rows, F.col("as_of") < F.col("fitted_through"), guards.LeakError,
        "as_of precedes the end of the calibration window", ["fold", "candidate_id"],
    )
    broken = F.lit(False)
    for name in names:
        broken = broken | F.col(name).isNull()
    guards.refuse(
        candidates, broken, guards.IntegrityError, "feature is absent", ["fold", "candidate_id"]
    )
    index = {name: i for i, name in enumerate(names)}
    families = []
    for family, members in config.families.items():
        part = F.lit(0.0)
        for name in members:
            part = part + F.col("coef")[index[name]] * F.col(name)
        families.append(part.alias(f"family_{family}"))
    m = F.col("magnitude")
    return rows.select(
        "fold", "candidate_id", "as_of", F.lit(config.horizon_sessions).alias("horizon_sessions"),
        "p_up", m.alias("expected_residual_return"),
        (m + F.col("low")).alias("q10"), (m + F.col("middle")).alias("q50"), (m + F.col("high")).alias("q90"),
        *families, "calibration_error", "effective_sample_size",
        F.lit(False).alias("eligible"),
        F.array(F.lit("eligibility_not_yet_evaluated")).alias("rejection_reasons"),
        "model_version",
    )


def arm_predictions(
    train: DataFrame, test: DataFrame, arms: Mapping[str, Sequence[str]], alpha: float, seed: str
) -> DataFrame:
    """Predict the test labels once per arm: fold, label_id, arm, prediction, outcome.

    An arm is a feature subset; every arm sees the same folds and labels.  The ``shuffled``
    arm sees the combined features with outcomes permuted within each date.
    ``train`` and ``test`` are design rows that also carry ``date``.
    """
    from tidemark.operators.metrics import shuffled_within_date

    out = None
    for arm, names in arms.items():
        rows = train
        if arm == "shuffled":
            keyed = train.withColumn("label_id", F.concat_ws("|", F.col("fold").cast("string"), "label_id"))
            keyed = keyed.withColumn("_date", F.concat_ws("|", F.col("fold").cast("string"), F.col("date").cast("string")))
            mixed = shuffled_within_date(keyed.select("label_id", "_date", "y"), "_date", "y", seed)
            rows = keyed.drop("y").join(mixed.select("label_id", F.col("shuffled_y").alias("y")), "label_id")
        fitted = ridge(rows, list(names), alpha).select("fold", "intercept", "coef")
        part = test.join(fitted, "fold").select(
            "fold", "label_id", "date", F.lit(arm).alias("arm"),
            (F.col("intercept") + dot("coef", list(names))).alias("prediction"),
            F.col("y").alias("outcome"), F.col("w").alias("uniqueness"),
        )
        out = part if out is None else out.unionByName(part)
    return out

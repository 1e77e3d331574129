"""A residual model on MLlib: what the power curve misses, learned from earlier hours, added within physical bounds."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustline.functions import wind as W
from gustline.operators import fitted
from gustline.operators.splits import share_split

FEATURES = ["w", "u", "v", "hour_sin", "hour_cos", "base"]


def with_features(rows: DataFrame) -> DataFrame:
    s, c = W.cycle(F.hour("hour"), 24)
    return rows.withColumns({"hour_sin": s, "hour_cos": c, "residual": (F.col("gen") - F.col("base")) / F.col("cap")})


def residual_model(rows: DataFrame, kind: str = "boosted") -> DataFrame:
    """(plant, hour, gen, base, hybrid) of the test part: 70/15/15 by hours, no hour split between parts.

    boosted: absolute loss, ended by the validation part, under a cap that it doesn't come near; linear: a ridge regression.
    """
    parts = share_split(with_features(rows), "hour_idx").withColumn("is_validation", F.col("part") == "validation")
    learned, test = parts.where("part <> 'test'"), parts.where("part = 'test'")
    if kind == "boosted":
        model = fitted.boosted(learned, FEATURES, "residual", stop="is_validation")
    else:
        data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(learned)
        model = LinearRegression(featuresCol="features", labelCol="residual", regParam=0.01).fit(data)
    return fitted.corrected(model, test, FEATURES).select("plant", "hour", "gen", "base", "hybrid")


def approval(out: DataFrame) -> DataFrame:
    """One row: errors of the power curve and of the corrected estimate on the test part, and whether the correction may be used: only if it is better."""
    errors = out.agg(F.count("*").alias("rows"), F.avg(F.abs(F.col("base") - F.col("gen"))).alias("base_mae"), F.avg(F.abs(F.col("hybrid") - F.col("gen"))).alias("hybrid_mae"))
    return errors.withColumn("approved", F.col("hybrid_mae") < F.col("base_mae"))


def refit(rows: DataFrame, candidates: dict[str, dict], folds: int = 2, gap_hours: int = 6, least: int = 1, most: int = fitted.MOST_ROUNDS):
    """(model, candidate, rounds, results, digest): the candidate that is best over folds of these development rows, fitted again on all of them.

    In the folds validation ends each run; the refit has no validation part and makes the median of the folds' rounds, within [least, most].
    """
    rows = with_features(rows)
    parts = fitted.expanding(rows, "hour_idx", folds, gap_hours, stopping=True)
    found = rows.sparkSession.createDataFrame(fitted.boosted_path(rows, "hour_idx", parts, "residual", FEATURES, candidates), "candidate string, fold int, rounds int, rows long, mae double")
    digest = fitted.selection_digest(found, parts)
    name = fitted.checked_selection(found, parts, digest, list(candidates))
    rounds = fitted.refit_rounds([r["rounds"] for r in found.where(F.col("candidate") == name).collect()], least, most)
    return fitted.boosted(rows, FEATURES, "residual", rounds=rounds, **candidates[name]), name, rounds, found, digest


def refit_approval(rows: DataFrame, candidates: dict[str, dict]) -> DataFrame:
    """One row: the candidate, the rounds of its refit on the first 85 percent of hours, and its approval on the rest."""
    parts = share_split(rows, "hour_idx")
    model, name, rounds, _, _ = refit(parts.where("part <> 'test'"), candidates)
    out = fitted.corrected(model, with_features(parts.where("part = 'test'")), FEATURES)
    return approval(out).select(F.lit(name).alias("candidate"), F.lit(rounds).alias("rounds"), "rows", "base_mae", "hybrid_mae", "approved")

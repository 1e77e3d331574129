"""Stored models: kept with hashes of their files and of the rows that judged them, checked when loaded; where anything differs the power curve stands in."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gustline.operators import checks, fitted
from gustline.sources import ordered, periods

KIND = "ridge-correction-1"
_PARTS = ["model", "groups", "evaluation"]


@dataclass(frozen=True)
class Stored:
    """A loaded correction. Where ``fault`` is not null it must not be used, and ``estimate`` gives the power curve."""

    path: str
    fault: str | None
    features: tuple[str, ...] = ()
    coefficients: tuple[float, ...] = ()
    evaluation: dict | None = None

    def estimate(self, rows: DataFrame, group: str) -> DataFrame:
        """Rows with ``hybrid`` and ``reason``: model; or the power curve because the model has a fault (its name), the group was not trained on (unknown_group) or a feature is missing (incomplete).

        Known groups are met by a join with the stored ones, however many there are.
        """
        if self.fault:
            return rows.withColumns({"hybrid": F.col("base"), "reason": F.lit(self.fault)})
        known = rows.sparkSession.read.parquet(f"{self.path}/groups").select(F.col("group").alias(group), F.lit(True).alias("_known"))
        complete = F.expr(" AND ".join(f"`{f}` IS NOT NULL" for f in self.features))
        reason = F.when(F.col("_known").isNull(), "unknown_group").when(~complete, "incomplete").otherwise("model")
        correction = fitted.linear(np.array(self.coefficients), list(self.features))
        out = rows.join(known, group, "left").withColumn("reason", reason).drop("_known")
        return out.withColumn("hybrid", F.when(F.col("reason") == "model", fitted.bounded_estimate(correction)).otherwise(F.col("base")))


def file_hashes(spark: SparkSession, path: str, parts: list[str] = _PARTS) -> DataFrame:
    """(file, bytes, sha256) of the files in some folders of a stored model, by folder and name. Each file is hashed whole in a task: these are files of models, not of tables (at most 2 GB each)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([f"{path}/{p}" for p in parts])
    return files.select(F.substring_index("path", "/", -2).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def _errors(judged: DataFrame) -> DataFrame:
    gap = lambda c: F.avg(F.abs(F.col(c) - F.col("gen")))
    return judged.agg(F.count("*").alias("rows"), gap("base").alias("base_mae"), gap("hybrid").alias("hybrid_mae"))


def _digest(test: DataFrame, group: str, hour: str, features: tuple[str, ...]) -> str:
    return ordered.ordered_hash(test, [hour, group], [group, hour, *features, "base", "gen"]).first()["digest"]


def save(training: DataFrame, test: DataFrame, path: str, group: str, hour: str, features: list[str], target: str, penalty: float = 1.0) -> None:
    """Fits a ridge correction of the power curve on the training rows, judges it on the test rows, and keeps model, known groups, evaluation and a manifest of file hashes at ``path``.

    The evaluation records the test rows' hours, count and ordered hash, both errors, and whether the model is approved: only if it is better than the curve. Refused: empty parts, and test rows that begin
    before training has ended. The output appears as a whole; one that is there already is an error.
    """
    (end,), (start, last, n) = training.agg(F.max(hour)).first(), test.agg(F.min(hour), F.max(hour), F.count("*")).first()
    if end is None or not n:
        raise checks.ContractError("training and test must have rows")
    if start <= end:
        raise checks.ContractError("the test begins before training has ended")
    spark = test.sparkSession
    learned = training.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [target, *features]))
    (sums,) = fitted.products(learned, features, [target], hour, [int(start)])
    if sums[0, 0] == 0:
        raise checks.ContractError("no row is left to train on")
    beta = [float(b) for b in fitted.ridge(sums, len(features), 0, penalty)]

    def write(part: str) -> None:
        terms = [(KIND, k, f, b) for k, (f, b) in enumerate(zip(["", *features], beta))]
        spark.createDataFrame(terms, "kind string, position int, feature string, coefficient double").coalesce(1).write.parquet(f"{part}/model")
        learned.select(F.col(group).alias("group")).distinct().write.parquet(f"{part}/groups")
        judged = Stored(part, None, tuple(features), tuple(beta)).estimate(test, group)
        facts = _errors(judged).select(F.lit(int(start)).alias("start"), F.lit(int(last)).alias("end"), "*", (F.col("hybrid_mae") < F.col("base_mae")).alias("approved"), F.lit(_digest(test, group, hour, tuple(features))).alias("digest"))
        facts.coalesce(1).write.parquet(f"{part}/evaluation")
        file_hashes(spark, part).coalesce(1).write.parquet(f"{part}/manifest")

    periods.staged_folder(spark, path, write)


def load(spark: SparkSession, path: str) -> Stored:
    """The model at a path, or why it can't be used: missing (a part is not there), changed (files or their hashes are not the manifest's), invalid (another kind, terms that are not numbers or repeat, an approval that its own
    errors contradict) or not_approved. The driver gets the model's terms and one row of evaluation.
    """
    spark.catalog.refreshByPath(path)
    try:
        manifest = spark.read.parquet(f"{path}/manifest").select("file", "bytes", "sha256")
        now = file_hashes(spark, path)
        differ = now.exceptAll(manifest).unionAll(manifest.exceptAll(now))
        if not differ.isEmpty():
            return Stored(path, "changed")
        terms = spark.read.parquet(f"{path}/model").orderBy("position").collect()
        facts = spark.read.parquet(f"{path}/evaluation").first()
    except AnalysisException:  # a folder is not there, or holds no table
        return Stored(path, "missing")
    ok = facts is not None and len(terms) > 1 and [t["position"] for t in terms] == list(range(len(terms))) and all(t["kind"] == KIND and math.isfinite(t["coefficient"]) for t in terms)
    if not ok or facts["approved"] != (facts["hybrid_mae"] < facts["base_mae"]):
        return Stored(path, "invalid")
    return Stored(path, None if facts["approved"] else "not_approved", tuple(t["feature"] for t in terms[1:]), tuple(t["coefficient"] for t in terms), facts.asDict())


def reevaluate(model: Stored, rows: DataFrame, group: str, hour: str) -> DataFrame:
    """One row (rows, base_mae, hybrid_mae): the model judged again on the test rows that its evaluation names, found in a table by their hours.

    Refused: a model with a fault, and rows whose count or ordered hash is not the recorded one.
    """
    if model.fault:
        raise checks.ContractError(f"the model can't be judged: {model.fault}")
    was = model.evaluation
    test = rows.where(F.col(hour).between(was["start"], was["end"]))
    if test.count() != was["rows"] or _digest(test, group, hour, model.features) != was["digest"]:
        raise checks.ContractError("the test rows are not those that the evaluation recorded")
    return _errors(model.estimate(test, group))

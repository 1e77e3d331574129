"""Models fitted over time: ridge regressions from sums of products, cross-fitted effects, walk-forward tuning, boosting that validation ends."""

from __future__ import annotations

import hashlib
import json
import statistics
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gustline.functions import wind as W
from gustline.operators.calibrate import orthogonal_effect
from gustline.operators.checks import ContractError
from gustline.operators.splits import block_of, ranked_hours


@dataclass(frozen=True)
class Fold:
    """Hours of a fold: it trains before ``train_end``, may stop by [stop_start, stop_end) and is judged on [start, end]. Without a stopping part both are equal."""

    number: int
    train_end: int
    stop_start: int
    stop_end: int
    start: int
    end: int


def expanding(rows: DataFrame, hour: str, folds: int, gap_hours: int, stopping: bool = False) -> list[Fold]:
    """Blocks of distinct hours, nearly equal: the first warms up, every later one is judged by what lies more than the gap before it.

    With ``stopping`` the block before the judged one ends training, and the blocks before that, less the gap, are learned from. The driver gets one row for each block.
    """
    ranks = ranked_hours(rows, hour)
    blocks = ranks.withColumn("_b", block_of(F.col("rank"), F.col("n"), folds + 1 + stopping)).groupBy("_b").agg(F.min(hour).alias("first"), F.max(hour).alias("last")).orderBy("_b").collect()
    if len(blocks) < folds + 1 + stopping:
        raise ContractError(f"{len(blocks)} blocks of hours: too few for {folds} folds")
    out = []
    for k in range(folds):
        judged = blocks[k + 1 + stopping]
        cutoff = judged["first"] - gap_hours
        stop = blocks[k + 1]["first"] if stopping else cutoff
        out.append(Fold(k + 1, stop - gap_hours if stopping else cutoff, stop, cutoff, judged["first"], judged["last"]))
    return out


def of_fold(folds: list[Fold], hour: str, value) -> Column:
    """A column for the fold that judges the row's hour: null for hours that none judges."""
    return F.coalesce(*(F.when(F.col(hour).between(f.start, f.end), value(f)) for f in folds))


def products(rows: DataFrame, features: list[str], targets: list[str], hour: str, edges: list[int]) -> np.ndarray:
    """Sums of products of (1, features, targets) over all rows before each edge, as matrices.

    One aggregation over the rows, by the span between edges that a row's hour lies in: partial sums are formed before the shuffle, and the driver gets a row of
    numbers for each span. Sums up to an edge are sums over the spans before it.
    """
    names = [*features, *targets]
    x = [F.lit(1.0), *(F.col(c).cast("double") for c in names)]
    ordered = sorted(set(edges))
    span = sum(((F.col(hour) >= e).cast("int") for e in ordered), F.lit(0))
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    found = rows.groupBy(span.alias("_span")).agg(*(F.sum(x[i] * x[j]).alias(f"s{k}") for k, (i, j) in enumerate(pairs))).collect()
    spans = np.zeros((len(ordered) + 1, len(x), len(x)))
    for r in found:
        for k, (i, j) in enumerate(pairs):
            spans[r["_span"], i, j] = spans[r["_span"], j, i] = r[f"s{k}"] or 0.0
    upto = np.cumsum(spans, axis=0)
    return np.stack([upto[ordered.index(e)] for e in edges])


def ridge(sums: np.ndarray, n_features: int, target: int, penalty: float) -> np.ndarray:
    """Intercept and coefficients: least squares plus ``penalty`` times the squares of all coefficients but the intercept, from sums of products."""
    p = n_features + 1
    shrink = np.diag([0.0] + [penalty] * n_features)
    return np.linalg.lstsq(sums[:p, :p] + shrink, sums[:p, p + target], rcond=None)[0]


def linear(coefficients: np.ndarray, features: list[str]) -> Column:
    return sum((F.lit(float(c)) * F.col(f) for c, f in zip(coefficients[1:], features)), F.lit(float(coefficients[0])))


@dataclass(frozen=True)
class Effect:
    """A partially linear model: outcome = controls + theta x (treatment less what controls say of it)."""

    theta: float
    se: float
    low: float
    high: float
    blocks: int
    rows: int
    treatment_std: float
    features: tuple[str, ...]
    outcome: np.ndarray
    treatment: np.ndarray
    treatment_col: str
    group: str | None
    groups: tuple

    def predict(self, rows: DataFrame) -> Column:
        """The outcome as a column over rows that have the controls and the treatment; a group that the model was not fitted on is refused (a job looks for one)."""
        if self.group and not rows.where(F.col(self.group).isNull() | ~F.col(self.group).isin(*self.groups)).isEmpty():
            raise ContractError("rows of groups that the model does not know")
        features = list(self.features)
        return linear(self.outcome, features) + self.theta * (F.col(self.treatment_col) - linear(self.treatment, features))


def cross_fitted_residuals(rows: DataFrame, hour: str, folds: list[Fold], outcome: str, treatment: str, features: list[str], penalty: float) -> DataFrame:
    """Judged rows with fold, y and d: outcome and treatment less what ridge models of the hours before the fold's cutoff say of them."""
    sums = products(rows, features, [outcome, treatment], hour, [f.train_end for f in folds])
    if any(s[0, 0] == 0 for s in sums):
        raise ContractError("a fold has no rows to train on")
    beta = {f.number: [ridge(s, len(features), k, penalty) for k in (0, 1)] for f, s in zip(folds, sums)}
    less = lambda c, k: F.col(c) - of_fold(folds, hour, lambda f: linear(beta[f.number][k], features))
    out = rows.withColumns({"fold": of_fold(folds, hour, lambda f: F.lit(f.number)), "y": less(outcome, 0), "d": less(treatment, 1)})
    return out.where("fold IS NOT NULL AND y IS NOT NULL AND d IS NOT NULL")


def fitted_effect(
    rows: DataFrame, hour: str, outcome: str, treatment: str, features: list[str], folds: int = 4, gap_hours: int = 6, penalty: float = 1e-3, least_rows: int = 100, least_std: float = 1e-3, cluster_hours: int = 24, group: str | None = None
) -> Effect:
    """The effect of a treatment on an outcome, given controls, with fitted nuisances.

    Both are predicted by ridge models of the controls, each fold by earlier hours only; theta is the slope of what remains of the outcome on what remains of the treatment, its error clustered by
    blocks of hours. Refused: fewer out-of-fold rows than ``least_rows``, and a treatment that the controls leave less than ``least_std`` of (no overlap). Rows with a null among
    the inputs are left out. The model that is kept is fitted on all rows. Four aggregations over the rows, of which the driver gets sums.
    """
    used = rows.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [hour, outcome, treatment, *features]))
    parts = expanding(used, hour, folds, gap_hours)
    left = cross_fitted_residuals(used, hour, parts, outcome, treatment, features, penalty)
    n, std = left.agg(F.count("*"), F.stddev_samp("d")).first()
    if n < least_rows:
        raise ContractError(f"{n} out-of-fold rows: at least {least_rows} are needed")
    if std is None or not std >= least_std:
        raise ContractError("no overlap: the controls determine the treatment")
    found = orthogonal_effect(left, F.col("y"), F.col("d"), hour, cluster_hours).first()
    last = used.agg(F.max(hour)).first()[0] + 1
    (whole,) = products(used, features, [outcome, treatment], hour, [last])
    known = tuple(r[0] for r in used.select(group).distinct().orderBy(group).limit(100_001).collect()) if group else ()
    if len(known) > 100_000:
        raise ContractError("more than 100,000 groups: check them by a join instead")
    models = [ridge(whole, len(features), k, penalty) for k in (0, 1)]
    return Effect(found["theta"], found["se"], found["low"], found["high"], found["blocks"], found["rows"], float(std), tuple(features), *models, treatment, group, known)


def bounded_estimate(correction: Column) -> Column:
    """The power curve plus a correction in shares of capacity, within physical bounds."""
    return W.bounded(F.col("base"), correction * F.col("cap"), F.col("w"), F.col("cap"), F.col("avail"))


def ridge_path(rows: DataFrame, hour: str, folds: list[Fold], target: str, features: list[str], penalties: dict[str, float]) -> DataFrame:
    """(candidate, fold, rounds, rows, mae): ridge corrections of the power curve, every candidate in every fold.

    All candidates share the sums of products of a fold's training hours (one aggregation), and all are judged in one more pass, each as a column.
    """
    sums = products(rows.where(F.col(target).isNotNull()), features, [target], hour, [f.train_end for f in folds])
    if any(s[0, 0] == 0 for s in sums):
        raise ContractError("a fold has no rows to train on")
    beta = {(f.number, c): ridge(s, len(features), 0, p) for f, s in zip(folds, sums) for c, p in penalties.items()}
    guess = {c: bounded_estimate(of_fold(folds, hour, lambda f, c=c: linear(beta[f.number, c], features))) for c in penalties}
    judged = rows.withColumn("fold", of_fold(folds, hour, lambda f: F.lit(f.number))).where("fold IS NOT NULL")
    errors = judged.groupBy("fold").agg(F.count("*").alias("rows"), *(F.avg(F.abs(g - F.col("gen"))).alias(f"e{k}") for k, g in enumerate(guess.values())))
    lines = F.array(*(F.struct(F.lit(c).alias("candidate"), F.col(f"e{k}").alias("mae")) for k, c in enumerate(guess)))
    return errors.select("fold", "rows", F.explode(lines).alias("x")).select("x.candidate", "fold", F.lit(1).alias("rounds"), "rows", "x.mae")


#: A cap that no run has come near: validation ends training, see ``boosted``.
MOST_ROUNDS = 2500


def boosted(train: DataFrame, features: list[str], target: str, rounds: int | None = None, stop: str | None = None, depth: int = 4, step: float = 0.1, seed: int = 7):
    """A boosted model (absolute loss). With ``stop`` (a boolean column) the rows it marks end training: the first round that makes their error worse is the last, and the rounds up to the
    best one are kept. Without it exactly ``rounds`` are made."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    data = VectorAssembler(inputCols=features, outputCol="features").transform(train)
    extra = {"validationIndicatorCol": stop, "validationTol": 0.0} if stop else {}
    return GBTRegressor(featuresCol="features", labelCol=target, lossType="absolute", maxIter=rounds or MOST_ROUNDS, maxDepth=depth, stepSize=step, seed=seed, **extra).fit(data)


def corrected(model, rows: DataFrame, features: list[str], name: str = "hybrid") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    out = model.transform(VectorAssembler(inputCols=features, outputCol="features").transform(rows))
    return out.withColumn(name, bounded_estimate(F.col("prediction"))).drop("features", "prediction")


def boosted_path(rows: DataFrame, hour: str, folds: list[Fold], target: str, features: list[str], candidates: dict[str, dict]) -> list[tuple]:
    """(candidate, fold, rounds, rows, mae) of boosted candidates (depth, step), each fold ended by its own stopping hours; one training run each."""
    out = []
    for f in folds:
        h = F.col(hour)
        learned = rows.where((h < f.train_end) | ((h >= f.stop_start) & (h < f.stop_end))).withColumn("_stop", h >= f.stop_start)
        judged = rows.where(h.between(f.start, f.end))
        for c, options in candidates.items():
            model = boosted(learned, features, target, stop="_stop", **options)
            n, mae = corrected(model, judged, features).agg(F.count("*"), F.avg(F.abs(F.col("hybrid") - F.col("gen")))).first()
            out.append((c, f.number, model.getNumTrees, n, mae))
    return out


def ranked(results: DataFrame) -> DataFrame:
    """(candidate, fold, rounds, rows, mae, mean_mae, rank): candidates by their mean over folds, ties by name; a row for each candidate and fold, so a small table."""
    every = results.withColumn("mean_mae", F.avg("mae").over(Window.partitionBy("candidate")))
    return every.withColumn("rank", F.dense_rank().over(Window.orderBy(F.round("mean_mae", 12), "candidate")))


def selection_digest(results: DataFrame, folds: list[Fold]) -> str:
    """SHA-256 over the folds' hours and all candidates' results, in one order: another fold, candidate, count or error gives another digest."""
    lines = [[r["candidate"], r["fold"], r["rounds"], r["rows"], f"{r['mae']:.9g}"] for r in results.orderBy("candidate", "fold").collect()]
    return hashlib.sha256(json.dumps([[list(vars(f).values()) for f in folds], lines]).encode()).hexdigest()


def checked_selection(results: DataFrame, folds: list[Fold], digest: str, candidates: list[str]) -> str:
    """The best candidate's name, if the results are whole (every candidate in every fold once, with an error that is a number) and have this digest."""
    rows = results.select("candidate", "fold", "rounds", "rows", "mae").collect()  # one for each candidate and fold
    want = sorted((c, f.number) for c in candidates for f in folds)
    if sorted((r["candidate"], r["fold"]) for r in rows) != want:
        raise ContractError("candidates or folds are missing, repeated or unknown")
    if any(r["mae"] is None or not np.isfinite(r["mae"]) or r["rounds"] < 1 for r in rows):
        raise ContractError("an error or a number of rounds is not valid")
    if selection_digest(results, folds) != digest:
        raise ContractError("results or folds were changed")
    return ranked(results).orderBy("rank").first()["candidate"]


def refit_rounds(rounds: list[int], least: int = 1, most: int = MOST_ROUNDS) -> int:
    """Rounds for a model of all development rows: the median of the folds' (of two middle ones the mean, rounded down), within bounds."""
    return max(least, min(int(statistics.median(sorted(rounds))), most))

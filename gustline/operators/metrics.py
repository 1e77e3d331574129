"""Error metrics as lists of aggregates, by any grouping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gustline.functions import wind as W
from gustline.functions.scalars import ratio
from gustline.operators.checks import few
from gustline.shared import shared_dir

#: Cells that a round of a search for quantiles counts in; rows of a slice that are counted by value; rounds before that is done with any number; slices that are broadcast. Only speed depends on them.
CELLS, FEW_ROWS, ROUNDS, MOST_SLICES = 256, 65_536, 12, 10_000


def regression(actual: Column, predicted: Column, capacity: Column) -> list[Column]:
    shares = [F.percentile(x, q).alias(name) for name, (x, q) in regression_quantiles(actual, predicted, capacity).items()]
    return regression_means(actual, predicted, capacity) + shares


def regression_means(actual: Column, predicted: Column, capacity: Column) -> list[Column]:
    """Those of the regression metrics that need no order of rows."""
    error = predicted - actual
    return [
        F.count("*").alias("rows"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error / capacity)).alias("nmae"),
        ratio(F.sum(F.abs(error)), F.sum(F.abs(actual))).alias("wape"),
        F.avg(error).alias("bias"),
        F.avg(error / capacity).alias("normalized_bias"),
    ]


def regression_quantiles(actual: Column, predicted: Column, capacity: Column) -> dict[str, tuple[Column, float]]:
    error = predicted - actual
    return {"p95_abs": (F.abs(error), 0.95), "p95_normalized": (F.abs(error / capacity), 0.95)}


def pearson(x: Column, y: Column) -> Column:
    """Correlation; null where a side doesn't vary."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def r2(actual: Column, predicted: Column) -> Column:
    error = predicted - actual
    return 1 - F.sum(error * error) / F.nullif(F.var_pop(actual) * F.count(actual), F.lit(0.0))


def extended(actual: Column, predicted: Column) -> list[Column]:
    error = predicted - actual
    ape = F.when(actual != 0, F.abs(error) / F.abs(actual))
    out = [
        r2(actual, predicted).alias("r2"),
        pearson(actual, predicted).alias("pearson"),
        F.sum(actual).alias("actual_total"),
        F.sum(predicted).alias("predicted_total"),
        F.sum(error).alias("signed_difference"),
        ratio(F.sum(error), F.sum(actual)).alias("signed_fraction"),
        F.avg(ape).alias("mape"),
        F.count_if(actual == 0).alias("zero_rows"),
    ]
    for q in (50, 90, 95, 99):
        out += [F.percentile(F.abs(error), q / 100).alias(f"p{q}_abs"), F.percentile(ape, q / 100).alias(f"p{q}_ape")]
    return out


def slices(rows: DataFrame, metrics: list[Column], dimensions: list[str]) -> DataFrame:
    """Metrics over all rows and by each dimension, in one pass of grouping sets."""
    sets = [[], *([F.col(d)] for d in dimensions)]
    return rows.groupingSets(sets, *dimensions).agg(*(F.grouping(d).cast("int").alias(f"all_{d}") for d in dimensions), *metrics)


def slices_with_quantiles(rows: DataFrame, metrics: list[Column], quantiles: dict[str, tuple[Column, float]], dimensions: list[str]) -> DataFrame:
    """As ``slices``, with exact interpolated quantiles (a column and a share by name) of any number of rows; nulls don't count.

    A quantile is searched for: the rows between a slice's bounds are counted in cells of equal width, and the cell that holds the rank gives the next bounds, until few rows are left, which are counted by value.
    So no task holds a slice's values; rounds pass over the rows again, and a slice's dimension is compared as text.
    """
    shared_dir(rows.sparkSession)
    names = list(quantiles)
    ends = [f(F.col(f"_{n}")).alias(f"_{k}_{n}") for n in names for k, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]
    rows = rows.withColumns({f"_{n}": x.cast("double") for n, (x, _) in quantiles.items()})
    sliced = reduce(lambda chain, d: chain.when(F.col(f"all_{d}") == 0, F.struct(F.lit(d).alias("_slice"), F.col(d).cast("string").alias("_of"))), dimensions, F)
    whole = slices(rows, [*metrics, *ends], dimensions).withColumn("_s", sliced.otherwise(F.struct(F.lit("").alias("_slice"), F.lit("").alias("_of")))).select("*", "_s.*").drop("_s").checkpoint()
    # for each slice and quantile: rank sought, rows below the bounds and within them, bounds, and the next value behind them
    one = lambda n: F.struct(F.lit(n).alias("_name"), F.col(f"_n_{n}").alias("_n"), (F.lit(quantiles[n][1]) * (F.col(f"_n_{n}") - 1)).alias("_place"), F.col(f"_lo_{n}").alias("_lo"), F.col(f"_hi_{n}").alias("_hi"))
    state = whole.select("_slice", "_of", F.explode(F.array(*map(one, names))).alias("x")).select("_slice", "_of", "x.*").where("_n > 0").withColumns({"_id": F.monotonically_increasing_id(), "_base": F.lit(0).cast("long"), "_next": F.lit(None).cast("double")})
    # a row for each slice that it is in, then one for each quantile
    long = rows.select(F.lit("").alias("_all"), *(F.col(d).cast("string").alias(d) for d in dimensions), *(f"_{n}" for n in names)).withColumnsRenamed({"_all": "", **{f"_{n}": n for n in names}})
    long = long.unpivot([F.col(f"`{n}`") for n in names], [F.col(f"`{d}`") for d in ("", *dimensions)], "_slice", "_of").unpivot(["_slice", "_of"], names, "_name", "_v")
    key, done = ["_slice", "_of", "_name"], []
    for k in range(ROUNDS + 1):
        state = state.checkpoint()
        done.append(state.where("_lo = _hi"))
        state = state.where("_lo <> _hi")
        most = state.agg(F.max("_n")).first()[0]
        if most is None:
            break
        at = state.select(F.col("_slice").alias("_s"), F.col("_of").alias("_o"), F.col("_name").alias("_q"), "_id", "_lo", "_hi")
        met = (F.col("_slice") == F.col("_s")) & F.col("_of").eqNullSafe(F.col("_o")) & (F.col("_name") == F.col("_q"))
        inside = long.join(few(at, MOST_SLICES), met).where("_v BETWEEN _lo AND _hi")
        v, lo, hi = (F.col(c) / 2 for c in ("_v", "_lo", "_hi"))  # halves, as a difference of large doubles may overflow
        width = F.when(F.col("_v") >= F.col("_hi"), float(CELLS)).otherwise(F.floor((v - lo) / (hi - lo) * CELLS).cast("double"))
        cell = F.col("_v") if most <= FEW_ROWS or k == ROUNDS else width
        cells = inside.groupBy("_id", cell.alias("_cell")).agg(F.count("*").alias("_c"), F.min("_v").alias("_a"), F.max("_v").alias("_z"))
        order = Window.partitionBy("_id").orderBy("_cell")
        cells = cells.withColumns({"_upto": F.sum("_c").over(order), "_after": F.lead("_a").over(order)})
        rank = F.floor("_place") - F.col("_base")
        found = state.join(cells, "_id").where((F.col("_upto") > rank) & (F.col("_upto") - F.col("_c") <= rank))
        state = found.select("_id", *key, F.col("_c").alias("_n"), "_place", F.col("_a").alias("_lo"), F.col("_z").alias("_hi"), (F.col("_base") + F.col("_upto") - F.col("_c")).alias("_base"), F.coalesce("_after", "_next").alias("_next"))
    # the value at the rank, and the next one where the rank is the last of its equals
    low, part = F.col("_lo"), F.col("_place") - F.floor("_place")
    high = F.when(F.floor("_place") + 1 < F.col("_base") + F.col("_n"), low).otherwise(F.coalesce("_next", low))
    values = reduce(DataFrame.unionByName, done).select(*key, F.when((part == 0) | (high == low), low).otherwise(low + (high - low) * part).alias("_v"))
    wide = values.groupBy(F.col("_slice").alias("_s"), F.col("_of").alias("_o")).agg(*(F.max(F.when(F.col("_name") == n, F.col("_v"))).alias(n) for n in names))
    out = whole.join(few(wide, MOST_SLICES), (F.col("_slice") == F.col("_s")) & F.col("_of").eqNullSafe(F.col("_o")), "left")
    return out.drop("_slice", "_of", "_s", "_o", *(f"_{k}_{n}" for n in names for k in ("n", "lo", "hi")))


def by_hour(rows: DataFrame, hour: str, sums: list[str]) -> DataFrame:
    """Totals over all plants, by hour: the level at which grid metrics are taken."""
    return rows.groupBy(hour).agg(*(F.sum(c).alias(c) for c in sums))


def grid_user(actual: Column, predicted: Column, hour: Column) -> list[Column]:
    error = predicted - actual
    ape = F.when(F.abs(actual) > 1e-9, F.abs(error) / F.abs(actual))
    first = -hour.cast("long")  # of equal peaks the earliest
    return [
        r2(actual, predicted).alias("r2"),
        pearson(actual, predicted).alias("pearson"),
        F.percentile(ape, 0.5).alias("median_ape"),
        F.percentile(ape, 0.9).alias("p90_ape"),
        *(F.avg((ape <= x / 100).cast("double")).alias(f"within_{x}") for x in (5, 10, 15, 20)),
        F.max(actual).alias("actual_peak"),
        F.max_by(predicted, F.struct(actual, first)).alias("predicted_at_peak"),
        F.max_by(hour, F.struct(actual, first)).alias("peak_hour"),
        F.max(predicted).alias("predicted_peak"),
        F.max_by(hour, F.struct(predicted, first)).alias("predicted_peak_hour"),
    ]


def reference_gap(a: Column, b: Column, tolerance: float = 1e-9) -> list[Column]:
    """Totals of two series, their relative gap, and shares of rows where the first is above, equal or below."""
    gap = a - b
    return [
        F.count("*").alias("rows"),
        F.sum(a).alias("total_a"),
        F.sum(b).alias("total_b"),
        ratio(F.sum(gap), F.sum(b)).alias("gap_fraction"),
        F.avg((gap > tolerance).cast("double")).alias("above"),
        F.avg((F.abs(gap) <= tolerance).cast("double")).alias("equal"),
        F.avg((gap < -tolerance).cast("double")).alias("below"),
    ]


def reconciliation(a: Column, b: Column, tolerance: float = 1e-3) -> list[Column]:
    return [F.avg(F.abs(a - b)).alias("mae"), F.max(F.abs(a - b)).alias("max_abs"), F.count_if(F.abs(a - b) > tolerance).alias("rows_beyond")]


def interval_table(rows: DataFrame, band: str, error: Column, least: int = 20) -> DataFrame:
    """(band, n, p05, p95, source): quantiles of signed errors by band; bands with fewer rows take those of all."""
    q = [F.count("*").alias("n"), F.percentile(error, 0.05).alias("p05"), F.percentile(error, 0.95).alias("p95")]
    whole = rows.agg(F.percentile(error, 0.05).alias("all05"), F.percentile(error, 0.95).alias("all95"))
    bands = rows.sparkSession.createDataFrame([(b,) for b in W.BAND_LABELS], f"{band} string")
    each = bands.join(rows.groupBy(band).agg(*q), band, "left").join(F.broadcast(whole))  # one row of two numbers
    enough = F.coalesce(F.col("n") >= least, F.lit(False))
    return each.select(
        band,
        F.coalesce("n", F.lit(0)).alias("n"),
        F.when(enough, F.col("p05")).otherwise(F.col("all05")).alias("p05"),
        F.when(enough, F.col("p95")).otherwise(F.col("all95")).alias("p95"),
        F.when(enough, "band").otherwise("all").alias("source"),
    )


def interval_coverage(rows: DataFrame, table: DataFrame, band: str, actual: Column, predicted: Column, wind: Column, capacity: Column, availability: Column) -> DataFrame:
    """Share of rows inside their band's interval, and its mean width; the table has a row for each of six bands."""
    joined = rows.join(few(table.select(band, "p05", "p95")), band, "left")
    low = W.bounded(predicted, F.col("p05") * capacity, wind, capacity, availability)
    high = W.bounded(predicted, F.col("p95") * capacity, wind, capacity, availability)
    return joined.agg(F.count("*").alias("rows"), F.avg(actual.between(low, high).cast("double")).alias("inside"), F.avg(high - low).alias("width"))


def weighted_mean(x: Column, w: Column) -> Column:
    """Over rows where the value is known and the weight positive."""
    ok = x.isNotNull() & (w > 0)
    return F.sum(F.when(ok, x * w)) / F.nullif(F.sum(F.when(ok, w)), F.lit(0.0))


def first_known(value: Column, order: Column) -> Column:
    """The first value that is not null, by an order."""
    return F.min_by(value, F.when(value.isNotNull(), order))


def weighted_hours(rows: DataFrame, keys: list[str], values: list[str], weight: str, order: str) -> DataFrame:
    """Weighted means of several columns by key, with the first member, the largest weight and the number of different ones."""
    means = [weighted_mean(F.col(v), F.col(weight)).alias(v) for v in values]
    return rows.groupBy(*keys).agg(*means, F.min(order).alias("first_member"), F.max(weight).alias("most"), F.count_distinct(weight).alias("members"))


def snapped_bounds(lat: Column, lon: Column, margin: float = 0.25, step: float = 0.25) -> list[Column]:
    """North, west, south, east with a margin, snapped outward to a grid."""
    up, down = lambda x: F.ceil((x + margin) / step).cast("double") * step, lambda x: F.floor((x - margin) / step).cast("double") * step
    return [up(F.max(lat)).alias("north"), down(F.min(lon)).alias("west"), down(F.min(lat)).alias("south"), up(F.max(lon)).alias("east")]


def equal_frequency(rows: DataFrame, x: str, y: str, bins: int = 8) -> DataFrame:
    """(bin, rows, mean of x, mean of y): bins between exact quantiles, so equal values share a bin."""
    from gustline.operators.stages import exact_quantiles

    edges = exact_quantiles(rows, x, [i / bins for i in range(1, bins)]).agg(F.array_sort(F.collect_list("value")).alias("edges"))
    placed = rows.join(F.broadcast(edges)).withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col(x))))  # one row of a few numbers
    return placed.groupBy("bin").agg(F.count("*").alias("rows"), F.avg(x).alias(f"mean_{x}"), F.avg(y).alias(f"mean_{y}"))

"""Joins with declared cardinalities, and by validity, priority, coverage and nearness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gustline.functions import scalars as S
from gustline.operators.checks import few, require_unique


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    return require_unique(left, keys).join(require_unique(right, keys), keys, how)


def many_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    return left.join(require_unique(right, keys), keys, how)


def coverage(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: keys of both sides, matched ones, and their share of the left."""
    marked = left.select(*keys).withColumn("l", F.lit(1)).join(right.select(*keys).withColumn("r", F.lit(1)), keys, "full_outer")
    out = marked.agg(F.count("l").alias("left_rows"), F.count("r").alias("right_rows"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("matched"))
    return out.withColumn("share", S.ratio(F.col("matched").cast("double"), F.col("left_rows").cast("double")))


def coverage_audit(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(side, rows) of a full outer join: both, only the left, only the right."""
    marked = left.select(*keys).withColumn("l", F.lit(1)).join(right.select(*keys).withColumn("r", F.lit(1)), keys, "full_outer")
    side = F.when(F.col("r").isNull(), "left_only").when(F.col("l").isNull(), "right_only").otherwise("both")
    return marked.groupBy(side.alias("side")).agg(F.count("*").alias("rows"))


def capacity_by_validity(rows: DataFrame, members: DataFrame, keys: list[str], time: str, member: str, capacity: str) -> DataFrame:
    """(keys, time, capacity, members): sums of the capacity of members that are active then; a member counts once (the largest of its active relations).

    Linear, whatever the number of members and times: relations become changes of capacity at their first moment and behind their last day, changes are
    summed by key and moment before they meet, and one running sum by key answers every distinct time.
    """
    always, never = (F.lit(t).cast("timestamp_ntz") for t in ("0001-01-01", "9999-12-31"))
    spans = members.select(*keys, member, F.coalesce(F.col(capacity), F.lit(0.0)).alias("_c"), F.coalesce(F.col("start").cast("timestamp_ntz"), always).alias("_a"), F.coalesce(F.col("end").cast("timestamp_ntz") + F.make_dt_interval(F.lit(1)), never).alias("_z")).where("_a < _z").distinct()
    edges = spans.select(*keys, member, F.explode(F.array("_a", "_z")).alias("_t")).distinct()
    held = edges.join(spans, [*keys, member], "left").groupBy(*keys, member, "_t").agg(F.max(F.when((F.col("_a") <= F.col("_t")) & (F.col("_t") < F.col("_z")), F.col("_c"))).alias("_c"))
    before = Window.partitionBy(*keys, member).orderBy("_t")
    now, then = (lambda x: F.coalesce(x, F.lit(0.0))), (lambda x: F.coalesce(F.lag(x).over(before), F.lit(0.0)))
    there = F.col("_c").isNotNull().cast("double")
    changes = held.withColumns({"_d": now(F.col("_c")) - then(F.col("_c")), "_n": there - then(there)}).groupBy(*keys, "_t").agg(F.sum("_d").alias("_d"), F.sum("_n").alias("_n"))
    asked = rows.select(*keys, F.col(time).alias("_t")).distinct()
    both = changes.withColumn("_asked", F.lit(False)).unionByName(asked.withColumns({"_d": F.lit(0.0), "_n": F.lit(0.0), "_asked": F.lit(True)}))
    upto = Window.partitionBy(*keys).orderBy("_t").rangeBetween(Window.unboundedPreceding, 0)
    running = both.withColumns({capacity: F.sum("_d").over(upto), "members": F.round(F.sum("_n").over(upto)).cast("long")})
    return running.where("_asked AND members > 0").select(*keys, F.col("_t").alias(time), capacity, "members")


def priority_match(rows: DataFrame, registry: DataFrame, key: str, steps: list[tuple[str, Column, Column]]) -> DataFrame:
    """rows -> rows with (match_method, match_status, match_reason, matched): the first step whose value is unique in the registry.

    steps: (name, value in rows, value in the registry), in order. A value that several entries have stops the search for review; empty values never match. The
    registry is first brought to one row for each value, so no join multiplies rows.
    """
    out, state = rows, []
    for name, mine, theirs in steps:
        known = registry.withColumn("_v", theirs).where("_v IS NOT NULL AND _v <> ''").groupBy("_v").agg(F.count("*").alias(f"_n_{name}"), F.min(key).alias(f"_k_{name}"))
        out = out.withColumn("_v", mine).join(known, "_v", "left").drop("_v")
        state.append(name)
    pick = lambda f: reduce(lambda chain, n: chain.when(F.col(f"_n_{n}").isNotNull(), f(n)), state, F)  # noqa: E731  (a null of the first step found is its result; no later step is asked)
    unique = lambda n: F.col(f"_n_{n}") == 1
    out = out.withColumns(
        {
            "match_method": F.coalesce(pick(lambda n: F.when(unique(n), n).otherwise("unresolved")), F.lit("unresolved")),
            "match_status": F.coalesce(pick(lambda n: F.when(unique(n), "matched").otherwise("review_required")), F.lit("unresolved")),
            "match_reason": F.coalesce(pick(lambda n: F.when(unique(n), "").otherwise(f"ambiguous_{n}")), F.lit("not_found")),
            "matched": pick(lambda n: F.when(unique(n), F.col(f"_k_{n}"))),
        }
    )
    return out.drop(*(f"_{p}_{n}" for n in state for p in "nk"))


def expand_groups(rows: DataFrame, membership: DataFrame, group: str, member: str, own_code: Column) -> DataFrame:
    """Groups without an own code become their members; others, and groups without members, stay themselves."""
    joined = rows.withColumn("_own", F.coalesce(~F.trim(own_code).isin("", "-"), F.lit(False)))
    linked = membership.select(F.col(group).alias("_g"), F.col(member).alias("_m"))
    joined = joined.join(linked, (F.col(group) == F.col("_g")) & ~F.col("_own"), "left")
    return joined.withColumns({"location": F.coalesce("_m", F.col(group)), "is_group": F.col("_m").isNotNull()}).drop("_own", "_g", "_m")


def nearest_on_axis(rows: DataFrame, value: str, axis: DataFrame, point: str, step: float) -> DataFrame:
    """Adds the nearest point of an axis whose neighbours lie at most ``step`` apart; ties go to the smaller point.

    Values and points meet in cells of that width (each point in its own and both neighbouring cells), so it is an equi-join.
    """
    cell = lambda c: F.floor(c / step).cast("long")
    spread = axis.select(F.col(point).alias("_p"), F.explode(F.array(*(cell(F.col(point)) + d for d in (-1, 0, 1)))).alias("_cell")).distinct()
    each = rows.select(value).where(F.col(value).isNotNull()).distinct().withColumn("_cell", cell(F.col(value)))
    best = each.join(spread, "_cell").groupBy(value).agg(F.min_by("_p", F.struct(F.abs(F.col("_p") - F.col(value)), F.col("_p"))).alias(f"nearest_{value}"))
    return rows.join(best, value, "left")


def expected_hours(blocks: DataFrame, segments: DataFrame) -> DataFrame:
    """(block, hours): hours of overlap of each block with all validity segments; both are small dimension tables."""
    lo, hi = F.greatest("block_start", "valid_from"), F.least("block_end", "valid_to")
    hours = F.greatest((F.unix_timestamp(hi.cast("timestamp")) - F.unix_timestamp(lo.cast("timestamp"))) / 3600, F.lit(0.0))
    return blocks.join(segments, (F.col("valid_from") < F.col("block_end")) & (F.col("valid_to") > F.col("block_start"))).groupBy("block").agg(F.sum(hours).alias("hours"))


def among(rows: DataFrame, wanted: DataFrame, key: str, small: int = 100_000) -> DataFrame:
    """Rows whose key is wanted; the keys are broadcast where a count shows at most ``small`` of them, else joined by a shuffle."""
    return rows.join(few(wanted.select(key).distinct(), small), key, "left_semi")


def union_all(tables: list[DataFrame]) -> DataFrame:
    """All rows; columns that a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def first_of(rows: DataFrame, order: list[Column], by: list[str] | None = None, n: int = 1) -> DataFrame:
    """The first n rows by an order with explicit ties, in all or within groups."""
    if not by:
        return rows.orderBy(*order).limit(n)
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")

"""Observed hours: source records into plant-hours with capacity, restriction half hours, weather filters, keyed contracts, cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gustline.functions import scalars as S
from gustline.operators import joins
from gustline.shared import shared_dir
from gustline.sources.tables import logical_hash


def in_scope(area: Column, kind: Column, wanted_area: str, wanted_kind: str) -> Column:
    """Whether a record is of the area and the technology, whatever case and outer space; null counts as no."""
    return F.coalesce((F.upper(F.trim(area)) == wanted_area.upper()) & F.contains(F.upper(F.trim(kind)), F.lit(wanted_kind.upper())), F.lit(False))


def known_id(name: Column) -> Column:
    """Whether an id is there: not null, empty or a dash."""
    return F.coalesce(~F.trim(name).isin("", "-"), F.lit(False))


def source_records(rows: DataFrame, zone: str, area: str, kind: str) -> DataFrame:
    """Records (id, area, kind, local, value as text) -> the same rows with plant, t (UTC), gen, and for each reason whether it rejects the row.

    Reasons come in order: a row out of scope or without an id has no other reason, and so on; ``valid`` rows have none.
    """
    scope, named = in_scope(F.col("area"), F.col("kind"), area, kind), known_id(F.col("id"))
    out = rows.withColumns({"plant": F.trim("id"), "t": S.apart(S.to_utc_strict(F.col("local"), zone)), "gen": S.local_number(F.col("value"))})
    good = scope & named
    numbered = F.col("gen").isNotNull() & (F.col("gen") >= 0)
    checked = good & F.col("t").isNotNull() & numbered
    flags = {
        "out_of_scope": ~scope,
        "without_id": scope & ~named,
        "bad_time": good & F.col("t").isNull(),
        "no_number": good & F.col("gen").isNull(),
        "negative": good & F.coalesce(F.col("gen") < 0, F.lit(False)),
        "off_hour": checked & (F.col("t") != S.hour_floor(F.col("t"))),
    }
    out = out.withColumns(flags)
    return out.withColumn("valid", checked & ~F.col("off_hour"))


def generation_hourly(records: DataFrame, members: DataFrame) -> DataFrame:
    """(plant, t, gen, records, cap, factor) of the valid records: exact copies count once, other records of a plant and hour are summed; hours whose
    active members have no capacity are left out. Nothing is imputed or clipped."""
    once = records.where("valid").select("plant", "t", "gen").distinct()
    shared_dir(records.sparkSession)
    hourly = once.groupBy("plant", "t").agg(F.sum("gen").alias("gen"), F.count("*").alias("records")).checkpoint()  # both sides of the join below read it
    capacity = joins.capacity_by_validity(hourly, members, ["plant"], "t", "member", "cap").drop("members")
    out = hourly.join(capacity, ["plant", "t"], "left").withColumn("factor", S.ratio(F.col("gen"), F.col("cap")))
    return out.where((F.col("cap") > 0) & (F.col("cap") < float("inf")))


def conflicting_records(records: DataFrame) -> DataFrame:
    """(plant, t, values): hours with several different records, which a strict run rejects."""
    return records.where("valid").groupBy("plant", "t").agg(F.count_distinct("gen").alias("values")).where("values > 1")


def on_half_hours(t: Column, exact: bool = True) -> Column:
    """Whether a time is a full or half hour, to the microsecond, or only by its minute; null counts as no."""
    return F.coalesce(t == S.half_hour_floor(t) if exact else F.minute(t).isin(0, 30), F.lit(False))


def half_hour_records(rows: DataFrame, name: str, time: str, exact: bool = True) -> DataFrame:
    """Rows with plant, half and ``fault``, the first reason not to use them: no id, no time, a time off the half hours. Nothing is floored into a half hour that it doesn't name."""
    t = F.col(time)
    fault = F.when(~known_id(F.col(name)), "without_id").when(t.isNull(), "bad_time").when(~on_half_hours(t, exact), "off_grid")
    return rows.withColumns({"plant": F.trim(name), "half": S.half_hour_floor(t), "fault": fault})


def restriction_hourly(halves: DataFrame, members: DataFrame, values: list[str], available: str, intervals: int = 2, tolerance: float = 1.05) -> DataFrame:
    """Half hours (plant, half, values...) -> hours with means, the number of half hours, capacity and availability.

    A half hour that comes several times counts once; where its copies differ the hour is marked as in conflict. Hours are kept that are complete, have a capacity
    and an availability from 0 to the tolerance, which is then clipped to 1.
    """
    each = halves.groupBy("plant", "half").agg(*(F.max(v).alias(v) for v in values), F.greatest(*(F.count_distinct(F.coalesce(F.col(v).cast("string"), F.lit("~"))) for v in values), F.lit(1)).alias("_n"))
    hourly = each.groupBy("plant", S.hour_floor(F.col("half")).alias("hour")).agg(*(F.avg(v).alias(v) for v in values), F.count("*").alias("intervals"), (F.max("_n") > 1).alias("conflict"))
    capacity = joins.capacity_by_validity(hourly, members, ["plant"], "hour", "member", "cap").drop("members")
    out = hourly.join(capacity, ["plant", "hour"], "left").withColumn("availability", S.ratio(F.col(available), F.col("cap")))
    kept = out.where((F.col("intervals") >= intervals) & (F.col("cap") > 0) & F.col("availability").between(0, tolerance))
    return kept.withColumn("availability", F.least(F.col("availability"), F.lit(1.0)))


def possible_weather(u: Column, v: Column, temperature: Column, pressure: Column) -> Column:
    """Whether all four are finite and within physical ranges; null counts as no."""
    known = S.finite(u).isNotNull() & S.finite(v).isNotNull()
    inside = (F.hypot(u, v) <= 50) & temperature.between(150, 350) & pressure.between(50_000, 120_000)
    return F.coalesce(known & inside, F.lit(False))


def keyed_report(rows: DataFrame, name: str, time: str) -> DataFrame:
    """One row: how many rows break the contract of a keyed table (no time, not at a full hour, no id, a key that another row has), and whether it holds."""
    copies = F.count("*").over(Window.partitionBy(F.trim(name), time))
    t = F.col(time)
    each = rows.select(known_id(F.col(name)).alias("named"), t.isNull().alias("no_time"), F.coalesce(t != S.hour_floor(t), F.lit(False)).alias("off"), (copies > 1).alias("repeated"))
    out = each.agg(F.count("*").alias("rows"), F.count_if(~F.col("named")).alias("without_id"), F.count_if("no_time").alias("without_time"), F.count_if("off").alias("off_hour"), F.count_if("repeated").alias("repeated"))
    return out.withColumn("holds", (F.col("without_id") + F.col("without_time") + F.col("off_hour") + F.col("repeated")) == 0)


def cohort(rows: DataFrame, plant: str, time: str) -> DataFrame:
    """One row that names a set of keys: rows, hours, plants, first and last hour, and a digest that doesn't depend on order."""
    keys = rows.select(plant, time)
    facts = keys.agg(F.count("*").alias("rows"), F.count_distinct(time).alias("hours"), F.count_distinct(plant).alias("plants"), F.min(time).alias("start"), F.max(time).alias("end"))
    return facts.join(F.broadcast(logical_hash(keys, [plant, time]).select("digest")))  # one row each


def window_of_days(rows: DataFrame, time: str, days: int, start=None) -> DataFrame:
    """Rows in [start, start + days); without a start, from the first hour on."""
    if start is not None:
        first = F.lit(start).cast("timestamp_ntz")
        return rows.where((F.col(time) >= first) & (F.col(time) < first + F.make_dt_interval(F.lit(days))))
    first = rows.agg(F.min(time).alias("_first"))
    return rows.join(F.broadcast(first)).where(F.col(time) < F.col("_first") + F.make_dt_interval(F.lit(days))).drop("_first")  # one row of one time


def profile(records: DataFrame, row_id: str) -> DataFrame:
    """One row about source records: rows, those whose id another row has, the share without a number, the share that is valid, plant-hours, and the share that
    these are of all plants by all hours."""
    copies = records.groupBy(row_id).agg(F.count("*").alias("_n")).agg(F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("repeated"))
    part = records.agg(F.count("*").alias("rows"), F.count_if(F.col("gen").isNull()).alias("_null"), F.count_if("valid").alias("_valid"))
    keys = records.where("valid").select("plant", "t").distinct().agg(F.count("*").alias("plant_hours"), F.count_distinct("plant").alias("_p"), F.count_distinct("t").alias("_t"))
    share = lambda a, b: S.ratio(a.cast("double"), b.cast("double"))
    out = part.join(F.broadcast(copies)).join(F.broadcast(keys))  # one row each
    return out.select("rows", "repeated", share(F.col("_null"), F.col("rows")).alias("null_rate"), share(F.col("_valid"), F.col("rows")).alias("valid_share"), "plant_hours", share(F.col("plant_hours"), F.col("_p") * F.col("_t")).alias("coverage"))

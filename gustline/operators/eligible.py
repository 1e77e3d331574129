"""What a model may be asked: targets, context, the domain of training; features in a fixed order; estimates with their reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gustline.functions import scalars as S
from gustline.functions import wind as W
from gustline.operators import windows

#: The features of a model and their order (fixed values).
FEATURES = [
    "wind_speed_100m",
    "wind_speed_hub_m",
    "most_applied",
    "most_missing",
    "wind_dir_sin",
    "wind_dir_cos",
    "air_density_kg_m3",
    "hour_sin",
    "hour_cos",
    "doy_sin",
    "doy_cos",
    "capacity_mw",
    "availability",
    "temperature_missing",
    "pressure_missing",
    "availability_missing",
    "grid_distance_km",
    "grid_distance_known",
    "wind_speed_mean_3h",
    "wind_speed_std_3h",
    "u_mean_3h",
    "v_mean_3h",
    "history_complete_3h",
    "wind_speed_mean_6h",
    "wind_speed_std_6h",
    "u_mean_6h",
    "v_mean_6h",
    "history_complete_6h",
    "wind_speed_gradient_1h",
    "wind_speed_gradient_3h",
    "wind_speed_gradient_6h",
    "temporal_context_complete",
]


def missing_flags(names: dict[str, str]) -> dict[str, Column]:
    """{new column: column} -> 1 where the column is null or NaN, else 0."""
    return {new: F.coalesce(F.isnan(F.col(c)) | F.col(c).isNull(), F.lit(True)).cast("int") for new, c in names.items()}


def feature_matrix(rows: DataFrame, key: list[str], time: str, hour: str) -> DataFrame:
    """The keys and FEATURES in their order, from what is known at the hour and before: u, v, temperature, pressure, capacity_mw, availability, hub, roughness,
    length, grid_distance_km. Observed generation is never read. Windows are of exact hours."""
    u, v = F.col("u"), F.col("v")
    hs, hc = W.cycle(F.hour(time), 24)
    ds, dc = W.cycle(F.dayofyear(time), 365.25)
    out = rows.withColumn("wind_speed_100m", W.speed(u, v))
    speed, applied = W.hub_speed(F.col("wind_speed_100m"), F.col("hub"), F.col("roughness"), F.col("length"))
    out = out.withColumns({"wind_speed_hub_m": speed, "most_applied": applied, "most_missing": 1 - applied})
    out = out.withColumns({"wind_dir_sin": W.heading_sine(u, v), "wind_dir_cos": W.heading_cosine(u, v), "air_density_kg_m3": W.air_density(F.col("pressure"), F.col("temperature")), "hour_sin": hs, "hour_cos": hc, "doy_sin": ds, "doy_cos": dc})
    out = out.withColumns(missing_flags({"temperature_missing": "temperature", "pressure_missing": "pressure", "availability_missing": "availability"}))
    out = out.withColumn("grid_distance_known", F.col("grid_distance_km").isNotNull().cast("int"))
    wind, complete = {"wind_speed": "wind_speed_hub_m", "u": "u", "v": "v"}, []
    for h in (3, 6):
        frame = windows.hours_back(key, hour, h - 1, 0)
        full = F.lit(True)
        for c in wind.values():
            full = full & (F.count(c).over(frame) == h)
        out = out.withColumn(f"history_complete_{h}h", full.cast("int"))
        done = F.col(f"history_complete_{h}h") == 1
        out = out.withColumns({f"{n}_mean_{h}h": F.when(done, F.avg(c).over(frame)) for n, c in wind.items()} | {f"wind_speed_std_{h}h": F.when(done, F.stddev_pop("wind_speed_hub_m").over(frame))})
        complete.append(done)
    out = out.withColumns({f"wind_speed_gradient_{h}h": windows.gradient(F.col("wind_speed_hub_m"), key, hour, h) for h in (1, 3, 6)})
    context = complete[0] & complete[1]
    for h in (1, 3, 6):
        context = context & F.col(f"wind_speed_gradient_{h}h").isNotNull()
    return out.withColumn("temporal_context_complete", context.cast("int")).select(*key, time, *FEATURES)


def target_fault(target: Column, capacity: Column, available: Column | None = None) -> Column:
    """Why a target can't be learned from: null, negative, above_capacity, or (if asked) above_available; else null."""
    fault = F.when(S.finite(target).isNull(), "null").when(target < 0, "negative").when(target > capacity, "above_capacity")
    return fault.when(target > available + 1e-9, "above_available") if available is not None else fault


def input_domain(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, least, most) of what a model was trained on: one aggregate."""
    one = rows.agg(*(F.min(c).cast("double").alias(f"least_{c}") for c in columns), *(F.max(c).cast("double").alias(f"most_{c}") for c in columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"least_{c}").alias("least"), F.col(f"most_{c}").alias("most")) for c in columns))).alias("x")).select("x.*")


def inside_domain(rows: DataFrame, train: DataFrame, plant: str, columns: list[str]) -> DataFrame:
    """Adds ``known`` (the plant was trained on) and ``in_domain`` (and every input lies within its training range; null does not)."""
    limits = train.agg(*(F.min(c).alias(f"_lo_{c}") for c in columns), *(F.max(c).alias(f"_hi_{c}") for c in columns))
    plants = train.select(plant).distinct().withColumn("_known", F.lit(True))
    out = rows.join(plants, plant, "left").join(F.broadcast(limits))  # one row of limits
    inside = F.lit(True)
    for c in columns:
        inside = inside & F.coalesce(F.col(c).between(F.col(f"_lo_{c}"), F.col(f"_hi_{c}")), F.lit(False))
    known = F.coalesce("_known", F.lit(False))
    return out.withColumns({"known": known, "in_domain": known & inside}).drop("_known", *(f"_{s}_{c}" for c in columns for s in ("lo", "hi")))


def fallback_reason(known: Column, context: Column) -> Column:
    return F.when(~known, "unknown_plant").when(~context, "incomplete_temporal_context").otherwise("none")


def capacity_warnings(generation: Column, capacity: Column, shares: Column) -> tuple[Column, Column]:
    """(capacity factor in percent, warnings): above 105 percent; no bus, or shares below 100 percent."""
    factor = S.ratio(generation, capacity) * 100
    notes = F.array_compact(F.array(F.when(factor > 105, "above_capacity"), F.when(F.coalesce(shares, F.lit(0.0)) == 0, "no_bus").when(shares < 100, "partial_bus")))
    return factor, notes


def estimates(rows: DataFrame, correction: Column, intervals: DataFrame, eligible: Column) -> DataFrame:
    """Rows (w, cap, avail, base, band and more) with estimate, bounds, confidence and notes: corrected where eligible, the power curve elsewhere.

    ``correction`` is in shares of capacity. Bounds come from the interval of the wind band and only where the correction was used. intervals has a row for each band.
    """
    used = F.coalesce(eligible, F.lit(False))
    out = rows.withColumn("corrected", used).withColumn("estimate", W.bounded(F.col("base"), F.when(used, correction * F.col("cap")).otherwise(F.lit(0.0)), F.col("w"), F.col("cap"), F.col("avail")))
    out = out.join(intervals.select("band", "p05", "p95"), "band", "left")
    edge = lambda q: F.when(F.col("corrected"), W.bounded(F.col("estimate"), F.col(q) * F.col("cap"), F.col("w"), F.col("cap"), F.col("avail")))
    idle = (F.col("w") < W.CUT_IN) | (F.col("w") >= W.CUT_OUT)
    notes = F.array_compact(F.array(F.when(F.col("corrected"), "empirical_interval").otherwise("no_interval"), F.when(~F.col("corrected"), "physical_curve"), F.when(idle, "outside_operating_range")))
    return out.withColumns({"lower": edge("p05"), "upper": edge("p95"), "confidence": F.when(F.col("corrected"), "medium").otherwise("low"), "notes": notes}).drop("p05", "p95")


def fully_matched(members: DataFrame, plant: str, status: str, t: Column) -> DataFrame:
    """Plants whose members active at t are all matched."""
    active = members.where(S.active_at(t, F.col("start"), F.col("end")))
    return active.groupBy(plant).agg(F.bool_and(F.col(status) == "matched").alias("_all"), F.count("*").alias("members")).where("_all").drop("_all")


def newest(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Of each group the row with the latest ``order``, as one aggregate."""
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_x")).select(*by, "_x.*")


def numbered(rows: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Rows with their place in a total order, for small published tables."""
    return rows.withColumn(name, F.row_number().over(Window.orderBy(*order)))

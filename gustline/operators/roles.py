"""Rows by fold and role: coverage of declared blocks, whether a job reads what it may, and the final block judged once by frozen intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustline.functions.scalars import fingerprint, ratio
from gustline.operators import metrics, splits, windows
from gustline.operators.checks import ContractError, few, require, require_subset

#: What a final block may be asked for.
CRITERIA = ("most_mae", "better_than_base", "least_inside")


def block_coverage(rows: DataFrame, blocks: DataFrame, validity: DataFrame, plant: str, hour: str, least_hours: int = 1, least_plants: int = 1, least_coverage: float = 0.0) -> DataFrame:
    """(fold, role, rows, plants, hours, expected, coverage, fault) of every declared block, those without a row too.

    blocks: fold, role, block_start, block_end (not included), a few declared rows; validity: plant, valid_from, valid_to. Expected are whole hours in which a plant is registered, by block, not all plants by the whole
    block; a block without such hours has coverage zero. The fault is the first of: empty, hours, plants, coverage. Segments that are null, reversed or overlap, and plants with rows but without a segment, are
    errors, found by jobs of their own before the result is planned.
    """
    require(blocks, ["fold", "role", "block_start", "block_end"])
    require(validity, [plant, "valid_from", "valid_to"])
    if not validity.where(F.coalesce(F.col("valid_from") >= F.col("valid_to"), F.lit(True)) | F.col(plant).isNull()).isEmpty():
        raise ContractError("segments of validity that are null or reversed")
    if not windows.overlapping_segments(validity, [plant], "valid_from", "valid_to").isEmpty():
        raise ContractError("segments of validity that overlap")
    require_subset(rows.select(plant).distinct(), validity.select(plant), [plant])
    declared = blocks.select("fold", "role", "block_start", "block_end")
    inside = splits.assign_blocks(rows.select(plant, hour), declared, hour).groupBy("fold", "role").agg(F.count("*").alias("rows"), F.count_distinct(plant).alias("plants"), F.count_distinct(hour).alias("hours"))
    span = F.least("block_end", "valid_to") - F.greatest("block_start", "valid_from")
    whole = F.extract(F.lit("DAY"), span) * 24 + F.extract(F.lit("HOUR"), span)
    met = validity.join(few(declared), (F.col("valid_from") < F.col("block_end")) & (F.col("valid_to") > F.col("block_start")))
    expected = met.groupBy("fold", "role").agg(F.sum(whole).cast("long").alias("expected"))
    out = declared.select("fold", "role").join(inside, ["fold", "role"], "left").join(expected, ["fold", "role"], "left").fillna(0, ["rows", "plants", "hours", "expected"])
    out = out.withColumn("coverage", F.coalesce(ratio(F.col("rows").cast("double"), F.col("expected").cast("double")), F.lit(0.0)))
    fault = F.when(F.col("rows") == 0, "empty").when(F.col("hours") < least_hours, "hours").when(F.col("plants") < least_plants, "plants").when(F.col("coverage") < least_coverage, "coverage")
    return out.withColumn("fault", fault)


def assignments(rows: DataFrame, blocks: DataFrame, keys: list[str], time: str, columns: list[str]) -> DataFrame:
    """(keys, fold, role, fingerprint): which block each row lies in, and a hash of its named columns, to be frozen before any job reads it."""
    placed = splits.assign_blocks(rows, blocks.select("fold", "role", "block_start", "block_end"), time)
    return placed.select(*keys, "fold", "role", fingerprint(*(F.col(c) for c in columns)).alias("fingerprint"))


def scope_faults(rows: DataFrame, assigned: DataFrame, roles: list[str], keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, fault): where a job's rows are not exactly those assigned to its roles, with the content that was frozen; none: it may run.

    unauthorised: the key belongs to no such role; missing: it does, but there is no row; repeated: several rows; ambiguous: frozen with several contents; changed: another content. The first of these counts.
    Both sides are brought to a row for each key before they meet.
    """
    require(assigned, [*keys, "role", "fingerprint"])
    have = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(fingerprint(*(F.col(c) for c in columns))).alias("_is"))
    may = assigned.where(F.col("role").isin(roles)).groupBy(*keys).agg(F.min("fingerprint").alias("_was"), F.max("fingerprint").alias("_too"))
    mine, theirs = (df.select(F.struct(*keys).alias("_key"), *(c for c in df.columns if c not in keys)) for df in (have, may))
    both = mine.alias("a").join(theirs.alias("b"), F.col("a._key").eqNullSafe(F.col("b._key")), "full").select(F.coalesce("a._key", "b._key").alias("_key"), "_n", "_is", "_was", "_too")
    fault = F.when(F.col("_was").isNull(), "unauthorised").when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "repeated").when(F.col("_was") != F.col("_too"), "ambiguous").when(F.col("_is") != F.col("_was"), "changed")
    return both.select("_key.*", fault.alias("fault")).where("fault IS NOT NULL")


def require_scope(rows: DataFrame, assigned: DataFrame, roles: list[str], keys: list[str], columns: list[str]) -> DataFrame:
    """Rows, if they are exactly those that the roles were given."""
    if bad := scope_faults(rows, assigned, roles, keys, columns).groupBy("fault").agg(F.count("*").alias("n")).collect():
        raise ContractError(f"rows outside {roles}: { {r['fault']: r['n'] for r in bad} }")
    return rows


def acceptance(rows: DataFrame, role: Column, band: str, actual: Column, before: Column, after: Column, wind: Column, capacity: Column, availability: Column, criteria: dict, least: int = 20) -> DataFrame:
    """One row (rows, base_mae, mae, inside, width, approved): the final block judged with intervals that only the calibration block has set.

    role: 'calibration', 'final_test', anything else stays out. criteria: most_mae, better_than_base, least_inside; all that are named must hold, and without any, or without a row, nothing is approved.
    """
    if unknown := sorted(set(criteria) - set(CRITERIA)):
        raise ContractError(f"unknown criteria: {unknown}")
    known = rows.withColumn("_role", role)
    frozen = metrics.interval_table(known.where("_role = 'calibration'"), band, (actual - after) / capacity, least)
    final = known.where("_role = 'final_test'")
    errors = final.agg(F.avg(F.abs(before - actual)).alias("base_mae"), F.avg(F.abs(after - actual)).alias("mae"))
    covered = metrics.interval_coverage(final, frozen, band, actual, after, wind, capacity, availability)
    out = errors.join(F.broadcast(covered))  # one row each
    asked = []
    if "most_mae" in criteria:
        asked.append(F.col("mae") <= criteria["most_mae"])
    if criteria.get("better_than_base"):
        asked.append(F.col("mae") < F.col("base_mae"))
    if "least_inside" in criteria:
        asked.append(F.col("inside") >= criteria["least_inside"])
    approved = F.lit(bool(asked))
    for each in asked:
        approved = approved & F.coalesce(each, F.lit(False))
    return out.select("rows", "base_mae", "mae", "inside", "width", approved.alias("approved"))

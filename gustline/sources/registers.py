"""Registers: plants with granted and inspected power, the universe of a system's plants, memberships; mapping onto buses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustline.functions import scalars as S
from gustline.operators import joins
from gustline.operators.checks import ContractError, find_column, require


def read_register(rows: DataFrame) -> DataFrame:
    """Register rows as text (code, name, state, lat, lon, granted_kw, inspected_kw) -> codes, their roots, coordinates and capacity in MW: what was inspected where
    that is positive, else what was granted."""
    require(rows, ["code", "name", "state", "lat", "lon", "granted_kw", "inspected_kw"])
    inspected, granted = S.local_number(F.col("inspected_kw")), S.local_number(F.col("granted_kw"))
    return rows.select(
        F.trim("code").alias("code"), S.fold(F.col("code")).alias("code_normal"), S.code_root(F.col("code")).alias("code_root"), "name", "state", S.local_number(F.col("lat")).alias("lat"), S.local_number(F.col("lon")).alias("lon"), (F.when(inspected > 0, inspected).otherwise(granted) / 1000).alias("capacity_mw")
    )


def read_universe(rows: DataFrame, aliases: dict[str, list[str]], area: str, kind: str | None = None) -> DataFrame:
    """Distinct plants of an area (and of a technology) from a source whose columns go by one of several names; of an id's rows one stays, with the count of its codes."""
    found = {name: find_column(rows, options) for name, options in aliases.items()}
    out = rows.select(*(F.col(f"`{c}`").alias(n) for n, c in found.items()))
    out = out.where(S.fold(F.col("area")) == area.upper())
    if kind:
        out = out.where(F.contains(S.fold(F.col("kind")), F.lit(kind.upper())))
    out = out.select(F.trim("id").alias("id"), F.trim("name").alias("name"), F.trim("code").alias("code"), S.fold(F.col("code")).alias("code_normal"), S.code_root(F.col("code")).alias("code_root"), "state").distinct()
    return out.groupBy("id").agg(F.max(F.struct("code", "name", "code_normal", "code_root", "state")).alias("x"), F.count_distinct("code_normal").alias("codes")).select("id", "x.*", "codes")


def require_one_code(universe: DataFrame) -> DataFrame:
    if bad := [r.id for r in universe.where("codes > 1").select("id").limit(10).collect()]:
        raise ContractError(f"ids with several codes: {bad}")
    return universe


def read_membership(rows: DataFrame, area: str) -> DataFrame:
    """(group, member, code, start, end) of an area; dates that can't be read are open. A missing id is an error, found as the rows are used."""
    own = rows.where(S.fold(F.col("area")) == area.upper())
    there = F.col("group").isNotNull() & F.col("member").isNotNull()
    named = F.when(F.assert_true(there, F.lit("a membership without an id")).isNull(), F.trim("group"))
    return own.select(named.alias("group"), F.trim("member").alias("member"), F.trim("code").alias("code"), F.try_to_timestamp("start").cast("timestamp_ntz").alias("start"), F.try_to_timestamp("end").cast("timestamp_ntz").alias("end"))


def reconcile(rows: DataFrame, register: DataFrame, overrides: DataFrame, key: str, place: str) -> DataFrame:
    """Rows with the register entry that an override names, else that has the same code, else the same root; a value that several entries have is for review."""
    named = rows.join(overrides.select(place, S.fold(F.col("override")).alias("_override")), place, "left")
    steps = [("override", F.col("_override"), F.col("code_normal")), ("exact", F.col("code_normal"), F.col("code_normal")), ("root", F.col("code_root"), F.col("code_root"))]
    return joins.priority_match(named, register, key, steps).drop("_override")


def frequencies(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, rows) of several columns: rows become pairs, which are counted once for all columns."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))
    return rows.select(F.explode(pairs).alias("x")).select("x.*").groupBy("column", "value").agg(F.count("*").alias("rows"))


def read_bus_sheet(rows: DataFrame, kind: str) -> DataFrame:
    """Sheet rows as text (code, kind, state, bus, share_mw) -> (code_root, bus, state, share_mw) of a technology, where bus and power are positive numbers and there is a code."""
    require(rows, ["code", "kind", "state", "bus", "share_mw"])
    bus, share, root = S.plain_number(F.col("bus")), S.plain_number(F.col("share_mw")), S.code_root(F.col("code"))
    wanted = (F.upper(F.trim("kind")) == kind.upper()) & (bus > 0) & (share > 0) & (root != "")
    return rows.where(wanted).select(root.alias("code_root"), bus.cast("long").alias("bus"), "state", share.alias("share_mw"))


def bus_mapping(members: DataFrame, sheet: DataFrame, root: str = "code_root") -> DataFrame:
    """Members of plants joined to all buses of their code root, summed by plant, place and bus (null fields are groups too), with how many of the plant's places
    have a bus. members: plant, place, code_root, capacity; sheet: code_root, bus, state, share_mw."""
    # a root's rows are summed by bus and state before they meet the members, so a pair is made for each bus of a root, not for each row of the sheet; both joins read the sums, the sheet is read once
    each = sheet.where("bus IS NOT NULL").groupBy(root, "bus", "state").agg(F.sum("share_mw").alias("share_mw")).checkpoint()
    own = members.select("plant", "place", root, "capacity").repartition("plant", "place")  # where the sheet's sums are small enough to be broadcast, nothing below is dealt again by place
    roots = each.select(root).distinct().withColumn("_m", F.lit(True))
    status = own.join(roots, root, "left").groupBy("plant", "place").agg(F.bool_or(F.coalesce("_m", F.lit(False))).alias("_m")).groupBy("plant").agg(F.count("*").alias("places"), F.count_if("_m").alias("mapped"))
    mapped = own.join(each, root).groupBy("plant", "place", "bus", "state").agg(F.sum("share_mw").alias("share_mw"), F.min("capacity").alias("capacity"), F.min(root).alias(root))
    return mapped.join(F.broadcast(status), "plant", "left")  # a row for each plant

"""Tables in one order, whatever wrote them: sorted parts with their bounds, positions of rows, hashes that the order is part of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustline.functions import scalars as S
from gustline.operators.checks import ContractError, few, require
from gustline.shared import shared_dir
from gustline.sources import periods, tables


def _named(c: str) -> Column:
    return F.col("`" + c.replace("`", "``") + "`")


def _comparable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _comparable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_comparable(f.dataType) for f in kind)
    return not isinstance(kind, (T.MapType, T.VariantType))


def in_order(df: DataFrame, order: list[str]) -> DataFrame:
    """The table in ranges of an order, nulls first, each range sorted; range k lies before range k + 1.

    Equal rows of the order are told apart by all other columns that can be compared (maps can't), so only rows that agree in every one of them may change places, and a
    value of the order that many rows share is split between ranges. One shuffle, behind a sample that Spark draws.
    """
    require(df, order)
    keys = [_named(c) for c in [*order, *(f.name for f in df.schema if f.name not in order and _comparable(f.dataType))]]
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def with_positions(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Adds the place of each row in the order, from 1.

    No task sorts more than a range: places within ranges are counted as they are sorted, and ranges are put behind one another by prefix sums of their sizes (a row each).
    """
    if name in df.columns:
        raise ContractError(f"there is a column {name}")
    shared_dir(df.sparkSession)
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = in_order(df, order).select(F.struct(*map(_named, df.columns)).alias("row"), F.spark_partition_id().alias("part"), within.alias("at")).checkpoint()
    sizes = dealt.groupBy("part").agg(F.count("*").alias("size"))
    bases = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("base"))
    return dealt.join(few(bases, 100_000), "part").select("row.*", (F.col("base") + F.col("at") + 1).alias(name))


def ordered_hash(df: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """One row (rows, digest): a hash of the named columns in an order, the same however the table is dealt to parts.

    Each row's SHA-256 holds its place, so two rows that swap give another digest; the sums of rows' hashes may be formed in any order. Floating numbers enter with nine significant digits.
    """
    kinds = dict(df.dtypes)
    placed = with_positions(df.select(*dict.fromkeys(map(_quoted, [*order, *columns]))), order, "_position")
    text = [S.significant(_named(c)) if kinds[c] in ("double", "float") else _named(c).cast("string") for c in columns]
    return tables.logical_hash(placed.select(F.col("_position"), *(t.alias(f"c{k}") for k, t in enumerate(text))), ["_position", *(f"c{k}" for k in range(len(text)))])


def _quoted(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def _placed_rows(spark: SparkSession, path: str) -> DataFrame:
    meta = F.col("_metadata")
    return spark.read.parquet(path).withColumns({"_file": meta["file_name"], "_at": meta["row_index"]})


def part_bounds(spark: SparkSession, path: str, order: list[str]) -> DataFrame:
    """(file, rows, first, last): each part's number of rows and the order's values in its first and last one, as they lie. Only the order's columns are read."""
    rows = _placed_rows(spark, path).select("_file", "_at", F.struct(*map(_named, order)).alias("_key"))
    sizes = rows.groupBy("_file").agg((F.max("_at") + 1).alias("rows"))
    ends = rows.join(few(sizes, 100_000), "_file").where((F.col("_at") == 0) | (F.col("_at") == F.col("rows") - 1))
    at = lambda place: F.first(F.when(F.col("_at") == place, F.col("_key")), ignorenulls=True)
    return ends.groupBy(F.col("_file").alias("file"), "rows").agg(at(0).alias("first"), at(F.col("rows") - 1).alias("last"))


def write_ordered(df: DataFrame, path: str, order: list[str]) -> None:
    """Writes Parquet whose parts, by name, and their rows, as they lie, are in the order; each part's bounds are kept at ``path``.bounds.

    Both appear as a whole or not at all, and an output that is there already is an error. A lost task writes its range again.
    """
    periods.staged(in_order(df, order), path)
    periods.staged(part_bounds(df.sparkSession, path, order), f"{path}.bounds")


def read_ordered(spark: SparkSession, path: str, name: str = "position") -> DataFrame:
    """An ordered table with each row's place, from 1: from the recorded sizes and the row's number in its part, so nothing is sorted or shuffled."""
    sizes = spark.read.parquet(f"{path}.bounds").select(F.col("file").alias("_file"), "rows")
    bases = sizes.select("_file", (F.sum("rows").over(Window.orderBy("_file")) - F.col("rows")).alias("_base"))  # a row for each part
    return _placed_rows(spark, path).join(few(bases, 100_000), "_file").withColumn(name, F.col("_base") + F.col("_at") + 1).drop("_file", "_at", "_base")


def order_faults(spark: SparkSession, path: str, order: list[str]) -> DataFrame:
    """(file, rows, fault) of every part that there is or should be; fault null: none.

    missing or unknown: the part is only in the bounds, or only in the folder; changed: rows or bounds are not the recorded ones; unsorted: a row lies behind one that it should precede;
    overlap: the part begins before the one before it has ended.
    """
    recorded = spark.read.parquet(f"{path}.bounds").select("file", F.struct("rows", "first", "last").alias("was"))
    found = part_bounds(spark, path, order).withColumn("before", F.lag("last").over(Window.orderBy("file")))  # a row for each part
    rows = _placed_rows(spark, path).select("_file", "_at", F.struct(*map(_named, order)).alias("_key"))
    turned = rows.withColumn("_last", F.lag("_key").over(Window.partitionBy("_file").orderBy("_at"))).where("_last > _key")
    unsorted = turned.select(F.col("_file").alias("file")).distinct().withColumn("turned", F.lit(True))
    both = found.join(recorded, "file", "full").join(unsorted, "file", "left")
    is_ = F.struct("rows", "first", "last")
    fault = F.when(F.col("rows").isNull(), "missing").when(F.col("was").isNull(), "unknown").when(F.col("turned"), "unsorted").when(F.col("before") > F.col("first"), "overlap").when(~is_.eqNullSafe(F.col("was")), "changed")
    return both.select("file", F.coalesce("rows", "was.rows").alias("rows"), fault.alias("fault"))


def write_lines(df: DataFrame, path: str, order: list[str], line: Column, header: str) -> None:
    """Writes text whose parts, put together by name, are one file in the order, its header first; rows with a null in the order's columns are refused.

    The header is a row whose order is null, so it is sorted before all others.
    """
    if not df.where(" OR ".join(f"{_quoted(c)} IS NULL" for c in order)).isEmpty():
        raise ContractError(f"nulls in {order}")
    keys = [f"_{k}" for k in range(len(order))]
    body = df.select(*(_named(c).alias(k) for c, k in zip(order, keys)), line.alias("value"))
    head = df.sparkSession.range(1).select(*(F.lit(None).cast(body.schema[k].dataType).alias(k) for k in keys), F.lit(header).alias("value"))
    periods.staged(in_order(head.unionAll(body), keys).select("value"), path, "text")

"""Fixed-width records in Latin-1 files: lines with byte offsets, blocks, fields, patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gustline.functions.scalars import fixed_number

#: The line that ends a block (fixed value).
BLOCK_END = "99999"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, offset, text, ending) of every line of every file; Latin-1, so a character is a byte. A file is one row, as its format is a whole."""
    files = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "ISO-8859-1").alias("body"))
    return split_lines(files, "path", "body")


def split_lines(files: DataFrame, name: str, body: str) -> DataFrame:
    lines = files.select(name, F.posexplode(F.split(F.col(body), "\n")).alias("line", "raw"), F.length(body).alias("size"))
    before = Window.partitionBy(name).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("offset", F.coalesce(F.sum(F.length("raw") + 1).over(before), F.lit(0)).cast("long"))
    ending = F.when(F.col("offset") + F.length("raw") >= F.col("size"), "").when(F.endswith("raw", F.lit("\r")), "CRLF").otherwise("LF")
    return lines.select(name, "line", "offset", F.rtrim(F.col("raw"), F.lit("\r")).alias("text"), ending.alias("ending")).where("NOT (text = '' AND ending = '')")


def block_records(lines: DataFrame, name: str, codes: list[str]) -> DataFrame:
    """Lines inside blocks, with ``block``: from a line that begins with a code up to the end mark; blank lines and comments, which begin with (, go."""
    code = F.regexp_extract("text", f"^({'|'.join(codes)})(?:\\s|$)", 1)
    mark = F.when(code != "", code).when(F.col("text").startswith(BLOCK_END), F.lit(""))
    state = F.last(mark, ignorenulls=True).over(Window.partitionBy(name).orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    inside = lines.withColumns({"block": state, "_mark": mark}).where("block <> '' AND _mark IS NULL").drop("_mark")
    return inside.where((F.trim("text") != "") & ~F.col("text").startswith("("))


def field(text: Column, start: int, width: int) -> Column:
    """The trimmed characters of a field, null where blank; positions count from 0."""
    return F.nullif(F.trim(F.substring(text, start + 1, width)), F.lit(""))


def int_field(text: Column, start: int, width: int) -> Column:
    return field(text, start, width).try_cast("int")


def patch(text: Column, start: int, width: int, value: Column) -> Column:
    """The line with one field replaced; everything else stays byte for byte."""
    return F.overlay(F.rpad(text, F.greatest(F.length(text), F.lit(start + width)), F.lit(" ")), value, F.lit(start + 1), F.lit(width))


def record(fields: list[tuple[Column, int]]) -> Column:
    """Numbers side by side, each right-aligned in its width."""
    return F.concat(*(fixed_number(c, w) for c, w in fields))

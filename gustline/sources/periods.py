"""Months and days of sources: which are there, which to ask for, which to do again; sinks that appear as a whole."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gustline.functions import scalars as S
from gustline.operators.checks import ContractError
from gustline.sources import files
from gustline.sources.tables import canonical_json


def month_start(year: Column, month: Column) -> Column:
    return F.make_date(year, month, F.lit(1))


def next_month(t: Column, n: int = 1) -> Column:
    """The label of the month n months later."""
    return F.date_format(F.add_months(F.trunc(t, "month"), n), "yyyy-MM")


def month_range(bounds: DataFrame, start: str, end: str) -> DataFrame:
    """(month_start) for every month from a row's start to its end; an end before the start is an error, found as the rows are used."""
    first = F.when(F.assert_true(F.col(end) >= F.col(start), F.lit("the end lies before the start")).isNull(), F.trunc(start, "month"))
    return bounds.select(F.explode(F.sequence(first, F.trunc(end, "month"), F.make_ym_interval(F.lit(0), F.lit(1)))).alias("month_start"))


def plan_requests(months: DataFrame, dataset: str, variables: list[str], area: list[float]) -> DataFrame:
    """Months -> (label, year, month, days, expected_hours, payload, request_hash): one request for each month; the hash names it, whatever the run."""
    fixed = canonical_json({"area": area, "dataset": dataset, "variable": variables})
    days = F.dayofmonth(F.last_day("month_start"))
    out = months.select(F.date_format("month_start", "yyyy-MM").alias("label"), F.year("month_start").alias("year"), F.month("month_start").alias("month"), days.alias("days"), (days * 24).alias("expected_hours"))
    payload = F.concat(F.lit(fixed[:-1] + ',"days":'), F.col("days").cast("string"), F.lit(',"month":"'), F.col("label"), F.lit('"}'))
    return out.withColumn("payload", payload).withColumn("request_hash", F.sha2("payload", 256))


def not_done(requests: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Requests whose hashes no finished run has; what is done with the same hashes is skipped, so a run may be repeated."""
    return requests.join(done.select(*keys).distinct(), keys, "left_anti")


def recent(rows: DataFrame, time: str, days: int, lag: int) -> DataFrame:
    """Rows of the last ``days`` days that end ``lag`` days before the newest row's day."""
    newest = rows.agg(F.max(F.to_date(time)).alias("_d"))
    day = F.to_date(time)
    return rows.join(F.broadcast(newest)).where((day <= F.date_sub("_d", lag)) & (day > F.date_sub(F.col("_d"), lag + days))).drop("_d")  # one row of one day


def months_touched(months: DataFrame, month: str, hours_ahead: int) -> DataFrame:
    """Local months -> the UTC months that their hours lie in: themselves and, where clocks are behind, the next."""
    start = F.to_date(F.concat(F.col(month), F.lit("-01")))
    last = (F.add_months(start, 1).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(1))) + F.make_dt_interval(F.lit(0), F.lit(hours_ahead))
    first = start.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(hours_ahead))
    return months.select(month, F.explode(F.array_distinct(F.array(F.date_format(first, "yyyy-MM"), F.date_format(last, "yyyy-MM")))).alias("utc_month"))


def present_hours(rows: DataFrame, time: str, asked: DataFrame, hour: str) -> DataFrame:
    """(hour, present): whether a table holds each asked hour; only the time column is read."""
    have = rows.select(F.date_trunc("hour", F.col(time)).cast("timestamp_ntz").alias(hour)).distinct().withColumn("present", F.lit(True))
    return asked.join(have, hour, "left").withColumn("present", F.coalesce("present", F.lit(False)))


def month_partitions(spark: SparkSession, path: str) -> DataFrame:
    """(year, month) of the partitions of a table, from its folders; no row is read."""
    return spark.read.parquet(path).select("year", "month").distinct()


def source_url(base: str, kind: str, year: Column, month: Column, earliest: int) -> Column:
    """The place of a month's file, null before the first year that there is."""
    return F.when(year >= earliest, F.format_string(f"{base}/{kind}/%d_%02d.csv", year, month))


def _in_place(spark: SparkSession, path: str):
    """The file system and the final place of an output that must not be there yet."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(target):
        raise ContractError(f"there is an output at {path}")
    return files, target


def staged_folder(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Lets ``write`` fill a folder beside the final place and renames it, so that readers see all of it or none; an output that is there already is an error."""
    files, target = _in_place(spark, path)
    part = f"{path}._part-{uuid.uuid4().hex[:12]}"
    write(part)
    files.mkdirs(target.getParent())
    if not files.rename(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(part), target):
        raise ContractError(f"{path} could not be put in place")


def staged(df: DataFrame, path: str, kind: str = "parquet", **options) -> None:
    """Writes beside the final place and renames, so that readers see all of an output or none; an output that is there already is an error."""
    staged_folder(df.sparkSession, path, df.write.format(kind).options(**options).save)


def with_manifest(df: DataFrame, path: str, facts: DataFrame, kind: str = "csv", **options) -> None:
    """Writes a table and, beside it as JSON, what is known about it (a few rows)."""
    staged(df, path, kind, **options)
    staged(facts, f"{path}.manifest", "json")


def record_limit(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    """(by, rows, too_many): groups with more records than a request may have."""
    return rows.groupBy(*by).agg(F.count("*").alias("rows")).withColumn("too_many", F.col("rows") > most)


def report_lines(facts: DataFrame, title: str, columns: list[str]) -> DataFrame:
    """(position, line) of a Markdown table of a small result, ordered by its first column."""
    head = [f"# {title}", "", "| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    top = facts.sparkSession.createDataFrame(list(enumerate(head)), "position long, line string")
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns)), F.lit(" |"))
    body = facts.select((F.row_number().over(Window.orderBy(columns[0])) + len(head) - 1).cast("long").alias("position"), row.alias("line"))
    return top.unionAll(body)


def weather_lines(rows: DataFrame) -> Column:
    """One line of the normalised weather file: plant, hour, u, v, availability."""
    number = lambda c, d: F.format_string(f"%.{d}f", F.col(c).cast("double"))
    return F.concat_ws(",", F.col("plant"), F.date_format("hour", "yyyy-MM-dd'T'HH:mm:ss'Z'"), number("u", 3), number("v", 3), number("availability", 4))


#: Columns that a user's file must have (fixed values), ranges of the others, and how many rows it may have.
REQUIRED, RANGES, MOST_ROWS = ["plant", "hour", "u", "v", "availability"], {"temperature": (150, 350), "pressure": (50_000, 120_000), "hub": (10, 300)}, 50_000
MOST_BYTES = 5 * 1024 * 1024


def check_file(spark: SparkSession, path: str, most: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The rows of a user's file as ``check_lines`` gives them. A file that is empty or too long is refused by its size, before it is read; one within the bound is read as one text."""
    size = files.listed(spark, path).agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    if size["files"] != 1 or not 0 < size["bytes"] <= most_bytes:
        raise ContractError(f"one file of 1 to {most_bytes} bytes, not {size['files']} of {size['bytes']}")
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("at", "line"))
    header = lines.where("at = 0").first()["line"]
    return check_lines(lines.where("at > 0").select((F.col("at") + 1).alias("row"), "line"), header, most)


def check_lines(lines: DataFrame, header: str, most: int = MOST_ROWS) -> DataFrame:
    """(row, line) of a user's delimited file, the header apart -> parsed columns and ``error``, the first thing wrong with each row (null: nothing); blank rows go.

    The delimiter is the commoner of , and ; in the header. Rows are numbered as in the file, so the first has number 2. A plant and hour may come once: later rows are repeats.
    """
    sep = ";" if header.count(";") > header.count(",") else ","
    names = [n.strip() for n in header.lstrip("﻿").split(sep)]
    if len(set(names)) < len(names) or not set(REQUIRED) <= set(names):
        raise ContractError(f"the header lacks columns: {sorted(set(REQUIRED) - set(names))}")
    cells = F.split("line", sep, -1)
    out = lines.where(F.trim(F.translate("line", sep, "")) != "").withColumn("_c", cells)
    out = out.withColumns({n: F.trim(F.get("_c", F.lit(k))) for k, n in enumerate(names)})
    values = {c: S.plain_number(F.col(c)) for c in ["u", "v", "availability", *(c for c in RANGES if c in names)]}
    out = out.withColumn("_t", S.strict_iso_hour(F.col("hour"))).withColumns({f"_{c}": x for c, x in values.items()})
    first = F.min("row").over(Window.partitionBy("plant", "_t"))
    error = F.when(F.col("row") > most + 1, "too_many_rows").when(F.size("_c") != len(names), "columns").when(F.col("_t").isNull(), "hour").when(F.coalesce(F.col("plant"), F.lit("")) == "", "plant").when(F.col("row") > first, "repeated")
    for c in ("u", "v", "availability"):
        error = error.when(F.col(f"_{c}").isNull(), c)
    error = error.when((F.hypot(F.col("_u"), F.col("_v")) > 50) | ~F.col("_availability").between(0, 1), "range")
    for c in RANGES:
        if c in names:
            error = error.when((F.col(c) != "") & ~F.coalesce(F.col(f"_{c}").between(*RANGES[c]), F.lit(False)), c)
    return out.select("row", "plant", F.to_timestamp_ntz(F.date_format("_t", "yyyy-MM-dd HH:mm:ss")).alias("hour"), *(F.col(f"_{c}").alias(c) for c in values), error.alias("error"))

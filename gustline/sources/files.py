"""Files that Spark has no reader for: Spark lists them, tasks open them by path and read the ranges that they need."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def listed(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length) of the files of a folder, or of one file; their contents are not read. Names that begin with a dot or an underscore are hidden."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length")


def located(path: str):
    """(file system, path in it) of a path or URI; an executor needs the folder mounted, or a store that Arrow knows (hdfs, s3, gs)."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def publish(path: str, content: bytes) -> None:
    """Writes a file whole or not at all: under another name first, then renamed, so that a task that is tried again, or twice at once, leaves one file."""
    store, target = located(path)
    folder, name = posixpath.split(target)
    draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
    store.create_dir(folder, recursive=True)
    with store.open_output_stream(draft) as out:
        out.write(content)
    store.move(draft, target)


def dealt(df: DataFrame) -> DataFrame:
    """Small rows, each of which stands for much work, dealt evenly over as many tasks as a shuffle has."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*df.columns))

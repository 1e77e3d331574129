"""Token-ID files: flat unsigned integers with 64-bit document offsets, written by ranges of document ids and memory-mapped."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gustline.llm import encode
from gustline.llm.common import cut, fresh_path, keyed, text_slices

#: A null document id in the files.
NO_ID = -(1 << 63)


def _local(path: str) -> str:
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"memory-mapped files need a mounted folder, not {path}")
    return path


def _write(folder: str, path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        encoder = encode.from_file(path)
        kind = np.uint16 if max(encoder.tokenizer.get_vocab_size() - 1, end_id) < 1 << 16 else np.uint32
        name = f"{task.partitionId():06d}-{task.taskAttemptId()}"
        out, docs, tokens = None, 0, 0
        for batch in batches:
            for part in text_slices(batch, "text"):
                if out is None:
                    os.makedirs(folder, exist_ok=True)
                    out = [open(f"{folder}/{name}.{ext}", "wb") for ext in ("tokens", "offsets", "ids")]
                    out[1].write(struct.pack("<q", 0))
                ids, ends = encoder.encode_column(part.column("text"), end_id)
                out[0].write(ids.astype(f"<u{np.dtype(kind).itemsize}").tobytes())
                out[1].write((tokens + ends[1:]).astype("<i8").tobytes())
                out[2].write(part.column("id").fill_null(NO_ID).to_numpy().astype("<i8").tobytes())
                docs += part.num_rows
                tokens += len(ids)
        if out is not None:
            for f in out:
                f.flush()
                os.fsync(f.fileno())
                f.close()
            yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "name": [name], "width": [np.dtype(kind).itemsize], "n_docs": [docs], "n_tokens": [tokens]})

    return run


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> DataFrame:
    """Writes ids of all documents in ascending order of their ids; returns the manifest (part, name, width, n_docs, n_tokens, base).

    Of each part there are three files in the mounted folder: .tokens (unsigned, ``width`` bytes each), .offsets (n_docs + 1 64-bit offsets within
    the part) and .ids (64-bit document ids). base is the number of ids in all parts before: a prefix sum over the manifest,
    one row for each part. A repeated task writes files of another name, and only those that the manifest names count. Null texts are
    empty; null ids come first; rows of one id follow each other by a hash of their text; an empty table writes nothing; other columns are ignored.
    """
    rows = keyed(docs, id_col, text_col).repartitionByRange("id", "key").sortWithinPartitions("id", "key").select("id", "text")
    parts = cut(rows.mapInArrow(_write(_local(folder), tokenizer_path, end_id), "part long, name string, width long, n_docs long, n_tokens long"))
    order = Window.orderBy("part")
    return cut(parts.withColumn("base", F.sum("n_tokens").over(order) - F.col("n_tokens")))


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                stem = f"{folder}/{row['name']}"
                tokens = np.memmap(f"{stem}.tokens", f"<u{row['width']}", "r")
                offsets, ids = np.fromfile(f"{stem}.offsets", "<i8"), np.fromfile(f"{stem}.ids", "<i8")
                step = 500
                for at in range(0, len(ids), step):
                    to = min(at + step, len(ids))
                    own = offsets[at : to + 1] - offsets[at]
                    data = encode.id_rows(tokens[offsets[at] : offsets[to]], own)
                    names = pa.array(ids[at:to], mask=ids[at:to] == NO_ID)
                    yield pa.RecordBatch.from_arrays([names, pa.array(row["base"] + offsets[at:to]), pa.array(np.diff(own)), data], ["id", "start", "n_tokens", "ids"])

    return run


def read_token_files(manifest: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """The manifest's files -> (id, start, n_tokens, ids): ids of all documents before, the document's, and these as little-endian unsigned 32-bit integers."""
    n = max(manifest.count(), 1)
    out = manifest.repartition(n, "part").mapInArrow(_read(_local(folder)), "id long, start long, n_tokens long, ids binary")
    return out.withColumnRenamed("id", id_col)


def token_files(spark: SparkSession, docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Writes into a fresh folder of the shared one and reads back."""
    folder = fresh_path(spark, "tokens")
    return read_token_files(write_token_files(docs, tokenizer_path, folder, **options), folder)

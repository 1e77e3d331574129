"""Token counts by section: each text is encoded once, and its tokens are joined to sections by character spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustline.llm import bytebpe
from gustline.llm.common import keyed, text_slices


def line_sections(text: str) -> list[int]:
    """Where sections begin, in characters: each line with the newline that ends it; an empty text has one."""
    starts, at = [0], text.find("\n")
    while at >= 0 and at + 1 < len(text):
        starts.append(at + 1)
        at = text.find("\n", at + 1)
    return starts


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table = bytebpe.encoder(path), bytebpe.token_bytes(path)
        sizes = np.array([len(t) for t in table], np.int64)
        for batch in batches:
            for part in text_slices(batch, "text"):
                texts = part.column("text").to_pylist()
                rows, numbers, begins, ends, counts = [], [], [], [], []
                every, at = own.encode_column(part.column("text"))
                for i, text in enumerate(texts):
                    starts = bytebpe.character_starts(text.encode(), sizes[every[at[i] : at[i + 1]]])
                    sections = np.array(line_sections(text))
                    # tokens in order meet sections in order: a merge join of sorted intervals
                    upto = np.searchsorted(starts, np.r_[sections[1:], len(text) + 1], side="left")
                    rows.append(np.full(len(sections), i)), numbers.append(np.arange(len(sections)))
                    begins.append(sections), ends.append(np.r_[sections[1:], len(text)]), counts.append(np.diff(np.r_[0, upto]))
                ids = part.column("id").take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(np.concatenate(x).astype(np.int64)) for x in (numbers, begins, ends, counts))], ["id", "section", "start", "end", "n_tokens"])

    return run


def section_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents -> (id, section, start, end, n_tokens): the tokens of every line of every whole text.

    Each document is encoded once, to the ids of its whole text (see ``encode``), so counts add up to the document's tokens. Where tokens begin
    follows from the bytes that each id stands for; these are the offsets that the library gives, as tests hold. A token counts for the section in which its
    first character lies, wherever it ends; a token that begins inside a character counts where that character lies. start and end are in
    characters. An empty or null text has one section of no tokens; null ids stay null; equal rows give equal rows; an empty table gives an empty
    table; other columns are ignored.
    """
    rows = keyed(docs, id_col, text_col).select("id", "text")
    out = rows.mapInArrow(_counted(path), "id long, section long, start long, end long, n_tokens long")
    return out.withColumnRenamed("id", id_col)


def field_tokens(table: DataFrame, path: str, id_col: str, fields: list[str]) -> DataFrame:
    """Records -> (id, field, n_tokens): the fields of a record are joined by newlines and encoded once; see ``section_tokens``.

    Newlines inside a field count as spaces there; null fields count as empty. The newline behind a field belongs to it.
    """
    parts = [F.translate(F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("")), "\n", " ") for f in fields]
    joined = table.select(F.col(f"`{id_col}`").alias("id"), F.concat_ws("\n", *parts, F.lit("")).alias("text"))
    names = F.array(*(F.lit(f) for f in fields))
    counted = section_tokens(joined, path, "id", "text")
    return counted.select(F.col("id").alias(id_col), F.element_at(names, (F.col("section") + 1).cast("int")).alias("field"), "n_tokens")

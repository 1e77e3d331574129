"""Cross-tokenizer alignment: groups and links of two tokenizers' tokens, and how many documents hold each linked pair of ids, by a cogroup of postings."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustline.llm import encode
from gustline.llm.common import modest_batches, ragged_index, stored, text_bytes, text_slices

#: Distinct chunks and links that a worker remembers; beyond that it forgets all and starts anew (results don't depend on it).
REMEMBERED, REMEMBERED_LINKS = 200_000, 4_000_000
#: Links (of one pair in one document each) that a task gathers before it gives out postings, and documents in a block of them.
GATHERED, BLOCK = 1 << 20, 1 << 16
#: Documents whose sums a task holds before it gives them out.
SUMMED = 1 << 20


def byte_level_table(tokenizer) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary; an entry with other characters stands for its own UTF-8."""
    number = {c: i for i, c in enumerate(encode.byte_characters())}
    table = [b""] * (max(tokenizer.get_vocab().values(), default=-1) + 1)
    for token, i in tokenizer.get_vocab().items():
        table[i] = bytes(number[c] for c in token) if all(c in number for c in token) else token.encode()
    return table


def piece_table(pieces: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    """The bytes of each piece: U+2581 is a space, a byte piece its byte."""
    names = map(pieces.id_to_piece, range(pieces.vocab_size()))
    return [bytes([int(n[3:5], 16)]) if pieces.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]


def cuts_at_spaces(pieces: sentencepiece.SentencePieceProcessor) -> bool:
    """Whether no piece reaches over a space that follows another character, and texts are taken as they are: then each chunk from such a space on can be encoded by itself."""
    names = [pieces.id_to_piece(i) for i in range(pieces.vocab_size()) if not (pieces.is_control(i) or pieces.is_unknown(i) or pieces.is_byte(i))]
    if any("▁" in n.lstrip("▁") for n in names):
        return False
    table = piece_table(pieces)
    sample = ["a  b", "One two, three-four 5.", "été é ﬁ ½ \n x\t y", "漢 字 \U0001f600 !"]
    joined = lambda text: [i for word in text.split(" ") for i in pieces.encode(word)]
    return all(b"".join(table[i] for i in pieces.encode(s)) == b" " + s.encode() for s in sample) and all(pieces.encode(s) == joined(s) for s in sample[1:])


class Bytes:
    """Rows of bytes, by number: a tokenizer's tokens, or what else is gathered in a row."""

    def __init__(self, rows: list[bytes]):
        self.flat = np.frombuffer(b"".join(rows), np.uint8)
        self.sizes = np.array([len(x) for x in rows], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[ragged_index(self.starts[ids], self.sizes[ids])]


def same_bytes(table: Bytes, ids: np.ndarray, counts: np.ndarray, raw: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which rows of text their tokens give back."""
    own = np.repeat(np.arange(len(counts)), counts)
    lengths = np.diff(rows)
    good = np.bincount(own, table.sizes[ids], minlength=len(counts)) == lengths
    text = table.joined(ids[good[own]])
    differ = text != raw[np.repeat(good, lengths)]
    if differ.any():
        good[np.repeat(np.flatnonzero(good), lengths[good])[differ]] = False
    return good


class Aligner:
    """Texts -> for each its counts, the hash of its groups, and its linked pairs of ids.

    A text with a space before it is cut into chunks where both tokenizers cut: at a space between two characters that are none. Tokens of both sides end there, so groups and links are those of the chunks in a row,
    and each distinct chunk is encoded and aligned once. Where the pieces don't allow it, a text is one chunk.
    """

    def __init__(self, a_path: str, b_path: str):
        self.a = encode.from_file(a_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes, self.b_bytes = Bytes(byte_level_table(self.a.tokenizer)), Bytes(piece_table(self.b))
        self.names = Bytes([b"%d " % i for i in range(max(len(self.a_bytes.sizes), len(self.b_bytes.sizes)))])  # the space gives way to what follows an id
        self.cuts = cuts_at_spaces(self.b)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.counts = np.zeros((0, 4), np.int64)  # n_a, n_b, n_groups, whether the bytes agree
        self.links, self.ends = np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.groups, self.group_ends = np.zeros(0, np.uint8), np.zeros(1, np.int64)  # as text, each group with its semicolon

    def chunk_starts(self, raw: np.ndarray, rows: np.ndarray) -> np.ndarray:
        begins = rows[:-1][np.diff(rows) > 0]
        if not self.cuts or not len(raw):
            return begins
        starts = encode.chunk_starts(raw, rows)
        within = np.zeros(len(raw) + 1, bool)
        within[begins] = True
        inner = (raw[starts] == 32) & ~within[starts + 1] & (np.r_[raw, 32][starts + 1] != 32) & (starts + 1 < len(raw))
        return starts[within[starts] | inner]

    def _align(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Chunks, each with a space before it, by both tokenizers, all in a row: counts, links and their number in each chunk, groups as text and their bytes in each chunk."""
        raw, rows = text_bytes(chunks)
        a, upto = self.a.encode_column(chunks)
        others = self.b.encode([c[1:] for c in chunks.to_pylist()], num_threads=1)
        a_count, b_count = np.diff(upto), np.array([len(x) for x in others], np.int64)
        a, b = a.astype(np.int64), np.fromiter(chain.from_iterable(others), np.int64, int(b_count.sum()))
        good = same_bytes(self.a_bytes, a, a_count, raw, rows) & same_bytes(self.b_bytes, b, b_count, raw, rows)
        a, b, a_count, b_count = a[np.repeat(good, a_count)], b[np.repeat(good, b_count)], a_count * good, b_count * good
        a_ends, b_ends = np.cumsum(self.a_bytes.sizes[a]), np.cumsum(self.b_bytes.sizes[b])
        own = np.repeat(np.arange(len(good)), a_count)  # the chunk of each token of A
        edges = np.sort(np.concatenate([a_ends, b_ends]), kind="stable")  # two sorted runs
        both = edges[1:][edges[1:] == edges[:-1]]
        edges = edges[np.r_[True, edges[1:] > edges[:-1]]] if len(edges) else edges  # the first token that ends at or behind an edge holds the byte before it; one without bytes holds none
        i, j = (np.searchsorted(x, edges[edges > 0]) for x in (a_ends, b_ends))
        a_group, b_group = np.searchsorted(both, a_ends), np.searchsorted(both, b_ends)
        group_chunk = own[np.searchsorted(a_group, np.arange(len(both)), side="right") - 1]
        # the ids of a group: those of A, then those of B
        a_place = np.arange(len(a)) + np.searchsorted(b_group, a_group)
        b_place = np.arange(len(b)) + np.searchsorted(a_group, b_group, side="right")
        ids, sign = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[a_place], ids[b_place] = a, b
        sign[a_place[np.r_[a_group[1:] != a_group[:-1], [True] * (len(a) > 0)]]] = ord("|")
        sign[b_place[np.r_[b_group[1:] != b_group[:-1], [True] * (len(b) > 0)]]] = ord(";")
        groups, ends = self.names.joined(ids), np.r_[0, np.cumsum(self.names.sizes[ids])]
        groups[ends[1:] - 1] = sign
        counts = np.stack([a_count, b_count, np.bincount(group_chunk, minlength=len(good)), good], axis=1)
        return counts, a[i] << 32 | b[j], np.bincount(own[i], minlength=len(good)), groups, np.diff(ends[np.r_[0, np.cumsum(a_count + b_count)]])

    def _slots(self, chunks: pa.Array) -> np.ndarray:
        names = chunks.to_pylist()
        slots = np.array([*map(self.known.get, names, repeat(-1))], np.int64)
        new = np.flatnonzero(slots < 0)
        if len(new):
            size = pc.utf8_length(chunks.take(pa.array(new))).to_numpy()
            new = new[np.argsort(size > encode.LONGEST, kind="stable")]  # long ones last, they are not remembered
            counts, links, n_links, groups, n_bytes = self._align(chunks.take(pa.array(new)))
            base = len(self.counts)
            self.counts = np.concatenate([self.counts, counts])
            self.links, self.ends = np.concatenate([self.links, links]), np.r_[self.ends, self.ends[-1] + np.cumsum(n_links)]
            self.groups, self.group_ends = np.concatenate([self.groups, groups]), np.r_[self.group_ends, self.group_ends[-1] + np.cumsum(n_bytes)]
            slots[new] = base + np.arange(len(new))
            kept = new[: int((size <= encode.LONGEST).sum())].tolist()
            self.known.update(zip([names[i] for i in kept], range(base, base + len(kept))))
        return slots

    def align(self, texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(n_a, n_b, n_groups, n_links of each text; the hash of its groups or ''; then for each text and linked pair of ids the text's number, the pair, and how often)."""
        raw, rows = text_bytes(texts)
        lengths = np.diff(rows)
        spaced = np.full(len(raw) + int((lengths > 0).sum()), 32, np.uint8)
        lead = np.cumsum(lengths > 0)
        own = np.repeat(lead, lengths) + np.arange(len(raw))
        spaced[own] = raw
        rows = rows + np.r_[0, lead]
        starts = self.chunk_starts(spaced, rows)
        chunks = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.r_[starts, len(spaced)].astype(np.int32)), pa.py_buffer(spaced))
        coded = chunks.dictionary_encode()
        slots = self._slots(coded.dictionary)
        pick = slots[coded.indices.to_numpy()] if len(starts) else np.zeros(0, np.int64)
        doc = np.searchsorted(rows, starts, side="right") - 1
        n = len(rows) - 1
        wrong = np.zeros(n, bool)
        wrong[doc[self.counts[pick, 3] == 0]] = True
        held = ~wrong[doc]
        doc, pick = doc[held], pick[held]
        count = self.ends[pick + 1] - self.ends[pick]
        columns = [np.bincount(doc, x, minlength=n).astype(np.int64) for x in (*self.counts[pick, :3].T, count)]
        texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.group_ends) - 1, [None, pa.py_buffer(self.group_ends), pa.py_buffer(self.groups)])
        flat, at = text_bytes(texts.take(pa.array(pick)))
        upto = at[np.searchsorted(doc, np.arange(n + 1))].tolist()
        groups = [hashlib.sha256(flat[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(upto[:-1], upto[1:])]
        # each distinct chunk of a text once, then its links, then each distinct pair once
        size = len(self.counts)
        once, times = np.unique(doc * size + pick, return_counts=True)
        doc, pick = once // size, once % size
        count = self.ends[pick + 1] - self.ends[pick]
        pairs, doc, times = self.links[ragged_index(self.ends[pick], count)], np.repeat(doc, count), np.repeat(times, count)
        order = np.lexsort((pairs, doc))
        pairs, doc, times = pairs[order], doc[order], times[order]
        new = np.flatnonzero(np.r_[True, (pairs[1:] != pairs[:-1]) | (doc[1:] != doc[:-1])]) if len(pairs) else np.zeros(0, np.int64)
        sums = np.add.reduceat(times, new) if len(new) else times
        pairs, doc = pairs[new], doc[new]
        if len(self.known) > REMEMBERED or len(self.links) > REMEMBERED_LINKS:
            self._forget()
        else:
            keep = len(self.known)
            self.counts, self.ends, self.group_ends = self.counts[:keep], self.ends[: keep + 1], self.group_ends[: keep + 1]
            self.links, self.groups = self.links[: self.ends[-1]], self.groups[: self.group_ends[-1]]
        return np.stack(columns, axis=1), groups, doc, pairs, sums


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


#: What the first pass stores: a row for each document (with its number), and a row for each linked pair and block of documents (with places from the block's base and multiplicities).
FIRST = "id long, row long, n_a long, n_b long, n_groups long, n_links long, groups string, a int, b int, base long, n_docs int, places binary, times binary"
_FIRST = pa.schema([(n, t) for n, t in zip((c.split()[0] for c in FIRST.split(", ")), [pa.int64()] * 6 + [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()])])


def _batch(columns: dict, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in _FIRST], schema=_FIRST)


def _bytes_rows(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Rows of a flat array as binary values."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _postings(base: int, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    rows, pairs, times = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((rows, pairs))
    rows, pairs, times = (rows[order] - base).astype("<u2"), pairs[order], times[order].astype("<u4")
    edges = np.r_[np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]]), len(pairs)]
    for at in range(0, len(edges) - 1, 16384):
        own = edges[at : at + 16385]
        first, n = pairs[own[:-1]], len(own) - 1
        span = slice(own[0], own[-1])
        columns = {"a": pa.array((first >> 32).astype(np.int32)), "b": pa.array((first & 0xFFFFFFFF).astype(np.int32)), "base": pa.array(np.full(n, base)), "n_docs": pa.array(np.diff(own).astype(np.int32))}
        yield _batch(columns | {"places": _bytes_rows(rows[span], own - own[0]), "times": _bytes_rows(times[span], own - own[0])}, n)


def _first(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, row = aligner(a_path, b_path), TaskContext.get().partitionId() << 40
        base, parts, gathered = row, [], 0
        for batch in batches:
            for part in (p for s in text_slices(batch, "text") for p in (s.slice(i, BLOCK) for i in range(0, s.num_rows, BLOCK))):
                if parts and (gathered >= GATHERED or row + part.num_rows - base > BLOCK):
                    yield from _postings(base, parts)
                    base, parts, gathered = row, [], 0
                if not parts:
                    base = row
                counts, groups, doc, pairs, times = own.align(part.column("text"))
                n = part.num_rows
                columns = {"id": part.column("id"), "row": pa.array(row + np.arange(n)), "groups": pa.array(groups, pa.string())}
                yield _batch(columns | {c: pa.array(counts[:, k]) for k, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))}, n)
                if len(doc):
                    parts.append((doc + row, pairs, times))
                    gathered += len(doc)
                row += n
        if parts:
            yield from _postings(base, parts)

    return run


def _contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings with their pair's count and whether it is their A id's highest -> (row, n_best, count_sum), summed as far as SUMMED documents allow."""
    held: dict[int, np.ndarray] = {}

    def given() -> Iterator[pa.RecordBatch]:
        for base, sums in held.items():
            at = np.flatnonzero(sums[1])
            yield pa.RecordBatch.from_arrays([pa.array(base + at), pa.array(sums[0][at]), pa.array(sums[1][at])], ["row", "n_best", "count_sum"])
        held.clear()

    for batch in batches:
        lengths = batch.column("n_docs").to_numpy().astype(np.int64)
        places, times = (np.frombuffer(text_bytes(batch.column(c))[0], d).astype(np.int64) for c, d in (("places", "<u2"), ("times", "<u4")))
        base, count, best = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("base", "count", "best"))
        block = np.repeat(base, lengths)
        order = np.argsort(block, kind="stable")
        edges = np.r_[np.flatnonzero(np.r_[True, np.diff(block[order]) > 0]), len(order)] if len(order) else np.zeros(1, np.int64)
        links, counted = times * np.repeat(best, lengths), times * np.repeat(count, lengths)
        for s, e in zip(edges[:-1], edges[1:]):
            own = order[s:e]
            name, top = int(block[own[0]]), int(places[own].max()) + 1
            sums = held.get(name)
            if sums is None or sums.shape[1] < top:
                held[name] = sums = np.pad(sums, ((0, 0), (0, top - sums.shape[1]))) if sums is not None else np.zeros((2, top), np.int64)
            np.add.at(sums[0], places[own], links[own])
            np.add.at(sums[1], places[own], counted[own])
        if sum(s.shape[1] for s in held.values()) > SUMMED:
            yield from given()
    yield from given()


def align_documents(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents -> (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256).

    A is a byte-level tokenizer's file, which encodes the text behind a space, B a sentencepiece model, which adds that space itself; strings of special tokens are plain text. Places where tokens of both end
    cut them into groups; tokens whose bytes overlap are linked, and each occurrence counts. A pair's count is the number of rows of the whole table that hold it
    linked; n_best are links whose count is the highest of their A id. Null and empty texts, and those whose bytes either side doesn't give back, have no tokens: zeros, and an empty hash.

    Postings, one row for each pair and block of documents (with the documents' places and multiplicities), are stored once. Their lengths, summed by pair and then compared by A id, give counts and maxima;
    both streams then meet in a sort-merge join by pair, sorted and spillable, whose hot pairs Spark can split, as each block is a row of its own. Then the
    postings of a block, with their pairs' counts, go to one task, which adds up what its documents get. Rows are numbered once, so repeated and null ids keep a row each; an empty table gives an empty table; other columns are ignored.
    """
    modest_batches(docs)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    first = stored(texts.mapInArrow(_first(a_path, b_path), FIRST), "alignment")
    postings = first.where(F.col("a").isNotNull()).select("a", "b", "base", "n_docs", "places", "times")
    pairs = stored(postings.groupBy("a", "b").agg(F.sum("n_docs").alias("count")), "pairs")
    highest = pairs.groupBy("a").agg(F.max("count").alias("most"))
    judged = pairs.join(highest, "a").select("a", "b", "count", (F.col("count") == F.col("most")).cast("int").alias("best"))
    met = postings.join(judged.hint("merge"), ["a", "b"]).select("base", "n_docs", "places", "times", "count", "best")
    sums = met.repartition("base").mapInArrow(_contributions, "row long, n_best long, count_sum long").groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("long")
    rows = first.where(F.col("row").isNotNull()).select("id", "row", "n_a", "n_b", "n_groups", "n_links", "groups")
    out = rows.join(sums, "row", "left").select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), F.col("groups").alias("groups_sha256"))
    return out

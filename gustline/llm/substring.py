"""Substring dedup: documents are parsed greedily against the reference blocks in which their windows occur before.

A relative Lempel-Ziv parse needs the blocks in which a document's text may recur. An index of all blocks finds them in two steps. Anchors: of
every window of ``window`` words the word sequence with the smallest hash; equal windows have equal anchors, so only windows whose anchor more than
one document has go on. Windows: the hash of each of these leads to the block of an earlier document that has it. Then every
block of a document is factored against the blocks that its windows lead to: factors of at least ``window`` words become
duplicate spans, and at each factor's boundary the windows across it are compared with the reference too. What goes is decided by words alone, never by a hash of
windows; a window could only be missed where two different ones share a 64-bit hash. Of equal texts only the one with the smallest id is parsed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustline.llm.common import keyed, ragged_index, stored, text_bytes, text_slices

#: Words of an anchor; windows of ``window`` words hold ``window - ANCHOR_WORDS + 1`` of them.
ANCHOR_WORDS = 10
#: Words of a reference block; least number of buckets that window hashes are dealt into, and windows of a bucket.
BLOCK_WORDS, BUCKETS, BUCKET_WINDOWS = 512, 64, 1_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R, _Q = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F  # odd, so that powers have inverses modulo 2 ** 64


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(max(n - 1, 0), base & (1 << 64) - 1, np.uint64)])[:n]


class _Rolling:
    """Hashes of runs of an integer sequence from one prefix sum."""

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        self.sums = np.r_[np.uint64(0), np.cumsum(values * _powers(base, n))]
        self.back = _powers(pow(base, -1, 1 << 64), n)

    def runs(self, length: int) -> np.ndarray:
        """The hash of every run of ``length`` values, by its start."""
        if len(self.sums) <= length:
            return np.zeros(0, np.uint64)
        d = self.sums[length:] - self.sums[:-length]
        return _mixed(d * self.back[: len(d)] + np.uint64(length))


def word_edges(raw: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets -> where words begin and end."""
    solid = np.r_[False, ~_SPACE[raw], False]
    edge = np.zeros(len(raw) + 1, bool)
    edge[rows] = True
    starts = np.flatnonzero(solid[1:-1] & (edge[:-1] | ~solid[:-2]))
    return starts, np.flatnonzero(solid[1:-1] & (edge[1:] | ~solid[2:])) + 1


def word_hashes(raw: np.ndarray, rows: np.ndarray, edges: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets -> a 64-bit hash of every word, and the offsets of the rows' words."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(rows), np.int64)
    starts, ends = edges or word_edges(raw, rows)
    sums = np.r_[np.uint64(0), np.cumsum(_BYTE[raw] * _powers(_R, n))]
    hashes = _mixed((sums[ends] - sums[starts]) * _powers(pow(_R, -1, 1 << 64), n)[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, rows)


def window_anchors(words: np.ndarray, rows: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every window of the rows: its start, its row and its anchor's hash."""
    grams = _Rolling(words, _Q).runs(ANCHOR_WORDS)
    per_row = np.maximum(np.diff(rows) - window + 1, 0)
    starts = ragged_index(rows[:-1], per_row)
    row = np.repeat(np.arange(len(per_row)), per_row)
    if not len(starts):
        return starts, row, np.zeros(0, np.uint64)
    span = window - ANCHOR_WORDS + 1
    least, width = grams, 1
    while width * 2 <= span:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    least = np.minimum(least[: len(grams) - span + 1], least[span - width : len(grams) - width + 1])
    return starts, row, least[starts]


def _anchor_rows(window: int):
    """The distinct anchors of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", 2 << 20):
                words, rows = word_hashes(*text_bytes(part.column("text")))
                _, row, value = window_anchors(words, rows, window)
                if not len(row):
                    continue
                fresh = np.r_[True, (value[1:] != value[:-1]) | (row[1:] != row[:-1])]
                row, value = row[fresh], value[fresh]
                order = np.lexsort((value, row))
                row, value = row[order], value[order]
                fresh = np.r_[True, (value[1:] != value[:-1]) | (row[1:] != row[:-1])]
                pick = pa.array(row[fresh])
                yield pa.RecordBatch.from_arrays([pa.array(value[fresh].view(np.int64)), part.column("id").take(pick), part.column("key").take(pick)], ["anchor", "id", "key"])

    return run


def _block_rows(window: int):
    """Blocks of documents with windows whose anchor is shared: the text that these windows cover, which of its words it begins with, and in it the ranges of the
    words that these windows begin with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", 2 << 20):
                raw, offsets = text_bytes(part.column("text"))
                begins, ends = word_edges(raw, offsets)
                words, rows = word_hashes(raw, offsets, (begins, ends))
                starts, row, value = window_anchors(words, rows, window)
                bounds = np.searchsorted(row, np.arange(part.num_rows + 1))
                at, firsts, data, lows, highs = [], [], [], [], []
                for i, shared in enumerate(part.column("anchors")):
                    own = slice(bounds[i], bounds[i + 1])
                    mine = starts[own][np.isin(value[own], shared.values.to_numpy().view(np.uint64))]
                    for some in np.split(mine, np.flatnonzero(np.diff((mine - rows[i]) // BLOCK_WORDS)) + 1):
                        if len(some):
                            fresh = np.flatnonzero(np.diff(some) > 1) + 1
                            at.append(i), firsts.append(some[0] - rows[i]), data.append(raw[begins[some[0]] : ends[some[-1] + window - 1]].tobytes())
                            lows.append((some[np.r_[0, fresh]] - some[0]).astype(np.int32)), highs.append((some[np.r_[fresh - 1, len(some) - 1]] - some[0] + 1).astype(np.int32))
                if at:
                    ids = [part.column(c).take(pa.array(at)) for c in ("id", "key")]
                    yield pa.RecordBatch.from_arrays([*ids, pa.array(firsts, pa.int64()), pa.array(data, pa.binary()), _lists(lows, pa.int32()), _lists(highs, pa.int32())], ["id", "key", "first", "words", "lows", "highs"])

    return run


def _earlier(hashes: np.ndarray, ids: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the first document that has each hash, and for all later ones (block, block of the first)."""
    order = np.lexsort((blocks, ids, hashes))
    h, i, b = hashes[order], ids[order], blocks[order]
    fresh = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
    first = np.flatnonzero(fresh)[np.cumsum(fresh) - 1] if len(h) else np.zeros(0, np.int64)
    later = i > i[first]
    keep = ~later & np.r_[True, (h[1:] != h[:-1]) | (b[1:] != b[:-1])] if len(h) else later
    return order[keep], np.unique(np.stack([b[later], b[first][later]], axis=1), axis=0)


def _window_hashes(window: int, buckets: int):
    """Blocks -> rows (bucket, b, id, hashes, refs): hashes of windows, dealt by hash, of the first document of each batch that has them; for the later ones its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "words", 4 << 20):
                words, rows = word_hashes(*text_bytes(part.column("words")))
                every = _Rolling(words, _Q).runs(window)
                lows, highs = part.column("lows"), part.column("highs")
                row = np.repeat(np.arange(part.num_rows), lows.value_lengths().to_numpy())
                low = lows.flatten().to_numpy()
                size = highs.flatten().to_numpy() - low
                hashes, owner = every[ragged_index(rows[row] + low, size)], np.repeat(row, size)
                b, ids = part.column("b").to_numpy(), part.column("id").to_numpy()
                kept, pairs = _earlier(hashes, ids[owner], b[owner])
                hashes, owner = hashes[kept], owner[kept]
                bucket = (hashes >> np.uint64(33)).astype(np.int64) * buckets >> 31
                order = np.lexsort((bucket, owner))
                hashes, owner, bucket = hashes[order], owner[order], bucket[order]
                cut = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (bucket[1:] != bucket[:-1])]) if len(owner) else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[cut, len(hashes)].astype(np.int32)), pa.array(hashes.view(np.int64)))
                none = pa.ListArray.from_arrays(pa.array(np.zeros(len(cut) + 1, np.int32)), pa.array([], pa.int64()))
                names = ["bucket", "b", "id", "hashes", "refs"]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cut].astype(np.int32)), pa.array(b[owner[cut]]), pa.array(ids[owner[cut]]), lists, none], names)
                if len(pairs):
                    own, cut = np.unique(pairs[:, 0], return_index=True)
                    refs = pa.ListArray.from_arrays(pa.array(np.r_[cut, len(pairs)].astype(np.int32)), pa.array(pairs[:, 1]))
                    none = pa.ListArray.from_arrays(pa.array(np.zeros(len(own) + 1, np.int32)), pa.array([], pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array((own % buckets).astype(np.int32)), pa.array(own), pa.array(own * 0), none, refs], names)

    return run


def _pairs_of(table: pa.Table) -> pa.Table:
    """A bucket of hashes -> (b, ref): blocks with a window that the other, of a document with a smaller id, has too."""
    b, ids = table.column("b").to_numpy(), table.column("id").to_numpy()
    hashes, refs = (table.column(c).combine_chunks() for c in ("hashes", "refs"))
    owner = np.repeat(np.arange(len(b)), hashes.value_lengths().to_numpy())
    _, pairs = _earlier(hashes.flatten().to_numpy().view(np.uint64), ids[owner], b[owner])
    known = np.stack([np.repeat(b, refs.value_lengths().to_numpy()), refs.flatten().to_numpy()], axis=1)
    every = np.unique(np.concatenate([pairs.reshape(-1, 2), known]), axis=0)
    return pa.table({"b": pa.array(every[:, 0], pa.int64()), "ref": pa.array(every[:, 1], pa.int64())})


def reference_text(blocks: list[np.ndarray]) -> np.ndarray:
    """Blocks of hashed words, joined with a word between them that no text has."""
    parts = []
    for k, b in enumerate(blocks):
        parts += [b, _mixed(np.array([k * 2 + 1], np.uint64) * np.uint64(_R))]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def factors(words: np.ndarray, reference: np.ndarray) -> list[tuple[int, int]]:
    """The greedy parse: (start, length) of the longest match with the reference at each factor's start; words without a match are skipped."""
    own, ref = _Rolling(words, _Q).runs(ANCHOR_WORDS), _Rolling(reference, _Q).runs(ANCHOR_WORDS)
    if not len(own) or not len(ref):
        return []
    order = np.argsort(ref, kind="stable")
    ranked = ref[order]
    lo, hi = np.searchsorted(ranked, own, "left"), np.searchsorted(ranked, own, "right")
    starts = np.flatnonzero(hi > lo)
    found, at = [], 0
    while True:
        k = np.searchsorted(starts, at)
        if k == len(starts):
            return found
        i = int(starts[k])
        length = _longest(words, i, reference, order[lo[i] : hi[i]])
        found.append((i, length))
        at = i + max(length, 1)


def _longest(words: np.ndarray, i: int, reference: np.ndarray, places: np.ndarray) -> int:
    """The longest match of words[i:] with the reference at any of the places."""
    done, step = 0, 64
    while True:
        want = words[i + done : i + done + step]
        if not len(want):
            return done
        best, still = 0, []
        for some in np.array_split(places, len(places) * step // (1 << 20) + 1):
            index = some[:, None] + (done + np.arange(len(want)))
            same = (index < len(reference)) & (reference[np.minimum(index, len(reference) - 1)] == want)
            run = np.where(same.all(1), len(want), np.argmin(same, axis=1))
            best = max(best, int(run.max(initial=0)))
            still.append(some[run == len(want)])
        places = np.concatenate(still)
        if not len(places) or len(want) < step:
            return done + best
        done, step = done + step, min(step * 2, 4096)


def duplicate_spans(words: np.ndarray, reference: np.ndarray, window: int) -> list[tuple[int, int]]:
    """(start, end) of what windows of the reference cover: long factors, and windows across a factor's boundary.

    A window that the reference has begins in a factor (its first words match) and lies in it or reaches over its end; so long factors and the
    windows over ends are all. Of the latter only those whose hash the reference has are compared, word by word.
    """
    found = factors(words, reference)
    spans = [(s, s + n) for s, n in found if n >= window]
    starts = np.flatnonzero(np.isin(_Rolling(words, _Q).runs(window), hashes := _Rolling(reference, _Q).runs(window)))
    over = starts[~np.isin(starts, np.concatenate([np.arange(s, e - window + 1) for s, e in spans] or [starts[:0]]))]
    if len(over):
        order = np.argsort(hashes, kind="stable")
        own = _Rolling(words, _Q).runs(window)[over]
        lo, hi = np.searchsorted(hashes[order], own, "left"), np.searchsorted(hashes[order], own, "right")
        spans += [(int(i), int(i) + window) for i, a, b in zip(over, lo, hi) if _longest(words[: i + window], int(i), reference, order[a:b]) == window]
    return spans


def _hashed(text: bytes) -> np.ndarray:
    return word_hashes(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]


def _parse(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for first, words, blocks in zip(*(batch.column(c).to_pylist() for c in ("first", "words", "blocks"))):
                found = duplicate_spans(_hashed(words), reference_text([_hashed(b) for b in sorted(set(blocks))]), window)
                spans.append(np.array([first + x for span in found for x in span], np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), _lists(spans, pa.int32())], ["id", "key", "spans"])

    return run


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.r_[0, np.cumsum([len(v) for v in values])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else [], kind))


def cut_text(raw: bytes, begins: np.ndarray, ends: np.ndarray, edges: np.ndarray) -> bytes:
    """A text without the words that the ranges (start, end, start, end, ...) name: each goes with the white space up to the next word, all other bytes stay."""
    kept, at = [], 0
    for s, e in edges.reshape(-1, 2).tolist():
        kept.append(raw[at : begins[s]])
        at = begins[e] if e < len(begins) else ends[e - 1]
    return b"".join([*kept, raw[at:]])


def _kept(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                raw, rows = text_bytes(part.column("text"))
                begins, ends = word_edges(raw, rows)
                bound = np.searchsorted(begins, rows)
                removed, cuts, texts, at = np.zeros(part.num_rows, np.int64), [np.zeros(0, np.int32)] * part.num_rows, [], 0
                lists, whole = part.column("spans"), part.column("whole").fill_null(False).to_numpy(zero_copy_only=False)
                for i in np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False) | whole):
                    n = bound[i + 1] - bound[i]
                    if whole[i] and n < window:
                        continue
                    spans = np.array([0, n]) if whole[i] else lists[i].values.to_numpy()
                    gone = np.bincount(spans[::2], minlength=n + 1) - np.bincount(spans[1::2], minlength=n + 1)
                    drop = np.cumsum(gone[:-1]) > 0
                    removed[i], cuts[i] = drop.sum(), np.flatnonzero(np.diff(np.r_[False, drop, False])).astype(np.int32)
                    own = slice(bound[i], bound[i + 1])
                    fresh = cut_text(raw[rows[i] : rows[i + 1]].tobytes(), begins[own] - rows[i], ends[own] - rows[i], cuts[i])
                    texts += [part.column("text").slice(at, i - at), pa.array([fresh], pa.binary()).cast(pa.string())]
                    at = i + 1
                text = pa.concat_arrays([*texts, part.column("text").slice(at)])
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("rest"), pa.array(np.diff(bound)), pa.array(removed), text, _lists(cuts, pa.int32())], ["id", "rest", "n_words", "n_removed", "kept_text", "spans"])

    return run


def repeated_passages(rows: DataFrame, window: int) -> DataFrame:
    """Rows of ``keyed`` -> (id, key, spans, whole): word ranges (start, end, start, end, ...) that documents with a smaller id have, or that such a document has
    the same text; rows without either are left out.

    Texts are shuffled once, to those rows that share an anchor; all else that moves are hashes and the text of blocks that share one.
    """
    doc = ["id", "key"]
    known = rows.where("id IS NOT NULL")
    # the aggregated sides of joins are stored, so that the joins can split the key of a text or passage that very many documents share
    content = known.select("id", "key", F.xxhash64(F.lit(1), "text").alias("check"))
    same = stored(content.groupBy("key", "check").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("last > first").drop("last"), "same")
    copies = stored(content.join(same, ["key", "check"]).where("id > first").select(doc).distinct(), "copies")
    anchors = stored(known.mapInArrow(_anchor_rows(window), "anchor long, id long, key long"), "anchors")
    shared = stored(anchors.groupBy("anchor").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("last > first").select("anchor"), "shared")
    theirs = anchors.join(shared, "anchor").groupBy(doc).agg(F.collect_set("anchor").alias("anchors")).join(copies, doc, "left_anti")
    # by merging: a compressed table's size says little about its size in memory, so none is to be broadcast for it
    texts = known.dropDuplicates(doc).join(theirs.hint("merge"), doc)
    found = texts.mapInArrow(_block_rows(window), "id long, key long, first long, words binary, lows array<int>, highs array<int>")
    blocks = stored(found.withColumn("b", F.monotonically_increasing_id()), "blocks")  # stored, so that the numbers stay
    count = blocks.select(F.sum(F.aggregate(F.zip_with("lows", "highs", lambda lo, hi: hi - lo), F.lit(0), lambda x, y: x + y))).first()[0] or 0
    buckets = max(BUCKETS, -(-count // BUCKET_WINDOWS))
    hashes = blocks.select("b", "id", "words", "lows", "highs").mapInArrow(_window_hashes(window, buckets), "bucket int, b long, id long, hashes array<long>, refs array<long>")
    wanted = hashes.groupBy("bucket").applyInArrow(_pairs_of, "b long, ref long").distinct()
    met = wanted.join(blocks.select(F.col("b").alias("ref"), F.col("words").alias("ref_words")), "ref").groupBy("b").agg(F.collect_list("ref_words").alias("blocks"))
    parsed = blocks.select("b", *doc, "first", "words").join(met, "b").select(*doc, "first", "words", "blocks")
    spans = parsed.mapInArrow(_parse(window), "id long, key long, spans array<int>").groupBy(doc).agg(F.flatten(F.collect_list("spans")).alias("spans")).where(F.size("spans") > 0)
    return spans.withColumn("whole", F.lit(False)).unionByName(copies.withColumns({"spans": F.lit(None).cast("array<int>"), "whole": F.lit(True)}))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, carry: list[str] | None = None) -> DataFrame:
    """Documents -> (id, n_words, n_removed, text, spans): passages that a document with a smaller id has, removed.

    Words are maximal runs of other bytes than ASCII white space. Every word goes that a window of ``window`` consecutive
    words covers whose word sequence also starts in a document with a smaller id; windows are judged on the input. A word
    goes with the white space behind it, up to the next word; all other bytes of the text stay, so a text without repeats comes back as it was. spans are
    (start, end, start, end, ...) word positions of what went. Null texts stay null and have no words. Rows with a null id are kept whole and are no source
    for others; rows of one id are no sources for each other, so equal rows give equal rows; an empty table gives an empty table. Other columns are left
    out, but those in ``carry`` come as fields of the struct ``rest``.
    """
    if window <= ANCHOR_WORDS:
        raise ValueError(f"window must exceed {ANCHOR_WORDS} words")
    rest = F.struct(*([F.col(f"`{c}`") for c in carry or []] or [F.lit(True).alias("none")])).alias("rest")
    spans = stored(repeated_passages(keyed(docs, id_col, text_col), window), "spans")
    text = F.col(f"`{text_col}`")
    whole = docs.select(rest, F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("key"))
    joined = whole.join(spans.hint("merge"), ["id", "key"], "left")
    schema = T.StructType([T.StructField("id", T.LongType()), joined.schema["rest"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("spans", T.ArrayType(T.IntegerType()))])
    out = joined.select("id", "text", "rest", "spans", "whole").mapInArrow(_kept(window), schema)
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", F.col("kept_text").alias("text"), "spans", *(["rest"] if carry else []))

"""SimHash near-duplicates: fingerprints in numpy, links by a binary trie self-join, classes by contraction."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustline.llm.common import cut, keyed, shared_dir, stored, text_slices
from gustline.llm.components import connected_components

#: Most fingerprints of one prefix bucket that one task joins; larger buckets are joined in pairs of blocks.
BUCKET_BLOCK = 2048
#: A pair of trie nodes with at most this many pairs of members is compared directly.
LEAF_PAIRS = 256
#: Rows of sorted cells (of at most two blocks each) that a task gathers before it joins those that are whole.
HELD_ROWS = 1 << 16


def fingerprint(text: str | bytes, shingle_words: int = 4) -> int:
    """The unsigned 64-bit SimHash of one text: A-Z lower-cased, words split at ASCII white space."""
    raw = text.encode() if isinstance(text, str) else text
    words = raw.lower().split()  # for bytes: A-Z only, and the six ASCII white-space bytes
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: -shingle_words].tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], 42) for s, e in zip(starts, (ends[shingle_words - 1 :] - 1).tolist())], dtype=">u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[i : i + 65536].view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def _fingerprints(shingle_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                fps = np.array([fingerprint(t.as_buffer().to_pybytes(), shingle_words) for t in part.column("text")], dtype=np.uint64)
                rest = [c for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(fps.view(np.int64))], [*rest, "fp"])

    return run


def bands(bits: int, max_bits: int, blocks: int | None = None) -> list[tuple[int, int]]:
    """(first bit, width) of ``max_bits + 1`` blocks of bits, or of more: two values within the budget agree on one of them, or on as many as there are more."""
    n = blocks or max_bits + 1
    edges = [bits * i // n for i in range(n + 1)]
    return [(edges[i], edges[i + 1] - edges[i]) for i in range(n)]


def tries(max_bits: int, n: int, block: int, most: int = 3) -> list[tuple[list[tuple[int, int]], int]]:
    """(order of the bits, as blocks; bits that are the top) of each trie that ``n`` fingerprints are joined in.

    Two values within the budget agree on ``agree`` of ``max_bits + agree`` blocks, so in the trie that has these blocks first they share the top. The top is
    made as deep as it takes for a bucket to hold about ``block`` of evenly spread values: more tries, with smaller buckets, where there are more values.
    """
    for agree in range(1, most + 2):
        parts = bands(64, max_bits, max_bits + agree)
        plan = [(list(top), sum(w for _, w in top)) for top in combinations(parts, agree)]
        if n <= block << min(w for _, w in plan) or agree == most + 1:
            return [(top + [p for p in parts if p not in top], width) for top, width in plan]
    raise AssertionError


def trie_links(values: np.ndarray, groups: np.ndarray, first_depth: int, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions whose values differ in at most ``max_bits`` bits, by a self-join of binary tries.

    values (unsigned, 64 bits) are sorted within each group; members of a group agree on the first ``first_depth`` bits. A
    trie node is a range of the sorted array; pairs of nodes go down together, the bits that differ add up, and a pair
    beyond the budget is dropped.
    """
    cuts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1], True]) if len(groups) else np.zeros(1, np.int64)
    lo, hi = cuts[:-1], cuts[1:]
    big = hi - lo > 1
    front = np.stack([lo[big], hi[big], lo[big], hi[big], np.zeros(big.sum(), np.int64)]).astype(np.int64)
    for depth in range(first_depth, 65):
        if not front.shape[1]:
            return
        small = (front[1] - front[0]) * (front[3] - front[2]) <= LEAF_PAIRS if depth < 64 else np.ones(front.shape[1], bool)
        yield from _compared(values, front[:, small], max_bits)
        front = front[:, ~small]
        if not front.shape[1]:
            return
        ones = np.r_[0, np.cumsum((values >> np.uint64(63 - depth)) & np.uint64(1))].astype(np.int64)
        alo, ahi, blo, bhi, diff = front
        amid, bmid = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
        own = alo == blo
        front = np.concatenate(
            [
                np.stack([alo, amid, blo, bmid, diff]),
                np.stack([amid, ahi, bmid, bhi, diff]),
                np.stack([alo, amid, bmid, bhi, diff + 1]),
                np.stack([amid, ahi, blo, bmid, diff + 1])[:, ~own],  # of a node with itself, the mirror of the pair above
            ],
            axis=1,
        )
        front = front[:, (front[1] > front[0]) & (front[3] > front[2]) & (front[4] <= max_bits) & ~((front[0] == front[2]) & (front[1] - front[0] < 2))]


def _compared(values: np.ndarray, front: np.ndarray, max_bits: int, at_once: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    alo, ahi, blo, bhi, _ = front
    sizes = (ahi - alo) * (bhi - blo)
    ends = np.cumsum(sizes)
    k = 0
    while k < len(sizes):
        before = ends[k - 1] if k else 0
        stop = max(k + 1, int(np.searchsorted(ends, before + at_once, side="right")))
        n = sizes[k:stop]
        if stop == k + 1 and n[0] > at_once:  # equal values cannot be split further
            rows = max(1, at_once // int(bhi[k] - blo[k]))
            for r in range(int(alo[k]), int(ahi[k]), rows):
                i = np.repeat(np.arange(r, min(r + rows, ahi[k])), bhi[k] - blo[k])
                yield _within(values, i, np.tile(np.arange(blo[k], bhi[k]), len(i) // int(bhi[k] - blo[k])), max_bits)
        else:
            which = np.repeat(np.arange(k, stop), n)
            within = np.arange(int(n.sum())) - np.repeat(ends[k:stop] - n - before, n)
            width = (bhi - blo)[which]
            yield _within(values, alo[which] + within // width, blo[which] + within % width, max_bits)
        k = stop


def _within(values: np.ndarray, i: np.ndarray, j: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    ok = (np.bitwise_count(values[i] ^ values[j]) <= max_bits) & (i != j)
    return i[ok], j[ok]


class Forest:
    """Union-find over positions; keeps the smallest position of each class as its root."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, i: np.ndarray) -> np.ndarray:
        r = self.parent[i]
        while True:
            up = self.parent[r]
            if np.array_equal(up, r):
                return r
            r = up

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        """Joins the classes of i[k] and j[k] for all k."""
        while len(i):
            a, b = self.roots(i), self.roots(j)
            apart = a != b
            i, j = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            if not len(i):
                return
            np.minimum.at(self.parent, j, i)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        every = np.arange(len(self.parent))
        root = self.roots(every)
        return every[root != every], root[root != every]


def _reordered(v: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    """Values with their blocks of bits in another order."""
    out = np.zeros(len(v), np.uint64)
    for s, w in order:
        out = (out << np.uint64(w)) | ((v >> np.uint64(64 - s - w)) & np.uint64((1 << w) - 1))
    return out


def _trie_join(max_bits: int, plan: list[tuple[list[tuple[int, int]], int]]):
    def joined(table: pa.Table) -> Iterator[pa.RecordBatch]:
        band, cell, fp = (table.column(c).to_numpy() for c in ("band", "cell", "fp"))
        for b, (order_of_bits, width) in enumerate(plan):
            pick = band == b
            if not pick.any():
                continue
            v = _reordered(fp[pick].view(np.uint64), order_of_bits)
            order = np.lexsort((v, cell[pick]))
            v, g = v[order], cell[pick][order]
            forest = Forest(len(v))
            for i, j in trie_links(v, g, width, max_bits):
                forest.add(i, j)
            i, j = forest.edges()
            own = fp[pick][order]
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(own[j])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell: some whole cells at a time are in memory, however many a partition has."""
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= HELD_ROWS:
                table = pa.Table.from_batches(held)
                cells = table.column("cell").to_numpy()
                last = int(np.searchsorted(cells, cells[-1]))
                yield from joined(table.slice(0, last))
                held, rows = table.slice(last).to_batches(), rows - last
        if rows:
            yield from joined(pa.Table.from_batches(held))

    return run


def hamming_links(fps: DataFrame, max_bits: int = 4, block: int = BUCKET_BLOCK) -> DataFrame:
    """Distinct (fp long) -> links (a long, b long) that connect exactly what lies within ``max_bits`` bits.

    The fingerprints are joined in several binary tries, each with the bits in another order, so that two within the budget share the top of
    one (see ``tries``); each (trie, top) is a subtrie that one task joins with itself. Buckets above ``block`` are
    joined as pairs of blocks, so none grows beyond two blocks in a task. Each task returns a spanning forest of its links, not all pairs.
    """
    plan = tries(max_bits, fps.count(), block)

    def top(order: list[tuple[int, int]], width: int):
        value, taken = F.lit(0).cast("long"), 0
        for s, w in order:
            if taken < width:
                value = F.shiftleft(value, w).bitwiseOR(F.shiftrightunsigned("fp", 64 - s - w).bitwiseAND(F.lit((1 << w) - 1).cast("long")))
                taken += w
        return value

    cells = F.array(*(F.struct(F.lit(i).alias("band"), top(order, width).alias("value")) for i, (order, width) in enumerate(plan)))
    rows = fps.select("fp", F.explode(cells).alias("c")).select("fp", "c.band", "c.value")
    sizes = rows.groupBy("band", "value").count()
    large = sizes.where(F.col("count") > block).withColumn("k", F.ceil(F.col("count") / block).cast("int")).select("band", "value", "k")
    dealt = rows.join(large, ["band", "value"], "left").withColumn("k", F.coalesce("k", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
    others = F.when(F.col("k") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("k") - 1), lambda x: x != F.col("mine")))
    dealt = dealt.withColumn("mine", mine).withColumn("other", F.explode(others))
    cell = F.xxhash64("band", "value", F.least("mine", "other"), F.greatest("mine", "other"), "k")
    dealt = dealt.select("band", cell.alias("cell"), "fp")
    return dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(_trie_join(max_bits, plan), "a long, b long")


def fingerprints(rows: DataFrame, shingle_words: int = 4) -> DataFrame:
    """Rows with ``text`` -> all their other columns, and ``fp``."""
    others = [f"`{c}` {t}" for c, t in rows.dtypes if c != "text"]
    return rows.mapInArrow(_fingerprints(shingle_words), ", ".join([*others, "fp long"]))


def fingerprint_classes(fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """Distinct fingerprints (fp) -> (fp, label): classes of those that links connect."""
    labels = connected_components(hamming_links(fps, max_bits))
    return fps.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, max_bits: int = 4) -> DataFrame:
    """Documents -> (id, fingerprint, component_id, kept): near-duplicate classes by SimHash.

    A fingerprint's bit is 1 if it is set in over half of the XXH64 (seed 42) values of the text's word shingles, repeats
    included; fewer words than a shingle has: the whole sequence; no words, empty or null text: fingerprint zero, which links like any
    other. Documents within ``max_bits`` bits are linked; component_id is the smallest id reachable, and kept tells the
    row whose id that is. Equal fingerprints are one node, so copies cost nothing in the join. Rows with a null id get
    the class's id and are not kept; equal rows give equal rows; an empty table gives an empty table; other columns are ignored.
    """
    shared_dir(docs.sparkSession)
    rows = keyed(docs, id_col, text_col).select("id", "text")
    fps = cut(fingerprints(rows, shingle_words))
    nodes = cut(fps.groupBy("fp").agg(F.min("id").alias("least")))
    named = cut(nodes.join(fingerprint_classes(nodes.select("fp"), max_bits), "fp"))
    # both sides of the next join are tables, so that it can split a class with very many fingerprints
    classes = stored(named.groupBy("label").agg(F.min("least").alias("component_id")), "classes")
    by_fp = named.join(classes, "label").select("fp", "component_id")
    out = fps.join(by_fp, "fp")
    return out.select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )

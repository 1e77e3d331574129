"""Embedding near-duplicates: a forest of random-projection trees with spill, comparison within leaves, classes by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustline.llm.common import cut, shared_dir, stored
from gustline.llm.components import connected_components
from gustline.llm.simhash import Forest

#: Trees; rows of the bounded sample that splits are fitted on; expected rows of a leaf before spill; random directions tried for a split.
TREES, SAMPLE_ROWS, LEAF_ROWS, TRIED = 8, 20_000, 300, 8
#: Rows of a leaf that one task compares; larger leaves are split again, and where that doesn't part them, compared as pairs of blocks.
LEAF_BLOCK = 4096


class Tree:
    """Splits by node (root 0; children of node i are left[i] and right[i]; leaves have -1)."""

    def __init__(self, x: np.ndarray, leaf: int, spill: float, rng: np.random.Generator):
        self.direction: list[np.ndarray] = []
        self.threshold: list[float] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.spill = spill
        self._grow(x, np.arange(len(x)), leaf, rng)
        self.direction = np.array(self.direction).reshape(len(self.left), -1)

    def _grow(self, x: np.ndarray, rows: np.ndarray, leaf: int, rng: np.random.Generator) -> int:
        node = len(self.left)
        d = rng.normal(size=(TRIED, x.shape[1]))
        d /= np.linalg.norm(d, axis=1, keepdims=True)
        at = x[rows] @ d.T
        best = int(at.std(axis=0).argmax()) if len(rows) else 0
        middle = float(np.median(at[:, best])) if len(rows) else 0.0
        self.direction.append(d[best]), self.threshold.append(middle), self.left.append(-1), self.right.append(-1)
        lower = at[:, best] < middle
        if len(rows) > leaf and 0 < lower.sum() < len(rows):
            self.left[node] = self._grow(x, rows[lower], leaf, rng)
            self.right[node] = self._grow(x, rows[~lower], leaf, rng)
        return node

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf): a row within ``spill`` of a split goes to both sides."""
        rows, found = [], []
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, own = todo.pop()
            if not len(own):
                continue
            if self.left[node] < 0:
                rows.append(own), found.append(np.full(len(own), node))
                continue
            side = x[own] @ self.direction[node] - self.threshold[node]
            todo += [(self.left[node], own[side < self.spill]), (self.right[node], own[side >= -self.spill])]
        return np.concatenate(rows), np.concatenate(found)


def unit(vectors: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, in double precision, with length 1."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _deal(trees: list[Tree], dim: int):
    """Each vector to its leaves; ``codes`` has all of them, so that a pair can tell the first leaf it shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                x = unit(part.column("v"), dim)
                rows, codes, base = [], [], 0
                for tree in trees:
                    r, leaf = tree.leaves(x)
                    rows.append(r), codes.append(leaf + base)
                    base += len(tree.left)
                row, code = np.concatenate(rows), np.concatenate(codes).astype(np.int64)
                order = np.lexsort((code, row))
                row, code = row[order], code[order]
                ends = np.r_[0, np.cumsum(np.bincount(row, minlength=part.num_rows))].astype(np.int32)
                every = pa.ListArray.from_arrays(pa.array(ends), pa.array(code))
                pick = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(code), part.column("rep").take(pick), part.column("copies").take(pick), part.column("v").take(pick), every.take(pick)], ["code", "rep", "copies", "v", "codes"])

    return run


def _compare(dim: int, threshold: float):
    """A leaf (or two blocks of one) -> (a, b, links): links of each vector, and a spanning forest of the linked ones."""

    def run(table: pa.Table) -> pa.Table:
        code, mine, other = (table.column(c)[0].as_py() for c in ("code", "mine", "other"))
        rep, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
        x = unit(table.column("v").combine_chunks(), dim)
        block = table.column("own").to_numpy()
        lists = table.column("codes").combine_chunks()
        flat, ends = lists.flatten().to_numpy(), np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
        owner = np.repeat(np.arange(len(rep)), np.diff(ends))
        before = flat < code
        names, col = np.unique(flat[before], return_inverse=True)
        earlier = np.zeros((len(rep), max(-(-len(names) // 8), 1)), np.uint8)  # bits of the leaves before this one
        np.bitwise_or.at(earlier, (owner[before], col >> 3), (1 << (col & 7)).astype(np.uint8))
        links = np.zeros(len(rep), np.int64)
        forest = Forest(len(rep))
        narrow, slack = x.astype(np.float32), 2e-7 * (dim + 16)  # float32 tells all but the closest cases
        for at in range(0, len(rep), 256):
            s = narrow[at : at + 256] @ narrow[at:].T
            i, j = np.nonzero(s >= threshold - slack)
            near = np.flatnonzero(s[i, j] < threshold + slack)
            i, j = i + at, j + at
            exact = np.ones(len(i), bool)
            exact[near] = np.einsum("ij,ij->i", x[i[near]], x[j[near]]) >= threshold
            ok = exact & (i < j)
            if mine != other:
                ok &= block[i] != block[j]  # pairs within a block are compared with that block alone
            i, j = i[ok], j[ok]
            for k in range(0, len(i), 1 << 18):
                a, b = i[k : k + (1 << 18)], j[k : k + (1 << 18)]
                fresh = ~(earlier[a] & earlier[b]).any(axis=1)
                a, b = a[fresh], b[fresh]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                forest.add(a, b)
        some = np.flatnonzero(links)
        a, b = forest.edges()
        return pa.table(
            {
                "a": pa.array(np.r_[rep[some], rep[a]]),
                "b": pa.array(np.r_[rep[some], rep[b]]),
                "links": pa.array(np.r_[links[some], np.zeros(len(a), np.int64)]),
            }
        )

    return run


def spill_of(dim: int, threshold: float) -> float:
    return 0.25 * np.sqrt(max(2 - 2 * threshold, 0) / dim)


def fit_forest(points: DataFrame, dim: int, rows: int, threshold: float, trees: int = TREES, sample_rows: int = SAMPLE_ROWS, leaf_rows: int = LEAF_ROWS, seed: int = 11) -> list[Tree]:
    """Trees on at most ``sample_rows`` vectors, those with the smallest hash of their id. Two vectors at the threshold lie at most
    sqrt(2 - 2 threshold) apart, so along a random direction they differ by about that over sqrt(dim); a quarter of it is the spill."""
    sample = points.select("rep", "v").orderBy(F.xxhash64("rep"), "rep").limit(sample_rows).toArrow()
    x = unit(sample.column("v").combine_chunks(), dim) if sample.num_rows else np.zeros((0, dim))
    spill = spill_of(dim, threshold)
    leaf = max(8, leaf_rows * len(x) // max(rows, 1))
    return [Tree(x, leaf, spill, np.random.default_rng([seed, t])) for t in range(trees)]


def _projected(dim: int, level: int):
    """Adds where each vector lies along a random direction of its leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, x = batch.column("code").to_numpy(), unit(batch.column("v"), dim)
            at = np.zeros(len(code))
            for c in np.unique(code):
                d = np.random.default_rng([int(c) & (1 << 63) - 1, level]).normal(size=dim)
                at[code == c] = x[code == c] @ (d / np.linalg.norm(d))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], [*batch.schema.names, "at"])

    return run


def split_leaves(dealt: DataFrame, dim: int, spill: float, block: int | None = None, levels: int = 24) -> DataFrame:
    """(code, rep, copies, v): leaves above ``block`` rows split at the median of a direction of their own, with spill, until they are small or don't part.

    A sample of bounded size can't fit leaves that are small however many rows there are; here every large leaf is split by all its own rows,
    all leaves at once, a level a round. A leaf whose rows lie within the spill of each other (near copies) stays whole.
    """
    block = block or LEAF_BLOCK
    done = None
    for level in range(levels):
        sizes = dealt.groupBy("code").count().where(F.col("count") > block)
        if sizes.isEmpty():
            break
        small = dealt.join(sizes, "code", "left_anti")
        done = small if done is None else done.unionByName(small)
        open_ = dealt.join(sizes.select("code"), "code", "left_semi").mapInArrow(_projected(dim, level), T.StructType([*dealt.schema.fields, T.StructField("at", T.DoubleType())]))
        middle = cut(open_.groupBy("code").agg(F.percentile_approx("at", 0.5, 1000).alias("middle"), F.stddev_pop("at").alias("spread")))
        sides = F.filter(F.array(F.when(F.col("at") < F.col("middle") + spill, 0), F.when(F.col("at") >= F.col("middle") - spill, 1)), lambda x: x.isNotNull())
        parts = F.col("spread") > 2 * spill
        placed = open_.join(middle, "code").withColumn("side", F.explode(F.when(parts, sides).otherwise(F.array(F.lit(-1)))))
        code = F.when(F.col("side") >= 0, F.xxhash64("code", "side")).otherwise(F.col("code"))
        placed = stored(placed.select(code.alias("code"), "rep", "copies", "v", (F.col("side") < 0).alias("dense")), "split")
        dense = placed.where("dense").drop("dense")
        done, dealt = done.unionByName(dense), placed.where("NOT dense").drop("dense")
    return dealt if done is None else done.unionByName(dealt)


def _links(points: DataFrame, dim: int, threshold: float, trees: list[Tree]) -> DataFrame:
    kind = points.schema["v"].dataType.simpleString()
    dealt = points.mapInArrow(_deal(trees, dim), f"code long, rep long, copies long, v {kind}, codes array<long>")
    dealt = stored(dealt, "leaves")
    if not dealt.groupBy("code").count().where(F.col("count") > LEAF_BLOCK).isEmpty():
        dealt = split_leaves(dealt.drop("codes"), dim, 2 * spill_of(dim, threshold))
        codes = stored(dealt.groupBy("rep").agg(F.array_sort(F.collect_set("code")).alias("codes")), "codes")
        dealt = stored(dealt.join(codes, "rep").select("code", "rep", "copies", "v", "codes"), "leaves")
    large = dealt.groupBy("code").count().where(F.col("count") > LEAF_BLOCK).select("code", F.ceil(F.col("count") / LEAF_BLOCK).cast("int").alias("k"))
    rows = dealt.join(large, "code", "left").withColumn("k", F.coalesce("k", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rep", F.lit(5)), F.col("k")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    rows = rows.select("code", F.least("own", "with").alias("mine"), F.greatest("own", "with").alias("other"), "own", "rep", "copies", "v", "codes")
    return rows.groupBy("code", "mine", "other").applyInArrow(_compare(dim, threshold), "a long, b long, links long")


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, trees: int = TREES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Vectors -> (id, n_links, component_id, kept): near-duplicate classes by cosine, in double precision.

    Vectors at or above the threshold are linked if some tree has both in one leaf; every candidate pair is compared exactly, so no
    link is false. n_links counts the other rows linked directly, component_id is the smallest id reachable, and kept tells the row whose id that
    is. Equal vectors are one point with a weight. Of the leaves that a pair shares only the first counts it; leaves return counts and a
    spanning forest, never all pairs; a leaf above LEAF_BLOCK rows is compared in pairs of blocks. Rows whose vector is null, empty, zero or holds
    null or non-finite components have no links; vectors of different lengths aren't compared; a null id has no links and is not kept; rows that repeat are
    separate rows; other columns are ignored; an empty table gives an empty table.
    """
    shared_dir(vectors.sparkSession)
    big = F.lit(float("inf"))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").alias("v"))
    sound = F.col("id").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)) & F.exists("v", lambda x: x != 0), F.lit(False))
    good = rows.where(sound)
    points = stored(good.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "points")
    found = None
    for dim, n in points.groupBy(F.size("v")).count().collect():  # a row for each length of vectors, in practice one
        own = points.where(F.size("v") == dim)
        part = _links(own, dim, threshold, fit_forest(own, dim, n, threshold, trees, sample_rows))
        found = part if found is None else found.unionAll(part)
    if found is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    found = cut(found)
    counts = found.where("links > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    labels = connected_components(found.where("a <> b").select("a", "b"))
    named = points.join(counts, "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("label", "rep").alias("component_id"))
    good = good.join(named, "v").select("id", "n_links", "component_id")
    rest = rows.where(~sound).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = good.unionAll(rest)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))

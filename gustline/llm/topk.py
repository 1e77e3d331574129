"""Exact top-k by inner product: dual-tree search over cover trees, first between blocks that hold nearby vectors, then inside each pair of them."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustline.llm.common import cut

#: Distinct vectors of a block of candidates and of queries; points of a leaf; points of a leaf whose parts would not be tighter; most children of a node.
CANDIDATE_BLOCK, QUERY_BLOCK, LEAF, FLAT, FANOUT = 8192, 8192, 48, 1024, 12
#: Nodes of the top level of the cover tree, which blocks are dealt by, and rows of the bounded sample that they are chosen from. Results don't depend on them.
CENTERS, SAMPLE_ROWS = 512, 4096


class Node:
    """A cover-tree node: a center, the covering radius of all points below it, and children or (at a leaf) points."""

    __slots__ = ("center", "children", "norm", "points", "radius", "worst")

    def __init__(self, center: np.ndarray, radius: float, points: np.ndarray | None, children: list["Node"]):
        self.center, self.radius, self.points, self.children = center, radius, points, children
        self.norm = float(np.sqrt(center @ center))
        self.worst = -np.inf  # of a query node: the smallest kth score of the queries below it


def cover_tree(x: np.ndarray, points: np.ndarray | None = None, center: int | None = None) -> Node:
    """Built from the top: a node keeps its own center as its first child, takes the farthest point as the next until half its radius covers all (or it
    has FANOUT children), and every point goes to the nearest center; so children's centers lie farther apart than what they cover."""
    points = np.arange(len(x)) if points is None else points
    center = int(points[0]) if center is None else center
    gap = ((x[points] - x[center]) ** 2).sum(1)
    radius = float(np.sqrt(gap.max()))
    if len(points) <= LEAF or radius == 0:
        return Node(x[center], radius, points, [])
    owner, near, centers = np.zeros(len(points), np.int64), gap.copy(), [center]
    while len(centers) < FANOUT and near.max() > (radius / 2) ** 2:
        far = int(points[near.argmax()])
        gap = ((x[points] - x[far]) ** 2).sum(1)
        closer = gap < near
        owner[closer], near[closer] = len(centers), gap[closer]
        centers.append(far)
    if near.max() > (0.8 * radius) ** 2:  # all points lie about as far from each other (many dimensions): smaller nodes would prune nothing
        if len(points) <= FLAT:
            return Node(x[center], radius, points, [])
        parts = np.array_split(points, -(-len(points) // FLAT))
        return Node(x[center], radius, None, [cover_tree(x, part) for part in parts])
    return Node(x[center], radius, None, [cover_tree(x, points[owner == k], c) for k, c in enumerate(centers)])


def bound(q: Node, r: Node) -> float:
    """No inner product of a point below q with a point below r is greater; the margin is far above what rounding can take away."""
    top = float(q.center @ r.center) + q.radius * r.norm + r.radius * q.norm + q.radius * r.radius
    return top + 1e-9 * ((q.norm + q.radius) * (r.norm + r.radius) + 1)


class DualSearch:
    """The k best (score, id) of each query, ties to the smaller id, among those whose score reaches the query's floor.

    Components are whole numbers once multiplied by 2 ** bits; scores are of those, of the given kind (object: exact integers). The trees are of
    float64 and scaled by powers of two, so that nothing overflows.
    """

    def __init__(self, queries: np.ndarray, candidates: np.ndarray, ids: list[np.ndarray], k: int, kind: type = np.float64, floors: np.ndarray | None = None, bits: int = 0):
        self.k, self.pairs = k, 0  # pairs: how many scores were taken
        own = [x.astype(np.float64) for x in (queries, candidates)]
        shifts = [max(0, int(np.frexp(np.abs(x).max(initial=0))[1])) for x in own]
        self.shift = 2 * bits + sum(shifts)  # scores are so many powers of two above those of the trees
        self.trees = [cover_tree(np.ldexp(x, -s)) for x, s in zip(own, shifts)]
        self.q, self.c = (_integers(x, kind, bits) for x in (queries, candidates))
        self.counts, self.flat = np.array([len(i) for i in ids]), np.concatenate(ids)
        self.first = np.cumsum(self.counts) - self.counts
        self.score = np.full((len(queries), k), -np.inf, dtype=kind)
        self.id = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.floor = np.full(len(queries), -np.inf) if floors is None else floors
        self._lower(self.trees[0])

    def run(self) -> None:
        self.search(*self.trees)

    def _scaled(self, score) -> float:
        """A score as the trees see it."""
        return float(Fraction(score, 1 << self.shift)) if isinstance(score, int) else float(np.ldexp(score, -self.shift))

    def _lower(self, q: Node) -> float:
        """The least score that the queries below a node need, as known now."""
        if q.points is not None:
            known = min(self.score[q.points, -1])
            q.worst = max(self._scaled(known), self._scaled(float(self.floor[q.points].min())))
        else:
            q.worst = min(self._lower(c) for c in q.children)
        return q.worst

    def search(self, q: Node, r: Node) -> None:
        if bound(q, r) < q.worst:
            return
        if q.points is not None and r.points is not None:
            self.leaves(q, r)
        elif r.points is None and (q.points is not None or r.radius >= q.radius):
            for child in sorted(r.children, key=lambda c: -bound(q, c)):
                self.search(q, child)
        else:
            for child in q.children:
                self.search(child, r)
            q.worst = min(c.worst for c in q.children)

    def leaves(self, q: Node, r: Node) -> None:
        scores = self.q[q.points] @ self.c[r.points].T
        self.pairs += scores.size
        least = np.maximum(self.score[q.points, -1], self.floor[q.points])
        close = scores >= least[:, None]
        if scores.dtype != object and scores.shape[1] > 4 * self.k:  # none but the best of this leaf can stay
            close &= scores >= np.partition(scores, -self.k, axis=1)[:, -self.k, None]
        live, own = np.flatnonzero(close.any(1)), np.flatnonzero(close.any(0))
        if len(live):
            rows, n = q.points[live], self.counts[r.points[own]]
            cols = np.repeat(own, n)
            ids = self.flat[np.repeat(self.first[r.points[own]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            part = np.ix_(live, cols)
            s = np.concatenate([self.score[rows], np.where(close[part], scores[part], -np.inf)], axis=1)
            i = np.concatenate([self.id[rows], np.where(close[part], ids, np.iinfo(np.int64).max)], axis=1)
            order = np.lexsort((i, -s), axis=1)[:, : self.k]
            self.score[rows], self.id[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        self._lower(q)


def _integers(x: np.ndarray, kind: type, bits: int) -> np.ndarray:
    """Components times 2 ** bits, as exact integers or as float64."""
    if kind is np.float64:
        return np.ldexp(x.astype(np.float64), bits)
    return np.array([int(Fraction(v) * (1 << bits)) for v in x.ravel().tolist()], object).reshape(x.shape)


def sort_key(score: int) -> bytes:
    """Bytes that sort like integers of any size."""
    if -(1 << 63) <= score < 1 << 63:
        return b"\1" + (score + (1 << 63)).to_bytes(8, "big")
    size = (abs(score).bit_length() + 7) // 8
    if score > 0:
        return b"\2" + size.to_bytes(3, "big") + score.to_bytes(size, "big")
    return b"\0" + ((1 << 24) - 1 - size).to_bytes(3, "big") + ((1 << 8 * size) - 1 + score).to_bytes(size, "big")


def _matrix(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    flat = table.column("vec")
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    values = (flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat).flatten().to_numpy()
    return values.reshape(table.num_rows, -1)


_FOUND = "query long, vec_id long, score long, sorted binary"


def _block_search(k: int):
    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        if not candidates.num_rows or not queries.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64()), "sorted": pa.array([], pa.binary())})
        c, q = _matrix(candidates), _matrix(queries)
        # float64 sums of integers are exact below 2 ** 53; beyond that the leaves are scored in exact integers
        top = [max(float(np.abs(x).max(initial=0)), 2.0**-8) for x in (c, q)]
        with np.errstate(over="ignore"):
            wide = not top[0] * top[1] * max(c.shape[1], 1) < 2.0**37
        floors = queries.column("floor").fill_null(-np.inf).to_numpy()
        search = DualSearch(q, c, [np.array(i, np.int64) for i in candidates.column("ids").to_pylist()], k, object if wide else np.float64, floors, bits=8)
        search.run()
        found = search.id < np.iinfo(np.int64).max
        scores = [int(v) for v in search.score[found]]
        limit = np.iinfo(np.int64)
        return pa.table(
            {
                "query": queries.column("query").take(pa.array(np.nonzero(found)[0])),
                "vec_id": pa.array(search.id[found]),
                "score": pa.array([min(max(v, limit.min), limit.max) for v in scores], pa.int64()),
                "sorted": pa.array([sort_key(v) for v in scores], pa.binary()),
            }
        )

    return run


def top_centers(points: DataFrame) -> list[np.ndarray]:
    """Vectors that lie far from each other, from a sample of at most SAMPLE_ROWS: the nodes of the cover tree's top level, at most CENTERS."""
    sample = points.select("vec").orderBy(F.xxhash64("vec")).limit(SAMPLE_ROWS).toArrow().column("vec").to_pylist()
    if not sample:
        return []
    dims = [len(v) for v in sample]
    x = np.array([v for v in sample if len(v) == max(set(dims), key=dims.count)])
    wanted = min(CENTERS, max(1, -(-points.count() // CANDIDATE_BLOCK)), len(x))
    chosen, gap = [0], np.full(len(x), np.inf)
    with np.errstate(over="ignore", invalid="ignore"):
        while len(chosen) < wanted:
            gap = np.minimum(gap, ((x - x[chosen[-1]]) ** 2).sum(1))
            chosen.append(int(np.nan_to_num(gap).argmax()))
    return [x[i] for i in dict.fromkeys(chosen)]


def _placed(centers: list[np.ndarray]):
    """Adds the nearest center and the distance to it (-1 and infinite where no center has as many components)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.array(centers)
        for batch in batches:
            block, far = np.full(batch.num_rows, -1), np.full(batch.num_rows, np.inf)
            sizes = batch.column("vec").value_lengths().to_numpy()
            own = np.flatnonzero(sizes == (c.shape[1] if len(c) else -1))
            for some in np.array_split(own, len(own) // 1024 + 1):
                if len(some):
                    x = batch.column("vec").take(pa.array(some)).flatten().to_numpy().reshape(len(some), -1)
                    with np.errstate(over="ignore", invalid="ignore"):
                        near = np.nan_to_num(((x[:, None, :] - c[None, :, :]) ** 2).sum(2) if len(c) < 32 else (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), nan=np.inf)
                        block[some] = near.argmin(1)
                        far[some] = np.nan_to_num(np.sqrt(((x - c[block[some]]) ** 2).sum(1)), nan=np.inf)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block.astype(np.int32)), pa.array(far)], [*batch.schema.names, "block", "far"])

    return run


def _place(rows: DataFrame, centers: list[np.ndarray]) -> DataFrame:
    schema = T.StructType([*rows.schema.fields, T.StructField("block", T.IntegerType()), T.StructField("far", T.DoubleType())])
    return rows.mapInArrow(_placed(centers), schema).withColumn("dim", F.size("vec"))


def _in_reach(centers: list[np.ndarray], blocks: dict[int, tuple[float, int]]):
    """Groups of queries -> the blocks whose bound reaches the worst of their kth scores, by parts; there are at most CENTERS + 1 blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for g in batch.to_pylist():
                for b, (radius, parts) in blocks.items():
                    top = np.inf
                    if b >= 0 and g["block"] >= 0:
                        q, r = centers[g["block"]], centers[b]
                        with np.errstate(over="ignore", invalid="ignore"):
                            qn, rn = np.sqrt(q @ q), np.sqrt(r @ r)
                            top = q @ r + g["far"] * rn + radius * qn + g["far"] * radius + 1e-9 * ((qn + g["far"]) * (rn + radius) + 1)
                    if not top * 65536 < g["worst"]:
                        out += [(g["dim"], g["block"], g["set"], b, part) for part in range(parts) if (b, part) != (g["block"], 0)]
            names = ["dim", "group", "set", "block", "part"]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int32()) for i in range(5)], names)

    return run


def top_k(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, query_every: int = 50, scale: int = 256) -> DataFrame:
    """Vectors -> (query_id, rank, vec_id, score): of every row whose id ``query_every`` divides, the k best other rows.

    Components become floor(256 x), and the score is their exact integer inner product; ties go to the smaller id. Ranks follow the exact integers,
    whatever their size; a score beyond 64 bits is given as the nearest 64-bit integer. Equal vectors are one point that carries its k + 1 smallest ids (no
    query can need more), so copies cost nothing. Rows that are null or hold null or non-finite components, or whose id is null, take no part; empty
    vectors have score 0 with each other; vectors of different lengths are not compared; fewer rows than k: all. Equal rows are one
    row; an id with different vectors takes part with each of them, and no row is near another of its own id. Other columns are ignored; an empty table gives an
    empty table.

    Vectors are dealt into blocks by the nearest of the cover tree's top nodes, which come from a bounded sample, and queries likewise. Every group of
    queries first searches the block around its own node; then it goes only to those blocks whose bound reaches the worst of its kth scores. Each such
    pair of blocks is a dual-tree search in one task.
    """
    if scale != 256:
        raise ValueError("components are taken in 256ths")
    big = F.lit(float("inf"))
    raw = F.col(f"`{vec_col}`")
    sound = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)), F.lit(False))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.transform(raw, lambda x: x.cast("double")).alias("v")).where(F.col("id").isNotNull() & sound)
    # in 256ths, so that nothing overflows; beyond 2 ** 45 every double is a whole number of them, and no long holds it
    step = lambda x: F.when(F.abs(x) < 2.0**45, F.floor(x * 256).cast("double") / 256).otherwise(x)
    rows = rows.select("id", F.transform("v", step).alias("vec")).dropDuplicates(["id", "vec"])
    first = rows.withColumn("rn", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("rn") <= k + 1)
    points = cut(first.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    asked = rows.where(F.col("id") % query_every == 0)
    queries = cut(asked.select("vec").distinct().withColumn("query", F.monotonically_increasing_id()))
    owners = cut(asked.join(queries, "vec").select("id", "query"))
    deep = k + (owners.groupBy("id").count().agg(F.max("count")).first()[0] or 1)  # a query's own id may hold as many of the best places as it has vectors

    centers = top_centers(points)
    left, right = _place(points, centers), _place(queries, centers)
    stats = left.groupBy("block").agg(F.max("far"), F.count("*")).collect()  # at most CENTERS + 1 rows
    blocks = {b: (float(far), -(-n // CANDIDATE_BLOCK)) for b, far, n in stats}
    asked_of = {b: -(-n // QUERY_BLOCK) for b, n in right.groupBy("block").count().collect()}
    part = lambda sizes, c: F.pmod(F.xxhash64(c), F.element_at(F.create_map(*(F.lit(x) for b, n in (sizes or {-1: 1}).items() for x in (b, n))), F.col("block"))).cast("int")
    left = left.withColumn("part", part({b: n for b, (_, n) in blocks.items()}, "vec")).drop("far")
    right = right.withColumn("set", part(asked_of, "query"))
    pair = ["dim", "block", "part", "group", "set"]

    home = right.select("query", "vec", "dim", "block", F.lit(0).alias("part"), F.col("block").alias("group"), "set", F.lit(None).cast("double").alias("floor"))
    again = lambda df, names: df.select(*(F.col(c).alias(c) for c in names))  # noqa: E731  columns of their own, so that both sides of a cogroup differ
    spread = again(home, pair).distinct()
    near = left.join(spread, ["dim", "block", "part"]).groupBy(pair).cogroup(home.groupBy(pair)).applyInArrow(_block_search(deep), _FOUND)
    near = cut(near)
    floors = near.groupBy("query").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("floor")).where(F.col("n") >= deep).select("query", (F.col("floor") - F.abs("floor") * 1e-15).alias("floor"))
    known = cut(right.join(floors, "query", "left"))
    groups = known.groupBy("dim", "block", "set").agg(F.max("far").alias("far"), F.min(F.coalesce("floor", -big)).alias("worst"))
    pairs = cut(groups.mapInArrow(_in_reach(centers, blocks), "dim int, group int, set int, block int, part int"))
    theirs = left.join(again(pairs, pair), ["dim", "block", "part"])
    ours = known.withColumnRenamed("block", "group").join(pairs, ["dim", "group", "set"])
    more = theirs.groupBy(pair).cogroup(ours.select("query", "vec", "floor", *pair).groupBy(pair)).applyInArrow(_block_search(deep), _FOUND)

    best = Window.partitionBy("query").orderBy(F.desc("sorted"), "vec_id")
    found = cut(near.unionAll(more).withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= deep).drop("rn"))
    mine = owners.select(F.col("id").alias("query_id"), "query").join(found, "query").where("vec_id <> query_id")
    final = Window.partitionBy("query_id").orderBy(F.desc("sorted"), "vec_id")
    return mine.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Ranked lexical search: inverted treaps per term, in doc_id order for search and in impact order as heaps, traversed together."""

from __future__ import annotations

import math
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from gustline.llm.common import modest_batches, ragged_index, stored, text_bytes, text_slices

#: Queries of one pass over the documents have about so many terms; more queries take more passes.
PASS_TERMS = 1 << 20
#: Postings that a task holds in treaps at once, those in one node of a treap, and those of a part that is scored rather than split.
HELD, NODE, LEAF = 1 << 20, 32, 4096

_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(terms of all rows in a row, the row of each): runs of digits, letters A to Z in either case (lower-cased) and bytes of other than ASCII characters."""
    raw, rows = text_bytes(texts)
    word, first = _WORD[raw], np.zeros(len(raw) + 1, bool)
    first[rows[:-1]] = True
    starts = np.flatnonzero(word & (first[:-1] | ~np.r_[False, word[:-1]]))
    data, upto = _SMALL[raw[word]], np.cumsum(word)
    ends = np.r_[upto[starts] - 1, len(data)].astype(np.int32) if len(starts) else np.zeros(1, np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)]), np.searchsorted(rows, starts, side="right") - 1


def _count(vocabulary):
    """Documents -> id, number of terms, and those terms that queries have, by number, with how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = vocabulary.value
        for batch in batches:
            for part in text_slices(batch, "text"):
                terms, row = terms_of(part.column("text"))
                coded = terms.dictionary_encode()
                known = pc.fill_null(pc.index_in(coded.dictionary, value_set=asked), -1).to_numpy().astype(np.int64)
                term = known[coded.indices.to_numpy()] if len(terms) else np.zeros(0, np.int64)
                pairs, tf = np.unique((row * len(asked) + term)[term >= 0], return_counts=True)
                ends = np.searchsorted(pairs, np.arange(part.num_rows + 1) * len(asked)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (pairs % max(len(asked), 1), tf)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.bincount(row, minlength=part.num_rows)), *lists], ["id", "n", "terms", "tfs"])

    return run


class Best:
    """The k best (score, document) so far: higher scores first, then smaller ids, no id last."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.scores, self.nameless, self.ids = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, nameless: np.ndarray, ids: np.ndarray) -> None:
        scores, nameless, ids = np.r_[self.scores, scores], np.r_[self.nameless, nameless], np.r_[self.ids, ids]
        order = np.lexsort((ids, nameless, -scores))[: self.k]
        self.scores, self.nameless, self.ids = scores[order], nameless[order], ids[order]
        if len(order) == self.k:
            self.least = int(self.scores[-1])


class Treaps:
    """Postings of some documents: a treap for each term.

    A node holds up to NODE postings that follow each other by document; the search order is by document, and no node has a smaller impact (the greatest share that one of its postings
    adds to a score, but for the term's weight) than those below it. So a node bounds all postings in its subtree, and the topmost node that meets an interval of documents bounds the term there.
    """

    def __init__(self, doc: np.ndarray, term: np.ndarray, share: np.ndarray, n_docs: int, n_terms: int):
        self.n_docs = n_docs
        keys = term * n_docs + doc
        order = np.argsort(keys, kind="stable")
        self.keys, self.doc, self.share = keys[order], doc[order], share[order]
        ends = np.searchsorted(self.keys, np.arange(n_terms + 1) * n_docs)
        nodes = -(-np.diff(ends) // NODE)  # of each term
        at = ragged_index(np.zeros(n_terms, np.int64), nodes) * NODE + np.repeat(ends[:-1], nodes)
        upto = np.minimum(at + NODE, np.repeat(ends[1:], nodes))
        impact = np.maximum.reduceat(self.share, at) if len(at) else np.zeros(0, np.int64)
        none = len(at)  # stands for no node: it meets every interval and adds nothing
        self.impact = np.r_[impact, 0]
        self.first, self.last = np.r_[self.doc[at], 0], np.r_[self.doc[upto - 1], n_docs]
        self.left, self.right = np.full((2, none + 1), none)
        self.root = np.full(n_terms, none)
        self._grow(np.cumsum(np.r_[0, nodes]).tolist(), impact.tolist(), none)

    def _grow(self, bounds: list[int], impact: list[int], none: int) -> None:
        """Links the nodes of each term in one pass from left to right: the path from the root to the last node is a stack."""
        left, right, root = self.left.tolist(), self.right.tolist(), self.root.tolist()
        for t in range(len(bounds) - 1):
            stack: list[int] = []
            for x in range(bounds[t], bounds[t + 1]):
                below = none
                while stack and impact[stack[-1]] < impact[x]:
                    below = stack.pop()
                left[x] = below
                if stack:
                    right[stack[-1]] = x
                stack.append(x)
            if stack:
                root[t] = stack[0]
        self.left, self.right, self.root = np.array(left), np.array(right), np.array(root, np.int64)

    def _topmost(self, nodes: np.ndarray, begin: int, end: int) -> np.ndarray:
        """Each term's topmost node that meets the interval, from the node that did so for a wider one."""
        while True:
            behind, ahead = self.first[nodes] >= end, self.last[nodes] < begin
            if not (behind | ahead).any():
                return nodes
            nodes = np.where(behind, self.left[nodes], np.where(ahead, self.right[nodes], nodes))

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Best, nameless: np.ndarray, ids: np.ndarray) -> None:
        """Adds what belongs to the best: intervals of documents by falling bound, each split at the node with the greatest part in it, until none can reach the kth score."""
        base = terms * self.n_docs
        nodes = self.root[terms]
        heap = [(-int((weights * self.impact[nodes]).sum()), 0, self.n_docs, nodes)]
        while heap and -heap[0][0] >= best.least:
            _, begin, end, nodes = heappop(heap)
            lo, hi = np.searchsorted(self.keys, base + begin), np.searchsorted(self.keys, base + end)
            if end - begin == 1 or (hi - lo).sum() <= LEAF:
                self._score(lo, hi - lo, weights, best, nameless, ids)
                continue
            top = nodes[np.argmax(weights * self.impact[nodes])]
            middle, least = int(self.first[top] + self.last[top] + 1) >> 1, end - begin >> 3
            if not begin + least < middle < end - least:  # too one-sided, as where impacts rise with the id
                middle = begin + end >> 1
            for a, b in ((begin, middle), (middle, end)):
                own = self._topmost(nodes, a, b)
                bound = int((weights * self.impact[own]).sum())
                if bound >= best.least:
                    heappush(heap, (-bound, a, b, own))

    def _score(self, at: np.ndarray, count: np.ndarray, weights: np.ndarray, best: Best, nameless: np.ndarray, ids: np.ndarray) -> None:
        own = ragged_index(at, count)
        docs, place = np.unique(self.doc[own], return_inverse=True)
        scores = np.zeros(len(docs), np.int64)
        np.add.at(scores, place, self.share[own] * np.repeat(weights, count))
        good = scores >= best.least
        if good.any():
            best.add(scores[good], nameless[docs[good]], ids[docs[good]])


def _search(asked, n: int, total: int, k: int):
    """Counted documents -> the k best of this task for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weight = asked.value
        found = [Best(k) for _ in queries]
        held, postings = [], 0
        for batch in batches:
            for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                held.append(part)
                postings += len(part.column("terms").flatten())
                if postings >= HELD:
                    _search_held(held, queries, weight, n, total, found)
                    held, postings = [], 0
        if postings:
            _search_held(held, queries, weight, n, total, found)
        for at in range(0, len(found), 4096):
            own = found[at : at + 4096]
            numbers = np.repeat(np.arange(at, at + len(own)), [len(b.ids) for b in own])
            ids = pa.array(np.concatenate([b.ids for b in own]), mask=np.concatenate([b.nameless for b in own]))
            yield pa.RecordBatch.from_arrays([pa.array(numbers), ids, pa.array(np.concatenate([b.scores for b in own]))], ["query", "id", "score"])

    return run


def _search_held(held: list[pa.RecordBatch], queries: list[np.ndarray], weight: np.ndarray, n: int, total: int, found: list[Best]) -> None:
    table = pa.Table.from_batches(held).combine_chunks()
    column = lambda c: table.column(c).chunk(0) if table.num_rows else None
    ids, terms, tfs = column("id"), column("terms"), column("tfs")
    nameless, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
    order = np.lexsort((ids, nameless))  # documents by id
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    lengths = terms.value_lengths().to_numpy()
    tf = tfs.flatten().to_numpy().astype(np.int64)
    m = 100 - 90 + 90 * column("n").to_numpy() * n // total
    share = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, lengths))
    treaps = Treaps(np.repeat(rank, lengths), terms.flatten().to_numpy().astype(np.int64), share, len(order), len(weight))
    for own, best in zip(queries, found):
        if len(own):
            treaps.search(own, weight[own], best, nameless[order], ids[order])


def query_blocks(items: DataFrame) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Distinct (item, terms), in blocks of about PASS_TERMS terms; the driver holds one block at a time."""
    block, size = [], 0
    for row in items.distinct().toLocalIterator():
        terms, _ = terms_of(pa.array([row.text or ""], pa.string()))
        block.append((row.item, terms.unique().to_pylist()))
        size += 16 + len(block[-1][1])
        if size >= PASS_TERMS:
            yield block
            block, size = [], 0
    if block:
        yield block


def rank_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = 10) -> DataFrame:
    """(item, rank, document, score): each item's ``k`` best documents with a score above 0.

    Every term of an item that a document holds adds weight times share: the weight is floor(1000 ln((2N + 2) / (2 df + 1))), the share grows with the term's count in the document and falls with
    the document's length, in integers. Documents are split into terms once a block of queries; the counts of those that queries have are stored. Tasks then build treaps over up to
    HELD postings at a time, search all queries of the block in them, and keep k documents of each query, whose kth score prunes what follows; the tasks' best are ranked in the end.
    The query set goes through the driver in blocks of bounded size, documents never do. Counts cover all documents.
    Null texts and those without terms don't count and aren't found. Equal scores are ranked by id, null ids last; rows that repeat an id are ranked each by itself. Equal items (id and text) are
    one query, other rows of one item id have ranks of their own. Items without known terms and empty tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    modest_batches(docs)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    asked = items.select(F.col(f"`{item_col}`").alias("item"), F.coalesce(F.col(f"`{item_text_col}`"), F.lit("")).alias("text"))
    kind = asked.schema["item"].dataType.simpleString()
    schema = f"item {kind}, rank int, id long, score long"
    out = None
    for block in query_blocks(asked):
        vocabulary = sorted({t for _, terms in block for t in terms})
        place = {t: i for i, t in enumerate(vocabulary)}
        counted = stored(texts.mapInArrow(_count(spark.sparkContext.broadcast(pa.array(vocabulary, pa.binary()))), "id long, n long, terms array<int>, tfs array<int>"), "postings")
        n, total = counted.where("n > 0").agg(F.count("*"), F.sum("n")).first()
        weight = np.zeros(len(vocabulary), np.int64)  # a row for each term that the block's queries have
        for term, df in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            weight[term] = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
        if not n or not len(vocabulary):
            continue
        queries = [np.array([place[t] for t in terms], np.int64) for _, terms in block]
        found = counted.mapInArrow(_search(spark.sparkContext.broadcast((queries, weight)), n, total, k), "query long, id long, score long")
        ranks = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        ranked = found.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k)
        names = spark.createDataFrame([Row(query=i, item=item) for i, (item, _) in enumerate(block)], f"query long, item {kind}")
        part = ranked.join(F.broadcast(names), "query").select("item", "rank", "id", "score")  # names are bounded by PASS_TERMS
        out = part if out is None else out.unionByName(part)
    out = spark.createDataFrame([], schema) if out is None else out
    return out.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")

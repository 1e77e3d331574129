"""Packing: token streams cut into sequences by order-preserving dynamic programming, within ranges of document ids."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustline.llm import encode
from gustline.llm.common import keyed, shared_dir, text_slices

#: What a cut costs, in tokens of padding: behind a sentence, and elsewhere inside a document. Between documents it is free.
SENTENCE_CUT, FORCED_CUT = 8, 32
#: Ids that are planned before settled sequences are given out, and ids that are planned again where none or few are settled and the best ones so far are given out.
#: That may cost one sequence in HORIZON - REPLAN ids (one in 192) and in practice costs a few ids: from the best cut so far any plan can go on as it would, after at most one more cut.
HORIZON, REPLAN = 1 << 20, 1 << 18


def cut_points(ids: np.ndarray, doc_ends: np.ndarray, ends_sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where documents that lie in a row may well be cut (ids before the cut), and what the cut costs: at each document's end, and behind every sentence."""
    cost = np.full(len(ids) + 1, -1, np.int64)
    cost[1:][ends_sentence[ids]] = SENTENCE_CUT
    cost[doc_ends] = 0
    at = np.flatnonzero(cost[1:] >= 0) + 1
    return at, cost[at]


class Plan:
    """The cuts of a stream with the least padding and cut costs, as cut points come in.

    The total up to a cut is the least total over the cuts at most ``capacity`` before it, plus one sequence and the cut's
    cost: a minimum over a sliding window, which a monotone queue keeps. A cut elsewhere, at the price ``forced``, is best made where it fills its sequence, as a later start
    reaches no less; so it need only be tried exactly ``capacity`` behind a cut, and only behind one that the queue has kept so far. Only the
    cuts in the queue can come before a later one, so what the best ways to all of them share is part of the plan of the whole stream, and can be given out.
    """

    def __init__(self, capacity: int, forced: int | None = None):
        self.capacity, self.forced = capacity, forced
        self.points, self.costs = [], []  # cut points behind the last cut that was given out
        self._start(0)

    def _start(self, at: int) -> None:
        self.at, self.total, self.before, self.queue, self.head = [at], [0], [0], [0], 0

    def extend(self, points: list[int], costs: list[int]) -> None:
        """Rising cut points and their costs; without a price for forced cuts neighbours lie at most ``capacity`` apart."""
        self.points += points
        self.costs += costs
        self._plan(points, costs)

    def _plan(self, points: list[int], costs: list[int]) -> None:
        at, total, before, queue, head, capacity, forced = self.at, self.total, self.before, self.queue, self.head, self.capacity, self.forced
        j = len(at)
        for here, cost in zip(points, costs):
            reach = here - capacity
            while at[queue[head]] < reach:
                i = queue[head]
                head += 1
                if forced is not None:
                    t = total[i] + capacity + forced
                    at.append(at[i] + capacity)
                    total.append(t)
                    before.append(i)
                    while len(queue) > head and total[queue[-1]] >= t:
                        queue.pop()
                    queue.append(j)
                    j += 1
            i = queue[head]
            t = total[i] + capacity + cost
            at.append(here)
            total.append(t)
            before.append(i)
            while len(queue) > head and total[queue[-1]] >= t:
                queue.pop()
            queue.append(j)
            j += 1
        del queue[:head]
        self.head = 0

    def _way(self, last: int) -> list[int]:
        cuts = []
        while last:
            cuts.append(self.at[last])
            last = self.before[last]
        return cuts[::-1]

    def settled(self) -> list[int]:
        """The cuts that the best ways to all cuts in the queue share; they are forgotten."""
        ends = sorted({-i for i in self.queue})
        while len(ends) > 1:  # the last one gives way to the one before it
            i = self.before[-heappop(ends)]
            if -i not in ends:
                heappush(ends, -i)
        root = -ends[0]
        cuts = self._way(root)
        self.at, self.total = self.at[root:], self.total[root:]
        self.before = [max(i - root, 0) for i in self.before[root:]]
        self.queue = [i - root for i in self.queue]
        self._forget(self.at[0])
        return cuts

    def _forget(self, place: int) -> None:
        k = bisect_right(self.points, place)
        self.points, self.costs = self.points[k:], self.costs[k:]

    def commit(self, keep: int) -> list[int]:
        """The best way so far, but for its last ``keep`` ids, whether settled or not; what follows is planned anew from there."""
        cuts = [c for c in self.best() if c <= self.at[-1] - keep]
        if not cuts:
            return []
        self._forget(cuts[-1])
        self._start(cuts[-1])
        self._plan(self.points, self.costs)
        return cuts

    def best(self) -> list[int]:
        """The best way to a cut among the last ``capacity`` ids; what is behind it needs no padding."""
        end = self.at[-1]
        return self._way(min((j for j in range(len(self.at)) if self.at[j] > end - self.capacity), key=lambda j: (self.total[j] - self.at[j], -j)))

    def finish(self) -> list[int]:
        """The rest of the plan: the best way, then sequences of power-of-two lengths."""
        cuts = self.best()
        done = cuts[-1] if cuts else self.at[0]
        for n in powers_of_two(self.at[-1] - done):
            done += n
            cuts.append(done)
        return cuts


def plan_cuts(at: list[int], cost: list[int], capacity: int, forced: int | None = None) -> list[int]:
    """The cuts with the least padding and cut costs of a whole stream, from 0 to the best cut among its last ``capacity`` ids."""
    plan = Plan(capacity, forced)
    plan.extend(at, cost)
    return plan.best()


def powers_of_two(n: int) -> list[int]:
    """n as a sum of falling powers of two."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Packer:
    """Takes documents in order; gives batches of pieces."""

    def __init__(self, capacity: int, ends_sentence: np.ndarray, base: int):
        self.ends_sentence, self.base = ends_sentence, base
        self.plan, self.given, self.sequence = Plan(capacity, FORCED_CUT), 0, 0
        self.ids = np.zeros(0, np.uint32)  # those not yet given out
        self.names, self.ends = [], np.zeros(0, np.int64)  # documents not yet given out whole: names, places of their ends
        self.begin = 0  # the place where the first of them begins

    def add(self, names: list[int | None], ids: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Documents, their ids in a row, and where each ends."""
        for first in range(0, len(names), 256):
            own = ends[first : first + 256]
            start = ends[first - 1] if first else 0
            points, costs = cut_points(ids[start : own[-1]], own - start, self.ends_sentence)
            place = self.given + len(self.ids)
            self.plan.extend((points + place).tolist(), costs.tolist())
            self.ids = np.concatenate([self.ids, ids[start : own[-1]]])
            self.names += names[first : first + 256]
            self.ends = np.concatenate([self.ends, own - start + place])
            if len(self.ids) >= HORIZON:
                yield from self._give(self.plan.settled())
                if len(self.ids) > REPLAN:
                    yield from self._give(self.plan.commit(REPLAN))

    def finish(self) -> Iterator[pa.RecordBatch]:
        if self.names:
            yield from self._give(self.plan.finish())

    def _give(self, cuts: list[int]) -> Iterator[pa.RecordBatch]:
        """The pieces up to the last cut; places count from the partition's first id."""
        if not cuts:
            return
        cuts = np.array(cuts, np.int64)
        starts = np.r_[self.begin, self.ends[:-1]]
        edges = np.unique(np.r_[self.given, cuts, self.ends[(self.ends > self.given) & (self.ends < cuts[-1])]])
        left, right = edges[:-1], edges[1:]
        doc, seq = np.searchsorted(self.ends, left, side="right"), np.searchsorted(cuts, left, side="right")
        offset = left - np.r_[self.given, cuts][seq]
        names = pa.array(self.names, pa.int64()).take(pa.array(doc))
        numbers = [left - starts[doc], right - left, (self.ends - starts)[doc], self.base + self.sequence + seq, offset]
        own = encode.id_rows(self.ids[: cuts[-1] - self.given], edges - self.given)
        yield pa.RecordBatch.from_arrays([names, *(pa.array(x) for x in numbers), own], ["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
        self.sequence += len(cuts)
        self.ids = self.ids[cuts[-1] - self.given :]
        self.given = int(cuts[-1])
        done = int(np.searchsorted(self.ends, self.given, side="right"))  # documents given out whole
        begin = int(self.ends[done - 1]) if done else self.begin
        self.names, self.ends, self.begin = self.names[done:], self.ends[done:], begin


def _pack(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encode.from_file(path)
        vocab = encoder.tokenizer.get_vocab()
        ends_sentence = np.zeros(max(max(vocab.values()), end_id) + 1, bool)
        ends_sentence[[i for token, i in vocab.items() if token.removesuffix("</w>")[-1:] in (".", "!", "?")]] = True
        packer = Packer(capacity, ends_sentence, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for part in text_slices(batch, "text"):
                ids, ends = encoder.encode_column(part.column("text"), end_id)
                yield from packer.add(part.column("id").to_pylist(), ids, ends[1:])
        yield from packer.finish()

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 2) -> DataFrame:
    """Documents -> (id, start, length, doc_tokens, sequence_id, offset, ids): the pieces of all documents in sequences.

    Each text (null: empty) is encoded whole and gets ``end_id``. Documents stay in the order of their ids: the table is
    dealt into ranges of ids, each range is one stream of tokens, and the stream's cuts, at documents' and sentences' ends and at a higher price
    behind any id, are planned so that padding to ``capacity`` plus the cost of cuts inside documents is least. What remains at a range's end fills
    sequences of power-of-two lengths. A sequence is named by its range and its number there; offsets have
    no gaps. The ranges' bounds come from a sample of ids that Spark draws, so a table read in other parts may get other bounds, and near them other
    cuts and sequence ids. ids is little-endian unsigned 32-bit. Every id of every document is in
    one piece, an empty document's end id too. Rows with a null id come first, under a null id; rows of one id follow each other by a hash of their
    text; an empty table gives an empty table; other columns are ignored.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    shared_dir(docs.sparkSession)
    rows = keyed(docs, id_col, text_col).repartitionByRange("id", "key").sortWithinPartitions("id", "key").select("id", "text")
    out = rows.mapInArrow(_pack(tokenizer_path, capacity, end_id), "id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
    return out.withColumnRenamed("id", id_col)

"""Quality classifier: a byte-level convolutional network in numpy, trained on a bounded sample of labelled rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gustline.llm.common import keyed, modest_batches, ragged_index, text_bytes, text_slices

#: Bytes that a filter sees, filters, bytes of a chunk, and by how much chunks start apart (so that they overlap).
WIDTH, FILTERS, CHUNK, STRIDE = 6, 16, 256, 224
#: The bounded sample: labelled rows of each class, and bytes of all their texts, of which one may have an eighth. It bounds rows; the texts of those that are in it are learned from whole.
SAMPLE_ROWS, SAMPLE_BYTES = 1500, 32 << 20
#: Chunks whose filters are computed at once in training.
AT_ONCE = 2048
#: In training, such a share of documents is cut to a random length at each step, so that short texts are learned too.
SHORT_SHARE = 0.35


@dataclass
class Network:
    """taps (WIDTH x 256 x FILTERS): what each byte adds to each filter; bias; weights of the mean and of the maximum over chunks."""

    taps: np.ndarray
    bias: np.ndarray
    mean: np.ndarray
    most: np.ndarray
    shift: float

    def pairs(self) -> list[np.ndarray]:
        """The same filters by pairs of bytes: one lookup for two taps."""
        return [(self.taps[j][:, None] + self.taps[j + 1][None]).reshape(65536, -1) for j in range(0, WIDTH, 2)]


def chunk_starts(length: int) -> np.ndarray:
    """Where the chunks of a text begin; together they cover all of its bytes."""
    return np.arange(0, max(length - CHUNK + STRIDE, 1), STRIDE) if length > CHUNK else np.zeros(1, np.int64)


def _padded(raw: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' bytes with WIDTH zeros after each, and where each row begins."""
    n = len(rows) - 1
    starts = rows[:-1] + WIDTH * np.arange(n)
    out = np.zeros(len(raw) + WIDTH * n + 1, np.uint8)
    out[ragged_index(starts, np.diff(rows))] = raw
    return out, starts


def probabilities(net: Network, raw: np.ndarray, rows: np.ndarray, pairs: list[np.ndarray] | None = None) -> np.ndarray:
    """The probability of label 1 for every row, from all of its bytes."""
    pairs = net.pairs() if pairs is None else pairs
    data, starts = _padded(raw, rows)
    lengths = np.diff(rows)
    two = data[:-1].astype(np.int32) * 256 + data[1:]
    n = len(two) - WIDTH + 2
    answer = np.take(pairs[0], two[:n], axis=0)
    for j in range(1, len(pairs)):
        answer += np.take(pairs[j], two[2 * j : 2 * j + n], axis=0)
    counts = np.where(lengths > CHUNK, (lengths - CHUNK + STRIDE - 1) // STRIDE + 1, 1)
    row = np.repeat(np.arange(len(lengths)), counts)
    first = ragged_index(np.zeros(len(counts), np.int64), counts) * STRIDE
    last = np.maximum(np.minimum(first + CHUNK, lengths[row]) - WIDTH, first) + 1
    edges = np.stack([starts[row] + first, starts[row] + last], axis=1).reshape(-1)
    pooled = np.maximum(np.maximum.reduceat(answer, edges, axis=0)[::2] + net.bias, 0)
    begin = np.cumsum(counts) - counts
    mean = np.add.reduceat(pooled, begin, axis=0) / counts[:, None]
    most = np.maximum.reduceat(pooled, begin, axis=0)
    return 1 / (1 + np.exp(-np.clip((mean @ net.mean + most @ net.most + net.shift).astype(np.float64), -30, 30)))


def _highest(taps: np.ndarray, x: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each filter is highest in each chunk, and how high; as in scoring, filters end with the text."""
    span = CHUNK - WIDTH + 1
    z = sum(np.take(taps[j], x[:, j : j + span], axis=0) for j in range(WIDTH))
    z[np.arange(span)[None] > np.maximum(used - WIDTH, 0)[:, None]] = -1e9
    spot = z.argmax(1)
    return spot, np.take_along_axis(z, spot[:, None], 1)[:, 0]


def train(chunks: list[np.ndarray], labels: np.ndarray, epochs: int = 12, batch: int = 32, rate: float = 0.02, seed: int = 7) -> Network:
    """chunks: for each document all its chunks (k x CHUNK bytes, zeros behind a short text). Adam on the logistic loss."""
    rng = np.random.default_rng(seed)
    p = {"taps": rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32), "bias": np.zeros(FILTERS, np.float32), "mean": rng.normal(0, 0.3, FILTERS).astype(np.float32), "most": np.zeros(FILTERS, np.float32), "shift": np.zeros(1, np.float32)}
    if not len(labels):
        return Network(p["taps"], p["bias"], p["mean"] * 0, p["most"], 0.0)
    ones = max(labels.sum(), 1), max((1 - labels).sum(), 1)
    weight = np.where(labels == 1, len(labels) * 0.6 / ones[0], len(labels) * 0.4 / ones[1])
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), batch):
            docs = order[at : at + batch]
            x = np.concatenate([chunks[d] for d in docs])
            row = np.repeat(np.arange(len(docs)), [len(chunks[d]) for d in docs])
            short = rng.random(len(docs)) < SHORT_SHARE
            keep = ~short[row] | np.r_[True, row[1:] != row[:-1]]  # of a shortened document, the first chunk
            x, row = x[keep].copy(), row[keep]
            limit = np.where(short, np.exp(rng.uniform(np.log(3), np.log(CHUNK), len(docs))), CHUNK).astype(int)[row]
            x[np.arange(CHUNK)[None] >= limit[:, None]] = 0
            used = CHUNK - (x[:, ::-1] != 0).argmax(1) * (x != 0).any(1) - CHUNK * ~(x != 0).any(1)
            counts = np.bincount(row, minlength=len(docs))
            begin = np.cumsum(counts) - counts
            spot, top = (np.concatenate(parts) for parts in zip(*(_highest(p["taps"], x[k : k + AT_ONCE], used[k : k + AT_ONCE]) for k in range(0, len(x), AT_ONCE))))
            top = top + p["bias"]
            pooled = np.maximum(top, 0)
            mean = np.add.reduceat(pooled, begin, axis=0) / counts[:, None]
            most = np.maximum.reduceat(pooled, begin, axis=0)
            out = 1 / (1 + np.exp(-np.clip(mean @ p["mean"] + most @ p["most"] + p["shift"], -30, 30)))
            err = ((out - labels[docs]) * weight[docs] / len(docs)).astype(np.float32)
            g = {"mean": mean.T @ err, "most": most.T @ err, "shift": err.sum(keepdims=True)}
            back = err[row][:, None] * (p["mean"] / counts[row][:, None] + p["most"] * (pooled == most[row])) * (top > 0)
            g["bias"] = back.sum(0)
            g["taps"] = np.zeros_like(p["taps"])
            lane = np.arange(FILTERS)[None]
            for j in range(WIDTH):
                np.add.at(g["taps"][j], (x[np.arange(len(x))[:, None], spot + j], np.broadcast_to(lane, spot.shape)), back)
            step += 1
            speed = rate * (0.5 if epoch >= epochs * 2 // 3 else 1)
            for k in p:
                g[k] = g[k].astype(np.float32) + 1e-5 * p[k]
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                p[k] -= speed * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)
    return Network(p["taps"], p["bias"], p["mean"], p["most"], float(p["shift"][0]))


def held_out(id_col) -> F.Column:
    """True for the rows that no label may be learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def chunk_grid(text: bytes) -> np.ndarray:
    """All chunks of a text, zeros behind its end."""
    starts = chunk_starts(len(text))
    data = np.zeros(starts[-1] + CHUNK, np.uint8)
    data[: len(text)] = np.frombuffer(text, np.uint8)
    return data[starts[:, None] + np.arange(CHUNK)]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Network:
    """Trains on whole texts of at most ``sample_rows`` rows of each class, those with the smallest hash of their id, none of them held out.

    What reaches the driver is bounded: of each class so many rows, in that order, as have half of ``sample_bytes`` together; a row with an eighth of ``sample_bytes`` by itself is not
    learned from. Rows with a null or other label than 0 and 1 are left out; of rows that share an id the one with the smallest hash of its text is taken. Without
    any labelled row the network answers 0.5 for every text.
    """
    rows = keyed(docs, id_col, text_col)
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)")
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg(F.min("label").alias("label"))
    parts = [known.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(sample_rows) for k in (0, 1)]
    chosen = parts[0].unionAll(parts[1])  # at most 2 x sample_rows rows, so it may be broadcast
    size = F.octet_length("text")
    found = rows.join(F.broadcast(chosen), "id").where(size <= sample_bytes // 8).groupBy("id", "label").agg(F.min(F.struct("key", "text")).alias("x")).select("id", "label", "x.text")
    before = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id")
    sample = found.withColumn("_upto", F.sum(size).over(before)).where(F.col("_upto") <= sample_bytes // 2).drop("_upto").toPandas().sort_values("id")
    return train([chunk_grid(t.encode()) for t in sample["text"]], sample["label"].to_numpy(dtype=np.int64))


def quality_scores(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents -> (id, held_out, score, predicted): the probability of good quality of each whole text.

    Only the text's bytes are an input. Every chunk of every text is scored; an empty or null text has one chunk of zeros. Rows with a null id are
    scored too and are not held out; equal rows get equal scores; an empty table gives an empty table; other columns are ignored.
    """
    rows = keyed(docs, id_col, text_col).select("id", "text")
    scored = rows.mapInArrow(_scored(net), "id long, score double")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _scored(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = net.pairs()
        for batch in batches:
            for part in text_slices(batch, "text", 1 << 18):
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(probabilities(net, *text_bytes(part.column("text")), pairs))], ["id", "score"])

    return run


def keep_good(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """The documents whose score is 0.5 or more, with all their columns, whatever their names (null and empty texts are scored like others)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = net.pairs()
        for batch in batches:
            for part in text_slices(batch, "text", 1 << 18):
                good = probabilities(net, *text_bytes(part.column("text")), pairs) >= 0.5
                yield part.filter(pa.array(good))

    modest_batches(docs)
    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*([F.col(f"`{c}`") for c in others] or [F.lit(True).alias("none")])).alias("rest"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, rows.schema).select(*(F.col("text").alias(c) if c == text_col else F.col("rest")[c].alias(c) for c in docs.columns))

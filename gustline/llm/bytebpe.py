"""Byte-level BPE from a rank file: encoding with the tokenizers library, character offsets, and decoding by the byte table."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustline.llm import encode
from gustline.llm.common import keyed, ragged_index, text_bytes, text_slices
from gustline.llm.encode import byte_characters


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts that BPE has left of a token's bytes just before the token itself would be made."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        options = [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if ranks.get(parts[i] + parts[i + 1], ranks[token]) < ranks[token]]
        if not options:
            break
        i = min(options)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else (b"", b"")


def tokenizer_from_ranks(path: str, pattern: str | None = None) -> tokenizers.Tokenizer:
    """A tokenizer with the file's ranks as ids; every match of the pattern (default: that of the public tokenizers) is merged by itself."""
    if pattern is None:
        from public_tokenizers import PATTERN as pattern
    ranks = read_ranks(path)
    shown = byte_characters()
    name = lambda token: "".join(shown[b] for b in token)
    merges = []
    for token in sorted((t for t in ranks if len(t) > 1), key=ranks.__getitem__):
        left, right = last_merge(token, ranks)
        if left:
            merges.append((name(left), name(right)))
    model = tokenizers.models.BPE(vocab={name(t): r for t, r in ranks.items()}, merges=merges)
    out = tokenizers.Tokenizer(model)
    split = tokenizers.pre_tokenizers.Split(tokenizers.Regex(pattern), "isolated")
    out.pre_tokenizer = tokenizers.pre_tokenizers.Sequence([split, tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return out


@lru_cache(maxsize=4)
def token_bytes(path: str) -> tuple[bytes, ...]:
    """The bytes of every id: of a rank file as it says, of a tokenizer file by the byte table, reversed."""
    if path.endswith(".json"):
        back = {c: b for b, c in enumerate(byte_characters())}
        vocab = {i: t for t, i in tokenizers.Tokenizer.from_file(path).get_vocab().items()}
        return tuple(bytes(back[c] for c in vocab[i]) if all(c in back for c in vocab.get(i, "\n")) else vocab.get(i, "").encode() for i in range(max(vocab) + 1))
    ids = {r: t for t, r in read_ranks(path).items()}
    return tuple(ids.get(i, b"") for i in range(max(ids) + 1))


def encoder(path: str) -> encode.Encoder:
    return encode.from_file(path) if path.endswith(".json") else encode.from_maker(tokenizer_from_ranks, path)


def character_starts(text: bytes, lengths: np.ndarray) -> np.ndarray:
    """Where each token begins, in characters; a token that begins inside a character begins where that does."""
    begins = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    before = np.r_[0, np.cumsum(begins)]  # characters begun before each byte
    at = np.cumsum(lengths) - lengths
    return before[at + 1] - 1 if len(at) else at


def character_ends(text: bytes, lengths: np.ndarray) -> np.ndarray:
    """Where each token ends, in characters; a token that ends inside a character ends behind it."""
    begins = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    return np.r_[0, np.cumsum(begins)][np.cumsum(lengths)]


def _offsets(texts: pa.Array, ids: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> list[pa.Array]:
    raw, rows = text_bytes(texts)
    own = [(raw[s:e].tobytes(), lengths[ids[i:j]]) for s, e, i, j in zip(rows[:-1], rows[1:], ends[:-1], ends[1:])]
    return [pa.array([f(t, n) for t, n in own], pa.list_(pa.int32())) for f in (character_starts, character_ends)]


def _encode(path: str, offsets: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        lengths = np.array([len(t) for t in token_bytes(path)]) if offsets else None
        for batch in batches:
            for part in text_slices(batch, "text"):
                ids, ends = own.encode_column(part.column("text"))
                columns = [part.column("id"), pa.array(np.diff(ends)), encode.id_rows(ids, ends)]
                if offsets:
                    columns += _offsets(part.column("text"), ids, ends, lengths)
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids", "starts", "ends"][: len(columns)])

    return run


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """Documents -> (id, n_tokens, ids): ids of each whole text (null: empty), as little-endian unsigned 32-bit integers.

    With ``offsets`` also starts and ends: the characters that each token covers, whole or in part. Strings of special tokens are ordinary
    text. Null ids stay null; equal rows give equal rows; an empty text has no ids; an empty table gives an empty table; other columns are ignored.
    """
    rows = keyed(docs, id_col, text_col).select("id", "text")
    more = ", starts array<int>, ends array<int>" if offsets else ""
    return rows.mapInArrow(_encode(path, offsets), f"id long, n_tokens long, ids binary{more}").withColumnRenamed("id", id_col)


def decode_documents(tokens: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded`` (the bytes of all ids in a row) to a table of ids (null: none).

    Bytes are joined before they are read as UTF-8, so characters that are split between tokens come out whole; see ``as_text`` for
    bytes that are no UTF-8, as a cut sequence may end in. An id that the vocabulary lacks is an error.
    """
    from pyspark.sql import types as T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_bytes(path)
        sizes = np.array([len(t) for t in tokens], np.int64)
        table, places = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(sizes) - sizes
        for batch in batches:
            for part in text_slices(batch, ids_col):
                ids, rows = text_bytes(part.column(ids_col))
                ids, rows = np.ascontiguousarray(ids).view("<u4"), rows // 4
                if len(ids) and int(ids.max()) >= len(sizes):
                    raise IndexError(f"the vocabulary has no id {int(ids.max())}")
                upto = np.r_[0, np.cumsum(sizes[ids])]
                raw = table[ragged_index(places[ids], sizes[ids])]
                decoded = pa.BinaryArray.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(upto[rows].astype(np.int32)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([*part.columns, decoded], [*part.schema.names, "decoded"])

    base = tokens.drop("decoded")
    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField("decoded", T.BinaryType())]))


def as_text(decoded: bytes) -> str:
    """Decoded bytes as text; what is no whole character becomes U+FFFD."""
    return decoded.decode("utf-8", errors="replace")

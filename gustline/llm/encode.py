"""Whole texts through the tokenizers library, each distinct chunk of a text once.

A text is cut only where white space follows a character that is none, or a mark an ASCII letter. No piece that the splitters of these vocabularies can match
reaches over such a place: a piece is either white space alone, or at most one space and then letters only, digits only, or neither, and
no rule looks at what lies before a piece. So the pieces of a text are those of its chunks in a row, and so are the ids. Chunks
repeat far more than texts do; each worker keeps the ids of those it has seen, up to a bound. Tests hold the ids against
those of whole texts, for all documents and all vocabularies.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tokenizers

from gustline.llm.common import ragged_index, text_bytes

#: Chunks and ids remembered by a worker; beyond that it forgets all and starts anew (results don't depend on it).
REMEMBERED, REMEMBERED_IDS = 500_000, 8_000_000
#: Longer chunks (in characters) are encoded but not remembered.
LONGEST = 64
#: A word of Latin letters (each a letter by itself, in normal form) with the space before it: every splitter here makes of it one piece.
PLAIN = "^ ?[A-Za-zÀ-ÖØ-öø-ÿ]+$"
#: Marks that end a piece of letters before them: no splitter here has a piece of letters and these.
_MARK, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_MARK[[*b".,;:!?"]] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: White space of other characters than these six: its last bytes, as a big-endian number.
_ODD = [c.encode() for c in map(chr, range(0x3001)) if c.isspace() and not (c.isascii() and _SPACE[ord(c)])]
_ODD_BY_SIZE = {n: np.array([int.from_bytes(c, "big") for c in _ODD if len(c) == n], np.int64) for n in (1, 2, 3)}


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the others in order from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    out = [""] * 256
    for b in shown:
        out[b] = chr(b)
    for k, b in enumerate(hidden):
        out[b] = chr(0x100 + k)
    return out


def chunk_starts(raw: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where chunks begin: at the start of each row that is not empty, at white space right behind a character that is none, and at a mark right behind a letter."""
    if not len(raw):
        return np.zeros(0, np.int64)
    space = _SPACE[raw]
    edge = np.zeros(len(raw), bool)
    edge[1:] = space[1:] & ~space[:-1]
    at = np.flatnonzero(edge)
    edge[1:] |= _MARK[raw[1:]] & _LETTER[raw[:-1]]
    odd = at[(raw[at - 1] >= 0x80) | (raw[at - 1] < 0x20)]
    if len(odd):
        behind = np.zeros(len(odd), np.int64)
        bad = np.zeros(len(odd), bool)
        for n in (1, 2, 3):  # the last n bytes before the place, as a number
            behind += np.where(odd >= n, raw[np.maximum(odd - n, 0)], 0).astype(np.int64) << 8 * (n - 1)
            bad |= np.isin(behind, _ODD_BY_SIZE[n])
        edge[odd[bad]] = False
    edge[rows[:-1][np.diff(rows) > 0]] = True
    return np.flatnonzero(edge)


def led_by_space(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which bytes are white space at the start of a chunk."""
    space, edge = _SPACE[raw], np.zeros(len(raw), bool)
    edge[starts] = True
    begins = space & (edge | np.r_[True, ~space[:-1]])
    return space & np.r_[False, edge[begins]][np.cumsum(begins)]


class Encoder:
    """Columns of texts -> their ids."""

    def __init__(self, tokenizer: tokenizers.Tokenizer):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        tokenizer.encode_special_tokens = True  # such strings in a text are ordinary text
        self.tokenizer = tokenizer
        alone = lambda chunk: list(tokenizer.encode(chunk, add_special_tokens=False).ids)
        lowers, names = alone("Q") == alone("q"), byte_characters()
        self.drops_space = alone(" ") == []
        self.shown = {i: "".join(names[b] for b in (chr(i).lower() if lowers else chr(i)).encode()) for i in range(256) if i != 10}
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def encode_column(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows in a row, where each row's begin and the last one's end); with ``end_id`` behind each row's. Null is empty."""
        raw, rows = text_bytes(texts)
        starts = chunk_starts(raw, rows)
        if self.drops_space:  # then chunks need none, and fewer of them differ
            solid = ~led_by_space(raw, starts)
            before = np.r_[0, np.cumsum(solid)]
            raw, rows, starts = raw[solid], before[rows], before[starts]
            starts = starts[np.r_[starts[1:] > starts[:-1], starts[-1:] < len(raw)]]
        chunks = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.r_[starts, len(raw)].astype(np.int32)), pa.py_buffer(raw))
        distinct = chunks.dictionary_encode()
        slot = self._slots(distinct.dictionary)
        pick = slot[distinct.indices.to_numpy()] if len(starts) else np.zeros(0, np.int64)
        begin, count = self.ends[pick], self.ends[pick + 1] - self.ends[pick]
        upto = np.r_[0, np.cumsum(count)][np.searchsorted(starts, rows)]
        ids = self.flat[ragged_index(begin, count)]
        if end_id is not None:
            ids = np.insert(ids, upto[1:], np.uint32(end_id))
            upto = upto + np.arange(len(upto))
        if len(self.known) > REMEMBERED or len(self.flat) > REMEMBERED_IDS:
            self._forget()
        else:  # long chunks were put behind the others
            self.ends = self.ends[: len(self.known) + 1]
            self.flat = self.flat[: self.ends[-1]]
        return ids, upto

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        ids, upto = self.encode_column(pa.array(texts, pa.string()))
        return [ids[s:e].tobytes() for s, e in zip(upto[:-1], upto[1:])]

    def _slots(self, chunks: pa.Array) -> np.ndarray:
        """The place of each distinct chunk in ``ends``; chunks that are new are encoded, the long ones last."""
        names = chunks.to_pylist()
        slots = np.array([*map(self.known.get, names, repeat(-1))], np.int64)
        new = np.flatnonzero(slots < 0)
        if not len(new):
            return slots
        fresh = chunks.take(pa.array(new))
        size = pc.utf8_length(fresh).to_numpy()
        plain = pc.match_substring_regex(fresh, PLAIN).to_numpy(zero_copy_only=False) & (size <= LONGEST)
        order = new[np.argsort(np.where(plain, 0, np.where(size <= LONGEST, 1, 2)), kind="stable")]
        chosen, split = [names[i] for i in order.tolist()], int(plain.sum())
        ids, counts = self._words(chosen[:split])
        more, n = self._encoded(chosen[split:])
        base = len(self.known)
        self.flat = np.concatenate([self.flat, ids, more])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.r_[counts, n])])
        slots[order] = base + np.arange(len(order))
        self.known.update(zip(chosen[: int((size <= LONGEST).sum())], range(base, base + len(order))))
        return slots

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Plain words by the tokenizer's model alone, as such a word is one piece."""
        ids, counts, tokenize = [], [], self.tokenizer.model.tokenize
        for word in "\n".join(words).translate(self.shown).split("\n") if words else []:
            own = tokenize(word)
            ids += [t.id for t in own]
            counts.append(len(own))
        return np.array(ids, np.uint32), np.array(counts, np.int64)

    def _encoded(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Many in one call, as a text that is cut beforehand, where each is encoded by itself and every id says whose it is."""
        if not chunks:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        ids, counts = [], []
        groups = [chunks[i : i + 200] for i in range(0, len(chunks), 200)]
        for at in range(0, len(groups), 100):
            part = groups[at : at + 100]
            for own, e in zip(part, self.tokenizer.encode_batch(part, is_pretokenized=True, add_special_tokens=False)):
                ids.append(np.array(e.ids, np.uint32))
                counts.append(np.bincount(np.array(e.word_ids, np.int64), minlength=len(own)))
        return np.concatenate(ids), np.concatenate(counts)


def id_rows(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Rows of ids as binary values, little-endian unsigned 32-bit."""
    raw = np.ascontiguousarray(ids, "<u4")
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(raw)])


@lru_cache(maxsize=4)
def from_file(path: str) -> Encoder:
    """The encoder of a tokenizer file, one for each worker process."""
    return Encoder(tokenizers.Tokenizer.from_file(path))


@lru_cache(maxsize=4)
def from_maker(maker: Callable[[str], tokenizers.Tokenizer], path: str) -> Encoder:
    return Encoder(maker(path))

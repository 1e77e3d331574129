import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

public = pytest.importorskip("public_tokenizers")

from gustline.llm import alignment  # noqa: E402

A, B = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def plain(texts):
    """Groups and links of whole texts, by the libraries' own calls and one byte after another."""
    a, b = tokenizers.Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    bytes_of = {c: i for i, c in enumerate(alignment.encode.byte_characters())}
    out = []
    for text in texts:
        if not text:
            out.append(([], [], [], []))
            continue
        left, right = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        left_bytes = [bytes(bytes_of[c] for c in a.id_to_token(i)) for i in left]
        pieces = [b.id_to_piece(i) for i in right]
        right_bytes = [bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode() for p in pieces]
        if b"".join(left_bytes) != (" " + text).encode() or b"".join(right_bytes) != (" " + text).encode():
            out.append(([], [], [], []))
            continue
        at_a = [k for k, x in enumerate(left_bytes) for _ in x]
        at_b = [k for k, x in enumerate(right_bytes) for _ in x]
        links = dict.fromkeys(zip(at_a, at_b))
        groups, i, j = [], 0, 0
        for p in range(1, len(at_a) + 1):
            if p == len(at_a) or (at_a[p] != at_a[p - 1] and at_b[p] != at_b[p - 1]):
                groups.append(",".join(map(str, left[i : at_a[p - 1] + 1])) + "|" + ",".join(map(str, right[j : at_b[p - 1] + 1])))
                i, j = at_a[p - 1] + 1, at_b[p - 1] + 1
        out.append((left, right, groups, [(left[x], right[y]) for x, y in links]))
    return out


def brute(rows):
    found = plain([t for _, t in rows])
    count = Counter(pair for *_, links in found for pair in {*links})
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for (i, _), (left, right, groups, links) in zip(rows, found):
        name = hashlib.sha256(";".join(groups).encode()).hexdigest() if left else ""
        out.append((i, len(left), len(right), len(groups), len(links), sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links), name))
    return sorted(out, key=repr)


def got(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "a.b": F.lit(2)}).repartition(parts)
    return sorted(map(tuple, alignment.align_documents(df, A, B).select(COLUMNS).collect()), key=repr)


ALPHABET = list("aab   \n\t-=_.,▁é 　 'st1234\U0001f600漢字́ \r\nQ") + ["The ", " and", "tion", "çà.", "<s>", "</s>", "<0x0A>", "<|endoftext|>", "<unk>"]


def fuzz(n, seed=0, odd=True):
    rng = random.Random(seed)
    signs = ALPHABET if odd else [c for c in ALPHABET if "▁" not in c]
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(n)] + [c * k for c in "a \né-" for k in (1, 2, 3, 40)]


def test_chunks_give_what_whole_texts_give():
    own = alignment.Aligner(A, B)
    assert own.cuts
    texts = fuzz(1500) + fuzz(1500, 1, odd=False)
    counts, groups, doc, pairs, times = own.align(pa.array(texts))
    links = defaultdict(Counter)
    for d, p, n in zip(doc.tolist(), pairs.tolist(), times.tolist()):
        links[d][p >> 32, p & 0xFFFFFFFF] += n
    for k, (left, right, parts, own_links) in enumerate(plain(texts)):
        assert counts[k].tolist() == [len(left), len(right), len(parts), len(own_links)], texts[k]
        assert groups[k] == (hashlib.sha256(";".join(parts).encode()).hexdigest() if left else "")
        assert links[k] == Counter(own_links)


def test_documents_against_whole_texts(monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 3000)
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).combine_chunks()
    texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
    own = alignment.Aligner(A, B)
    parts = [own.align(texts.slice(i, 100)) for i in range(0, len(texts), 100)]
    want = plain(texts.to_pylist())
    assert np.concatenate([p[0] for p in parts]).tolist() == [[len(a), len(b), len(g), len(x)] for a, b, g, x in want]
    assert [g for p in parts for g in p[1]] == [hashlib.sha256(";".join(g).encode()).hexdigest() if a else "" for a, _, g, _ in want]
    assert len(own.known) < 20_000


def test_rows_against_brute_force(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(fuzz(60, 5, odd=False))] + [(1, None), (2, ""), (None, "One two"), (None, "One two"), (3, "One two"), (3, "▁ gone"), (4, "One two " * 30)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []


def test_small_blocks_give_the_same(monkeypatch):
    """The two Arrow functions with bounds that flush often, joined by hand."""
    for name, value in (("GATHERED", 50), ("BLOCK", 7), ("SUMMED", 10)):
        monkeypatch.setattr(alignment, name, value)
    monkeypatch.setattr(alignment.TaskContext, "get", staticmethod(lambda: type("T", (), {"partitionId": lambda self: 3})()))
    rows = [(i, t) for i, t in enumerate(fuzz(80, 7, odd=False))]
    batches = pa.table({"id": [i for i, _ in rows], "text": [t for _, t in rows]}).to_batches(max_chunksize=30)
    first = pa.Table.from_batches(alignment._first(A, B)(batches)).to_pylist()
    docs, postings = [r for r in first if r["row"] is not None], [r for r in first if r["a"] is not None]
    assert max(r["n_docs"] for r in postings) <= 7
    count, most = Counter(), defaultdict(int)
    for r in postings:
        count[r["a"], r["b"]] += r["n_docs"]
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    met = [{**{c: r[c] for c in ("base", "n_docs", "places", "times")}, "count": count[r["a"], r["b"]], "best": int(count[r["a"], r["b"]] == most[r["a"]])} for r in postings]
    sums = defaultdict(lambda: [0, 0])
    for b in alignment._contributions(pa.Table.from_pylist(met).to_batches(max_chunksize=13)):
        for r in b.to_pylist():
            sums[r["row"]][0] += r["n_best"]
            sums[r["row"]][1] += r["count_sum"]
    assert sorted([(r["id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], *sums[r["row"]], r["groups"]) for r in docs], key=repr) == brute(rows)


def test_long_texts():
    own = alignment.Aligner(A, B)
    texts = ["word " * 1_000_000, "x" * 100_000, "a b"]
    counts, _, doc, _, times = own.align(pa.array(texts))
    assert counts[0].tolist() == [1_000_001, 1_000_001, 1_000_001, 1_000_001] and times[doc == 0].sum() == 1_000_001
    assert counts[2].tolist() == [2, 2, 2, 2]

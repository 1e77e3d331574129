import bisect
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
import tokenizers

public = pytest.importorskip("public_tokenizers")

from gustline.llm import bytebpe, encode, packing, tokencounts, tokenfiles  # noqa: E402

BYTE, WORD, RANKS = (public.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_50k.tiktoken"))
ALPHABET = list("aab  \n\t-=_.!,é \u3000\x1c\x85'st1234😀漢字ßΣ\u0301 \r\nQ") + ["The ", "çà.", "\nÜn ", "<|endoftext|>"]
ROWS = [(4, "One two.\nThree é😀"), (2, ""), (3, None), (1, "word " * 9000 + "!"), (None, "lost"), (9, "\n\n a \u00a0 b"), (9, "\n\n a \u00a0 b"), (10, "<|endoftext|>")]


def fuzz(n=1500, seed=0):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 50))) for _ in range(n)] + [c * n for c in "-=.a\n é" for n in (1, 2, 3, 5, 40, 90)]


def whole(path, texts):
    t = tokenizers.Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, b"x") for i, t in rows], "doc_id long, text string, ids binary")


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_chunks_give_what_whole_texts_give(path):
    texts = fuzz()
    assert encode.from_file(path).encode(texts) == whole(path, texts)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_all_documents_give_what_whole_texts_give(name, monkeypatch):
    path = public.path(name)
    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column(0).combine_chunks()
    texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
    own = bytebpe.encoder(path)
    got = [own.encode_column(texts.slice(i, 700)) for i in range(0, len(texts), 700)]
    monkeypatch.setenv("TOKENIZERS_PARALLELISM", "true")
    plain = texts.fill_null("").to_pylist()
    want = own.tokenizer.encode_batch_fast(plain, add_special_tokens=False)
    assert np.array_equal(np.concatenate([ids for ids, _ in got]), np.concatenate([np.array(e.ids, np.uint32) for e in want]))
    assert np.concatenate([np.diff(ends) for _, ends in got]).tolist() == [len(e.ids) for e in want]
    if name.endswith(".tiktoken"):
        reference = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bytebpe.read_ranks(path), special_tokens={})
        assert [len(e.ids) for e in want] == [len(x) for x in reference.encode_ordinary_batch(plain)]
        assert np.array_equal(np.concatenate([ids for ids, _ in got]), np.concatenate([np.array(x, np.uint32) for x in reference.encode_ordinary_batch(plain)]))


def test_memory_is_bounded_without_changing_results(monkeypatch):
    monkeypatch.setattr(encode, "REMEMBERED", 5)
    own = encode.Encoder(tokenizers.Tokenizer.from_file(BYTE))
    texts = fuzz(100)
    assert [own.encode([t])[0] for t in texts] == whole(BYTE, texts)
    assert len(own.known) <= 60


def test_ranks_give_what_tiktoken_gives():
    reference = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bytebpe.read_ranks(RANKS), special_tokens={})
    texts = fuzz(seed=1)
    ids = bytebpe.encoder(RANKS).encode(texts)
    assert ids == [np.array(reference.encode_ordinary(t), "<u4").tobytes() for t in texts]
    table = bytebpe.token_bytes(RANKS)
    assert [b"".join(table[i] for i in np.frombuffer(x, "<u4")).decode() for x in ids] == texts


def test_round_trip_on_spark(spark):
    tokens = bytebpe.encode_documents(frame(spark), RANKS)
    out = bytebpe.decode_documents(tokens, RANKS).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded).decode()) for r in out) == sorted((str(i), t or "") for i, t in ROWS)
    assert all(r.n_tokens * 4 == len(r.ids) for r in out)
    assert bytebpe.encode_documents(frame(spark, []), RANKS).count() == 0
    assert bytebpe.as_text("é".encode()[:1]) == "\ufffd"


def test_character_starts():
    text = "aé😀b"
    assert bytebpe.character_starts(text.encode(), np.array([1, 1, 1, 2, 2, 1])).tolist() == [0, 1, 1, 2, 2, 3]
    assert bytebpe.character_starts(b"", np.array([], int)).tolist() == []


def test_section_counts_against_offsets(spark):
    t = tokenizers.Tokenizer.from_file(BYTE)
    t.encode_special_tokens = True
    got = tokencounts.section_tokens(frame(spark), BYTE).toPandas()
    for i, text in {(i, x or "") for i, x in ROWS if i is not None and i != 9}:
        starts = tokencounts.line_sections(text)
        want = [0] * len(starts)
        for s, _ in t.encode(text, add_special_tokens=False).offsets:
            want[bisect.bisect_right(starts, s) - 1] += 1
        own = got[got.doc_id == i].sort_values("section")
        assert tokencounts.bytebpe.character_starts(text.encode(), np.array([len(x) for x in map(bytebpe.token_bytes(BYTE).__getitem__, t.encode(text, add_special_tokens=False).ids)], int)).tolist() == [s for s, _ in t.encode(text, add_special_tokens=False).offsets]
        assert own.n_tokens.tolist() == want and own.start.tolist() == starts and own.end.tolist() == [*starts[1:], len(text)]
    assert len(got[got.doc_id == 9]) == 2 * len(tokencounts.line_sections(ROWS[5][1]))


def test_field_counts(spark):
    df = spark.createDataFrame([(1, "a b", None, "c\nd")], "id long, title string, body string, tail string")
    got = {r.field: r.n_tokens for r in tokencounts.field_tokens(df, BYTE, "id", ["title", "body", "tail"]).collect()}
    assert set(got) == {"title", "body", "tail"} and sum(got.values()) == len(whole(BYTE, ["a b\n\nc d\n"])[0]) // 4


def best_total(at, cost, capacity):
    """The least total over all ways to cut, by trying them all."""
    points = [0, *at]
    total = [0] + [None] * len(at)
    for j in range(1, len(points)):
        options = [total[i] for i in range(j) if total[i] is not None and points[j] - points[i] <= capacity]
        total[j] = min(options) + capacity + cost[j - 1] if options else None
    return total


@pytest.mark.parametrize("seed", range(5))
def test_cuts_are_the_best(seed):
    rng = random.Random(seed)
    at = sorted(rng.sample(range(1, 400), 60)) + [400]
    at = sorted({*at, *range(30, 400, 30)})
    cost = [rng.choice([0, 8, 64]) for _ in at]
    cuts = packing.plan_cuts(at, cost, 64)
    total = dict(zip([0, *at], best_total(at, cost, 64)))
    price, before = 0, 0
    for c in cuts:
        assert 0 < c - before <= 64
        price += 64 + cost[at.index(c)]
        before = c
    assert price == total[cuts[-1]]
    assert total[cuts[-1]] - cuts[-1] == min(total[a] - a for a in [0, *at] if a > 400 - 64)


@pytest.mark.parametrize("seed", range(4))
def test_cuts_given_out_early_are_those_of_the_whole_stream(seed):
    rng = random.Random(seed)
    at, cost, here = [], [], 0
    for _ in range(3000):
        here += rng.randint(1, 20)
        at.append(here), cost.append(rng.choice([0, 8, 8, 64]))
    whole_plan, early = packing.plan_cuts(at, cost, 64), packing.Plan(64)
    cuts, given = [], 0
    for i in range(0, 3000, 100):
        early.extend(at[i : i + 100], cost[i : i + 100])
        more = early.settled()
        cuts, given = cuts + more, given + bool(more)
    assert given > 15 and cuts + early.best() == whole_plan


def test_a_plan_that_is_given_out_unsettled_is_nearly_as_good():
    rng = random.Random(9)
    at = sorted(rng.sample(range(1, 60_000), 3000))
    cost = [rng.choice([0, 8, 8]) for _ in at]
    price = dict(zip(at, cost))
    total = lambda cuts: sum(64 + price.get(c, 32) for c in cuts) - cuts[-1]
    plan, cuts = packing.Plan(64, 32), []
    for i in range(0, 3000, 100):
        plan.extend(at[i : i + 100], cost[i : i + 100])
        if plan.at[-1] - plan.at[0] > 2000:
            cuts += plan.commit(1000)
    cuts += plan.best()
    assert np.diff([0, *cuts]).min() > 0 and np.diff([0, *cuts]).max() <= 64
    best = packing.plan_cuts(at, cost, 64, 32)
    assert total(best) <= total(cuts) <= total(best) + 60 * 64


def test_plan_of_real_documents():
    t = tokenizers.Tokenizer.from_file(WORD)
    ends_sentence = np.zeros(t.get_vocab_size(), bool)
    ends_sentence[[i for token, i in t.get_vocab().items() if token.removesuffix("</w>")[-1:] in (".", "!", "?")]] = True
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column(0).fill_null("").to_pylist()[:60]
    docs = [np.frombuffer(x, "<u4") for x in whole(WORD, texts)]
    ends = np.cumsum([len(d) + 1 for d in docs])
    stream = np.concatenate([np.append(d, 2) for d in docs]).astype(np.uint32)
    at, cost = packing.cut_points(stream, ends, ends_sentence)
    assert {*ends.tolist(), *(np.flatnonzero(ends_sentence[stream]) + 1).tolist()} == {*at.tolist()}  # every sentence and document
    cuts = packing.plan_cuts(at.tolist(), cost.tolist(), 512, packing.FORCED_CUT)
    every = np.full(len(stream) + 1, packing.FORCED_CUT)  # by trying a cut behind every id
    every[at] = cost
    total = np.zeros(len(stream) + 1, np.int64)
    for j in range(1, len(total)):
        total[j] = total[max(j - 512, 0) : j].min() + 512 + every[j]
    assert np.diff([0, *cuts]).max() <= 512 and sum(512 + every[c] for c in cuts) == total[cuts[-1]]
    last = np.arange(len(stream) - 511, len(stream) + 1)
    assert total[cuts[-1]] - cuts[-1] <= (total[last] - last)[every[last] < packing.FORCED_CUT].min()
    rare = packing.plan_cuts([5000], [0], 512, 64)  # nothing but the end is a good place
    assert rare == [512 * k for k in range(1, 10)]


def check_packing(pieces, ids_of, capacity):
    seen = {}
    for p in pieces.sort_values(["doc_id", "start"], na_position="first").itertuples():
        seen.setdefault(p.doc_id, b"")
        seen[p.doc_id] += bytes(p.ids)
        assert len(p.ids) == 4 * p.length
    assert seen == ids_of
    for _, s in pieces.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == (s.length.cumsum() - s.length).tolist() and s.length.sum() <= capacity


def test_packing_odd_rows(spark):
    rows = [r for r in ROWS if r[0] not in (9, None)] + [(7, "Sentence one. " * 2000), (8, "nostop " * 5000)]
    pieces = packing.pack_documents(frame(spark, rows), WORD).toPandas()
    end = np.array([2], "<u4").tobytes()
    check_packing(pieces, {i: x + end for (i, _), x in zip(rows, whole(WORD, [t or "" for _, t in rows]))}, 4096)
    repeated = packing.pack_documents(frame(spark), WORD).toPandas()
    assert repeated[repeated.doc_id == 9].doc_tokens.tolist() == [repeated[repeated.doc_id == 9].doc_tokens.iloc[0]] * 2
    assert repeated.doc_id.isna().sum() == 1
    assert packing.pack_documents(frame(spark, []), WORD).count() == 0


def test_packing_of_a_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs, pieces = df.toPandas(), packing.pack_documents(df, WORD).toPandas()
    end = np.array([2], "<u4").tobytes()
    check_packing(pieces, {i: x + end for i, x in zip(docs.doc_id, whole(WORD, docs.text.tolist()))}, 4096)
    size = pieces.groupby("sequence_id").length.sum()
    padding = sum(0 if n & (n - 1) == 0 else 4096 - n for n in size)
    assert padding < 0.005 * size.sum()


def test_token_files(spark):
    rows = [r for r in ROWS if r[0] != 9]
    got = tokenfiles.token_files(spark, frame(spark, rows), BYTE).toPandas()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    end, at = np.array([2], "<u4").tobytes(), 0
    for (i, _), x in zip(order, whole(BYTE, [t or "" for _, t in order])):
        row = got[got.doc_id.isna() if i is None else got.doc_id == i].iloc[0]
        assert (row.start, row.n_tokens, zlib.crc32(bytes(row.ids))) == (at, len(x + end) // 4, zlib.crc32(x + end))
        at += len(x + end) // 4
    assert len(got) == len(rows)
    assert tokenfiles.token_files(spark, frame(spark, []), BYTE).count() == 0
    with pytest.raises(ValueError):
        tokenfiles._local("hdfs://somewhere/x")


@pytest.mark.parametrize("texts", [["word " * 1_500_000], ["x" * 6_000_000], [*["A short one. "] * 50, "word " * 1_500_000, *["Another. "] * 5], ["word " * 1_200_000, "", "a"]], ids=["words", "one word", "between", "first"])
def test_packing_of_texts_longer_than_the_horizon(texts):
    own = encode.from_file(WORD)
    ends_sentence = np.zeros(49408, bool)
    ends_sentence[own.encode_column(pa.array(["."]))[0]] = True
    packer, pieces, wanted = packing.Packer(4096, ends_sentence, 0), [], {}
    for i, t in enumerate(texts):
        ids, ends = own.encode_column(pa.array([t]), 2)
        wanted[i] = ids.astype("<u4").tobytes()
        pieces += packer.add([i], ids, ends[1:])
        assert len(packer.ids) <= packing.HORIZON + len(ids)
    pieces += packer.finish()
    check_packing(pa.Table.from_batches(pieces).to_pandas().rename(columns={"id": "doc_id"}), wanted, 4096)

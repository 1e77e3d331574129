"""Offsets in characters: the characters that a token's bytes touch, also where a character is split between tokens."""

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from gustline.llm import bytebpe, queries  # noqa: E402


def test_offsets_cover_what_each_token_touches(spark):
    path = queries.vocabulary("byte_bpe_50k.tiktoken")
    texts = ["plain words, 12 of them", "São Tomé \u2603\U0001f9ea\U00013080 ok", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = bytebpe.token_bytes(path)
    split = 0
    for r in bytebpe.encode_documents(docs, path, offsets=True).collect():
        text, at = texts[r.doc_id] or "", 0
        owner = [k for k, c in enumerate(text) for _ in c.encode()]
        assert r.n_tokens == len(r.starts) == len(r.ends)
        for i, start, end in zip(np.frombuffer(r.ids, "<u4"), r.starts, r.ends):
            n = len(table[i])
            assert (start, end) == (owner[at], owner[at + n - 1] + 1)
            split += at + n < len(owner) and owner[at + n] == owner[at + n - 1]
            at += n
        assert at == len(owner)
    assert split

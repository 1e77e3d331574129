"""The SimHash stage over null, repeated and shared ids: one row of each class stays, and no other text goes."""

import pytest

import corpus_pipeline

A = "the quick brown fox jumps over the lazy dog and runs far away from here"
B = "completely different words stand in this other sentence about rivers and mountains"


def left(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return sorted((tuple(r) for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()), key=repr)


def row(doc_id, text, source="s"):
    return doc_id, text, "en", source, len(text or "")


@pytest.mark.parametrize(
    "rows, want",
    [
        ([row(None, A), row(None, A, "t"), row(None, A)], 1),  # copies with a null id
        ([row(None, A), row(4, A)], [row(4, A)]),  # a known id goes before a null one
        ([row(1, A), row(1, A), row(1, A)], [row(1, A)]),  # repeated rows of the kept id
        ([row(1, A), row(1, A, "t")], 1),  # the same id and text, other columns
        ([row(1, A), row(2, A), row(2, B)], [row(1, A), row(2, B)]),  # an id shared by a dropped copy and another text
        ([row(1, A, None), row(2, B), row(3, None), row(4, "")], [row(1, A, None), row(2, B), row(3, None)]),
    ],
)
def test_one_row_of_each_class(spark, rows, want):
    got = left(spark, rows)
    assert len(got) == want if isinstance(want, int) else got == sorted(want, key=repr)

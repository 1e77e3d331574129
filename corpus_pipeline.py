"""From documents to packed sequences: quality, near-duplicates, repeated passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gustline.llm import quality, queries, simhash, substring
from gustline.llm.common import cut, modest_batches, stored


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level network, trained on ``labels``, gives 0.5 or more."""
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash class one row: the smallest id (null ids last), of equal ids the smallest hash of the text, then of all columns.

    Classes are found over texts, which are known by two hashes (128 bits), so ids that are null, repeated or shared by different texts neither keep a copy nor lose a text.
    The table's own columns travel in one struct, whatever their names.
    """
    twice = lambda *c: (F.xxhash64(*c), F.xxhash64(F.lit(1), *c))
    text = F.coalesce("text", F.lit(""))
    (t1, t2), (r1, r2) = twice(text), twice(*(x for c in docs.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())))
    tagged = docs.select(t1.alias("t1"), t2.alias("t2"), r1.alias("r1"), r2.alias("r2"), F.col("doc_id"), text.alias("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    modest_batches(docs)
    fps = cut(simhash.fingerprints(tagged.select("t1", "t2", "text")).distinct())
    classes = stored(simhash.fingerprint_classes(fps.select("fp").distinct()), "classes")
    # the best row of each text, then of each class: aggregates only, so a class with very many rows is no one task's load
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "t1", "t2", "r1", "r2")
    best = stored(tagged.groupBy("t1", "t2").agg(F.min(order).alias("best")).join(fps, ["t1", "t2"]).select("fp", "best"), "best")
    winners = best.join(classes, "fp").groupBy("label").agg(F.min("best").alias("best")).select(*(f"best.{c}" for c in ("t1", "t2", "r1", "r2")))
    return tagged.dropDuplicates(["t1", "t2", "r1", "r2"]).join(winners, ["t1", "t2", "r1", "r2"], "left_semi").select("row.*")


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a document with a smaller id has go, all other bytes stay; n_chars is counted anew (null where the text is null)."""
    out = substring.substring_dedup(docs, carry=[c for c in docs.columns if c not in ("doc_id", "text", "n_chars")])
    fresh = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("long").alias("n_chars")}
    return out.select(*(fresh.get(c, F.col("rest")[c].alias(c)) for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens."""
    return queries.packed(docs)


STAGES = [("quality", good_quality), ("simhash", one_of_each_group), ("substring", without_repeats), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each is written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express the classifier, the fingerprints or the tokenizer; tests hold the pipeline against brute force.
ORACLE_SQL = None

"""Benchmark decontamination: a prefix-filtered join of item windows and documents, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gustline.llm.common import cut, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words once A-Z are lower-cased, and in the text as it is.
BETWEEN, BETWEEN_AS_IS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Most bytes of windows that one pass over the documents broadcasts; a larger benchmark takes more passes.
PASS_BYTES = 32 << 20


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased. An empty string stands before or behind them where the text doesn't begin or end with a word."""
    return F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN)


def n_words(text: Column) -> Column:
    parts = F.split(F.coalesce(text, F.lit("")), BETWEEN_AS_IS)
    blank = lambda at: (F.element_at(parts, at) == "").cast("long")
    return F.greatest(F.size(parts) - blank(1) - blank(-1), F.lit(0)).cast("long")


def _gram(words: Column, at: Column, size: int) -> Column:
    """The name of the words at, at + 1, ...; one that reaches over the end meets nothing, as its size is part of the name."""
    return F.xxhash64(F.lit(size), *(F.get(words, at + j) for j in range(size)))


def item_windows(items: DataFrame, item_col: str, text_col: str, window: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (words, len, s1, s2) and who has them (s1, s2, item): windows of the same items share one name of 128 bits."""
    own = items.select(F.col(f"`{item_col}`").alias("item"), F.filter(words_of(F.col(f"`{text_col}`")), lambda w: w != "").alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(window))
    each = own.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.slice("w", i, size))).alias("words")).distinct()
    named = each.withColumns({"a": F.xxhash64(F.lit(1), "item"), "b": F.xxhash64(F.lit(2), "item")})
    windows = cut(named.groupBy("words").agg(F.bit_xor("a").alias("s1"), F.bit_xor(F.xxhash64("b", F.lit(3))).alias("s2")).withColumn("len", F.size("words")))
    return windows, cut(each.join(windows, "words").select("s1", "s2", "item").distinct())


def in_passes(table: DataFrame, name: Column, size: Column) -> list[DataFrame]:
    """Parts of a table, dealt by ``name``, each shown by a sum over ``size`` to hold no more than PASS_BYTES (or else a single row), marked for broadcast."""
    parts = 1
    while True:
        dealt = table.withColumn("_part", F.pmod(name, F.lit(parts)) if parts > 1 else F.lit(0))
        sizes = dealt.groupBy("_part").agg(F.sum(size).alias("bytes"), F.count("*").alias("rows")).agg(F.max(F.when(F.col("rows") > 1, F.col("bytes"))).alias("most"), F.sum("bytes").alias("all")).first()
        if (sizes.most or 0) <= PASS_BYTES:
            return [F.broadcast(dealt.where(F.col("_part") == k).drop("_part")) for k in range(parts)]
        parts = max(2 * parts, 2 * sizes.all // PASS_BYTES)


def _places(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """A row for each word of each document and each size of shingle: pos, and the shingle's name ``gram``. ``words`` is passed on by reference inside the stage, and no exchange may carry it."""
    spread = docs.select("id", "t1", "t2", words_of(F.col("text")).alias("words")).select("id", "t1", "t2", "words", F.posexplode_outer("words").alias("pos", "word"))
    grams = [_gram(F.col("words"), F.col("pos"), k) for k in sizes]
    if len(grams) == 1:
        return spread.withColumn("gram", grams[0])
    return spread.withColumn("gram", F.explode(F.array(*grams)))


def window_hits(docs: DataFrame, windows: DataFrame, gram: int) -> DataFrame:
    """(id, t1, t2, start, len, s1, s2): every occurrence of every window.

    Shingles of ``gram`` words (all words of a shorter window) are ordered by how often they occur in all documents. A window occurs whole or not at all, so its prefix is one
    shingle, its rarest, and windows whose rarest shingle occurs nowhere are gone at once. Where a prefix shingle occurs, its place in the window
    says where that would begin and end, both must lie in the document, and then all words are compared.
    """
    size = F.least(F.col("len"), F.lit(gram))
    lengths = sorted(r[0] for r in windows.select(size).distinct().collect())  # at most ``gram`` numbers
    if not lengths:
        lengths = [gram]
    shingle = F.coalesce(*(F.when(size == k, _gram(F.col("words"), F.col("off"), k)) for k in lengths))
    shingles = windows.select("*", F.explode(F.sequence(F.lit(0), F.col("len") - size)).alias("off")).withColumn("gram", shingle)
    seen = None
    for part in in_passes(shingles.select("gram").distinct(), F.col("gram"), F.lit(64)):
        found = _places(docs, lengths).join(part, "gram").groupBy("gram").count()
        seen = found if seen is None else seen.unionByName(found)
    rarest = shingles.join(cut(seen), "gram", "left").groupBy("words", "len", "s1", "s2").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "gram", "off")).alias("x"))
    prefixes = cut(rarest.where("x.count > 0").select(F.col("words").alias("window"), "len", "s1", "s2", "x.gram", "x.off"))
    begin = F.col("pos") - F.col("off")
    fits = (begin >= 0) & (begin + F.col("len") <= F.size("words"))
    same = F.slice("words", F.when(fits, begin + 1).otherwise(1), F.col("len")) == F.col("window")
    hits = None
    for part in in_passes(prefixes, F.col("gram"), F.length(F.concat_ws(" ", "window")) + 8 * F.col("len") + 128):
        places = _places(docs, lengths).alias("p")
        found = places.join(part.alias("q"), (F.col("p.gram") == F.col("q.gram")) & fits & same).select("id", "t1", "t2", begin.alias("start"), "len", "s1", "s2")
        hits = found if hits is None else hits.unionByName(found)
    return hits


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, gram: int = 3) -> DataFrame:
    """Documents -> (id, n_words, n_hit, n_items, items, contaminated): the words that lie in an occurrence of ``window`` consecutive words of an item, and those items.

    An item of fewer words is one window, one without words none. ``items`` holds the distinct item ids as sorted strings; items without an id count as one, which the list leaves out.
    Windows that several items share, and repeated items, are compared once. A row is known by its id and two hashes of its text, so rows that share an id keep
    their own results and equal rows get equal ones; null texts have no words; an empty table of either kind gives no hit; other columns are ignored.
    Documents are read twice more than the result needs (for the counts of shingles, then for hits) and their texts are never shuffled. Each pass broadcasts
    at most PASS_BYTES of windows; a larger benchmark takes several.
    """
    if window < 1 or gram < 1:
        raise ValueError("window and gram must be positive")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), text.alias("text"))
    windows, owners = item_windows(items, item_col, item_text_col, window)
    hits = stored(window_hits(rows, windows, gram), "windows")
    key = ["id", "t1", "t2"]
    before = Window.partitionBy(*key).orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("len")
    fresh = end - F.greatest(F.col("start"), F.least(end, F.coalesce(F.max(end).over(before), F.col("start"))))
    covered = hits.select(*key, "start", "len").distinct().select(*key, fresh.alias("n")).groupBy(*key).agg(F.sum("n").cast("long").alias("n_hit"))
    who = hits.select(*key, "s1", "s2").distinct().join(owners, ["s1", "s2"]).select(*key, "item").distinct()
    named = who.groupBy(*key).agg(F.count("*").alias("n_items"), F.sort_array(F.collect_list(F.col("item").cast("string"))).alias("items"))
    same_row = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["t1"] == b["t1"]) & (a["t2"] == b["t2"])
    found = covered.join(named, same_row(covered, named)).select(covered["id"], covered["t1"], covered["t2"], "n_hit", "n_items", "items")
    counted = rows.select(*key, n_words(F.col("text")).alias("n_words"))
    zero = F.lit(0).cast("long")
    return counted.join(found, same_row(counted, found), "left").select(
        counted["id"].alias(id_col), "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), (F.coalesce("n_hit", zero) > 0).alias("contaminated"),
    )

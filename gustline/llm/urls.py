"""URL filter: host and path rules, and for the rest a ratio of two character language models. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gustline.llm.common import cut

#: (verdict, host with its subdomains, what the path starts with)
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: Characters of a context and the one behind it; probability of a character that no model knows; bins of a unit of the normalised score.
ORDER, UNSEEN, BINS = 4, 1 / 256, 200
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``, ``#`` or the end. Null or without ``://``: empty."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else null; of rules of one length the first in order wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, name + start).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _characters(url: Column) -> Column:
    """The URL's characters between ORDER - 1 start marks and an end mark."""
    return F.concat(F.array_repeat(F.lit("\u0002"), ORDER - 1), F.regexp_extract_all(url, F.lit("(?s)."), 0), F.array(F.lit("\u0003")))


def _grams(chars: str) -> Column:
    """Of each character and the end: it and the ORDER - 1 characters before it. ``chars`` names a column, as a lambda would split the URL anew for every gram."""
    return F.transform(F.sequence(F.lit(1), F.size(chars) - ORDER + 1), lambda i: F.array_join(F.slice(chars, i, ORDER), ""))


def gram_ratios(grams: DataFrame) -> DataFrame:
    """(gram, yes, no) counts of accepted and rejected URLs -> (gram, ratio): log-likelihood of the last character under one model less that under the other.

    Each model interpolates orders by Witten and Bell: P(c | context) = (n(context c) + u(context) P(c | shorter context)) / (n(context) + u(context)), where u
    counts the characters seen behind a context; a context that was never seen gives way to the shorter one.
    """
    levels = {ORDER: grams.withColumnRenamed("gram", "g")}
    for k in range(ORDER - 1, 0, -1):
        longer = levels[k + 1]
        levels[k] = longer.groupBy(F.substring("g", 2, k).alias("g")).agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    below = None
    for k in range(1, ORDER + 1):
        level = levels[k].withColumn("context", F.substring("g", 1, k - 1)).withColumn("tail", F.substring("g", 2, k - 1))
        seen = level.groupBy("context").agg(*(f(c).alias(f"{n}_{c}") for c in ("yes", "no") for n, f in (("n", lambda c: F.sum(c)), ("u", lambda c: F.sum((F.col(c) > 0).cast("long"))))))
        level = level.join(seen, "context")
        if below is None:
            level = level.withColumns({f"p_{c}": F.lit(UNSEEN) for c in ("yes", "no")})
        else:
            level = level.join(below, "tail")
        new = {f"q_{c}": F.when(F.col(f"n_{c}") > 0, (F.col(c) + F.col(f"u_{c}") * F.col(f"p_{c}")) / (F.col(f"n_{c}") + F.col(f"u_{c}"))).otherwise(F.col(f"p_{c}")) for c in ("yes", "no")}
        level = level.withColumns(new)
        below = level.select(F.col("g").alias("tail"), F.col("q_yes").alias("p_yes"), F.col("q_no").alias("p_no"))
    return below.select(F.col("tail").alias("gram"), (F.log("p_yes") - F.log("p_no")).alias("ratio"))


def fold_of(url: Column) -> Column:
    """0 or 1: the half that a URL belongs to when the threshold is calibrated."""
    return F.pmod(F.xxhash64(url, F.lit(7)), F.lit(2))


def score_urls(urls: DataFrame) -> DataFrame:
    """(url, weight, verdict or null) of distinct URLs -> (url, verdict, weight, score, held_score): length-normalised log-likelihood ratios, the first by the
    models of all URLs with a verdict, the second by the models of those of the other half, which haven't seen the URL."""
    n = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    split = urls.select(F.xxhash64("url").alias("k1"), F.xxhash64("url", F.lit(1)).alias("k2"), fold_of(F.col("url")).alias("fold"), "weight", "verdict", _characters(F.col("url")).alias("chars"))
    split = split.repartition(n, "k1")  # a URL is small and its grams are many, so AQE must not put many URLs into one task
    tokens = split.select("k1", "k2", "fold", "weight", "verdict", F.explode(_grams("chars")).alias("gram"))
    of = lambda what, fold: F.sum(F.when((F.col("verdict") == what) & (F.col("fold") == fold), F.col("weight")).otherwise(F.lit(0)))
    counts = cut(tokens.groupBy("gram").agg(*(of(what, fold).alias(f"{name}{fold}") for what, name in (("allow", "yes"), ("block", "no")) for fold in (0, 1))))
    every = lambda c: F.col(f"{c}0") + F.col(f"{c}1")
    ratios = gram_ratios(counts.select("gram", every("yes").alias("yes"), every("no").alias("no")))
    for fold in (0, 1):
        other = gram_ratios(counts.select("gram", F.col(f"yes{1 - fold}").alias("yes"), F.col(f"no{1 - fold}").alias("no")))
        ratios = ratios.join(other.withColumnRenamed("ratio", f"ratio{fold}"), "gram")
    held = F.when(F.col("fold") == 0, F.col("ratio0")).otherwise(F.col("ratio1"))
    sums = tokens.select("k1", "k2", "fold", "gram").join(cut(ratios), "gram").groupBy("k1", "k2").agg(F.round(F.avg("ratio"), 9).alias("score"), F.round(F.avg(held), 9).alias("held_score"))
    named = urls.select("url", "weight", "verdict", F.xxhash64("url").alias("k1"), F.xxhash64("url", F.lit(1)).alias("k2"))
    return named.join(sums, ["k1", "k2"]).select("url", "weight", "verdict", "score", "held_score")


def calibrated_threshold(scored: DataFrame) -> float:
    """The score from which URLs are accepted: where the share of accepted URLs at or above it less that of rejected ones is greatest, by scores of
    models that haven't seen the URL.

    Scores are counted in bins (so at most a few thousand rows are ordered); of equal bins the one nearest to zero wins. Without both kinds of URLs it is zero.
    """
    known = scored.where("verdict IS NOT NULL").withColumn("bin", F.floor(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), "held_score")) * BINS))
    sums = known.groupBy("bin").agg(*(F.sum(F.when(F.col("verdict") == v, F.col("weight")).otherwise(F.lit(0))).alias(v) for v in ("allow", "block")))
    above = Window.orderBy(F.desc("bin"))
    whole = Window.partitionBy(F.lit(0))
    gain = F.sum("allow").over(above) / F.nullif(F.sum("allow").over(whole), F.lit(0)) - F.sum("block").over(above) / F.nullif(F.sum("block").over(whole), F.lit(0))
    best = sums.withColumn("gain", F.round(gain, 12)).where("gain IS NOT NULL").orderBy(F.desc("gain"), F.abs("bin")).select("bin").first()
    return best[0] / BINS if best else 0.0


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """Pages -> (id, host, path, rule, verdict, score): the verdict of the longest rule that fits, else that of the language models.

    URLs under a rule are what the two models learn from, and what calibrates the threshold, each half by models of the other; every page counts. Copies of a URL
    are scored once. A null URL is scored like an empty one; null ids and repeated rows stay; an empty table gives an empty table; other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{url_col}`"), F.lit("")).alias("url"))
    urls = rows.groupBy("url").agg(F.count("*").alias("weight")).withColumn("host", host).withColumn("path", path)
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    scored = cut(score_urls(urls.select("url", "weight", verdict.alias("verdict"))))
    threshold = calibrated_threshold(scored)
    own = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    joined = rows.join(scored.select("url", "score"), "url").withColumn("host", host).withColumn("path", path)
    return joined.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "score")

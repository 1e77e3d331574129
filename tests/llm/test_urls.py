import math
from collections import Counter

from gustline.llm import urls

RULES = urls.RULES


def host_path(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n])
    path = rest[n:]
    return host, path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def rule_of(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def brute(pages, learn_from=lambda url: True):
    """Rules, and two Witten-Bell models by the definition, in plain Python."""
    counts = {"allow": Counter(), "block": Counter()}
    parsed = []
    for i, url in pages:
        host, path = host_path(url)
        rule, verdict = rule_of(host, path)
        parsed.append((i, url or "", host, path, rule, verdict))
        if verdict and learn_from(url or ""):
            s = "\x02" * 3 + (url or "") + "\x03"
            counts[verdict].update(s[k - 3 : k + 1] for k in range(3, len(s)))
    tables = {}
    for v, c in counts.items():
        levels = {4: c}
        for k in (3, 2, 1):
            levels[k] = Counter()
            for g, n in levels[k + 1].items():
                levels[k][g[1:]] += n
        contexts = {k: (Counter(), Counter()) for k in levels}
        for k, level in levels.items():
            for g, n in level.items():
                contexts[k][0][g[:-1]] += n
                contexts[k][1][g[:-1]] += 1
        tables[v] = levels, contexts

    def p(v, g):
        levels, contexts = tables[v]
        if not g:
            return urls.UNSEEN
        n, u = contexts[len(g)][0][g[:-1]], contexts[len(g)][1][g[:-1]]
        lower = p(v, g[1:])
        return (levels[len(g)][g] + u * lower) / (n + u) if n else lower

    out = {}
    for i, url, host, path, rule, verdict in parsed:
        s = "\x02" * 3 + url + "\x03"
        grams = [s[k - 3 : k + 1] for k in range(3, len(s))]
        out[i] = host, path, rule, verdict, sum(math.log(p("allow", g)) - math.log(p("block", g)) for g in grams) / len(grams)
    return out


def test_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    extra = [(-1, None), (-2, ""), (-3, "no scheme"), (-4, "HTTPS://WWW.Example.COM/en/7?q#f"), (-5, "x://a.net?/de/1"), (-6, "http://example.net/de/8"), (-7, "ftp://notexample.com/en/7"), (-8, "a://b://net/de/"), (-9, "http://é.org/es/" + "x" * 30_000), (-10, "http://com/en/\n1"), (-11, "http://É.NET:80/de/")]
    pages = [(r.page_id, r.url) for r in df.collect()] + extra
    table = spark.createDataFrame([(i, u, "h") for i, u in pages], "page_id long, url string, host string")
    got = {r.page_id: r for r in urls.filter_urls(table).collect()}
    want = brute(pages)
    assert len(got) == len(pages)
    for i, (host, path, rule, verdict, score) in want.items():
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule), i
        assert verdict is None or r.verdict == verdict
        assert abs(r.score - score) < 1e-6
    folds = {r.url: r.fold for r in table.selectExpr("coalesce(url, '') AS url").distinct().select("url", urls.fold_of(urls.F.col("url")).alias("fold")).collect()}
    text = {i: u or "" for i, u in pages}
    held = {}
    for fold in (0, 1):
        held.update({i: x[4] for i, x in brute(pages, lambda u: folds[u] != fold).items() if folds[text[i]] == fold})
    known = [(math.floor(round(held[i], 9) * urls.BINS), want[i][3]) for i in want if want[i][3]]
    n = Counter(v for _, v in known)
    gain = {b: sum(1 for x, v in known if v == "allow" and x >= b) / n["allow"] - sum(1 for x, v in known if v == "block" and x >= b) / n["block"] for b in {x for x, _ in known}}
    threshold = min(gain, key=lambda b: (-round(gain[b], 12), abs(b))) / urls.BINS
    for i, x in want.items():
        if x[3] is None and abs(x[4] - threshold) > 1e-6:
            assert got[i].verdict == ("allow" if x[4] >= threshold else "block")
    free = [(r.score, r.verdict) for r in got.values() if r.rule is None]
    assert max((s for s, v in free if v == "block"), default=-99) < min((s for s, v in free if v == "allow"), default=99)


def test_the_models_tell_labelled_urls_apart(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    rows = urls.filter_urls(df).where("rule IS NOT NULL").toPandas()
    assert rows[rows.verdict == "allow"].score.mean() > rows[rows.verdict == "block"].score.mean()


def test_without_labels_repeats_and_empty(spark):
    schema = "page_id long, url string"
    rows = urls.filter_urls(spark.createDataFrame([(1, "http://a.b/c"), (1, "http://a.b/c"), (None, None)], schema)).collect()
    assert [r.verdict for r in rows] == ["allow"] * 3
    assert urls.filter_urls(spark.createDataFrame([], schema)).count() == 0

"""Importance resampling, periodic runs and URL filters against brute force, on whole small tables and on edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from nodeloom.llm import importance, periodic, registry, url_filter
from nodeloom.llm.common import table

SF = "/root/testdata/sf0.001"
BIG = 2**53
DOCS = "doc_id long, text string, bucket string, word int, row long, rank int, runs string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _odd():
    """Nulls, empty and long texts, ties, repeated rows, ids beyond 2**53 beside a null one; other columns clash."""
    texts = [(1, None), (2, ""), (3, " \t\n"), (4, "One two One TWO one two one two, one two"), (5, "x " * 30_000), (None, "a b c d e f g " * 9), (BIG + 1, "la " * 20), (BIG + 3, "É é É é É é É é É é"), (-4, "a b c d e f g " * 9), (8, "same same same same same same"), (8, "same same same same same same"), (9, "\x00 ! ?\x7f z_z Ärger")]
    return [(*r, "clash", 1, 2, 3, "r") for r in texts]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(_odd(), DOCS)


# --- importance resampling --------------------------------------------------
def _plain_resample(rows, target, order=2, buckets=10_000, least=20, percent=25):
    def words(text):
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))

    def features(w):
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, order + 1) for i in range(len(w) - n + 1)]

    source, aim = Counter(), Counter()
    for _, text in rows:
        source.update(features(words(text)))
    for text in target:
        aim.update(features(words(text)))
    S, T = sum(source.values()), sum(aim.values())
    gain = [math.floor(1000 * math.log((aim[b] + 1) * (S + buckets) / ((source[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for doc, text in rows:
        f = features(words(text))
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)) >= least])
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): k for k, r in enumerate(fit[: percent * len(fit) // 100], 1)}
    return sorted(((*r[:4], ranks.get(id(r))) for r in out), key=repr)


def _got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_resampling_equals_plain_counts(spark):
    docs, target = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    rows, aim = [tuple(r) for r in docs.select("doc_id", "text").collect()], [r["text"] for r in target.collect()]
    assert _got(registry.queries()["op11_importance_resampling"](spark, SF)) == _plain_resample(rows, aim)
    assert _got(importance.resample(docs, target, order=3, buckets=500, percent=60)) == _plain_resample(rows, aim, 3, 500, 20, 60)


def test_resampling_edges(spark, odd):
    target = spark.createDataFrame([("one two three", 1), (None, 2), ("É é", 3)], "text string, gain int")
    rows = [r[:2] for r in _odd()]
    got = _got(importance.resample(odd, target, least_words=8, percent=50))
    want = _plain_resample(rows, ["one two three", None, "É é"], least=8, percent=50)
    assert got == want and {r[0] for r in got} >= {BIG + 1, BIG + 3, None, -4}
    none = spark.createDataFrame([], DOCS)
    assert importance.resample(none, target).collect() == []
    assert _got(importance.resample(odd, target.limit(0))) == _plain_resample(rows, [])


def test_the_window_needs_no_shuffle_of_its_own(spark):
    plan = importance.position_table(table(spark, SF, "documents").select("doc_id", "text"), 2, 100)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" in plan


def test_ranks_over_many_ranges(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(importance, "TASK_ROWS", 100)
    rows = spark.range(2000).select((F.col("id") % 7).alias("score"), F.when(F.col("id") % 3 > 0, F.lit(5)).alias("doc_id"), "id")
    got = importance.ranked(rows, [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("id")], "rank").collect()
    assert [r["rank"] for r in sorted(got, key=lambda r: (-r["score"], r["doc_id"] is None, r["id"]))] == list(range(1, 2001))


# --- periodic runs ----------------------------------------------------------
def _plain_runs(w, exponent=4, least=6):
    found = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, exponent * p):
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((s, p, e - s) for (s, e), p in found.items())


def test_runs_equal_plain_search():
    rnd = random.Random(3)
    for _ in range(300):
        docs = []
        for _ in range(rnd.randrange(1, 5)):
            n, k = rnd.randrange(70), rnd.choice([1, 2, 2, 3, 6])
            w = [rnd.randrange(k) for _ in range(n)]
            if n and rnd.random() < 0.5:
                a, p = rnd.randrange(n), rnd.randrange(1, 9)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            docs.append(w)
        counts = np.array([len(w) for w in docs])
        edges = np.r_[0, np.cumsum(counts)]
        symbols = np.array([10 * d + x for d, w in enumerate(docs) for x in w], np.int64)
        for exponent, least in ((4, 6), (2, 2)):
            s, e, p = periodic.runs(symbols, np.repeat(edges[:-1], counts), np.repeat(edges[1:], counts), exponent, least)
            want = [(int(edges[d]) + a, q, n) for d, w in enumerate(docs) for a, q, n in _plain_runs(w, exponent, least)]
            assert sorted(zip(s.tolist(), p.tolist(), (e - s).tolist(), strict=True)) == sorted(want)


def test_nearest_low_of_ramps():
    for values in (np.r_[-1, np.arange(500), 3, 2, 1, np.arange(300), -1], np.r_[-1, np.zeros(200, int), -1], np.array([-1, -1])):
        want = [0] + [max((j for j in range(i) if values[j] <= values[i]), default=0) for i in range(1, len(values))]
        assert periodic.nearest_low(values).tolist() == want


def _plain_row(doc, text):
    w = (text or "").encode().split()
    h, n = zlib.crc32(str(doc).encode()) if doc is not None else 1, len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = _plain_runs(w)
    gone = {i for s, p, n in runs for i in range(s + p, s + n)}
    best = min(((-n, s, p) for s, p, n in runs), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    shown = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    return (doc, len(runs), *shown, sha("".join(f"{s},{n},{p}\n" for s, p, n in runs).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


RUNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_run_query_equals_plain_search(spark):
    got = registry.queries()["op12_periodic_runs"](spark, SF)
    rows = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    short = {d for d, t in rows if len((t or "").split()) <= 3000}
    want = sorted(_plain_row(d, t) for d, t in rows if d in short)
    have = sorted(tuple(r) for r in got.select(*RUNS).collect())
    assert len(have) == len(rows) and [r for r in have if r[0] in short] == want and len(want) > 150


def test_runs_edges(spark, odd):
    got = periodic.collapse(odd).collect()
    assert len(got) == len(_odd())
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(([(x["start"], x["period"], x["length"]) for x in r["runs"]], r["n_words"], r["text"]))
    for doc, text, *_ in _odd():
        if doc != 5:
            w = (text or "").encode().split()
            runs = _plain_runs(w)
            gone = {i for s, p, n in runs for i in range(s + p, s + n)}
            assert (runs, len(w), " ".join(x.decode() for i, x in enumerate(w) if i not in gone)) in by[doc]
    assert by[5] == [([(0, 1, 30_000)], 30_000, "x")] and len(by[8]) == 2 and by[BIG + 1][0][2] == "la"
    assert periodic.collapse(spark.createDataFrame([], DOCS)).collect() == []


# --- URL filters ------------------------------------------------------------
def _plain_parts(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    return (m.group(1).translate(LOWER), m.group(2)) if m else ("", "")


def _plain_grams(host, path, orders=(3, 4, 5), buckets=1 << 14):
    out = Counter()
    for mark, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        out.update(zlib.crc32((mark + text[i : i + k]).encode()) % buckets for k in orders for i in range(len(text) - k + 1))
    return out


def _plain_model(urls, steps=300, rate=0.5, decay=1e-3, buckets=1 << 14):
    x, y = np.zeros((len(urls), buckets)), np.array([float(b) for _, b in urls])
    for k, (url, _) in enumerate(urls):
        for b, n in _plain_grams(*_plain_parts(url)).items():
            x[k, b] = n
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    w, c = np.zeros(buckets), 0.0
    for _ in range(steps):
        miss = y - 1 / (1 + np.exp(-(x @ w + c)))
        w, c = w * (1 - rate * decay) + rate * x.T @ miss, c + rate / len(y) * miss.sum()
    return w, c


def _plain_verdict(url, rules, w, c):
    host, path = _plain_parts(url)
    fits = [(len(h + p), h + p, says) for says, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    g = _plain_grams(host, path)
    z = sum(n * w[b] for b, n in g.items()) / (sum(n * n for n in g.values()) ** 0.5 or 1) + c
    score = 1 / (1 + math.exp(-z))
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "block" if score >= 0.5 else "allow", score


def test_url_query_equals_plain_descent(spark):
    labelled = [tuple(r) for r in registry.labelled_urls(spark).select("url", "bad").collect()]
    w, c = _plain_model(labelled)
    got = {r["page_id"]: r for r in registry.queries()["op13_url_filter"](spark, "/root/testdata/sf0.01").collect()}
    pages = table(spark, "/root/testdata/sf0.01", "pages").select("page_id", "url").collect()
    assert len(got) == len(pages)
    for r in pages:
        host, path, rule, verdict, score = _plain_verdict(r["url"], registry.URL_RULES, w, c)
        g = got[r["page_id"]]
        assert (g["host"], g["path"], g["rule"], g["verdict"]) == (host, path, rule, verdict) and abs(g["score"] - score) < 1e-9


def test_url_edges(spark):
    """Rules: hosts, subdomains, prefixes, the longest; parts of odd URLs; nulls, long and repeated ones."""
    urls = ["http://example.org/es/1", "http://a.EXAMPLE.org/es/", "http://notexample.org/es/", "https://example.org/en/17", "http://example.org", "http://x.com/fr/?a", "http://x.com/de/#b", "http://com/de/", "ftp://h?x/y", "://", "no scheme", "", None, "http://a/b?c#d", "http://u://v/de/", "http://x.com:80/de/", "http://" + "long" * 20_000 + ".net/" + "y" * 50_000, "http://É.net/ß/\n/x"]
    rows = [(BIG + 1, u, "p", 0.5, 1) for u in urls] + [(None, urls[0], "p", 0.5, 1)]
    model = url_filter.train(registry.labelled_urls(spark))
    w, c = np.zeros(1 << 14), 0.0
    for r in model.collect():
        if r["bucket"] < 0:
            c = r["weight"]
        else:
            w[r["bucket"]] = r["weight"]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, host string, score double, row int"), registry.URL_RULES, model).collect()
    key = lambda r: (r[0], r[1], r[2] or "", r[3], round(r[4], 9))
    assert sorted(key((r["host"], r["path"], r["rule"], r["verdict"], r["score"])) for r in got) == sorted(key(_plain_verdict(r[1], registry.URL_RULES, w, c)) for r in rows)
    assert {r["page_id"] for r in got} == {BIG + 1, None}
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(empty, registry.URL_RULES, model).collect() == []
    with pytest.raises(ValueError, match="labelled"):
        url_filter.train(spark.range(url_filter.ROWS + 1).selectExpr("concat('http://a/', id) as url", "true as bad"))


def test_url_model_judges_hosts_it_has_not_seen(spark):
    """Trained without one bad host and its subdomains, the model still tells most of them."""
    bad = sorted({re.sub(r"^(www|blog|m)\.", "", h) for h in registry.BAD_HOSTS})
    right = 0
    for k in range(4):
        out = bad[k::4]
        w, c = _plain_model([(r["url"], r["bad"]) for r in registry.labelled_urls(spark).collect() if not any(h in r["url"] for h in out)])
        right += sum(_plain_verdict(f"http://{h}/en/5", [], w, c)[3] == "block" for h in out)
    assert right >= 0.7 * len(bad)

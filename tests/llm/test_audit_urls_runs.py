"""Filter audit, URL filters and periodic runs against plain Python, over whole small tables and odd rows."""

import random
import zlib
from collections import Counter
from itertools import permutations

import pytest
from brute import sha, words

from pyspark.sql import functions as F

from textloom.llm import filter_audit, periodic_runs, queries, url_filters

CLASH = ("id", "part", "digest", "mask", "good", "toxic", "n", "low", "host", "path", "rule", "verdict", "runs", "words", "g", "a")
LONG = " ".join(f"w{i % 700}" for i in range(30_000))
TEXTS = [None, "", " \t\n", "one", "ABC " * 60, "a b c " * 30, "a | b " * 30, LONG, LONG, LONG + " x", "Ünï 漢字 É\x85Ö\u00a0x " * 20, "x" * 5_000, "same text " * 3, "same text " * 3, None]


def with_clashes(df, column):
    for c in CLASH:
        if c not in df.columns:
            df = df.withColumn(c, F.col(column))
    return df


# Filter audit


def fails(text):
    w, t = words(text), text or ""
    tests = [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), any(c in "#$%&*|" for c in t)]
    return {c for c, bad in zip("ABCD", tests, strict=True) if bad}


def audit(rows, labels):
    """rows: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    first = {}
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    docs = []
    for d, t, s in rows:
        bad = fails(t) | ({"E"} if d is not None and d > first[t or ""] else set())
        own = [x for x in labels if d is not None and x[0] == d]
        docs.append((s or "", bad, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out = []
    for part in {d[0] for d in docs}:
        own = [d[1:] for d in docs if d[0] == part]
        steps, total = [], Counter()
        for order in map("".join, permutations("ABCDE")):
            left = list(own)
            for k, c in enumerate(order, 1):
                gone, left = [x for x in left if c in x[0]], [x for x in left if c not in x[0]]
                total[c] += len(gone)
                steps.append((part, order, k, len(left), len(gone), sum(c in x[0] for x in own) - len(gone), sum(x[0] == {c} for x in own), sum(x[1] for x in gone), sum(x[2] for x in gone)))
        out += [(*x, total[x[1][x[2] - 1]]) for x in steps]
    return sorted(out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def got_audit(spark, rows, labels):
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), "text")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").select("doc_id", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    return sorted(map(tuple, filter_audit.filter_audit(docs, marks).select(COLUMNS).collect()))


def test_audit_of_odd_rows(spark):
    rows = [(i, t, ["s", None, "t"][i % 3]) for i, t in enumerate(TEXTS)]
    rows += [(None, "same text " * 3, "s"), (None, None, None), (12, "same text " * 3, "t"), (12, "same text " * 3, "t"), (3, "another", "s")]
    labels = [(0, 1, 0), (0, 0, 1), (5, 1, None), (None, 1, 1), (13, None, 1), (12, 1, 0), (99, 1, 1)]
    assert got_audit(spark, rows, labels) == audit(rows, labels)


def test_audit_of_the_table(spark, sf):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    want = audit(rows, labels)
    assert got_audit(spark, rows, labels) == want
    assert sorted(map(tuple, queries.op11_filter_audit(spark, sf).select(COLUMNS).collect())) == want


def test_crowd_of_copies_in_the_audit(spark):
    rows = [(i, LONG[:3_000] if i % 3 else f"other {i} " * 60, "s") for i in range(900)]
    assert got_audit(spark, rows, []) == audit(rows, [])


def test_audit_without_rows_labels_or_copies(spark):
    assert got_audit(spark, [], []) == []
    docs = spark.createDataFrame([(1, "a b", "s"), (2, "a b", "s")], "doc_id long, text string, source string")
    few = filter_audit.filter_audit(docs, filters={"X": "n_words < 3", "Y": "n_distinct = 2"}, copies=None)
    assert sorted((r.filter_order, r.step, r.kept, r.removed, r.redundant, r.shapley) for r in few.collect()) == [("XY", 1, 0, 2, 0, 2), ("XY", 2, 0, 0, 2, 2), ("YX", 1, 0, 2, 0, 2), ("YX", 2, 0, 0, 2, 2)]
    with pytest.raises(ValueError):
        filter_audit.filter_audit(docs, filters={"E": "n_words < 3"})


@pytest.mark.parametrize("block, mask", [(1 << 20, (1 << 64) - 1), (7, (1 << 64) - 1), (1 << 20, 3), (50, 1), (1, 0)])
def test_scanner_in_blocks_and_with_collisions(block, mask):
    import numpy as np

    rnd = random.Random(block)
    texts = ["".join(rnd.choice("aAbé漢 \n\t|") for _ in range(rnd.randrange(60))) for _ in range(200)] + ["", " ", "word" * 40, "end"]
    raw = [t.encode() for t in texts]
    bounds = np.cumsum([0, *map(len, raw)])
    found = filter_audit.Scanner(block=block, hash_mask=mask).scan(np.frombuffer(b"".join(raw), np.uint8), bounds)
    want = [(len(w := words(t)), len(set(w)), sum("A" <= c <= "Z" for c in t), len(t), sum(c in "#$%&*|" for c in t)) for t in texts]
    assert [tuple(map(int, r)) for r in found] == want


# URL filters


def judged(url, rules, default="allow"):
    tail = (url or "").partition("://")[2]
    host = tail[: min((tail + "/").find("/"), (tail + "?").find("?"), (tail + "#").find("#"))]
    path = tail[len(host) :]
    path = path[: min((path + "?").find("?"), (path + "#").find("#"))]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for (h, p), v in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, default)))


URLS = [None, "", "no scheme", "http://", "://a.com/x", "HTTP://WWW.Example.COM/en/1", "http://www.example.com/EN/1", "http://example.com", "http://example.com?x=/en/", "http://example.com/en/#a",
        "http://x.example.com/en/y://z.net/es/", "http://notexample.com/en/", "http://b.net/es/1?q", "http://net/fr/", "http://a.com:80/en/", "http://é.com/漢/字", "http://é.com/漢", "http://.com/", "http://a..com/en/", "http://com./x", "http://a.b\nc.com/x\ny"]
RULES = {(h, p): v for h, p, v in queries.URL_RULES} | {("é.com", "/漢/"): "block", ("a.com", ""): "block", ("b.a.com", "/"): "allow", ("com", "/x"): "block"}


@pytest.mark.parametrize("bits, file_rows", [(64, 1 << 20), (2, 1 << 20), (0, 4), (64, 3)])
def test_urls_with_collisions_and_in_files(spark, bits, file_rows):
    rnd = random.Random(3)
    made = ["http://" + ".".join(rnd.choice(["a", "b", "www", "example", "net"]) for _ in range(rnd.randrange(4))) + rnd.choice([".com", ".net", ""]) + rnd.choice(["/", "", "/en/", "/es/1", "/x"]) for _ in range(300)]
    pages = with_clashes(spark.createDataFrame([*enumerate(URLS + made), (None, "http://b.net/es/"), (0, URLS[5])], "page_id long, url string").repartition(3), "url")
    rules = spark.createDataFrame([(h, p or None, v) for (h, p), v in RULES.items()], "host string, path string, verdict string")
    hashed = (lambda k: url_filters.digest(k) >> (64 - bits)) if bits else (lambda k: 7)
    found = url_filters.judge_urls(pages, rules, file_rows=file_rows, hashed=hashed)
    want = [(i, *judged(u, RULES)) for i, u in [*enumerate(URLS + made), (None, "http://b.net/es/"), (0, URLS[5])]]
    assert Counter(map(tuple, found.collect())) == Counter(want)


def test_urls_of_the_table(spark, sf):
    rows = [(r.page_id, r.url) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    rules = {(h, p): v for h, p, v in queries.URL_RULES}
    assert Counter(map(tuple, queries.op12_url_filters(spark, sf).collect())) == Counter((i, *judged(u, rules)) for i, u in rows)


def test_rules_that_clash_or_say_nothing(spark):
    rows = [("A.com", "/", "allow"), ("a.com", "/", "block"), ("a.com", "/", "block"), (None, "/", "block"), ("b.com", "/", None), ("b.com", "/", "odd"), ("", "", "block")]
    rules = spark.createDataFrame(rows, "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/"), (2, "http://b.com/"), (3, None)], "page_id long, url string")
    assert {(r.page_id, r.rule, r.verdict) for r in url_filters.judge_urls(pages, rules).collect()} == {(1, "a.com/", "block"), (2, None, "allow"), (3, "", "block")}
    none = rules.limit(0)
    assert {r.verdict for r in url_filters.judge_urls(pages, none, default="block").collect()} == {"block"}
    assert url_filters.judge_urls(pages.limit(0), rules).count() == 0


def test_long_list(spark):
    rules = spark.range(20_000).selectExpr("concat('h', id, '.org') host", "concat('/', id % 7) path", "if(id % 2 = 0, 'block', 'allow') verdict")
    pages = spark.range(3_000).selectExpr("id page_id", "concat('http://www.h', id * 8, '.org/', id * 8 % 7, 'x') url")
    found = url_filters.judge_urls(pages, rules, file_rows=4_096).groupBy("verdict", F.col("rule").isNull()).count().collect()
    assert {tuple(r) for r in found} == {("block", False, 2_500), ("allow", True, 500)}


# Periodic runs


def runs_of(w, least=12):
    out = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - p:
            j = i
            while j < len(w) - p and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, 2 * p):
                out.setdefault((i, j + p), p)  # the smallest period comes first
            i = max(j, i + 1)
    return sorted((s, e - s, p) for (s, e), p in out.items())


def repeats_planted(doc_id, text):
    w = words(text)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    return w


def op13(doc_id, text):
    w = repeats_planted(doc_id, text)
    runs = runs_of(w)
    dropped = {i for s, n, p in runs for i in range(s + p, s + n)}
    s, n, p = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    return (doc_id, len(runs), s, n, p, runs and 1000 * n // p or None, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in dropped)))


def test_runs_of_the_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {op13(*r) for r in rows}
    assert {tuple(r) for r in queries.op13_periodic_runs(spark, sf).collect()} == want
    assert sum(r[1] > 0 for r in want) >= 10


def test_runs_of_odd_rows(spark):
    planted = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    texts = TEXTS[:7] + TEXTS[10:] + ["a " * 400, "x y z " * 10 + "q " + "x y " * 9, " lead  and\ttrail \n" * 5]
    rows = [(k, t) for k, t in zip(planted, texts, strict=False)] + [(100_000 + i, t) for i, t in enumerate(texts)] + [(None, "b " * 20), (None, None), (5, "c " * 20), (5, "c " * 20)]
    df = with_clashes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "text")
    found = periodic_runs.periodic_runs(queries.planted_repeats(df))
    got = Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in found.collect())
    want = Counter()
    for d, t in rows:
        w = repeats_planted(d, t)
        runs = runs_of(w)
        dropped = {i for s, n, p in runs for i in range(s + p, s + n)}
        want[d, len(w), tuple(runs), " ".join(x for i, x in enumerate(w) if i not in dropped)] += 1
    assert got == want
    assert periodic_runs.periodic_runs(df.limit(0)).count() == 0
    clashing = with_clashes(df.withColumn("x", F.col("text")), "text")
    assert periodic_runs.periodic_runs(clashing).columns == ["doc_id", "n_words", "runs", "collapsed"]


@pytest.mark.parametrize("short", [0, 4096])
def test_runs_of_random_words(monkeypatch, short):
    monkeypatch.setattr(periodic_runs, "SHORT", short)
    periodic_runs._short_grid.cache_clear()
    rnd = random.Random(short)
    fib = ["a", "ab"]
    while len(fib[-1]) < 200:
        fib.append(fib[-1] + fib[-2])
    made = [list(map(ord, fib[-1]))]
    for _ in range(600):
        n, k = rnd.randrange(120), rnd.choice([1, 2, 3, 5, 40])
        w = [rnd.randrange(k) for _ in range(n)]
        if n and rnd.random() < 0.6:
            a = rnd.randrange(n)
            p = 1 + rnd.randrange(max(1, (n - a) // 2))
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)] + [rnd.randrange(k) for _ in range(rnd.choice([0, 20]))]
        made.append(w)
    for w in made:
        for least in (2, 5, 12):
            assert periodic_runs.find_runs(w, least, block=rnd.choice([1, 30, 1 << 18])) == runs_of(w, least)
    periodic_runs._short_grid.cache_clear()


def test_runs_of_a_very_long_text():
    import numpy as np

    n = 300_000
    w = np.arange(n)
    w[1_000:201_000] = np.arange(200_000) % 3
    w[250_000:] = 7
    assert periodic_runs.find_runs(w) == [(1_000, 200_000, 3), (250_000, 50_000, 1)]
    half = np.concatenate([np.arange(n // 2)] * 2)
    assert periodic_runs.find_runs(half) == [(0, n, n // 2)]
    assert periodic_runs.kept_words(n, [(0, n, n // 2)]).tolist() == [True] * (n // 2) + [False] * (n // 2)

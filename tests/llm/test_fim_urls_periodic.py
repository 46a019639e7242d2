"""Operators 11 to 13 against plain versions, on the tables and on cases."""

import glob
import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from staveforge.llm import fim, periodic, urls
from staveforge.llm import queries as Q

SF = "/root/testdata/sf0.001"
NASTY = [None, "", " ", "a", "é\u0301\r\n\0x😀", "<P>", "ab<S>cd", "<" * 40, "<P" * 30, "\n\r\u2028" * 300, "語" * 100, "x y " * 9000]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


# operator 11


def plain_fim(i, text):
    text, n = text or "", len(text or "")
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    head, mid, tail = text[:a], text[a:b], text[b:]
    out = f"<S>{tail}<P>{head}<M>{mid}" if h4 % 100 < 20 else f"<P>{head}<S>{tail}<M>{mid}"
    return n, "spm" if h4 % 100 < 20 else "psm", a, b - a, sha(out), sha(text)


def test_fim_query(spark, docs):
    got = {r.doc_id: tuple(r)[1:] for r in Q.op11_split_fim(spark, SF).collect()}
    assert got == {i: plain_fim(i, t) for i, t in docs.items()}
    assert {v[1] for v in got.values()} == {"plain", "psm", "spm"}


def test_fim_cases(spark):
    rows = [(i, t) for i in range(30) for t in NASTY] + [(None, "no id"), (3, "a"), (3, "a")]
    got = [tuple(r) for r in fim.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(map(str, got)) == sorted(str((i, *plain_fim(i, t))) for i, t in rows)


@pytest.mark.parametrize("n", [0, 1, fim.BLOCK - 1, fim.BLOCK, fim.BLOCK + 1, fim.SLAB - 1, fim.SLAB, fim.SLAB + 1, 2 * fim.SLAB + 77])
def test_offsets_are_code_points(n):
    text = "".join(random.Random(n).choice("aß語😀\n\r\0\u0301 ") for _ in range(n))
    cuts = fim.Offsets(text)
    assert cuts.n == n and all(cuts[k] == k for k in {0, n, n // 2, n // 3, max(0, n - 1)})


def test_fim_keeps_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "abc", 7, "x")], "doc_id long, text string, fim int, output string")
    r = fim.fill_in_middle(df).collect()[0]
    assert (r.fim, r.output, r.text) == (7, "x", "abc") and r.fim_.n == 3
    assert fim.digests(df.limit(0)).count() == 0


def test_fim_other_sentinels(spark):
    marks = fim.Sentinels("[pre]", "(suf)", "|mid|")
    df = spark.createDataFrame([(i, f"text {i} <P> of (suf") for i in range(50)], "doc_id long, text string")
    made = fim.fill_in_middle(df, marks=marks, plain=0, spm=50).select("text", "fim.*")
    back = made.withColumn("p", fim.parts(made["output"], made["form"], marks))
    rows = back.select("text", "form", fim.restored(back["p"], back["output"], back["form"]).alias("b")).collect()
    assert all(r.text == r.b for r in rows) and {r.form for r in rows} == {"psm", "spm"}


# operator 12


def plain_url(url):
    url = url or ""
    m = re.search(r"://([^/?#]*)([^?#]*)", url)
    low = url.translate(urls._LOWER)
    host, path = (m[1].translate(urls._LOWER), m[2]) if m else ("", "")
    fits = [(r, v) for r, v in urls.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    rule, ruled = max(fits, key=lambda x: len(x[0]), default=(None, None))
    count = lambda terms: sum(bool(re.search(rf"(?<![a-z0-9\u0080-\U0010ffff]){re.escape(t)}(?![a-z0-9\u0080-\U0010ffff])", low)) for t in terms)
    strict, soft = count(urls.STRICT), count(urls.SOFT)
    return host, path, rule, ruled or ("block" if strict or soft >= urls.SOFT_LIMIT else "allow"), strict, soft


def test_urls_query(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: tuple(r)[1:] for r in Q.op12_url_vocabulary(spark, SF).collect()}
    assert got == {r.page_id: plain_url(r.url) for r in pages}


CASES = [
    None, "", "nothing", "://", "a://", "http:///en/", "HTTP://WWW.EXAMPLE.COM/en/x", "http://example.com/en/", "http://a.b.example.com/en/q?x#y", "http://example.com/EN/", "http://notexample.com/en/",
    "http://com/", "http://com", "http://x.com?://y.net/es/", "http://x.net/es", "http://x.net/es/", "http://x.net/fr/a", "http://x.net/de/free-bets", "http://x.org/free-betsy", "http://x.org/free/bets", "http://x.org/free/free",
    "http://x.org/xxx", "http://x.org/axxx", "http://x.orgéxxx", "http://x.org/freé/bets", "http://EXAMPLE.org/XXX", "http://x.com:80/", "http://user@x.com/", "free bets", "porn", "http://x.org/" + "a" * 50000 + "/spam", "http://.com/", "http://x..com/",
]


def test_url_cases(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(CASES)] * 2, "page_id long, url string")
    rows = urls.judge(df).select("page_id", "judged.*").collect()
    assert len(rows) == 2 * len(CASES)
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict, len(r.strict), len(r.soft)) == plain_url(CASES[r.page_id]), CASES[r.page_id]


def test_url_rules_columns_and_empty_tables(spark):
    df = spark.createDataFrame([("http://b.a.x/p/q", 5)], "url string, JUDGED int")
    r = urls.judge(df, rules=[("x/", "block"), ("a.x/p/", "allow"), ("b.a.x/p/q/", "block")]).collect()[0]
    assert r.JUDGED == 5 and r.judged_.rule == "a.x/p/"
    assert urls.judge(df, rules=[], strict=[], soft=[]).collect()[0].judged_.verdict == "allow"
    assert urls.judge(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="not a rule"):
        urls.judge(df, rules=[("com", "block")])


# operator 13


def plain_runs(w, least=12):
    """Every maximal stretch of every period, by definition."""
    n, found = len(w), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            if i + p - s >= max(least, 2 * p):
                found.setdefault((s, i + p), p)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def plain_digest(i, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    runs = sorted(plain_runs(w), key=lambda r: (r[0], r[2]))
    gone = {k for s, m, p in runs for k in range(s + p, s + m)}
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return len(runs), *best, sha("".join(f"{s},{m},{p}\n" for s, m, p in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone))


def test_runs_query(spark, docs):
    got = {r.doc_id: tuple(r)[1:] for r in Q.op13_harmonic_runs(spark, SF).collect()}
    assert set(got) == set(docs)
    short = [i for i, t in docs.items() if len((t or "").split()) < 1500]
    assert len(short) > 150 and {i: got[i] for i in short} == {i: plain_digest(i, docs[i]) for i in short}


@pytest.mark.parametrize("seed", range(40))
def test_runs_of_random_words(seed):
    r = random.Random(seed)
    texts = []
    for _ in range(r.randint(1, 30)):
        w = [r.randint(0, r.choice([0, 1, 2, 5])) for _ in range(r.choice([0, 1, 2, 11, 12, 13, 40, 150]))]
        if r.random() < 0.5 and len(w) > 2:
            p = r.randint(1, len(w))
            w = [w[k % p] for k in range(len(w))]
        texts.append(w)
    least = r.choice([1, 2, 12])
    runs = periodic.find(np.array([x for t in texts for x in t], np.int64), np.repeat(np.arange(len(texts)), [len(t) for t in texts]), least)
    base, want = 0, []
    for t in texts:
        want += [[base + s, base + s + m, p] for s, m, p in plain_runs(t, least)]
        base += len(t)
    assert sorted(runs.tolist()) == sorted(want)


def test_runs_of_long_words_and_cases(spark):
    rows = [(i, t) for i in range(12) for t in [*NASTY[:-1], "a b " * 400, "Fibonacci " + " ".join("abaababaabaababaababaabaababaabaab"), "x" * 300000, "ü ü\u00a0ü " * 40]] + [(None, "a " * 30)]
    got = [tuple(r) for r in periodic.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(map(str, got)) == sorted(str((i, *plain_digest(i, t))) for i, t in rows)


def test_runs_of_one_long_text():
    r = np.random.default_rng(5)
    unit = r.integers(0, 50, 7000)
    ids = np.concatenate([r.integers(0, 50, 30000), np.tile(unit, 4)[:25001], r.integers(50, 99, 30000), np.zeros(20000, np.int64)])
    runs = periodic.find(ids, np.zeros(len(ids), np.int64)).tolist()
    assert [85001, 105001, 1] in runs and any(p == 7000 and s <= 30000 and e == 55001 for s, e, p in runs)


def test_runs_keep_columns_and_empty_tables(spark):
    df = spark.createDataFrame([("a b " * 10, 1)], "text string, periodic int")
    r = periodic.find_runs(df).collect()[0]
    assert r.periodic == 1 and r.periodic_.collapsed == "a b" and [tuple(x) for x in r.periodic_.runs] == [(0, 20, 2)]
    assert periodic.find_runs(df.limit(0)).count() == 0


# SQL of the llm queries


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_llm_query_equals_sql(spark, con, name):
    got = Q.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(Q.ORACLE_SQL[name])
    at = [[d[0] for d in want.description].index(c) for c in cols]
    assert sorted(str(tuple(r[c] for c in cols)) for r in got.collect()) == sorted(str(tuple(r[k] for k in at)) for r in want.fetchall())

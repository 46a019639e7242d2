"""The ten operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import base64
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from staveforge.llm import decontaminate as D
from staveforge.llm import licenses, lines, media, minhash, mixing, quality, sharding, toxicity, warc
from staveforge.llm import words as W
from staveforge.llm.common import Scratch

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced(x):
    return re.findall(r"[^\x20\x09-\x0D]+", (x or "").translate(LOW))


def alnum(x):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").translate(LOW))


VOCAB = ["alpha", "Beta", "gamma", "delta", "Épsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu", "nu", "xi", "omicron", "pi"]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    base = [" ".join(r.choices(VOCAB, k=60)) for _ in range(6)]
    out = [None, "", " \n\t ", "one", "Two words", base[0], base[0], base[0].upper()]
    for b in base:
        for e in range(6):
            w = b.split()
            for _ in range(e):
                w[r.randrange(len(w))] = f"edit{r.randrange(99)}"
            out.append(" ".join(w))
    return [*out, " ".join(r.choices(VOCAB, k=30_000)), "x" * 300_000, "the same\nline here\n\nthe same", "the same"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, x, "src" + str(i % 3) if i % 7 else None, i) for i, x in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[5], (None, "one", "src0", 0)], "doc_id long, text string, source string, size long")


def empty(docs):
    return docs.where("false")


def test_word_scan_equals_regex(texts, monkeypatch):
    for size in (1 << 18, 64):
        monkeypatch.setattr(W, "SLICE", size)
        batch = pa.record_batch({"text": pa.array(texts)})
        for kind, find in ((W.SPACED, spaced), (W.ALNUM, alnum)):
            w = W.scan(batch, "text", kind)
            names = {}
            for i, x in enumerate(texts):
                got = [bytes(w.data[a:b]).decode().translate(LOW) for a, b in zip(w.start[w.bounds[i] : w.bounds[i + 1]], w.end[w.bounds[i] : w.bounds[i + 1]])]
                assert got == find(x)
                for word, h in zip(got, w.hash[w.bounds[i] : w.bounds[i + 1]].tolist()):
                    assert names.setdefault(word, h) == h
            assert len(set(names.values())) == len(names)


def brute_components(sets, percent, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    items = [(n, s) for n, s in sets.items() if s]
    for i, (a, s) in enumerate(items):
        for b, t in items[:i]:
            k = len(s & t)
            if 100 * k >= percent * (len(s) + len(t) - k):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize(("k", "percent", "block"), [(3, 85, 256), (5, 80, 256), (3, 60, 4)])
def test_near_duplicates(spark, docs, texts, k, percent, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", block)
    got = minhash.near_duplicates(docs, shingle=k, percent=percent).collect()
    sets = {i: {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set()) for i, w in enumerate(map(spaced, texts))}
    want = brute_components(sets, percent, list(sets))
    assert len(got) == len(texts) + 2
    for r in got:
        if r.doc_id is None:  # "one", as document 3
            assert (r.component_id, r.kept) == (3, False)
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    kept = minhash.drop_near_duplicates(docs, shingle=k, percent=percent)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({r.doc_id for r in got if r.kept})
    assert minhash.near_duplicates(empty(docs)).count() == 0


def test_near_duplicates_of_repeated_and_null_ids(spark):
    a, b, c = ("x y z " * 9 + "one two three four five six seven eight nine ten " + t for t in ("end", "End", "a b c d e f g h i j k l m n o p"))
    rows = [(7, a, 1), (7, a, 1), (7, a, 2), (7, c, 3), (4, c.upper(), 4), (None, b, 5), (None, "alone", 6), (None, "alone", 7), (9, "", 8), (9, "", 8), (None, None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `node.k1` int").withColumnRenamed("node.k1", "node")
    got = minhash.near_duplicates(docs, shingle=3, percent=85).groupBy("doc_id", "component_id", "kept").count().collect()
    assert {tuple(r) for r in got} == {(7, 7, True, 3), (7, 4, False, 1), (4, 4, True, 1), (None, 7, False, 1), (None, None, True, 3), (9, 9, True, 2)}
    kept = minhash.drop_near_duplicates(docs, shingle=3, percent=85)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(7, a, 1), (4, c.upper(), 4), (None, "alone", 6), (9, "", 8), (9, "", 8), (None, None, 9)], key=str)


def test_agreement_is_corrected_for_chance():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    b = np.concatenate([a[:3200], rng.integers(0, 1 << 63, 800, dtype=np.uint64)])
    x, y = minhash._pack(minhash.minima(a)), minhash._pack(minhash.minima(b))
    d = x ^ y
    d |= d >> np.uint64(1)
    d |= d >> np.uint64(2)
    same = minhash.HASHES - int(np.bitwise_count(d & np.uint64(0x1111111111111111)).sum())
    p = (same / minhash.HASHES - 2.0**-minhash.BITS) / (1 - 2.0**-minhash.BITS)
    assert abs(p - 3200 / 4800) < 0.17
    assert minhash.least_agreeing(0.85) < minhash.HASHES * 0.85


def test_fuzzy_lines(spark, docs, texts):
    rng = random.Random(3)
    long = "".join(rng.choices("abcdefgh ", k=400))
    more = [(100 + i, long[:j] + "Z" + long[j + 1 :] + "\n" + long) for i, j in enumerate(range(20, 400, 40))]
    d = docs.where("doc_id <> 45").select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = lines.dedup_lines(d).collect()
    place, first, sets = {}, {}, {}
    for i, x in sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in d.collect() if r.text is not None):
        for j, line in enumerate(x.split("\n")):
            if line.strip(" "):
                place[i, j] = line
                first.setdefault(line, (i, j))
    for line in first:
        b = line.encode()
        sets[line] = {b[k : k + 12] for k in range(max(1, len(b) - 11))}
    names = sorted(first, key=first.get)
    comp = brute_components({names.index(n): sets[n] for n in names}, 80, list(range(len(names))))
    best = {}
    for n in names:
        c = comp[names.index(n)]
        best[c] = min(best.get(c, first[n]), first[n])
    fix = lambda a, b: (-1 if a is None else a, b)
    assert {fix(r.doc_id, r.line_no) for r in got} == set(place)
    for r in got:
        at = fix(r.doc_id, r.line_no)
        assert fix(r.component_doc, r.component_line) == best[comp[names.index(place[at])]]
        assert r.kept == (at == fix(r.component_doc, r.component_line))
    assert lines.dedup_lines(empty(docs)).count() == 0


def test_fuzzy_lines_of_mixed_scripts(spark, docs, texts):
    rng = random.Random(8)
    tail = " ".join(f"w{i}" for i in range(40))
    han, code = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(1000)), "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789+/", k=3000))
    more = [(200, f"{han}\n{code}"), (201, f"{han} {tail}"), (202, f"{code} {tail}"), (203, "x" * 300_000)]
    d = docs.where("doc_id = 45 or doc_id is null").select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    assert d.where("length(text) = 300000").count() == 2 and d.where("doc_id is null").count() == 1
    got = {(r.doc_id, r.line_no): (r.component_doc, r.component_line, r.kept) for r in lines.dedup_lines(d).collect()}
    want = {(None, 0): (None, 0, True), (45, 0): (45, 0, True), (200, 0): (200, 0, True), (200, 1): (200, 1, True)}
    assert got == {**want, (201, 0): (200, 0, False), (202, 0): (200, 1, False), (203, 0): (45, 0, False)}


def test_fuzzy_line_bands_meet(spark):
    """Pairs of 324 shingles each at a similarity of exactly 0.8: three letters differ."""
    assert (1 - 0.8**lines.ROWS) ** lines.BANDS < 1e-3
    rng, rows = random.Random(4), []
    for i in range(1500):
        line = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(48))[:335]
        other = list(line)
        for at in (60, 160, 260):
            other[at] = "Z"
        a, b = ({x[k : k + 12] for k in range(324)} for x in (line, "".join(other)))
        if 5 * len(a & b) == 4 * len(a | b):
            rows += [(2 * i, line), (2 * i + 1, "".join(other))]
    assert len(rows) > 2900
    named = lines.lines_of(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    keys = named.select("doc_id", "h1", "h2").join(lines.signatures(named).select("h1", "h2", F.explode("keys").alias("key")), ["h1", "h2"]).withColumn("pair", F.expr("doc_id div 2"))
    met = keys.groupBy("pair", "key").agg(F.count_distinct("doc_id").alias("n")).where("n = 2").select("pair").distinct().count()
    assert len(rows) // 2 - met <= 5


def test_leaks(spark, docs, texts, monkeypatch):
    items = [("a", " ".join(texts[8].split()[5:30])), ("b", "TWO, words"), ("c", None), ("d", "?!"), ("e", "kappa"), ("b2", texts[20])]
    bench = spark.createDataFrame(items, "item_id string, text string")
    win = {}
    for name, x in items:
        w = alnum(x)
        n = min(10, len(w))
        for j in range(len(w) - n + 1) if w else ():
            win.setdefault(tuple(w[j : j + n]), set()).add(name)
    want = {}
    for i, x in enumerate(texts):
        w, hit, own = alnum(x), set(), set()
        for n in {len(k) for k in win}:
            for j in range(len(w) - n + 1):
                if (key := tuple(w[j : j + n])) in win:
                    hit.update(range(j, j + n))
                    own |= win[key]
        want[i] = (len(w), len(hit), sorted(own))
    for limit in (200_000, 20):
        monkeypatch.setattr(D, "AUTOMATON_WORDS", limit)
        got = D.find_leaks(docs.withColumn("leak", F.lit(1)), bench).collect()
        assert len(got) == len(texts) + 2
        for r in got:
            if r.doc_id is not None:
                assert (r.leak.n_words, r.leak.n_hit, sorted(r.leak["items"])) == want[r.doc_id]
    clean = D.decontaminate(docs, bench)
    assert clean.columns == docs.columns and D.find_leaks(clean, bench).where("leak.n_hit > 0").count() == 0
    same = {r.doc_id: r.text for r in clean.collect()}
    assert all(same[i] == texts[i] for i in same if i is not None and want[i][1] == 0)
    assert D.find_leaks(docs, bench.where("false")).where("leak.n_hit > 0").count() == 0
    assert D.find_leaks(empty(docs), bench).count() == 0


def test_shards(spark, docs, texts):
    many = docs.unionByName(spark.range(1000, 3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot copy")).otherwise(F.concat(F.lit("t"), "id")).alias("text"), F.lit("s").alias("source"), F.lit(0).cast("long").alias("size")))
    many = many.where("text is null or length(text) < 1000")
    out = sharding.shard(many.withColumns({"bin": F.lit("x"), "cuts": F.lit("y")}), parts=8).toPandas()
    assert len(out) == many.count() and set(out.columns) == {"doc_id", "text", "source", "bin", "cuts", "size", "shard", "slot"}
    assert (out.bin == "x").all() and (out.cuts == "y").all()
    g = out.groupby("shard")
    assert (g.slot.max() + 1 == g.slot.nunique()).all() and (g.slot.nunique() == g.size()).all()
    total = g["size"].sum()
    assert len(total) == 8 and (abs(total - total.mean()) < 0.01 * total.mean() + 2 * 400).all()
    assert sharding.shard(empty(docs)).count() == 0


def test_entropy_balance(spark, docs):
    r = random.Random(1)
    rows = [(i, " ".join(["w"] * r.randrange(1, 80)), "abc"[i % 3] if i % 11 else None, 0) for i in range(900)]
    many = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    out = mixing.mix(many.withColumn("rate", F.lit("x")).withColumn("key", F.lit(1))).toPandas()
    assert set(out.columns) == {"doc_id", "text", "source", "rate", "key", "size", "source_size", "target", "copies"}
    assert out.copies.between(0, 3).all() and (out["size"] == out.text.str.split().str.len()).all()
    g = out.assign(taken=out.copies * out["size"], source=out.source.fillna("~")).groupby("source").agg(s=("size", "sum"), ss=("source_size", "first"), t=("target", "first"), k=("taken", "sum"))
    assert (g.s == g.ss).all() and abs(g.t.sum() - g.s.sum()) < 1e-6
    assert (abs(g.k - g.t) <= 2).all()
    left, full = g.s.sum(), set()
    w = dict(zip(sorted(g.index), (5, 2, 1, 5)))
    while True:
        rest, ws = left - sum(3 * g.s[x] for x in full), sum(w[x] for x in w if x not in full)
        t = {x: 3 * g.s[x] if x in full else rest * w[x] / ws for x in w}
        over = {x for x in w if t[x] > 3 * g.s[x] + 1e-9}
        if not over:
            break
        full |= over
    assert all(abs(t[x] - g.t[x]) < 1e-6 for x in w)
    again = mixing.mix(many).toPandas().set_index("doc_id").copies.sort_index()
    assert (again == out.set_index("doc_id").copies.sort_index()).all()
    odd = mixing.mix(docs)
    assert odd.count() == docs.count() and odd.where("text is null and size <> 0").count() == 0
    assert mixing.mix(empty(docs)).count() == 0


def test_toxicity_learns_and_ignores_groups(spark, docs):
    r = random.Random(2)
    rows = []
    for i in range(600):
        bad = i % 4 == 0
        w = r.choices(VOCAB, k=40)
        if bad:
            w[r.randrange(40)] = r.choice(["vilewordA", "vilewordB", "nastyish"])
        if r.random() < (0.6 if bad else 0.2):
            w[r.randrange(40)] = r.choice(["muslim", "christian", "jewish"])
        rows.append((i, " ".join(w), int(bad)))
    t = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(t, t.where("doc_id % 3 <> 1").unionByName(t.limit(1).withColumn("toxic", F.lit(None).cast("int"))))
    got = t.select("doc_id", "toxic", toxicity.score(F.col("text"), model, spark).alias("s")).where("doc_id % 3 = 1").toPandas()
    assert ((got.s >= 0.7) == (got.toxic == 1)).mean() > 0.97
    names = toxicity._hashes(["muslim", "hindu", "christian"])
    weight = {int(f): w for f, w in zip(model.feature, model.weight)}
    own = [weight[int(x)] for x in W.mix(names ^ toxicity._SALT[0])]
    assert max(own) - min(own) < 0.5 * max(model.weight)
    odd = docs.select(toxicity.score(F.col("text"), model, spark).alias("s")).collect()
    assert len(odd) == docs.count() and all(0 <= x.s <= 1 for x in odd)
    flat = toxicity.train(t, t.where("false"))
    assert t.select(toxicity.score(F.col("text"), flat, spark).alias("s")).distinct().count() == 1
    assert toxicity.drop_toxic(empty(t), t).count() == 0


def test_swap_replaces_only_identity_terms():
    table = toxicity._terms()
    terms = dict(zip(toxicity._hashes(list(table)).tolist(), table.values()))
    text = "A Muslim man, née Öz."
    w = W.scan(pa.record_batch({"text": pa.array([text])}), "text", W.ALNUM)
    assert toxicity.swapped(text, w, 0, 0, terms) == "A christian nonbinary, née Öz."
    assert toxicity.swapped("plain", W.scan(pa.record_batch({"text": pa.array(["plain"])}), "text", W.ALNUM), 0, 0, terms) is None


def test_ordinal_grades(spark, docs):
    r = random.Random(4)
    rows = []
    for i in range(500):
        g = i % 4
        w = r.choices(VOCAB, k=50)
        for j in r.sample(range(50), 12 * g):
            w[j] = w[j].upper() + "!!"
        rows.append((i, " ".join(w), g))
    t = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.train(t, t.where("doc_id % 3 <> 1"))
    assert list(model.grades) == [0, 1, 2, 3] and (np.diff(model.threshold) > 0).all()
    got = t.where("doc_id % 3 = 1").select("quality", quality.grade(F.col("text"), model, spark).alias("g")).collect()
    assert np.mean([abs(x.g.expected - x.quality) < 0.5 for x in got]) > 0.9
    odd = docs.select(quality.grade(F.col("text"), model, spark).alias("g")).collect()
    assert len(odd) == docs.count() and all(0 <= x.g.top <= 1 for x in odd)
    one = quality.train(t, t.where("quality = 2"))
    assert t.select(quality.grade(F.col("text"), one, spark).alias("g")).where("g.expected <> 2").count() == 0


@pytest.mark.parametrize("least", [0, 6])
def test_warc_round_trip(spark, least):
    urls = ["http://www.b.example.com/x?q=1#f", "https://b.example.com:443/x?q=1", None, "no url\r\nX-Evil: 1", "http://a.example.org:8080"]
    rows = [(i, urls[i % 5], [None, "", "<p>é</p>", "same body", "b" * 200_000, f"own {i}"][i % 6]) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    folder = Scratch(spark, "t").folder("p")
    warc.write_archives(pages, folder, revisit_from=least)
    got = {r.page_id: r for r in warc.read_records(warc.captures(spark, folder), folder).collect()}
    top = {}
    for i, _, x in rows:
        top[x or ""] = max(i, top.get(x or "", i))
    assert len(got) == 60
    for i, _, x in rows:
        raw = (x or "").encode()
        response = len(raw) < least or top[x or ""] == i
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if response else "revisit", None if response else top[x or ""])
        assert bytes(got[i].payload) == (raw if response else b"")
    found = warc.lookup(spark.createDataFrame([(urls[0],), ("http://none.example.com",), (None,), (urls[4],)], "url string"), folder).collect()
    assert {(r.url, r.page_id) for r in found} == {(u, i) for u in (urls[0], urls[4]) for i, v, _ in rows if v and warc.url_key(v) == warc.url_key(u)}
    blank = Scratch(spark, "t").folder("e")
    warc.write_archives(pages.where("false"), blank)
    assert warc.read_records(warc.captures(spark, blank), blank).count() == 0


def test_url_keys():
    assert warc.url_key("https://WWW.b.Example.com:443/x?y#z") == "com,example,b)/x?y"
    assert warc.url_key("http://[bad") == "http://[bad" and warc.url_key(None) == ""


def test_licenses(spark, docs):
    cases = {
        0: ("MIT License mit license, Apache License!", 3, 0, 4, "apache,mit", "apache,mit"), 1: ("", 0, None, None, "", ""), 2: (None, 0, None, None, "", ""),
        3: ("Gnu General Public License, version 3. SPDX-License-Identifier: MPL-2.0", 1, 0, 0, "gpl", "gpl,mpl"), 4: ("mit licenses, apache", 0, None, None, "", "apache"),
        5: ("CC BY-NC 4.0", 1, 0, 0, "cc-by", "cc-by,cc-by-nc"), 6: ("licensed under the GNU Affero General Public License v3", 0, None, None, "", "agpl"),
        7: ("mit license " * 3000, 3000, 0, 5998, "mit", "mit"), 8: ("GNU lesser general public license", 0, None, None, "", "lgpl"),
    }
    df = spark.createDataFrame([(k, v[0], "x") for k, v in cases.items()], "doc_id long, text string, license string")
    for r in licenses.scan(df).collect():
        _, n, a, b, base, labels = cases[r.doc_id]
        assert (r.license.n_base, r.license.first_word, r.license.last_word, r.license.base_labels, r.license.labels) == (n, a, b, base, labels), r
        assert r.license.n_words == len(alnum(cases[r.doc_id][0])) and 0 <= r.license.score <= 1
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(empty(docs)).count() == 0
    assert len(licenses.rules()) > 200


def test_media_round_trip(spark, docs, texts):
    for n in (0, 1, 63, 64, 65, 4096, 4160, 300_001):
        p = media.padded(bytes(i % 251 for i in range(n)))
        x = media.mux(p)
        t = media.read_tables(x)
        assert media.read_payload(x, t) == p and len(p) % 64 == 0 and t["codec"] == "raw " and t["duration"] == len(p)
        assert all(x[a : a + b] == p[i * 64 : i * 64 + 64] for i, a, b in zip(t["sync"], t["offset"][t["sync"]], t["size"][t["sync"]]))
        assert [q[-1] for q, _, _ in media.walk(memoryview(x))][:3] == [b"ftyp", b"moov", b"mvhd"]
    with pytest.raises(ValueError):
        media.read_tables(x[:100])
    for r in media.digests(media.store(docs)).collect():
        if r.doc_id is not None:
            raw = (texts[r.doc_id] or "").encode()
            assert r.n_bytes == len(raw) and r.payload_sha256 == hashlib.sha256(media.padded(raw)).hexdigest()
    info = media.describe(media.store(docs).withColumn("info", F.lit(1))).select("info.*").collect()
    assert len(info) == docs.count() and all(r.codec == "raw " and r.keyframes for r in info)
    assert media.digests(media.store(empty(docs))).count() == 0

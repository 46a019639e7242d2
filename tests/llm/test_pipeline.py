"""Each stage on its predecessor's rows, against plain versions of what it decides."""

import re

import corpus_pipeline as C
from pyspark.sql import functions as F

from staveforge.llm.toxicity import score, train

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in C.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.toPandas()
        assert name == "sharding" or docs.columns == columns
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    model = train(raw, spark.read.parquet(f"{SF}/labels.parquet"))
    clean = raw.where(score(F.col("text"), model, spark) < 0.7)
    assert set(kept["toxicity"].doc_id) == {r.doc_id for r in clean.select("doc_id").collect()}

    def shingles(x):
        w = re.findall(r"[^\x20\x09-\x0D]+", x.translate(LOW))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    t = kept["toxicity"]
    sets = {i: shingles(x) for i, x in zip(t.doc_id, t.text)}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and 10 * min(len(sets[a]), len(sets[b])) >= 8 * max(len(sets[a]), len(sets[b])) and (k := len(sets[a] & sets[b])) * 100 >= 80 * (len(sets[a]) + len(sets[b]) - k):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    assert set(kept["near_duplicates"].doc_id) == {i for i in ids if root(i) == i}

    bench = spark.read.parquet(f"{SF}/benchmark.parquet").toPandas()
    words = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", x.translate(LOW))
    grams = {tuple(w[i : i + 10]) for w in map(words, bench.text) for i in range(len(w) - 9)}
    hits = lambda x: any(tuple(w[i : i + 10]) in grams for w in [words(x)] for i in range(len(w) - 9))
    before, after = kept["near_duplicates"].set_index("doc_id").text, kept["decontamination"].set_index("doc_id").text
    assert any(map(hits, before)) and not any(map(hits, after))
    assert all(after[i] == x for i, x in before.items() if not hits(x))

    m = kept["mixing"]
    assert m.groupby("doc_id").size().max() <= 3 and set(m.doc_id) <= set(after.index)
    s = kept["sharding"]
    assert len(s) == len(m) and (s.groupby("shard").slot.max() + 1 == s.groupby("shard").size()).all()
    assert C.run(spark, SF).count() == len(s)

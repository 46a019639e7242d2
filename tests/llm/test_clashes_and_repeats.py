"""Columns whose names operators use themselves, and ids that repeat in the tables that models are fitted on."""

from staveforge.llm import decontaminate, licenses, quality, toxicity


def test_own_columns_survive_decontamination(spark):
    items = spark.createDataFrame([("i", "one two three four")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "zero one two three four five six seven eight nine ten", "x", 5)], "doc_id long, text string, __leak string, __LEAK_ int")
    r = decontaminate.decontaminate(docs, items, window=3).collect()[0]
    assert r.asDict() == {"doc_id": 1, "text": "zero   five six seven eight nine ten", "__leak": "x", "__LEAK_": 5}


def test_own_columns_survive_license_scans(spark):
    docs = spark.createDataFrame([(1, "mit license", "a", 2, "c", "d")], "doc_id long, text string, __norm string, __N int, __base string, __rules string")
    r = licenses.scan(docs).collect()[0]
    assert (r["__norm"], r["__N"], r["__base"], r["__rules"]) == ("a", 2, "c", "d") and r.license.base_labels == "mit" and r.license.n_words == 2


def test_repeated_ids_are_fitted_once(spark):
    rows = [(i, f"good text number {i}" if i % 2 else f"bad awful words {i}") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    once, often = (spark.createDataFrame(rows * k + [(3, "zzz")] * (k - 1) * 500, "doc_id long, text string") for k in (1, 2))
    a, b = (quality.train(d, labels) for d in (once, often))
    assert (a.weight == b.weight).all() and (a.cuts == b.cuts).all() if hasattr(a, "cuts") else (a.weight == b.weight).all()
    toxic = labels.withColumnRenamed("quality", "toxic")
    a, b = (toxicity.train(d, toxic) for d in (once, often))
    assert len(a.weight) == len(b.weight) and abs(a.weight - b.weight).max() < 1e-12 and a.bias == b.bias

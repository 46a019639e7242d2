"""Last places of doubles, where a comparison or a text shows them."""

import duckdb
from pyspark.sql import functions as F

from staveforge.functions import exprs as E
from staveforge.operators.frames import quantile


def test_quantile_between_neighbours_one_last_place_apart(spark):
    low, high = -0.018104000000000006, -0.018104000000000002
    values = [low] * 3417 + [high] * 5125
    want = duckdb.execute("SELECT quantile_cont(x, 0.4) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [values]).fetchone()[0]
    rows = [("a", x) for x in values] + [("b", 1.0), ("b", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    assert dict(quantile(df, ["k"], F.col("x"), 0.4, "q").collect()) == {"a": want, "b": 1.0}
    assert df.where("k = 'a'").agg(F.percentile("x", 0.4)).first()[0] != want


def test_round_half_rounds_the_double(spark):
    df = spark.range(20000).select((F.col("id") / 1e4 / 1e3 + F.lit(4.0880005)).alias("x")).union(spark.createDataFrame([(-2.5,), (0.0,), (-0.0000005,)], "x double"))
    got = df.select("x", E.round_half(F.col("x"), 6).alias("y"), F.round("x", 6).alias("decimal")).toPandas()
    want = duckdb.execute("SELECT round(x, 6) AS y FROM got").df()["y"]
    assert (got["y"] == want).all()
    assert (got["decimal"] != want).any()


def test_qa_report_rounds_confidence_as_a_double(spark, monkeypatch):
    from types import SimpleNamespace

    from staveforge.plans import chain_queries as C

    rows = spark.range(20000).select(F.lit("a").alias("recording_id"), F.format_string("n%05d", "id").alias("note_id"), (F.col("id") / 1e6 + F.lit(0.0880005)).alias("confidence"), F.lit("KEEP").alias("plan_action"))
    notes = rows.select("recording_id", "note_id", F.lit(0.0).alias("start_sec"), F.lit(1.0).alias("end_sec"))
    out = notes.select("*", *[F.lit(None).cast("string").alias(c) for c in ("phase_1", "phase_2")], F.lit(False).alias("cut"), F.lit(False).alias("phase_5"))
    monkeypatch.setattr(C, "_stem", lambda t: (rows, None, out, None, None))
    got = C._qa(SimpleNamespace(notes=notes)).select("note_id", "confidence").toPandas().merge(rows.select("note_id", F.col("confidence").alias("x")).toPandas())
    assert (got["confidence"] == duckdb.execute("SELECT round(x, 6) AS y FROM got").df()["y"]).all()

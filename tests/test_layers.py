"""Drum layers: hits of two layers in one transient both stay; spacing by runs equals a plain pass."""

import random

from pyspark.sql import functions as F

from staveforge.operators import drums as D

HIT = "recording_id string, class_name string, hit_id int, onset_sec double, score double"


def test_layered_transient(spark):
    rows = [("a", "kick", 1, 1.00, 0.9), ("a", "hat", 2, 1.01, 0.4), ("a", "hat", 3, 1.05, 0.8), ("a", "kick", 4, 2.0, 0.1)]
    got = D.group_winners(spark.createDataFrame(rows, HIT), ["recording_id", "class_name"], 0.15).where("not suppressed").collect()
    assert sorted(r.hit_id for r in got) == [1, 3, 4]


def plain(rows):
    kept = {}
    for r in sorted(rows, key=lambda r: (r[3], r[2])):
        own = kept.setdefault(r[:2], [])
        gap = 0.5 if r[1] == "kick" else 0.3
        if own and r[3] - own[-1][3] < gap:
            own[-1] = r if r[4] > own[-1][4] else own[-1]
        else:
            own.append(r)
    return sorted(x[2] for own in kept.values() for x in own)


def test_spacing_of_runs_with_a_hot_recording(spark):
    r = random.Random(3)
    rows = [("hot" if r.random() < 0.8 else "b", r.choice(["kick", "hat"]), k, round(r.uniform(0, 120), 2), round(r.random(), 1)) for k in range(900)]
    df = spark.createDataFrame(rows, HIT).repartition(3)
    got = D.keep_spaced(df, ["recording_id", "class_name"], "onset_sec", "score", F.when(F.col("class_name") == "kick", 0.5).otherwise(0.3), "hit_id")
    assert sorted(x.hit_id for x in got.collect()) == plain(rows) and got.columns == df.columns

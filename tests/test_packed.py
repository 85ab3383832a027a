"""Splitting packed fields: shapes of names, quoting, dirt."""

import re

import pytest
from pyspark.sql import functions as F

from biblyst.operators import packed
from biblyst.operators.packed import split_packed

CASES = [
    ("Ann Lee; Bo Ek; ; Cy Fox;", ["Ann Lee", "Bo Ek", "Cy Fox"]),
    ("Lee, A.; Ek, Bo, Jr.; Cy Fox", ["Lee, A.", "Ek, Bo, Jr.", "Cy Fox"]),
    ("U. Melel, Hugo R. Jarik", ["U. Melel", "Hugo R. Jarik"]),
    ("Lee, Ann", ["Lee, Ann"]),
    ("Melel, A. P., & Korov, A. C.", ["Melel, A. P.", "Korov, A. C."]),
    ("W Oltvam, Anne-Marie Ralad, and Hélène Valed", ["W Oltvam", "Anne-Marie Ralad", "Hélène Valed"]),
    ("Patricia B. Ralad III, Theodore Valed, and Jose Pelav", ["Patricia B. Ralad III", "Theodore Valed", "Jose Pelav"]),
    ("Istan, Mike and Gorom, Rebecca", ["Istan, Mike", "Gorom, Rebecca"]),
    ('"Ann ""A"" Lee","Ek, Bo"', ['Ann "A" Lee', "Ek, Bo"]),
    ('"Norag Bank; Research Unit"; Bo Ek', ["Norag Bank; Research Unit", "Bo Ek"]),
    ("Ann  Lee\tBo\tC. Dee", ["Ann Lee", "Bo", "C. Dee"]),
    ("A. Lee/B. Ek|C. Fox；D. Gru\nE. Hu", ["A. Lee", "B. Ek", "C. Fox", "D. Gru", "E. Hu"]),
    ("Kelor, P.；Quil, Rafael, III", ["Kelor, P.", "Quil, Rafael, III"]),
    ("Lee, A.-M., Ek, B.", ["Lee, A.-M.", "Ek, B."]),
    ('""; ;', []),
    ("   ", []),
]


@pytest.mark.parametrize("n", range(len(CASES)))
def test_shapes(spark, n):
    text, want = CASES[n]
    got = split_packed(spark.createDataFrame([(1, text)], "id int, f string"), "f", ["id"]).orderBy("pos").collect()
    assert [r["value"] for r in got] == want
    assert [r["pos"] for r in got] == list(range(1, len(want) + 1))


def test_nulls_repeats_clashing_names_and_long_text(spark):
    long = "; ".join(f"Ann Lee{k}" for k in range(5000))
    df = spark.createDataFrame([(1, None, "x"), (2, "A. Lee; B. Ek", "x"), (2, "A. Lee; B. Ek", "x"), (3, long, None)], "id int, f string, value string")
    got = split_packed(df, "f", ["id"])
    assert got.columns == ["id", "pos", "value"]
    assert got.where("id = 1").count() == 0 and got.where("id = 2").count() == 4 and got.where("id = 3").count() == 5000
    assert split_packed(df.limit(0), "f", ["id"]).count() == 0


def test_long_rules_are_not_broadcast(spark, monkeypatch):
    # few skeletons, but more bytes of rules than the driver should hold
    monkeypatch.setattr(packed, "BROADCAST_BYTES", 10_000, raising=False)
    rows = [(k, ";".join(["Ann Lee"] * (60 + k))) for k in range(20)] + [(60 + k, "Ann Lee; Bo Li") for k in range(300)]
    got = split_packed(spark.createDataFrame(rows, "k long, a string"), "a", ["k"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"BroadcastHashJoin \[skeleton#\d+\], \[skeleton#\d+\], Inner", plan)
    assert got.groupBy("k").agg(F.max("pos").alias("p"), F.count("*").alias("n")).where("p = n").agg(F.count("*"), F.sum("n")).first()[:] == (320, sum(60 + k for k in range(20)) + 600)

"""Places, reshaped tables and scalar rules over small tables."""

import pytest
from pyspark.sql import functions as F

from quire.functions import bibliography as B
from quire.functions import text as T
from quire.operators import explore as X
from quire.operators import graph as G
from quire.operators import ingest as I
from quire.operators import ordering as O
from quire.operators import shapes as H
from quire.operators import similarity as V


def test_places_over_many_ranges(spark):
    rows = spark.range(5000, numPartitions=7).select((F.col("id") * 7919 % 5000).alias("x"), F.lit("a").alias("place_of"))
    out = O.placed(rows, ["x"])
    assert out.columns == ["x", "place_of", "place"]
    assert out.where("place <> x + 1").count() == 0 and out.count() == 5000
    run = O.cumulated(rows, ["x"], {"s": "x"})
    assert run.where("s <> x * (x + 1) div 2").count() == 0
    assert O.placed(rows.limit(0), ["x"]).count() == 0


def test_balanced_groups(spark):
    rows = spark.createDataFrame([("a", i) for i in range(300)] + [("b", i) for i in range(20)] + [(None, i) for i in range(30)], "g string, k long")
    out = V.balanced(rows, "g", "k")
    assert {r[0]: r[1] for r in out.groupBy("g").count().collect()} == {"a": 20, "b": 20, None: 20}
    assert sorted(out.collect(), key=str) == sorted(V.balanced(rows.repartition(5), "g", "k").collect(), key=str)


def test_scores_of_groups(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 2.0), ("c", None)], "g string, x double")
    assert sorted(V.z_scores(rows, "g", "x").collect(), key=str) == sorted([("a", 1.0, -1.0), ("a", 3.0, 1.0), (None, 2.0, None), ("c", None, None)], key=str)


def test_forced_ids(spark):
    rows = spark.createDataFrame([("a", 1), (None, 2), ("", 3), ("b", 4)], "id string, n int")
    assert {tuple(r) for r in I.forced_ids(rows, ["n"]).collect()} == {("a", 1), ("X0001", 2), ("X0002", 3), ("b", 4)}


def test_page_sums(spark):
    cases = {"xi, [1], 216 p.": 228, "216": 216, "[48] p": 48, "8p.": 8, "48]": 48, "xiv,210,[2]p.": 226, "[4], 12 p., 3 plates": 16, "1 sheet": None, "": None, None: None, "mdccl": 1750, "iv; 20": 24}
    out = spark.createDataFrame([(k,) for k in cases], "x string").select("x", B.page_sum(F.col("x"))).collect()
    assert {r[0]: r[1] for r in out} == cases


def test_strings(spark):
    df = spark.createDataFrame([("a,b,",), (",a",), ("",), ("a,,b",), (None,)], "x string")
    assert [r[0] for r in df.select(T.split_keeping("x", ",")).collect()] == [["a,", "b,", ""], [",", "a"], [""], ["a,", ",", "b"], None]
    one = spark.range(1).select(T.hashed(F.lit("a")), T.marks_cut(F.lit("London : ;")), B.prose_or_verse(F.lit("Map"), F.lit("Poetry"), F.lit("Fiction"))).first()
    assert tuple(one) == ("abd37534c7d9a2efb9465de931cd7055ffdb8879563ae98078d6d6d5", "London", "Verse")


def test_flattened(spark):
    df = spark.range(1).select(F.lit(1).alias("a"), F.struct(F.lit(2).alias("c"), F.struct(F.lit(3).alias("e")).alias("d")).alias("b"))
    out = H.flattened(df)
    assert out.columns == ["a", "b_c", "d_e"] and tuple(out.first()) == (1, 2, 3)


def test_widened(spark):
    df = spark.createDataFrame([("a", '{"x": "1", "id": "no"}'), ("b", None), ("c", "")], "id string, meta string")
    assert H.widened(df).orderBy("id").collect() == [("a", "1"), ("b", None), ("c", None)]


def test_triangles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 3), (5, 5)], "src long, dst long")
    assert {r[0]: tuple(r)[1:] for r in G.clustering(edges).collect()} == {1: (2, 1, 1.0), 2: (2, 1, 1.0), 3: (3, 1, 1 / 3), 4: (1, 0, 0.0)}


def test_chosen(spark):
    t = spark.createDataFrame([("1", 1700), ("2", 1800)], "id string, year int")
    assert [r[0] for r in X.chosen({"c": t, "e": t}, "c|1; e|year > 1750").collect()] == ["1", "2"]
    with pytest.raises(ValueError):
        X.chosen({"c": t}, "c")

"""Bibliographic rules and semantic networks on small tables."""

import numpy as np
from pyspark.sql import functions as F

from quire.functions import bibliography as B
from quire.operators import graph as G
from quire.operators import semantics as M
from quire.operators import similarity as V


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_years(spark):
    meta = F.create_map(*[F.lit(x) for x in ("year", "1801", "date_of", "c. 1799-1801", "title", "1700", "year_2", "none")])
    assert one(spark, B.years_of(meta)) == [1799, 1801]
    years = lambda *y: F.array(*[F.lit(x) for x in y])
    assert [one(spark, B.representative_year(years(*range(1, n + 1)))) for n in (1, 4, 5, 6, 7)] == [1, 1, 2, 4, 4]
    assert one(spark, B.marc_year(F.lit("18uu"))) is None and one(spark, B.imprint_year(F.lit("Lond. 1750."))) == 1750


def test_rules(spark):
    df = spark.createDataFrame([("Novels", "", "x"), ("", "English fiction", "x"), ("Poems | Fiction", "", ""), ("Sermons", None, "a novel"), ("", "", "")], "form string, topic string, title string")
    rules = [("form", "novels", "Fiction"), ("form", "fiction", "Fiction"), ("form", "poems", "Poetry"), ("topic", "fiction", "Fiction"), ("title", "novel", "Fiction")]
    got = [(r.genres, r.genre_source) for r in B.classified(df, rules).collect()]
    assert got == [(["Fiction"], "form"), (["Fiction"], "topic"), (["Fiction", "Poetry"], "form"), (["Fiction"], "title"), ([], None)]


def test_strings(spark):
    words = lambda s: F.split(F.lit(s), " ")
    assert one(spark, B.token_set_ratio(words("the great gatsby"), words("gatsby the great novel"))) == 100
    assert one(spark, B.token_set_ratio(words("a"), words("z"))) == 0
    spelt = F.create_map(F.lit("vertue"), F.array(F.lit("vertue"), F.lit("virtue")))
    assert one(spark, B.variants(words("of vertue"), spelt)) == ["of vertue", "of virtue"]
    assert one(spark, B.detokenised(words("Well , ( yes ) !"))) == "Well, (yes)!"
    assert [one(spark, B.coerced(F.lit(x))) for x in ("12", "1.5", "x1", "3.0")] == ["12", "1.5", "x1", "3"]
    assert one(spark, B.volume_id(F.lit("uc1/ark+=13960=t0.json"))) == "uc1.ark:/13960/t0"
    assert one(spark, B.translated(F.array(F.lit("Translator")), F.lit(None).cast("string"), F.lit("x"))) == "relator"
    assert one(spark, B.translated(F.lit(None).cast("array<string>"), F.lit("Candide. English"), F.lit("x"))) == "uniform_title"
    assert one(spark, B.translated(F.lit(None).cast("array<string>"), F.lit(None).cast("string"), F.lit("done into English"))) == "phrase"


def test_networks(spark):
    near = spark.createDataFrame([("a", "b", 0.9), ("b", "a", 0.9), ("b", "c", 0.8), ("c", "a", 0.8), ("x", "y", 0.7), ("a", "y", 0.1)], "word string, neighbour string, similarity double")
    edges = M.network(near, 0.5)
    assert edges.count() == 4 and M.network(near, 0.5, 2).count() == 3
    assert {(r.src, r.dst) for r in M.giant(edges).collect()} == {("a", "b"), ("b", "c"), ("a", "c")}
    parts = M.partitions(edges)
    assert len({r.part for r in parts.where("node in ('a', 'b', 'c')").collect()}) == 1
    assert sum(r.n for r in M.blocks(edges, parts).collect()) == 4
    assert {r.word: r.n for r in M.hubness(near).collect()} == {"a": 2, "b": 1, "c": 1, "y": 2}


def test_graph_texts(spark):
    df = spark.createDataFrame([("Emma --> (friend)Harriet[1]; (loves)Knightley[2];",)], "rel string")
    assert {tuple(r) for r in G.static_edges(df, "rel").collect()} == {("Emma", "friend", "Harriet", "1"), ("Emma", "loves", "Knightley", "2")}
    weights = spark.createDataFrame([("a", "b", 2.0), ("a", "c", 50.0)], "src string, dst string, weight double")
    assert {r.dst: r.weight for r in G.rescaled(weights, 10).collect()} == {"b": 1.0, "c": 10.0}


def test_vocabulary_and_axes(spark):
    r = np.random.default_rng(2)
    vectors = spark.createDataFrame([(f"w{k}", v.tolist()) for k, v in enumerate(r.standard_normal((8, 3)))], "word string, v array<double>")
    counts = spark.createDataFrame([(f"w{k}", k) for k in range(8)], "word string, n int")
    assert M.limited(vectors, counts, 3).count() == 5 and M.limited(vectors, counts, 0, 2).count() == 2
    scores = M.on_axis(vectors, M.axis(vectors, ["w0"], ["w1"]))
    assert scores.where("word = 'w0'").first().score > scores.where("word = 'w1'").first().score
    assert M.axis_statistics(scores).first().variance > 0
    assert M.displacement(vectors, vectors).agg({"distance": "max"}).first()[0] < 1e-9
    assert V.report(spark.createDataFrame([(1.0, 0.9), (0.0, 0.8), (1.0, 0.1)], "label double, p double")).first().precision == 0.5


def test_families_of_copies(spark):
    """A family of 60 copies, near copies and loners, against all pairs; a text's nearest are k others, ties by id."""
    import numpy as np

    from quire.operators import similarity as V

    rng = np.random.default_rng(5)
    x = rng.random((12, 40)) * (rng.random((12, 40)) < 0.4)
    x = np.concatenate([np.repeat(x[:1], 60, axis=0), x, x[1:5] + 0.02 * (rng.random((4, 40)) < 0.2)])
    x = x[x.any(axis=1)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = [f"t{k:03d}" for k in rng.permutation(len(x))]
    rows = [(ids[a], f"w{b:02d}", float(x[a, b])) for a in range(len(x)) for b in range(40) if x[a, b]]
    got = sorted(tuple(r) for r in V.duplicates(spark.createDataFrame(rows, "_id string, word string, weight double"), 10, 0.8).collect())
    near, wanted = np.round(x @ x.T, 6), set()
    for a in range(len(x)):
        best = sorted((-near[a, b], ids[b]) for b in range(len(x)) if b != a and near[a, b] >= 0.8)[:10]
        wanted |= {(min(ids[a], i), max(ids[a], i), round(-s, 4)) for s, i in best}
    assert got == sorted(wanted) and len(got) > 500


def test_joins_keep_rows(spark):
    from quire.operators import links as L

    left = spark.createDataFrame([(1, "abcx"), (1, "abcx"), (2, "zz"), (3, None)], "k long, c string")
    codes = spark.createDataFrame([("ab",), ("abc",), ("abc",), (None,)], "code string")
    assert sorted((r.k, r.code) for r in L.longest_prefix(left, "c", codes, "code", (2, 3)).collect() if r.code) == [(1, "abc"), (1, "abc")]
    assert L.longest_prefix(left, "c", codes, "code", (2, 3)).count() == 4
    right = spark.createDataFrame([(1, "b"), (1, "a"), (2, None)], "k long, v string")
    assert sorted((r.k, r.v) for r in L.coalesced(left, [(right, "k", "k")], "v").na.fill("-").collect()) == [(1, "a"), (1, "a"), (2, "-"), (3, "-")]
    human = spark.createDataFrame([(1, "y", "v2"), (1, "y", "v1"), (2, "n", None)], "k long, is_match string, verified string")
    assert sorted((r.k, r.c) for r in L.verified(left, human, "k", "c").na.fill("-").collect()) == [(1, "v1"), (1, "v1"), (2, ""), (3, "-")]


def test_a_table_too_large_for_a_driver_file_is_refused(spark, tmp_path, monkeypatch):
    import pytest

    from quire.sources import sinks as K

    monkeypatch.setattr(K, "DRIVER_ROWS", 5)
    with pytest.raises(ValueError, match="at most 5"):
        K.write(spark.range(6), str(tmp_path / "x.pkl"))


def test_medians_count_zeros(spark):
    """Medians and U over dense columns, against numpy."""
    import numpy as np

    from quire.operators import words as W

    rng = np.random.default_rng(2)
    x = np.round(rng.random((23, 4)) * (rng.random((23, 4)) < [0.2, 0.6, 0.9, 0.5]), 2)
    group = ["a" if k < 12 else "b" for k in range(23)]
    long = spark.createDataFrame([(str(k), f"w{j}", float(x[k, j])) for k in range(23) for j in range(4) if x[k, j]], "_id string, word string, tf double")
    groups = spark.createDataFrame([(str(k), g) for k, g in enumerate(group)], "_id string, group string")
    words = spark.createDataFrame([(f"w{j}",) for j in range(4)], "word string")
    a, b = x[:12], x[12:]
    got = {(r.group, r.word): r["median"] for r in W.group_medians(long, groups, words).collect()}
    assert all(abs(got[g, f"w{j}"] - np.median(v[:, j])) < 1e-9 for g, v in (("a", a), ("b", b)) for j in range(4))
    for r in W.mann_whitney(long, groups).collect():
        j = int(r.word[1])
        u = sum((p > q) + 0.5 * (p == q) for p in a[:, j] for q in b[:, j])
        _, t = np.unique(x[:, j], return_counts=True)
        sd = np.sqrt(12 * 11 / 12 * (24 - (t**3 - t).sum() / (23 * 22)))
        assert abs(r.u - u) < 1e-9 and abs(r.z - (u - 66) / sd) < 1e-9 and 0 <= r.p <= 1 and abs(r.group1_mean - a[:, j].mean()) < 1e-9


def test_manual_links(spark):
    from quire.operators import curation as U

    pairs = spark.createDataFrame([("a", "b", 0.5, "fuzzy_title")], "a string, b string, similarity double, tier string")
    new = spark.createDataFrame([("b", "a"), ("d", "c"), ("c", "d"), ("e", "e")], "a string, b string")
    assert sorted(map(tuple, U.link(pairs, new).collect())) == [("a", "b", 1.0, "manual"), ("c", "d", 1.0, "manual")]
    assert U.unlink(pairs, new).count() == 0

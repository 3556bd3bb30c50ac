"""Operators against brute force, and sources and sinks against what was written."""

import gzip
import json
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions import udfs
from quire.operators import explore as X
from quire.operators import graph as G
from quire.operators import ingest as I
from quire.operators import links as L
from quire.operators import matching as M
from quire.operators import sections as C
from quire.operators import sets as Z
from quire.operators import similarity as V
from quire.operators import words as W
from quire.sources import readers as R
from quire.sources import sinks as K
from quire.streaming import counts as SC


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def union_find(pairs):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    r = random.Random(seed)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(150)]
    pairs = [(a, b) for a, b in pairs if a != b] + [(1000 + k, 1001 + k) for k in range(40)]
    got = {x.node: x.component for x in G.components(edges(spark, pairs)).collect()}
    assert got == union_find(pairs)
    assert G.components(edges(spark, [])).count() == 0


def test_k_core(spark):
    r = random.Random(3)
    pairs = [(r.randrange(40), r.randrange(40)) for _ in range(120)]
    around = {}
    for a, b in pairs:
        if a != b:
            around.setdefault(a, set()).add(b)
            around.setdefault(b, set()).add(a)
    while weak := [x for x, n in around.items() if len(n) < 4]:
        for x in weak:
            for y in around.pop(x):
                if y in around:
                    around[y].discard(x)
    assert {x.node for x in G.k_core(edges(spark, pairs), 4).collect()} == set(around)


def test_dynamic_edges(spark):
    df = spark.createDataFrame([("a,b>c",), ("x<y",), ("p<>q",), ("none",)], "rel string")
    assert {(r.src, r.dst) for r in G.dynamic_edges(df, "rel").collect()} == {("a", "c"), ("b", "c"), ("y", "x"), ("p", "q"), ("q", "p")}


def packed(sentences, n):
    out, held, at = [], [], 0
    for s in sentences:
        held.append(s)
        size = sum(len(h.split()) for h in held)
        if size >= n:
            out.append((at, at + size, " ".join(held)))
            at, held = at + size, []
    if held:
        size = sum(len(h.split()) for h in held)
        out.append((at, at + size, " ".join(held)))
    return out


def test_passages(spark):
    r = random.Random(5)
    text = " ".join(" ".join("w" * r.randint(1, 5) for _ in range(r.randint(1, 9))) + r.choice([".", "!", "?"]) for _ in range(40))
    df = spark.createDataFrame([("a", text), ("b", ""), ("c", "no end")], "_id string, text string")
    got = {}
    for row in C.passages(df, 12).collect():
        got.setdefault(row._id, []).append((row.start, row.end, row.passage))
    sentences = [s.sentences for s in df.where("_id = 'a'").select(T.sentences("text").alias("sentences")).collect()][0]
    assert sorted(got["a"]) == packed(sentences, 12)
    assert " ".join(sentences) == text
    assert "b" not in got and got["c"] == [(0, 2, "no end")]


@given(st.text(alphabet="abcd", max_size=8), st.text(alphabet="abcd", max_size=8))
def test_jaro_winkler_properties(a, b):
    f = udfs.jaro_winkler_similarity
    assert 0 <= f(a, b) <= 1 and abs(f(a, b) - f(b, a)) < 0.2 and f(a, a) == 1.0


def test_ingest(spark):
    rows = spark.createDataFrame(
        [("t001", "Pride and Prejudice", "Austen, Jane", "1813", "Fiction", "Novel", "x"), ("t002", "Sense and Sensibility", "Austen, Jane", "1811", "Fiction", "Novel", ""), ("t003", "Frankenstein", "Shelley, Mary", "1818", "Fiction", "Novel, Gothic", None), ("t004", "The Monk", "Lewis, Matthew", "1796", "Fiction", "Novel, Gothic", "nan"), ("t004", "again", "B", "1", "x", "x", "x"), ("", "no id", "B", "1", "x", "x", "x"), (None, "no id", "B", "1", "x", "x", "x")],
        "id string, title string, author string, year string, genre string, genre_raw string, note string",
    )
    got = {r.id: r for r in I.ingest(rows.coalesce(1), "test_corpus").collect()}
    assert set(got) == {"t001", "t002", "t003", "t004"} and got["t004"].title == "The Monk"
    assert got["t001"]._id == "_test_corpus/t001" and got["t001"].author_norm == "austen" and got["t001"].year == 1813
    assert json.loads(got["t001"].meta) == {"note": "x"} and json.loads(got["t002"].meta) == {}
    assert [r.id for r in got.values() if r.year < 1800] == ["t004"]


def test_dedup_is_idempotent(spark):
    df = spark.createDataFrame([("a", "g", 2), ("b", "g", 1), ("c", None, 1), ("d", None, 1)], "_id string, grp string, year int")
    once = W.kept_by(df, "grp", [F.col("year"), F.col("_id")])
    assert {r._id for r in once.collect()} == {"b", "c", "d"} == {r._id for r in W.kept_by(once, "grp", [F.col("year"), F.col("_id")]).collect()}


def test_first_tier_wins_and_pairs_are_ordered(spark):
    one = spark.createDataFrame([("a", "b", 1.0, "exact_norm")], "a string, b string, similarity double, tier string")
    two = spark.createDataFrame([("a", "b", 0.5, "containment"), ("b", "c", 0.5, "containment")], "a string, b string, similarity double, tier string")
    got = {(r.a, r.b): r.tier for r in M.first_tier(one, two).collect()}
    assert got == {("a", "b"): "exact_norm", ("b", "c"): "containment"}


def test_expression_terms():
    assert W.terms("a+b-c, d") == [("a+b-c", [("a", 1), ("b", 1), ("c", -1)]), ("d", [("d", 1)])]


def test_prefixed_and_ranked_keys(spark):
    df = spark.range(1).select(F.create_map(*[F.lit(x) for x in ("date_2", "1800", "date_1", "", "note", "n")]).alias("m"))
    assert df.select(X.prefixed_key(F.col("m"), "date").alias("v")).first().v == "1800"
    assert spark.range(1).select(X.ranked_key([F.lit(""), F.lit("a|b")]).alias("v")).first().v == "a"


def test_ids(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), ("", 4)], "id string, k int")
    assert [r.id for r in I.versioned_ids(df.where("k < 3"), ["k"]).orderBy("k").collect()] == ["a", "a/v2"]
    assert [r.id for r in I.forced_ids(df, ["k"]).orderBy("k").collect()] == ["a", "a", "X0001", "X0002"]
    assert I.corpus_info(df.withColumn("corpus", F.lit("x")), 1.5).first().n_texts == 4


def test_layers_and_cleaning(spark):
    strong = spark.createDataFrame([("1", "new", "")], "id string, title string, genre string")
    base = spark.createDataFrame([("1", "old", "Poetry", "1800"), ("2", "two", "nan", "18xx")], "id string, title string, genre string, year string")
    got = {r.id: r for r in R.layered([strong, base]).collect()}
    assert (got["1"].title, got["1"].genre, got["1"].year) == ("new", "Poetry", "1800")
    clean = {r.id: r for r in R.clean_metadata(base).collect()}
    assert clean["2"].genre is None and clean["2"].year is None and clean["2"].year_orig == "18xx" and clean["1"].year == 1800


def test_readers(spark, tmp_path):
    (tmp_path / "m.csv").write_text("id,title\n1,One\n2,Two\n")
    assert R.metadata(spark, str(tmp_path / "m.csv")).count() == 2
    assert R.annotated_path(str(tmp_path / "m.csv")).endswith("m.csv")
    (tmp_path / "m.anno.csv").write_text("id,title\n1,Uno\n")
    assert R.annotated_path(str(tmp_path / "m.csv")).endswith("m.anno.csv")
    (tmp_path / "m.tsv").write_text("id\ttitle\n1\tOne\n")
    assert R.metadata(spark, str(tmp_path / "m.tsv")).first().title == "One"
    (tmp_path / "m.jsonl").write_text('{"id": 1}\n{"id": 2}\n')
    assert R.metadata(spark, str(tmp_path / "m.jsonl")).count() == 2
    with pytest.raises(ValueError):
        R.metadata(spark, "m.unknown")
    folder = tmp_path / "freqs"
    folder.mkdir()
    (folder / "a.json").write_text('{"the": 3, "of": 1}')
    with gzip.open(folder / "b.json.gz", "wt") as f:
        f.write('{"the": 2}')
    (folder / "c.json").write_text("broken")
    assert {(r.id, r.word, r["count"]) for r in R.frequencies(spark, str(folder)).collect()} == {("a", "the", 3), ("a", "of", 1), ("b", "the", 2)}
    (tmp_path / "f.tsv").write_text("The\t2\nthe\t1\nbad\n")
    assert [tuple(r) for r in R.tsv_frequencies(spark, str(tmp_path / "f.tsv")).collect()] == [("the", 3)]
    (tmp_path / "s.tsv").write_text("vertue\tvirtue\nx\n")
    assert R.spelling_map(spark, str(tmp_path / "s.tsv")).count() == 1
    for kind, body in (("txt", "plain text"), ("xml", "<p>marked text</p>")):
        (tmp_path / kind).mkdir()
        (tmp_path / kind / f"{kind}1.{kind}").write_text(body)
    ids = spark.createDataFrame([("txt1",), ("xml1",), ("none",)], "id string")
    got = {r.id: r.text for r in R.texts_or_xml(spark, ids, str(tmp_path / "txt"), str(tmp_path / "xml")).collect()}
    assert got == {"txt1": "plain text", "xml1": "marked text", "none": ""}
    walk = tmp_path / "walk" / "t1"
    walk.mkdir(parents=True)
    (walk / "meta.json").write_text('{"title": "T"}')
    assert R.json_walk(spark, str(tmp_path / "walk")).first().id == "t1"
    record = {"id": "r1", "fields": [{"tag": "245", "subfields": [{"code": "a", "value": "Title"}]}, {"tag": "260", "subfields": [{"code": "c", "value": "[1799]"}]}]}
    (tmp_path / "marc.json").write_text(json.dumps(record))
    got = R.marc_json(spark, str(tmp_path / "marc.json")).first()
    assert (got.title, got.year, got.author) == ("Title", 1799, None)
    (tmp_path / "marc.xml").write_text("<c><record><id>1</id></record><record><id>2</id></record></c>")
    assert R.marc_xml(spark, str(tmp_path / "marc.xml")).count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "1", "x"), ("b", "1", "y")], "corpus string, id string, v string")
    for kind in ("csv", "tsv", "jsonl", "parquet"):
        K.write(df, str(tmp_path / f"out.{kind}"))
        assert R.metadata(spark, str(tmp_path / f"out.{kind}")).count() == 2
    K.replace_corpus(df, str(tmp_path / "texts"))
    K.replace_corpus(df.where("corpus = 'a'").withColumn("v", F.lit("new")), str(tmp_path / "texts"))
    assert {(r.corpus, r.v) for r in spark.read.parquet(str(tmp_path / "texts")).collect()} == {("a", "new"), ("b", "y")}
    K.write_frequencies(df, str(tmp_path / "freqs"))
    assert spark.read.parquet(str(tmp_path / "freqs")).count() == 2
    new = spark.createDataFrame([("c", "1", "z"), ("c", "2", "w")], "corpus string, id string, v string")
    assert {r.id: r.corpus for r in K.upsert(df.where("corpus = 'a'"), new, "id").collect()} == {"1": "a", "2": "c"}
    assert {r.id: r.corpus for r in K.upsert(df.where("corpus = 'a'"), new, "id", old_wins=False).collect()} == {"1": "c", "2": "c"}
    store = str(tmp_path / "kv")
    K.put(spark, store, "k", "1", 1.0)
    K.put(spark, store, "k", "2", 2.0)
    K.put(spark, store, "gone", "1", 1.0)
    K.put(spark, store, "gone", None, 2.0)
    assert [tuple(r) for r in R.key_values(spark, store).collect()] == [("k", "2")]


def test_links_and_sets(spark):
    left = spark.createDataFrame([("1", "A"), ("2", None)], "id string, ref string")
    right = spark.createDataFrame([("a", "t"), ("a", "u")], "id string, title string")
    got = L.linked(left, right, "ref", "id", "other", F.lower).orderBy("id").collect()
    assert [(r.id, r.other_title) for r in got] == [("1", "t"), ("2", None)]
    a, b = spark.createDataFrame([(1,), (2,)], "x int"), spark.createDataFrame([(2,), (3,)], "x int")
    assert [r.x for r in Z.intersection([a, b]).collect()] == [2] and [r.x for r in Z.without(a, b).collect()] == [1]
    assert spark.range(1).select(Z.last_non_empty(F.lit("a"), F.lit(""), F.lit(None)).alias("v")).first().v == "a"
    assert spark.range(1).select(Z.appended(F.array(F.lit(1)), F.array(F.lit(2), F.lit(1))).alias("v")).first().v == [1, 2]


def test_vectors(spark):
    import numpy as np

    r = np.random.default_rng(1)
    turn = np.linalg.qr(r.standard_normal((4, 4)))[0]
    x = r.standard_normal((30, 4))
    base = spark.createDataFrame([(str(k), v.tolist()) for k, v in enumerate(x)], "word string, v array<double>")
    other = spark.createDataFrame([(str(k), (v @ turn.T).tolist()) for k, v in enumerate(x)], "word string, v array<double>")
    assert np.allclose((x @ turn.T) @ V.procrustes(base, other), x)
    near = V.analogy(base, ["0"], [], 1).first()
    cos = (x / np.linalg.norm(x, axis=1)[:, None]) @ (x[0] / np.linalg.norm(x[0]))
    cos[0] = -2
    assert near.word == str(int(cos.argmax()))
    df = spark.createDataFrame([([1.0, 1.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert df.select(V.rejected(F.col("a"), F.col("b")).alias("v")).first().v == [0.0, 1.0]
    rows = spark.createDataFrame([(k, k % 2, float(k % 2) + 0.01 * (k % 7)) for k in range(120)], "id long, label int, f double")
    scored = V.cross_validated(rows, ["f"], "label")
    assert scored.count() == 120 and V.report(scored).first().f1 > 0.9
    assert V.sample(rows, 5, "id").count() == 5 and {r["count"] for r in V.balanced(rows.where("id < 51"), "label", "id").groupBy("label").count().collect()} == {25}


def test_streams(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    batches = [["one two two"], ["two three"]]
    for k, texts in enumerate(batches):
        spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).write.mode("append").parquet(str(source))
        SC.count_words(SC.text_stream(spark, str(source), "text string", 1), out, str(tmp_path / "state")).awaitTermination()
        if k == 0:
            assert {r.word: r.n for r in SC.counted(spark, out).collect()} == {"one": 1, "two": 2}
    assert {r.word: r.n for r in SC.counted(spark, out).collect()} == {"one": 1, "two": 3, "three": 1}
    spark.createDataFrame([("a", "1")], "corpus string, id string").write.parquet(str(tmp_path / "c1"))
    SC.replace_corpora(SC.text_stream(spark, str(tmp_path / "c1"), "corpus string, id string"), str(tmp_path / "c2"), str(tmp_path / "c3")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "c2")).count() == 1

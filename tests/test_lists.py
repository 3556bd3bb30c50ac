"""Lists of texts, marked-up texts and graph files, on rows written by hand."""

from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from quire.functions import markup as U
from quire.operators import lists as L
from quire.sources import readers as R
from quire.sources import sinks as K


def one(spark, value):
    return spark.range(1).select(value.alias("v")).first().v


@pytest.mark.parametrize(
    ("letter", "recip", "sender"),
    [
        ("", [], []),
        ("no names at all to be found", [], []),
        ("Anna Howe to Clarissa", ["Clarissa"], ["Anna Howe"]),
        ("Anna wrote to Bella and then to Clara", ["Bella", "Clara"], ["Anna", "Bella"]),
        ("this is from Mr. Lovelace", [], ["Mr. Lovelace"]),
        ("To Élise d' Or", ["Élise"], []),
    ],
)
def test_roles(spark, letter, recip, sender):
    got = one(spark, L.roles(F.split(F.lit(letter), " ")))
    assert (got.recip, got.sender) == (recip, sender)


def test_older_annotations(spark):
    got = one(spark, L.annotations_loaded(F.lit('{"_a/1": {"genre": "Fiction"}, "_a/2": {"genre_source": "llm", "notes": "x"}}')))
    assert got == [{"_id": "_a/1", "genre_source": "human", "genre": "Fiction"}, {"_id": "_a/2", "genre_source": "llm", "notes": "x"}]
    assert one(spark, L.annotations_loaded(F.lit('[{"_id": "_a/1", "genre": "x"}]'))) == [{"_id": "_a/1", "genre": "x"}]
    assert one(spark, L.annotations_loaded(F.lit("[]"))) == [] and one(spark, L.annotations_loaded(F.lit("{}"))) == []


def test_edges_and_removal(spark):
    edges = spark.createDataFrame([("a", "b", "rdf:type", ""), ("a", "b", "other", "n")], "src string, dst string, rel string, yn string")
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "c"), (None, "a")], "src string, dst string")
    got = L.edges_added(edges, pairs, yn="y")
    assert sorted(map(tuple, got.collect())) == [("a", "b", "other", "n"), ("a", "b", "rdf:type", "y"), ("b", "a", "rdf:type", "y")]
    assert L.edges_added(got, pairs, yn="y").count() == 3
    texts = spark.createDataFrame([("a", 1), ("b", 2)], "_id string, n int")
    left, rest = L.removed(texts, got, spark.createDataFrame([("b",), ("b",)], "_id string"))
    assert [tuple(r) for r in left.collect()] == [("a", 1)] and rest.count() == 0


def test_a_graph_file_is_xml(spark, tmp_path):
    path = f"{tmp_path}/graph"
    rows = [("a & b", 'say "x"', 2.0), ("<c>", "a & b", 1.0)]
    K.write_gexf(spark.createDataFrame(rows, "src string, dst string, weight double").repartition(3), "file://" + path)
    text = "\n".join(p.read_text() for p in sorted(tmp_path.glob("graph/part-*")))
    tree = ElementTree.fromstring(text.encode())
    assert sorted((e.get("source"), e.get("target"), float(e.get("weight"))) for e in tree.iter("edge")) == sorted(rows)
    assert {n.get("id") for n in tree.iter("node")} == {"a & b", 'say "x"', "<c>"}
    assert sorted(map(tuple, R.gexf_edges(spark, "file://" + path).collect())) == sorted(rows)


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "x").mkdir()
    for name in ("a.json", "x/b.json.gz"):
        (tmp_path / name).write_text("{}")
    listing = R.listing(spark, f"file://{tmp_path}")
    assert sorted(r.path for r in listing.collect()) == ["a.json", "x/b.json.gz"]
    ids = spark.createDataFrame([("a",), ("x/b",), ("c",)], "id string")
    assert {r.id: r.path for r in L.file_paths(ids, listing, [".json", ".json.gz"]).collect()} == {"a": "a.json", "x/b": "x/b.json.gz", "c": None}


def test_markup(spark):
    text = F.lit("<HEAD class='x'>a\nb</HEAD><header>c</header>d")
    assert one(spark, U.without_tags(text, ["head"])) == "<header>c</header>d"
    assert one(spark, U.header(F.lit(""))).year == 0 and one(spark, U.header(F.lit("<BIBLFULL><DATE>1 701, i.e. 1702</DATE></BIBLFULL>"))).year == 1701
    assert one(spark, U.speeches(F.lit("<p>x</p>"))) == ""
    assert one(spark, U.first_of(F.lit(None).cast("string"), F.lit(" \n"), F.lit(" x "))) == "x"


def test_words_to_correct(spark):
    index = spark.createDataFrame([("t", "fuch", 2), ("t", "such", 3), ("t", "of", 1)], "_id string, word string, count long")
    fixes = spark.createDataFrame([("fuch", "such"), ("fuch", "tuch")], "old string, new string")
    assert sorted(map(tuple, L.corrected(index, fixes).collect())) == [("t", "of", 1), ("t", "such", 5)]

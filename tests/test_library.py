"""Corpora from manifests, and a library built of them."""

import pytest
from pyspark.sql import functions as F

from quire.__main__ import main
from quire.library import Library
from quire.sources import corpora as C


@pytest.fixture(scope="module")
def known(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpora")
    one, two = root / "one", root / "two"
    (one / "txt").mkdir(parents=True)
    two.mkdir()
    (one / "metadata.csv").write_text('id,title,author,year,genre\nblake_songs,Songs of Innocence,William Blake,1794,Poetry\nausten_pride,Pride and Prejudice,"Austen, Jane",1813,Fiction\nshelley_frank,Frankenstein: a tale,"Shelley, Mary",1818,Fiction\nausten_again,Pride and Prejudice,"Austen, Jane",1815,Fiction\n')
    for name, text in (("blake_songs", "the lamb the tyger"), ("austen_pride", "the truth the truth acknowledged"), ("shelley_frank", "the creature")):
        (one / "txt" / f"{name}.txt").write_text(text)
    (two / "metadata.csv").write_text("id,ref_id,format,pages\nedition_austen,austen_pride,octavo,432\nedition_shelley_1,shelley_frank,duodecimo,280\nedition_shelley_2,shelley_frank,octavo,312\n")
    (root / "first.txt").write_text(f"[one]\nroot = /nowhere\n[two]\nroot = {two}\nlinks = one:ref_id=id\n")
    (root / "second.txt").write_text(f"[one]\nroot = {one}\n")
    return C.registered(str(root / "first.txt"), str(root / "second.txt")), root


def test_links(spark, known):
    corpora, _ = known
    merged = {r.id: r for r in corpora["two"].linked(spark, corpora).collect()}
    assert merged["edition_austen"].one_author == "Austen, Jane" and merged["edition_shelley_2"].one_title == "Frankenstein: a tale"
    back = lambda i: corpora["one"].linking(spark, corpora["two"], spark.createDataFrame([(i,)], "id string")).count()
    assert [back(i) for i in ("shelley_frank", "austen_pride", "blake_songs", "unknown")] == [2, 1, 0, 0]


def test_library(spark, known, tmp_path, capsys):
    corpora, _ = known
    library = Library(spark, str(tmp_path))
    broken = C.Corpus("broken", "/nowhere")
    assert list(library.rebuild([*corpora.values(), broken])) == ["broken"]
    library.rebuild([corpora["one"]])
    assert library.table("texts").count() == 7
    assert library.get("_one/austen_pride")["author_norm"] == "austen" and library.get("_one/none") is None
    assert library.get("_two/edition_austen")["pages"] == "432"
    library.index([corpora["one"]])
    got = {(r.period, r.word): r.raw_count for r in library.ngram(["the", "truth"]).collect()}
    assert got == {(1790, "the"): 2, (1810, "the"): 3, (1810, "truth"): 2}
    library.match(fuzzy=True)
    assert library.texts("oldest", genre="Fiction").where(F.col("title") == "Pride and Prejudice").first().year == 1813
    assert library.texts("rank", genre="Fiction").count() == 2 and library.texts(genre="Fiction", year_min=1814).count() == 2
    assert library.matches("pride").count() == 2 and library.info().count() == 2
    assert library.query("SELECT count(*) AS n FROM texts JOIN groups USING (_id)").first().n == 2
    main([str(tmp_path), "info"])
    assert "one" in capsys.readouterr().out

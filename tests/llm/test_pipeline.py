"""The pipeline's stages, each on its predecessor's rows."""

import re

import awkward
import pytest
from oracle import DATA

import corpus_pipeline as P
from quire.llm import jaccard, mixing, packing, toxicity
from quire.llm.common import materialize

SMALL = f"{DATA}/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = P.read(spark, SMALL, "documents"), []
    for name, stage in P.STAGES:
        new = materialize(stage(spark, docs, SMALL), name)
        out.append((name, docs, new))
        docs = new
    return out


def test_order_and_columns(steps):
    assert [n for n, _, _ in steps] == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"]
    assert all(new.columns == docs.columns for _, docs, new in steps[:-1])


def test_toxicity(spark, steps):
    _, docs, new = steps[0]
    scored = toxicity.score(docs, toxicity.train_from(spark, SMALL, docs))
    assert {r.doc_id for r in new.collect()} == {r.doc_id for r in scored.where("predicted = 0").collect()}


def test_one_of_each_group(spark, steps):
    _, docs, new = steps[1]
    found = jaccard.jaccard_components(docs).collect()
    assert sorted(r.doc_id for r in new.collect()) == sorted({r.component_id for r in found})


def test_secrets(steps):
    _, docs, new = steps[2]
    old, now = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.text for r in new.collect()}
    pattern = r'token = "[0-9a-f]{40}"'
    assert old.keys() == now.keys() and not any(re.search(pattern, t or "") for t in now.values())
    assert all(now[i] == t for i, t in old.items() if not re.search(r"[A-Za-z0-9_+/=.-]{16,}|PRIVATE KEY", t or ""))


def test_mixing(steps):
    _, docs, new = steps[3]
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    taken = {}
    for r in new.collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + words(r.text)
    assert taken == {r.doc_id: r.taken for r in mixing.mix_sources(docs).collect() if r.taken}


def test_packing(steps):
    _, docs, new = steps[4]
    library = packing.encoder(packing.default_path()).tokenizer
    wanted = sorted(tuple(library.encode(r.text or "", add_special_tokens=False).ids) + (1,) for r in docs.collect())
    ids, rows = {}, new.collect()
    for r in rows:
        ids.setdefault(r.sequence_id, {})[r.offset] = r.ids
    for sequence in ids.values():
        at = 0
        for offset in sorted(sequence):
            assert offset == at
            at += len(sequence[offset])
        assert at <= packing.LENGTH
    assert sorted(x for r in rows for x in r.ids) == sorted(x for ids in wanted for x in ids)
    assert sum(r.start == 0 for r in rows) == len(wanted)


#: Names that operators use inside, as columns of the user's own.
CLASHES = ("_row", "score", "predicted", "size", "source_size", "target", "taken", "whole", "part", "part_start", "_", "n", "key", "finding", "left", "row", "range_", "place", "Score", "_score", "component_id")


def test_clashing_columns_keep_their_values(spark):
    """Through all stages but the last, with repeated rows among them."""
    from pyspark.sql import functions as F

    docs = P.read(spark, SMALL, "documents").where("doc_id < 120").select("*", *[F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in CLASHES if c != "Score"])
    docs = materialize(docs.unionByName(docs.where("doc_id < 5")), "clashing")
    types, names = docs.dtypes, docs.columns
    for name, stage in P.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SMALL), name)
        assert docs.columns == names and [t for t in docs.dtypes] == types
        rows = docs.collect()
        assert rows and all(r[c] == f"{c}:{r.doc_id}" for r in rows for c in CLASHES if c != "Score"), name
        if name == "near_duplicates":
            assert len({r.doc_id for r in rows}) == len(rows)
    assert P.STAGES[-1][1](spark, docs, SMALL).count() > 0


def test_repeated_rows_and_empty_tables(spark, edge, empty):
    docs = P.read(spark, edge, "documents")
    kept = P.drop_copies(spark, docs, edge)
    assert kept.columns == docs.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 4, 5, 6, 7, 9, 11, 12, 13]
    assert P.run(spark, empty).count() == 0
    packed = P.run(spark, edge).collect()
    assert {r.doc_id for r in packed} <= {r[0] for r in awkward.DOCS} and all(len(r.ids) == r.length for r in packed) and len(packed) > 3

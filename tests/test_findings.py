"""Cases in which a query once differed from its SQL, or left too much to do."""

import random

from oracle import connect, same
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions import udfs
from quire.operators import jaccard as J
from quire.operators import links as L
from quire.operators import matching as M
from quire.operators import similarity as V
from quire.plans import registry


def test_abbreviations_in_a_row(spark, tmp_path):
    titles = ["St. st. st. st. st. x", "The Rev. Dr. Smith", "Rev.  Dr. Smith", "Capt. of Col. Maj. x", "A. b. c. Mr. Mrs. d", "St. x", "mr.mrs. x", None]
    rows = [(k, t, "en", "src1") for k, t in enumerate(titles)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    same(registry.QUERIES["normalize_title"](spark, str(tmp_path)), connect(tmp_path), registry.ORACLES["normalize_title"])
    # The operator takes the period of each of them, as the reference does
    got = spark.createDataFrame([(t,) for t in titles[:2]], "t string").select(T.normalize_title(F.col("t")).alias("t")).collect()
    assert [r.t for r in got] == ["st st st st st x", "the rev dr smith"]


def strings(n, seed):
    r = random.Random(seed)
    return [(k, "Name " + "".join(r.choice("abc") for _ in range(r.choice((0, 3, 8, 9, 10, 11)))), k % 2) for k in range(n)]


def test_most_alike_titles(spark):
    rows = [*strings(120, 1), (500, "Name aaa", 0), (501, "Name aaa", 0), (502, "zzz", 1), (503, None, 1)]
    df = spark.createDataFrame(rows, "key long, title string, block long")
    done = [k for k, _, _ in rows if k % 3 == 0]
    want = {}
    for a, t, g in rows:
        near = [(-s, b) for b, u, h in rows if a not in done and g == h and a != b and t is not None and u is not None and (s := udfs.jaro_winkler_similarity(t, u)) >= 0.85]
        if near:
            want[a] = (min(near)[1], -min(near)[0])
    found = L.to_verify(df, df, spark.createDataFrame([(k,) for k in done], "key long"), "key", "title", "block")
    assert {r.a: (r.b, r.score) for r in found.collect()} == want


def edits(x, y):
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


def test_linkage_of_pieces(spark):
    rows = strings(150, 2)
    df = spark.createDataFrame([(f"{k:04}", t, g) for k, t, g in rows], "_id string, name string, block long")
    for least in (0.9, 0.7, 1.0):
        want = {(f"{a:04}", f"{b:04}") for a, t, g in rows for b, u, h in rows if a < b and g == h and 1 - edits(t, u) / max(len(t), len(u), 1) >= least}
        found = M.linkage(df, "block", ["name"], least)
        assert "_piece" in found._jdf.queryExecution().optimizedPlan().toString()  # never joined by the block alone
        assert sorted((r.a, r.b) for r in found.collect()) == sorted(want)


def test_few_comparisons(spark, monkeypatch):
    """Of a string's candidates only those are compared whose bound reaches the best found."""
    import numpy as np

    names = [f"Customer#{k:09}" for k in range(0, 3000, 7)]
    codes = np.array([[ord(c) for c in x] for x in names], np.int32)
    sizes, keys = np.full(len(names), 18), np.arange(len(names))
    calls, plain = [], udfs.jaro_winkler_similarity
    monkeypatch.setattr(udfs, "jaro_winkler_similarity", lambda a, b: calls.append(b) or plain(a, b))
    got = udfs.most_alike(names[5], names, codes, sizes, keys, keys != 5, 0.85)
    assert got == min(((k, plain(names[5], x)) for k, x in enumerate(names) if k != 5), key=lambda p: (-p[1], p[0])) and len(calls) < len(names) // 2


def word_sets(n, seed):
    r = random.Random(seed)
    common = [f"c{k}" for k in range(30)]
    out = [[r.choice(common) for _ in range(r.choice((1, 2, 5, 9, 10, 40)))] for _ in range(n)]
    base = [f"w{k}" for k in range(400)]
    out += [[w for w in base if r.random() > 0.1] + [f"x{k}"] for k in range(n // 3)]  # near copies of one text
    return [*out, *out[: n // 4], [], None, ["a", "b", "c", "d"], ["a", "b", "c", "d", "e"], ["a", "b", "c", "e"]]


def test_alike_sets(spark, monkeypatch):
    """All pairs of different sets, from the smallest key of each, and all copies; in blocks and cells of any size."""
    sets = word_sets(120, 3)
    df = spark.createDataFrame([(f"{k:04}", w) for k, w in enumerate(sets)], "_id string, words array<string>")
    classes = {}
    for k, w in enumerate(sets):
        if w:
            classes.setdefault(frozenset(w), []).append(f"{k:04}")
    for threshold, block, cell in ((80, 1024, 512), (55, 7, 5)):
        want = {(c[0], d, 1.0) for c in classes.values() for d in c[1:]}
        for x, (a, *_) in classes.items():
            want |= {(a, b, len(x & y) / len(x | y)) for y, (b, *_) in classes.items() if a < b and 100 * len(x & y) >= threshold * len(x | y)}
        monkeypatch.setattr(J, "BLOCK", block)
        monkeypatch.setattr(J, "CELL", cell)
        got = J.alike(df, F.col("words"), threshold).collect()
        assert len(got) == len(set(got)) and {tuple(r) for r in got} == want


def test_alike_sets_meet_as_sketches():
    """Cells hold sketches of some bytes; what leaves is a forest, however many sets are alike."""
    import numpy as np

    r = np.random.default_rng(1)
    base = r.integers(-(2**62), 2**62, 300)
    near = [np.append(base, k) for k in r.integers(-(2**62), 2**62, 200)]
    far = [r.integers(-(2**62), 2**62, 301) for _ in range(200)]
    found = J.may_be_alike(np.full(400, 301), [J.sketch(x) for x in near + far], np.zeros(400, int), 80)
    assert len(found) == 199 and {k for p in found for k in p} == set(range(200)) and len(J.sketch(near[0])) == 64


def test_blocks_of_duplicates_are_not_written(spark, monkeypatch):
    """Rows meet blocks as they were written: no exchange or copy of vectors for each block; results as by all pairs."""
    import numpy as np
    from pyspark.sql.classic.dataframe import DataFrame

    rng = np.random.default_rng(7)
    x = rng.random((30, 300)) * (rng.random((30, 300)) < 0.3)
    x = np.concatenate([x, x[:20] + 0.3 * rng.random((20, 300)) * (rng.random((20, 300)) < 0.1), np.repeat(x[:1], 15, axis=0)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = [f"t{k:03d}" for k in rng.permutation(len(x))]
    rows = spark.createDataFrame([(ids[a], f"w{b:03d}", float(x[a, b])) for a, b in zip(*np.nonzero(x), strict=True)], "_id string, word string, weight double")
    plans, plain = [], DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda df, *a, **b: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df, *a, **b))
    monkeypatch.setattr(V, "BLOCK", 9)
    got = sorted(tuple(r) for r in V.duplicates(rows, 3, 0.8).collect())
    near, wanted = np.round(x @ x.T, 6), set()
    for a in range(len(x)):
        best = sorted((-near[a, b], ids[b]) for b in range(len(x)) if b != a and near[a, b] >= 0.8)[:3]
        wanted |= {(min(ids[a], i), max(ids[a], i), round(-s, 4)) for s, i in best}
    assert got == sorted(wanted) and len(got) > 40
    assert plans and not any(w in p for p in plans for w in ("Exchange", "Generate"))


def test_duplicates_multiply_few_pairs(spark, monkeypatch):
    """Bounds leave all but pairs that a row may still take; each two rows meet once, whichever of them is sent. Results as by all pairs."""
    import numpy as np

    rng = np.random.default_rng(11)
    topics = rng.random((3, 900)) ** 8
    x = np.array([(t := topics[k % 3]) * (rng.random(900) < 0.3) * (0.5 + rng.random(900)) + 0.05 * rng.random(900) * (rng.random(900) < 0.02) for k in range(240)])
    x = np.concatenate([x, x[:80] * (rng.random((80, 900)) < 0.97), np.repeat(x[:1], 14, axis=0)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    r, c = np.nonzero(x)
    rows = V.Rows(np.arange(len(x)), (x > 0).sum(axis=1), c.astype(np.int32), x[r, c])
    met, plain = [], V.Best.add
    monkeypatch.setattr(V.Best, "add", lambda self, row, place, near: (met.append(len(row)), plain(self, row, place, near))[1])
    first, second = rows.take(np.arange(0, len(x), 2)), rows.take(np.arange(1, len(x), 2))
    block = V.Block(first, 900, np.full(len(first.sizes), 800_000))
    own, others = V.Best(np.full(len(second.sizes), 800_000), 4), V.Best(block.least, 4)
    V.meet(second, block, own, others)
    near = np.rint(x @ x.T * 1e6).astype(int)
    for best, mine, theirs in ((own, second.places, first.places), (others, block.rows.places, second.places)):
        for k, p in enumerate(mine):
            wanted = sorted((-near[p, q], q) for q in theirs if near[p, q] >= 800_000)[:4]
            assert [(-n, q) for n, q in zip(best.near[k], best.place[k], strict=True) if n] == wanted
    assert 0 < sum(met) / 2 < 0.1 * len(first.sizes) * len(second.sizes)


def test_words_of_duplicates_are_counted_in_their_text(spark, tmp_path, monkeypatch):
    """No word index is made, and no row for each word; words are as in the SQL, however they are written."""
    from quire.sources import tables as S

    words = ["don't", "'tis", "-x-", "a_b", "été", "naïve", "x1", "2nd", "“quoted”", "l’été", "ÄPFEL", "rock-n-roll", "--", "日本語", "e\u0301a", "a\u00a0b", "___", "o’", "q—r", "ⅷ", "x²"]
    r = random.Random(3)
    texts = [" ".join(r.choice(words) + r.choice(["", ",", ".", "\n", "!?"]) for _ in range(30)) for _ in range(25)]
    texts += [t + " more" for t in texts[:12]] + texts[:3] + ["", "12 34", None]
    rows = [(k, t, "en", "src1") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(S, "stored_index", lambda *a: 1 / 0)
    same(registry.QUERIES["find_duplicates"](spark, str(tmp_path)), connect(tmp_path), registry.ORACLES["find_duplicates"])

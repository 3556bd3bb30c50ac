"""Joins that follow declared links between tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.sources.scratch import kept


def linked(left: DataFrame, right: DataFrame, mine: str, theirs: str, prefix: str, transform=None) -> DataFrame:
    """left with the columns of the one row of right that it links to, prefixed. transform: a column function over my key.
    The first row of a key counts; Spark broadcasts right if its size allows."""
    first = Window.partitionBy(theirs).orderBy(*[F.col(c) for c in right.columns])
    one = right.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    one = one.select(*[F.col(c).alias(f"{prefix}_{c}") for c in right.columns])
    key: Column = F.col(mine) if transform is None else transform(F.col(mine))
    return left.join(one, key == F.col(f"{prefix}_{theirs}"), "left")


def one_to_many(left: DataFrame, right: DataFrame, mine: str, theirs: str) -> DataFrame:
    return left.join(right, F.col(mine) == F.col(theirs), "left")


def _first(right: DataFrame, key: str, *order: str) -> DataFrame:
    """One row of each key that isn't null, the first by its columns."""
    names = [c for c in right.columns if c != key]
    one = right.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*order, *[c for c in names if c not in order])).alias("_r"))
    return one.select(key, *[F.col("_r")[c].alias(c) for c in names])


def coalesced(left: DataFrame, rights: list[tuple[DataFrame, str, str]], value: str) -> DataFrame:
    """left with a value from the first of several tables (table, my key, its key) that has one. Rows of left stay as many
    as they are: of rows of a table that share a key the smallest value counts."""
    out, names = left, []
    for k, (right, mine, theirs) in enumerate(rights):
        names.append(f"_v{k}")
        own = _first(right.where(F.col(value).isNotNull()).select(F.col(theirs).alias(f"_k{k}"), F.col(value).alias(f"_v{k}")), f"_k{k}")
        out = out.join(own, F.col(mine) == F.col(f"_k{k}"), "left").drop(f"_k{k}")
    return out.withColumn(value, F.coalesce(*names)).drop(*names)


def longest_prefix(left: DataFrame, column: str, codes: DataFrame, code: str, lengths: tuple[int, ...]) -> DataFrame:
    """left with the longest code that its column begins with, null where none does: one equal join for each of the codes'
    lengths, longest first. Rows stay as many as they are."""
    out, names = left, []
    known = codes.select(F.col(code).alias("_c")).where(F.col(code).isNotNull()).distinct()
    for k, n in enumerate(sorted(set(lengths), reverse=True)):
        names.append(f"_p{k}")
        out = out.join(known.where(F.length("_c") == n).withColumnRenamed("_c", f"_p{k}"), F.substring(column, 1, n) == F.col(f"_p{k}"), "left")
    return out.withColumn(code, F.coalesce(*names)).drop(*names)


def verified(rows: DataFrame, human: DataFrame, key: str, column: str) -> DataFrame:
    """People's decisions (key, is_match, verified) over matched ids: n clears, anything else sets. Of several decisions of
    a key the first by its columns counts."""
    j = rows.join(_first(human.select(key, "is_match", "verified"), key), key, "left")
    chosen = F.when(F.col("is_match") == "n", "").when(F.col("verified").isNotNull(), F.col("verified")).otherwise(F.col(column))
    return j.withColumn(column, chosen).select(*rows.columns)


def inherited(rows: DataFrame, key: str, refers_to: str, columns: list[str]) -> DataFrame:
    """Rows whose columns are empty take them from the row they refer to."""
    source = _first(rows.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns]), "_k")
    j = rows.join(source, F.col(refers_to) == F.col("_k"), "left")
    empty = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "")
    return j.select(*[F.when(empty(c), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])


def to_verify(rows: DataFrame, others: DataFrame, done: DataFrame, key: str, title: str, block: str, least: float = 0.85) -> DataFrame:
    """Candidates for people to check: rows that nobody has decided, with the most alike title of the other side in the
    same block (Jaro-Winkler; at least so alike; ties by the other's key)."""
    import numpy as np
    import pyarrow as pa

    from quire.functions import udfs

    own = rows.join(done.select(key).distinct(), key, "left_anti").where(F.col(key).isNotNull() & F.col(title).isNotNull()).select(F.col(key).alias("a"), F.col(title).alias("ta"), block)
    theirs = others.where(F.col(key).isNotNull() & F.col(title).isNotNull())
    # A title of a block stands for its rows: of equal ones only the two smallest keys can be chosen
    names = theirs.groupBy(block, title).agg(F.min(key).alias("b"))
    again = theirs.join(names.select(block, title, "b"), [block, title]).where(F.col(key) > F.col("b")).groupBy(block, title).agg(F.min(key).alias("b2"))
    names = names.join(again, [block, title], "left").select(block, F.col(title).alias("tb"), "b", "b2")
    # Equal titles are as alike as can be
    same = own.join(names.withColumnRenamed("tb", "ta"), [block, "ta"], "left").withColumn("_b", F.when(F.col("b") == F.col("a"), F.col("b2")).otherwise(F.col("b")))
    same = kept(same.select("a", "ta", block, "_b"), "same")
    certain = same.where("_b is not null").select("a", F.col("_b").alias("b"), F.lit(1.0).alias("score"))
    kind = rows.schema[key].dataType.simpleString()
    left = same.where("_b is null").select(block, "a", "ta")

    def compared(_, mine, its):
        tb = its.column("tb").to_pylist()
        keys, sizes = its.column("b").to_numpy(), np.array([len(x) for x in tb], np.int64)
        seconds = its.column("b2").to_pylist()
        codes = np.full((len(tb), max(sizes.max(initial=1), 1)), -1, np.int32)
        for k, x in enumerate(tb):
            codes[k, : len(x)] = np.fromiter(map(ord, x), np.int32, len(x))
        found = []
        for a, ta in zip(mine.column("a").to_pylist(), mine.column("ta").to_pylist(), strict=True):
            own_, now, there = np.flatnonzero(keys == a), keys, np.ones(len(tb), bool)
            if len(own_):  # not itself: its title's second key, if there is one
                now = keys.copy()
                for k in own_:
                    there[k], now[k] = seconds[k] is not None, seconds[k] or 0
            got = udfs.most_alike(ta, tb, codes, sizes, now, there, least)
            if got:
                found.append((a, *got))
        return pa.table({"a": [f[0] for f in found], "b": [f[1] for f in found], "score": pa.array([f[2] for f in found], pa.float64())}, pa.schema([("a", mine.schema.field("a").type), ("b", its.schema.field("b").type), ("score", pa.float64())]))

    # A block's titles are shared by several tasks, each with some of its open rows
    parts = 4
    mine = left.withColumn("_p", F.pmod(F.xxhash64("a"), F.lit(parts)))
    spread = names.join(left.select(block).distinct(), block, "left_semi").select(block, "tb", "b", "b2").withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>")))
    alike = mine.groupBy(block, "_p").cogroup(spread.groupBy(block, "_p")).applyInArrow(compared, f"a {kind}, b {kind}, score double")
    every = certain.unionByName(alike)
    return every.groupBy("a").agg(F.max_by(F.struct("b", "score"), F.struct(F.col("score"), -F.col("b"))).alias("m")).select("a", "m.b", "m.score")

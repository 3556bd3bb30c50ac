"""Unions, intersections and differences of corpora, vocabularies and maps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union(corpora: dict[str, DataFrame], column: str = "corpus") -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(column, F.lit(name)) for name, df in corpora.items()])


def intersection(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.intersect(b), tables)


def without(todo: DataFrame, done: DataFrame) -> DataFrame:
    return todo.join(done, todo.columns, "left_anti")


def multi_map(df: DataFrame, key: str, value: str) -> DataFrame:
    """key and its distinct values, sorted."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("values"))


def last_non_empty(*columns: Column) -> Column:
    """The last of several values that is neither null nor empty."""
    return F.coalesce(*[F.when(F.trim(c.cast("string")) != "", c) for c in reversed(columns)])


def appended(a: Column, b: Column) -> Column:
    """Ordered union of two arrays."""
    return F.array_distinct(F.concat(a, b))

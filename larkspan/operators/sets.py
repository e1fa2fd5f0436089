"""Set and bag operations on whole collections and on array columns.

Sets treat null as equal to null; a bag keeps multiplicities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def set_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def set_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b.select(a.columns))


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b.select(a.columns))


def bag_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def bag_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Each row of ``b`` takes one equal row out of ``a``."""
    return a.exceptAll(b.select(a.columns))


def array_bag_difference(a: Column, b: Column) -> Column:
    """The same on arrays of orderable elements: the n-th copy stays if ``b`` has fewer than n."""
    copies = lambda xs, x: F.size(F.filter(xs, lambda y: y.eqNullSafe(x)))
    return F.flatten(F.transform(F.array_distinct(a), lambda x: F.array_repeat(x, F.greatest(copies(a, x) - copies(b, x), F.lit(0)))))


def membership(x: Column, items: Column) -> Column:
    return F.coalesce(F.exists(items, lambda y: y.eqNullSafe(x)), F.lit(False))


def multiplicity(x: Column, items: Column) -> Column:
    return F.size(F.filter(items, lambda y: y.eqNullSafe(x)))


def unique_map(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row per key if keys are unique; else the rows of repeated keys carry a failure code."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    return df.select(key, value, F.when(n > 1, F.lit("t_sda_duplicate_key")).alias("failure"))

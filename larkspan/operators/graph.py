"""What can be reached from a value, by documents that link values.

``edges`` have a row per document: ``__to``, the value it is found by, and
``__next``, the value it leads to.  Where every value leads to one other at
most and its chain ends, doubling the jumps counts all chains together in as
many rounds as the longest has binary digits, a row per value.  Only what
branches or runs in a circle is followed pair by pair with what was seen.
"""

from __future__ import annotations

import uuid
from itertools import count
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspan.sources.durable import durable, shared_folder


class _Rounds:
    """Tables of rounds in the shared folder; those no longer read are deleted at once."""

    def __init__(self, df: DataFrame) -> None:
        self.spark, self.folder = df.sparkSession, f"{shared_folder(df.sparkSession)}/graph-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, free: bool = True) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.parquet(path)
        if free:
            self.spark._jvm.System.gc()  # lets shuffle files of finished rounds go
        return self.spark.read.schema(df.schema).parquet(path)

    def read(self, schema: T.StructType, names: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{n}" for n in names])

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def common_type(*columns: tuple[DataFrame, str]) -> T.DataType:
    """The type in which these columns compare."""
    df = columns[0][0]
    return df.select(F.coalesce(*[F.lit(None).cast(d.schema[c].dataType) for d, c in columns])).schema[0].dataType


def chains(edges: DataFrame, rounds: _Rounds) -> DataFrame:
    """Per value (__v) the documents (__n) its chain has; null where it branches or never ends."""
    branches = F.coalesce(F.min("__next") != F.max("__next"), F.lit(False))
    first = edges.where(F.col("__to").isNotNull()).groupBy("__to").agg(F.count(F.lit(1)).alias("n"), F.min("__next").alias("j"), branches.alias("b"))
    now = rounds.write(first.select(F.col("__to").alias("__v"), F.when(~F.col("b"), F.col("j")).alias("__j"), F.when(~F.col("b"), F.col("n")).alias("__n")), "chains-0")
    before = None
    for i in count(1):
        # Of a chain that ends some value settles in every round: if none did, the rest runs in circles.
        left = now.where(F.col("__j").isNotNull()).count()
        if not left or left == before:
            break
        before = left
        there = now.select(F.col("__v").alias("__w"), F.col("__j").alias("__k"), F.col("__n").alias("__m"))
        found = F.col("__w").isNotNull()
        n = F.when(found, F.col("__n") + F.col("__m")).otherwise(F.col("__n"))
        now = rounds.write(now.join(there, F.col("__j") == F.col("__w"), "left").select("__v", F.when(n.isNotNull(), F.col("__k")).alias("__j"), n.alias("__n")), f"chains-{i}")
        rounds.drop(f"chains-{i - 1}")
    return now.select("__v", F.when(F.col("__j").isNull(), F.col("__n")).alias("__n"))


def pairs(starts: DataFrame, edges: DataFrame, rounds: _Rounds, name: str, simple: bool, depth: int | None = None) -> DataFrame:
    """Pairs of a start (__s) and every value with documents that it reaches (__at), each written once.

    ``simple`` tells that all chains end without branching, so nothing can be met twice.
    """
    values = rounds.write(edges.where(F.col("__to").isNotNull()).select("__to").distinct(), f"{name}-values")
    links = rounds.write(edges.where(F.col("__next").isNotNull()).select("__to", "__next").distinct(), f"{name}-links")
    front = starts.select("__s", F.col("__s").alias("__at"))
    names: list[str] = []
    for i in count() if depth is None else range(depth + 1):
        hit = front.join(values, F.col("__at") == F.col("__to"), "left_semi")
        if names and not simple:
            hit = hit.join(rounds.read(hit.schema, names), ["__s", "__at"], "left_anti")
        here = rounds.write(hit, f"{name}-{i}", free=i % 8 == 7)
        names.append(f"{name}-{i}")
        if here.isEmpty():
            break
        front = here.join(links, F.col("__at") == F.col("__to")).select("__s", F.col("__next").alias("__at"))
        front = front if simple else front.distinct()
    return rounds.read(front.schema, names)


def lookup(df: DataFrame, right: DataFrame, start: Column, source: str, target: str, name: str, depth: int | None = None, sized: bool = False) -> DataFrame:
    """``df`` with the documents of ``right`` that ``start`` reaches as ``name``, or with their number where ``sized``.

    Links go from field ``source`` to documents whose ``target`` equals it.
    """
    rounds = _Rounds(df)
    doc = F.struct(*[F.col(f"`{c}`") for c in right.columns])
    plain = df.withColumn("__s", start)
    edges = right.select(F.col(target).alias("__to"), F.col(source).alias("__next"))
    kind = common_type((edges, "__to"), (edges, "__next"), (plain, "__s"))
    edges = edges.select(*[F.col(c).cast(kind).alias(c) for c in ("__to", "__next")])
    plain = plain.withColumn("__s", F.col("__s").cast(kind))
    known = chains(edges, rounds) if depth is None else None
    if sized and known is not None and known.where(F.col("__n").isNull()).limit(1).count() == 0:
        found = known.select(F.col("__v").alias("__f"), F.col("__n").alias("__got"))
    else:
        plain = durable(plain)
        starts = plain.where(F.col("__s").isNotNull()).select("__s").distinct()
        at = lambda simple: starts.join(known.where(F.col("__n").isNotNull() == simple), F.col("__s") == F.col("__v"), "left_semi")
        odd = pairs(starts if known is None else at(False), edges, rounds, "odd", False, depth)
        if sized:
            documents = edges.groupBy("__to").agg(F.count(F.lit(1)).alias("__n"))
            found = odd.join(documents, F.col("__at") == F.col("__to")).groupBy(F.col("__s").alias("__f")).agg(F.sum("__n").alias("__got"))
            if known is not None:
                found = found.unionAll(known.where(F.col("__n").isNotNull()).select("__v", "__n"))
        else:
            every = odd if known is None else odd.unionAll(pairs(at(True), edges, rounds, "even", True))
            nodes = right.select(F.col(target).cast(kind).alias("__to"), doc.alias("__doc"))
            found = every.join(nodes, F.col("__at") == F.col("__to")).groupBy(F.col("__s").alias("__f")).agg(F.array_sort(F.collect_list("__doc")).alias("__got"))
    empty = F.lit(0) if sized else F.array().cast(found.schema["__got"].dataType)
    value = F.coalesce(F.col("__got"), empty)
    joined = plain.join(found, F.col("__s") == F.col("__f"), "left").withColumn(name, value.cast("int") if sized else value)
    return joined.drop("__s", "__f", "__got")


def sizes(spec: Any, name: str) -> Any:
    """A projection in which ``$size`` of the field ``name`` reads its number instead; None if it reads more of it."""

    def walk(x: Any) -> Any:
        if isinstance(x, dict):
            if x in ({"$size": f"${name}"}, {"$size": [f"${name}"]}):
                return f"${size_field(name)}"
            return {k: walk(v) for k, v in x.items()}
        if isinstance(x, list | tuple):
            return [walk(v) for v in x]
        if isinstance(x, str) and (x == f"${name}" or x.startswith(f"${name}.")):
            raise LookupError(x)
        return x

    if all(v in (0, False) for v in spec.values()) or any(k == name or k.startswith(name + ".") for k, v in spec.items() if v in (1, True)):
        return None
    try:
        return walk(dict(spec))
    except LookupError:
        return None


def size_field(name: str) -> str:
    return f"__size_{name}"

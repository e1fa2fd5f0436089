"""Databases and collections: named DataFrames with a key.

A collection is either typed (its columns are its fields) or schemaless (one
VARIANT column ``doc`` holds the document).  Both have a key; where a table has
none of its own, all its orderable columns break ties.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspan.errors import CoverageError, StaticError
from larkspan.functions.values import Scope, kind_of

BODY = "doc"
NAME_BYTES, KEY_BYTES = 256, 2048


def check_name(name: str) -> str:
    if not name or len(name.encode()) > NAME_BYTES or "\0" in name:
        raise StaticError("bad_collection_name", name[:40])
    return name


def check_key(key: str) -> str:
    if not key or len(key.encode()) > KEY_BYTES or "\0" in key:
        raise StaticError("bad_key", key[:40])
    return key


@dataclass(frozen=True)
class Hole:
    """A part of a collection that should be there and isn't."""

    source: str
    reason: str


@dataclass(frozen=True)
class Collection:
    name: str
    df: DataFrame
    key: tuple[str, ...]
    holes: tuple[Hole, ...] = ()

    @property
    def body(self) -> str | None:
        return BODY if BODY in self.df.columns and isinstance(self.df.schema[BODY].dataType, T.VariantType) else None

    @property
    def rows(self) -> DataFrame:
        """The documents with ``_key``."""
        if "_key" in self.df.columns or len(self.key) != 1:
            return self.df
        return self.df.withColumn("_key", F.col(self.key[0]))

    @property
    def ties(self) -> tuple[str, ...]:
        """Columns that break ties of an order, so that it is total."""
        if "_key" in self.df.columns or len(self.key) == 1:
            return ("_key",)
        return self.key or tuple(f.name for f in self.df.schema if kind_of(f.dataType) not in ("variant", "object", "array"))

    def scope(self, aliases: tuple[str, ...] = ()) -> Scope:
        return Scope(self.rows.schema, self.body, aliases)

    # scans

    def list_keys(self, limit: int | None = 256, after: object | None = None) -> DataFrame:
        """Keys in ascending order."""
        keys = self.rows.select("_key")
        keys = keys if after is None else keys.where(F.col("_key") > F.lit(after))
        keys = keys.orderBy("_key")
        return keys if limit is None else keys.limit(limit)

    def get(self, key: object) -> DataFrame:
        """The one document of that key, or no row."""
        return self.rows.where(F.col("_key") == F.lit(key)).limit(1)

    def scan(self, limit: int | None = None, after: object | None = None, complete: bool = True) -> DataFrame:
        """Documents in key order; fails on missing parts unless ``complete`` is false."""
        if complete and self.holes:
            raise CoverageError("incomplete", ", ".join(h.source for h in self.holes))
        rows = self.rows if after is None else self.rows.where(F.col("_key") > F.lit(after))
        rows = rows.orderBy(*self.ties)
        return rows if limit is None else rows.limit(limit)

    def iterate(self) -> Iterator:
        """Rows one by one; only one partition at a time reaches the driver."""
        return self.scan().toLocalIterator(prefetchPartitions=False)


@dataclass
class Database:
    """All queries run in one database; names resolve to its collections."""

    spark: SparkSession
    collections: dict[str, Collection] = field(default_factory=dict)

    def add(self, name: str, df: DataFrame, key: str | Sequence[str] = (), holes: Sequence[Hole] = ()) -> Collection:
        keys = (key,) if isinstance(key, str) else tuple(key)
        if not keys and "_key" in df.columns:
            keys = ("_key",)
        for k in keys:
            if k not in df.columns:
                raise StaticError("unknown_key_column", k)
        self.collections[check_name(name)] = Collection(name, df, keys, tuple(holes))
        return self.collections[name]

    def add_json(self, name: str, lines: DataFrame, key: str = "_key", text: str = "json") -> Collection:
        """Schemaless documents from a key column and a JSON text column; text that doesn't parse is a hole."""
        parsed = lines.select(F.col(key).alias("_key"), F.try_parse_json(F.col(text)).alias(BODY))
        return self.add(name, parsed, "_key")

    def __getitem__(self, name: str) -> Collection:
        if name not in self.collections:
            raise StaticError("unknown_collection", name)
        return self.collections[name]

    def list_collections(self) -> list[str]:
        return sorted(self.collections)

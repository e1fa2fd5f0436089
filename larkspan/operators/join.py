"""Fluent inner equijoins over any number of collections.

``MultiQuery(db).source("orders", "o").join("customers", "c", "customer_id",
"id")`` gives one struct column per alias.  Missing keys drop, null joins null.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspan.catalog import Database
from larkspan.errors import BudgetError, StaticError
from larkspan.functions.values import descend
from larkspan.operators.attach import join_keys
from larkspan.plans import predicates as P


@dataclass(frozen=True)
class Source:
    name: str
    alias: str
    where: P.Predicate | None = None
    limit: int | None = None
    documents: int | None = None
    left_alias: str | None = None
    left: str | None = None
    right: str | None = None


@dataclass(frozen=True)
class MultiQuery:
    db: Database
    sources: tuple[Source, ...] = ()
    total: int | None = None
    keys: bool = False
    params: Mapping[str, Any] = field(default_factory=dict)

    def source(self, name: str, alias: str | None = None) -> MultiQuery:
        if self.sources:
            raise StaticError("second_from", name)
        return replace(self, sources=(Source(name, alias or name),))

    def join(self, name: str, alias: str | None, left: str, right: str, left_alias: str | None = None) -> MultiQuery:
        """Join on ``left`` of ``left_alias`` (the first source if none) = ``right`` of the new one."""
        if not self.sources:
            raise StaticError("join_before_from", name)
        alias = alias or name
        known = [s.alias for s in self.sources]
        if alias in known:
            raise StaticError("duplicate_alias", alias)
        if left_alias is not None and left_alias not in known:
            raise StaticError("unknown_alias", left_alias)
        return replace(self, sources=(*self.sources, Source(name, alias, left_alias=left_alias or known[0], left=left, right=right)))

    def _last(self, **changes: Any) -> MultiQuery:
        if not self.sources:
            raise StaticError("no_source")
        return replace(self, sources=(*self.sources[:-1], replace(self.sources[-1], **changes)))

    def where(self, predicate: P.Predicate | P.Built) -> MultiQuery:
        """Filter the latest source before it is joined."""
        return self._last(where=P.node(predicate))

    def source_limit(self, n: int) -> MultiQuery:
        """Only the first ``n`` documents of the latest source, by key."""
        return self._last(limit=n)

    def source_budget(self, documents: int) -> MultiQuery:
        return self._last(documents=documents)

    def limit(self, n: int) -> MultiQuery:
        return replace(self, total=n)

    def include_keys(self) -> MultiQuery:
        return replace(self, keys=True)

    def describe(self) -> dict[str, Any]:
        """The plan, without running it."""
        return {
            "sources": [{"collection": s.name, "alias": s.alias, "where": P.to_json(s.where) if s.where else None, "limit": s.limit, "on": None if s.left is None else [f"{s.left_alias}.{s.left}", f"{s.alias}.{s.right}"]} for s in self.sources],
            "limit": self.total,
            "include_keys": self.keys,
        }

    def _rows(self, s: Source) -> DataFrame:
        side = self.db[s.name]
        rows = side.rows
        if s.documents is not None and rows.limit(s.documents + 1).count() > s.documents:
            raise BudgetError("budget_exceeded", s.alias)
        if s.where is not None:
            rows = rows.where(P.Compiler(side.scope((s.alias, s.name)), self.params).condition(s.where))
        if s.limit is not None:
            rows = rows.orderBy(*[F.col(f"`{t}`") for t in side.ties]).limit(s.limit)
        names = [c for c in rows.columns if c != "_key" or self.keys or side.df.columns == rows.columns]
        key = F.struct(*[F.col(f"`{t}`") for t in side.ties]).alias(f"__key_{s.alias}")
        document = F.col(side.body) if side.body and not self.keys else F.struct(*[F.col(f"`{c}`") for c in names])
        return rows.select(document.alias(s.alias), key, *([F.col("_key").alias(f"__own_{s.alias}")] if "_key" in rows.columns else []))

    def _slot(self, df: DataFrame, alias: str, path: str):
        if path in ("_key", "$key") and f"__own_{alias}" in df.columns:
            return descend(F.col(f"`__own_{alias}`"), df.schema[f"__own_{alias}"].dataType, ())
        dtype = df.schema[alias].dataType
        if isinstance(dtype, T.StructType) and "doc" in dtype.names and isinstance(dtype["doc"].dataType, T.VariantType):
            return descend(F.col(f"`{alias}`").getField("doc"), T.VariantType(), tuple(path.split(".")))
        return descend(F.col(f"`{alias}`"), dtype, tuple(path.split(".")))

    def collect_df(self) -> DataFrame:
        """The joined rows, one column per alias, ordered by the sources' keys where limited."""
        if not self.sources:
            raise StaticError("no_source")
        df = self._rows(self.sources[0])
        for s in self.sources[1:]:
            right = self._rows(s)
            l, r = self._slot(df, s.left_alias, s.left), self._slot(right, s.alias, s.right)
            if isinstance(r.dtype, T.NullType) or isinstance(l.dtype, T.NullType):
                raise StaticError("unknown_join_path", f"{s.left_alias}.{s.left} = {s.alias}.{s.right}")
            lk, rk = join_keys(l, r)
            df = df.where(l.present).withColumn("__l", lk).join(right.where(r.present).withColumn("__r", rk), F.col("__l").eqNullSafe(F.col("__r")), "inner").drop("__l", "__r")
        if self.total is not None:
            df = df.orderBy(*[F.col(f"`__key_{s.alias}`") for s in self.sources]).limit(self.total)
        return df.select(*[F.col(f"`{s.alias}`") for s in self.sources])

    def map_algebra(self, program: str, name: str = "value") -> DataFrame:
        """Evaluate a value-algebra expression for every joined row, its aliases bound to the documents."""
        from larkspan.functions.algebra import map_rows

        return map_rows(self.collect_df(), program, name)

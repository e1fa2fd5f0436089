"""Running plans: filter, group, order, limit, attach, project."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspan.catalog import Collection, Database, Hole
from larkspan.errors import BudgetError, CoverageError, StaticError
from larkspan.functions.values import Scope, Slot, canonical, family, number
from larkspan.operators import attach
from larkspan.plans.paging import Cursor, CursorKey
from larkspan.plans.predicates import Compiler
from larkspan.plans.query import Budget, Plan
from larkspan.plans.text import parse_with_explain
from larkspan.sources.durable import numbered


@dataclass(frozen=True)
class SortColumn:
    """One column of the total order, with how it is placed."""

    name: str
    value: Column
    descending: bool
    nulls_first: bool

    def term(self) -> Column:
        c = F.col(f"`{self.name}`")
        if self.descending:
            return c.desc_nulls_first() if self.nulls_first else c.desc_nulls_last()
        return c.asc_nulls_first() if self.nulls_first else c.asc_nulls_last()


def _variant_sort(slot: Slot, name: str, descending: bool, nulls_first: bool) -> list[SortColumn]:
    """A VARIANT's order: null before the rest, booleans, numbers, strings, others as text; absent apart."""
    f, v = family(slot.value), slot.value
    rank = F.when(f == "null", 0).when(f == "bool", 1).when(f == "num", 2).when(f == "str", 3).otherwise(4)
    columns = {
        "rank": F.when(slot.present, rank),
        "bool": F.when(f == "bool", F.try_variant_get(v, "$", "boolean")),
        "num": F.when(f == "num", F.try_variant_get(v, "$", "double")),
        "text": F.when(f == "str", F.try_variant_get(v, "$", "string")).when(f.isin("array", "object", "other"), F.to_json(v)),
    }
    return [SortColumn(f"{name}{k}", c, descending, nulls_first) for k, c in columns.items()]


def sort_columns(plan: Plan, scope: Scope, ties: tuple[str, ...]) -> list[SortColumn]:
    """The plan's order terms and then the key, ascending: a total order."""
    out: list[SortColumn] = []
    for i, t in enumerate(plan.order):
        slot = scope.resolve(t.path)
        if slot.kind == "variant":
            out.extend(_variant_sort(slot, f"__s{i}", t.descending, t.nulls_first))
        else:
            value = slot.value if slot.kind not in ("array", "object") else F.to_json(slot.value)
            out.append(SortColumn(f"__s{i}", value, t.descending, t.nulls_first))
    used = {t.path for t in plan.order}
    return out + [SortColumn(f"__k{i}", F.col(f"`{t}`"), False, False) for i, t in enumerate(ties) if t not in used]


def aggregate_columns(plan: Plan, scope: Scope) -> list[Column]:
    out = []
    for a in plan.aggregates:
        if a.fn == "count":
            out.append(F.count(F.lit(1)).alias(a.name))
        else:
            out.append({"sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg}[a.fn](number(scope.resolve(a.path))).alias(a.name))
    return out


def group(df: DataFrame, plan: Plan, scope: Scope) -> DataFrame:
    """Grouped aggregates; missing and null keys are one group.

    Without keys there is one row, or none over no rows.  Keys without
    aggregates are the distinct keys.
    """
    keys = []
    for g in plan.group or ():
        slot = scope.resolve(g)
        name = g.split(".")[-1]
        if slot.kind == "variant":
            value = F.when(family(slot.value) == "str", F.try_variant_get(slot.value, "$", "string")).when(family(slot.value) != "null", F.to_json(slot.value))
            keys.append(value.alias(name))
        elif slot.kind in ("array", "object"):
            keys.append(F.to_json(slot.value).alias(name))
        else:
            keys.append(slot.value.alias(name))
    made = aggregate_columns(plan, scope)
    if not made:
        return df.select(*keys).distinct()
    if keys:
        return df.groupBy(*keys).agg(*made)
    return df.agg(*made, F.count(F.lit(1)).alias("__n")).where("__n > 0").drop("__n")


@dataclass(frozen=True)
class Page:
    """One page of a result."""

    rows: DataFrame
    continuation: str | None
    holes: tuple[Hole, ...]
    plan_hash: str

    @property
    def complete(self) -> bool:
        return not self.holes


@dataclass(frozen=True)
class Pages:
    """All pages of a result: the rows of all in order, with the number of their page, and the token after each page but the last."""

    rows: DataFrame
    continuations: tuple[str, ...]
    holes: tuple[Hole, ...]
    plan_hash: str
    number: str = "_page"


class Engine:
    """Runs query texts and plans over a database."""

    def __init__(self, db: Database, secret: bytes = b"larkspan-local", budget: Budget | None = None, strict: bool = True) -> None:
        self.db, self.secret, self.budget, self.strict = db, secret, budget, strict

    # plans

    def _plan(self, query: str | Plan) -> Plan:
        if isinstance(query, Plan):
            return query.checked()
        plan, explain = parse_with_explain(query)
        if explain:
            raise StaticError("explain", "use explain()")
        return plan

    def explain(self, query: str | Plan) -> dict[str, Any]:
        plan = query if isinstance(query, Plan) else parse_with_explain(query)[0]
        self.db[plan.source]
        return plan.explain()

    def _covered(self, side: Collection, plan: Plan) -> tuple[Hole, ...]:
        if side.holes and not plan.allow_incomplete:
            raise CoverageError("incomplete", ", ".join(h.source for h in side.holes))
        return side.holes

    def _budgeted(self, df: DataFrame, ties: tuple[str, ...], plan: Plan) -> tuple[DataFrame, tuple[Hole, ...]]:
        """The rows a document budget lets through: an error beyond it, or a stop in key order."""
        budget = plan.budget.merged(self.budget)
        if budget.documents is None:
            return df, ()
        over = df.limit(budget.documents + 1).count() > budget.documents
        if not over:
            return df, ()
        if not plan.allow_incomplete:
            raise BudgetError("budget_exceeded", "documents")
        return df.orderBy(*[F.col(f"`{t}`") for t in ties]).limit(budget.documents), (Hole("budget", "budget_exhausted_documents"),)

    def _result_budget(self, df: DataFrame, plan: Plan) -> None:
        limit = plan.budget.merged(self.budget).result_bytes
        if limit is not None:
            size = df.select(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
            if size > limit:
                raise BudgetError("budget_exceeded", "result_bytes")

    def _selected(self, plan: Plan, params: Mapping[str, Any]) -> tuple[DataFrame, list[SortColumn], Collection, tuple[Hole, ...]]:
        """Filtered or grouped rows with their sort columns, before order and limit."""
        side = self.db[plan.source]
        holes = self._covered(side, plan)
        aliases = tuple(x for x in (plan.alias, plan.source) if x)
        df, more = self._budgeted(side.rows, side.ties, plan)
        scope = side.scope(aliases)
        if plan.where is not None:
            df = df.where(Compiler(scope, params).condition(plan.where))
        ties = side.ties
        if plan.grouped:
            df = group(df, plan, scope)
            scope = Scope(df.schema)
            ties = tuple(g.split(".")[-1] for g in plan.group or ())
        order = sort_columns(plan, scope, ties)
        return df.withColumns({s.name: s.value for s in order}) if order else df, order, side, (*holes, *more)

    def _finished(self, df: DataFrame, plan: Plan, side: Collection, params: Mapping[str, Any], order: list[SortColumn], keep: tuple[str, ...] = ()) -> DataFrame:
        """Attach and project limited rows; the order is restored after joins."""
        aliases = tuple(x for x in (plan.alias, plan.source) if x)
        hidden = [s.name for s in order]
        if plan.project is not None and plan.steps:
            roots = [p for p in plan.project if p in df.columns]
            df = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*roots, *[t for t in side.ties if t in df.columns], *hidden])])
        if plan.steps:
            df = attach.steps(df, plan.steps, self.db, params, side.ties, self.strict, aliases, side.body, plan)
            if order:
                df = df.orderBy(*[s.term() for s in order])
        extra = [F.col(f"`{c}`") for c in keep]
        scope = Scope(df.schema, side.body if side.body in df.columns else None, aliases)
        if plan.brace is not None:
            return df.select(*attach.brace(scope, plan.brace), *extra)
        if plan.project is not None and not plan.grouped:
            found = [(p, scope.resolve(p)) for p in plan.project]
            added = [s.name for s in plan.steps if hasattr(s, "cardinality")]
            columns = [slot.value.alias("_key" if p == "$key" else p) for p, slot in found if not isinstance(slot.dtype, T.NullType)]
            return df.select(*columns, *[F.col(n) for n in added if n not in plan.project], *extra)
        return df.drop(*[h for h in hidden if h not in keep])

    # results

    def run(self, query: str | Plan, params: Mapping[str, Any] | None = None) -> DataFrame:
        """The whole result, ordered.  Pages only matter to ``page``."""
        plan, params = self._plan(query), params or {}
        df, order, side, _ = self._selected(plan, params)
        if order and (plan.order or plan.limit is not None):
            df = df.orderBy(*[s.term() for s in order])
        if plan.limit is not None:
            df = df.limit(plan.limit)
        out = self._finished(df, plan, side, params, order)
        self._result_budget(out, plan)
        return out

    def page(self, query: str | Plan, params: Mapping[str, Any] | None = None, after: str | None = None, size: int | None = None, now: float | None = None) -> Page:
        """One page in the total order, and the token of the next.

        The token binds the plan, its parameters and the last row's sort
        tuple; the next page is found by comparing with that tuple, never by
        counting rows.
        """
        plan, params = self._plan(query), params or {}
        size = size or plan.page_size
        bind = CursorKey(self.secret, plan.hash(), params)
        cursor = bind.open(after, now) if after else Cursor((), 0)
        df, order, side, holes = self._selected(plan, params)
        if not order:
            raise StaticError("no_order")
        if after:
            df = df.where(_beyond(order, cursor.values, df.schema))
        left = size if plan.limit is None else min(size, plan.limit - cursor.seen)
        more_allowed = plan.limit is None or plan.limit - cursor.seen > size
        ordered = df.orderBy(*[s.term() for s in order]).limit(max(0, left) + 1)
        last = ordered.select(*[s.name for s in order]).collect()  # at most a page
        token = None
        if len(last) > left and more_allowed and left > 0:
            token = bind.seal(Cursor(tuple(last[left - 1]), cursor.seen + left), now)
        rows = self._finished(ordered.limit(max(0, left)), plan, side, params, order)
        self._result_budget(rows, plan)
        return Page(rows, token, holes, plan.hash())

    def pages(self, query: str | Plan, params: Mapping[str, Any] | None = None, size: int | None = None, now: float | None = None) -> Pages:
        """All pages that following ``page`` from token to token gives, by one sort.

        Page by page every page reads and sorts its source again.  Here the
        sorted rows are written once and numbered, and only the last sort tuple
        of each page comes to the driver.
        """
        plan, params = self._plan(query), params or {}
        size = size or plan.page_size
        bind = CursorKey(self.secret, plan.hash(), params)
        df, order, side, holes = self._selected(plan, params)
        if not order:
            raise StaticError("no_order")
        if plan.project is not None and not plan.grouped and all(p in df.columns for p in plan.project) and not plan.steps:
            df = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*plan.project, *[s.name for s in order]])])
        df = df.orderBy(*[s.term() for s in order])
        df = numbered(df if plan.limit is None else df.limit(plan.limit), "__at")
        last = df.where((F.col("__at") % size == size - 1)).select("__at", *[s.name for s in order]).orderBy("__at").collect()  # one row a page
        total = df.agg(F.max("__at")).first()[0]
        tokens = tuple(bind.seal(Cursor(tuple(r)[1:], r[0] + 1), now) for r in last if r[0] < total)
        number = SortColumn("_page", F.col("_page"), False, False)
        df = df.withColumn("_page", F.floor(F.col("__at") / size).cast("long")).drop("__at")
        rows = self._finished(df, plan, side, params, [number, *order], ("_page",))
        self._result_budget(rows.drop("_page"), plan)
        return Pages(rows, tokens, holes, plan.hash())


def _beyond(order: list[SortColumn], values: tuple[Any, ...], schema: T.StructType) -> Column:
    """Rows after a sort tuple in the total order."""
    test = F.lit(False)
    equal = F.lit(True)
    for s, v in zip(order, values):
        c, dtype = F.col(f"`{s.name}`"), schema[s.name].dataType
        if v is None:
            after = c.isNotNull() if s.nulls_first else F.lit(False)
        else:
            v = F.lit(v).cast(dtype)
            after = F.coalesce((c < v) if s.descending else (c > v), F.lit(False))
            if not s.nulls_first:
                after = after | c.isNull()
            same = c.eqNullSafe(v)
        test = test | (equal & after)
        equal = equal & (c.isNull() if v is None else same)
    return test


__all__ = ["Engine", "Page", "canonical"]

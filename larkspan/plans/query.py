"""Query plans: frozen, with one canonical JSON form and one hash.

Text, builder and dialects all make the same ``Plan``; equal plans have equal
hashes whatever made them.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from dataclasses import dataclass, replace
from typing import Any

from larkspan.errors import StaticError
from larkspan.functions.values import parse_path
from larkspan.plans import predicates as P

PAGE_DEFAULT, PAGE_MOST, ORDER_TERMS, PROJECT_ITEMS, DEPTH = 64, 4096, 16, 1024, 8
AGGREGATES = ("count", "sum", "min", "max", "avg")
CARDINALITIES = ("exactly_one", "optional", "many")


@dataclass(frozen=True)
class OrderTerm:
    path: str
    descending: bool = False
    nulls_first: bool = False


@dataclass(frozen=True)
class Aggregate:
    fn: str
    path: str | None
    name: str


@dataclass(frozen=True)
class Item:
    """A brace item: ``name: path``, or ``name { items }``."""

    name: str
    path: str
    items: tuple["Item", ...] | None = None


@dataclass(frozen=True)
class Enrich:
    name: str
    source: str
    alias: str | None
    left: str
    right: str
    cardinality: str
    where: P.Predicate | None = None


@dataclass(frozen=True)
class Within:
    path: str
    alias: str | None
    steps: tuple["Step", ...]


@dataclass(frozen=True)
class Where:
    predicate: P.Predicate


Step = Enrich | Within | Where


@dataclass(frozen=True)
class Budget:
    documents: int | None = None
    bytes: int | None = None
    result_bytes: int | None = None

    def merged(self, other: Budget | None) -> Budget:
        """The stricter of both, limit by limit."""
        if other is None:
            return self
        least = lambda a, b: b if a is None else a if b is None else min(a, b)
        return Budget(least(self.documents, other.documents), least(self.bytes, other.bytes), least(self.result_bytes, other.result_bytes))


@dataclass(frozen=True)
class Plan:
    source: str
    alias: str | None = None
    where: P.Predicate | None = None
    steps: tuple[Step, ...] = ()
    group: tuple[str, ...] | None = None
    aggregates: tuple[Aggregate, ...] = ()
    project: tuple[str, ...] | None = None
    brace: tuple[Item, ...] | None = None
    order: tuple[OrderTerm, ...] = ()
    limit: int | None = None
    page_size: int = PAGE_DEFAULT
    allow_incomplete: bool = False
    current: bool = False
    budget: Budget = Budget()

    @property
    def grouped(self) -> bool:
        return self.group is not None or bool(self.aggregates)

    def checked(self) -> Plan:
        """The plan, or the reason it can't run."""
        if not 1 <= self.page_size <= PAGE_MOST:
            raise StaticError("bad_page_size", str(self.page_size))
        if len(self.order) > ORDER_TERMS:
            raise StaticError("too_many_order_terms")
        if len(self.project or ()) > PROJECT_ITEMS:
            raise StaticError("too_many_projected_items")
        if self.limit is not None and self.limit < 0:
            raise StaticError("bad_limit")
        for path in (*(self.project or ()), *(self.group or ()), *(t.path for t in self.order)):
            parse_path(path)
        if self.grouped:
            names = [g.split(".")[-1] for g in self.group or ()] + [a.name for a in self.aggregates]
            if len(set(names)) < len(names):
                raise StaticError("duplicate_output", ", ".join(names))
            if self.steps or self.brace is not None:
                raise StaticError("group_with_attachment")
        if self.brace is not None:
            _check_items(self.brace, 1)
        _check_steps(self.steps, 1)
        if self.project is not None and self.steps:
            needed = {s.left.split(".")[0] for s in self.steps if isinstance(s, Enrich)} | {s.path.split(".")[0] for s in self.steps if isinstance(s, Within)}
            kept = {p.split(".")[0] for p in self.project if "." not in p} | {s.name for s in self.steps if isinstance(s, Enrich)} | {"_key", "$key"}
            if self.steps and needed - kept:
                raise StaticError("projection_drops_attachment_path", ", ".join(sorted(needed - kept)))
        if self.where is not None and P.count_nodes(self.where) > 4096:
            raise StaticError("predicate_too_large")
        return self

    def canonical(self) -> str:
        return json.dumps(_json(self), sort_keys=True, separators=(",", ":"), ensure_ascii=False)

    def hash(self) -> str:
        return hashlib.blake2b(self.canonical().encode(), digest_size=32, person=b"larkspan-plan-1").hexdigest()

    def explain(self) -> dict[str, Any]:
        """The plan as a tree and its hash; no rows are read."""
        ops = ["bind", "scan"] + ["filter"] * (self.where is not None) + ["group"] * self.grouped + ["order"] + ["limit"] * (self.limit is not None) + ["page"]
        ops += [type(s).__name__.lower() for s in self.steps] + ["project"] * (self.project is not None or self.brace is not None)
        return {"hash": self.hash(), "operators": ops, "plan": _json(self)}


def _check_items(items: tuple[Item, ...], depth: int) -> None:
    if depth > DEPTH:
        raise StaticError("projection_too_deep")
    names = [i.name for i in items]
    if len(set(names)) < len(names):
        raise StaticError("duplicate_output", ", ".join(names))
    for i in items:
        if i.items is not None:
            _check_items(i.items, depth + 1)


def _check_steps(steps: tuple[Step, ...], depth: int) -> None:
    if depth > DEPTH + 1:
        raise StaticError("within_too_deep")
    for s in steps:
        if isinstance(s, Within):
            _check_steps(s.steps, depth + 1)
        elif isinstance(s, Enrich) and s.cardinality not in CARDINALITIES:
            raise StaticError("bad_cardinality", s.cardinality)


def _json(x: Any) -> Any:
    if isinstance(x, P.Const | P.Compare | P.In | P.Test | P.StartsWith | P.Contains | P.And | P.Or | P.Not):
        return P.to_json(x)
    if isinstance(x, tuple):
        return [_json(v) for v in x]
    if hasattr(x, "__dataclass_fields__"):
        made = {k: _json(getattr(x, k)) for k in x.__dataclass_fields__}
        return ({"step": type(x).__name__.lower()} if isinstance(x, Enrich | Within | Where) else {}) | made
    return x


def plan_from_json(x: Mapping[str, Any]) -> Plan:
    """The inverse of the canonical JSON."""

    def steps(found: list[Mapping[str, Any]]) -> tuple[Step, ...]:
        out: list[Step] = []
        for s in found:
            if s["step"] == "where":
                out.append(Where(P.from_json(s["predicate"])))
            elif s["step"] == "within":
                out.append(Within(s["path"], s["alias"], steps(s["steps"])))
            else:
                out.append(Enrich(s["name"], s["source"], s["alias"], s["left"], s["right"], s["cardinality"], P.from_json(s["where"]) if s["where"] else None))
        return tuple(out)

    def items(found: list[Mapping[str, Any]] | None) -> tuple[Item, ...] | None:
        return None if found is None else tuple(Item(i["name"], i["path"], items(i["items"])) for i in found)

    return Plan(
        x["source"], x["alias"], P.from_json(x["where"]) if x["where"] else None, steps(x["steps"]), None if x["group"] is None else tuple(x["group"]),
        tuple(Aggregate(**a) for a in x["aggregates"]), None if x["project"] is None else tuple(x["project"]), items(x["brace"]), tuple(OrderTerm(**t) for t in x["order"]),
        x["limit"], x["page_size"], x["allow_incomplete"], x["current"], Budget(**x["budget"]),
    ).checked()


class Builder:
    """The fluent way to a plan."""

    def __init__(self, source: str, alias: str | None = None) -> None:
        self.plan = Plan(source, alias)

    def _with(self, **changes: Any) -> Builder:
        self.plan = replace(self.plan, **changes)
        return self

    def where(self, predicate: P.Predicate | P.Built) -> Builder:
        new = P.node(predicate)
        if self.plan.steps:
            return self._with(steps=(*self.plan.steps, Where(new)))
        return self._with(where=new if self.plan.where is None else P.And((self.plan.where, new)))

    def group_by(self, *paths: str) -> Builder:
        return self._with(group=tuple(paths))

    def aggregate(self, fn: str, name: str, path: str | None = None) -> Builder:
        if fn not in AGGREGATES or (path is None) != (fn == "count"):
            raise StaticError("bad_aggregate", fn)
        return self._with(aggregates=(*self.plan.aggregates, Aggregate(fn, path, name)))

    def project(self, *paths: str) -> Builder:
        return self._with(project=tuple(paths))

    def brace(self, *items: Item) -> Builder:
        return self._with(brace=tuple(items))

    def order_by(self, path: str, descending: bool = False, nulls_first: bool = False) -> Builder:
        return self._with(order=(*self.plan.order, OrderTerm(path, descending, nulls_first)))

    def limit(self, n: int) -> Builder:
        return self._with(limit=n)

    def page_size(self, n: int) -> Builder:
        return self._with(page_size=n)

    def enrich(self, name: str, source: str, left: str, right: str, cardinality: str, where: P.Predicate | P.Built | None = None, alias: str | None = None) -> Builder:
        return self._with(steps=(*self.plan.steps, Enrich(name, source, alias, left, right, cardinality, P.node(where))))

    def within(self, path: str, *steps: Step, alias: str | None = None) -> Builder:
        return self._with(steps=(*self.plan.steps, Within(path, alias, tuple(steps))))

    def allow_incomplete(self) -> Builder:
        return self._with(allow_incomplete=True)

    def budget(self, **limits: int) -> Builder:
        return self._with(budget=Budget(**limits))

    def build(self) -> Plan:
        return self.plan.checked()

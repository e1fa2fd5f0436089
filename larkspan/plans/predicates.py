"""Predicates: frozen trees, their JSON form, and their compilation to Columns.

Two profiles share the leaves.  A *total* predicate is false wherever an
operand is absent.  A *filter* is as document databases have it: ``ne`` holds
for a missing field.  Every compiled predicate is two-valued: never NULL.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspan.errors import StaticError
from larkspan.functions.values import Scope, Slot, family, kind_of

_MAX_NODES = 4096
COMPARISONS = ("eq", "ne", "lt", "lte", "gt", "gte")


@dataclass(frozen=True)
class Path:
    name: str


@dataclass(frozen=True)
class Lit:
    value: Any  # None, bool, int, float, str, or a tuple of these


@dataclass(frozen=True)
class Param:
    name: str


Operand = Path | Lit | Param


@dataclass(frozen=True)
class Const:
    value: bool


@dataclass(frozen=True)
class Compare:
    op: str
    left: Operand
    right: Operand


@dataclass(frozen=True)
class In:
    left: Operand
    values: tuple[Operand, ...]
    negated: bool = False


@dataclass(frozen=True)
class Test:
    """present, missing, is_null, is_not_null."""

    op: str
    path: Path


@dataclass(frozen=True)
class StartsWith:
    path: Path
    prefix: Operand


@dataclass(frozen=True)
class Contains:
    path: Path
    value: Operand


@dataclass(frozen=True)
class And:
    parts: tuple["Predicate", ...]


@dataclass(frozen=True)
class Or:
    parts: tuple["Predicate", ...]


@dataclass(frozen=True)
class Not:
    part: "Predicate"


Predicate = Const | Compare | In | Test | StartsWith | Contains | And | Or | Not


class Field:
    """Fluent leaves: ``field("a.b").eq(1) & ~field("c").present()``."""

    def __init__(self, path: str) -> None:
        self.path = Path(path)

    def _compare(self, op: str, value: Any) -> Built:
        return Built(Compare(op, self.path, operand(value)))

    def eq(self, value: Any) -> Built:
        return self._compare("eq", value)

    def ne(self, value: Any) -> Built:
        return self._compare("ne", value)

    def lt(self, value: Any) -> Built:
        return self._compare("lt", value)

    def lte(self, value: Any) -> Built:
        return self._compare("lte", value)

    def gt(self, value: Any) -> Built:
        return self._compare("gt", value)

    def gte(self, value: Any) -> Built:
        return self._compare("gte", value)

    def isin(self, *values: Any) -> Built:
        return Built(In(self.path, tuple(map(operand, values))))

    def not_in(self, *values: Any) -> Built:
        return Built(In(self.path, tuple(map(operand, values)), True))

    def present(self) -> Built:
        return Built(Test("present", self.path))

    def missing(self) -> Built:
        return Built(Test("missing", self.path))

    def is_null(self) -> Built:
        return Built(Test("is_null", self.path))

    def is_not_null(self) -> Built:
        return Built(Test("is_not_null", self.path))

    def starts_with(self, prefix: str) -> Built:
        return Built(StartsWith(self.path, operand(prefix)))

    def contains(self, value: Any) -> Built:
        return Built(Contains(self.path, operand(value)))


@dataclass(frozen=True)
class Built:
    node: Predicate

    def __and__(self, other: Built) -> Built:
        return Built(And((self.node, other.node)))

    def __or__(self, other: Built) -> Built:
        return Built(Or((self.node, other.node)))

    def __invert__(self) -> Built:
        return Built(Not(self.node))


def field(path: str) -> Field:
    return Field(path)


def operand(value: Any) -> Operand:
    if isinstance(value, Path | Lit | Param):
        return value
    if isinstance(value, Field):
        return value.path
    return Lit(tuple(value) if isinstance(value, list | tuple) else value)


def node(p: Predicate | Built | None) -> Predicate | None:
    return p.node if isinstance(p, Built) else p


def count_nodes(p: Predicate) -> int:
    children = p.parts if isinstance(p, And | Or) else (p.part,) if isinstance(p, Not) else ()
    return 1 + sum(map(count_nodes, children))


# JSON form


def _operand_json(x: Operand) -> Any:
    if isinstance(x, Path):
        return {"path": x.name}
    if isinstance(x, Param):
        return {"param": x.name}
    return {"lit": list(x.value) if isinstance(x.value, tuple) else x.value}


def _operand_of(x: Mapping[str, Any]) -> Operand:
    if "path" in x:
        return Path(x["path"])
    if "param" in x:
        return Param(x["param"])
    return operand(x["lit"])


def to_json(p: Predicate) -> dict[str, Any]:
    match p:
        case Const(value):
            return {"op": "true" if value else "false"}
        case Compare(op, left, right):
            return {"op": op, "left": _operand_json(left), "right": _operand_json(right)}
        case In(left, values, negated):
            return {"op": "not_in" if negated else "in", "left": _operand_json(left), "values": [_operand_json(v) for v in values]}
        case Test(op, path):
            return {"op": op, "path": path.name}
        case StartsWith(path, prefix):
            return {"op": "starts_with", "path": path.name, "value": _operand_json(prefix)}
        case Contains(path, value):
            return {"op": "contains", "path": path.name, "value": _operand_json(value)}
        case And(parts) | Or(parts):
            return {"op": "and" if isinstance(p, And) else "or", "parts": [to_json(x) for x in parts]}
        case Not(part):
            return {"op": "not", "part": to_json(part)}
    raise StaticError("bad_predicate", repr(p))


def from_json(x: Mapping[str, Any]) -> Predicate:
    op = x["op"]
    if op in ("true", "false"):
        return Const(op == "true")
    if op in COMPARISONS:
        return Compare(op, _operand_of(x["left"]), _operand_of(x["right"]))
    if op in ("in", "not_in"):
        return In(_operand_of(x["left"]), tuple(map(_operand_of, x["values"])), op == "not_in")
    if op in ("present", "missing", "is_null", "is_not_null"):
        return Test(op, Path(x["path"]))
    if op == "starts_with":
        return StartsWith(Path(x["path"]), _operand_of(x["value"]))
    if op == "contains":
        return Contains(Path(x["path"]), _operand_of(x["value"]))
    if op in ("and", "or"):
        parts = tuple(map(from_json, x["parts"]))
        return And(parts) if op == "and" else Or(parts)
    if op == "not":
        return Not(from_json(x["part"]))
    raise StaticError("bad_predicate", str(op))


# compilation



def _literal(value: Any) -> Slot:
    if isinstance(value, tuple):
        if not value:
            return Slot(F.lit(True), F.array().cast("array<string>"), T.ArrayType(T.StringType()))
        kinds = {type(v) for v in value}
        if not kinds <= {int, float} and len(kinds) > 1:
            raise StaticError("mixed_array_literal", repr(value))
        dtype = {bool: T.BooleanType(), str: T.StringType()}.get(type(value[0]), T.DoubleType() if float in kinds else T.LongType())
        return Slot(F.lit(True), F.array(*[F.lit(v).cast(dtype) for v in value]), T.ArrayType(dtype))
    dtype = {type(None): T.NullType(), bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}.get(type(value))
    if dtype is None:
        raise StaticError("bad_literal", repr(value))
    return Slot(F.lit(True), F.lit(value), dtype)


class Compiler:
    """Compiles predicates against one scope with bound parameters."""

    def __init__(self, scope: Scope, params: Mapping[str, Any] | None = None, filter_profile: bool = False) -> None:
        self.scope, self.params, self.filter_profile = scope, params or {}, filter_profile

    def slot(self, x: Operand) -> Slot:
        if isinstance(x, Path):
            return self.scope.resolve(x.name)
        if isinstance(x, Param):
            if x.name not in self.params:
                raise StaticError("unbound_parameter", x.name)
            value = self.params[x.name]
            return _literal(tuple(value) if isinstance(value, list) else value)
        return _literal(x.value)

    def compile(self, p: Predicate) -> Column:
        if count_nodes(p) > _MAX_NODES:
            raise StaticError("predicate_too_large")
        return self._compile(p)

    def condition(self, p: Predicate) -> Column:
        """For use as a filter only: may be NULL for false, so that comparisons reach the scan.

        Outside a negation NULL and false drop the same rows, through AND and OR alike.
        """
        if count_nodes(p) > _MAX_NODES:
            raise StaticError("predicate_too_large")
        return self._condition(p)

    def _condition(self, p: Predicate) -> Column:
        match p:
            case And(parts) if parts:
                return reduce(lambda a, b: a & b, map(self._condition, parts))
            case Or(parts) if parts:
                return reduce(lambda a, b: a | b, map(self._condition, parts))
            case Compare(op, left, right) if op in COMPARISONS[2:]:
                a, b = self.slot(left), self.slot(right)
                if a.kind == b.kind and a.kind in ("num", "str", "time"):
                    return a.present & b.present & _less(op, a.value, b.value)
            case Compare("eq", left, Lit(value) as right) if value is not None:
                a, b = self.slot(left), self.slot(right)
                if a.kind == b.kind and a.kind in ("num", "str", "bool"):
                    return a.present & (a.value == b.value)
            case StartsWith(path, prefix):
                a, b = self.slot(path), self.slot(prefix)
                if a.kind == b.kind == "str":
                    return a.present & F.startswith(a.value, b.value)
        return self._compile(p)

    def _compile(self, p: Predicate) -> Column:
        match p:
            case Const(value):
                return F.lit(value)
            case And(parts):
                return reduce(lambda a, b: a & b, map(self._compile, parts), F.lit(True)) if parts else F.lit(True)
            case Or(parts):
                return reduce(lambda a, b: a | b, map(self._compile, parts)) if parts else F.lit(False)
            case Not(part):
                return ~self._compile(part)
            case Compare(op, left, right):
                return self._comparison(op, left, right)
            case In(left, values, negated):
                a = self.slot(left)
                inside = reduce(lambda x, y: x | y, (_equal(a, self.slot(v)) for v in values), F.lit(False)) if values else F.lit(False)
                return (a.present & ~inside) if negated else (a.present & inside)
            case Test(op, path):
                return self._test(op, self.slot(path))
            case StartsWith(path, prefix):
                a, b = _text(self.slot(path)), _text(self.slot(prefix))
                return F.lit(False) if a is None or b is None else F.coalesce(F.startswith(a, b), F.lit(False))
            case Contains(path, value):
                return self._contains(self.slot(path), self.slot(value))
        raise StaticError("bad_predicate", repr(p))

    def _comparison(self, op: str, left: Operand, right: Operand) -> Column:
        a, b = self.slot(left), self.slot(right)
        both = a.present & b.present
        if op == "eq":
            return both & _equal(a, b)
        if op == "ne":
            differs = both & ~_equal(a, b)
            return (~a.present | differs) if self.filter_profile else differs
        return both & _ordered(op, a, b, self.filter_profile)

    @staticmethod
    def _test(op: str, a: Slot) -> Column:
        null = (family(a.value) == "null") if a.kind == "variant" else a.value.isNull()
        null = F.coalesce(null, F.lit(False))
        return {"present": a.present, "missing": ~a.present, "is_null": a.present & null, "is_not_null": a.present & ~null}[op]

    @staticmethod
    def _contains(a: Slot, b: Slot) -> Column:
        if a.kind == "array":
            element = a.dtype.elementType
            return a.present & F.coalesce(F.exists(a.value, lambda x: _equal(Slot(F.lit(True), x, element), b)), F.lit(False))
        if a.kind == "variant":
            items = F.try_variant_get(a.value, "$", "array<variant>")
            inside = F.exists(items, lambda x: _equal(Slot(F.lit(True), x, T.VariantType()), b))
            text = _text(b)
            substring = F.contains(_text(a), text) if text is not None else F.lit(False)
            return a.present & F.coalesce(F.when(family(a.value) == "array", inside).otherwise(substring), F.lit(False))
        x, y = _text(a), _text(b)
        return F.lit(False) if x is None or y is None else F.coalesce(F.contains(x, y), F.lit(False))


def _text(a: Slot) -> Column | None:
    if a.kind == "str":
        return a.value
    if a.kind == "variant":
        return F.when(family(a.value) == "str", F.try_variant_get(a.value, "$", "string"))
    return None


def _as(v: Slot, kind: str, like: T.DataType) -> Slot:
    """A VARIANT as a typed value of that kind; NULL of another kind."""
    name = {"num": "decimal(38,12)", "str": "string", "bool": "boolean"}.get(kind)
    if name is None:
        return Slot(v.present, F.lit(None), T.NullType())
    return Slot(v.present, F.when(family(v.value) == kind, F.try_variant_get(v.value, "$", name)), T._parse_datatype_string(name))


def _equal(a: Slot, b: Slot) -> Column:
    """Equality of present values, null equal to null; numbers by value, other kinds never equal across."""
    if a.kind == "variant" and b.kind == "variant":
        from larkspan.functions.values import canonical

        return canonical(Slot(F.lit(True), a.value, a.dtype)).eqNullSafe(canonical(Slot(F.lit(True), b.value, b.dtype)))
    if b.kind == "variant":
        a, b = b, a
    if a.kind == "variant":
        if b.kind == "null":
            return F.coalesce(family(a.value) == "null", F.lit(False))
        if b.kind == "array":
            items = F.try_variant_get(a.value, "$", b.dtype.simpleString())
            return F.coalesce((family(a.value) == "array") & items.eqNullSafe(b.value), F.lit(False))
        typed = _as(a, b.kind, b.dtype)
        return F.coalesce(typed.value == b.value, F.coalesce(family(a.value) == "null", F.lit(False)) & b.value.isNull())
    if "null" in (a.kind, b.kind):
        return (b if a.kind == "null" else a).value.isNull() if a.kind != b.kind else F.lit(True)
    if a.kind == b.kind == "array" and kind_of(a.dtype.elementType) != kind_of(b.dtype.elementType):
        # Without an element in common only empty arrays are equal, such as the literal [].
        return F.coalesce((F.size(a.value) == 0) & (F.size(b.value) == 0), F.lit(False)) | (a.value.isNull() & b.value.isNull())
    if a.kind == b.kind:
        return a.value.eqNullSafe(b.value)
    if {a.kind, b.kind} == {"time", "str"}:
        t, s = (a, b) if a.kind == "time" else (b, a)
        return t.value.eqNullSafe(s.value.try_cast(t.dtype))
    return a.value.isNull() & b.value.isNull()


def _ordered(op: str, a: Slot, b: Slot, bools: bool) -> Column:
    """Order of numbers or of strings (times too; booleans in filters); false across kinds."""
    if a.kind == "variant" and b.kind == "variant":
        kinds = ["num", "str", *(["bool"] if bools else [])]
        each = [F.when((family(a.value) == k) & (family(b.value) == k), _less(op, _as(a, k, a.dtype).value, _as(b, k, b.dtype).value)) for k in kinds]
        return F.coalesce(*each, F.lit(False))
    if a.kind == "variant":
        a = _as(a, b.kind, b.dtype)
    elif b.kind == "variant":
        b = _as(b, a.kind, a.dtype)
    if {a.kind, b.kind} == {"time", "str"}:
        return F.coalesce(_less(op, a.value if a.kind == "time" else a.value.try_cast(b.dtype), b.value if b.kind == "time" else b.value.try_cast(a.dtype)), F.lit(False))
    if a.kind != b.kind or a.kind not in ("num", "str", "time", *(["bool"] if bools else [])):
        return F.lit(False)
    return F.coalesce(_less(op, a.value, b.value), F.lit(False))


def _less(op: str, x: Column, y: Column) -> Column:
    return {"lt": x < y, "lte": x <= y, "gt": x > y, "gte": x >= y}[op]


def columns_used(p: Predicate | None) -> set[str]:
    """The paths a predicate reads."""
    if p is None:
        return set()
    match p:
        case Compare(_, left, right):
            return {x.name for x in (left, right) if isinstance(x, Path)}
        case In(left, values, _):
            return {x.name for x in (left, *values) if isinstance(x, Path)}
        case Test(_, path) | StartsWith(path, _) | Contains(path, _):
            return {path.name}
        case And(parts) | Or(parts):
            return set().union(*map(columns_used, parts)) if parts else set()
        case Not(part):
            return columns_used(part)
    return set()


__all__ = ["And", "Built", "Compare", "Compiler", "Const", "Contains", "Field", "In", "Lit", "Not", "Or", "Param", "Path", "Predicate", "StartsWith", "Test", "columns_used", "count_nodes", "field", "from_json", "kind_of", "node", "operand", "to_json"]

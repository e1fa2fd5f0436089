"""Value families of typed and VARIANT columns, and what depends on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspan.errors import StaticError

#: Decimal text that counts as a number in aggregates ("1d" or "NaN" doesn't).
NUMERIC_TEXT = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
_MAX_SEGMENTS = 64


def kind_of(dtype: T.DataType) -> str:
    """The family of a type: null, bool, num, str, bytes, time, array, object, variant."""
    for name, types in (("null", T.NullType), ("bool", T.BooleanType), ("num", T.NumericType), ("str", T.StringType), ("bytes", T.BinaryType), ("time", (T.DateType, T.TimestampType, T.TimestampNTZType)), ("array", T.ArrayType), ("object", (T.StructType, T.MapType)), ("variant", T.VariantType)):
        if isinstance(dtype, types):
            return name
    return "other"


@dataclass(frozen=True)
class Slot:
    """What a path leads to: whether it is there, its value and its type.

    A declared column is always there, also when null; inside a VARIANT a
    missing field is not.
    """

    present: Column
    value: Column
    dtype: T.DataType

    @property
    def kind(self) -> str:
        return kind_of(self.dtype)


def absent() -> Slot:
    return Slot(F.lit(False), F.lit(None), T.NullType())


def parse_path(path: str) -> tuple[str, ...]:
    parts = tuple(path.split("."))
    if not all(parts) or len(parts) > _MAX_SEGMENTS:
        raise StaticError("bad_path", path)
    return parts


def _variant(value: Column, parts: tuple[str, ...], guard: Column) -> Slot:
    if not parts:
        return Slot(guard & value.isNotNull(), value, T.VariantType())
    step = "$" + "".join("['" + p.replace("\\", "\\\\").replace("'", "\\'") + "']" for p in parts)
    found = F.try_variant_get(value, step, "variant")
    return Slot(guard & found.isNotNull(), found, T.VariantType())


def descend(root: Column, dtype: T.DataType, parts: tuple[str, ...], present: Column | None = None) -> Slot:
    """Follow ``parts`` from a value; objects only, arrays are never entered."""
    here = F.lit(True) if present is None else present
    for i, name in enumerate(parts):
        if isinstance(dtype, T.VariantType):
            return _variant(root, parts[i:], here)
        if isinstance(dtype, T.StructType) and name in dtype.names:
            if i:
                here = here & root.isNotNull()
            root, dtype = root.getField(name), dtype[name].dataType
        elif isinstance(dtype, T.MapType) and isinstance(dtype.keyType, T.StringType):
            here = here & F.coalesce(F.map_contains_key(root, F.lit(name)), F.lit(False))
            root, dtype = F.try_element_at(root, F.lit(name)), dtype.valueType
        else:
            return absent()
    if isinstance(dtype, T.VariantType):
        return _variant(root, (), here)
    return Slot(here, root, dtype)


class Scope:
    """Resolves dotted paths against the current row (or an array element).

    ``columns`` are the row's fields; ``body`` names a VARIANT column whose
    fields count as the row's own; ``aliases`` are prefixes a path may carry.
    """

    def __init__(self, schema: T.StructType, body: str | None = None, aliases: tuple[str, ...] = (), element: Column | None = None) -> None:
        self.schema, self.body, self.aliases, self.element = schema, body, aliases, element

    def _column(self, name: str) -> Column:
        return F.col(f"`{name}`") if self.element is None else self.element.getField(name)

    def resolve(self, path: str) -> Slot:
        parts = parse_path("_key" if path == "$key" else path)
        if len(parts) > 1 and parts[0] in self.aliases:
            parts = parts[1:]
        if isinstance(self.schema, T.StructType):
            dotted = ".".join(parts)
            if dotted in self.schema.names:
                return descend(self._column(dotted), self.schema[dotted].dataType, ())
            if parts[0] in self.schema.names and parts[0] != self.body:
                return descend(self._column(parts[0]), self.schema[parts[0]].dataType, parts[1:])
            if self.body is not None:
                return descend(self._column(self.body), self.schema[self.body].dataType, parts)
            return absent()
        return descend(self.element, self.schema, parts)

    def __contains__(self, path: str) -> bool:
        return not isinstance(self.resolve(path).dtype, T.NullType)


def family(v: Column) -> Column:
    """Of a VARIANT: null, bool, num, str, array, object or other; SQL NULL if absent."""
    s = F.schema_of_variant(v)
    return (
        F.when(s == "VOID", "null").when(s == "BOOLEAN", "bool").when(s == "STRING", "str")
        .when(s.rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"), "num")
        .when(s.startswith("ARRAY"), "array").when(s.startswith("OBJECT"), "object").when(s.isNotNull(), "other")
    )


def number(slot: Slot) -> Column:
    """The value as a double for sums and the like: numbers and decimal text; else NULL."""
    text = lambda c: F.when(c.rlike(NUMERIC_TEXT), c.try_cast("double"))
    if slot.kind == "num":
        return slot.value.cast("double")
    if slot.kind == "str":
        return text(slot.value)
    if slot.kind == "variant":
        f = family(slot.value)
        found = F.when(f == "num", F.try_variant_get(slot.value, "$", "double")).when(f == "str", text(F.try_variant_get(slot.value, "$", "string")))
        return F.when(~F.isnan(found) & (F.abs(found) != F.lit(float("inf"))), found)
    return F.lit(None).cast("double")


def canonical(slot: Slot) -> Column:
    """A string equal for equal values, whatever their types: for joins, groups and distinct.

    Numbers are equal by value (1 = 1.0), null equals null; SQL NULL means absent.
    """
    if slot.kind == "null":
        text = F.lit("null")
    elif slot.kind == "variant":
        f, v = family(slot.value), slot.value
        exact = F.try_variant_get(v, "$", "decimal(38,12)")
        plain = F.regexp_replace(F.regexp_replace(exact.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
        text = F.when(f == "num", F.concat(F.lit("n:"), F.coalesce(plain, F.try_variant_get(v, "$", "double").cast("string")))).when(f == "null", F.lit("null")).when(f == "str", F.concat(F.lit("str:"), F.try_variant_get(v, "$", "string"))).otherwise(F.concat(f, F.lit(":"), F.to_json(v)))
    elif slot.kind == "num":
        exact = slot.value.try_cast("decimal(38,12)")
        plain = F.regexp_replace(F.regexp_replace(exact.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
        text = F.coalesce(F.concat(F.lit("n:"), F.coalesce(plain, slot.value.cast("double").cast("string"))), F.lit("null"))
    elif slot.kind in ("array", "object"):
        text = F.coalesce(F.concat(F.lit(slot.kind + ":"), F.to_json(slot.value)), F.lit("null"))
    elif slot.kind == "str":
        text = F.coalesce(F.concat(F.lit("str:"), slot.value), F.lit("null"))
    else:
        text = F.coalesce(F.concat(F.lit(slot.kind + ":"), slot.value.cast("string")), F.lit("null"))
    return F.when(slot.present, text)

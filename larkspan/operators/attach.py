"""Attachments with a stated cardinality, and work inside nested arrays.

An attachment is a left join against the other side *pre-aggregated by its
key*, so it never multiplies rows.  Where a cardinality is stated, its
violations are counted before the result is built: a lazy assertion inside the
plan could be pruned away with an unused column.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspan.catalog import Collection, Database
from larkspan.errors import CardinalityError, StaticError
from larkspan.functions.values import Scope, Slot, canonical
from larkspan.plans.predicates import Compiler, columns_used
from larkspan.plans.query import Enrich, Item, Plan, Step, Where, Within


def _document(side: Collection, fields: set[str] | None = None) -> Column:
    """A foreign row as one value: its VARIANT body, or a struct of its columns (or of those that are used)."""
    if side.body:
        return F.col(side.body)
    names = [c for c in side.rows.columns if fields is None or c in fields]
    return F.struct(*[F.col(f"`{c}`") for c in names or side.rows.columns[:1]])


def used_fields(plan: Plan, name: str) -> set[str] | None:
    """The fields of an attachment that a plan reads; None for all of them.

    An aggregate of whole documents would keep every column in the scan.
    """
    if plan.brace is None:
        return None
    paths = [i.path if i.items is None else f"{i.path}.{j.path}" for i in plan.brace for j in (i.items or (i,))]
    for s in plan.steps:
        if isinstance(s, Within):
            paths.append(s.path)
        elif isinstance(s, Enrich):
            paths += [s.left, *columns_used(s.where)]
        else:
            paths += columns_used(s.predicate)
    cut = [p.split(".") for p in paths]
    cut = [c[1:] if len(c) > 1 and c[0] in (plan.alias, plan.source) else c for c in cut]
    mine = [c for c in cut if c[0] == name]
    return None if any(len(c) == 1 for c in mine) else {c[1] for c in mine}


def join_keys(left: Slot, right: Slot) -> tuple[Column, Column]:
    """Columns equal exactly for equal values: the values themselves where the types agree."""
    same = {left.kind, right.kind}
    if len(same) == 1 and not same & {"variant", "array", "object", "null"}:
        return left.value, right.value
    return canonical(left), canonical(right)


@dataclass(frozen=True)
class _Attached:
    """Where an attachment's documents come from."""

    side: Collection
    rows: DataFrame
    aliases: tuple[str, ...]
    cardinality: str


def _violated(left: DataFrame, right: DataFrame, cardinality: str) -> bool:
    """Whether a key of ``left`` (__k, null where absent: __p false) has too many rows in ``right`` (__k), or none where one is wanted.

    One aggregation of both sides' keys, with partial sums before its shuffle;
    documents aren't read and nothing is joined.
    """
    sides = left.select("__k", "__p", F.lit(0).alias("__r")).unionAll(right.select("__k", F.lit(None).cast("boolean"), F.lit(1)))
    keys = sides.groupBy("__k").agg(F.max("__p").alias("some"), F.min("__p").alias("all"), F.sum("__r").alias("n"))
    many = F.coalesce(F.col("some"), F.lit(False)) & (F.col("n") > 1)
    if cardinality == "exactly_one":
        many = many | (F.coalesce(F.col("some"), F.lit(False)) & (F.col("n") == 0)) | ~F.coalesce(F.col("all"), F.lit(True))
    return keys.where(many).limit(1).count() > 0


def enrich(df: DataFrame, scope: Scope, step: Enrich, db: Database, params: Mapping[str, Any], strict: bool = True, fields: set[str] | None = None, known: dict[str, _Attached] | None = None, top: str | None = None) -> DataFrame:
    """Attach ``step.name``: one row, an optional row or null, or all rows by key.

    ``known`` are attachments made before, ``top`` names a flag of rows that
    only carry their document and match nothing.
    """
    if step.name in df.columns:
        raise StaticError("field_exists", step.name)
    side = db[step.source]
    aliases = tuple(x for x in (step.alias, step.source) if x)
    inner = side.scope(aliases)
    right = side.rows
    if step.where is not None:
        right = right.where(Compiler(inner, params).condition(step.where))
    l, r = scope.resolve(step.left), inner.resolve(step.right)
    lk, rk = join_keys(l, r)
    many = step.cardinality == "many"
    ties = [t for t in side.ties if t in right.columns]
    keyed = right.where(r.present).select(rk.alias("__rk"), F.struct(*[F.col(f"`{t}`") for t in ties]).alias("__order"), _document(side, fields).alias("__doc"))
    if many:
        # Ordered by the foreign key; a VARIANT can't be compared, so it rides behind the key.
        listed = F.collect_list(F.struct("__order", "__doc")) if side.body is None else F.collect_list(F.struct("__order", F.to_json("__doc").alias("__doc")))
        got = F.transform(F.array_sort(listed), lambda x: x["__doc"] if side.body is None else F.parse_json(x["__doc"]))
        grouped = keyed.groupBy("__rk").agg(got.alias("__got"))
    else:
        grouped = keyed.groupBy("__rk").agg(F.count(F.lit(1)).alias("__n"), F.first("__doc").alias("__got"))
    real = F.lit(True) if top is None else ~F.col(top)
    if strict and not many:
        foreign = right.where(r.present).select(rk.alias("__k"))
        sure = False
        before = (known or {}).get(step.left.split(".")[0])
        if before is not None and "." in step.left and (before.cardinality == "exactly_one" or step.cardinality == "optional"):
            # Keys from an attachment made before: if all its documents are fine, so are those that were attached.
            slot = before.side.scope(before.aliases).resolve(step.left.split(".", 1)[1])
            if slot.kind == l.kind:
                sure = not _violated(before.rows.select(join_keys(slot, r)[0].alias("__k"), slot.present.alias("__p")), foreign, step.cardinality)
        if not sure and _violated(df.where(real).select(lk.alias("__k"), l.present.alias("__p")), foreign, step.cardinality):
            raise CardinalityError("cardinality", f"{step.name} expects {step.cardinality}")
    if known is not None:
        known[step.name] = _Attached(side, right, aliases, step.cardinality)
    joined = df.withColumns({"__lk": lk, "__lp": l.present & real}).join(grouped, F.col("__lp") & F.col("__lk").eqNullSafe(F.col("__rk")), "left")
    if not many:
        found = F.coalesce(F.col("__n"), F.lit(0))
        bad = (found > 1) if step.cardinality == "optional" else (found != 1)
        value = F.when(bad & real, F.raise_error(F.lit(f"cardinality: {step.name}"))).otherwise(F.col("__got"))
    else:
        value = F.coalesce(F.col("__got"), F.array().cast(grouped.schema["__got"].dataType))
    names = [F.col(f"`{c}`") for c in df.columns]
    return joined.select(*names, value.alias(step.name))


def _set_field(root: Column, dtype: T.DataType, parts: tuple[str, ...], value: Column) -> Column:
    if len(parts) == 1:
        return root.withField(f"`{parts[0]}`", value)
    return root.withField(f"`{parts[0]}`", _set_field(root.getField(parts[0]), dtype[parts[0]].dataType, parts[1:], value))


def _write(df: DataFrame, path: str, value: Column) -> DataFrame:
    parts = tuple(path.split("."))
    if len(parts) == 1:
        return df.withColumn(parts[0], value)
    root = df.schema[parts[0]].dataType
    return df.withColumn(parts[0], _set_field(F.col(f"`{parts[0]}`"), root, parts[1:], value))


def _only_filters(steps: tuple[Step, ...]) -> bool:
    return all(isinstance(s, Where) or (isinstance(s, Within) and _only_filters(s.steps)) for s in steps)


def _filtered(array: Column, dtype: T.DataType, step: Within, params: Mapping[str, Any]) -> Column:
    """``within`` of filters alone: higher-order functions, no rows are exploded."""
    element = dtype.elementType

    def one(x: Column, keep: bool) -> Column:
        scope = Scope(element, None, (step.alias,) if step.alias else (), x)
        if keep:
            test = F.lit(True)
            for s in step.steps:
                if isinstance(s, Where):
                    test = test & Compiler(scope, params).compile(s.predicate)
            return test
        for s in step.steps:
            if isinstance(s, Within):
                parts = tuple(s.path.split("."))
                inner = scope.resolve(s.path)
                _carrier(inner, s.path)
                x = _set_field(x, element, parts, _filtered(inner.value, inner.dtype, s, params))
        return x

    kept = F.filter(array, lambda x: one(x, True))
    return F.transform(kept, lambda x: one(x, False)) if any(isinstance(s, Within) for s in step.steps) else kept


def _carrier(slot: Slot, path: str) -> None:
    if slot.kind != "array":
        raise StaticError("within_carrier", f"{path} is {slot.kind}, not an array")


def within(df: DataFrame, scope: Scope, step: Within, db: Database, params: Mapping[str, Any], ties: tuple[str, ...], strict: bool = True, top: str | None = None) -> DataFrame:
    """Run steps on the elements of a nested array and write the array back.

    Elements keep their order, filtered ones drop, an empty array stays empty.
    A null or missing array is an error, found before the result is built.
    """
    slot = scope.resolve(step.path)
    _carrier(slot, step.path)
    real = F.lit(True) if top is None else ~F.col(top)
    if strict and df.where(real & (~slot.present | slot.value.isNull())).limit(1).count():
        raise StaticError("within_carrier", f"{step.path} is null or missing in a row")
    if _only_filters(step.steps):
        return _write(df, step.path, _filtered(slot.value, slot.dtype, step, params))
    # Attachments inside: explode with position, run the steps, regroup in order.
    ids = [t for t in ties if t in df.columns]
    if not ids:
        raise StaticError("within_needs_key", step.path)
    # A row before the elements carries the document's other columns, so that one aggregation puts all together again.
    others = [c for c in df.columns if c != step.path]
    names = slot.dtype.elementType.names
    elements = F.concat(F.array(F.lit(None).cast(slot.dtype.elementType)), F.coalesce(slot.value, F.array().cast(slot.dtype)))
    rows = df.select(*[F.col(f"`{t}`").alias(f"__id{i}") for i, t in enumerate(ids)], F.struct(*[F.col(f"`{c}`") for c in others]).alias("__document"), F.posexplode(elements).alias("__pos", "__el"))
    first = F.col("__pos") == 0
    flat = rows.select(*[f"__id{i}" for i in range(len(ids))], "__pos", first.alias("__top"), F.when(first, F.col("__document")).alias("__document"), *[F.col("__el").getField(n).alias(n) for n in names])
    flat = steps(flat, step.steps, db, params, (*[f"__id{i}" for i in range(len(ids))], "__pos"), strict, (step.alias,) if step.alias else (), top="__top")
    fields = [c for c in flat.columns if not c.startswith("__")]
    element = F.struct("__pos", F.struct(*[F.col(f"`{c}`") for c in fields]).alias("__el"))
    back = flat.groupBy(*[f"__id{i}" for i in range(len(ids))]).agg(F.first("__document", ignorenulls=True).alias("__document"), F.collect_list(F.when(~F.col("__top"), element)).alias("__array"))
    array = F.transform(F.array_sort("__array"), lambda x: x["__el"]).alias("__array")
    whole = back.select(*[F.col("__document").getField(c).alias(c) for c in others], array)
    return _write(whole, step.path, F.col("__array")).select(*[F.col(f"`{c}`") for c in df.columns])


def steps(df: DataFrame, found: tuple[Step, ...], db: Database, params: Mapping[str, Any], ties: tuple[str, ...], strict: bool = True, aliases: tuple[str, ...] = (), body: str | None = None, plan: Plan | None = None, top: str | None = None) -> DataFrame:
    """Run attachment steps in order; ``plan`` tells which fields of them are read, rows flagged by ``top`` pass."""
    known: dict[str, _Attached] = {}
    for s in found:
        scope = Scope(df.schema, body if body in df.columns else None, aliases)
        if isinstance(s, Where):
            test = Compiler(scope, params).condition(s.predicate)
            df = df.where(test if top is None else F.col(top) | test)
        elif isinstance(s, Enrich):
            df = enrich(df, scope, s, db, params, strict, used_fields(plan, s.name) if plan is not None else None, known, top)
        else:
            df = within(df, scope, s, db, params, ties, strict, top)
            known.clear()
    return df


def brace(scope: Scope, items: tuple[Item, ...]) -> list[Column]:
    """Columns of a brace projection; nested blocks follow structs and arrays."""
    out = []
    for i in items:
        slot = scope.resolve(i.path)
        if isinstance(slot.dtype, T.NullType):
            continue  # an absent field is left out
        out.append((slot.value if i.items is None else _block(slot, i)).alias(i.name))
    return out


def _block(slot: Slot, item: Item) -> Column:
    if isinstance(slot.dtype, T.StructType):
        return F.when(slot.value.isNotNull(), F.struct(*brace(Scope(slot.dtype, None, (), slot.value), item.items)))
    if isinstance(slot.dtype, T.ArrayType) and isinstance(slot.dtype.elementType, T.StructType):
        element = slot.dtype.elementType
        return F.transform(slot.value, lambda x: F.struct(*brace(Scope(element, None, (), x), item.items)))
    if isinstance(slot.dtype, T.VariantType):
        inner = Scope(slot.dtype, None, (), slot.value)
        fields = [F.try_variant_get(inner.resolve(i.path).value, "$", "variant").alias(i.name) for i in item.items]
        return F.when(slot.present, F.struct(*fields))
    raise StaticError("project_type", f"{item.path} is {slot.kind}, it has no fields")

"""A document layer with owners, soft deletion, versions and pipelines.

Policies are filters on every source that a query reads: what is deleted or
another owner's is never seen, whatever the pipeline does, at any depth.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspan.errors import EngineError, StaticError
from larkspan.functions.values import Scope
from larkspan.operators import graph
from larkspan.operators.attach import join_keys
from larkspan.plans.dialects import from_mongo
from larkspan.plans.predicates import Compiler

STRICT = {"$match", "$project", "$sort", "$skip", "$limit"}
DENIED = {"$out", "$merge", "$function", "$accumulator"}
FIRST = {"$search", "$geoNear", "$vectorSearch"}
MOST_STAGES, MOST_ROWS = 50, 1000
#: Documents of one facet of a result.
MOST_FACET = 100_000


def normalise(criteria: Any, key: str | None = None) -> Any:
    """Ids in criteria as they are stored: ``_uuid`` upper case, ``_owner`` trimmed."""
    if isinstance(criteria, Mapping):
        return {k: normalise(v, k if k in ("_uuid", "_owner") else key if k.startswith("$") and k not in ("$and", "$or", "$not") else None if not k.startswith("$") else key) for k, v in criteria.items()}
    if isinstance(criteria, list):
        return [normalise(v, key) for v in criteria]
    if isinstance(criteria, str) and key == "_uuid":
        return criteria.upper()
    return criteria.strip() if isinstance(criteria, str) and key == "_owner" else criteria


def mentions(criteria: Any, name: str) -> bool:
    if isinstance(criteria, Mapping):
        return any(k == name or mentions(v, name) for k, v in criteria.items())
    return isinstance(criteria, list) and any(mentions(v, name) for v in criteria)


def validate(pipeline: Sequence[Mapping[str, Any]], mode: str = "guarded", secure: Sequence[str] = ()) -> None:
    """Refuse what a mode doesn't allow, in nested pipelines too."""
    if mode not in ("loose", "guarded", "strict"):
        raise StaticError("bad_mode", mode)
    if len(pipeline) > MOST_STAGES:
        raise StaticError("too_many_stages")
    for stage in pipeline:
        if len(stage) != 1:
            raise StaticError("bad_stage", str(list(stage)))
        name, spec = next(iter(stage.items()))
        if mode == "strict" and name not in STRICT:
            raise StaticError("stage_refused", name)
        if mode != "loose" and _uses(spec, DENIED | {name} & DENIED) or (mode != "loose" and name in DENIED):
            raise StaticError("stage_refused", name)
        if name == "$limit" and mode != "loose" and not 1 <= spec <= MOST_ROWS:
            raise StaticError("bad_limit", str(spec))
        for prefix in secure:
            if _names(spec, prefix):
                raise StaticError("secure_field", prefix)
        for inner in _nested(name, spec):
            validate(inner, mode, secure)


def _uses(x: Any, names: set[str]) -> bool:
    if isinstance(x, Mapping):
        return any(k in names or _uses(v, names) for k, v in x.items())
    return isinstance(x, list) and any(_uses(v, names) for v in x)


def _names(x: Any, prefix: str) -> bool:
    if isinstance(x, Mapping):
        return any(k.split(".")[-1].startswith(prefix) or k.startswith(prefix) or _names(v, prefix) for k, v in x.items())
    if isinstance(x, list):
        return any(_names(v, prefix) for v in x)
    return isinstance(x, str) and x.startswith("$" + prefix)


def _nested(name: str, spec: Any) -> list[Sequence[Mapping[str, Any]]]:
    if name == "$facet":
        return list(spec.values())
    if name in ("$lookup", "$unionWith") and isinstance(spec, Mapping) and "pipeline" in spec:
        return [spec["pipeline"]]
    return []


@dataclass(frozen=True)
class Documents:
    """Named tables under one policy: not deleted, and of one owner if given."""

    tables: Mapping[str, DataFrame]
    owner: str | None = None
    strict_owner: bool = False
    secure: tuple[str, ...] = ()
    mode: str = "guarded"
    versions: Mapping[str, DataFrame] = field(default_factory=dict)

    # policy

    def _where(self, df: DataFrame, criteria: Mapping[str, Any]) -> DataFrame:
        return df.where(Compiler(Scope(df.schema), {}, filter_profile=True).condition(from_mongo(normalise(criteria)).node))

    def _visible(self, name: str, criteria: Mapping[str, Any] | None = None) -> DataFrame:
        if name not in self.tables:
            raise StaticError("unknown_collection", name)
        df = self.tables[name]
        if "_deleted" in df.columns and not mentions(criteria or {}, "_deleted"):
            df = df.where(~F.coalesce(F.col("_deleted"), F.lit(False)))
        if self.owner is not None:
            if criteria and mentions(criteria, "_owner") and normalise(criteria).get("_owner", self.owner) != self.owner:
                raise EngineError("owner_conflict", self.owner)
            if "_owner" in df.columns:
                df = df.where(F.col("_owner") == F.lit(self.owner))
            elif self.strict_owner:
                raise StaticError("no_owner_field", name)
        elif self.strict_owner:
            raise StaticError("owner_required", name)
        return df

    def _stripped(self, df: DataFrame) -> DataFrame:
        return df.drop(*[c for c in df.columns if any(c.startswith(p) for p in self.secure)])

    # reading

    def find(self, name: str, criteria: Mapping[str, Any] | None = None, projection: Sequence[str] | None = None, sort: Mapping[str, int] | None = None, skip: int = 0, limit: int | None = None) -> DataFrame:
        df = self._where(self._visible(name, criteria), criteria or {})
        if sort:
            df = df.orderBy(*_sorted(sort))
        df = df.offset(skip) if skip else df
        df = df if limit is None else df.limit(limit)
        return self._stripped(df if projection is None else df.select(*projection))

    def find_one(self, name: str, criteria: Mapping[str, Any]) -> DataFrame:
        return self.find(name, criteria, limit=1)

    def get(self, name: str, key: str) -> DataFrame:
        return self.find_one(name, {"_uuid": key})

    def count(self, name: str, criteria: Mapping[str, Any] | None = None) -> int:
        return self._where(self._visible(name, criteria), criteria or {}).count()

    def aggregate(self, name: str, pipeline: Sequence[Mapping[str, Any]], skip: int = 0, limit: int | None = None) -> DataFrame:
        """Run a pipeline of stages; each source it reads passes the policy."""
        validate(pipeline, self.mode, self.secure)
        first = pipeline[0].get("$match") if pipeline else None
        df = self._pipeline(self._visible(name, first), pipeline)
        df = df.offset(skip) if skip else df
        return self._stripped(df if limit is None else df.limit(limit))

    def _pipeline(self, df: DataFrame, pipeline: Sequence[Mapping[str, Any]]) -> DataFrame:
        stages = [next(iter(s.items())) for s in pipeline]
        for i, (name, spec) in enumerate(stages):
            if name == "$graphLookup" and i + 1 < len(stages) and stages[i + 1][0] == "$project":
                # A projection that only asks how many documents were reached doesn't need them.
                projected = graph.sizes(stages[i + 1][1], spec["as"])
                if projected is not None:
                    stages[i + 1] = ("$project", projected)
                    df = self._stage_graphLookup(df, spec, sized=True)
                    continue
            run = getattr(self, "_stage_" + name[1:], None)
            if run is None:
                raise StaticError("unknown_stage", name)
            df = run(df, spec)
        return df

    def _stage_match(self, df: DataFrame, spec: Mapping[str, Any]) -> DataFrame:
        return self._where(df, spec)

    def _stage_sort(self, df: DataFrame, spec: Mapping[str, int]) -> DataFrame:
        return df.orderBy(*_sorted(spec))

    def _stage_skip(self, df: DataFrame, spec: int) -> DataFrame:
        return df.offset(spec)

    def _stage_limit(self, df: DataFrame, spec: int) -> DataFrame:
        return df.limit(spec)

    def _stage_count(self, df: DataFrame, spec: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias(spec)).where(F.col(spec) > 0)

    def _stage_project(self, df: DataFrame, spec: Mapping[str, Any]) -> DataFrame:
        if all(v in (0, False) for v in spec.values()):
            return df.drop(*spec)
        return df.select(*[_expression(df, "$" + k if v in (1, True) else v).alias(k) for k, v in spec.items() if v not in (0, False)])

    def _stage_addFields(self, df: DataFrame, spec: Mapping[str, Any]) -> DataFrame:  # noqa: N802
        return df.withColumns({k: _expression(df, v) for k, v in spec.items()})

    _stage_set = _stage_addFields

    def _stage_unset(self, df: DataFrame, spec: str | list[str]) -> DataFrame:
        return df.drop(*([spec] if isinstance(spec, str) else spec))

    def _stage_unwind(self, df: DataFrame, spec: str | Mapping[str, Any]) -> DataFrame:
        path, outer = (spec, False) if isinstance(spec, str) else (spec["path"], spec.get("preserveNullAndEmptyArrays", False))
        name = path[1:]
        others = [F.col(f"`{c}`") for c in df.columns if c != name]
        return df.select(*others, (F.explode_outer if outer else F.explode)(F.col(f"`{name}`")).alias(name))

    def _stage_group(self, df: DataFrame, spec: Mapping[str, Any]) -> DataFrame:
        key = spec["_id"]
        made = {"$sum": F.sum, "$avg": F.avg, "$min": F.min, "$max": F.max, "$first": F.first, "$addToSet": F.collect_set, "$push": F.collect_list}
        out = []
        for name, how in spec.items():
            if name != "_id":
                op, x = next(iter(how.items()))
                if op == "$count" or (op == "$sum" and x == 1):
                    out.append(F.count(F.lit(1)).alias(name))
                elif op in made:
                    out.append(made[op](_expression(df, x)).alias(name))
                else:
                    raise StaticError("unknown_accumulator", op)
        if key is None:
            return df.agg(*out).select(F.lit(None).cast("string").alias("_id"), *[F.col(n) for n in spec if n != "_id"])
        column = F.struct(*[_expression(df, v).alias(k) for k, v in key.items()]) if isinstance(key, Mapping) else _expression(df, key)
        return df.groupBy(column.alias("_id")).agg(*out)

    def _stage_lookup(self, df: DataFrame, spec: Mapping[str, Any]) -> DataFrame:
        """Attach the array of matching documents; an array-valued local field matches by membership."""
        right = self._pipeline(self._visible(spec["from"]), spec.get("pipeline", []))
        local, foreign = Scope(df.schema).resolve(spec["localField"]), Scope(right.schema).resolve(spec["foreignField"])
        documents = right.select(F.struct(*[F.col(f"`{c}`") for c in right.columns]).alias("__doc"), foreign.value.alias("__rk"))
        names = [F.col(f"`{c}`") for c in df.columns if c != spec["as"]]
        if local.kind == "array":
            rows = df.withColumn("__row", F.monotonically_increasing_id())
            from larkspan.sources.durable import durable

            rows = durable(rows)
            value = Scope(rows.schema).resolve(spec["localField"]).value
            hits = rows.select("__row", F.explode(F.array_distinct(value)).alias("__lk")).join(documents, F.col("__lk").eqNullSafe(F.col("__rk"))).groupBy("__row").agg(F.array_sort(F.collect_list("__doc")).alias("__got"))
            joined = rows.join(hits, "__row", "left")
        else:
            lk, rk = join_keys(local, replace(foreign, value=F.col("__rk")))
            grouped = documents.select(rk.alias("__rk"), "__doc").groupBy("__rk").agg(F.array_sort(F.collect_list("__doc")).alias("__got"))
            joined = df.withColumn("__lk", lk).join(grouped, F.col("__lk").eqNullSafe(F.col("__rk")), "left")
        kind = T.ArrayType(documents.schema["__doc"].dataType)
        return joined.select(*names, F.coalesce(F.col("__got"), F.array().cast(kind)).alias(spec["as"]))

    def _stage_unionWith(self, df: DataFrame, spec: str | Mapping[str, Any]) -> DataFrame:  # noqa: N802
        name, inner = (spec, []) if isinstance(spec, str) else (spec["coll"], spec.get("pipeline", []))
        return df.unionByName(self._pipeline(self._visible(name), inner), allowMissingColumns=True)

    def _stage_facet(self, df: DataFrame, spec: Mapping[str, Sequence[Mapping[str, Any]]]) -> DataFrame:
        """One row with the result of each inner pipeline as an array of its documents.

        An array of more than ``MOST_FACET`` documents is refused: it would be one value of one row.
        """
        parts = []
        for name, inner in spec.items():
            found = self._pipeline(df, inner)
            if found.limit(MOST_FACET + 1).count() > MOST_FACET:
                raise EngineError("facet_too_large", name)
            parts.append(found.agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in found.columns])).alias(name)))
        return reduce(lambda a, b: a.crossJoin(b), parts)  # one row each

    def _stage_graphLookup(self, df: DataFrame, spec: Mapping[str, Any], sized: bool = False) -> DataFrame:  # noqa: N802
        """Documents reachable from ``startWith`` by following connectFromField to connectToField; only their number if ``sized``."""
        name = graph.size_field(spec["as"]) if sized else spec["as"]
        start = _expression(df, spec["startWith"])
        return graph.lookup(df, self._visible(spec["from"]), start, spec["connectFromField"], spec["connectToField"], name, spec.get("maxDepth"), sized)

    # writing: each returns the layer with a new table

    def _with(self, name: str, df: DataFrame) -> Documents:
        return replace(self, tables={**self.tables, name: df})

    def _hits(self, name: str, criteria: Mapping[str, Any], deleted: bool = False) -> Column:
        df = self.tables[name]
        test = Compiler(Scope(df.schema), {}, filter_profile=True).compile(from_mongo(normalise(criteria)).node)
        if "_deleted" in df.columns:
            gone = F.coalesce(F.col("_deleted"), F.lit(False))
            test = test & (gone if deleted else ~gone)
        return test & (F.col("_owner") == self.owner) if self.owner is not None and "_owner" in df.columns else test

    def update_all(self, name: str, criteria: Mapping[str, Any], changes: Mapping[str, Any], now: Any = None) -> Documents:
        """Set fields of all visible matches."""
        if any(k in ("_uuid", "_owner") for k in changes):
            raise StaticError("protected_field")
        df, hit = self.tables[name], self._hits(name, criteria)
        if now is not None:
            changes = {**changes, "_updated": now}
        return self._with(name, df.withColumns({k: F.when(hit, F.lit(v).cast(df.schema[k].dataType)).otherwise(F.col(k)) for k, v in changes.items()}))

    def delete_all(self, name: str, criteria: Mapping[str, Any], now: Any = None) -> Documents:
        """Flag all visible matches as deleted."""
        return self.update_all(name, criteria, {"_deleted": True}, now)

    def restore(self, name: str, criteria: Mapping[str, Any]) -> Documents:
        hit = self._hits(name, criteria, deleted=True)
        return self._with(name, self.tables[name].withColumn("_deleted", F.when(hit, F.lit(False)).otherwise(F.col("_deleted"))))

    def purge_deleted_older_than(self, name: str, cutoff: Any) -> Documents:
        df = self.tables[name]
        gone = F.coalesce(F.col("_deleted"), F.lit(False)) & F.coalesce(F.col("_updated") <= F.lit(cutoff).cast(df.schema["_updated"].dataType), F.lit(False))
        return self._with(name, df.where(~gone))

    def update_versioned(self, name: str, key: str, changes: Mapping[str, Any]) -> Documents:
        """Keep the document as version max + 1, then update it."""
        df = self.tables[name]
        now = self._visible(name).where(F.col("_uuid") == key.upper())
        kept = self.versions.get(name)
        if kept is None:
            snapshot = now.withColumn("_v", F.lit(1).cast("long"))
        else:
            last = kept.where(F.col("_uuid") == key.upper()).agg(F.coalesce(F.max("_v"), F.lit(0)).alias("__last"))
            snapshot = now.crossJoin(last).withColumn("_v", F.col("__last") + 1).drop("__last")  # one row each
            snapshot = kept.unionByName(snapshot)
        out = self._with(name, df).update_all(name, {"_uuid": key}, changes)
        return replace(out, versions={**self.versions, name: snapshot})

    def list_versions(self, name: str, key: str) -> DataFrame:
        return self.versions[name].where(F.col("_uuid") == key.upper()).orderBy(F.col("_v").desc())

    def revert_to_version(self, name: str, key: str, version: int) -> Documents:
        df = self.tables[name]
        old = self.versions[name].where((F.col("_uuid") == key.upper()) & (F.col("_v") == version))
        if not old.limit(1).count():
            raise EngineError("unknown_version", str(version))
        return self._with(name, df.where(F.col("_uuid") != key.upper()).unionByName(old.drop("_v")))


def latest_versions(versions: DataFrame, key: str = "_uuid") -> DataFrame:
    """The newest version of every document."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("_v").desc()))
    return versions.withColumn("__r", rank).where("__r = 1").drop("__r")


def apply_schema(lines: DataFrame, text: str, schema: str, required: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Documents that fit a schema, and the texts that don't."""
    parsed = lines.withColumn("__doc", F.from_json(text, schema + ", __bad string", {"columnNameOfCorruptRecord": "__bad", "mode": "PERMISSIVE"}))
    fits = F.col("__doc").isNotNull() & F.col("__doc.__bad").isNull()
    for r in required:
        fits = fits & F.col("__doc").getField(r).isNotNull()
    names = [c for c in T._parse_datatype_string(schema).names]
    return parsed.where(fits).select(*[F.col("__doc").getField(n).alias(n) for n in names]), parsed.where(~fits).select(text)


def _sorted(spec: Mapping[str, int]) -> list[Column]:
    return [F.col(k).desc_nulls_last() if d < 0 else F.col(k).asc_nulls_first() for k, d in spec.items()]


def _expression(df: DataFrame, x: Any) -> Column:
    if isinstance(x, str) and x.startswith("$"):
        slot = Scope(df.schema).resolve(x[1:])
        return slot.value
    if isinstance(x, Mapping):
        op, args = next(iter(x.items()))
        made = [_expression(df, a) for a in (args if isinstance(args, list) else [args])]
        two = {"$add": lambda a, b: a + b, "$subtract": lambda a, b: a - b, "$multiply": lambda a, b: a * b, "$divide": F.try_divide, "$eq": lambda a, b: a.eqNullSafe(b), "$gt": lambda a, b: a > b, "$lt": lambda a, b: a < b, "$ifNull": F.coalesce}
        if op in two:
            return reduce(two[op], made)
        one = {"$toUpper": F.upper, "$toLower": F.lower, "$size": F.size, "$abs": F.abs}
        if op in one:
            return one[op](made[0])
        if op == "$concat":
            return F.concat(*made)
        if op == "$literal":
            return F.lit(args)
        raise StaticError("unknown_expression", op)
    return F.lit(x)

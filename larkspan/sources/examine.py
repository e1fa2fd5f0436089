"""Examination of raw segment files: what can be recovered, and how sure that is.

A segment is a run of frames: magic ``LKS1``, a length, a SHA-256 of the JSON
payload, the payload.  Scanning is forward and tolerant; what isn't a whole,
verified frame becomes a unit with a hole.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.errors import EngineError
from larkspan.functions import algebra

MAGIC = b"LKS1"
UNIT = (
    "unit_kind string, status string, segment_id string, item_id string, event_id string, event_kind string, "
    "physical struct<source:string,offset:long,encoded_length:long>, integrity struct<framing:string,structural:string,content:string>, "
    "payload struct<availability:string,logical_length:long,value:string>, holes array<struct<reason:string,offset:long,length:long>>, uncertainty array<string>"
)
#: Tags of hole reasons.
HOLE_TAGS = {"truncated": "missing_tail", "bad_magic": "unframed_bytes", "bad_digest": "corrupt_content", "bad_payload": "undecodable", "limit": "not_examined"}


def frame(event: dict[str, Any]) -> bytes:
    body = json.dumps(event, sort_keys=True).encode()
    return MAGIC + len(body).to_bytes(8, "little") + hashlib.sha256(body).digest() + body


def units_of(source: str, data: bytes, most: int = 1_000_000) -> Iterator[dict[str, Any]]:
    """The units of one segment, in order of offset."""
    name = source.rsplit("/", 1)[-1]

    def unit(kind: str, status: str, at: int, length: int, event: dict[str, Any] | None = None, reason: str | None = None, size: int | None = None) -> dict[str, Any]:
        e = event or {}
        return {
            "unit_kind": kind, "status": status, "segment_id": name, "item_id": e.get("key"), "event_id": e.get("event_id"), "event_kind": e.get("kind"),
            "physical": {"source": source, "offset": at, "encoded_length": length},
            "integrity": {"framing": "bad" if reason in ("bad_magic", "truncated") else "ok", "structural": "bad" if reason == "bad_payload" else "unknown" if reason else "ok", "content": "bad" if reason == "bad_digest" else "unknown" if reason else "ok"},
            "payload": {"availability": "complete" if event is not None else "missing", "logical_length": size, "value": json.dumps(e.get("body")) if event is not None else None},
            "holes": [{"reason": reason, "offset": at, "length": length}] if reason else [], "uncertainty": [reason] if reason else [],
        }

    at = made = 0
    while at < len(data):
        if made == most:
            yield unit("hole", "incomplete", at, len(data) - at, reason="limit")
            return
        made += 1
        if data[at : at + 4] != MAGIC:
            end = data.find(MAGIC, at + 1)
            end = len(data) if end < 0 else end
            yield unit("hole", "damaged", at, end - at, reason="bad_magic")
            at = end
            continue
        size = int.from_bytes(data[at + 4 : at + 12], "little")
        body = data[at + 44 : at + 44 + size]
        if len(data) < at + 44 or len(body) < size:
            nxt = data.find(MAGIC, at + 4)
            end = len(data) if nxt < 0 else nxt
            yield unit("hole", "damaged", at, end - at, reason="truncated")
            at = end
            continue
        if hashlib.sha256(body).digest() != data[at + 12 : at + 44]:
            yield unit("event", "damaged", at, 44 + size, reason="bad_digest", size=size)
        else:
            try:
                yield unit("event", "verified_complete", at, 44 + size, json.loads(body), size=size)
            except ValueError:
                yield unit("event", "damaged", at, 44 + size, reason="bad_payload", size=size)
        at += 44 + size


def examine(spark: SparkSession, path: str, most: int = 1_000_000) -> DataFrame:
    """The units of all segment files under ``path``; one file a task, ordered only on demand."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for source, data in zip(part["path"], part["content"]):
                chunk: list[dict[str, Any]] = []
                for u in units_of(source, bytes(data), most):
                    chunk.append(u)
                    if len(chunk) == 10_000:
                        yield pd.DataFrame(chunk)
                        chunk = []
                if chunk:
                    yield pd.DataFrame(chunk)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.seg").load(path).select("path", "content")
    return files.mapInPandas(run, UNIT)


def ordered(units: DataFrame) -> DataFrame:
    """The total order of units."""
    return units.orderBy(F.col("segment_id").asc_nulls_last(), "physical.source", F.col("physical.offset").asc_nulls_last(), F.col("event_id").asc_nulls_last())


def filter_status(units: DataFrame, status: str) -> DataFrame:
    return units.where(F.col("status") == status)


def filter_holes(units: DataFrame) -> DataFrame:
    return units.where(F.size("holes") > 0)


def filter_verified(units: DataFrame) -> DataFrame:
    return filter_status(units, "verified_complete")


def map_units(units: DataFrame, program: str) -> DataFrame:
    """A program per unit, the unit's fields bound by name; JSON results."""
    return algebra.map_rows(units, program)


def filter_units(units: DataFrame, program: str) -> DataFrame:
    """Units for which the predicate is true; a result that is no boolean is an error."""
    judged = units.withColumn("__v", _value(units, program))
    return judged.where(F.when(F.col("__v").isin("true", "false"), F.col("__v") == "true").otherwise(F.raise_error(F.concat(F.lit("predicate is no boolean: "), F.col("__v"))))).drop("__v")


def _value(units: DataFrame, program: str):
    parsed = algebra.parse(program)

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        ev = algebra.Evaluator()
        return pd.Series([json.dumps(algebra.to_json(ev.run(parsed, {k: algebra.from_json(v) for k, v in json.loads(r).items()}))) for r in rows])

    return run(F.to_json(F.struct(*[F.col(c) for c in units.columns]), {"ignoreNullFields": "false"}))


def eval_page(units: DataFrame, program: str, size: int = 256) -> Any:
    """A program over the first ``size`` units in order, bound to ``units``."""
    rows = [json.loads(r.j) for r in ordered(units).limit(size).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).collect()]
    if len(rows) > 4096:
        raise EngineError("page_too_large", str(size))
    return algebra.evaluate(program, units=rows)


def hole_tags(units: DataFrame) -> DataFrame:
    """Each hole with its reason's tag."""
    table = F.create_map(*[F.lit(x) for kv in HOLE_TAGS.items() for x in kv])
    return units.select("segment_id", F.explode("holes").alias("hole")).select("segment_id", "hole.*", F.coalesce(F.try_element_at(table, F.col("hole.reason")), F.lit("unknown")).alias("tag"))

"""An append-only document store: put and delete events in Parquet.

The live state is the latest event of each subject; history, older versions
and the catalog come from the same log.  Events are appended, never changed,
so a job that is run again or loses executors reads what it read before.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.catalog import Collection, Database, Hole, check_key, check_name
from larkspan.errors import BudgetError, CoverageError, EngineError, StaticError
from larkspan.sources.durable import numbered

EVENTS = "collection string, key string, kind string, tag string, body string, bytes binary, segment long, seq long, offset long, file string, event_id string, operation_id string, complete boolean, written_at timestamp"
#: The order in which a subject's events are recovered.
RECOVERY = ("segment", "seq", "offset", "file", "event_id")
PARTITIONS = 64
INDEXES = "name string, fields array<string>, folder string, upto long, made double, there boolean"
#: Holes that an opened collection names one by one; of more, the number is told.
NAMED_HOLES = 100
#: Seconds after which a writer that isn't done counts as given up.
LEASE = 600


def recovery_order(descending: bool = False) -> list[Column]:
    return [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_first() for c in RECOVERY]


def partition_of(key: Column, partitions: int = PARTITIONS) -> Column:
    """The virtual partition of a key."""
    return F.pmod(F.xxhash64(key), F.lit(partitions)).cast("int")


def deduplicated(events: DataFrame) -> DataFrame:
    """Each event once, whatever was copied or replayed."""
    return events.dropDuplicates(["collection", "key", "event_id"])


def live(events: DataFrame) -> DataFrame:
    """The latest event per subject, where that is a put.

    One aggregation with map-side partials: no subject's history is sorted.
    """
    order = F.struct(*[F.col(c) for c in RECOVERY])
    columns = [c for c in events.columns if c not in ("collection", "key")]
    latest = events.groupBy("collection", "key").agg(F.max_by(F.struct(*columns), order).alias("e"))
    return latest.where(F.col("e.kind") == "put").select("collection", "key", "e.*")


def history(events: DataFrame, collection: str, key: str) -> DataFrame:
    """All versions of one document, oldest first, numbered."""
    own = deduplicated(events.where((F.col("collection") == collection) & (F.col("key") == key)))
    return own.withColumn("version", F.row_number().over(Window.orderBy(*recovery_order()))).orderBy("version")


def histories(events: DataFrame) -> DataFrame:
    """Versions of all documents, numbered within each."""
    return deduplicated(events).withColumn("version", F.row_number().over(Window.partitionBy("collection", "key").orderBy(*recovery_order())))


def last_complete(events: DataFrame, before: int | None = None, cross_tombstones: bool = False) -> DataFrame:
    """Per subject the newest complete put with ``seq`` below ``before``.

    A later delete hides what is before it unless ``cross_tombstones``.
    """
    rows = deduplicated(events) if before is None else deduplicated(events).where(F.col("seq") < before)
    order = F.struct(*[F.col(c) for c in RECOVERY])
    columns = [c for c in events.columns if c not in ("collection", "key")]
    put = (F.col("kind") == "put") & F.col("complete")
    found = rows.groupBy("collection", "key").agg(
        F.max_by(F.when(put, F.struct(*columns)), F.when(put, order)).alias("e"), F.max(F.when(put, order)).alias("at"), F.max(F.when(F.col("kind") == "delete", order)).alias("gone")
    )
    found = found.where(F.col("e").isNotNull())
    if not cross_tombstones:
        found = found.where(F.col("gone").isNull() | (F.col("gone") < F.col("at")))
    return found.select("collection", "key", "e.*")


def read_at(events: DataFrame, moment: Any) -> DataFrame:
    """The live state as of a time."""
    return live(events.where(F.col("written_at") <= F.lit(moment).cast("timestamp")))


def rebuilt_catalog(events: DataFrame) -> DataFrame:
    """Collections with their live and deleted subjects."""
    order = F.struct(*[F.col(c) for c in RECOVERY])
    latest = events.groupBy("collection", "key").agg(F.max_by("kind", order).alias("kind"))
    return latest.groupBy("collection").agg(F.count_if(F.col("kind") == "put").alias("live"), F.count_if(F.col("kind") == "delete").alias("deleted"))


def tiers(spark: SparkSession, paths: Mapping[str, str]) -> tuple[DataFrame, list[Hole]]:
    """The events of all tiers that can be read, and a hole for each that can't."""
    found, holes = spark.createDataFrame([], EVENTS), []
    for tier, path in paths.items():
        try:
            found = found.unionByName(spark.read.schema(EVENTS).option("recursiveFileLookup", True).parquet(path))
        except Exception as e:  # an offline tier is a gap, not a failure
            if "PATH_NOT_FOUND" not in str(e):
                raise
            holes.append(Hole(tier, "offline"))
    return found, holes


class Store:
    """Documents in one folder; writes are appends, reads are DataFrames."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def events(self) -> DataFrame:
        try:
            return self.spark.read.schema(EVENTS).option("recursiveFileLookup", True).parquet(f"{self.path}/events")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], EVENTS)

    # writing

    def _claim(self) -> int:
        """The next segment's number, which no other writer has: its claim is a file that is made only once."""
        fs, folder = self._folder("_claims")
        last = self.events().agg(F.max("segment")).first()[0]
        n = max([-1 if last is None else last, *self._numbers("_claims")]) + 1
        while True:
            target = f"{folder}/{n:012d}"
            try:
                if fs.getScheme() == "file":
                    os.close(os.open(target.removeprefix("file:"), os.O_CREAT | os.O_EXCL))
                else:
                    fs.create(self.spark._jvm.org.apache.hadoop.fs.Path(target), False).close()
                return n
            except FileExistsError:
                n += 1
            except Exception as e:
                if "AlreadyExists" not in str(e):
                    raise
                n += 1

    def _folder(self, name: str) -> tuple[Any, str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        return fs, fs.makeQualified(path).toString()

    def _numbers(self, name: str) -> dict[int, float]:
        """Segments claimed, or done, and since when."""
        fs, folder = self._folder(name)
        return {int(f.getPath().getName()): f.getModificationTime() / 1000 for f in fs.listStatus(self.spark._jvm.org.apache.hadoop.fs.Path(folder)) if f.getPath().getName().isdigit()}

    def _wait(self, segment: int) -> None:
        """Until every writer that claimed an earlier segment is done; claims beyond their lease count as given up."""
        until = time.time() + 2 * LEASE
        while time.time() < until:
            done = self._numbers("_done")
            if not [n for n, since in self._numbers("_claims").items() if n < segment and n not in done and since > time.time() - LEASE]:
                return
            time.sleep(0.05)
        raise EngineError("store_busy", str(segment))

    def append(self, rows: DataFrame, operation_id: str | None = None, unless: Callable[[], EngineError | None] | None = None) -> bool:
        """Append rows of (collection, key, kind, tag, body, bytes) as one segment; whether they were.

        A repeated operation id writes nothing: a retried batch is applied
        once.  ``unless`` may refuse the write by what the log holds then:
        every earlier writer is done by that time, and every later one waits,
        so check and write are one step.
        """
        segment = self._claim()
        try:
            if operation_id is not None or unless is not None:
                self._wait(segment)
            if operation_id is not None and self.events().where(F.col("operation_id") == operation_id).limit(1).count():
                return False
            if unless is not None and (error := unless()) is not None:
                raise error
            self._write(rows, segment, operation_id)
            return True
        finally:
            fs, folder = self._folder("_done")
            fs.create(self.spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{segment:012d}"), True).close()

    def _write(self, rows: DataFrame, segment: int, operation_id: str | None) -> None:
        made = rows.withColumns({
            "segment": F.lit(segment).cast("long"), "offset": F.monotonically_increasing_id(), "seq": F.lit(segment).cast("long"), "file": F.lit(f"{segment:012d}"),
            "event_id": F.concat(F.lit(f"{segment:012d}-"), F.sha2(F.concat_ws("\0", "collection", "key", "kind", F.coalesce("body", F.lit("")), F.coalesce(F.hex("bytes"), F.lit(""))), 256)),
            "operation_id": F.lit(operation_id).cast("string"), "complete": F.lit(True), "written_at": F.current_timestamp(),
        })
        names = [f.split(" ")[0] for f in EVENTS.split(", ")]
        # A folder of its own: jobs that write to one folder at once would clear each other's unfinished files.
        made.select(names).write.mode("append").parquet(f"{self.path}/events/{segment:012d}")

    def _rows(self, collection: str, documents: Iterable[tuple[str, Any]], kind: str = "put") -> DataFrame:
        check_name(collection)
        out = []
        for key, value in documents:
            check_key(key)
            raw = isinstance(value, bytes | bytearray)
            out.append((collection, key, kind, "bytes" if raw else "json", None if raw or kind == "delete" else json.dumps(value, ensure_ascii=False), bytes(value) if raw else None))
        return self.spark.createDataFrame(out, "collection string, key string, kind string, tag string, body string, bytes binary")

    def put_many(self, collection: str, documents: Mapping[str, Any], operation_id: str | None = None) -> None:
        self.append(self._rows(collection, documents.items()), operation_id)

    def put(self, collection: str, key: str, value: Any) -> None:
        self.put_many(collection, {key: value})

    upsert = put

    def _version(self, collection: str, key: str) -> str | None:
        """The latest event of a live document."""
        now = live(self.events().where((F.col("collection") == collection) & (F.col("key") == key))).select("event_id").collect()
        return now[0].event_id if now else None

    def create(self, collection: str, key: str, value: Any) -> None:
        """Insert; the key may not be live."""
        self.append(self._rows(collection, [(key, value)]), unless=lambda: EngineError("exists", key) if self._version(collection, key) else None)

    def add(self, collection: str, value: Any) -> str:
        """Insert under a new key."""
        key = uuid.uuid4().hex
        self.put(collection, key, value)
        return key

    def _unfit(self, collection: str, key: str, version: str | None) -> EngineError | None:
        now = self._version(collection, key)
        if now is None:
            return EngineError("missing", key)
        return EngineError("version_conflict", key) if version is not None and now != version else None

    def replace(self, collection: str, key: str, value: Any, version: str | None = None) -> None:
        """Overwrite a live document; with ``version``, only if its latest event is that one."""
        self.append(self._rows(collection, [(key, value)]), unless=lambda: self._unfit(collection, key, version))

    def delete(self, collection: str, key: str, version: str | None = None) -> bool:
        """Append a tombstone; whether there was something to delete."""
        try:
            return self.append(self._rows(collection, [(key, None)], "delete"), unless=lambda: self._unfit(collection, key, version))
        except EngineError as e:
            if e.code == "missing":
                return False
            raise

    def merge(self, collection: str, rows: DataFrame, mode: str = "upsert", operation_id: str | None = None) -> None:
        """Write a DataFrame of (key, body): upsert all, create the new, or replace the live."""
        if mode not in ("upsert", "create", "replace"):
            raise StaticError("bad_mode", mode)
        if mode != "upsert":
            now = live(self.events().where(F.col("collection") == collection)).select("key")
            rows = rows.join(now, "key", "left_anti" if mode == "create" else "left_semi")
        made = rows.select(F.lit(check_name(collection)).alias("collection"), "key", F.lit("put").alias("kind"), F.lit("json").alias("tag"), "body", F.lit(None).cast("binary").alias("bytes"))
        self.append(made, operation_id)

    # reading

    def get(self, collection: str, key: str) -> Any:
        """One document, or None."""
        rows = live(self.events().where((F.col("collection") == collection) & (F.col("key") == key))).select("tag", "body", "bytes").collect()
        if not rows:
            return None
        return bytes(rows[0].bytes) if rows[0].tag == "bytes" else json.loads(rows[0].body)

    def get_version(self, collection: str, key: str, event_id: str) -> Any:
        rows = history(self.events(), collection, key).where(F.col("event_id") == event_id).select("kind", "tag", "body", "bytes").collect()
        if not rows or rows[0].kind == "delete":
            return None
        return bytes(rows[0].bytes) if rows[0].tag == "bytes" else json.loads(rows[0].body)

    def list_collections(self) -> list[str]:
        return [r.collection for r in rebuilt_catalog(self.events()).where("live > 0").select("collection").orderBy("collection").collect()]

    def partial(self, collection: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Healthy documents, keys whose latest event is incomplete, keys whose text doesn't parse."""
        rows = live(self.events().where(F.col("collection") == collection))
        parsed = rows.withColumn("doc", F.try_parse_json("body"))
        healthy = parsed.where(F.col("complete") & (F.col("doc").isNotNull() | (F.col("tag") == "bytes")))
        return (
            healthy.select(F.col("key").alias("_key"), "doc", "bytes"),
            rows.where(~F.col("complete")).select(F.col("key").alias("_key")),
            parsed.where(F.col("complete") & (F.col("tag") == "json") & F.col("doc").isNull()).select(F.col("key").alias("_key")),
        )

    def open(self, db: Database, collection: str, complete: bool = True) -> Collection:
        """The live documents as a schemaless collection of a database.

        Its holes name the first documents that can't be read, and say how
        many more there are; ``partial`` has all of them.
        """
        healthy, broken, undecodable = self.partial(collection)
        holes = []
        for rows, why in ((broken, "incomplete"), (undecodable, "undecodable")):
            named = [Hole(r["_key"], why) for r in rows.orderBy("_key").limit(NAMED_HOLES + 1).collect()]
            more = rows.count() - NAMED_HOLES if len(named) > NAMED_HOLES else 0
            holes += [*named[:NAMED_HOLES], *([Hole(f"{more} more", why)] if more else [])]
        if holes and complete:
            raise CoverageError("incomplete", holes[0].source)
        return db.add(collection, healthy.where(F.col("doc").isNotNull()).select("_key", "doc"), "_key", holes)

    # upkeep

    def compact(self, path: str) -> Store:
        """The live state as a new store; the old one stays as it is."""
        live(self.events()).select([f.split(" ")[0] for f in EVENTS.split(", ")]).write.mode("overwrite").parquet(f"{path}/events")
        return Store(self.spark, path)

    checkpoint = compact

    def clustered(self, collection: str, fields: Sequence[str], path: str) -> DataFrame:
        """A projection sorted by document fields, so that equality filters skip row groups: the role of an index."""
        rows = live(self.events().where(F.col("collection") == collection))
        made = rows.select("key", "body", *[F.get_json_object("body", "$." + f).alias(f) for f in fields])
        made.repartitionByRange(*[F.col(f"`{f}`") for f in fields]).sortWithinPartitions(*[F.col(f"`{f}`") for f in fields]).write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def scan_partitions(self, collection: str, only: Sequence[int] | None = None, present: Sequence[int] | None = None, complete: bool = True, limit: int | None = None) -> tuple[DataFrame, list[Hole]]:
        """Live rows of virtual partitions; partitions that aren't present are holes."""
        asked = set(range(PARTITIONS) if only is None else only)
        there = asked if present is None else asked & set(present)
        holes = [Hole(f"partition-{p}", "missing") for p in sorted(asked - there)]
        if holes and complete:
            raise CoverageError("incomplete", f"{len(holes)} partitions")
        rows = live(self.events().where(F.col("collection") == collection)).withColumn("partition", partition_of(F.col("key"))).where(F.col("partition").isin(sorted(there)))
        rows = rows.orderBy("key")
        return (rows if limit is None else rows.limit(limit)), holes

    def _scanned(self, collection: str, prefix: str, only: Sequence[int] | None, present: Sequence[int] | None, complete: bool) -> tuple[DataFrame, tuple[Hole, ...]]:
        """Events of keys with a prefix in the virtual partitions asked for, and the holes among these."""
        events = self.events().where((F.col("collection") == collection) & F.startswith(F.col("key"), F.lit(prefix)))
        asked = set(range(PARTITIONS) if only is None else only)
        there = asked if present is None else asked & set(present)
        holes = tuple(Hole(f"partition-{p}", "missing") for p in sorted(asked - there))
        if holes and complete:
            raise CoverageError("incomplete", f"{len(holes)} partitions")
        if len(there) < PARTITIONS:
            events = events.where(partition_of(F.col("key")).isin(sorted(there)))
        return events, holes

    def scan_page(self, collection: str, prefix: str = "", documents: int = 256, result_bytes: int | None = None, after: str | None = None, only: Sequence[int] | None = None, present: Sequence[int] | None = None, complete: bool = True) -> ScanPage:
        """One page of a scan over virtual partitions, in order of keys.

        Keys begin with ``prefix`` and come after ``after``, the continuation
        of the page before; a page ends at its budget of documents, or of bytes
        of bodies (one document at least).
        """
        if documents < 1:
            raise StaticError("bad_budget", str(documents))
        events, holes = self._scanned(collection, prefix, only, present, complete)
        if after is not None:
            events = events.where(F.col("key") > F.lit(after))
        rows = live(events)
        ends = rows.select("key", F.coalesce(F.octet_length("body"), F.octet_length("bytes"), F.lit(0)).alias("n")).orderBy("key").limit(documents + 1).collect()  # at most a page
        n, held = 0, 0
        for r in ends[:documents]:
            if n and result_bytes is not None and held + r.n > result_bytes:
                break
            n, held = n + 1, held + r.n
        if not n:
            return ScanPage(rows.limit(0), holes, None)
        page = rows.where(F.col("key") <= F.lit(ends[n - 1].key)).orderBy("key")
        return ScanPage(page, holes, ends[n - 1].key if n < len(ends) else None)

    def scan_pages(self, collection: str, prefix: str = "", documents: int = 256, only: Sequence[int] | None = None, present: Sequence[int] | None = None, complete: bool = True) -> ScanPages:
        """All pages that following ``scan_page`` from continuation to continuation gives, by one sort.

        Page by page every page brings the log to its live state again, and
        every task sends a page of keys to the driver.
        """
        if documents < 1:
            raise StaticError("bad_budget", str(documents))
        events, holes = self._scanned(collection, prefix, only, present, complete)
        rows = numbered(live(events).orderBy("key"), "__at")
        last = rows.where(F.col("__at") % documents == documents - 1).select("__at", "key").orderBy("__at").collect()  # one key a page
        total = rows.agg(F.max("__at")).first()[0]
        rows = rows.withColumn("page", F.floor(F.col("__at") / documents).cast("long")).drop("__at")
        return ScanPages(rows, holes, tuple(r.key for r in last if r["__at"] < total))

    # indexes: projections sorted by document fields, each made from the events up to a segment

    def create_index(self, collection: str, name: str, fields: Sequence[str]) -> None:
        """Make an index of these fields; its name may not be taken."""
        if name in self.list_indexes(collection):
            raise EngineError("index_exists", name)
        self._build(collection, name, list(fields))

    def _build(self, collection: str, name: str, fields: list[str]) -> None:
        folder = f"{self._indexes(collection)}/data/{uuid.uuid4().hex}"
        upto = self.events().where(F.col("collection") == collection).agg(F.max("segment")).first()[0]
        done = self._numbers("_done")
        upto = min([-1 if upto is None else upto, *(n - 1 for n in self._numbers("_claims") if n not in done)])  # what is still being written may come in later
        check_name(name)
        self.clustered(collection, fields, folder)
        # The last row written tells which build holds: a build that breaks off leaves none.
        self.spark.createDataFrame([(name, fields, folder, upto, time.time(), True)], INDEXES).coalesce(1).write.parquet(f"{self._indexes(collection)}/catalog/{uuid.uuid4().hex}")

    def _indexes(self, collection: str) -> str:
        return f"{self.path}/indexes/{hashlib.sha256(collection.encode()).hexdigest()[:24]}"

    def list_indexes(self, collection: str) -> dict[str, dict[str, Any]]:
        """The indexes of a collection: their fields, folder, and the last segment they know."""
        try:
            rows = self.spark.read.schema(INDEXES).option("recursiveFileLookup", True).parquet(f"{self._indexes(collection)}/catalog")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return {}
        last = rows.groupBy("name").agg(F.max_by(F.struct("*"), "made").alias("i")).select("i.*").where("there")
        return {r.name: {"fields": list(r.fields), "folder": r.folder, "upto": r.upto} for r in last.collect()}

    def get_index(self, collection: str, name: str) -> dict[str, Any]:
        found = self.list_indexes(collection)
        if name not in found:
            raise EngineError("unknown_index", name)
        return found[name]

    def drop_index(self, collection: str, name: str) -> None:
        i = self.get_index(collection, name)
        self.spark.createDataFrame([(name, i["fields"], i["folder"], i["upto"], time.time(), False)], INDEXES).coalesce(1).write.parquet(f"{self._indexes(collection)}/catalog/{uuid.uuid4().hex}")

    def rebuild_index(self, collection: str, name: str) -> None:
        self._build(collection, name, self.get_index(collection, name)["fields"])

    def probe(self, collection: str, equal: Mapping[str, Any]) -> DataFrame:
        """Live documents (key, body) with fields of these values, through an index that has all of them, or else by a scan.

        Documents changed since the index was made are read from the log, so
        that an old index gives no other result.
        """
        text = lambda v: json.dumps(v) if not isinstance(v, str) else v
        test = lambda of: reduce(lambda a, b: a & b, [of(f) == F.lit(text(v)) for f, v in equal.items()])
        body = lambda f: F.get_json_object("body", "$." + f)
        events = self.events().where(F.col("collection") == collection)
        found = next((i for i in self.list_indexes(collection).values() if set(equal) <= set(i["fields"])), None)
        if found is None:
            return live(events).where(test(body)).select("key", "body")
        newer = events.where(F.col("segment") > found["upto"])
        old = self.spark.read.parquet(found["folder"]).where(test(lambda f: F.col(f"`{f}`"))).select("key", "body").join(newer.select("key").distinct(), "key", "left_anti")
        return old.unionByName(live(newer).where(test(body)).select("key", "body"))


@dataclass(frozen=True)
class ScanPage:
    """Rows of a scan over partitions, the holes in it, and the key to go on after."""

    rows: DataFrame
    holes: tuple[Hole, ...]
    continuation: str | None


@dataclass(frozen=True)
class ScanPages:
    """Rows of all pages of a scan in order, each with its ``page``, the holes, and the key after which each page but the first goes on."""

    rows: DataFrame
    holes: tuple[Hole, ...]
    continuations: tuple[str, ...]


def budgeted_history(events: DataFrame, collection: str, key: str, most: int) -> DataFrame:
    """A history that may not exceed ``most`` versions."""
    found = history(events, collection, key)
    if found.limit(most + 1).count() > most:
        raise BudgetError("budget_exceeded", "versions")
    return found

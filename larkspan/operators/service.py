"""Calls from outside: bounded asynchronous runs, deadlines, read views, and a JSON dispatcher."""

from __future__ import annotations

import hashlib
import json
import threading
import time
import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any, TypeVar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.catalog import Collection, Database
from larkspan.errors import BudgetError, EngineError, StaticError
from larkspan.operators.core import Engine
from larkspan.plans import dialects as D
from larkspan.sources import store as S
from larkspan.sources.durable import durable

T = TypeVar("T")


def with_deadline(db: Database, seconds: float, work: Callable[[], T]) -> T:
    """Run ``work``; its Spark jobs are cancelled when the time is over."""
    context, tag = db.spark.sparkContext, f"larkspan-{uuid.uuid4().hex}"
    over = threading.Event()

    def stop() -> None:
        over.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    context.addJobTag(tag)
    timer.start()
    try:
        return work()
    except Exception as e:
        if over.is_set():
            raise EngineError("deadline_exceeded", f"{seconds} s") from e
        raise
    finally:
        timer.cancel()
        context.removeJobTag(tag)


class AsyncEngine:
    """Runs on a few threads behind a bounded queue; a full queue refuses."""

    def __init__(self, threads: int = 4, queue: int = 64) -> None:
        self._pool, self._room = ThreadPoolExecutor(threads), threading.BoundedSemaphore(queue)

    def submit(self, work: Callable[..., T], *args: Any) -> Future[T]:
        if not self._room.acquire(blocking=False):
            raise BudgetError("queue_full")
        future = self._pool.submit(work, *args)
        future.add_done_callback(lambda _: self._room.release())
        return future

    def close(self) -> None:
        self._pool.shutdown(wait=True)


@dataclass(frozen=True)
class ReadView:
    """A collection as it was: a durable copy, what it came from, and until when it holds."""

    collection: Collection
    fingerprint: str
    opened: float
    seconds: float

    def use(self, now: float | None = None) -> Collection:
        if (now or time.time()) - self.opened > self.seconds:
            raise EngineError("read_view_expired")
        return self.collection


def fingerprint(df: DataFrame) -> str:
    """What a DataFrame reads: its files, or its plan."""
    files = sorted(df.inputFiles()) or [df._jdf.queryExecution().optimizedPlan().toString()]
    return hashlib.sha256("\n".join(files).encode()).hexdigest()


def read_view(side: Collection, seconds: float = 900, documents: int | None = None) -> ReadView:
    """Keep a collection as it is now; ``documents`` bounds what is kept."""
    if documents is not None and side.df.limit(documents + 1).count() > documents:
        raise BudgetError("budget_exceeded", "documents")
    kept = Collection(side.name, durable(side.df), side.key, side.holes)
    return ReadView(kept, fingerprint(side.df), time.time(), seconds)


@dataclass(frozen=True)
class Service:
    """JSON requests over a store: ``{"op": ..., ...}`` in, a JSON value out."""

    store: S.Store
    most: int = 1000

    def call(self, request: Mapping[str, Any]) -> dict[str, Any]:
        try:
            return {"ok": self._run(**request)}
        except EngineError as e:
            return {"error": {"code": e.code, "message": str(e)}}
        except TypeError as e:
            return {"error": {"code": "bad_request", "message": str(e)}}

    def _run(self, op: str, **r: Any) -> Any:
        found = getattr(self, "_op_" + op, None)
        if found is None:
            raise StaticError("unknown_op", op)
        return found(**r)

    def _db(self, *collections: str) -> Database:
        db = Database(self.store.spark)
        for c in collections:
            self.store.open(db, c)
        return db

    def _rows(self, df: DataFrame) -> list[Any]:
        rows = df.limit(self.most + 1).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).collect()
        if len(rows) > self.most:
            raise BudgetError("result_too_large", str(self.most))
        return [json.loads(r.j) for r in rows]

    def _op_get(self, collection: str, key: str) -> Any:
        found = self.store.get(collection, key)
        return {"hex": found.hex()} if isinstance(found, bytes) else found

    _op_get_bytes = _op_get

    def _op_put(self, collection: str, key: str, value: Any) -> None:
        self.store.put(collection, key, value)

    def _op_create(self, collection: str, key: str, value: Any) -> None:
        self.store.create(collection, key, value)

    def _op_replace(self, collection: str, key: str, value: Any, version: str | None = None) -> None:
        self.store.replace(collection, key, value, version)

    def _op_delete(self, collection: str, key: str) -> bool:
        return self.store.delete(collection, key)

    def _op_list_collections(self) -> list[str]:
        return self.store.list_collections()

    def _op_list_keys(self, collection: str, limit: int = 256, after: str | None = None) -> list[str]:
        return [r["_key"] for r in self._db(collection)[collection].list_keys(min(limit, self.most), after).collect()]

    def _op_scan_json(self, collection: str, limit: int = 256, after: str | None = None) -> list[Any]:
        return self._rows(self._db(collection)[collection].scan(min(limit, self.most), after))

    def _op_find(self, collection: str, filter: Any, dialect: str = "json", limit: int = 256) -> list[Any]:
        side = self._db(collection)[collection]
        return self._rows(D.find(side, D.Dialects().compile(dialect, filter), limit=min(limit, self.most)))

    def _op_history(self, collection: str, key: str) -> list[Any]:
        return self._rows(S.history(self.store.events(), collection, key).select("version", "kind", "body", "event_id"))

    def _op_query(self, text: str, params: Mapping[str, Any] | None = None, after: str | None = None, size: int | None = None) -> Any:
        page = Engine(self._db(*self.store.list_collections())).page(text, params, after, size)
        return {"rows": self._rows(page.rows), "continuation": page.continuation, "complete": page.complete}

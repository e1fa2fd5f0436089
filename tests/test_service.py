"""Deadlines, asynchronous runs, read views, and the dispatcher."""

import time

import pytest
from pyspark.sql import functions as F

from larkspan.catalog import Database
from larkspan.errors import BudgetError, EngineError
from larkspan.operators import service as V
from larkspan.sources.store import Store


def test_deadline(spark):
    db = Database(spark)
    assert V.with_deadline(db, 60, lambda: spark.range(5).count()) == 5
    slow = spark.range(0, 3 * 10**9, 1, 64).select(F.sum(F.sin("id")))
    began = time.time()
    with pytest.raises(EngineError, match="deadline"):
        V.with_deadline(db, 2, lambda: slow.collect())
    assert time.time() - began < 30


def test_async(spark):
    pool = V.AsyncEngine(1, 2)
    gate = [pool.submit(time.sleep, 1), pool.submit(lambda: spark.range(3).count())]
    with pytest.raises(BudgetError):
        pool.submit(print)
    assert gate[1].result() == 3
    pool.close()


def test_read_view(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    db = Database(spark)
    view = V.read_view(db.add("t", spark.read.parquet(path), "id"))
    spark.range(9).write.mode("overwrite").parquet(path)
    assert view.use().rows.count() == 3 and view.fingerprint != V.fingerprint(spark.read.parquet(path))
    with pytest.raises(EngineError):
        view.use(now=time.time() + 1000)
    with pytest.raises(BudgetError):
        V.read_view(db.add("u", spark.read.parquet(path), "id"), documents=2)


def test_dispatch(spark, tmp_path):
    s = V.Service(Store(spark, str(tmp_path)))
    call = lambda **r: s.call(r)
    for k, n in (("a", 1), ("b", 2), ("c", 2)):
        assert call(op="put", collection="t", key=k, value={"n": n}) == {"ok": None}
    assert call(op="get", collection="t", key="b") == {"ok": {"n": 2}}
    assert call(op="list_keys", collection="t", after="a") == {"ok": ["b", "c"]}
    assert [r["_key"] for r in call(op="find", collection="t", filter={"n": 2})["ok"]] == ["b", "c"]
    page = call(op="query", text="from t where n > 0 project _key, n order by n desc", size=2)["ok"]
    assert page["rows"] == [{"_key": "b", "n": 2}, {"_key": "c", "n": 2}]
    assert call(op="query", text="from t where n > 0 project _key, n order by n desc", size=2, after=page["continuation"])["ok"]["rows"] == [{"_key": "a", "n": 1}]
    assert call(op="delete", collection="t", key="a") == {"ok": True} and len(call(op="history", collection="t", key="a")["ok"]) == 2
    assert call(op="create", collection="t", key="b", value=1)["error"]["code"] == "exists"
    assert call(op="nope")["error"]["code"] == "unknown_op" and call(op="get")["error"]["code"] == "bad_request"
    assert call(op="list_collections") == {"ok": ["t"]} and len(call(op="scan_json", collection="t")["ok"]) == 2

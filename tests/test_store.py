"""The event store, examination, and streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from larkspan.catalog import Database
from larkspan.errors import BudgetError, CoverageError, EngineError
from larkspan.operators.core import Engine
from larkspan.sources import examine as X
from larkspan.sources import store as S
from larkspan.streaming import watch as W


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    s = S.Store(spark, str(tmp_path_factory.mktemp("store")))
    s.put_many("people", {"a": {"n": 1}, "b": {"n": 2}}, "op-1")
    s.put_many("people", {"a": {"n": 99}}, "op-1")  # a retry
    s.replace("people", "a", {"n": 3})
    s.delete("people", "b")
    s.create("people", "c", {"n": None})
    s.put("files", "f", b"\x00\x01")
    return s


def test_live_and_get(store):
    assert store.get("people", "a") == {"n": 3} and store.get("people", "b") is None and store.get("files", "f") == b"\x00\x01"
    assert store.list_collections() == ["files", "people"]
    for call in (lambda: store.create("people", "a", 1), lambda: store.replace("people", "b", 1), lambda: store.replace("people", "a", 1, "other"), lambda: store.delete("people", "a", "other")):
        with pytest.raises(EngineError):
            call()
    assert store.delete("people", "nobody") is False


def test_history(store):
    rows = S.history(store.events(), "people", "a").collect()
    assert [r.body for r in rows] == ['{"n": 1}', '{"n": 3}'] and [r.version for r in rows] == [1, 2]
    assert store.get_version("people", "a", rows[0].event_id) == {"n": 1}
    with pytest.raises(BudgetError):
        S.budgeted_history(store.events(), "people", "a", 1)
    last = {r.key: r.body for r in S.last_complete(store.events().where("collection = 'people'")).collect()}
    assert last == {"a": '{"n": 3}', "c": '{"n": null}'}
    crossed = {r.key: r.body for r in S.last_complete(store.events().where("collection = 'people'"), cross_tombstones=True).collect()}
    assert crossed["b"] == '{"n": 2}'
    assert {r.key: r.body for r in S.last_complete(store.events(), before=1).where("collection = 'people'").collect()} == {"a": '{"n": 1}', "b": '{"n": 2}'}
    assert S.read_at(store.events(), dt.datetime(2000, 1, 1)).count() == 0
    assert {r.collection: (r.live, r.deleted) for r in S.rebuilt_catalog(store.events()).collect()} == {"people": (2, 1), "files": (1, 0)}
    assert S.histories(store.events()).count() == store.events().count()


def test_query_over_the_store(store, spark):
    db = Database(spark)
    store.open(db, "people")
    assert [r["_key"] for r in Engine(db).run("from people where n is not null").collect()] == ["a"]


def test_merge_compact_partitions(store, spark, tmp_path):
    s = store.compact(str(tmp_path / "copy"))
    s.merge("people", spark.createDataFrame([("a", '{"n": 7}'), ("z", '{"n": 8}')], "key string, body string"), "create")
    assert s.get("people", "a") == {"n": 3} and s.get("people", "z") == {"n": 8}
    s.merge("people", spark.createDataFrame([("a", '{"n": 7}'), ("y", "{}")], "key string, body string"), "replace")
    assert s.get("people", "a") == {"n": 7} and s.get("people", "y") is None
    rows, holes = s.scan_partitions("people", present=range(64))
    assert [r.key for r in rows.collect()] == ["a", "c", "z"] and not holes
    with pytest.raises(CoverageError):
        s.scan_partitions("people", present=range(3))
    rows, holes = s.scan_partitions("people", present=range(3), complete=False)
    assert len(holes) == 61
    found, gaps = S.tiers(spark, {"hot": f"{s.path}/events", "cold": str(tmp_path / "gone")})
    assert found.count() == s.events().count() and [g.source for g in gaps] == ["cold"]
    assert s.clustered("people", ["n"], str(tmp_path / "ix")).where("n = '7'").first().key == "a"
    broken = spark.createDataFrame([("people", "q", "put", "json", "{oops", None)], "collection string, key string, kind string, tag string, body string, bytes binary")
    s.append(broken)
    healthy, _, bad = s.partial("people")
    assert [r["_key"] for r in bad.collect()] == ["q"] and healthy.count() == 3
    with pytest.raises(CoverageError):
        s.open(Database(spark), "people")


def test_examine(spark, tmp_path):
    good = X.frame({"key": "k1", "event_id": "e1", "kind": "put", "body": {"n": 1}})
    other = X.frame({"key": "k2", "event_id": "e2", "kind": "put", "body": {"n": 2}})
    rotten = bytearray(other)
    rotten[-2] ^= 1
    (tmp_path / "one.seg").write_bytes(good + b"junk" + bytes(rotten) + other[:20])
    (tmp_path / "two.seg").write_bytes(other)
    units = X.examine(spark, str(tmp_path))
    assert [(r.segment_id, r.status) for r in X.ordered(units).collect()] == [("one.seg", "verified_complete"), ("one.seg", "damaged"), ("one.seg", "damaged"), ("one.seg", "damaged"), ("two.seg", "verified_complete")]
    assert sorted(r.tag for r in X.hole_tags(units).collect()) == ["corrupt_content", "missing_tail", "unframed_bytes"]
    assert X.filter_holes(units).count() == 3 and X.filter_verified(units).count() == 2
    assert [r.item_id for r in X.filter_units(units, 'item_id = "k2"').collect()] == ["k2"]
    assert sorted(r.value for r in X.map_units(X.filter_verified(units), "item_id").collect()) == ['"k1"', '"k2"']
    assert X.eval_page(units, "{ yield u<item_id>? | u in units | u<status>? = Some(\"verified_complete\") }") == [{"$type": "some", "$value": k} for k in ("k1", "k2")]
    with pytest.raises(Exception, match="no boolean"):
        X.filter_units(units, "1").collect()
    assert [u["status"] for u in X.units_of("x", good * 3, most=1)] == ["verified_complete", "incomplete"]


def test_streams(store, spark, tmp_path):
    seen = []
    for _ in range(2):  # a second run resumes and finds nothing new
        W.watch(spark, store.path, lambda df, n: seen.extend(r.event_id for r in df.select("event_id").collect()), str(tmp_path / "w"), "people").awaitTermination()
    assert len(seen) == len(set(seen)) == store.events().where("collection = 'people'").count()
    W.maintain_live(spark, store.path, str(tmp_path / "live"), str(tmp_path / "c")).awaitTermination()
    want = {(r.collection, r.key, r.body) for r in S.live(store.events()).collect()}
    assert {(r.collection, r.key, r.body) for r in W.generation(spark, str(tmp_path / "live"), 0).collect()} == want
    assert W.event_counts(store.events(), "1 day").agg(F.sum("n")).first()[0] == store.events().count()


def test_conditional_writes_are_atomic(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    s = S.Store(spark, str(tmp_path / "s"))
    s.put("t", "a", {"n": 0})
    version = S.history(s.events(), "t", "a").first().event_id

    def attempt(call):
        try:
            call()
            return True
        except EngineError as e:
            return e.code

    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(attempt, [lambda i=i: s.replace("t", "a", {"n": i}, version) for i in range(4)]))
        made = list(pool.map(attempt, [lambda i=i: s.create("t", "b", i) for i in range(4)]))
        list(pool.map(attempt, [lambda i=i: s.put("t", f"k{i}", i) for i in range(4)]))
    assert sorted(map(str, got)) == ["True"] + ["version_conflict"] * 3 and sorted(map(str, made)) == ["True"] + ["exists"] * 3
    segments = [r.segment for r in s.events().select("segment").collect()]
    assert len(set(segments)) == len(segments) == 7 and s.get("t", "b") == made.index(True)


def test_all_scan_pages_by_one_sort(spark, tmp_path):
    """Rows, pages and continuations as page by page."""
    s = S.Store(spark, str(tmp_path / "s"))
    s.put_many("t", {f"{p}{i:02d}": {"n": i} for p in "ab" for i in range(20)})
    s.delete("t", "a03")
    for documents, prefix, there in ((7, "a", None), (19, "a", None), (100, "", range(40)), (3, "zz", None)):
        want, ends, after = [], [], None
        while True:
            page = s.scan_page("t", prefix=prefix, after=after, documents=documents, present=there, complete=False)
            want += [(r.key, len(ends)) for r in page.rows.collect()]
            after = page.continuation
            if after is None:
                break
            ends.append(after)
        found = s.scan_pages("t", prefix=prefix, documents=documents, present=there, complete=False)
        assert [(r.key, r.page) for r in found.rows.collect()] == want and found.continuations == tuple(ends) and found.holes == page.holes
    with pytest.raises(CoverageError):
        s.scan_pages("t", present=[1])


def test_scan_pages(spark, tmp_path):
    s = S.Store(spark, str(tmp_path / "s"))
    s.put_many("t", {f"{p}{i:02d}": {"n": i} for p in "ab" for i in range(20)})
    s.delete("t", "a03")
    want = [f"a{i:02d}" for i in range(20) if i != 3]
    for budget in ({"documents": 7}, {"documents": 100}, {"documents": 100, "result_bytes": 30}, {"documents": 1000, "result_bytes": 1}):
        keys, after = [], None
        while True:
            page = s.scan_page("t", prefix="a", after=after, **budget)
            keys += [r.key for r in page.rows.collect()]
            after = page.continuation
            if after is None:
                break
        assert keys == want, budget
    page = s.scan_page("t", present=range(40), complete=False)
    assert len(page.holes) == 24 and all(r.partition < 40 for r in page.rows.select(S.partition_of(F.col("key")).alias("partition")).collect())
    with pytest.raises(CoverageError):
        s.scan_page("t", present=[1])
    assert s.scan_page("t", prefix="zz").rows.count() == 0


def test_indexes(spark, tmp_path):
    s = S.Store(spark, str(tmp_path / "s"))
    s.put_many("t", {f"k{i}": {"n": i % 3, "s": "xy"[i % 2]} for i in range(12)})
    found = lambda **q: sorted(r.key for r in s.probe("t", q).collect())
    want = found(n=1, s="x")
    s.create_index("t", "ns", ["n", "s"])
    assert s.list_indexes("t")["ns"]["fields"] == ["n", "s"] and found(n=1, s="x") == want == ["k10", "k4"]
    with pytest.raises(EngineError, match="index_exists"):
        s.create_index("t", "ns", ["n"])
    s.put("t", "k4", {"n": 2, "s": "x"})
    s.put("t", "new", {"n": 1, "s": "x"})
    s.delete("t", "k10")
    assert found(n=1, s="x") == ["new"] and "k4" in found(n=2)
    before = s.get_index("t", "ns")["upto"]
    s.rebuild_index("t", "ns")
    assert found(n=1, s="x") == ["new"] and s.get_index("t", "ns")["upto"] > before
    s.drop_index("t", "ns")
    assert s.list_indexes("t") == {} and found(n=1, s="x") == ["new"]
    with pytest.raises(EngineError, match="unknown_index"):
        s.drop_index("t", "ns")


def test_more_holes_than_are_named(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "NAMED_HOLES", 3)
    s = S.Store(spark, str(tmp_path / "s"))
    s.merge("t", spark.createDataFrame([(f"k{i}", "{oops" if i < 8 else "{}") for i in range(10)], "key string, body string"))
    side = s.open(Database(spark), "t", complete=False)
    assert [h.source for h in side.holes] == ["k0", "k1", "k2", "5 more"] and side.rows.count() == 2


def test_a_shared_folder_is_wanted_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from larkspan.errors import StaticError
    from larkspan.sources import durable

    conf = SimpleNamespace(get=lambda *a: None)
    fake = lambda master: SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: conf, master=master))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(StaticError, match="no_shared_folder"):
            durable.shared_folder(fake(master))
    assert durable.shared_folder(fake("local[2]"))

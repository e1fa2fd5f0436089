"""The document layer: policies, pipelines, versions."""

import datetime as dt

import pytest

from larkspan.errors import EngineError, StaticError
from larkspan.operators import documents as M


@pytest.fixture(scope="module")
def docs(spark):
    t = dt.datetime(2024, 1, 1)
    a = spark.createDataFrame([("A1", "ann", False, t, 5, ["x", "y"], "s1"), ("A2", "ann", None, t, 7, [], "s2"), ("A3", "bob", None, t, 9, ["x"], "s3"), ("A4", "ann", True, t, 1, None, "s4")], "_uuid string, _owner string, _deleted boolean, _updated timestamp, n int, tags array<string>, _secret string")
    b = spark.createDataFrame([("x", "ann", None), ("y", "ann", True), ("x", "bob", None)], "tag string, _owner string, _deleted boolean")
    g = spark.createDataFrame([("r", None), ("m", "r"), ("l", "m"), ("o", "zz")], "id string, parent string")
    return M.Documents({"items": a, "tags": b, "tree": g})


def ids(df):
    return sorted(r["_uuid"] for r in df.collect())


def test_find(docs):
    assert ids(docs.find("items")) == ["A1", "A2", "A3"]
    assert ids(docs.find("items", {"_deleted": True})) == ["A4"]
    assert docs.get("items", "a2").first().n == 7
    assert docs.count("items", {"n": {"$gt": 5}}) == 2
    assert [r["_uuid"] for r in docs.find("items", sort={"n": -1}, skip=1, limit=1).collect()] == ["A2"]
    assert docs.find("items", projection=["n"]).columns == ["n"]
    mine = M.Documents(docs.tables, owner="ann", secure=("_secret",))
    assert ids(mine.find("items", {"_owner": " ann "})) == ["A1", "A2"] and "_secret" not in mine.find("items").columns
    with pytest.raises(EngineError):
        mine.find("items", {"_owner": "bob"})
    with pytest.raises(StaticError):
        M.Documents(docs.tables, strict_owner=True).find("items")


def test_pipelines(docs):
    mine = M.Documents(docs.tables, owner="ann")
    out = mine.aggregate("items", [{"$match": {"n": {"$gte": 5}}}, {"$lookup": {"from": "tags", "localField": "tags", "foreignField": "tag", "as": "t"}}, {"$sort": {"n": 1}}, {"$project": {"_uuid": 1, "t": 1, "m": {"$multiply": ["$n", 2]}}}])
    assert [(r["_uuid"], [x.tag for x in r.t], r.m) for r in out.collect()] == [("A1", ["x"], 10), ("A2", [], 14)]
    groups = docs.aggregate("items", [{"$group": {"_id": "$_owner", "n": {"$sum": 1}, "total": {"$sum": "$n"}}}, {"$sort": {"_id": 1}}])
    assert [tuple(r) for r in groups.collect()] == [("ann", 2, 12), ("bob", 1, 9)]
    one = docs.aggregate("items", [{"$facet": {"a": [{"$match": {"n": 5}}], "b": [{"$count": "k"}]}}]).first()
    assert len(one.a) == 1 and one.b[0].k == 3
    assert docs.aggregate("items", [{"$unionWith": {"coll": "tags"}}]).count() == 5
    assert docs.aggregate("items", [{"$unwind": "$tags"}]).count() == 3
    reach = docs.aggregate("tree", [{"$graphLookup": {"from": "tree", "startWith": "$parent", "connectFromField": "parent", "connectToField": "id", "as": "up"}}])
    assert {r.id: [x.id for x in r.up] for r in reach.collect()} == {"r": [], "m": ["r"], "l": ["m", "r"], "o": []}
    scalar = docs.aggregate("tree", [{"$lookup": {"from": "tree", "localField": "parent", "foreignField": "id", "as": "p"}}])
    assert {r.id: len(r.p) for r in scalar.collect()} == {"r": 0, "m": 1, "l": 1, "o": 0}


def test_validation(docs):
    for bad in ([{"$out": "x"}], [{"$facet": {"a": [{"$out": "x"}]}}], [{"$project": {"a": {"$function": {}}}}], [{"$limit": 0}], [{"$match": {}}] * 51, [{"a": 1, "b": 2}]):
        with pytest.raises(StaticError):
            M.validate(bad)
    M.validate([{"$group": {"_id": None}}])
    with pytest.raises(StaticError):
        M.validate([{"$group": {"_id": None}}], "strict")
    with pytest.raises(StaticError):
        M.validate([{"$match": {"_secret": 1}}], secure=("_secret",))
    with pytest.raises(StaticError):
        docs.aggregate("items", [{"$nope": 1}])


def test_writes(docs):
    up = docs.update_all("items", {"n": {"$lt": 8}}, {"n": 0})
    assert sorted(r.n for r in up.tables["items"].collect()) == [0, 0, 1, 9]
    gone = docs.delete_all("items", {"_uuid": "a1"}, dt.datetime(2024, 5, 1))
    assert ids(gone.find("items")) == ["A2", "A3"]
    assert ids(gone.restore("items", {"_uuid": "A1"}).find("items")) == ["A1", "A2", "A3"]
    assert gone.purge_deleted_older_than("items", dt.datetime(2024, 3, 1)).tables["items"].count() == 3
    v = docs.update_versioned("items", "A2", {"n": 70}).update_versioned("items", "A2", {"n": 71})
    assert [(r["_v"], r.n) for r in v.list_versions("items", "a2").collect()] == [(2, 70), (1, 7)]
    assert v.get("items", "A2").first().n == 71
    back = v.revert_to_version("items", "A2", 1)
    assert back.get("items", "A2").first().n == 7 and back.tables["items"].count() == 4
    with pytest.raises(StaticError):
        docs.update_all("items", {}, {"_owner": "x"})
    assert M.latest_versions(v.versions["items"]).first()["_v"] == 2


def test_schema(spark):
    lines = spark.createDataFrame([('{"a": 1, "b": "x"}',), ('{"a": "no"}',), ('{"b": "y"}',), ("{",)], "j string")
    good, bad = M.apply_schema(lines, "j", "a int, b string", ["a"])
    assert [tuple(r) for r in good.collect()] == [(1, "x")] and bad.count() == 3


def test_a_graph_of_any_depth(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(106)] + [(900, 901), (901, 900)], "k int, up int")
    found = M.Documents({"t": chain}).aggregate("t", [{"$match": {"k": {"$gt": 104}}}, {"$graphLookup": {"from": "t", "startWith": "$up", "connectFromField": "up", "connectToField": "k", "as": "above"}}])
    assert {r.k: len(r.above) for r in found.collect()} == {105: 105, 900: 2, 901: 2}


def test_graphs_by_their_sizes_and_documents(spark):
    """Chains, branches, circles, doubled and missing documents, against a walk; sizes alone read no documents."""
    rows = [(i, i // 2 or None) for i in range(1, 40)] + [(17, 8), (50, 51), (51, 52), (52, 50), (53, 50), (60, 1), (60, 50), (61, 60), (62, 99), (63, None), (64, 64)]
    starts = [(i, s) for i, s in enumerate([None, 1, 17, 34, 39, 50, 53, 60, 61, 62, 63, 64, 99, 7, 7])]
    docs = M.Documents({"t": spark.createDataFrame(rows, "k long, up int"), "s": spark.createDataFrame(starts, "id int, at int")})

    def walk(start, depth=None):
        seen, front = set(), {start}
        while front and (depth is None or depth >= 0):
            front = {x for x in front if any(k == x for k, _ in rows)} - seen
            seen |= front
            front = {u for k, u in rows if k in front and u is not None}
            depth = None if depth is None else depth - 1
        return sorted((r for r in rows if r[0] in seen), key=lambda r: (r[0], r[1] is not None, r[1] or 0))

    for depth in (None, 0, 2):
        look = {"from": "t", "startWith": "$at", "connectFromField": "up", "connectToField": "k", "as": "all"} | ({} if depth is None else {"maxDepth": depth})
        want = {i: walk(s, depth) for i, s in starts}
        found = docs.aggregate("s", [{"$graphLookup": look}])
        assert {r.id: [tuple(x) for x in r["all"]] for r in found.collect()} == want
        sized = docs.aggregate("s", [{"$graphLookup": look}, {"$project": {"id": 1, "n": {"$size": "$all"}}}])
        assert {r.id: r.n for r in sized.collect()} == {i: len(w) for i, w in want.items()}
        assert "collect_list" not in sized._jdf.queryExecution().toString()
    both = docs.aggregate("s", [{"$graphLookup": look}, {"$project": {"n": {"$size": "$all"}, "all": 1}}])
    assert all(len(r["all"]) == r.n for r in both.collect())


def test_a_facet_too_large_is_refused(docs, monkeypatch):
    monkeypatch.setattr(M, "MOST_FACET", 2)
    with pytest.raises(EngineError, match="facet_too_large"):
        docs.aggregate("items", [{"$facet": {"a": [{"$match": {}}]}}])

"""Filters in other dialects, joins, and sets."""

import json

import pytest

from larkspan.catalog import Database
from larkspan.errors import BudgetError, StaticError
from larkspan.operators import sets
from larkspan.operators.core import Engine
from larkspan.operators.join import MultiQuery
from larkspan.plans import dialects as D
from larkspan.plans import predicates as P
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def db(spark):
    db = Database(spark)
    rows = [{"_key": "a", "n": 1, "t": "x"}, {"_key": "b", "n": None}, {"_key": "c"}, {"_key": "d", "n": 5, "t": "xy", "tags": ["p", "q"]}, {"_key": "e", "n": "5"}, {"_key": "f", "n": True}]
    db.add_json("docs", spark.createDataFrame([(r["_key"], json.dumps({k: v for k, v in r.items() if k != "_key"})) for r in rows], "_key string, json string"))
    db.add("customers", spark.createDataFrame([(1, "ann"), (2, "bob"), (None, "nil")], "id int, name string"), "id")
    db.add("orders", spark.createDataFrame([(10, 1, "p"), (11, 1, "q"), (12, None, "p"), (13, 7, "p")], "oid int, cid int, pid string"), "oid")
    db.add("products", spark.createDataFrame([("p", 3.0), ("q", 4.0)], "pid string, price double"), "pid")
    return db


def found(db, f):
    return [r["_key"] for r in D.find(db["docs"], f).collect()]


def test_mongo(db):
    assert found(db, D.from_mongo({"n": {"$ne": 1}})) == ["b", "c", "d", "e", "f"]
    assert found(db, D.from_mongo({"n": {"$gte": 1, "$lt": 6}})) == ["a", "d"]
    assert found(db, D.from_mongo({"n": None})) == ["b"]
    assert found(db, D.from_mongo({"$or": [{"n": {"$exists": False}}, {"t": {"$prefix": "xy"}}]})) == ["c", "d"]
    assert found(db, D.from_mongo({"$not": {"n": {"$in": [1, 5]}}})) == ["b", "c", "e", "f"]
    assert found(db, D.from_mongo('{"tags": {"$contains": "q"}, "n": 5}')) == ["d"]
    assert found(db, D.from_mongo({"n": {"$gt": False}})) == ["f"]
    assert found(db, D.from_mongo({})) == list("abcdef")
    for bad in ({"n": {"$regex": "x"}}, {"$nor": []}, {"a..b": 1}, {"n": {"x": 1}}):
        with pytest.raises(StaticError):
            D.from_mongo(bad)


def test_filter_as_total_predicate(db):
    for f in (D.from_mongo({"n": {"$ne": 1}}), D.from_mongo({"$not": {"t": {"$ne": "x"}}})):
        e = Engine(db)
        from larkspan.plans.query import Builder

        assert [r["_key"] for r in e.run(Builder("docs").where(f.to_predicate()).order_by("_key").build()).collect()] == found(db, f)


def test_sql(db):
    f, columns, table = D.from_sql("SELECT a, b.c AS z FROM docs WHERE n IS NULL OR t = \"x\"")
    assert columns == ("a", "b.c") and table == "docs" and found(db, f) == ["a", "b", "c"]
    assert found(db, D.from_sql("n NOT IN (1, 5)")[0]) == ["b", "c", "e", "f"]
    assert found(db, D.from_sql("n <> 1 AND NOT (t = 'xy')")[0]) == ["b", "c", "e", "f"]
    for bad in ("SELECT * FROM docs ORDER BY n", "SELECT * FROM a JOIN b ON a.x = b.x", "n BETWEEN 1 AND 2", "lower(t) = 'x'"):
        with pytest.raises(StaticError):
            D.from_sql(bad)


def test_sql_plus(db):
    plan = D.from_sql_plus("SELECT o.oid, pid FROM orders AS o WHERE o.cid = :c AND pid IS NOT NULL ORDER BY oid DESC LIMIT 1 PAGE SIZE 9")
    assert plan.project == ("oid", "pid") and plan.page_size == 9
    assert [r.oid for r in Engine(db).run(plan, {"c": 1}).collect()] == [11]
    assert D.from_sql_plus("SELECT * FROM orders WHERE cid != 1").where == P.Or((P.Test("missing", P.Path("cid")), P.Compare("ne", P.Path("cid"), P.Lit(1))))
    for bad, why in (("SELECT a FROM x GROUP BY a", "group_by"), ("SELECT count(a) FROM x", "function"), ("SELECT a FROM x UNION SELECT b FROM y", "set_operation"), ("SELECT a FROM x, y", "joins"), ("SELECT a FROM x WHERE a LIKE 'b'", "like"), ("SELECT DISTINCT a FROM x", "distinct"), ("DELETE FROM x", "write"), ("SELECT a FROM x WHERE a IN (SELECT 1)", "subquery")):
        with pytest.raises(StaticError, match=why):
            D.from_sql_plus(bad)


def test_registry(db):
    d = D.Dialects()
    assert found(db, d.compile("sda", "getPath(_, Seq[\"n\"]) = Some(5)")) == ["d"]
    for name in ("rql", "graphql", "nope"):
        with pytest.raises(StaticError):
            d.compile(name, "")
    d.register("eq", lambda s: D.Filter(P.Compare("eq", P.Path(s.split("=")[0]), P.Lit(int(s.split("=")[1])))))
    assert found(db, d.compile("eq", "n=1")) == ["a"]
    with pytest.raises(StaticError):
        d.register("sql", D.from_mongo)


def test_find_order_and_plan(db):
    plan = D.FindPlan(P.Const(True), (("n", False),), 4)
    assert D.FindPlan.from_json(plan.to_json()) == plan
    assert [r["_key"] for r in D.find(db["docs"], plan).collect()] == ["b", "c", "f", "a"]
    with pytest.raises(BudgetError):
        D.find(db["docs"], D.FindPlan(P.Const(True), documents=2))


def test_multi_query(db):
    q = MultiQuery(db).source("orders", "o").join("customers", "c", "cid", "id").join("products", "p", "pid", "pid")
    rows = q.collect_df().select("o.oid", "c.name", "p.price").orderBy("oid").collect()
    assert [tuple(r) for r in rows] == [(10, "ann", 3.0), (11, "ann", 4.0), (12, "nil", 3.0)]
    assert q.where(P.field("price").gt(3)).limit(5).collect_df().count() == 1
    assert q.describe()["sources"][1]["on"] == ["o.cid", "c.id"]
    assert q.map_algebra('p<price>? |> typeOf(_)').first()[0] == '"some"'
    with pytest.raises(StaticError):
        q.join("orders", "o", "x", "y")
    with pytest.raises(StaticError):
        q.join("orders", "o2", "zzz", "oid").collect_df()
    with pytest.raises(BudgetError):
        MultiQuery(db).source("orders").source_budget(1).collect_df()


def test_sets(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "x int") for xs in ([1, 1, 2, None], [1, None, 3]))
    got = lambda df: sorted((r.x for r in df.collect()), key=str)
    assert got(sets.set_union(a, b)) == sorted([1, 2, 3, None], key=str)
    assert got(sets.set_intersection(a, b)) == [1, None]
    assert got(sets.set_difference(a, b)) == [2]
    assert got(sets.bag_union(a, b)) == sorted([1, 1, 2, None, 1, None, 3], key=str)
    assert got(sets.bag_difference(a, b)) == [1, 2]
    row = spark.createDataFrame([([1, 1, 2, 3], [1, 3, 3])], "a array<int>, b array<int>").select(sets.array_bag_difference(F.col("a"), F.col("b")).alias("d"), sets.membership(F.lit(2), F.col("a")).alias("m"), sets.multiplicity(F.lit(1), F.col("a")).alias("n")).first()
    assert sorted(row.d) == [1, 2] and row.m and row.n == 2

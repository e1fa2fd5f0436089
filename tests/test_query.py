"""The query language over typed and schemaless collections."""

import json

import pytest

from larkspan.catalog import Database, Hole
from larkspan.errors import BudgetError, CardinalityError, CoverageError, StaticError
from larkspan.operators.core import Engine
from larkspan.plans import predicates as P
from larkspan.plans.query import Builder, Item, plan_from_json
from larkspan.plans.text import parse, parse_predicate

EDGE = [{}, {"a": None}, {"a": 1}, {"a": 1.0}, {"a": -0.0}, {"a": 9007199254740993}, {"a": "1.5"}, {"a": " 2 "}, {"a": "NaN"}, {"a": "x"}, {"a": True}, {"a": []}, {"a": [None]}, {"a": ["v", "v"]}, {"a": {"b": None}}, {"a": {"b": 1}}]


@pytest.fixture(scope="module")
def db(spark):
    db = Database(spark)
    docs = spark.createDataFrame([(f"k{i:02d}", json.dumps(d)) for i, d in enumerate(EDGE)], "_key string, json string")
    db.add_json("edge", docs)
    db.add("customers", spark.createDataFrame([(1, "ann", "gold"), (2, "bob", None), (3, "cy", "gold")], "id int, name string, tier string"), "id")
    db.add("orders", spark.createDataFrame([(10, 1, 5.0, "F"), (11, 1, 7.5, "O"), (12, 2, 2.0, "F"), (13, None, 9.0, "O"), (14, 9, 1.0, "F")], "id int, customer_id int, total double, status string"), "id")
    db.add("carts", spark.createDataFrame([("c1", [{"sku": "a", "qty": 1}, {"sku": "b", "qty": 5}]), ("c2", []), ("c3", [{"sku": "z", "qty": 9}])], "_key string, items array<struct<sku:string,qty:int>>"), "_key")
    db.add("products", spark.createDataFrame([("a", "apple"), ("b", "bean")], "sku string, name string"), "sku")
    return db


def keys(df):
    return [r["_key"] for r in df.select("_key").collect()]


def edge_oracle(test):
    """Keys whose document passes; the test gets (present, value)."""
    return [f"k{i:02d}" for i, d in enumerate(EDGE) if test("a" in d, d.get("a"))]


def is_num(v):
    return isinstance(v, (int, float)) and not isinstance(v, bool)


@pytest.mark.parametrize(
    ("text", "test"),
    [
        ("a = 1", lambda p, v: p and is_num(v) and v == 1),
        ("a != 1", lambda p, v: p and not (is_num(v) and v == 1)),
        ("a = null", lambda p, v: p and v is None),
        ("a != null", lambda p, v: p and v is not None),
        ("a < 5", lambda p, v: p and is_num(v) and v < 5),
        ("not (a < 5)", lambda p, v: not (p and is_num(v) and v < 5)),
        ('a >= "1"', lambda p, v: p and isinstance(v, str) and v >= "1"),
        ("a in [1, null]", lambda p, v: p and (v is None or (is_num(v) and v == 1))),
        ("a not in [1]", lambda p, v: p and not (is_num(v) and v == 1)),
        ("present(a)", lambda p, v: p),
        ("missing(a)", lambda p, v: not p),
        ("a is null", lambda p, v: p and v is None),
        ("a is not null", lambda p, v: p and v is not None),
        ('starts_with(a, "1")', lambda p, v: isinstance(v, str) and v.startswith("1")),
        ('contains(a, "v")', lambda p, v: (isinstance(v, str) and "v" in v) or (isinstance(v, list) and "v" in v)),
        ("a contains null", lambda p, v: isinstance(v, list) and None in v),
        ("a = []", lambda p, v: v == []),
        ("a.b = 1", lambda p, v: isinstance(v, dict) and v.get("b") == 1),
        ("a.b is null", lambda p, v: isinstance(v, dict) and "b" in v and v["b"] is None),
        ("a = a", lambda p, v: p),
        ("a = true or a = 9007199254740993", lambda p, v: v is True or v == 9007199254740993),
        ("true and not false", lambda p, v: True),
    ],
)
def test_predicates_on_schemaless_documents(db, text, test):
    got = keys(Engine(db).run(f"from edge where {text} order by _key"))
    assert got == edge_oracle(test)


def test_predicate_json_round_trip():
    p = parse_predicate('a = 1 and not (b in ["x", $p] or starts_with(c, "d")) and e contains 2 and f is null and g <> h')
    assert P.from_json(json.loads(json.dumps(P.to_json(p)))) == p


def test_typed_null_is_present(db):
    e = Engine(db)
    assert e.run("from orders where present(customer_id) project id").count() == 5
    assert [r.id for r in e.run("from orders where customer_id is null project id").collect()] == [13]
    assert e.run("from orders where customer_id != 1").count() == 3
    assert e.run("from orders where status = 3").count() == 0
    assert e.run("from orders where total > $t", {"t": 6}).count() == 2
    with pytest.raises(StaticError, match="unbound"):
        e.run("from orders where total > $t")


def test_order_limit_projection(db):
    e = Engine(db)
    assert [r.id for r in e.run("from orders project id, total order by total desc limit 2").collect()] == [13, 11]
    assert [r.id for r in e.run("from orders order by customer_id desc nulls last, id").collect()] == [14, 12, 10, 11, 13]
    assert [r.id for r in e.run("from orders order by customer_id nulls first").collect()] == [13, 10, 11, 12, 14]
    assert e.run("from orders limit 0").count() == 0
    assert e.run("from orders project {}").columns == []
    assert e.run("from orders project nope, id").columns == ["id"]


def test_cross_type_order(db):
    got = keys(Engine(db).run("from edge order by a"))
    assert got[0] == "k01" and got[1] == "k10" and got[-1] == "k00"
    assert got[2:6] == ["k04", "k02", "k03", "k05"]


def test_group_aggregate(db):
    e = Engine(db)
    rows = {r.status: (r.n, r.s, r.lo, r.hi, r.m) for r in e.run("from orders group by status project count() as n, sum(total) as s, min(total) as lo, max(total) as hi, avg(total) as m").collect()}
    assert rows == {"F": (3, 8.0, 1.0, 5.0, 8 / 3), "O": (2, 16.5, 7.5, 9.0, 8.25)}
    assert e.run("from orders where id > 99 project count() as n").count() == 0
    one = e.run("from edge project count() as n, sum(a) as s").first()
    assert one.n == 16 and one.s == 1 + 1 + 9007199254740992 + 1.5 + 2
    assert sorted(r.status for r in e.run("from orders group by status").collect()) == ["F", "O"]
    with pytest.raises(StaticError, match="duplicate"):
        parse("from orders group by a.x, b.x")


def test_enrich(db):
    e = Engine(db)
    with pytest.raises(CardinalityError):
        e.run("from orders enrich c using customers matching customer_id = id expect exactly_one")
    ok = e.run('from orders where id < 13 enrich c using customers as k matching customer_id = k.id expect exactly_one where c.tier = "gold" project { id, who: c.name, c { tier } }')
    assert [(r.id, r.who, r.c.tier) for r in ok.orderBy("id").collect()] == [(10, "ann", "gold"), (11, "ann", "gold")]
    opt = e.run("from orders enrich c using customers matching customer_id = id expect optional order by id")
    assert [r.c and r.c.name for r in opt.collect()] == ["ann", "ann", "bob", None, None]
    many = e.run("from customers enrich os using orders as o matching id = o.customer_id where o.total > 5 expect many order by id")
    assert [[x.id for x in r.os] for r in many.collect()] == [[11], [], []]
    short = e.run("from customers enrich os from orders on customers.id = orders.customer_id many order by id")
    assert [[x.id for x in r.os] for r in short.collect()] == [[10, 11], [12], []]
    with pytest.raises(CardinalityError):
        e.run("from customers enrich o using orders matching id = customer_id expect optional")
    with pytest.raises(StaticError, match="field_exists"):
        e.run("from orders enrich total using customers matching customer_id = id expect many")
    with pytest.raises(StaticError, match="projection_drops"):
        parse("from orders enrich c using customers matching customer_id = id expect many project id")


def test_enrich_cardinality_holds_when_pruned(db):
    with pytest.raises(CardinalityError):
        Engine(db).run("from orders enrich c using customers matching customer_id = id expect exactly_one project { id }").count()


def test_within(db):
    e = Engine(db)
    got = {r["_key"]: [x.sku for x in r["items"]] for r in e.run("from carts within items as i { where i.qty > 2 }").collect()}
    assert got == {"c1": ["b"], "c2": [], "c3": ["z"]}
    got = {r["_key"]: [(x.sku, x.p and x.p.name) for x in r["items"]] for r in e.run("from carts within items { enrich p using products matching sku = sku expect optional }").collect()}
    assert got == {"c1": [("a", "apple"), ("b", "bean")], "c2": [], "c3": [("z", None)]}
    shaped = e.run("from carts project { _key, items { code: sku } }")
    assert [x.code for x in shaped.orderBy("_key").first()["items"]] == ["a", "b"]
    with pytest.raises(StaticError, match="within_carrier"):
        e.run("from orders within total { where x = 1 }")
    with pytest.raises(StaticError, match="project_type"):
        e.run("from orders project { total { x } }")


def test_within_with_filters_and_attachments(db, spark):
    """Documents whose elements are all filtered keep the rest of their columns; what carries them matches nothing."""
    rows = spark.createDataFrame([(1, "a", [("x", 1, [("p", 1)]), ("y", 2, [])]), (2, None, []), (3, "c", [(None, 3, [("q", 9), ("p", 4)])])], "id int, note string, items array<struct<sku:string,qty:int,parts:array<struct<k:string,n:int>>>>")
    files = Database(spark)
    files.add("carts", rows, "id")
    files.add("skus", spark.createDataFrame([("x", "ex"), ("y", "why"), (None, "none")], "sku string, name string"), "sku")
    files.add("kinds", spark.createDataFrame([("p", "pe"), ("q", "cue")], "k string, label string"), "k")
    e = Engine(files)
    got = {r.id: (r.note, [(x.qty, x.s.name) for x in r["items"]]) for r in e.run("from carts within items as i { where i.qty > 1 enrich s using skus matching sku = sku expect exactly_one }").collect()}
    assert got == {1: ("a", [(2, "why")]), 2: (None, []), 3: ("c", [(3, "none")])}
    deep = {r.id: [[(p.n, p.d.label) for p in x.parts] for x in r["items"]] for r in e.run("from carts within items as i { within parts as p { where p.n < 9 enrich d using kinds matching k = k expect exactly_one } }").collect()}
    assert deep == {1: [[(1, "pe")], []], 2: [], 3: [[(4, "pe")]]}
    with pytest.raises(CardinalityError):
        e.run("from carts within items { enrich s using kinds matching sku = k expect exactly_one }")


def test_cardinality_of_chains(spark):
    """Violations in documents that nobody attached don't matter; those that matter are found."""
    db = Database(spark)
    db.add("a", spark.createDataFrame([(1, 10), (2, 20)], "id int, b int"), "id")
    db.add("b", spark.createDataFrame([(10, 100), (20, 200), (30, 999)], "id int, c int"), "id")
    db.add("c", spark.createDataFrame([(100, "x"), (200, "y")], "id int, name string"), "id")
    text = "from a enrich b1 using b matching b = id expect exactly_one enrich c1 using c matching b1.c = id expect exactly_one project { id, name: c1.name }"
    assert sorted(tuple(r) for r in Engine(db).run(text).collect()) == [(1, "x"), (2, "y")]
    db.add("c", spark.createDataFrame([(100, "x")], "id int, name string"), "id")
    with pytest.raises(CardinalityError):
        Engine(db).run(text)
    db.add("c", spark.createDataFrame([(100, "x"), (200, "y"), (200, "z")], "id int, name string"), "id")
    with pytest.raises(CardinalityError):
        Engine(db).run(text.replace("expect exactly_one project", "expect optional project"))
    db.add("c", spark.createDataFrame([(100, "x"), (999, "y"), (999, "z")], "id int, name string"), "id")
    assert sorted(str(r.name) for r in Engine(db).run(text.replace("expect exactly_one project", "expect optional project")).collect()) == ["None", "x"]


def test_builder_and_text_have_one_hash():
    text = parse('from orders where status = "F" and total > 1 project id, total order by total desc limit 3')
    built = Builder("orders").where(P.field("status").eq("F") & P.field("total").gt(1)).project("id", "total").order_by("total", True).limit(3).build()
    assert text == built and text.hash() == built.hash()
    assert plan_from_json(json.loads(text.canonical())) == text
    full = parse("from a enrich b using c matching x = y expect many within z { where q = 1 } project { m: n, o { p } }")
    assert plan_from_json(json.loads(full.canonical())) == full
    assert full.brace == (Item("m", "n"), Item("o", "o", (Item("p", "p"),)))


def test_pages_join_to_the_whole(db):
    e = Engine(db)
    for text in ("from orders order by customer_id desc nulls first", "from edge order by a desc", "from orders", "from orders order by status limit 4", "from orders group by status project count() as n"):
        whole = e.run(text + (" order by status" if "group" in text else " order by _key" if "order" not in text else "")).collect()
        rows, token = [], None
        while True:
            page = e.page(text, after=token, size=2)
            rows += page.rows.collect()
            token = page.continuation
            if token is None:
                break
        assert [str(r) for r in rows] == [str(r) for r in whole], text
    token = e.page("from orders", size=2).continuation
    with pytest.raises(StaticError, match="bad_continuation"):
        e.page("from orders where id > 0", after=token)
    with pytest.raises(StaticError, match="expired"):
        e.page("from orders", after=token, now=1e12)


def test_all_pages_by_one_sort(db, spark):
    """The rows, pages and tokens that following page by page gives, with no more jobs for more pages."""
    e = Engine(db)
    for text in ("from orders order by customer_id desc nulls first", "from edge order by a desc", "from orders", "from orders order by status limit 4", "from orders order by status limit 3", "from orders where id < 0", "from orders group by status project count() as n", "from orders project status order by total", "from orders enrich c using customers matching customer_id = id expect many project { id, who: c.name }"):
        for size in (2, 100):
            rows, tokens, after = [], [], None
            while True:
                page = e.page(text, after=after, size=size, now=1e9)
                rows += [(len(tokens), str(r)) for r in page.rows.collect()]
                after = page.continuation
                if after is None:
                    break
                tokens.append(after)
            found = e.pages(text, size=size, now=1e9)
            assert [(r[found.number], str(r)) for r in found.rows.collect()] == [(n, r[:-1] + f", _page={n})") for n, r in rows], (text, size)
            assert found.continuations == tuple(tokens), (text, size)


def test_coverage_and_budgets(db, spark):
    holed = Database(spark)
    holed.add("t", spark.range(10).withColumnRenamed("id", "n"), "n", [Hole("part-3", "missing")])
    e = Engine(holed)
    with pytest.raises(CoverageError):
        e.run("from t")
    page = e.page("from t coverage allow incomplete")
    assert not page.complete and page.holes[0].source == "part-3"
    with pytest.raises(BudgetError):
        Engine(db).run("from orders budget { documents: 2 }")
    page = Engine(db).page("from orders coverage allow incomplete budget { documents: 2 }")
    assert [h.reason for h in page.holes] == ["budget_exhausted_documents"] and page.rows.count() == 2
    with pytest.raises(BudgetError):
        Engine(db).run("from orders budget { result_bytes: 3 }")


def test_refusals():
    for bad in ("from a limit", "from a where", "select x", "from a at rank 3", "from a access direct", 'from a after "x"', "from a limit 1 limit 2", "from a page size 0", "from a project { x, y.x }", "from a where b in $c"):
        with pytest.raises(StaticError):
            parse(bad)
    assert parse('from a where b = "at rank direct enrich"').where is not None


def test_scans(db):
    assert [r["_key"] for r in db["orders"].list_keys(2, 10).collect()] == [11, 12]
    assert db["orders"].get(12).first().total == 2.0 and db["orders"].get(99).count() == 0
    assert [r["id"] for r in db["orders"].iterate()] == [10, 11, 12, 13, 14]
    assert db.list_collections() == ["carts", "customers", "edge", "orders", "products"]
    assert Engine(db).explain("explain from orders where id = 1")["operators"] == ["bind", "scan", "filter", "order", "page"]


def test_filters_and_columns_reach_the_scan(db, spark, tmp_path):
    db["orders"].df.write.parquet(str(tmp_path / "o"))
    files = Database(spark)
    files.add("orders", spark.read.parquet(str(tmp_path / "o")), "id")
    df = Engine(files).run('from orders where status = "F" and total > 1 and (id < 12 or id >= 14) project total')
    plan = df._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("]")[0]
    assert "EqualTo(status,F)" in pushed and "GreaterThan(total,1.0)" in pushed and "Or(" in pushed
    assert "customer_id" not in plan[plan.index("ReadSchema") :]
    db["customers"].df.write.parquet(str(tmp_path / "c"))
    files.add("customers", spark.read.parquet(str(tmp_path / "c")), "id")
    joined = Engine(files).run("from orders where id < 13 enrich c using customers matching customer_id = id expect exactly_one project { id, who: c.name }")
    assert "tier" not in joined._jdf.queryExecution().executedPlan().toString() and [r.who for r in joined.orderBy("id").collect()] == ["ann", "ann", "bob"]
    nested = Engine(files).run("from orders enrich c using customers matching customer_id = id expect optional where c.tier = \"gold\" project { id, c { name } }")
    assert [r.c.name for r in nested.orderBy("id").collect()] == ["ann", "ann"] and nested.select("c.*").columns == ["name"]
    top = Engine(files).run("from orders order by total desc limit 2")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in top

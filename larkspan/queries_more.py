"""Registered queries of scans, filters, refusals, the store, examination and documents, with equivalent SQL."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.catalog import Database, Hole
from larkspan.errors import EngineError
from larkspan.functions import algebra
from larkspan.operators import documents as M
from larkspan.operators import service as V
from larkspan.operators.core import Engine
from larkspan.operators.join import MultiQuery
from larkspan.plans import dialects as D
from larkspan.plans import predicates as P
from larkspan.plans.query import Builder
from larkspan.plans.text import parse
from larkspan.queries_algebra import QUERIES as _ALGEBRA
from larkspan.queries_algebra import ORACLES as _ALGEBRA_SQL
from larkspan.sources import examine as X
from larkspan.sources import store as S
from larkspan.sources.durable import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = dict(_ALGEBRA)
ORACLES: dict[str, str] = dict(_ALGEBRA_SQL)
KEYS = {"nation": "n_nationkey", "region": "r_regionkey", "customer": "c_custkey", "orders": "o_orderkey", "part": "p_partkey", "supplier": "s_suppkey", "events": "event_id", "documents": "doc_id", "labels": "doc_id"}


def _register(name: str, sql: str) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name], ORACLES[name] = fn, sql
        return fn

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _db(spark: SparkSession, sf_dir: str, *names: str) -> Database:
    db = Database(spark)
    for n in names:
        db.add(n, _read(spark, sf_dir, n), KEYS[n])
    return db


def _text(name: str, tables: tuple[str, ...], text: str, sql: str, **params: object) -> None:
    QUERIES[name] = lambda spark, sf_dir: Engine(_db(spark, sf_dir, *tables)).run(text, params)
    ORACLES[name] = sql


def _values(*rows: tuple[str, str]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in rows) + ") t(what, code)"


def _codes(spark: SparkSession, calls: dict[str, Callable[[], object]]) -> DataFrame:
    """What each call is refused with."""
    rows = []
    for what, call in calls.items():
        try:
            call()
            rows.append((what, "ran"))
        except EngineError as e:
            rows.append((what, e.code))
    return spark.createDataFrame(rows, "what string, code string")


# scans

_text("scan_identity", ("nation",), "from nation", "SELECT *, n_nationkey AS _key FROM nation")
_text("scan_default_order", ("orders",), "from orders project o_orderkey, o_custkey limit 75", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 75")


@_register("scan_keys", "SELECT c_custkey AS _key FROM customer WHERE c_custkey > 100")
def scan_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _db(spark, sf_dir, "customer")["customer"].list_keys(None, 100)


@_register("scan_get", "SELECT p_partkey, p_brand FROM part WHERE p_partkey = 17")
def scan_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _db(spark, sf_dir, "part")["part"].get(17).select("p_partkey", "p_brand")


@_register("scan_after", "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_suppkey > 20")
def scan_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _db(spark, sf_dir, "supplier")["supplier"].scan(after=20).select("s_suppkey", "s_acctbal")


@_register("scan_iterate", "SELECT n_nationkey, n_name FROM nation")
def scan_iterate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _db(spark, sf_dir, "nation")["nation"].iterate()
    return spark.createDataFrame([(r["n_nationkey"], r["n_name"]) for r in rows], "n_nationkey int, n_name string")


@_register("scan_with_holes", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 500")
def scan_with_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a collection with a part missing, where that is allowed."""
    db = Database(spark)
    db.add("orders", _read(spark, sf_dir, "orders"), "o_orderkey", [Hole("part-9", "missing")])
    return Engine(db).page("from orders project o_orderkey coverage allow incomplete", size=500).rows


@_register("budget_soft_stop", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 120")
def budget_soft_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document budget stops in key order where incomplete results are allowed; the stricter of two holds."""
    from larkspan.plans.query import Budget

    engine = Engine(_db(spark, sf_dir, "customer"), budget=Budget(documents=120))
    return engine.run("from customer project c_custkey coverage allow incomplete budget { documents: 500 }")


# predicates and filters


@_register("predicate_constants", "SELECT o_orderkey FROM orders WHERE o_orderkey > 100")
def predicate_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.And((P.Const(True), P.Or((P.Const(False), P.node(P.field("o_orderkey").gt(100)))), P.Or((P.Compare("lt", P.Lit(1), P.Lit(2)),)), P.Not(P.Or(()))))
    return Engine(_db(spark, sf_dir, "orders")).run(Builder("orders").where(p).project("o_orderkey").build())


@_register("predicate_fluent", "SELECT p_partkey FROM part WHERE ((p_size >= 5 AND p_size < 30) OR p_brand IN ('Brand#11', 'Brand#12')) AND NOT starts_with(p_type, 'S') AND p_name IS NOT NULL")
def predicate_fluent(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = P.field
    p = ((f("p_size").gte(5) & f("p_size").lt(30)) | f("p_brand").isin("Brand#11", "Brand#12")) & ~f("p_type").starts_with("S") & f("p_name").present() & f("p_name").is_not_null()
    return Engine(_db(spark, sf_dir, "part")).run(Builder("part").where(p).project("p_partkey").build())


@_register("predicate_json", "SELECT s_suppkey FROM supplier WHERE (s_acctbal > 100 AND s_nationkey <> 3) OR s_nationkey IN (1, 2)")
def predicate_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.node((P.field("s_acctbal").gt(100) & P.field("s_nationkey").ne(3)) | P.field("s_nationkey").isin(1, 2))
    return Engine(_db(spark, sf_dir, "supplier")).run(Builder("supplier").where(P.from_json(P.to_json(p))).project("s_suppkey").build())


@_register("predicate_array_equality", "SELECT l_orderkey FROM (SELECT l_orderkey, list_sort(list(l_linenumber)) AS xs FROM lineitem GROUP BY 1) WHERE xs = [1, 2] OR xs = [3]")
def predicate_array_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database(spark)
    db.add("carts", _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("xs")), "l_orderkey")
    return Engine(db).run("from carts where xs = [1, 2] or xs = [3] and xs != [] project l_orderkey")


@_register("filter_operators", "SELECT doc_id FROM documents WHERE lang IS NOT NULL AND starts_with(source, 'src1') AND contains(text, 'the') OR doc_id IN (1, 2, 3)")
def filter_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct("doc_id", "text", "lang", "source")).alias("json"))  # null fields are left out
    db = Database(spark)
    side = db.add_json("d", rows.select(F.col("doc_id").alias("_key"), "json"))
    f = D.from_mongo({"$or": [{"lang": {"$exists": True}, "source": {"$prefix": "src1"}, "text": {"$contains": "the"}}, {"doc_id": {"$in": [1, 2, 3]}}]})
    return D.find(side, f).select(F.col("_key").alias("doc_id"))


@_register("filter_bool_order", "SELECT event_id FROM events WHERE value > 50")
def filter_bool_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database(spark)
    side = db.add("e", _read(spark, sf_dir, "events").select("event_id", (F.col("value") > 50).alias("hot")), "event_id")
    return D.find(side, D.from_mongo({"hot": {"$gt": False}})).select("event_id")


@_register("filter_as_algebra", "SELECT n_nationkey FROM nation WHERE (n_regionkey = 1 OR n_regionkey = 3) AND n_nationkey <> 9")
def filter_as_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = D.from_mongo({"n_regionkey": {"$in": [1, 3]}, "n_nationkey": {"$ne": 9}})
    return algebra.filter_rows(_read(spark, sf_dir, "nation"), algebra.filter_to_text(f.node)).select("n_nationkey")


@_register("filter_missing_differs", "SELECT doc_id FROM documents WHERE lang IS DISTINCT FROM 'en'")
def filter_missing_differs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter's 'not equal' holds where the field is missing; as a total predicate it still does."""
    rows = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("_key"), F.to_json(F.struct("lang")).alias("json"))
    db = Database(spark)
    db.add_json("d", rows)
    where = D.from_mongo({"lang": {"$ne": "en"}}).to_predicate()
    return Engine(db).run(Builder("d").where(where).project("_key").build()).select(F.col("_key").alias("doc_id"))


@_register("dialect_registry", "SELECT p_partkey, p_size FROM part WHERE p_size = 5 OR (p_brand = 'Brand#21' AND p_size < 9)")
def dialect_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = D.Dialects()
    d.register("equals", lambda s: D.Filter(P.Compare("eq", P.Path(s.split("=")[0]), P.Lit(int(s.split("=")[1])))))
    side = _db(spark, sf_dir, "part")["part"]
    other = d.compile("sda", '_<p_brand> = "Brand#21" and _<p_size> < 9')
    return D.find(side, D.Filter(P.Or((d.compile("equals", "p_size=5").node, other.node)))).select("p_partkey", "p_size")


@_register("find_plan_json", "SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 30")
def find_plan_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = D.FindPlan.from_json(D.FindPlan(D.from_mongo({"c_mktsegment": "BUILDING"}).node, (("c_acctbal", True),), 30).to_json())
    return D.find(_db(spark, sf_dir, "customer")["customer"], plan).select("c_custkey", "c_acctbal")


@_register("explain_operators", "SELECT * FROM (VALUES (0, 'bind'), (1, 'scan'), (2, 'filter'), (3, 'order'), (4, 'limit'), (5, 'page'), (6, 'project')) t(pos, operator)")
def explain_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Engine(_db(spark, sf_dir, "orders")).explain("explain from orders where o_orderkey > 3 project o_orderkey order by o_totalprice limit 5")
    return spark.createDataFrame(list(enumerate(found["operators"])), "pos int, operator string")


# orders over values of several types


@_register("order_cross_type", "SELECT event_id AS _key FROM events ORDER BY CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END, CASE WHEN event_id % 4 = 1 THEN value > 50 END, CASE WHEN event_id % 4 = 2 THEN event_id % 1000 END, CASE WHEN event_id % 4 = 3 THEN event_type END, event_id LIMIT 9000")
def order_cross_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null before booleans before numbers before strings; the limit falls among the strings."""
    k = F.col("event_id") % 4
    value = F.when(k == 0, F.lit("null")).when(k == 1, (F.col("value") > 50).cast("string")).when(k == 2, (F.col("event_id") % 1000).cast("string")).otherwise(F.to_json(F.struct(F.col("event_type").alias("t"))).substr(F.lit(6), F.length("event_type") + 2))
    rows = _read(spark, sf_dir, "events").select(F.col("event_id").alias("_key"), F.concat(F.lit('{"v":'), value, F.lit("}")).alias("json"))
    db = Database(spark)
    db.add_json("mixed", rows)
    return Engine(db).run("from mixed project _key order by v nulls first limit 9000")


# attachments and joins

_text("enrich_by_store_key", ("orders", "customer"), "from orders enrich c using customer as k matching o_custkey = k._key expect exactly_one project { o_orderkey, name: c.c_name }", "SELECT o_orderkey, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey")
_text("enrich_other_spelling", ("orders", "customer"), "from orders enrich c from customer on orders.o_custkey = customer.c_custkey exactly_one project { o_orderkey, segment: c.c_mktsegment }", "SELECT o_orderkey, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey")


@_register("enrich_null_keys", "SELECT d.doc_id, n FROM documents d JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY 1) g ON d.lang IS NOT DISTINCT FROM g.lang")
def enrich_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null matches null."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "lang")
    db = Database(spark)
    db.add("documents", docs, "doc_id")
    db.add("langs", docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "lang")
    return Engine(db).run("from documents enrich g using langs matching lang = lang expect exactly_one project { doc_id, n: g.n }")


@_register("join_source_limits", "SELECT o_orderkey, c_name FROM (SELECT * FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 900) JOIN (SELECT * FROM customer WHERE c_nationkey < 20 ORDER BY c_custkey LIMIT 700) ON o_custkey = c_custkey ORDER BY o_orderkey LIMIT 60")
def join_source_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = MultiQuery(_db(spark, sf_dir, "orders", "customer")).source("orders", "o").where(P.field("o_orderstatus").eq("O")).source_limit(900)
    q = q.join("customer", "c", "o_custkey", "c_custkey").where(P.field("c_nationkey").lt(20)).source_limit(700).limit(60)
    return q.collect_df().select("o.o_orderkey", "c.c_name")


@_register("join_describe", "SELECT * FROM (VALUES ('o', 'orders', NULL), ('c', 'customer', 'o.o_custkey = c.c_custkey')) t(alias, collection, condition)")
def join_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = MultiQuery(_db(spark, sf_dir, "orders", "customer")).source("orders", "o").join("customer", "c", "o_custkey", "c_custkey").describe()
    return spark.createDataFrame([(s["alias"], s["collection"], s["on"] and " = ".join(s["on"])) for s in found["sources"]], "alias string, collection string, condition string")


@_register("join_map_algebra", "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name || ' of ' || r_name AS label FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_map_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = MultiQuery(_db(spark, sf_dir, "nation", "region")).source("nation", "n").join("region", "r", "n_regionkey", "r_regionkey")
    text = 'bindOpt(n<n_nationkey>?, k => bindOpt(n<n_name>?, a => mapOpt(r<r_name>?, b => Map{k: k, label: a ++ " of " ++ b})))'
    return q.map_algebra(text).select(F.from_json("value", "`$value` struct<k:long,label:string>").alias("x")).select("x.`$value`.*")


@_register("algebra_over_collections", "SELECT CAST(r_regionkey AS BIGINT) AS k, count(n_nationkey) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def algebra_over_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One program over two bound collections, which are small and come to the driver."""
    db = _db(spark, sf_dir, "region", "nation")
    rows = {n: [{k: v for k, v in r.asDict().items() if k != "_key"} for r in db[n].iterate()] for n in ("region", "nation")}
    found = algebra.evaluate("{ yield Map{k: r<r_regionkey>?, n: { yield n<n_name>? | n in nation | n<n_regionkey>? = r<r_regionkey>? }} | r in region }", **rows)
    return spark.createDataFrame([(x["k"]["$value"], len(x["n"])) for x in found], "k long, n long")


# what is refused, by its code

_REFUSED = {
    "block over a scalar": "from orders project { o_totalprice { x } }",
    "two fields of one name": "from orders project { o_orderkey, o_orderkey: o_custkey }",
    "within no array": "from orders within o_totalprice { where x = 1 }",
    "rank access": "from orders at rank 3",
    "document budget": "from orders budget { documents: 2 }",
    "result budget": "from nation budget { result_bytes: 3 }",
    "too many matches": "from customer enrich o using orders matching c_nationkey = o_custkey expect exactly_one",
    "attached over a field": "from orders enrich o_custkey using customer matching o_custkey = c_custkey expect many",
    "unknown collection": "from nowhere",
}


def _refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(_db(spark, sf_dir, "orders", "customer", "nation"))
    holed = Database(spark)
    holed.add("t", _read(spark, sf_dir, "nation"), "n_nationkey", [Hole("part-3", "missing")])
    calls: dict[str, Callable[[], object]] = {what: (lambda text=text: engine.run(text)) for what, text in _REFUSED.items()}
    calls["a part is missing"] = lambda: Engine(holed).run("from t")
    calls["missing parts in a scan"] = lambda: holed["t"].scan()
    calls["sql+ with groups"] = lambda: D.from_sql_plus("SELECT a FROM x GROUP BY a")
    calls["sql with an order"] = lambda: D.from_sql("SELECT * FROM x ORDER BY a")
    calls["a refused dialect"] = lambda: D.Dialects().compile("graphql", "")
    calls["a strict pipeline"] = lambda: M.validate([{"$group": {"_id": None}}], "strict")
    calls["a pipeline that writes"] = lambda: M.validate([{"$facet": {"a": [{"$out": "x"}]}}])
    calls["a secure field"] = lambda: M.validate([{"$match": {"_secret": 1}}], secure=("_secret",))
    calls["a changed plan"] = lambda: engine.page("from orders where o_orderkey > 0", after=engine.page("from orders", size=2).continuation)
    return _codes(spark, calls)


QUERIES["refusals"] = _refusals
ORACLES["refusals"] = _values(
    ("block over a scalar", "project_type"), ("two fields of one name", "duplicate_output"), ("within no array", "within_carrier"), ("rank access", "not_supported"), ("document budget", "budget_exceeded"),
    ("result budget", "budget_exceeded"), ("too many matches", "cardinality"), ("attached over a field", "field_exists"), ("unknown collection", "unknown_collection"), ("a part is missing", "incomplete"),
    ("missing parts in a scan", "incomplete"), ("sql+ with groups", "refused"), ("sql with an order", "refused"), ("a refused dialect", "dialect_refused"), ("a strict pipeline", "stage_refused"),
    ("a pipeline that writes", "stage_refused"), ("a secure field", "secure_field"), ("a changed plan", "bad_continuation"),
)

# the store: customers are put, those of nation 3 put again, those in debt deleted


def _body() -> Column:
    return F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))).alias("body")


def _nation() -> Column:
    return F.get_json_object("body", "$.nation").cast("int").alias("nation")


def _store(spark: SparkSession, sf_dir: str) -> S.Store:
    rows = _read(spark, sf_dir, "customer")
    store = S.Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    key = F.col("c_custkey").cast("string").alias("key")
    store.merge("customers", rows.select(key, _body()), "upsert", "first")
    store.merge("customers", rows.select(key, _body()), "upsert", "first")  # a retry, which writes nothing
    store.merge("customers", rows.where("c_nationkey = 3").select(key, F.to_json(F.struct(F.col("c_custkey").alias("id"), F.lit(-1).alias("nation"))).alias("body")), "replace")
    store.merge("customers", rows.select(key, F.lit("{}").alias("body")), "create")  # all there
    gone = rows.where("c_acctbal < 0").select(F.lit("customers").alias("collection"), key, F.lit("delete").alias("kind"), F.lit("json").alias("tag"), F.lit(None).cast("string").alias("body"), F.lit(None).cast("binary").alias("bytes"))
    store.append(gone)
    return store


_LIVE = "SELECT CAST(c_custkey AS VARCHAR) AS key, CASE WHEN c_nationkey = 3 THEN -1 ELSE c_nationkey END AS nation FROM customer WHERE NOT c_acctbal < 0"


@_register("store_writes", _LIVE)
def store_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.live(_store(spark, sf_dir).events()).select("key", _nation())


@_register("store_compacted", _LIVE)
def store_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir)
    return S.live(store.compact(store.path + "-compact").events()).select("key", _nation())


@_register("store_versions", "SELECT CAST(c_custkey AS VARCHAR) AS key, CAST(1 + (c_nationkey = 3)::INT + (c_acctbal < 0)::INT AS BIGINT) AS versions, c_acctbal < 0 AS deleted FROM customer")
def store_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.histories(_store(spark, sf_dir).events())
    return found.groupBy("key").agg(F.max("version").cast("long").alias("versions"), (F.max_by("kind", "version") == "delete").alias("deleted"))


@_register("store_partitions", f"SELECT count(*) AS n, count(*) FILTER (WHERE nation = -1) AS changed, CAST(0 AS BIGINT) AS holes FROM ({_LIVE})")
def store_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scans of two halves of the virtual partitions give the whole."""
    store = _store(spark, sf_dir)
    (a, x), (b, y) = (store.scan_partitions("customers", range(k, S.PARTITIONS, 2)) for k in (0, 1))
    return a.unionByName(b).agg(F.count(F.lit(1)).alias("n"), F.count_if(_nation() == -1).alias("changed"), F.lit(len(x) + len(y)).cast("long").alias("holes"))


@_register("store_partition_pages", "SELECT CAST(c_custkey AS VARCHAR) AS key FROM customer WHERE NOT c_acctbal < 0 AND starts_with(CAST(c_custkey AS VARCHAR), '1')")
def store_partition_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of one prefix in pages of four hundred, their bounds found by one sort."""
    return _store(spark, sf_dir).scan_pages("customers", prefix="1", documents=400).rows.select("key")


@_register("store_index", "SELECT CAST(c_custkey AS VARCHAR) AS key FROM customer WHERE c_nationkey = 7 AND NOT c_acctbal < 0")
def store_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir)
    store.create_index("customers", "by_nation", ["nation"])
    return store.probe("customers", {"nation": 7}).select("key")


@_register("store_tiers", "SELECT CAST(c_custkey AS VARCHAR) AS key, holes FROM customer, (SELECT 'cold' AS holes) WHERE NOT c_acctbal < 0")
def store_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir)
    events, holes = S.tiers(spark, {"hot": f"{store.path}/events", "cold": f"{store.path}/offline"})
    return S.live(events).select("key", F.lit(",".join(h.source for h in holes)).alias("holes"))


@_register("store_partial", "SELECT CAST(event_id AS VARCHAR) AS key, event_id % 7 <> 0 AS decodes FROM events")
def store_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text doesn't parse are told apart, all of them."""
    e = _read(spark, sf_dir, "events")
    store = S.Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    store.merge("events", e.select(F.col("event_id").cast("string").alias("key"), F.when(F.col("event_id") % 7 == 0, F.lit("{oops")).otherwise(F.col("props")).alias("body")))
    healthy, _, bad = store.partial("events")
    return healthy.select(F.col("_key").alias("key"), F.lit(True).alias("decodes")).unionAll(bad.select("_key", F.lit(False)))


@_register("store_bytes", "SELECT CAST(n_nationkey AS VARCHAR) AS key, CAST(length(n_name) AS INTEGER) AS size FROM nation")
def store_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _read(spark, sf_dir, "nation")
    store = S.Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    store.append(n.select(F.lit("names").alias("collection"), F.col("n_nationkey").cast("string").alias("key"), F.lit("put").alias("kind"), F.lit("bytes").alias("tag"), F.lit(None).cast("string").alias("body"), F.encode("n_name", "UTF-8").alias("bytes")))
    return S.live(store.events()).where("tag = 'bytes'").select("key", F.octet_length("bytes").alias("size"))


@_register("store_open", "SELECT count(*) AS n, CAST(max(c_nationkey) AS DOUBLE) AS hi FROM customer WHERE NOT c_acctbal < 0 AND c_nationkey > 3")
def store_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query over the live documents of a store."""
    db = Database(spark)
    _store(spark, sf_dir).open(db, "customers")
    return Engine(db).run("from customers where nation > 3 project count() as n, max(nation) as hi")


@_register("read_with_deadline", "SELECT count(*) AS n FROM orders")
def read_with_deadline(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _db(spark, sf_dir, "orders")
    return V.with_deadline(db, 600, lambda: Engine(db).run("from orders project count() as n"))


@_register("async_runs", "SELECT 'nation' AS name, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region UNION ALL SELECT 'supplier', count(*) FROM supplier")
def async_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = V.AsyncEngine(2, 8)
    runs = {n: pool.submit(_read(spark, sf_dir, n).count) for n in ("nation", "region", "supplier")}
    rows = [(n, f.result()) for n, f in runs.items()]
    pool.close()
    return spark.createDataFrame(rows, "name string, n long")


@_register("service_calls", "SELECT CAST(r_regionkey AS VARCHAR) AS key, r_name AS name FROM region WHERE r_regionkey <> 2")
def service_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Put, delete and scan through the dispatcher."""
    service = V.Service(S.Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"))
    for r in _read(spark, sf_dir, "region").collect():  # five rows
        service.call({"op": "put", "collection": "regions", "key": str(r.r_regionkey), "value": {"name": r.r_name}})
    service.call({"op": "delete", "collection": "regions", "key": "2"})
    found = service.call({"op": "query", "text": "from regions where present(name) project _key, name", "size": 50})["ok"]["rows"]
    return spark.createDataFrame([(r["_key"], r["name"]) for r in found], "key string, name string")


# examination: every event is a unit, errors are damaged


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    bad, none = F.col("event_type") == "error", F.lit(None).cast("string")
    reason = F.when(F.col("value") > 50, "bad_digest").otherwise("truncated")
    hole = F.struct(reason.alias("reason"), F.col("event_id").alias("offset"), F.lit(8).cast("long").alias("length"))
    return e.select(
        F.lit("event").alias("unit_kind"), F.when(bad, "damaged").otherwise("verified_complete").alias("status"), F.concat(F.lit("s"), F.col("user_id") % 10).alias("segment_id"), F.col("user_id").cast("string").alias("item_id"),
        F.col("event_id").cast("string").alias("event_id"), F.col("event_type").alias("event_kind"), F.struct(F.lit("log").alias("source"), F.col("event_id").alias("offset"), F.lit(8).cast("long").alias("encoded_length")).alias("physical"),
        F.struct(F.lit("ok").alias("framing"), F.lit("ok").alias("structural"), F.when(bad, "bad").otherwise("ok").alias("content")).alias("integrity"),
        F.struct(F.when(bad, "missing").otherwise("complete").alias("availability"), F.lit(8).cast("long").alias("logical_length"), F.when(~bad, F.col("props")).otherwise(none).alias("value")).alias("payload"),
        F.when(bad, F.array(hole)).otherwise(F.array().cast("array<struct<reason:string,offset:bigint,length:bigint>>")).alias("holes"), F.array().cast("array<string>").alias("uncertainty"),
    )


@_register("examine_status", "SELECT CAST(event_id AS VARCHAR) AS event_id, 'verified' AS kind FROM events WHERE event_type <> 'error' UNION ALL SELECT CAST(event_id AS VARCHAR), 'hole' FROM events WHERE event_type = 'error'")
def examine_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = _units(spark, sf_dir)
    return X.filter_verified(units).select("event_id", F.lit("verified").alias("kind")).unionAll(X.filter_holes(X.filter_status(units, "damaged")).select("event_id", F.lit("hole")))


@_register("examine_hole_tags", "SELECT CAST(event_id AS BIGINT) AS \"offset\", CASE WHEN value > 50 THEN 'corrupt_content' ELSE 'missing_tail' END AS tag FROM events WHERE event_type = 'error'")
def examine_hole_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.hole_tags(_units(spark, sf_dir)).select("offset", "tag")


@_register("examine_map", "SELECT '\"' || user_id || ':' || event_type || '\"' AS value FROM events")
def examine_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.map_units(_units(spark, sf_dir), 'item_id ++ ":" ++ event_kind')


@_register("examine_filter", "SELECT CAST(event_id AS VARCHAR) AS event_id FROM events WHERE event_type = 'click' AND user_id % 10 = 3")
def examine_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.filter_units(_units(spark, sf_dir), 'event_kind = "click" and segment_id = "s3"').select("event_id")


@_register("examine_page", "SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(row_number() OVER (ORDER BY user_id % 10, event_id) - 1 AS INTEGER) AS pos FROM events QUALIFY pos < 200")
def examine_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of units in their total order."""
    found = X.eval_page(_units(spark, sf_dir), "{ yield u<event_id>? | u in units }", 200)
    return spark.createDataFrame([(x["$value"], k) for k, x in enumerate(found)], "event_id string, pos int")


# the document layer: orders with owners, F orders deleted


def _documents(spark: SparkSession, sf_dir: str, **policy: object) -> M.Documents:
    o = _read(spark, sf_dir, "orders")
    rows = o.select(
        F.concat(F.lit("O"), "o_orderkey").alias("_uuid"), F.col("o_orderpriority").alias("_owner"), F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False).alias("_deleted"),
        F.col("o_orderdate").alias("_updated"), F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("customer"), F.lit("x").alias("_secret_note"),
    )
    return M.Documents({"orders": rows, "nation": _read(spark, sf_dir, "nation"), "region": _read(spark, sf_dir, "region")}, **policy)


_ID = "'O' || o_orderkey AS _uuid"


@_register("documents_find", f"SELECT {_ID}, o_totalprice AS price FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice > 50000 ORDER BY o_totalprice DESC LIMIT 40 OFFSET 10")
def documents_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).find("orders", {"price": {"$gt": 50000}}, ["_uuid", "price"], {"price": -1}, 10, 40)


@_register("documents_counts", "SELECT count(*) FILTER (WHERE o_orderstatus <> 'F') AS live, count(*) FILTER (WHERE o_orderstatus = 'F') AS deleted, count(*) FILTER (WHERE o_orderkey = 2 AND o_orderstatus <> 'F') AS one FROM orders")
def documents_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return spark.createDataFrame([(docs.count("orders"), docs.count("orders", {"_deleted": True}), docs.get("orders", "o2").count())], "live long, deleted long, one long")


@_register("documents_owner", f"SELECT {_ID} FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority = (SELECT min(o_orderpriority) FROM orders)")
def documents_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    owner = _read(spark, sf_dir, "orders").agg(F.min("o_orderpriority")).first()[0]
    found = _documents(spark, sf_dir, owner=owner, strict_owner=False, secure=("_secret",)).find("orders", {"_owner": f" {owner} "})
    return found.select(*[c for c in found.columns if c in ("_uuid", "_secret_note")])


@_register("documents_ids", f"SELECT {_ID} FROM orders WHERE o_orderkey IN (1, 2, 3, 4, 5, 6, 7) AND o_orderstatus <> 'F'")
def documents_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids in criteria are normalised, at any depth."""
    return _documents(spark, sf_dir).find("orders", {"$or": [{"_uuid": {"$in": ["o1", "o2", "o3", "o4"]}}, {"_uuid": {"$in": ["O5", "o6", "o7"]}}]}).select("_uuid")


@_register("documents_policy_inside", "SELECT count(*) AS k FROM (SELECT n_name FROM nation UNION ALL SELECT 'O' FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice > 100000)")
def documents_policy_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleted documents stay out of a source that a pipeline brings in."""
    return _documents(spark, sf_dir).aggregate("nation", [{"$unionWith": {"coll": "orders", "pipeline": [{"$match": {"price": {"$gt": 100000}}}]}}, {"$count": "k"}])


@_register("documents_facet", "SELECT (SELECT count(*) FROM nation WHERE n_regionkey = 1) AS a, (SELECT count(DISTINCT n_regionkey) FROM nation) AS b")
def documents_facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _documents(spark, sf_dir).aggregate("nation", [{"$facet": {"a": [{"$match": {"n_regionkey": 1}}], "b": [{"$group": {"_id": "$n_regionkey", "n": {"$sum": 1}}}]}}])
    return found.select(F.size("a").cast("long").alias("a"), F.size("b").cast("long").alias("b"))


@_register("documents_graph", "WITH RECURSIVE up(k, node) AS (SELECT CAST(o_orderkey AS BIGINT), CAST(o_orderkey // 2 AS BIGINT) FROM orders WHERE o_orderkey // 2 > 0 UNION SELECT k, node // 2 FROM up WHERE node // 2 > 0) SELECT n.k, coalesce(c, 0) AS reached FROM (SELECT CAST(o_orderkey AS BIGINT) AS k FROM orders) n LEFT JOIN (SELECT k, count(*) AS c FROM up GROUP BY 1) u ON n.k = u.k")
def documents_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of orders, each under the one of half its number, followed to the root."""
    tree = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.expr("nullif(o_orderkey div 2, 0)").alias("parent"))
    found = M.Documents({"tree": tree}).aggregate("tree", [{"$graphLookup": {"from": "tree", "startWith": "$parent", "connectFromField": "parent", "connectToField": "k", "as": "up"}}, {"$project": {"k": 1, "reached": {"$size": "$up"}}}])
    return found.select("k", F.col("reached").cast("long").alias("reached"))


@_register("documents_update", f"SELECT {_ID}, CASE WHEN o_orderstatus <> 'F' AND o_custkey < 100 THEN -1.0 ELSE o_totalprice END AS price FROM orders")
def documents_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).update_all("orders", {"customer": {"$lt": 100}}, {"price": -1.0}).tables["orders"].select("_uuid", "price")


@_register("documents_restore_purge", f"SELECT {_ID} FROM orders WHERE o_orderstatus <> 'F' OR o_custkey < 50 OR o_orderdate > TIMESTAMP '1995-01-01'")
def documents_restore_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).restore("orders", {"customer": {"$lt": 50}})
    return docs.purge_deleted_older_than("orders", dt.datetime(1995, 1, 1)).tables["orders"].select("_uuid")


@_register("documents_versions", "SELECT CAST(v AS BIGINT) AS version, CASE v WHEN 1 THEN o_totalprice ELSE 1.0 END AS price, o_totalprice AS now FROM orders, (VALUES (1), (2)) t(v) WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders WHERE o_orderstatus = 'O')")
def documents_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versioned updates and a return to the first version."""
    docs = _documents(spark, sf_dir)
    key = f"O{_read(spark, sf_dir, 'orders').where("o_orderstatus = 'O'").agg(F.min('o_orderkey')).first()[0]}"
    docs = docs.update_versioned("orders", key, {"price": 1.0}).update_versioned("orders", key, {"price": 2.0}).revert_to_version("orders", key, 1)
    return docs.list_versions("orders", key).select(F.col("_v").alias("version"), "price").crossJoin(docs.get("orders", key).select(F.col("price").alias("now")))  # one row


@_register("documents_schema", "SELECT count(*) AS fits, CAST(0 AS BIGINT) AS others FROM events")
def documents_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = M.apply_schema(_read(spark, sf_dir, "events").select("props"), "props", "k int", ["k"])
    return good.agg(F.count(F.lit(1)).alias("fits")).crossJoin(bad.agg(F.count(F.lit(1)).alias("others")))  # one row each


@_register("parsed_and_built", "SELECT * FROM (VALUES (true)) t(same)")
def parsed_and_built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan from text and one from the builder have one hash."""
    built = Builder("orders").where(P.field("o_orderstatus").eq("F")).project("o_orderkey").order_by("o_totalprice", True).limit(3).build()
    return spark.createDataFrame([(parse('from orders where o_orderstatus = "F" project o_orderkey order by o_totalprice desc limit 3').hash() == built.hash(),)], "same boolean")

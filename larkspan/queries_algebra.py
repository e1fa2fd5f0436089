"""Registered queries of the value algebra, with equivalent SQL.

Each program runs once per row over the columns bound by name, and its result,
a JSON object, is read back into typed columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.functions import algebra

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _table(name: str, *columns: str) -> Query:
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations, each with the suppliers of all nations of equal remainder by five."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.struct("s_suppkey", "s_nationkey").alias("s"), F.pmod("s_nationkey", F.lit(5)).alias("g"))
    groups = s.groupBy("g").agg(F.sort_array(F.collect_list("s")).alias("ss"))
    return spark.read.parquet(f"{sf_dir}/nation.parquet").join(groups, F.pmod("n_nationkey", F.lit(5)) == F.col("g")).select("n_nationkey", "ss")


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions with their nations, in order of keys."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("ns"))
    return spark.read.parquet(f"{sf_dir}/region.parquet").join(n, F.col("r_regionkey") == F.col("n_regionkey"), "left").select("r_regionkey", "r_name", F.coalesce("ns", F.array().cast(n.schema["ns"].dataType)).alias("ns"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the line numbers of their items, in order."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("xs"))
    return items.select("l_orderkey", "xs")


def _register(name: str, rows: Query, program: str, schema: str, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: algebra.map_rows(rows(spark, sf_dir), program).select(F.from_json("value", schema).alias("x")).select("x.*")
    ORACLES[name] = sql


_PART = _table("part", "p_partkey", "p_size", "p_brand", "p_type")
_LINES = "(SELECT l_orderkey, list_sort(list(l_linenumber)) AS xs FROM lineitem GROUP BY 1)"

# scalars

_register("algebra_arithmetic", _PART, "Map{k: p_partkey, a: p_size * 3 - 1, b: -p_size + 2, q: p_size / 4, t: p_size / 3 * 3}", "k long, a long, b long, q double, t long", "SELECT p_partkey AS k, CAST(p_size * 3 - 1 AS BIGINT) AS a, CAST(2 - p_size AS BIGINT) AS b, p_size / 4.0::DOUBLE AS q, CAST(p_size AS BIGINT) AS t FROM part")
_register("algebra_concat", _table("nation", "n_nationkey", "n_name"), 'Map{k: n_nationkey, s: n_name ++ "/" ++ n_name, xs: Seq[n_nationkey] ++ Seq[1, 2]}', "k long, s string, xs array<long>", "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name || '/' || n_name AS s, [CAST(n_nationkey AS BIGINT), 1, 2] AS xs FROM nation")
_register("algebra_logic", _PART, 'Map{k: p_partkey, a: p_size > 10 and not (p_size >= 40), b: p_brand < "Brand#3" or p_size = 7, c: p_size != 3}', "k long, a boolean, b boolean, c boolean", "SELECT p_partkey AS k, p_size > 10 AND NOT p_size >= 40 AS a, p_brand < 'Brand#3' OR p_size = 7 AS b, p_size <> 3 AS c FROM part")
_register("algebra_symbols", _PART, ";; other spellings\nMap{k → p_partkey, a → p_size ∈ Set{1, 2, 3} ∧ ¬ (p_size = 2), b → p_size ≤ 9 ∨ p_size ≠ p_size}", "k long, a boolean, b boolean", "SELECT p_partkey AS k, p_size IN (1, 3) AS a, p_size <= 9 AS b FROM part")
_register("algebra_type_of", _table("events", "event_id", "value", "event_type"), 'Map{k: event_id, a: typeOf(value), b: typeOf(event_type), c: typeOf(value > 3), d: typeOf(null), e: typeOf(Set{value}), f: typeOf(value / 0), g: typeOf(Some(1))}', "k long, a string, b string, c string, d string, e string, f string, g string", "SELECT event_id AS k, 'num' AS a, 'str' AS b, 'bool' AS c, 'null' AS d, 'set' AS e, 'fail' AS f, 'some' AS g FROM events")
_register("algebra_text_tests", _PART, 'Map{k: p_partkey, a: startsWith(p_type, "S"), b: strContains(p_brand, "#2")}', "k long, a boolean, b boolean", "SELECT p_partkey AS k, starts_with(p_type, 'S') AS a, contains(p_brand, '#2') AS b FROM part")
_register("algebra_failures", _PART, "Map{k: p_partkey, a: 1 / (p_size - 7), b: p_size + p_brand, c: nothing}", "k long, a struct<`$code`:string>, b struct<`$code`:string>, c struct<`$code`:string>", "")
QUERIES["algebra_failures"] = lambda spark, sf_dir, run=QUERIES["algebra_failures"]: run(spark, sf_dir).select("k", *[F.col(f"{c}.`$code`").alias(c) for c in "abc"]).select("k", F.col("a").isNotNull().alias("failed"), F.coalesce("a", F.lit("none")).alias("a"), "b", "c")
ORACLES["algebra_failures"] = "SELECT p_partkey AS k, p_size = 7 AS failed, CASE WHEN p_size = 7 THEN 't_sda_div_by_zero' ELSE 'none' END AS a, 't_sda_wrong_shape' AS b, 't_sda_unbound_name' AS c FROM part"

# options, results, maps

_register("algebra_get_path", lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.struct(F.struct("n_name", "n_regionkey").alias("n")).alias("d")), 'Map{k: n_nationkey, a: getPath(d, Seq["n", "n_name"]), b: getPath(d, Seq["n", "nope"])}', "k long, a struct<`$type`:string,`$value`:string>, b struct<`$type`:string>", "")
QUERIES["algebra_get_path"] = lambda spark, sf_dir, run=QUERIES["algebra_get_path"]: run(spark, sf_dir).select("k", F.col("a.`$value`").alias("name"), F.col("a.`$type`").alias("a"), F.col("b.`$type`").alias("b"))
ORACLES["algebra_get_path"] = "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name, 'some' AS a, 'none' AS b FROM nation"
_register("algebra_options", _PART, 'let m = Map{x: p_size}; Map{k: p_partkey, a: bindOpt(mapOpt(m<x>?, v => v + 1), v => Some(v * 2)) = Some(2 * p_size + 2), b: orElseOpt(m<y>?, p_size), c: orElseOpt(bindOpt(m<x>?, v => None), -1), d: orElseOpt(m<x>?, 0) = Some(p_size)}', "k long, a boolean, b long, c long, d boolean", "SELECT p_partkey AS k, true AS a, CAST(p_size AS BIGINT) AS b, CAST(-1 AS BIGINT) AS c, true AS d FROM part")
_register("algebra_results", _PART, 'let m = Map{x: p_size}; Map{k: p_partkey, a: mapRes(m<x>!, v => v + 1) = Ok(p_size + 1), b: orElseRes(m<y>!, p_size), c: typeOf(bindRes(m<x>!, v => Fail("odd", "no"))), d: typeOf(mapRes(m<y>!, v => v))}', "k long, a boolean, b long, c string, d string", "SELECT p_partkey AS k, true AS a, CAST(p_size AS BIGINT) AS b, 'fail' AS c, 'fail' AS d FROM part")
_register("algebra_selectors", _PART, "let p = Prod{s: p_size}; let b = Bind(p_partkey, p_size); Map{k: b<key>, a: p<s>, v: b<val>, m: typeOf(Map{s: 1}<s>?), n: typeOf(Map{s: 1}<t>!)}", "k long, a long, v long, m string, n string", "SELECT p_partkey AS k, CAST(p_size AS BIGINT) AS a, CAST(p_size AS BIGINT) AS v, 'some' AS m, 'fail' AS n FROM part")
_register("algebra_keys_values", _PART, "let m = Map{b: p_size, a: p_partkey}; Map{k: p_partkey, ks: { yield x | x in keys(m) } = Set{\"a\", \"b\"}, vs: values(m)}", "k long, ks boolean, vs array<long>", "SELECT p_partkey AS k, true AS ks, [p_partkey, CAST(p_size AS BIGINT)] AS vs FROM part")
_register("algebra_merge", _PART, 'let a = Map{x: p_size, y: 1}; let b = Map{x: 0, z: 2}; Map{k: p_partkey, l: orElseOpt(mergeLeft(a, b)<x>?, -1) = Some(p_size), r: orElseOpt(mergeRight(a, b)<x>?, -1) = Some(0), f: typeOf(merge(a, b)), p: typeOf(a + Map{z: 3})}', "k long, l boolean, r boolean, f string, p string", "SELECT p_partkey AS k, true AS l, true AS r, 'fail' AS f, 'map' AS p FROM part")
_register("algebra_multimap", _PART, 'let m = asBagKV(Bag{Bind("size", p_size), Bind(p_brand, 1), Bind("Brand#11", 2)}); Map{k: p_partkey, u: typeOf(normalizeUnique(m)), s: typeOf(m<size>!)}', "k long, u string, s string", "SELECT p_partkey AS k, CASE WHEN p_brand = 'Brand#11' THEN 'fail' ELSE 'ok' END AS u, 'ok' AS s FROM part")
_register("algebra_lambda_pipe", _PART, "let twice = x => x * 2; Map{k: p_partkey, a: twice(p_size) |> _ + 1 |> twice(_)}", "k long, a long", "SELECT p_partkey AS k, CAST((p_size * 2 + 1) * 2 AS BIGINT) AS a FROM part")

# carriers

_register("algebra_literals", _orders, "Map{k: l_orderkey, s: typeOf(Set{1, 1}), n: { yield x * 2 | x in Seq[3, 4] }, e: Set{2, 1, 2} = Set{1, 2}, f: Bag{1, 2} = Bag{2, 1}, g: Bag{1} = Bag{1, 1}, b: typeOf(Bytes(\"00ff\"))}", "k long, s string, n array<long>, e boolean, f boolean, g boolean, b string", "SELECT DISTINCT l_orderkey AS k, 'set' AS s, [6::BIGINT, 8] AS n, true AS e, true AS f, false AS g, 'bytes' AS b FROM lineitem")
_register("algebra_membership", _orders, "Map{k: l_orderkey, a: 1 in xs, b: 7 in xs or 6 in xs}", "k long, a boolean, b boolean", f"SELECT l_orderkey AS k, list_contains(xs, 1) AS a, list_contains(xs, 7) OR list_contains(xs, 6) AS b FROM {_LINES}")
_register("algebra_multiplicity", _orders, "Map{k: l_orderkey, a: count(1, asBag(xs)), b: count(9, matchBag(xs))}", "k long, a long, b long", "SELECT l_orderkey AS k, count(*) FILTER (WHERE l_linenumber = 1) AS a, CAST(0 AS BIGINT) AS b FROM lineitem GROUP BY 1")
_register("algebra_first_last", _orders, "Map{k: l_orderkey, a: mapOpt(first(xs), v => v) = Some(1), b: orElseOpt(first({ x in xs | x > 3 }), 0) = Some(4), c: typeOf(last({ x in xs | x > 90 })), d: typeOf(first(asBag(xs)))}", "k long, a boolean, b boolean, c string, d string", f"SELECT l_orderkey AS k, xs[1] = 1 AS a, coalesce(list_filter(xs, lambda x: x > 3)[1] = 4, false) AS b, 'none' AS c, 'fail' AS d FROM {_LINES}")
_register("algebra_comprehension_rows", _orders, "Map{k: l_orderkey, ys: { yield x * x | x in xs | x > 2 }}", "k long, ys array<long>", f"SELECT l_orderkey AS k, [CAST(x * x AS BIGINT) FOR x IN xs IF x > 2] AS ys FROM {_LINES}")

# joins of the algebra

_SUPPLIED = "SELECT CAST(n_nationkey AS BIGINT) AS k, {} FROM nation LEFT JOIN (SELECT s_nationkey, list_sort(list(s_suppkey)) AS m FROM supplier GROUP BY 1) ON n_nationkey = s_nationkey"
_ITEMS = "struct<`$type`:string,`$items`:array<struct<s_suppkey:long>>>"
for _name, _program in (("algebra_match", "Match(Some(n_nationkey), ss, l, r<s_nationkey>?)"), ("algebra_keyed", "asBag(ss[r<s_nationkey>! = Ok(n_nationkey)])"), ("algebra_theta", "asBag({ s in ss | s<s_nationkey>? = Some(n_nationkey) })")):
    _register(_name, _nations, f"Map{{k: n_nationkey, m: {_program}}}", f"k long, m {_ITEMS}", _SUPPLIED.format("coalesce(m, []) AS m"))
    QUERIES[_name] = lambda spark, sf_dir, run=QUERIES[_name]: run(spark, sf_dir).select("k", F.sort_array(F.transform("m.`$items`", lambda x: x["s_suppkey"])).alias("m"))
_COUNTED = "SELECT CAST(n_nationkey AS BIGINT) AS k, {} FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS c FROM supplier GROUP BY 1) ON n_nationkey = s_nationkey"
_register("algebra_one_optional", _nations, "let m = Match(Some(n_nationkey), ss, l, r<s_nationkey>?); Map{k: n_nationkey, a: typeOf(one?(m)), b: typeOf(oneOpt(m))}", "k long, a string, b string", _COUNTED.format("CASE WHEN c IS NULL THEN 'none' WHEN c = 1 THEN 'some' ELSE 'fail' END AS a, CASE WHEN c IS NULL THEN 'none' WHEN c = 1 THEN 'some' ELSE 'fail' END AS b"))
_register("algebra_one_required", _nations, "let m = Match(Some(n_nationkey), ss, l, r<s_nationkey>?); Map{k: n_nationkey, a: typeOf(one!(m)), b: typeOf(only(m)), c: typeOf(oneReq(m))}", "k long, a string, b string, c string", _COUNTED.format(", ".join(f"CASE WHEN c = 1 THEN 'map' ELSE 'fail' END AS {x}" for x in "abc")))
QUERIES["algebra_enrich"] = lambda spark, sf_dir: algebra.map_rows(_regions(spark, sf_dir), 'ns |> enrich { region: r_regionkey, label: r_name ++ "!" }').select(F.inline(F.from_json("value", "array<struct<n_nationkey:long,n_name:string,region:long,label:string>>")))
ORACLES["algebra_enrich"] = "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(r_regionkey AS BIGINT) AS region, r_name || '!' AS label FROM nation JOIN region ON n_regionkey = r_regionkey"


def algebra_pretty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predicate's canonical text selects what the predicate does."""
    text = '(_<p_size> + 2 < 20 and not startsWith(_<p_brand>, "Brand#1")) or _<p_size> = 50'
    again = algebra.pretty(algebra.parse_expr(algebra.pretty(algebra.parse_expr(text))))
    return algebra.filter_rows(_PART(spark, sf_dir), again).select("p_partkey")


QUERIES["algebra_pretty"] = algebra_pretty
ORACLES["algebra_pretty"] = "SELECT p_partkey FROM part WHERE (p_size + 2 < 20 AND NOT starts_with(p_brand, 'Brand#1')) OR p_size = 50"

"""The value algebra: parser, evaluator, columns."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspan.errors import StaticError
from larkspan.functions import algebra as A


def code(v):
    return v["$code"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("1 + 2 * 3", 7),
        ("(1 + 2) * 3 - -1", 10),
        ("1 / 4", 0.25),
        ("1 / 3", {"$type": "num", "$value": "1/3"}),
        ("1 / 3 * 3 = 1", True),
        ('"a" ++ "b"', "ab"),
        ("Seq[1] ++ Seq[2]", [1, 2]),
        ("Set{2, 1, 2, 1.0}", {"$type": "set", "$items": [1, 2]}),
        ("Set{1,2} union Set{3}", {"$type": "set", "$items": [1, 2, 3]}),
        ("Set{1,2} ∩ Set{2}", {"$type": "set", "$items": [2]}),
        ("Set{1,2} diff Set{2}", {"$type": "set", "$items": [1]}),
        ("Bag{1,1,2} ⊖ Bag{1}", {"$type": "bag", "$items": [1, 2]}),
        ("Bag{1} ⊎ Bag{1}", {"$type": "bag", "$items": [1, 1]}),
        ("count(1, Bag{1,1,2})", 2),
        ("2 ∈ Seq[1,2] ∧ ¬ (3 in Set{1})", True),
        ('"a" in Map{"a" -> 1}', True),
        ('Map{"a" -> 1}<a>?', {"$type": "some", "$value": 1}),
        ('Map{"a" -> 1}<b>?', {"$type": "none"}),
        ("Prod{x: 4}<x>", 4),
        ("{ yield x * x | x in Seq[1,2,3] | x > 1 }", [4, 9]),
        ("{ x in Bag{1,2} | x = 2 }", {"$type": "bag", "$items": [2]}),
        ("{ yield 1 | x in Set{1,2} }", {"$type": "set", "$items": [1]}),
        ("let f = x => x + 1; f(2)", 3),
        ("5 |> _ * 2", 10),
        ("keys(Map{b: 1, a: 2})", {"$type": "set", "$items": ["a", "b"]}),
        ("values(Map{b: 1, a: 2})", [2, 1]),
        ('getPath(Map{a: Map{b: null}}, Seq["a","b"])', {"$type": "some", "$value": None}),
        ("mapOpt(Some(2), x => x + 1)", {"$type": "some", "$value": 3}),
        ("orElseOpt(None, 4)", 4),
        ("bindRes(Ok(2), x => Ok(x))", {"$type": "ok", "$value": 2}),
        ("normalizeUnique(BagKV{\"a\" -> 1})", {"$type": "ok", "$value": {"a": 1}}),
        ("one?(Bag{})", {"$type": "none"}),
        ("one!(Bag{7})", 7),
        ("first(Seq[1,2])", {"$type": "some", "$value": 1}),
        ("mergeRight(Map{a: 1}, Map{a: 2})", {"a": 2}),
        ("typeOf(Bytes(\"00ff\"))", "bytes"),
        ("Match(1, Seq[1, 2, 1], l, r)", {"$type": "bag", "$items": [1, 1]}),
        ("Seq[Map{k: 1}] |> enrich { m: one!(Match(l, Seq[Map{k: 1, v: 9}], l<k>!, r<k>!)) }", [{"k": 1, "m": {"k": 1, "v": 9}}]),
        ("Seq[Map{k: 1}, Map{k: 2}][r<k>! = Ok(2)]", [{"k": 2}]),
        (";; note\n ok(1)", {"$type": "ok", "$value": 1}),
    ],
)
def test_values(text, want):
    assert A.evaluate(text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("1 / 0", "t_sda_div_by_zero"), ("1 + true", "t_sda_wrong_shape"), ("nope", "t_sda_unbound_name"), ("_", "t_sda_unbound_placeholder"), ("true and 1", "t_sda_wrong_shape"),
        ('Map{"a" -> 1}<b>!', "t_sda_missing_key"), ("Map{a: 1}<a>", "t_sda_wrong_shape"), ("Prod{a: 1}<b>", "t_sda_unknown_field"), ('BagKV{"a" -> 1, "a" -> 2}<a>!', "t_sda_duplicate_key"),
        ("one!(Bag{})", "t_enr_missing"), ("only(Bag{1,2})", "t_enr_duplicate"), ("first(Bag{1})", "t_enr_unordered_policy"), ("Map{a: 1} + Map{a: 2}", "t_enr_field_collision"), ("keys(1, 2)", "t_sda_arity_mismatch"),
        ("3(4)", "t_sda_not_callable"), ('normalizeUnique(BagKV{"a" -> 1, "a" -> 1})', "t_sda_duplicate_key"), ("{ x in Seq[1] | 5 }", "t_sda_wrong_shape"), ("1 < \"a\"", "t_sda_wrong_shape"), ("Match(1, 2, l, r)", "t_enr_wrong_shape"),
    ],
)
def test_failures_are_values(text, want):
    assert code(A.evaluate(text)) == want


def test_syntax_errors():
    for bad in ("1 +", "{ 1 | 2 }", "let _ = 1", "Seq[1", "@", "let set = 1"):
        with pytest.raises(StaticError):
            A.parse(bad)


atoms = st.sampled_from(["1", "2.5", '"s"', "true", "null", "x", "None"])
exprs = st.recursive(atoms, lambda e: st.one_of(st.tuples(e, st.sampled_from(["+", "and", "union", "=", "++", "in"]), e).map(lambda t: f"({t[0]} {t[1]} {t[2]})"), e.map(lambda x: f"Some({x})"), st.lists(e, max_size=3).map(lambda xs: f"Bag{{{', '.join(xs)}}}"), e.map(lambda x: f"{{ yield y | y in Seq[{x}] | y = y }}"), e.map(lambda x: f"(z => {x})")), max_leaves=8)


@settings(max_examples=60, deadline=None)
@given(exprs)
def test_pretty_text_parses_to_the_same(text):
    e = A.parse_expr(text)
    assert A.parse_expr(A.pretty(e)) == e


def test_json_bridge():
    for x in (None, 1, 2.5, "a", [1, [2]], {"a": {"b": []}}, {"$type": "set", "$items": [1]}, {"$type": "map", "$fields": {"$type": "set"}}):
        assert A.to_json(A.from_json(x)) == x


def test_rows(spark):
    df = spark.createDataFrame([(1, "ab", [1, 2]), (2, None, [3]), (3, "abc", [])], "i int, s string, xs array<int>")
    assert [r.i for r in A.filter_rows(df, 'startsWith(_<s>, "ab") and _<i> >= 2').collect()] == [3]
    assert "PythonUDF" not in A.filter_rows(df, "_<i> > 1")._jdf.queryExecution().toString()
    assert [r.i for r in A.filter_rows(df, "_<i> / 2 = 1").collect()] == [2]
    assert [r.i for r in A.filter_rows(df, "_<i>").collect()] == []
    assert [r.value for r in A.map_rows(df, "{ yield x * 2 | x in xs }").collect()] == ["[2, 4]", "[6]", "[]"]
    from pyspark.sql import functions as F

    c, _ = A.to_column(A.parse_expr("{ yield x + 1 | x in xs | x > 1 }"), {"xs": (F.col("xs"), df.schema["xs"].dataType)})
    assert [[int(v) for v in r[0]] for r in df.select(c).collect()] == [[3], [4], []]


ODD_ROWS = [(1, 5, "ab", True), (None, 3, "x", False), (2**63 - 1, -(2**31), 'q"\\', True), (-(2**63), 2**31 - 1, "é \x01/", None), (0, None, None, False), (7, 0, "", True)]


def check_native(spark, program, native=True):
    """A program gives the evaluator's text in every row; whether any row does without it."""
    rows = spark.createDataFrame([(*r, [1, 2]) for r in ODD_ROWS], "k long, n int, s string, b boolean, xs array<int>")
    want = [A.json.dumps(A.evaluate(program, **r.asDict()), sort_keys=True, ensure_ascii=False) for r in rows.collect()]
    assert [r.value for r in A.map_rows(rows, program).collect()] == want, program
    found = A._native(rows, A.parse(program))
    assert (found is not None and rows.where(found.isNotNull()).count() > 0) == native, program


def test_constants_are_evaluated_once(spark):
    check_native(spark, 'Map{k: k, s: typeOf(Set{1, 1}), n: { yield x * 2 | x in Seq[3, 4] }, e: Set{2, 1, 2} = Set{1, 2}, t: s, o: Some(b), z: Seq[n, null, " \\""], f: nothing, g: typeOf(n)}')
    check_native(spark, "Map{k: k, a: typeOf(Set{n}), b: k in xs}", native=False)
    check_native(spark, 'Map{"$type": s, k: k}', native=False)
    used = A.map_rows(spark.createDataFrame([(1, [2])], "k long, xs array<int>"), "Map{k: k}")
    assert "xs" not in used._jdf.queryExecution().optimizedPlan().toString().split("LogicalRDD")[0]


@pytest.mark.parametrize(
    "program",
    [
        'let m = Map{x: n}; Map{k: k, a: mapRes(m<x>!, v => v + 1) = Ok(n + 1), b: orElseRes(m<y>!, n), c: typeOf(bindRes(m<x>!, v => Fail("odd", "no"))), d: typeOf(mapRes(m<y>!, v => v))}',
        "Map{k: k, a: n * 3 - 1, b: -n + 2, c: k + k, d: k * n, e: n = 5, f: n != 1 / 2, g: Seq[n, s] = Seq[3, \"x\"], h: Some(n) = Ok(n), i: n = s, j: n = null}",
        'Map{a: n > 3 and not (k >= 7), b: s < "b" or b, c: startsWith(s, "a"), d: strContains(s, ""), e: n + s, f: not n, g: n and b, h: s <= n, i: startsWith(s, n), j: n < s}',
        "Map{a: Bind(n, s) = Bind(n, \"ab\"), b: Prod{x: n} = Prod{x: 3}, c: Prod{x: n}<x>, d: Map{x: n, y: 1} = Map{y: 1, x: 0}, e: n |> _ + 1, f: (x => x * x)(n)}",
    ],
)
def test_operations_on_columns(spark, program):
    check_native(spark, program)


def test_what_rows_decide_is_left_to_the_evaluator(spark):
    for program in ("Map{a: 1 / n}", "Map{a: n < 1 / 2}", "Map{a: n in Seq[1, 3]}", "Map{a: k * k * k}", "Map{a: s ++ s}", "Map{a: { x in Seq[1, 2] | n > x }}", "Map{a: asBagKV(Bag{Bind(s, 1)})<x>!}", "Map{a: getPath(Map{x: 1}, Seq[s])}", "Map{a: Fail(s, s)}", "Map{a: Set{n, 3}}"):
        check_native(spark, program, native=False)

"""The value algebra: exact values, total operations, failures as values.

``parse`` makes a tree, ``Evaluator`` evaluates it exactly (rationals, sets,
bags, multimaps, options, results), ``to_column`` compiles the part that Spark
expressions can carry, and ``map_rows`` / ``filter_rows`` use the compiled form
where there is one and batches through the evaluator where there isn't.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from fractions import Fraction
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspan.errors import StaticError

# values: None, bool, Fraction, str, bytes, and these


@dataclass(frozen=True)
class Items:
    """seq, set or bag."""

    kind: str
    items: tuple[Any, ...]


@dataclass(frozen=True)
class Record:
    """map or prod: named fields in order."""

    kind: str
    fields: tuple[tuple[str, Any], ...]

    def get(self, name: str) -> tuple[bool, Any]:
        for k, v in self.fields:
            if k == name:
                return True, v
        return False, None


@dataclass(frozen=True)
class MultiMap:
    pairs: tuple[tuple[Any, Any], ...]


@dataclass(frozen=True)
class Bind:
    key: Any
    val: Any


@dataclass(frozen=True)
class Some:
    value: Any


@dataclass(frozen=True)
class Nothing:
    pass


@dataclass(frozen=True)
class Ok:
    value: Any


@dataclass(frozen=True)
class Fail:
    code: str
    message: str


@dataclass(frozen=True, eq=False)
class Lambda:
    param: str
    body: tuple
    env: Mapping[str, Any]


def _fail(code: str) -> Fail:
    return Fail(code, code.split("_", 2)[2].replace("_", " "))


WRONG = _fail("t_sda_wrong_shape")
ENR_WRONG = _fail("t_enr_wrong_shape")


class NotCompiled(Exception):
    """The expression needs the evaluator."""


@dataclass(frozen=True, eq=False)
class Sym:
    """A number (whole, of at most ``most``), text or boolean that a column holds in each row; never null."""

    kind: str
    column: Column
    most: int = 0
    nodes: int = 1


def type_of(v: Any) -> str:
    if v is None:
        return "null"
    if isinstance(v, Items | Record | Sym):
        return v.kind
    return {bool: "bool", Fraction: "num", str: "str", bytes: "bytes", MultiMap: "bagkv", Bind: "bind", Some: "some", Nothing: "none", Ok: "ok", Fail: "fail", Lambda: "fn"}[type(v)]


def comparable(v: Any) -> bool:
    if isinstance(v, Lambda):
        return False
    if isinstance(v, Items):
        return all(map(comparable, v.items))
    if isinstance(v, Record):
        return all(comparable(x) for _, x in v.fields)
    if isinstance(v, MultiMap):
        return all(comparable(k) and comparable(x) for k, x in v.pairs)
    if isinstance(v, Bind):
        return comparable(v.key) and comparable(v.val)
    return comparable(v.value) if isinstance(v, Some | Ok) else True


def sort_key(v: Any) -> str:
    """Equal exactly for equal values; the canonical order of sets and bags."""
    if isinstance(v, Sym):
        raise NotCompiled("order of a column's values")
    if isinstance(v, Items):
        inner = list(map(sort_key, v.items))
        return f"{v.kind}[{','.join(inner if v.kind == 'seq' else sorted(inner))}]"
    if isinstance(v, Record):
        return f"{v.kind}{{{','.join(sorted(json.dumps(k) + ':' + sort_key(x) for k, x in v.fields))}}}"
    if isinstance(v, MultiMap):
        return f"bagkv{{{','.join(sorted(sort_key(k) + ':' + sort_key(x) for k, x in v.pairs))}}}"
    if isinstance(v, Bind):
        return f"bind({sort_key(v.key)},{sort_key(v.val)})"
    if isinstance(v, Some | Ok):
        return f"{type_of(v)}({sort_key(v.value)})"
    if isinstance(v, Fail):
        return f"fail({json.dumps(v.code)},{json.dumps(v.message)})"
    if isinstance(v, bytes):
        return "bytes:" + v.hex()
    return f"{type_of(v)}:{json.dumps(v) if isinstance(v, str) else v}"


def equal(a: Any, b: Any) -> bool:
    return sort_key(a) == sort_key(b)


def distinct(items: Any) -> tuple[Any, ...]:
    return tuple({sort_key(x): x for x in reversed(list(items))}.values())[::-1]


# JSON bridge

_TAGS = {"num", "bytes", "set", "bag", "seq", "map", "prod", "bagkv", "bind", "some", "none", "ok", "fail"}


def from_json(x: Any) -> Any:
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if isinstance(x, int):
        return Fraction(x)
    if isinstance(x, float):
        return Fraction(repr(x)) if x == x and abs(x) != float("inf") else str(x)
    if isinstance(x, list | tuple):
        return Items("seq", tuple(map(from_json, x)))
    tag = x.get("$type")
    if tag == "num":
        return Fraction(x["$value"])
    if tag == "bytes":
        return bytes.fromhex(x["$value"])
    if tag in ("set", "bag", "seq"):
        items = tuple(map(from_json, x["$items"]))
        return Items(tag, distinct(items) if tag == "set" else items)
    if tag in ("map", "prod"):
        return Record(tag, tuple((k, from_json(v)) for k, v in x["$fields"].items()))
    if tag == "bagkv":
        return MultiMap(tuple((from_json(k), from_json(v)) for k, v in x["$items"]))
    if tag == "bind":
        return Bind(from_json(x["$key"]), from_json(x["$val"]))
    if tag in ("some", "ok"):
        return (Some if tag == "some" else Ok)(from_json(x["$value"]))
    if tag == "none":
        return Nothing()
    if tag == "fail":
        return Fail(x["$code"], x["$message"])
    return Record("map", tuple((k, from_json(v)) for k, v in x.items()))


def to_json(v: Any) -> Any:
    if v is None or isinstance(v, bool | str):
        return v
    if isinstance(v, Fraction):
        if v.denominator == 1:
            return v.numerator
        d = v.denominator
        for p in (2, 5):
            while d % p == 0:
                d //= p
        return float(v) if d == 1 and Fraction(repr(float(v))) == v else {"$type": "num", "$value": f"{v.numerator}/{v.denominator}"}
    if isinstance(v, bytes):
        return {"$type": "bytes", "$value": v.hex()}
    if isinstance(v, Items):
        if v.kind == "seq":
            return list(map(to_json, v.items))
        return {"$type": v.kind, "$items": [to_json(x) for x in sorted(v.items, key=sort_key)]}
    if isinstance(v, Record):
        fields = {k: to_json(x) for k, x in v.fields}
        if v.kind == "prod" or fields.get("$type") in _TAGS:
            return {"$type": v.kind, "$fields": fields}
        return fields
    if isinstance(v, MultiMap):
        return {"$type": "bagkv", "$items": [[to_json(k), to_json(x)] for k, x in v.pairs]}
    if isinstance(v, Bind):
        return {"$type": "bind", "$key": to_json(v.key), "$val": to_json(v.val)}
    if isinstance(v, Some | Ok):
        return {"$type": type_of(v), "$value": to_json(v.value)}
    if isinstance(v, Nothing):
        return {"$type": "none"}
    if isinstance(v, Fail):
        return {"$type": "fail", "$code": v.code, "$message": v.message}
    raise StaticError("not_serialisable", type_of(v))


# text

_SYMBOLS = {"∧": "and", "∨": "or", "¬": "not", "∈": "in", "∪": "union", "∩": "inter", "⊎": "bunion", "⊖": "bdiff", "\\": "diff", "≠": "!=", "≤": "<=", "≥": ">=", "→": "->", "↦": "=>", "⟨": "⟨", "⟩": "⟩", "∣": "|", "•": "_"}
_LEX = re.compile(r"""\s+|;;[^\n]*|(?P<str>"(?:[^"\\]|\\.)*")|(?P<num>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z][A-Za-z0-9_]*|_(?![A-Za-z0-9]))|(?P<op>\|>|=>|->|\+\+|!=|<=|>=|[-+*/=<>(){}\[\],:;|!?\\∧∨¬∈∪∩⊎⊖≠≤≥→↦⟨⟩∣•])""", re.X)
_WORDS = {"let", "yield", "null", "true", "false", "bytes", "seq", "set", "bag", "map", "prod", "bagkv", "some", "none", "ok", "fail", "union", "inter", "diff", "bunion", "bdiff", "in", "and", "or", "not"}
_SETISH = ("union", "inter", "diff", "bunion", "bdiff", "in")


class _Parser:
    def __init__(self, source: str) -> None:
        self.toks: list[tuple[str, str]] = []
        at = 0
        while at < len(source):
            m = _LEX.match(source, at)
            if m is None:
                raise StaticError("bad_character", f"{source[at]!r} at {at}")
            kind, text = m.lastgroup, m.group()
            if kind == "str":
                text = re.sub(r"\\(.)", lambda e: {"n": "\n", "t": "\t", "r": "\r"}.get(e[1], e[1]), text[1:-1], flags=re.S)
            elif kind == "op" and text in _SYMBOLS:
                text = _SYMBOLS[text]
                kind = "word" if text.isalpha() else "name" if text == "_" else "op"
            elif kind == "name" and text.lower() in _WORDS:
                kind, text = "word", text.lower()
            if kind:
                self.toks.append((kind, text))
            at = m.end()
        self.toks.append(("end", ""))
        self.at = 0

    def peek(self, n: int = 0) -> tuple[str, str]:
        return self.toks[min(self.at + n, len(self.toks) - 1)]

    def take(self, kind: str, *texts: str) -> str | None:
        k, t = self.peek()
        if k == kind and (not texts or t in texts):
            self.at += 1
            return t
        return None

    def need(self, kind: str, *texts: str) -> str:
        found = self.take(kind, *texts)
        if found is None:
            raise StaticError("syntax", f"expected {' or '.join(texts) or kind}, found {self.peek()[1] or 'the end'!r}")
        return found

    def program(self) -> tuple:
        out = []
        while self.peek()[0] != "end":
            if self.take("word", "let"):
                if self.peek() == ("name", "_"):
                    raise StaticError("t_sda_reserved_placeholder")
                name = self.need("name")
                self.need("op", "=")
                out.append(("let", name, self.expr()))
            elif self.peek() == ("name", "source") and self.peek(1)[0] == "name":
                self.at += 2
                self.need("op", ":")
                self.need("name")
                if self.take("op", "["):
                    while self.take("op", "]") is None:
                        self.at += 1
                out.append(("source",))
            else:
                out.append(("expr", self.expr()))
            if self.peek()[0] != "end":
                self.need("op", ";")
        return tuple(out)

    def expr(self) -> tuple:
        left = self._or()
        while self.take("op", "|>"):
            left = ("pipe", left, self._or())
        return left

    def _chain(self, ops: tuple[str, ...], kind: str, below: Callable[[], tuple]) -> tuple:
        left = below()
        while (op := self.take(kind, *ops)) is not None:
            left = ("bin", op, left, below())
        return left

    def _or(self) -> tuple:
        return self._chain(("or",), "word", self._and)

    def _and(self) -> tuple:
        return self._chain(("and",), "word", self._not)

    def _not(self) -> tuple:
        if self.take("word", "not"):
            return ("un", "not", self._not())
        left = self._setish()
        if (op := self.take("op", "=", "!=", "<", "<=", ">", ">=")) is not None:
            return ("bin", op, left, self._setish())
        return left

    def _setish(self) -> tuple:
        return self._chain(_SETISH, "word", lambda: self._chain(("+", "-", "++"), "op", lambda: self._chain(("*", "/"), "op", self._unary)))

    def _unary(self) -> tuple:
        return ("un", "-", self._unary()) if self.take("op", "-") else self._postfix()

    def _postfix(self) -> tuple:
        e = self._primary()
        while True:
            k, t = self.peek()
            if t in ("?", "!") and k == "op" and e == ("name", "one") and self.peek(1) == ("op", "("):
                self.at += 1
                e = ("name", "one" + t)
            elif k == "op" and t == "⟨" or (k == "op" and t == "<" and self.peek(1)[0] in ("name", "str") and self.peek(2) == ("op", ">")):
                self.at += 1
                field = self.take("str") or self.need("name")
                self.need("op", ">", "⟩")
                e = ("select", e, field, self.take("op", "?", "!") or "")
            elif k == "op" and t == "(":
                self.at += 1
                e = ("call", e, self._list(")"))
            elif k == "op" and t == "[":
                self.at += 1
                a = self._setish()
                self.need("op", "=")
                b = self._setish()
                self.need("op", "]")
                e = ("each", None, "r", e, ("bin", "=", a, b))  # keeps the carrier of what it selects from
            elif e in (("name", "enrich"), ("name", "refine")) and k == "op" and t == "{":
                self.at += 1
                if e[1] == "refine":
                    inner = self.expr()
                    self.need("op", "}")
                    return inner
                return ("enrich", self._fields())
            else:
                return e

    def _list(self, end: str) -> tuple:
        out = []
        while self.take("op", end) is None:
            out.append(self.expr())
            if self.take("op", ",") is None:
                self.need("op", end)
                break
        return tuple(out)

    def _fields(self) -> tuple:
        out = []
        while self.take("op", "}") is None:
            name = self.take("str") or self.need("name")
            self.need("op", ":", "->")
            out.append((name, self.expr()))
            if self.take("op", ",") is None:
                self.need("op", "}")
                break
        return tuple(out)

    def _primary(self) -> tuple:
        k, t = self.peek()
        if k == "name" and self.peek(1) == ("op", "=>"):
            self.at += 2
            return ("lambda", t, self.expr())
        self.at += 1
        if k == "num":
            return ("lit", Fraction(t))
        if k == "str":
            return ("lit", t)
        if k == "name":
            return ("name", t)
        if k == "word":
            if t in ("null", "true", "false"):
                return ("lit", {"null": None, "true": True, "false": False}[t])
            if t == "bytes":
                self.need("op", "(")
                found = self.need("str")
                self.need("op", ")")
                try:
                    return ("lit", bytes.fromhex(found))
                except ValueError as e:
                    raise StaticError("bad_bytes", found) from e
            if t == "seq":
                self.need("op", "[")
                return ("items", t, self._list("]"))
            if t in ("set", "bag"):
                self.need("op", "{")
                return ("items", t, self._list("}"))
            if t in ("map", "prod"):
                self.need("op", "{")
                return ("record", t, self._fields())
            if t == "bagkv":
                self.need("op", "{")
                out = []
                while self.take("op", "}") is None:
                    key = self._setish()
                    self.need("op", ":", "->")
                    out.append((key, self.expr()))
                    if self.take("op", ",") is None:
                        self.need("op", "}")
                        break
                return ("bagkv", tuple(out))
            if t == "none":
                return ("lit", Nothing())
            if t in ("some", "ok", "fail"):
                self.need("op", "(")
                return (t, *self._list(")"))
        if k == "op" and t == "(":
            e = self.expr()
            self.need("op", ")")
            return e
        if k == "op" and t == "{":
            return self._comprehension()
        raise StaticError("syntax", f"unexpected {t or 'end'!r}")

    def _comprehension(self) -> tuple:
        made = None
        if self.take("word", "yield"):
            made = self.expr()
            self.need("op", "|")
            gen = self.expr()
        else:
            gen = self.expr()
            if not self._generator(gen):
                made = gen
                self.need("op", "|")
                gen = self.expr()
        if not self._generator(gen):
            raise StaticError("syntax", "expected name in collection")
        test = self.expr() if self.take("op", "|") else None
        self.need("op", "}")
        return ("each", made, gen[2][1], gen[3], test)

    @staticmethod
    def _generator(e: tuple) -> bool:
        return e[0] == "bin" and e[1] == "in" and e[2][0] == "name"


def parse(source: str) -> tuple:
    """The program as statements; raises ``StaticError`` where it isn't one."""
    return _Parser(source).program()


def parse_expr(source: str) -> tuple:
    found = parse(source)
    if len(found) != 1 or found[0][0] != "expr":
        raise StaticError("syntax", "one expression is wanted")
    return found[0][1]


def pretty(e: tuple) -> str:
    """Canonical text of an expression; parsing it gives the expression again."""
    name = lambda s: s if re.fullmatch(r"[A-Za-z][A-Za-z0-9_]*", s) and s.lower() not in _WORDS else json.dumps(s, ensure_ascii=False)
    match e:
        case ("lit", v):
            if isinstance(v, Fraction):
                return str(v.numerator) if v.denominator == 1 else repr(float(v))
            return json.dumps(v, ensure_ascii=False) if isinstance(v, str | bool) or v is None else f'Bytes("{v.hex()}")' if isinstance(v, bytes) else "None"
        case ("name", n):
            return n
        case ("bin", op, a, b):
            return f"({pretty(a)} {op} {pretty(b)})"
        case ("un", op, a):
            return f"({op} {pretty(a)})"
        case ("pipe", a, b):
            return f"({pretty(a)} |> {pretty(b)})"
        case ("select", a, f, mode):
            return f"{pretty(a)}<{name(f)}>{mode}"
        case ("call", f, args):
            return f"{pretty(f)}({', '.join(map(pretty, args))})"
        case ("lambda", p, b):
            return f"({p} => {pretty(b)})"
        case ("items", k, xs):
            a, b = ("[", "]") if k == "seq" else ("{", "}")
            return f"{k.capitalize()}{a}{', '.join(map(pretty, xs))}{b}"
        case ("record", k, fs):
            return f"{k.capitalize()}{{{', '.join(f'{name(n)} -> {pretty(x)}' for n, x in fs)}}}"
        case ("enrich", fs):
            return f"enrich {{{', '.join(f'{name(n)}: {pretty(x)}' for n, x in fs)}}}"
        case ("bagkv", ps):
            return f"BagKV{{{', '.join(f'{pretty(k)} -> {pretty(x)}' for k, x in ps)}}}"
        case ("each", made, var, coll, test):
            return "{" + (f"yield {pretty(made)} | " if made else "") + f"{var} in {pretty(coll)}" + (f" | {pretty(test)}" if test else "") + "}"
        case (("some" | "ok" | "fail") as k, *args):
            return f"{k.capitalize()}({', '.join(map(pretty, args))})"
    raise StaticError("bad_expression", repr(e))


# evaluation


class Evaluator:
    """Evaluates expressions exactly; what goes wrong is a ``Fail`` value."""

    def run(self, program: tuple, env: Mapping[str, Any] | None = None) -> Any:
        scope, last = dict(env or {}), None
        for stmt in program:
            if stmt[0] == "let":
                scope[stmt[1]] = self.eval(stmt[2], scope)
            elif stmt[0] == "expr":
                last = self.eval(stmt[1], scope)
        return last

    def eval(self, e: tuple, env: Mapping[str, Any]) -> Any:
        return getattr(self, "_" + e[0])(e, env)

    def _lit(self, e: tuple, env: Mapping[str, Any]) -> Any:
        return e[1]

    def _name(self, e: tuple, env: Mapping[str, Any]) -> Any:
        if e[1] in env:
            return env[e[1]]
        return _fail("t_sda_unbound_placeholder" if e[1] == "_" else "t_sda_unbound_name")

    def _items(self, e: tuple, env: Mapping[str, Any]) -> Any:
        items = tuple(self.eval(x, env) for x in e[2])
        if e[1] == "set":
            return Items("set", distinct(items)) if all(map(comparable, items)) else WRONG
        return Items(e[1], items)

    def _record(self, e: tuple, env: Mapping[str, Any]) -> Any:
        names = [n for n, _ in e[2]]
        if len(set(names)) < len(names):
            return _fail("t_sda_duplicate_key")
        return Record(e[1], tuple((n, self.eval(x, env)) for n, x in e[2]))

    def _bagkv(self, e: tuple, env: Mapping[str, Any]) -> Any:
        pairs = tuple((self.eval(k, env), self.eval(x, env)) for k, x in e[1])
        return MultiMap(pairs) if all(comparable(k) for k, _ in pairs) else _fail("t_sda_invalid_bagkv_key")

    def _some(self, e: tuple, env: Mapping[str, Any]) -> Any:
        return Some(self.eval(e[1], env)) if len(e) == 2 else _fail("t_sda_arity_mismatch")

    def _ok(self, e: tuple, env: Mapping[str, Any]) -> Any:
        return Ok(self.eval(e[1], env)) if len(e) == 2 else _fail("t_sda_arity_mismatch")

    def _fail(self, e: tuple, env: Mapping[str, Any]) -> Any:
        if len(e) != 3:
            return _fail("t_sda_arity_mismatch")
        code, message = self.eval(e[1], env), self.eval(e[2], env)
        return Fail(code, message) if isinstance(code, str) and isinstance(message, str) else WRONG

    def _lambda(self, e: tuple, env: Mapping[str, Any]) -> Any:
        return Lambda(e[1], e[2], dict(env))

    def _pipe(self, e: tuple, env: Mapping[str, Any]) -> Any:
        return self.eval(e[2], {**env, "_": self.eval(e[1], env)})

    def _un(self, e: tuple, env: Mapping[str, Any]) -> Any:
        v = self.eval(e[2], env)
        if e[1] == "-":
            return -v if isinstance(v, Fraction) else WRONG
        return not v if isinstance(v, bool) else WRONG

    def _bin(self, e: tuple, env: Mapping[str, Any]) -> Any:
        return binary(e[1], self.eval(e[2], env), self.eval(e[3], env))

    def _select(self, e: tuple, env: Mapping[str, Any]) -> Any:
        return select(self.eval(e[1], env), e[2], e[3])

    def _each(self, e: tuple, env: Mapping[str, Any]) -> Any:
        _, made, var, coll, test = e
        found = self.eval(coll, env)
        if isinstance(found, MultiMap):
            found = Items("bag", tuple(Bind(k, v) for k, v in found.pairs))
        if not isinstance(found, Items):
            return WRONG
        out = []
        for x in found.items:
            inner = {**env, var: x}
            if test is not None:
                keep = self.eval(test, inner)
                if not isinstance(keep, bool):
                    return WRONG
                if not keep:
                    continue
            out.append(x if made is None else self.eval(made, inner))
        if found.kind == "set":
            return Items("set", distinct(out)) if all(map(comparable, out)) else WRONG
        return Items(found.kind, tuple(out))

    def _enrich(self, e: tuple, env: Mapping[str, Any]) -> Any:
        if "_" not in env:
            return _fail("t_sda_unbound_placeholder")
        left = env["_"]
        if not isinstance(left, Items):
            return ENR_WRONG
        out = []
        for x in left.items:
            added = Record("map", tuple((n, self.eval(f, {**env, "l": x})) for n, f in e[1]))
            out.append(merge(x, added, "fail") if isinstance(x, Record) else ENR_WRONG)
        if left.kind == "set":
            return Items("set", distinct(out)) if all(map(comparable, out)) else WRONG
        return Items(left.kind, tuple(out))

    def _call(self, e: tuple, env: Mapping[str, Any]) -> Any:
        fn, args = e[1], e[2]
        if fn == ("name", "Match"):
            return self._match(args, env)
        values = [self.eval(a, env) for a in args]
        if fn[0] == "name" and fn[1] in LIBRARY:
            arity, call = LIBRARY[fn[1]]
            return call(self, *values) if len(values) == arity else _fail("t_sda_arity_mismatch")
        return self.apply(self.eval(fn, env), *values)

    def apply(self, fn: Any, *values: Any) -> Any:
        if isinstance(fn, Fail) and fn.code == "t_sda_unbound_name":
            return fn
        if not isinstance(fn, Lambda):
            return _fail("t_sda_not_callable")
        return self.eval(fn.body, {**fn.env, fn.param: values[0]}) if len(values) == 1 else _fail("t_sda_arity_mismatch")

    def _match(self, args: tuple, env: Mapping[str, Any]) -> Any:
        if len(args) != 4:
            return _fail("t_sda_arity_mismatch")
        left, right = self.eval(args[0], env), self.eval(args[1], env)
        if not isinstance(right, Items):
            return ENR_WRONG
        out = []
        for r in right.items:
            inner = {**env, "l": left, "r": r}
            a, b = self.eval(args[2], inner), self.eval(args[3], inner)
            if not (comparable(a) and comparable(b)):
                return _fail("t_enr_invalid_key")
            if equal(a, b):
                out.append(r)
        return Items("bag", tuple(out))


def merge(a: Any, b: Any, policy: str) -> Any:
    if not (isinstance(a, Record) and isinstance(b, Record)):
        return ENR_WRONG
    fields = dict(a.fields)
    for k, v in b.fields:
        if k in fields and policy == "fail":
            return _fail("t_enr_field_collision")
        if k not in fields or policy == "right":
            fields[k] = v
    return Record(a.kind, tuple(fields.items()))


def binary(op: str, a: Any, b: Any) -> Any:
    numbers = isinstance(a, Fraction) and isinstance(b, Fraction)
    if op == "+" and isinstance(a, Record) and isinstance(b, Record):
        return merge(a, b, "fail")
    if op in ("+", "-", "*", "/"):
        if not numbers:
            return WRONG
        if op == "/":
            return a / b if b else _fail("t_sda_div_by_zero")
        return a + b if op == "+" else a - b if op == "-" else a * b
    if op == "++":
        if isinstance(a, str) and isinstance(b, str):
            return a + b
        both = isinstance(a, Items) and isinstance(b, Items) and a.kind == b.kind == "seq"
        return Items("seq", a.items + b.items) if both else WRONG
    if op in ("=", "!="):
        return equal(a, b) == (op == "=") if comparable(a) and comparable(b) else WRONG
    if op in ("<", "<=", ">", ">="):
        if not (numbers or (isinstance(a, str) and isinstance(b, str))):
            return WRONG
        return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    if op in ("and", "or"):
        if not (isinstance(a, bool) and isinstance(b, bool)):
            return WRONG
        return (a and b) if op == "and" else (a or b)
    if op == "in":
        if isinstance(b, Record):
            return b.get(a)[0] if isinstance(a, str) else WRONG
        if not isinstance(b, Items) or not comparable(a) or not all(map(comparable, b.items)):
            return WRONG
        return any(equal(a, x) for x in b.items)
    kind = "bag" if op in ("bunion", "bdiff") else "set"
    if not (isinstance(a, Items) and isinstance(b, Items) and a.kind == b.kind == kind):
        return WRONG
    theirs = {sort_key(x) for x in b.items}
    if op == "union":
        return Items("set", distinct(a.items + b.items))
    if op == "inter":
        return Items("set", tuple(x for x in a.items if sort_key(x) in theirs))
    if op == "diff":
        return Items("set", tuple(x for x in a.items if sort_key(x) not in theirs))
    if op == "bunion":
        return Items("bag", a.items + b.items)
    left = [sort_key(x) for x in b.items]
    out = []
    for x in a.items:
        if sort_key(x) in left:
            left.remove(sort_key(x))
        else:
            out.append(x)
    return Items("bag", tuple(out))


def select(v: Any, name: str, mode: str) -> Any:
    if isinstance(v, Record):
        found, x = v.get(name)
        if v.kind == "prod":
            return (x if found else _fail("t_sda_unknown_field")) if not mode else WRONG
        return WRONG if not mode else (Some(x) if found else Nothing()) if mode == "?" else (Ok(x) if found else _fail("t_sda_missing_key"))
    if isinstance(v, Bind):
        found, x = name in ("key", "val"), {"key": v.key, "val": v.val}.get(name)
        return x if not mode else (Some(x) if found else Nothing()) if mode == "?" else (Ok(x) if found else _fail("t_sda_missing_key"))
    if isinstance(v, MultiMap) and mode:
        hits = [x for k, x in v.pairs if k == name and isinstance(k, str)]
        if mode == "?":
            return Some(hits[0]) if len(hits) == 1 else Nothing()
        return Ok(hits[0]) if len(hits) == 1 else _fail("t_sda_missing_key" if not hits else "t_sda_duplicate_key")
    return WRONG


def _one(optional: bool) -> Callable[[Evaluator, Any], Any]:
    def call(_: Evaluator, v: Any) -> Any:
        if not isinstance(v, Items):
            return ENR_WRONG
        if len(v.items) > 1:
            return Fail("t_enr_duplicate", "duplicate match")
        if not v.items:
            return Nothing() if optional else Fail("t_enr_missing", "missing match")
        return Some(v.items[0]) if optional else v.items[0]

    return call


def _end(at: int) -> Callable[[Evaluator, Any], Any]:
    def call(_: Evaluator, v: Any) -> Any:
        if not isinstance(v, Items):
            return ENR_WRONG
        if v.kind != "seq":
            return _fail("t_enr_unordered_policy")
        return Some(v.items[at]) if v.items else Nothing()

    return call


def _path(_: Evaluator, doc: Any, path: Any) -> Any:
    if not isinstance(path, Items) or path.kind != "seq" or not all(isinstance(p, str) for p in path.items):
        return WRONG
    for p in path.items:
        found, doc = doc.get(p) if isinstance(doc, Record) else (False, None)
        if not found:
            return Nothing()
    return Some(doc)


def _as_multimap(_: Evaluator, v: Any) -> Any:
    ok = isinstance(v, Items) and v.kind == "bag" and all(isinstance(x, Bind) for x in v.items)
    return MultiMap(tuple((x.key, x.val) for x in v.items)) if ok else WRONG


def _unique(_: Evaluator, v: Any) -> Any:
    if not isinstance(v, MultiMap) or not all(isinstance(k, str) for k, _ in v.pairs):
        return WRONG
    keys = [k for k, _ in v.pairs]
    return Ok(Record("map", v.pairs)) if len(set(keys)) == len(keys) else _fail("t_sda_duplicate_key")


def _count(_: Evaluator, x: Any, v: Any) -> Any:
    if not (isinstance(v, Items) and v.kind == "bag" and comparable(x) and all(map(comparable, v.items))):
        return WRONG
    return Fraction(sum(equal(x, y) for y in v.items))


def _text2(test: Callable[[str, str], bool]) -> Callable[[Evaluator, Any, Any], Any]:
    return lambda _, a, b: test(a, b) if isinstance(a, str) and isinstance(b, str) else WRONG


LIBRARY: dict[str, tuple[int, Callable[..., Any]]] = {
    "one?": (1, _one(True)), "oneOpt": (1, _one(True)), "one!": (1, _one(False)), "oneReq": (1, _one(False)), "only": (1, _one(False)),
    "first": (1, _end(0)), "last": (1, _end(-1)),
    "merge": (2, lambda _, a, b: merge(a, b, "fail")), "mergeFail": (2, lambda _, a, b: merge(a, b, "fail")), "mergeLeft": (2, lambda _, a, b: merge(a, b, "left")), "mergeRight": (2, lambda _, a, b: merge(a, b, "right")),
    "asBag": (1, lambda _, v: Items("bag", v.items) if isinstance(v, Items) else ENR_WRONG), "matchBag": (1, lambda _, v: Items("bag", v.items) if isinstance(v, Items) else ENR_WRONG),
    "typeOf": (1, lambda _, v: type_of(v)),
    "keys": (1, lambda _, v: Items("set", tuple(k for k, _ in v.fields)) if isinstance(v, Record) and v.kind == "map" else WRONG),
    "values": (1, lambda _, v: Items("seq", tuple(x for _, x in sorted(v.fields, key=lambda f: f[0]))) if isinstance(v, Record) and v.kind == "map" else WRONG),
    "count": (2, _count), "normalizeUnique": (1, _unique), "asBagKV": (1, _as_multimap), "Bind": (2, lambda _, k, v: Bind(k, v)), "getPath": (2, _path),
    "startsWith": (2, _text2(str.startswith)), "strContains": (2, _text2(lambda a, b: b in a)),
    "mapOpt": (2, lambda ev, o, f: Some(ev.apply(f, o.value)) if isinstance(o, Some) else o if isinstance(o, Nothing) else WRONG),
    "bindOpt": (2, lambda ev, o, f: ev.apply(f, o.value) if isinstance(o, Some) else o if isinstance(o, Nothing) else WRONG),
    "orElseOpt": (2, lambda _, o, d: o if isinstance(o, Some) else d if isinstance(o, Nothing) else WRONG),
    "mapRes": (2, lambda ev, r, f: Ok(ev.apply(f, r.value)) if isinstance(r, Ok) else r if isinstance(r, Fail) else WRONG),
    "bindRes": (2, lambda ev, r, f: ev.apply(f, r.value) if isinstance(r, Ok) else r if isinstance(r, Fail) else WRONG),
    "orElseRes": (2, lambda _, r, d: r if isinstance(r, Ok) else d if isinstance(r, Fail) else WRONG),
}


def evaluate(source: str, **env: Any) -> Any:
    """Run a program over JSON values; the result as JSON."""
    return to_json(Evaluator().run(parse(source), {k: from_json(v) for k, v in env.items()}))


# compilation to columns


def to_column(e: tuple, env: Mapping[str, tuple[Column, T.DataType]]) -> tuple[Column, T.DataType]:
    """An expression over typed columns as a Column, where both agree on every input.

    Compiled are literals, selectors that can't miss, arithmetic without
    division, comparisons of equal kinds, logic, text functions, and
    comprehensions over arrays; inputs must not be null.
    """
    from larkspan.functions.values import kind_of

    match e:
        case ("lit", v) if isinstance(v, bool | str):
            return F.lit(v), T.BooleanType() if isinstance(v, bool) else T.StringType()
        case ("lit", Fraction() as v) if v.denominator == 1 and abs(v) < 2**62:
            return F.lit(int(v)), T.LongType()
        case ("name", n) if n in env:
            return env[n]
        case ("select", inner, name, "!" | "?") | ("call", ("name", "getPath"), (inner, ("items", "seq", (("lit", name),)))):
            raise NotCompiled(name)
        case ("select", inner, name, ""):
            c, t = to_column(inner, env)
            if isinstance(t, T.StructType) and name in t.names:
                return c.getField(name), t[name].dataType
        case ("bin", ("+" | "-" | "*") as op, a, b):
            (x, s), (y, t) = to_column(a, env), to_column(b, env)
            if isinstance(s, T.IntegralType) and isinstance(t, T.IntegralType):
                x, y = x.cast("decimal(19,0)"), y.cast("decimal(19,0)")
                return (x + y if op == "+" else x - y if op == "-" else x * y), T.DecimalType(38, 0)
        case ("bin", ("=" | "!=" | "<" | "<=" | ">" | ">=") as op, a, b):
            (x, s), (y, t) = to_column(a, env), to_column(b, env)
            if kind_of(s) == kind_of(t) and kind_of(s) in ("num", "str", *(("bool",) if op in ("=", "!=") else ())):
                return {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], T.BooleanType()
        case ("bin", ("and" | "or") as op, a, b):
            (x, s), (y, t) = to_column(a, env), to_column(b, env)
            if isinstance(s, T.BooleanType) and isinstance(t, T.BooleanType):
                return (x & y if op == "and" else x | y), T.BooleanType()
        case ("un", "not", a):
            x, s = to_column(a, env)
            if isinstance(s, T.BooleanType):
                return ~x, s
        case ("bin", "++", a, b):
            (x, s), (y, t) = to_column(a, env), to_column(b, env)
            if isinstance(s, T.StringType) and isinstance(t, T.StringType):
                return F.concat(x, y), s
        case ("call", ("name", ("startsWith" | "strContains") as fn), (a, b)):
            (x, s), (y, t) = to_column(a, env), to_column(b, env)
            if isinstance(s, T.StringType) and isinstance(t, T.StringType):
                return (F.startswith(x, y) if fn == "startsWith" else F.contains(x, y)), T.BooleanType()
        case ("pipe", a, b):
            return to_column(b, {**env, "_": to_column(a, env)})
        case ("each", made, var, coll, test):
            c, t = to_column(coll, env)
            if isinstance(t, T.ArrayType):
                probe = {**env, var: (F.lit(None).cast(t.elementType), t.elementType)}
                if test is not None:
                    if not isinstance(to_column(test, probe)[1], T.BooleanType):
                        raise NotCompiled("predicate")
                    c = F.filter(c, lambda x: to_column(test, {**env, var: (x, t.elementType)})[0])
                if made is None:
                    return c, t
                kind = to_column(made, probe)[1]
                return F.transform(c, lambda x: to_column(made, {**env, var: (x, t.elementType)})[0]), T.ArrayType(kind)
        case ("record", "prod", fields):
            made = [(n, *to_column(x, env)) for n, x in fields]
            return F.struct(*[c.alias(n) for n, c, _ in made]), T.StructType([T.StructField(n, t) for n, _, t in made])
    raise NotCompiled(e[0])


def _nulls(e: tuple, env: Mapping[str, tuple[Column, T.DataType]]) -> list[Column]:
    """Columns a compiled expression reads that mustn't be null."""
    out: list[Column] = []
    if e[0] in ("select", "name"):
        try:
            out.append(to_column(e, env)[0])
        except NotCompiled:
            pass
        return out
    for x in e[1:]:
        if isinstance(x, tuple) and x and isinstance(x[0], str) and e[0] != "each":
            out.extend(_nulls(x, env))
    return out


#: Beyond this many operations an expression of columns goes to the evaluator.
MOST_NODES = 500


class Symbolic(Evaluator):
    """Evaluates a program once for all rows: what columns hold stays a ``Sym``.

    Kinds are known, so failures, options and selections are settled before any
    row is read.  Wherever a result would depend on a row's value in another
    way than the operations below, ``NotCompiled`` is raised.
    """

    def _name(self, e: tuple, env: Mapping[str, Any]) -> Any:
        v = super()._name(e, env)
        if isinstance(v, NotCompiled):
            raise v
        return v

    def _un(self, e: tuple, env: Mapping[str, Any]) -> Any:
        v = self.eval(e[2], env)
        if isinstance(v, Sym):
            if e[1] == "-":
                return Sym("num", -v.column, v.most, v.nodes + 1) if v.kind == "num" else WRONG
            return Sym("bool", ~v.column, 0, v.nodes + 1) if v.kind == "bool" else WRONG
        return super()._un(("un", e[1], ("lit", v)), env)

    def _bin(self, e: tuple, env: Mapping[str, Any]) -> Any:
        return sym_binary(e[1], self.eval(e[2], env), self.eval(e[3], env))

    def _select(self, e: tuple, env: Mapping[str, Any]) -> Any:
        v = self.eval(e[1], env)
        if isinstance(v, MultiMap) and _holds(v):
            raise NotCompiled("multimap")
        return select(v, e[2], e[3])

    def _each(self, e: tuple, env: Mapping[str, Any]) -> Any:
        _, made, var, coll, test = e
        found = self.eval(coll, env)
        if _holds(found):
            raise NotCompiled("each")
        return super()._each(("each", made, var, ("lit", found), test and ("known", test)), env)

    def _known(self, e: tuple, env: Mapping[str, Any]) -> Any:
        v = self.eval(e[1], env)
        if _holds(v):
            raise NotCompiled("test")
        return v

    def _fail(self, e: tuple, env: Mapping[str, Any]) -> Any:
        if any(_holds(self.eval(x, env)) for x in e[1:]):
            raise NotCompiled("fail")
        return super()._fail(e, env)

    def _call(self, e: tuple, env: Mapping[str, Any]) -> Any:
        fn, args = e[1], e[2]
        if fn == ("name", "Match"):
            raise NotCompiled("Match")
        if fn[0] == "name" and fn[1] in ("startsWith", "strContains") and len(args) == 2:
            a, b = (self.eval(x, env) for x in args)
            if isinstance(a, Sym) or isinstance(b, Sym):
                if type_of(a) != "str" or type_of(b) != "str":
                    return WRONG
                (x, m), (y, n) = _column(a), _column(b)
                return Sym("bool", (F.startswith if fn[1] == "startsWith" else F.contains)(x, y), 0, m + n + 1)
        if fn[0] == "name" and fn[1] in LIBRARY and fn[1] not in _SETTLED:
            if any(_holds(self.eval(a, env)) for a in args):
                raise NotCompiled(fn[1])
        return super()._call(e, env)


#: Functions that look at the shape of their arguments only, never at what a column holds.
_SETTLED = {"typeOf", "Bind", "mapOpt", "bindOpt", "orElseOpt", "mapRes", "bindRes", "orElseRes"}


def _holds(v: Any) -> bool:
    """Whether a value has a column in it."""
    if isinstance(v, Items):
        return any(map(_holds, v.items))
    if isinstance(v, Record):
        return any(_holds(x) for _, x in v.fields)
    if isinstance(v, MultiMap):
        return any(_holds(k) or _holds(x) for k, x in v.pairs)
    if isinstance(v, Bind):
        return _holds(v.key) or _holds(v.val)
    if isinstance(v, Lambda):
        return False
    return _holds(v.value) if isinstance(v, Some | Ok) else isinstance(v, Sym)


def sym_binary(op: str, a: Any, b: Any) -> Any:
    if not (_holds(a) or _holds(b)):
        return binary(op, a, b)
    if op in ("=", "!="):
        if not (comparable(a) and comparable(b)):
            return WRONG
        same = sym_equal(a, b)
        if isinstance(same, bool):
            return same == (op == "=")
        return same if op == "=" else Sym("bool", ~same.column, 0, same.nodes + 1)
    kinds = (type_of(a), type_of(b))
    whole = all(isinstance(x, Sym) or not isinstance(x, Fraction) or x.denominator == 1 for x in (a, b))
    if op in ("+", "-", "*") and kinds == ("num", "num") and whole:
        m, n = (x.most if isinstance(x, Sym) else abs(int(x)) for x in (a, b))
        most = m * n if op == "*" else m + n
        if max(most, m, n) < 10**37:
            (x, i), (y, j) = _column(a), _column(b)
            made = x + y if op == "+" else x - y if op == "-" else x * y
            return Sym("num", made.cast("decimal(38,0)"), most, i + j + 1)
    if op in ("<", "<=", ">", ">=") and kinds in (("num", "num"), ("str", "str")) and whole:
        (x, i), (y, j) = _column(a), _column(b)
        return Sym("bool", {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], 0, i + j + 1)
    if op in ("and", "or") and kinds == ("bool", "bool"):
        (x, i), (y, j) = _column(a), _column(b)
        return Sym("bool", x & y if op == "and" else x | y, 0, i + j + 1)
    wanted = {"and": ("bool",), "or": ("bool",), "<": ("num", "str"), "<=": ("num", "str"), ">": ("num", "str"), ">=": ("num", "str"), "++": ("str", "seq")}
    if op in ("+", "-", "*", "/", *wanted) and (kinds[0] != kinds[1] or kinds[0] not in wanted.get(op, ("num", "map", "prod"))) and not (isinstance(a, Record) and isinstance(b, Record)):
        return WRONG  # kinds that this operation never takes
    raise NotCompiled(op)


def _column(v: Any) -> tuple[Column, int]:
    """A symbol, whole number, text or boolean as a column, and the operations in it."""
    if isinstance(v, Sym):
        return v.column, v.nodes
    if isinstance(v, Fraction):
        if v.denominator != 1 or abs(v) >= 10**37:
            raise NotCompiled("number")
        return F.lit(str(v.numerator)).cast("decimal(38,0)"), 1
    return F.lit(v), 1


def sym_equal(a: Any, b: Any) -> bool | Sym:
    """Whether two values are equal, as far as that is the same in all rows."""
    if not (_holds(a) or _holds(b)):
        return equal(a, b)
    if type_of(a) != type_of(b):
        return False
    if isinstance(a, Sym) or isinstance(b, Sym):
        if any(isinstance(x, Fraction) and x.denominator != 1 for x in (a, b)):
            return False
        (x, i), (y, j) = _column(a), _column(b)
        return Sym("bool", x == y, 0, i + j + 1)
    if isinstance(a, Some | Ok):
        return sym_equal(a.value, b.value)
    if isinstance(a, Bind):
        return _all([(a.key, b.key), (a.val, b.val)])
    if isinstance(a, Items) and a.kind == "seq":
        return len(a.items) == len(b.items) and _all(list(zip(a.items, b.items)))
    if isinstance(a, Record):
        x, y = dict(a.fields), dict(b.fields)
        return x.keys() == y.keys() and _all([(x[k], y[k]) for k in x])
    raise NotCompiled("equality")


def _all(both: list[tuple[Any, Any]]) -> bool | Sym:
    found = [sym_equal(a, b) for a, b in both]
    open_ = [f for f in found if isinstance(f, Sym)]
    if not all(f for f in found if isinstance(f, bool)):
        return False
    if not open_:
        return True
    column = open_[0].column
    for f in open_[1:]:
        column = column & f.column
    return Sym("bool", column, 0, sum(f.nodes for f in open_) + len(open_))


def _symbols(df: DataFrame) -> tuple[dict[str, Any], dict[str, Column]]:
    """What each column is to a program, and where a row's value is what that says."""
    env: dict[str, Any] = {}
    fits: dict[str, Column] = {}
    widths = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if type(f.dataType) in widths:
            env[f.name] = Sym("num", c.cast("decimal(38,0)"), 2 ** widths[type(f.dataType)])
            fits[f.name] = c.isNotNull()
        elif isinstance(f.dataType, T.BooleanType):
            env[f.name] = Sym("bool", c)
            fits[f.name] = c.isNotNull()
        elif f.dataType == T.StringType():
            # Text that JSON escapes is left to the evaluator.
            env[f.name] = Sym("str", c)
            fits[f.name] = F.coalesce(F.is_valid_utf8(c) & ~F.rlike(c, F.lit(r'[\x00-\x1f"\\]')), F.lit(False))
        else:
            env[f.name] = NotCompiled(f.name)
    return env, fits


def _text(v: Any) -> list[str | Sym]:
    """The JSON text of a value, in pieces, as the evaluator would write it."""
    held: list[Sym] = []
    mark = uuid.uuid4().hex

    def tree(v: Any) -> Any:
        if isinstance(v, Sym):
            held.append(v)
            return f"{mark}{len(held) - 1}{mark}"
        if isinstance(v, Record):
            if any(k == "$type" for k, _ in v.fields) or v.kind == "prod":
                raise NotCompiled("$type")
            return {k: tree(x) for k, x in v.fields}
        if isinstance(v, Items) and v.kind == "seq":
            return list(map(tree, v.items))
        if isinstance(v, Some | Ok):
            return {"$type": type_of(v), "$value": tree(v.value)}
        if isinstance(v, Bind):
            return {"$type": "bind", "$key": tree(v.key), "$val": tree(v.val)}
        if _holds(v):
            raise NotCompiled(type_of(v))
        return to_json(v)

    text = json.dumps(tree(v), sort_keys=True, ensure_ascii=False)
    parts = re.split(f'"{mark}(\\d+){mark}"', text)
    return [held[int(p)] if i % 2 else p for i, p in enumerate(parts)]


def _native(df: DataFrame, program: tuple) -> Column | None:
    """The JSON text of the program's result from columns alone, null in rows that need the evaluator."""
    env, fits = _symbols(df)
    try:
        pieces = _text(Symbolic().run(program, env))
    except (NotCompiled, StaticError, RecursionError):
        return None
    if sum(p.nodes for p in pieces if isinstance(p, Sym)) > MOST_NODES:
        return None
    texts = [F.lit(p) if isinstance(p, str) else F.concat(F.lit('"'), p.column, F.lit('"')) if p.kind == "str" else p.column.cast("string") for p in pieces]
    fit = F.lit(True)
    for name in _names(program) & fits.keys():
        fit = fit & fits[name]
    return F.when(fit, F.concat(*texts))


def _names(e: Any) -> set[str]:
    """Every name that an expression mentions."""
    if isinstance(e, tuple):
        return ({e[1]} if len(e) == 2 and e[0] == "name" and isinstance(e[1], str) else set()).union(*map(_names, e))
    return set()


def _batched(df: DataFrame, source: str, name: str, bind: Callable[[dict], Mapping[str, Any]], keep_only: bool, native: Column | None = None) -> DataFrame:
    """Through the evaluator: rows travel as JSON in Arrow batches, results come back as JSON; rows that ``native`` answers don't travel."""


    program = parse(source)

    @F.pandas_udf(T.StringType())
    def run(rows: pd.Series) -> pd.Series:
        ev = Evaluator()
        return pd.Series([None if r is None else json.dumps(to_json(ev.run(program, {k: from_json(v) for k, v in bind(json.loads(r)).items()})), sort_keys=True, ensure_ascii=False) for r in rows], dtype=object)

    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    if native is not None:
        return df.withColumn(name, F.coalesce(native, run(F.when(native.isNull(), row))))
    made = df.withColumn(name, run(row))
    return made.where(F.col(name) == "true").drop(name) if keep_only else made


def map_rows(df: DataFrame, source: str, name: str = "value") -> DataFrame:
    """Evaluate an expression per row, its columns bound by name; the result is JSON text.

    Only columns that the program mentions are read; what it does to whole
    numbers, texts and booleans runs as Spark expressions, the rest, and rows
    with nulls, through the evaluator.
    """
    program = parse(source)
    names = _names(program)
    used = df.select(*[F.col(f"`{c}`") for c in df.columns if c in names] or [F.lit(None).alias("__none")])
    native = _native(used, program)
    return _batched(used, source, name, lambda row: row, False, native).select(name)


def filter_rows(df: DataFrame, source: str) -> DataFrame:
    """Rows for which the predicate is true; anything but a boolean is no match.

    The row is bound to ``_`` as a product.  Where the predicate compiles and
    its columns aren't null it is a plain filter that reaches the scan.
    """
    e = parse_expr(source)
    row = T.StructType(df.schema.fields)
    env = {"_": (F.struct(*[F.col(f"`{c}`") for c in df.columns]), row)}
    try:
        test, kind = to_column(e, env)
    except NotCompiled:
        wrap = lambda r: {"_": {"$type": "prod", "$fields": r}}
        return _batched(df, source, "__keep", wrap, True)
    if not isinstance(kind, T.BooleanType):
        return df.limit(0)
    for c in _nulls(e, env):
        test = test & c.isNotNull()
    return df.where(F.coalesce(test, F.lit(False)))


def to_filter(source: str):
    """A predicate over ``_`` as a portable filter, if it only compares paths with literals."""
    from larkspan.plans import predicates as P
    from larkspan.plans.dialects import Filter

    def path(e: tuple) -> str:
        match e:
            case ("select", ("name", "_"), name, _):
                return name
            case ("select", inner, name, _):
                return f"{path(inner)}.{name}"
            case ("call", ("name", "getPath"), (("name", "_"), ("items", "seq", parts))):
                return ".".join(p[1] for p in parts)
        raise StaticError("not_portable", pretty(e))

    def operand(e: tuple) -> P.Operand:
        if e[0] == "lit":
            v = e[1]
            return P.Lit(int(v) if isinstance(v, Fraction) and v.denominator == 1 else float(v) if isinstance(v, Fraction) else v)
        if e[0] == "some":
            return operand(e[1])
        return P.Path(path(e))

    def walk(e: tuple) -> P.Predicate:
        match e:
            case ("bin", ("and" | "or") as op, a, b):
                return (P.And if op == "and" else P.Or)((walk(a), walk(b)))
            case ("un", "not", a):
                return P.Not(walk(a))
            case ("bin", ("=" | "!=" | "<" | "<=" | ">" | ">=") as op, a, b):
                return P.Compare({"=": "eq", "!=": "ne", "<": "lt", "<=": "lte", ">": "gt", ">=": "gte"}[op], operand(a), operand(b))
            case ("call", ("name", "startsWith"), (a, b)):
                return P.StartsWith(P.Path(path(a)), operand(b))
            case ("call", ("name", "strContains"), (a, b)):
                return P.Contains(P.Path(path(a)), operand(b))
            case ("lit", bool() as v):
                return P.Const(v)
        raise StaticError("not_portable", pretty(e))

    return Filter(walk(parse_expr(source)))


def filter_to_text(p: Any) -> str:
    """A filter as algebra text over ``_``: for explanation, and as an oracle in tests."""
    from larkspan.plans import predicates as P

    def get(x: Any) -> str:
        if isinstance(x, P.Path):
            return f"getPath(_, Seq[{', '.join(json.dumps(s) for s in x.name.split('.'))}])"
        v = x.value
        return f"Some({json.dumps(v) if not isinstance(v, tuple) else 'Seq[' + ', '.join(map(json.dumps, v)) + ']'})"

    def num(x: Any) -> str:
        return get(x)

    match p:
        case P.Const(v):
            return "true" if v else "false"
        case P.And(parts) | P.Or(parts):
            word = " and " if isinstance(p, P.And) else " or "
            return "(" + word.join(map(filter_to_text, parts)) + ")" if parts else ("true" if word == " and " else "false")
        case P.Not(part):
            return f"(not {filter_to_text(part)})"
        case P.Compare("eq", a, b):
            return f"({num(a)} = {num(b)})"
        case P.Compare("ne", a, b):
            return f"({num(a)} != {num(b)})"
        case P.In(a, values, False):
            return "(" + " or ".join(f"({get(a)} = {get(v)})" for v in values) + ")" if values else "false"
        case P.Test("present" | "missing" as op, path):
            return f"({get(path)} {'!=' if op == 'present' else '='} None)"
    raise StaticError("not_expressible", repr(p))


def stream(text: str) -> Iterator[tuple[str, str]]:
    """The tokens of a text, for tools."""
    yield from _Parser(text).toks[:-1]

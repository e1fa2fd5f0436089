"""The query language's text form: tokenizer and recursive-descent parser."""

from __future__ import annotations

import re
from dataclasses import dataclass

from larkspan.errors import StaticError
from larkspan.plans import predicates as P
from larkspan.plans.query import AGGREGATES, Aggregate, Budget, Enrich, Item, OrderTerm, Plan, Step, Where, Within

_MAX_SOURCE = 1 << 20
_TOKEN = re.compile(
    r"""\s+|--[^\n]*|(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<num>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<name>[$]?[A-Za-z_][A-Za-z0-9_]*)|(?P<op><>|!=|<=|>=|[=<>(){}\[\],:.])""",
    re.X,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_REFUSED = {"at": "direct_access", "access": "direct_access", "rank": "direct_access", "after": "continuation_is_a_run_option"}


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int


def tokens(source: str) -> list[Token]:
    if len(source.encode()) > _MAX_SOURCE:
        raise StaticError("source_too_large")
    out, at = [], 0
    while at < len(source):
        m = _TOKEN.match(source, at)
        if m is None:
            raise StaticError("bad_character", f"{source[at]!r} at {at}")
        if m.lastgroup:
            text = m.group()
            if m.lastgroup == "str":
                text = re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), text[1:-1], flags=re.S)
            out.append(Token(m.lastgroup, text, at))
        at = m.end()
    return [*out, Token("end", "", len(source))]


class _Reader:
    def __init__(self, source: str) -> None:
        self.tokens, self.at = tokens(source), 0

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def peek(self, n: int = 1) -> Token:
        return self.tokens[min(self.at + n, len(self.tokens) - 1)]

    def word(self, *words: str) -> bool:
        """Whether the next words are these."""
        return all((t := self.peek(i)).kind == "name" and t.text.lower() == w for i, w in enumerate(words))

    def take(self, *words: str) -> bool:
        if self.word(*words):
            self.at += len(words)
            return True
        return False

    def op(self, text: str) -> bool:
        if self.now.kind == "op" and self.now.text == text:
            self.at += 1
            return True
        return False

    def fail(self, wanted: str) -> StaticError:
        return StaticError("syntax", f"expected {wanted} at {self.now.at}, found {self.now.text or 'the end'!r}")

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise self.fail(" ".join(words))

    def need_op(self, text: str) -> None:
        if not self.op(text):
            raise self.fail(text)

    def name(self) -> str:
        if self.now.kind != "name" or self.now.text.startswith("$"):
            raise self.fail("a name")
        self.at += 1
        return self.tokens[self.at - 1].text

    def source(self) -> str:
        if self.now.kind == "str":
            self.at += 1
            return self.tokens[self.at - 1].text
        return self.name()

    def path(self) -> str:
        if self.now.kind == "name" and self.now.text == "$key":
            self.at += 1
            return "$key"
        parts = [self.name()]
        while self.op("."):
            parts.append(self.name())
        return ".".join(parts)

    def whole(self) -> int:
        if self.now.kind != "num" or not self.now.text.isdigit():
            raise self.fail("a number")
        self.at += 1
        return int(self.tokens[self.at - 1].text)


class _Parser(_Reader):
    # predicates

    def predicate(self) -> P.Predicate:
        parts = [self._and()]
        while self.take("or"):
            parts.append(self._and())
        return parts[0] if len(parts) == 1 else P.Or(tuple(parts))

    def _and(self) -> P.Predicate:
        parts = [self._not()]
        while self.take("and"):
            parts.append(self._not())
        return parts[0] if len(parts) == 1 else P.And(tuple(parts))

    def _not(self) -> P.Predicate:
        if self.take("not"):
            return P.Not(self._not())
        if self.op("("):
            inner = self.predicate()
            self.need_op(")")
            return inner
        return self._leaf()

    def _leaf(self) -> P.Predicate:
        nxt = self.peek()
        if self.now.kind == "name" and nxt.text == "(" and (fn := self.now.text.lower()) in ("present", "missing", "starts_with", "contains"):
            self.at += 2
            path = P.Path(self.path())
            if fn in ("present", "missing"):
                self.need_op(")")
                return P.Test(fn, path)
            self.need_op(",")
            value = self.operand()
            self.need_op(")")
            return P.StartsWith(path, value) if fn == "starts_with" else P.Contains(path, value)
        if self.word("true") or self.word("false"):
            follows = self.peek()
            if not (follows.kind == "op" and follows.text in ("=", "!=", "<>", "<", "<=", ">", ">=")):
                return P.Const(self._bool())
        left = self.operand()
        if self.take("is", "not", "null"):
            return self._null(left, "is_not_null")
        if self.take("is", "null"):
            return self._null(left, "is_null")
        if self.take("contains"):
            if not isinstance(left, P.Path):
                raise self.fail("a path before contains")
            return P.Contains(left, self.operand())
        negated = self.take("not", "in")
        if negated or self.take("in"):
            if isinstance(self.now, Token) and self.now.kind == "name" and self.now.text.startswith("$"):
                raise StaticError("list_parameter_in", "spell the list out")
            self.need_op("[")
            values: list[P.Operand] = []
            while not self.op("]"):
                values.append(self.operand())
                if not self.op(","):
                    self.need_op("]")
                    break
            return P.In(left, tuple(values), negated)
        ops = {"=": "eq", "!=": "ne", "<>": "ne", "<": "lt", "<=": "lte", ">": "gt", ">=": "gte"}
        if self.now.kind != "op" or self.now.text not in ops:
            raise self.fail("a comparison")
        self.at += 1
        return P.Compare(ops[self.tokens[self.at - 1].text], left, self.operand())

    def _null(self, left: P.Operand, op: str) -> P.Predicate:
        if not isinstance(left, P.Path):
            raise self.fail("a path before is null")
        return P.Test(op, left)

    def _bool(self) -> bool:
        self.at += 1
        return self.tokens[self.at - 1].text.lower() == "true"

    def operand(self) -> P.Operand:
        t = self.now
        if t.kind == "str":
            self.at += 1
            return P.Lit(t.text)
        if t.kind == "num":
            self.at += 1
            return P.Lit(int(t.text) if re.fullmatch(r"-?\d+", t.text) else float(t.text))
        if t.kind == "op" and t.text == "[":
            self.at += 1
            values = []
            while not self.op("]"):
                x = self.operand()
                if not isinstance(x, P.Lit):
                    raise self.fail("a literal")
                values.append(x.value)
                if not self.op(","):
                    self.need_op("]")
                    break
            return P.Lit(tuple(values))
        if t.kind == "name":
            if t.text.startswith("$") and t.text != "$key":
                self.at += 1
                return P.Param(t.text[1:])
            if t.text.lower() in ("true", "false", "null") and self.peek().text != ".":
                self.at += 1
                return P.Lit({"true": True, "false": False, "null": None}[t.text.lower()])
            return P.Path(self.path())
        raise self.fail("a value")

    # clauses

    def steps(self, end: str | None) -> list[Step]:
        out: list[Step] = []
        while True:
            if self.take("where"):
                out.append(Where(self.predicate()))
            elif self.word("enrich"):
                out.append(self._enrich())
            elif self.take("within"):
                path = self.path()
                alias = self.name() if self.take("as") else None
                self.need_op("{")
                inner = self.steps("}")
                self.need_op("}")
                out.append(Within(path, alias, tuple(inner)))
            else:
                return out

    def _enrich(self) -> Enrich:
        self.need("enrich")
        name = self.name()
        if self.take("from"):  # the short spelling
            source = self.source()
            alias = self.name() if self.take("as") else None
            self.need("on")
            a = self.path()
            self.need_op("=")
            b = self.path()
            cut = lambda p, x: p[len(x) + 1 :] if x and p.startswith(x + ".") else p
            left, right = (a, b)
            if a.split(".")[0] in (source, alias) and b.split(".")[0] not in (source, alias):
                left, right = b, a
            right = cut(cut(right, source), alias or "")
            left = left.split(".", 1)[1] if "." in left and left.split(".")[0] == self.root else left
            where = self.predicate() if self.take("where") else None
            self.take("expect")
            return Enrich(name, source, alias, left, right, self._cardinality(), where)
        self.need("using")
        source = self.source()
        alias = self.name() if self.take("as") else None
        self.need("matching")
        left = self.path()
        self.need_op("=")
        right = self.path()
        if alias and right.startswith(alias + "."):
            right = right[len(alias) + 1 :]
        where = self.predicate() if self.take("where") else None
        self.need("expect")
        return Enrich(name, source, alias, left, right, self._cardinality(), where)

    def _cardinality(self) -> str:
        for c in ("exactly_one", "optional", "many"):
            if self.take(c):
                return c
        raise self.fail("exactly_one, optional or many")

    def items(self) -> tuple[Item, ...]:
        out: list[Item] = []
        while not self.op("}"):
            path = self.path()
            if self.op(":"):
                out.append(Item(path, self.path()))
            elif self.op("{"):
                out.append(Item(path.split(".")[-1], path, self.items()))
            else:
                out.append(Item(path.split(".")[-1], path))
            self.op(",")
        return tuple(out)

    def query(self) -> tuple[Plan, bool]:
        explain = self.take("explain")
        self.need("from")
        source = self.source()
        alias = self.name() if self.take("as") else None
        self.root = alias or source
        steps = self.steps(None)
        where: P.Predicate | None = None
        while steps and isinstance(steps[0], Where):
            first = steps.pop(0).predicate
            where = first if where is None else P.And((where, first))
        made: dict = {"source": source, "alias": alias, "where": where, "steps": tuple(steps)}
        seen: set[str] = set()

        def once(key: str) -> None:
            if key in seen:
                raise StaticError("duplicate_clause", key)
            seen.add(key)

        while self.now.kind != "end":
            if self.take("group", "by"):
                once("group")
                paths = [self.path()]
                while self.op(","):
                    paths.append(self.path())
                made["group"] = tuple(paths)
            elif self.take("project"):
                once("project")
                if self.op("{"):
                    made["brace"] = self.items()
                else:
                    self._flat(made)
            elif self.take("order", "by"):
                once("order")
                terms = [self._term()]
                while self.op(","):
                    terms.append(self._term())
                made["order"] = tuple(terms)
            elif self.take("limit"):
                once("limit")
                made["limit"] = self.whole()
            elif self.take("page", "size"):
                once("page size")
                made["page_size"] = self.whole()
            elif self.take("coverage"):
                once("coverage")
                made["allow_incomplete"] = self.take("allow", "incomplete")
                if not made["allow_incomplete"]:
                    self.need("complete")
            elif self.take("consistency"):
                once("consistency")
                made["current"] = self.take("current")
                if not made["current"]:
                    self.need("available")
            elif self.take("budget"):
                once("budget")
                made["budget"] = self._budget()
            elif self.now.kind == "name" and self.now.text.lower() in _REFUSED:
                raise StaticError("not_supported", _REFUSED[self.now.text.lower()])
            else:
                raise self.fail("a clause")
        return Plan(**made).checked(), explain

    def _flat(self, made: dict) -> None:
        bracket = self.op("[")
        paths: list[str] = []
        aggregates: list[Aggregate] = []
        while self.now.kind == "name" or (bracket and not (self.now.kind == "op" and self.now.text == "]")):
            fn = self.now.text.lower()
            if fn in AGGREGATES and self.peek().text == "(":
                self.at += 2
                path = None if fn == "count" else self.path()
                self.need_op(")")
                self.need("as")
                aggregates.append(Aggregate(fn, path, self.name()))
            else:
                paths.append(self.path())
            if not self.op(","):
                break
        if bracket:
            self.need_op("]")
        if aggregates:
            made["aggregates"] = tuple(aggregates)  # a group's row has its keys and aggregates, whatever is listed beside them
        elif "group" not in made:
            made["project"] = tuple(paths)

    def _term(self) -> OrderTerm:
        path = self.path()
        descending = self.take("desc")
        if not descending:
            self.take("asc")
        first = False
        if self.take("nulls") or self.take("missing"):
            first = self.take("first")
            if not first:
                self.need("last")
        return OrderTerm(path, descending, first)

    def _budget(self) -> Budget:
        self.need_op("{")
        found: dict[str, int] = {}
        while not self.op("}"):
            key = self.name()
            if key not in ("documents", "bytes", "result_bytes") or key in found:
                raise StaticError("bad_budget", key)
            self.need_op(":")
            found[key] = self.whole()
            self.op(",")
        return Budget(**found)


def parse(source: str) -> Plan:
    """The plan of a query text."""
    return _Parser(source).query()[0]


def parse_with_explain(source: str) -> tuple[Plan, bool]:
    return _Parser(source).query()


def parse_predicate(source: str) -> P.Predicate:
    reader = _Parser(source)
    reader.root = ""
    found = reader.predicate()
    if reader.now.kind != "end":
        raise reader.fail("the end")
    return found

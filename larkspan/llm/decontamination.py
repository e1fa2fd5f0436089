"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of e edits is cut into e + 1 pieces: whatever
the edits, one piece survives whole.  One automaton over the pieces of all
items finds the surviving pieces in a text; around each hit, Myers' bit-parallel
algorithm decides whether the whole item is there within its budget.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import durable, filter_slices, id_and_text, map_slices

#: Edits allowed, as a share of an item's characters.
MAX_ERROR_RATE = 0.08
#: Characters of items whose automaton one pass over the documents carries.
BLOCK_CHARS = 4_000_000


def normalise(text: str) -> str:
    """Lower case, every run of white space one space."""
    return " ".join(text.lower().split())


class Pattern:
    """An item with its bit vectors."""

    def __init__(self, item: object, text: str, rate: float) -> None:
        self.item, self.text, self.size = item, text, len(text)
        self.budget = int(rate * len(text))
        self.peq = _peq(text)
        self.back: dict[str, int] | None = None

    def pieces(self) -> Iterator[tuple[str, int, int]]:
        k = self.budget + 1
        for j in range(k):
            a, b = j * self.size // k, (j + 1) * self.size // k
            yield self.text[a:b], a, b

    def find(self, text: str, start: int, stop: int) -> tuple[int, int, int] | None:
        """The best place in text[start:stop]: (distance, begin, end), if within budget."""
        distance, end = _myers(self.peq, self.size, text[start:stop])
        if distance > self.budget:
            return None
        end += start
        if self.back is None:
            self.back = _peq(self.text[::-1])
        low = max(start, end - self.size - self.budget)
        _, length = _myers(self.back, self.size, text[low:end][::-1], anchored=True)
        return distance, end - length, end


def _peq(text: str) -> dict[str, int]:
    found: dict[str, int] = {}
    for i, ch in enumerate(text):
        found[ch] = found.get(ch, 0) | 1 << i
    return found


def _myers(peq: dict[str, int], m: int, text: str, anchored: bool = False) -> tuple[int, int]:
    """Least edit distance of the pattern to a substring of ``text`` (``anchored``:
    to a prefix), and the first end where it is reached."""
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = mask, 0, m
    best, at = m, 0
    carry = 1 if anchored else 0
    for i, ch in enumerate(text, 1):
        eq = peq.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = (mv | ~(xh | pv)) & mask
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        if score < best:
            best, at = score, i
        ph = ph << 1 | carry
        mh <<= 1
        pv = (mh | ~(xv | ph)) & mask
        mv = ph & xv & mask
    return best, at


class Matcher:
    """All items at once."""

    def __init__(self, items: list[tuple[object, str]], rate: float = MAX_ERROR_RATE) -> None:
        import ahocorasick

        self.patterns = [Pattern(i, n, rate) for i, t in items if (n := normalise(t or ""))]
        where: dict[str, list[tuple[int, int, int]]] = {}
        for k, p in enumerate(self.patterns):
            for piece, a, b in p.pieces():
                where.setdefault(piece, []).append((k, a, b))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, places)
        if where:
            self.automaton.make_automaton()
        self.empty = not where

    def matches(self, text: str) -> list[tuple[object, int, int, int]]:
        """(item, distance, begin, end) in the normalised text: the best place of each item, of equally good ones the first."""
        if self.empty or not text:
            return []
        text = normalise(text)
        tried: set[tuple[int, int]] = set()
        found: dict[int, tuple[int, int, int]] = {}
        for end, places in self.automaton.iter(text):
            for k, a, b in places:
                at = end + 1 - b  # where the item would begin without edits
                if (k, at) in tried:
                    continue
                tried.add((k, at))
                p = self.patterns[k]
                known = found.get(k)
                if known is not None and known[0] == 0 and known[1] <= at:
                    continue
                hit = p.find(text, max(0, at - p.budget), min(len(text), at + p.size + p.budget))
                if hit is not None and (known is None or hit < known):
                    found[k] = hit
        return [(self.patterns[k].item, *hit) for k, hit in found.items()]


def _blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[object, str]]]:
    """The items, at most ``BLOCK_CHARS`` characters (or one item) at a time."""
    block: list[tuple[object, str]] = []
    held = 0
    for row in items.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).where(F.col("t").isNotNull()).orderBy("i", "t").toLocalIterator():
        if block and held + len(row.t) > BLOCK_CHARS:
            yield block
            block, held = [], 0
        block.append((row.i, row.t))
        held += len(row.t)
    if block:
        yield block


def contamination(docs: DataFrame, items: DataFrame, rate: float = MAX_ERROR_RATE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, contaminated, matches.

    ``matches`` lists each item found within ``floor(rate * characters)``
    edits, both sides in lower case with single spaces: its item_id, distance,
    and the begin and end of its best place in the text so normalised.
    Null or empty texts and items match nothing; without items no document is
    contaminated.  Null ids and repeated rows are kept, other columns ignored.
    Items beyond one automaton's size are matched in blocks, each against all
    documents.
    """
    kind = dict(docs.select(F.col(id_col).alias("doc_id")).dtypes)["doc_id"]
    of = dict(items.select(F.col(item_col).alias("i")).dtypes)["i"]
    schema = f"doc_id {kind}"
    rows = id_and_text(docs, id_col, text_col)
    blocks = _blocks(items, item_col, item_text_col)
    block, more = next(blocks, []), next(blocks, None)
    if more is None:
        found = _scan(rows, block, rate, schema, of)[0]
    else:
        numbered = _numbered(rows)
        found = numbered.select("row", "doc_id").join(_hits(numbered, chain([block, more], blocks), rate, of), "row", "left").withColumn("matches", F.coalesce("matches", F.array()))
    return found.select("doc_id", (F.size("matches") > 0).alias("contaminated"), F.array_sort("matches").alias("matches"))


def _scan(rows: DataFrame, block: list[tuple[object, str]], rate: float, schema: str, of: str) -> tuple[DataFrame, Broadcast]:
    """The first column of ``rows``, and the matches of the texts in the second; and what the executors are sent for it."""
    shared = rows.sparkSession.sparkContext.broadcast(pickle.dumps(block))
    name = rows.columns[0]

    def each():
        matcher = Matcher(pickle.loads(shared.value), rate)

        def step(part: pa.RecordBatch) -> dict:
            found = [matcher.matches(t) for t in part.column(1).to_pylist()]
            return {name: part.column(0), "matches": [[{"item_id": i, "distance": d, "begin": a, "end": b} for i, d, a, b in m] for m in found]}

        return step

    return map_slices(rows, f"{schema}, matches array<struct<item_id:{of},distance:int,begin:int,end:int>>", each), shared


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with numbers that every scan sees alike; ids may be null or repeated."""
    return durable(rows.withColumn("row", F.monotonically_increasing_id()))


def _hits(numbered: DataFrame, blocks: Iterable[list[tuple[object, str]]], rate: float, of: str) -> DataFrame:
    """(row, matches) of the rows in which an item of any block is found.

    Blocks are scanned one after the other, and each one's items leave the
    driver and the executors before the next ones come.
    """
    scans = []
    for block in blocks:
        found, shared = _scan(numbered.select("row", "text"), block, rate, "row long", of)
        scans.append(durable(found.where(F.size("matches") > 0)))
        shared.destroy()
    return reduce(DataFrame.unionAll, scans).groupBy("row").agg(F.flatten(F.collect_list("matches")).alias("matches"))


def without_contaminated(docs: DataFrame, items: DataFrame, rate: float = MAX_ERROR_RATE, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents, all columns kept, in which no item is found."""
    blocks = _blocks(items, item_col, item_text_col)
    block, more = next(blocks, []), next(blocks, None)
    if more is not None:
        of = dict(items.select(F.col(item_col).alias("i")).dtypes)["i"]
        numbered = _numbered(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("all"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
        return numbered.join(_hits(numbered, chain([block, more], blocks), rate, of), "row", "left_anti").select("all.*")
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(block))

    def each():
        matcher = Matcher(pickle.loads(shared.value), rate)
        return lambda texts: [not matcher.matches(t or "") for t in texts]

    return filter_slices(docs, text_col, each)

"""Token counts by a map-side two-tier lookup.

A text's token count is the sum of its pre-tokens' token counts, because the
tokenizer never merges across pre-tokens.  Tier one is a broadcast table of the
corpus's frequent pre-tokens and their lengths, found by one pass of bounded
per-partition summaries over *all* documents.  Tier two is a bounded cache in
each Python worker, filled by encoding the pre-tokens tier one misses.  No
pre-token is ever shuffled: only the summaries (at most ``table_size`` entries
each) travel, in a merge tree of fixed fan-in.
"""

from __future__ import annotations

import json
import pickle
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import MAX_BROADCAST_BYTES, id_and_text, map_slices, slices

#: Frequent pre-tokens in the broadcast table.
TABLE_SIZE = 32_768
#: Pre-tokens a worker keeps beyond them.
CACHE_SIZE = 400_000
#: Summaries merged by one task of the tree.
FAN_IN = 32
#: Longer pre-tokens are encoded but not kept.
KEPT_CHARS = 64

def fast_pattern() -> re.Pattern:
    """The byte-level pre-token pattern over Latin-1, for ``re``.

    Letters come first: no other alternative starts with one, so the order
    between them is free, and possessive repeats never backtrack.
    """
    kinds = [unicodedata.category(chr(c))[0] for c in range(256)]
    letters, numbers = ("".join(re.escape(chr(c)) for c in range(256) if kinds[c] == k) for k in "LN")
    space = " \\t\\n\\r\xa0"
    return re.compile(rf" ?[{letters}]++|'(?:s|t|re|ve|m|ll|d)| ?[{numbers}]++| ?[^{space}{letters}{numbers}]++|[{space}]+(?![^{space}])|[{space}]+")


#: Characters outside what ``fast_pattern`` covers.
_OTHER = re.compile("[^\t\n\r -~\xa0-\xff]")


def byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies spell the 256 bytes."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def load(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class PreTokens:
    """Splits texts into pre-tokens, or says that the library has to count."""

    def __init__(self, path: str, tokenizer=None) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
        self.plain = plain and spec.get("normalizer") is None and spec.get("post_processor") is None
        added = [re.escape(x["content"]) for x in spec.get("added_tokens", [])]
        self.added = re.compile("|".join(added)) if added else None
        self.findall = fast_pattern().findall
        self.library = (tokenizer or load(path)).pre_tokenizer

    def split(self, text: str) -> list[str] | None:
        """Pre-tokens of ``text``; None where it holds an added token, or the
        tokenizer is of another kind."""
        if not self.plain or (self.added and self.added.search(text)):
            return None
        if _OTHER.search(text):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
        return self.findall(text)


class TwoTier(dict):
    """Lengths of pre-tokens: the broadcast ones, and a bounded cache."""

    def __init__(self, frequent: dict[str, int], tokenizer, cache_size: int = CACHE_SIZE) -> None:
        super().__init__(frequent)
        self.frequent, self.limit = frequent, len(frequent) + cache_size
        self.model, self.letters = tokenizer.model, byte_letters()

    def __missing__(self, pre_token: str) -> int:
        n = len(self.model.tokenize(pre_token.encode().decode("latin-1").translate(self.letters)))
        if len(pre_token) <= KEPT_CHARS:
            if len(self) >= self.limit:
                self.clear()
                self.update(self.frequent)
            self[pre_token] = n
        return n

    def count(self, pre_tokens: list[str]) -> int:
        return sum(map(self.__getitem__, pre_tokens))


def _summaries(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for part in slices(batches):
            for text in part.column(0).to_pylist():
                counts.update(text.split())
            if len(counts) > 16 * size:  # lossy: what is rare so far starts anew
                counts = Counter(dict(counts.most_common(4 * size)))
        top = {k: v for k, v in counts.most_common(size) if len(k) < KEPT_CHARS}
        yield pa.RecordBatch.from_pydict({"summary": pa.array([pickle.dumps(top)], pa.binary())})

    return run


def _merge(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for blob in batch.column(0):
                counts.update(pickle.loads(blob.as_py()))
                if len(counts) > 16 * size:
                    counts = Counter(dict(counts.most_common(4 * size)))
        yield pa.RecordBatch.from_pydict({"summary": pa.array([pickle.dumps(dict(counts.most_common(size)))], pa.binary())})

    return run


def frequent_lengths(docs: DataFrame, path: str, text_col: str = "text", table_size: int = TABLE_SIZE) -> dict[str, int]:
    """The pre-tokens of the corpus's most frequent words, with their token counts.

    The table only decides which lookups are cheap: counts are exact with any
    table, also an empty one.
    """
    found = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    per_partition = max(512, table_size // 8)
    parts = found.mapInArrow(_summaries(per_partition), "summary binary")
    n = found.rdd.getNumPartitions()
    while n > 1:
        n = -(-n // FAN_IN)
        parts = parts.repartition(n).mapInArrow(_merge(table_size), "summary binary")
    tokenizer = load(path)
    pre, counts = PreTokens(path, tokenizer), Counter()
    for row in parts.collect():  # one row
        for word, n in pickle.loads(row[0]).items():
            for found in pre.split(f" {word}") or []:
                counts[found] += n
    table = TwoTier({}, tokenizer)
    return {k: table[k] for k, _ in counts.most_common(table_size)}


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", table_size: int = TABLE_SIZE) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    ``n_tokens`` is what the tokenizer of ``path`` gives for the whole text
    without added special tokens; special strings inside a text count as the
    library treats them by default.  A null or empty text has 0 bytes and 0
    tokens.  A null id is kept.  Repeated rows give repeated results, an empty
    table an empty one; other columns are ignored, whatever their names.
    """
    frequent = frequent_lengths(docs, path, text_col, table_size) if table_size else {}
    blob = pickle.dumps(frequent)
    if len(blob) > MAX_BROADCAST_BYTES:
        raise ValueError(f"the table of frequent pre-tokens has {len(blob)} bytes")
    shared = docs.sparkSession.sparkContext.broadcast(blob)

    def each():
        tokenizer = load(path)
        pre, table = PreTokens(path, tokenizer), TwoTier(pickle.loads(shared.value), tokenizer)

        def step(part: pa.RecordBatch) -> dict:
            texts = part.column(1).to_pylist()
            split = map(pre.split, texts)
            counts = [len(tokenizer.encode(t, add_special_tokens=False).ids) if s is None else table.count(s) for t, s in zip(texts, split)]
            return {"doc_id": part.column(0), "n_bytes": pc.cast(pc.binary_length(part.column(1)), pa.int64()), "n_tokens": counts, "over_limit": [n > limit for n in counts]}

        return step

    kind = dict(docs.select(F.col(id_col).alias("doc_id")).dtypes)["doc_id"]
    return map_slices(id_and_text(docs, id_col, text_col), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean", each)

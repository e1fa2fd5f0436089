"""SentencePiece encoding and decoding with an Aho-Corasick automaton.

One automaton over all pieces reads a text once.  At every position its output
links enumerate the pieces that end there, longest first, and each of them
relaxes the best state of that position.  What "best" is depends on the model:

* unigram models: the largest sum of piece scores (Viterbi);
* BPE models: the piece that may follow the best encoding of what is before
  it.  The maximum of score sums is *not* the encoding of a BPE model, whose
  scores are merge priorities; but a sequence of pieces is a text's BPE
  encoding exactly if every piece encodes to itself and every two neighbours
  encode to themselves together, so each prefix has one last piece, found by
  the same single pass.

No piece goes from a non-blank to a blank, so a text's words, each with the
blanks before it, are encoded on their own, and a bounded cache in each worker
serves the frequent ones.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import MAX_BROADCAST_BYTES, id_and_text, map_slices

BLANK = "▁"
#: Words a worker keeps.
CACHE_SIZE = 1_000_000
KEPT_CHARS = 48
#: Transitions that an automaton adds to its first ones.
MOST_MOVES = 2_000_000
#: Neighbour checks a worker keeps.
PAIR_CACHE = 1_000_000
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol buffer message: (number, int or bytes)."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + n]
            at += n


class Model:
    """Pieces, scores and settings of a SentencePiece model file."""

    def __init__(self, data: bytes) -> None:
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.algorithm, self.fallback, self.prefix, self.collapse, self.escape, self.charsmap = UNIGRAM, False, True, True, True, b""
        for number, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                self.pieces.append(piece)
                self.scores.append(score)
                self.kinds.append(kind)
            elif number == 2:
                for n, v in _fields(value):
                    if n == 3:
                        self.algorithm = v
                    elif n == 35:
                        self.fallback = bool(v)
            elif number == 3:
                for n, v in _fields(value):
                    if n == 2:
                        self.charsmap = v
                    elif n == 3:
                        self.prefix = bool(v)
                    elif n == 4:
                        self.collapse = bool(v)
                    elif n == 5:
                        self.escape = bool(v)
        self.bytes = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)
        if self.charsmap or self.collapse or not self.escape or USER_DEFINED in self.kinds or self.algorithm not in (UNIGRAM, BPE):
            raise ValueError("only models without own normalisation rules or user-defined pieces are supported")

    @classmethod
    def load(cls, path: str) -> Model:
        with open(path, "rb") as f:
            return cls(f.read())


class Automaton:
    """Aho-Corasick automaton over pieces, completed lazily into one dict a state."""

    def __init__(self, pieces: dict[str, int]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.fail: list[int] = [0]
        #: Per state the pieces that end in it, longest first: what its output links lead to.
        self.outputs: list[tuple[tuple[int, int], ...]] = [()]
        self.added = 0
        for text, i in pieces.items():
            s = 0
            for ch in text:
                if ch not in self.next[s]:
                    self.next[s][ch] = len(self.next)
                    self.next.append({})
                    self.fail.append(0)
                    self.outputs.append(())
                s = self.next[s][ch]
            self.outputs[s] = ((i, len(text)),)
        queue = list(self.next[0].values())
        for s in queue:  # in order of depth
            self.outputs[s] += self.outputs[self.fail[s]]
            for ch, t in self.next[s].items():
                f = self.fail[s]
                while f and ch not in self.next[f]:
                    f = self.fail[f]
                self.fail[t] = self.next[f].get(ch, 0)
                queue.append(t)

    def step(self, state: int, ch: str) -> int:
        at = state
        while True:
            found = self.next[at].get(ch)
            if found is not None:
                break
            if not at:
                found = 0
                break
            at = self.fail[at]
        if at != state and self.added < MOST_MOVES:
            self.next[state][ch] = found  # the way round by the failure links is gone once
            self.added += 1
        return found


class Words(dict):
    """Encodings of words that follow ``before``, as packed ids; bounded."""

    def __init__(self, encoder: Encoder, before: str) -> None:
        super().__init__()
        self.encoder, self.before = encoder, before

    def __missing__(self, word: str) -> bytes:
        found = np.array(self.encoder._word(self.before + word), np.int32).tobytes()
        if len(word) <= KEPT_CHARS:
            if len(self) >= self.encoder.cache_size:
                self.clear()
            self[word] = found
        return found

    def __reduce__(self):
        return dict, ()


class Encoder:
    """Encodes and decodes texts; ``encode`` gives what the sentencepiece library gives."""

    def __init__(self, model: Model, cache_size: int = CACHE_SIZE, usable: dict[str, int] | None = None) -> None:
        self.model, self.cache_size = model, cache_size
        self.of = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k in (NORMAL, UNUSED) and p}
        self.bpe = model.algorithm == BPE
        self.score = model.scores
        self.lowest = min((s for s, k in zip(model.scores, model.kinds) if k == NORMAL), default=0.0) - 10.0
        self.apart = not any(BLANK in p.lstrip(BLANK) for p in self.of)
        self.words = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+", re.S).findall if self.apart else (lambda text: [text] if text else [])
        self.usable = {p: i for p, i in self.of.items() if self._stands(p, i)} if usable is None else usable
        self.automaton = Automaton(self.usable)
        self.pairs: dict[int, bool] = {}
        self.traces: dict[tuple[int, bool], list[tuple[float, str | None]]] = {}
        # A line feed without a piece of its own merges with nothing: lines can be told apart.
        self.lines = self.apart and model.prefix and model.fallback and not any("\n" in p for p in self.of)
        self.after = Words(self, BLANK)  # words after a blank
        self.bare = Words(self, "")
        self.feed = np.array([model.bytes.get(10, 0)], np.int32).tobytes()
        self.texts = [("" if k == CONTROL else " \u2047 " if k == UNKNOWN else p.replace(BLANK, " ") if k != BYTE else chr(int(p[1:-1], 16))) for p, k in zip(model.pieces, model.kinds)]
        self.high = np.zeros(len(model.pieces), bool)  # bytes that are no character alone
        self.high[[i for b, i in model.bytes.items() if b > 127]] = True

    def _stands(self, piece: str, i: int) -> bool:
        return self.model.kinds[i] == NORMAL and (not self.bpe or self._merge(piece) == [piece])

    def _merge(self, text: str) -> list[str]:
        """BPE by its definition: merge the best-scored pair, the leftmost of equals, until none is left."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.score[i], -k) for k in range(len(parts) - 1) if (i := self.of.get(parts[k] + parts[k + 1])) is not None), default=None)
            if best is None:
                break
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _trace(self, i: int, left: bool) -> list[tuple[float, str | None]]:
        """How piece ``i`` builds itself from characters, in order: each merge's
        score, and its outermost part on the side of the neighbour if that changed."""
        key = (i, left)
        found = self.traces.get(key)
        if found is None:
            parts = list(self.model.pieces[i])
            found = [(0.0, parts[-1] if left else parts[0])]
            while len(parts) > 1:
                score, k = max((self.score[j], -k) for k in range(len(parts) - 1) if (j := self.of.get(parts[k] + parts[k + 1])) is not None)
                parts[-k : 2 - k] = [parts[-k] + parts[1 - k]]
                outer = parts[-1] if left else parts[0]
                found.append((score, outer if (-k == len(parts) - 1 if left else k == 0) else None))
            self.traces[key] = found
        return found

    def _neighbours(self, a: int, b: int) -> bool:
        """Whether pieces ``a`` and ``b`` in a row encode to themselves.

        Both build themselves as they would alone unless a merge across the
        border comes first: the three next merges compete by score, the
        leftmost of equals winning.
        """
        key = a << 32 | b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= PAIR_CACHE:
                self.pairs.clear()
            found = self.pairs[key] = self._apart(self._trace(a, True), self._trace(b, False))
        return found

    def _apart(self, left: list[tuple[float, str | None]], right: list[tuple[float, str | None]]) -> bool:
        i = j = 1
        x, y, of, score = left[0][1], right[0][1], self.of, self.score
        across = of.get(x + y)
        while i < len(left) or j < len(right):
            l, r = left[i][0] if i < len(left) else None, right[j][0] if j < len(right) else None
            c = None if across is None else score[across]
            if l is not None and (r is None or l >= r) and (c is None or l >= c):
                outer, i = left[i][1], i + 1
                if outer is not None:
                    x, across = outer, of.get(outer + y)
            elif c is not None and (r is None or c >= r):
                return False
            else:
                outer, j = right[j][1], j + 1
                if outer is not None:
                    y, across = outer, of.get(x + outer)
        return across is None

    def _word(self, word: str) -> tuple[int, ...]:
        """Encode one word: the single pass over its characters."""
        step, moves, outputs = self.automaton.step, self.automaton.next, self.automaton.outputs
        n = len(word)
        last, size = [-2], [0]  # the best piece that ends here and its length; -2: the start, or a character without a piece
        state = 0
        if self.bpe:
            pairs = self.pairs
            for end, ch in enumerate(word, 1):
                found = moves[state].get(ch)
                state = step(state, ch) if found is None else found
                for p, length in outputs[state]:
                    before = last[end - length]
                    if before < 0 or (fits := pairs.get(before << 32 | p)) or (fits is None and self._neighbours(before, p)):
                        last.append(p)
                        size.append(length)
                        break
                else:
                    last.append(-2)
                    size.append(1)
        else:
            best = [0.0]
            for end, ch in enumerate(word, 1):
                state = step(state, ch)
                top, chosen, width = None, -2, 1
                for p, length in outputs[state]:
                    value = best[end - length] + self.score[p]
                    if top is None or value > top:
                        top, chosen, width = value, p, length
                if ch not in self.usable and (top is None or best[end - 1] + self.lowest > top):
                    top, chosen, width = best[end - 1] + self.lowest, -2, 1
                best.append(top)
                last.append(chosen)
                size.append(width)
        out: list[int] = []
        end = n
        while end:
            if last[end] >= 0:
                out.append(last[end])
            elif self.model.fallback:
                out.extend(self.model.bytes[b] for b in reversed(word[end - 1].encode()))
            elif not out or out[-1] != self.model.unknown or end == n or last[end + 1] != -2:
                out.append(self.model.unknown)
            end -= size[end]
        return tuple(reversed(out))

    def array(self, text: str) -> np.ndarray:
        """The ids of ``text``."""
        if not text:
            return np.zeros(0, np.int32)
        found: list[bytes] = []
        if self.lines and BLANK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            get = self.after.__getitem__
            for k, line in enumerate(text.split("\n")):
                words = line.split(" ")
                if k:
                    found.append(self.feed)
                    found.append(self.bare[words[0]] if words[0] else b"")
                    del words[0]
                found.extend(map(get, words))
        else:
            text = text.replace(" ", BLANK)
            found.extend(map(self.bare.__getitem__, self.words(BLANK + text if self.model.prefix else text)))
        return np.frombuffer(b"".join(found), np.int32)

    def encode(self, text: str) -> list[int]:
        return self.array(text).tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``: bytes joined, blanks restored, the dummy prefix dropped."""
        pieces, kinds = self.model.pieces, self.model.kinds
        if not len(ids):
            return ""
        if not self.high[ids].any():
            text = "".join(map(self.texts.__getitem__, ids))
            return text[1:] if self.model.prefix and text[:1] == " " else text
        out = bytearray()
        for i in ids:
            kind = kinds[i]
            if kind == BYTE:
                out.append(int(pieces[i][1:-1], 16))
            elif kind == UNKNOWN:
                out += " ⁇ ".encode()
            elif kind != CONTROL:
                out += pieces[i].encode()
        text = out.decode("utf-8", "replace").replace(BLANK, " ")
        return text[1:] if self.model.prefix and text[:1] == " " else text


_ENCODERS: dict[str, Encoder] = {}


def _encoder(key: str, shared) -> Encoder:
    """The worker's encoder of this model: its caches serve all tasks of the worker."""
    if key not in _ENCODERS:
        _ENCODERS.clear()
        model, usable = pickle.loads(shared.value)
        _ENCODERS[key] = Encoder(model, usable=usable)
    return _ENCODERS[key]


def _share(docs: DataFrame, path: str) -> tuple[str, object]:
    with open(path, "rb") as f:
        encoder = Encoder(Model(f.read()))
    blob = pickle.dumps((encoder.model, encoder.usable))
    if len(blob) > MAX_BROADCAST_BYTES:
        raise ValueError(f"the model has {len(blob)} bytes")
    return hashlib.sha256(blob).hexdigest(), docs.sparkSession.sparkContext.broadcast(blob)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_pieces, n_byte_pieces, ids, roundtrip, text_sha256.

    ``ids`` are the pieces of the whole text as the library gives them, without
    begin or end; ``roundtrip`` tells whether decoding them gives the text
    again (it does unless the text itself holds U+2581, which decodes to a
    space), ``text_sha256`` is the digest of what they decode to.  A null or
    empty text has no pieces.  Null ids and repeated rows are kept, other
    columns ignored.
    """
    kind = dict(docs.select(F.col(id_col).alias("doc_id")).dtypes)["doc_id"]
    key, shared = _share(docs, path)

    def each():
        encoder = _encoder(key, shared)
        low, high = (min(encoder.model.bytes.values(), default=0), max(encoder.model.bytes.values(), default=-1))

        def step(part: pa.RecordBatch) -> dict:
            texts = part.column(1).to_pylist()
            flat = [encoder.array(t) for t in texts]
            ends = np.cumsum([0, *map(len, flat)])
            backs = [encoder.decode(a.tolist()) for a in flat]
            return {
                "doc_id": part.column(0),
                "n_bytes": pc.cast(pc.binary_length(part.column(1)), pa.int64()),
                "n_pieces": np.diff(ends),
                "n_byte_pieces": [int(((a >= low) & (a <= high)).sum()) for a in flat],
                "ids": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32))),
                "roundtrip": [a == b for a, b in zip(texts, backs)],
                "text_sha256": [hashlib.sha256(b.encode()).hexdigest() for b in backs],
            }

        return step

    return map_slices(id_and_text(docs, id_col, text_col), f"doc_id {kind}, n_bytes long, n_pieces long, n_byte_pieces long, ids array<int>, roundtrip boolean, text_sha256 string", each)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row: doc_id and text.  Null ids decode to a null text, no ids to an empty one."""
    kind = dict(encoded.select(F.col(id_col).alias("doc_id")).dtypes)["doc_id"]
    key, shared = _share(encoded, path)

    def each():
        encoder = _encoder(key, shared)

        def step(part: pa.RecordBatch) -> dict:
            return {"doc_id": part.column(0), "text": [None if ids is None else encoder.decode(ids) for ids in part.column(1).to_pylist()]}

        return step

    rows = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"), F.lit("").alias("text"))
    return map_slices(rows, f"doc_id {kind}, text string", each)

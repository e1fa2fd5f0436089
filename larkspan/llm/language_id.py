"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent layers read a text's UTF-8 bytes in either direction; a
softmax over both states gives a language distribution at *every* position,
and a document's distribution is the mean over all its positions.  The network
is small and is trained in numpy by backpropagation through time, on a bounded
sample of labelled rows; inference runs on the executors over whole texts, cut
into segments that overlap by ``CONTEXT`` bytes on either side so that segments
of many documents advance together, one matrix product a step.
"""

from __future__ import annotations

import pickle
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.llm.common import filter_slices, map_slices

#: Units of each direction.
HIDDEN = 6
#: The bound of the training sample: documents per language, windows of each.
DOCS_PER_LANGUAGE, WINDOWS_PER_DOC = 500, 4
#: Bytes of a training window.
WINDOW = 64
STEPS, BATCH, RATE, SEED = 400, 256, 0.02, 7
#: More labels than this can't be languages.
MOST_LANGUAGES = 512
#: Bytes of a segment, and of the overlap on either side that only warms up the states.
SEGMENT, CONTEXT = 480, 48
#: Segments that advance together.
LANES = 1536
UNDETERMINED = "und"
#: Letters, and numbers that aren't decimal digits.
_LETTERLIKE = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LETTERLIKE.finditer(text))


@dataclass
class Network:
    """Weights; the first axis of ``x``, ``u`` is the direction.

    ``x``: bytes to the three gates (update, reset, new), biases included.
    ``u``: state to the gates.  ``v``, ``b``: both states to the languages.
    """

    languages: list[str]
    x: np.ndarray
    u: np.ndarray
    v: np.ndarray
    b: np.ndarray
    steps: int = field(default=0)


def _soft(a: np.ndarray) -> np.ndarray:
    """The squashing function: as tanh in shape, a fraction of its cost."""
    return a / (1 + np.abs(a))


def _slope(s: np.ndarray) -> np.ndarray:
    """The derivative of ``_soft``, by its value."""
    return (1 - np.abs(s)) ** 2


def _gate(a: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * _soft(a)


def train(windows: dict[str, list[bytes]], hidden: int = HIDDEN, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = SEED, length: int = WINDOW) -> Network:
    """Fit the network to windows of known language (Adam, cross-entropy at every position)."""
    languages = sorted(windows)
    rng = np.random.default_rng(seed)
    h, n = hidden, len(languages)
    net = Network(languages, rng.normal(0, 0.3, (2, 3 * h, 256)), rng.normal(0, 1 / np.sqrt(h), (2, 3 * h, h)), rng.normal(0, 0.3, (2, n, h)), np.zeros((n, 1)))
    if n < 2 or not steps:
        return net
    pools = [[np.frombuffer(w[:length], np.uint8) for w in windows[k] if w] for k in languages]
    names = ("x", "u", "v", "b")
    first, second = ({k: np.zeros_like(getattr(net, k)) for k in names} for _ in range(2))
    for step in range(1, steps + 1):
        labels = rng.integers(0, n, batch)
        rows = [pools[k][rng.integers(len(pools[k]))] for k in labels]
        lens = np.array([len(r) for r in rows])
        data, mask = np.zeros((length, batch), np.intp), np.arange(length)[:, None] < lens
        for i, r in enumerate(rows):
            data[: len(r), i] = r
        target = np.zeros((n, batch))
        target[labels, np.arange(batch)] = 1
        grads = _gradients(net, data, mask, target)
        pace = rate * min(1, step / 20) * 0.5 * (1 + np.cos(np.pi * step / (steps + 1)))
        norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
        for k in names:
            g = grads[k] / max(1.0, norm)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            getattr(net, k)[...] -= pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    net.steps = steps
    return net


def _gradients(net: Network, data: np.ndarray, mask: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
    """Backpropagation through time of the mean cross-entropy over real positions."""
    length, batch = data.shape
    h = net.u.shape[2]
    states, kept = np.zeros((2, length, h, batch)), [[None] * length, [None] * length]
    for d in (0, 1):
        state = np.zeros((h, batch))
        for t in range(length) if d == 0 else range(length - 1, -1, -1):
            x, u = net.x[d][:, data[t]], net.u[d] @ state
            z, r = _gate(x[:h] + u[:h]), _gate(x[h : 2 * h] + u[h : 2 * h])
            new = _soft(x[2 * h :] + r * u[2 * h :])
            kept[d][t] = (z, r, new, u[2 * h :], state)
            state = np.where(mask[t], new + z * (state - new), state)
            states[d, t] = state
    logits = np.einsum("dnh,dthb->tnb", net.v, states, optimize=True) + net.b
    logits -= logits.max(1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(1, keepdims=True)
    error = (p - target) * (mask[:, None, :] / mask.sum())
    out = {"b": error.sum((0, 2))[:, None], "v": np.einsum("tnb,dthb->dnh", error, states, optimize=True), "x": np.zeros_like(net.x), "u": np.zeros_like(net.u)}
    for d in (0, 1):
        back = np.zeros((h, batch))
        above = np.einsum("nh,tnb->thb", net.v[d], error, optimize=True)
        gates = np.zeros((length, 3 * h, batch))
        for t in range(length - 1, -1, -1) if d == 0 else range(length):
            z, r, new, u_new, before = kept[d][t]
            total = above[t] + back
            live = np.where(mask[t], total, 0)
            g_new = live * (1 - z) * _slope(new)
            g_z = live * (before - new) * 0.5 * _slope(2 * z - 1)
            g_r = g_new * u_new * 0.5 * _slope(2 * r - 1)
            through = np.concatenate([g_z, g_r, g_new * r])
            out["u"][d] += through @ before.T
            gates[t, : 2 * h], gates[t, 2 * h :] = through[: 2 * h], g_new
            back = net.u[d].T @ through + live * z + np.where(mask[t], 0, total)
        flat, at = gates.transpose(1, 0, 2).reshape(3 * h, -1), data.reshape(-1)
        for k in range(3 * h):
            out["x"][d, k] = np.bincount(at, flat[k], 256)
    return out


class Reader:
    """Inference over many texts at once, in single precision."""

    def __init__(self, net: Network, lanes: int = LANES) -> None:
        h = net.u.shape[2]
        self.x = np.ascontiguousarray(net.x, np.float32)
        self.u = np.ascontiguousarray(net.u, np.float32)
        self.v = np.ascontiguousarray(net.v, np.float32)
        self.b = net.b.astype(np.float32)
        self.h, self.n, self.lanes = h, len(net.languages), lanes

    def _direction(self, d: int, data: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """States of one direction, (steps, hidden, lanes)."""
        steps, lanes = data.shape
        h, x, u = self.h, self.x[d], self.u[d]
        states = np.empty((steps, h, lanes), np.float32)
        state = np.zeros((h, lanes), np.float32)
        gates, inner, size = (np.empty((3 * h, lanes), np.float32) for _ in range(3))
        zr, new, u_new = gates[: 2 * h], gates[2 * h :], inner[2 * h :]
        ragged = lens.min() < steps
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            np.take(x, data[t], axis=1, out=gates, mode="clip")
            np.matmul(u, state, out=inner)
            zr += inner[: 2 * h]
            np.abs(zr, out=size[: 2 * h])
            size[: 2 * h] += 1
            zr /= size[: 2 * h]
            zr *= 0.5
            zr += 0.5
            u_new *= zr[h:]
            new += u_new
            np.abs(new, out=size[2 * h :])
            size[2 * h :] += 1
            new /= size[2 * h :]
            now = states[t]
            np.subtract(state, new, out=now)
            now *= zr[:h]
            now += new
            if ragged:
                now *= lens > t
            state = now
        return states

    def sums(self, data: np.ndarray, lens: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Per lane, the sum over positions first..last-1 of the distributions: (lanes, languages).

        ``data`` is (steps, lanes), zero beyond each lane's length.
        """
        steps, lanes = data.shape
        forward, backward = self._direction(0, data, lens), self._direction(1, data, lens)
        total = np.zeros((self.n, lanes), np.float32)
        p, q = (np.empty((self.n, lanes), np.float32) for _ in range(2))
        low, high, top, bottom = int(first.min()), int(last.max()), int(first.max()), int(last.min())
        for t in range(low, high):
            np.matmul(self.v[0], forward[t], out=p)
            np.matmul(self.v[1], backward[t], out=q)
            p += q
            p += self.b
            np.exp(p, out=p)
            weight = np.reciprocal(p.sum(0))
            if not top <= t < bottom:
                weight *= (first <= t) & (t < last)
            p *= weight
            total += p
        return total.T

    def positions(self, text: bytes) -> np.ndarray:
        """The distribution at every position of one text: (len, languages)."""
        if not text:
            return np.zeros((0, self.n), np.float32)
        data = np.frombuffer(text, np.uint8)[:, None].astype(np.intp)
        lens = np.array([len(text)])
        states = [self._direction(d, data, lens)[:, :, 0] for d in (0, 1)]
        p = np.exp(states[0] @ self.v[0].T + states[1] @ self.v[1].T + self.b.T)
        return p / p.sum(1, keepdims=True)

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """The pooled distribution of every text; zeros for an empty one."""
        parts: list[tuple[int, int, int, int, int]] = []  # steps, document, begin, first, last
        for i, text in enumerate(texts):
            for at in range(0, len(text), SEGMENT):
                end = min(at + SEGMENT, len(text))
                begin, stop = max(0, at - CONTEXT), min(len(text), end + CONTEXT)
                parts.append((stop - begin, i, begin, at - begin, end - begin))
        parts.sort()
        total = np.zeros((len(texts), self.n))
        for at in range(0, len(parts), self.lanes):
            group = parts[at : at + self.lanes]
            steps = group[-1][0]
            block = np.zeros((len(group), steps), np.uint8)
            for k, (n, i, begin, _, _) in enumerate(group):
                block[k, :n] = np.frombuffer(texts[i], np.uint8, n, begin)
            lens, first, last = (np.array([g[c] for g in group]) for c in (0, 3, 4))
            found = self.sums(np.ascontiguousarray(block.T, dtype=np.intp), lens, first, last)
            np.add.at(total, [g[1] for g in group], found)
        return total / np.maximum(total.sum(1, keepdims=True), 1e-30)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that training never sees: CRC-32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def training_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = DOCS_PER_LANGUAGE, windows: int = WINDOWS_PER_DOC, length: int = WINDOW) -> dict[str, list[bytes]]:
    """At most ``per_language`` documents of each language, ``windows`` pieces of each.

    Documents are those with the least hashes of their ids, pieces begin
    anywhere in the text.
    """
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (F.char_length(F.col(text_col)) > 0) & ~held_out(id_col))
    rows = rows.select(F.col(id_col).cast("string").alias("i"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).withColumn("o", F.xxhash64("i"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return {}
    bar = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 4 * per_language / n))])
    near = rows.where(F.pmod("o", F.lit(1 << 20)) <= bar[F.col("lang")] * (1 << 20))
    starts = F.transform(F.sequence(F.lit(1), F.lit(windows)), lambda k: F.pmod(F.xxhash64("o", k), F.greatest(F.char_length("text") - length + 1, F.lit(1))) + 1)
    pieces = near.select("lang", "o", "i", F.transform(starts, lambda s: F.substring(F.col("text"), s.cast("int"), F.lit(length))).alias("pieces"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("o", "i"))
    found: dict[str, list[bytes]] = {k: [] for k in counts}
    for r in pieces.withColumn("k", rank).where(F.col("k") <= per_language).orderBy("lang", "k").collect():
        found[r.lang].extend(p.encode() for p in r.pieces)
    return {k: v for k, v in found.items() if v}


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options: int) -> Network:
    """A network fitted to the sample of ``training_windows``; same rows, same network."""
    return train(training_windows(docs, id_col, text_col, lang_col), **options)


def identify(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    ``score`` is the pooled probability of ``lang_pred``, rounded to six
    places; ties go to the first language in order.  A null or empty text, one
    without a letter, or a network without languages gives ``und`` and 0.0.
    Null ids and repeated rows are kept, other columns ignored.
    """
    kind = dict(docs.select(F.col(id_col).alias("doc_id")).dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(net))

    def each():
        net = pickle.loads(shared.value)
        reader = Reader(net)

        def step(part: pa.RecordBatch) -> dict:
            texts = part.column(2).to_pylist()
            known = [bool(net.languages and has_letter(t)) for t in texts]
            pooled = reader.documents([t.encode() if k else b"" for t, k in zip(texts, known)]) if net.languages else np.zeros((len(texts), 1))
            best = pooled.argmax(1)
            return {
                "doc_id": part.column(0),
                "held_out": part.column(1),
                "lang_pred": [net.languages[b] if k else UNDETERMINED for b, k in zip(best, known)],
                "score": [round(min(1.0, float(row[b])), 6) if k else 0.0 for row, b, k in zip(pooled, best, known)],
            }

        return step

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return map_slices(rows, f"doc_id {kind}, held_out boolean, lang_pred string, score double", each)


def identified(docs: DataFrame, net: Network, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents, all columns kept, whose language is determined with at least that score."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(net))

    def each():
        net = pickle.loads(shared.value)
        reader = Reader(net)

        def step(texts: list[str | None]) -> list[bool]:
            known = [bool(net.languages and t and has_letter(t)) for t in texts]
            pooled = reader.documents([t.encode() if k else b"" for t, k in zip(texts, known)]) if net.languages else np.zeros((len(texts), 1))
            return [k and bool(row.max() >= least) for k, row in zip(known, pooled)]

        return step

    return filter_slices(docs, text_col, each)

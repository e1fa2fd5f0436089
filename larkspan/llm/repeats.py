"""Removal of long byte strings that an earlier document already has.

A byte is removed if it lies in a string of ``LENGTH`` bytes that also starts in
a document of smaller id.  Every window of ``LENGTH`` bytes has an *anchor*, the
``GRAM``-byte string in it of least hash: equal windows have equal anchors at
equal places, so documents can only share a window if they share its anchor.
In a large corpus so few bytes are shared by chance, so an anchor counts with its
*context*, the 33 or 34 bytes around it that lie in the window.

1. Batches of documents are written once, compressed.  Each batch sends the
   hashes of its contexts (one per 12 bytes of text, less than four bytes each)
   to the hash buckets of their anchors, which answer with a bit for each: does
   another document have it too?
2. For those contexts alone a batch sends its *stretches*: the windows that
   share one occurrence of an anchor, as one string.  Of equal stretches in a
   batch only that of the least id travels; the others are settled there.  A
   bucket indexes its stretches by a logarithmic family of suffix arrays: in
   order of ids, each new batch of suffixes is sorted, scanned against the
   sorted levels before it for common prefixes of ``LENGTH`` bytes, and joins
   them, levels of equal size being merged.
3. What was found goes back to the batches, which cut it out.

A context that very many batches share would draw all their stretches into one
bucket; its windows are sent one by one instead, spread by their own hashes, and
folded in shares of the batches, so that of equal windows a few reach the bucket.
They are read off the batches by themselves: nothing else is written for them.
"""

from __future__ import annotations

import gc
import hashlib
import json
import struct
import time
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm.common import durable, slices

LENGTH, GRAM = 50, 16
#: Bytes of text in a batch, and text per bucket.
BATCH_BYTES, BUCKET_BYTES = 4 << 20, 8 << 20
#: Bytes of text whose anchors are found at a time.
PART_BYTES = 512 << 10
#: Suffixes of the index's smallest level.
LEVEL = 1 << 15
#: A context in more batches than this has its windows spread one by one.
HOT_BATCHES = 2_000
#: With fewer buckets than this, shuffle files are too small to be freed early.
FREED_BUCKETS = 64


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of the ``gram`` (a multiple of 8) bytes from each position; past the end, of what is there."""
    padded = np.concatenate([data, np.zeros(gram, np.uint8)])
    n = len(data)
    words = np.ndarray((n + gram - 8,), np.uint64, padded, strides=(1,))
    whole = words[:n] * np.uint64(0x9E3779B97F4A7C15)
    other = np.empty(n, np.uint64)
    for at in range(8, gram, 8):
        np.right_shift(whole, np.uint64(32), out=other)
        whole ^= other
        whole += words[at : at + n]
        whole *= np.uint64(0xBF58476D1CE4E5B9)
    np.right_shift(whole, np.uint64(29), out=other)
    whole ^= other
    whole *= np.uint64(0x94D049BB133111EB)
    np.right_shift(whole, np.uint64(32), out=other)
    whole ^= other
    return whole


def string_hashes(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of the strings data[begin : begin + size], each of 8 bytes at least."""
    words = np.ndarray((max(0, len(data) - 7),), np.uint64, np.ascontiguousarray(data), strides=(1,))
    out = _mix(words[begin + size - 8] + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    live, at = np.arange(len(begin)), 0
    while len(live := live[size[live] >= at + 8]):
        out[live] = _mix(out[live] * np.uint64(3) + words[begin[live] + at])
        at += 8
    return out


def _bytes_of(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The strings data[begin : begin + size] back to back."""
    ends = np.cumsum(size)
    return data[np.repeat(begin - ends + size, size) + np.arange(ends[-1])] if len(size) else data[:0]


def _earlier(data: np.ndarray, begin: np.ndarray, size: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of strings in order of their documents, those that a smaller document has too.

    Strings of one hash are compared byte by byte with the first of them.
    """
    if not len(begin):
        return np.zeros(0, bool)
    _, first, same = np.unique(string_hashes(data, begin, size), return_index=True, return_inverse=True)
    head = first[same]
    out = (doc[head] < doc) & (size[head] == size)
    at = np.flatnonzero(out)
    for k in range(0, len(at), 1 << 15):
        own = at[k : k + (1 << 15)]
        n = size[own]
        unlike = _bytes_of(data, begin[own], n) != _bytes_of(data, begin[head[own]], n)
        if unlike.any():
            out[own[np.unique(np.searchsorted(np.cumsum(n), np.flatnonzero(unlike), "right"))]] = False
    return out


def anchors(data: np.ndarray, starts: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Maximal runs of windows with one anchor and one context: (anchor's hash, context's hash, first window, last window, document) of each.

    A window's *context* is the first occurrence of its anchor with half of the
    window's other bytes: those before it if the window has them, else those
    after it.  Equal windows have equal contexts.  ``data`` holds documents back
    to back, ``starts`` where each begins, and its end; windows that cross a
    border don't count.
    """
    parts, a = [_anchors(data[:0], starts[:1], length, gram)], 0
    while a < len(starts) - 1:  # documents of a few hundred kB at a time, for memory
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + PART_BYTES, "right")) - 1)
        value, context, first, last, owner = _anchors(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a], length, gram)
        parts.append((value, context, first + starts[a], last + starts[a], owner + a))
        a = b
    return tuple(np.concatenate(x) for x in zip(*parts))


def _anchors(data: np.ndarray, starts: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    sizes = np.diff(starts)
    if not len(data) or not (sizes >= length).any():
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    grams = gram_hashes(data, gram)
    least = grams.copy()
    span, reach = 1, length - gram + 1
    while 2 * span <= reach:
        np.minimum(least[:-span], least[span:], out=least[:-span])
        span *= 2
    if span < reach:
        np.minimum(least[: span - reach], least[reach - span :], out=least[: span - reach])
    ends = starts[1:]
    outside = np.zeros(len(data) + 1, np.int32)
    np.add.at(outside, np.maximum(starts[:-1], ends - length + 1), 1)
    np.add.at(outside, ends, -1)
    new = np.ones(len(data), bool)
    np.not_equal(least[1:], least[:-1], out=new[1:])
    new[1:] |= grams[:-1] == least[:-1]  # the occurrence is left behind; the anchor may occur again
    new[starts[:-1][sizes > 0]] = True
    new &= np.cumsum(outside[:-1], dtype=np.int32) == 0
    first = np.flatnonzero(new)
    owner = np.searchsorted(starts, first, "right") - 1
    last = np.minimum(np.append(first[1:] - 1, len(data)), ends[owner] - length)
    value, place = least[first], last.copy()
    seek = np.flatnonzero(grams[place] != value)
    while len(seek):
        place[seek] += 1
        seek = seek[grams[place[seek]] != value[seek]]
    # Windows that begin ``before`` bytes or more ahead of the anchor, and the rest.
    before = (length - gram) // 2
    after = length - gram - before + 1
    turn = np.clip(place - before + 1, first, last + 1)
    left, right = np.flatnonzero(turn > first), np.flatnonzero(turn <= last)
    run = np.concatenate([left, right])
    begin = np.concatenate([place[left] - before, place[right]])
    size = np.repeat(np.array([gram + before, gram + after]), [len(left), len(right)])
    context = string_hashes(data, begin, size)
    order = np.argsort(run, kind="stable")
    run = run[order]
    return value[run], context[order], np.concatenate([first[left], turn[right]])[order], np.concatenate([turn[left] - 1, last[right]])[order], owner[run]


def _ids(batch: pa.RecordBatch, id_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids as integers (null: 0), and which are not null."""
    column = batch.column(batch.schema.get_field_index(id_col))
    return pc.fill_null(pc.cast(column, pa.int64()), 0).to_numpy(zero_copy_only=False), pc.is_valid(column).to_numpy(zero_copy_only=False)


def _texts(batch: pa.RecordBatch, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes back to back, and the borders."""
    column = pc.fill_null(batch.column(batch.schema.get_field_index(text_col)), "").cast(pa.large_binary())
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
    data = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    return data, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _batches(docs: DataFrame, text_col: str, size: int) -> DataFrame:
    """(batch, n_bytes, payload): documents in batches, each an Arrow stream compressed by zstandard."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        n = 0

        def full() -> pa.RecordBatch:
            nonlocal number, held, n
            sink = pa.BufferOutputStream()
            merged = pa.Table.from_batches(held).combine_chunks()
            with pa.ipc.new_stream(sink, merged.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as out:
                out.write_table(merged)
            row = pa.RecordBatch.from_pydict({"batch": pa.array([number], pa.int64()), "n_bytes": pa.array([n], pa.int64()), "payload": pa.array([sink.getvalue().to_pybytes()], pa.binary())})
            number, held, n = number + 1, [], 0
            return row

        for part in slices(found, text_col, size):
            m = pc.sum(pc.binary_length(part.column(part.schema.get_field_index(text_col)))).as_py() or 0
            if held and n + m > size:
                yield full()
            held.append(part)
            n += m
        if held:
            yield full()

    return docs.mapInArrow(run, "batch long, n_bytes long, payload binary")


def _open(payload: bytes) -> pa.RecordBatch:
    table = pa.ipc.open_stream(payload).read_all().combine_chunks()
    return table.to_batches()[0]


def _squeeze(*arrays: np.ndarray) -> bytes:
    import zstandard

    raw = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return struct.pack("<q", len(raw)) + zstandard.ZstdCompressor(level=3).compress(raw)


def _expand(blob: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(blob[8:], max_output_size=struct.unpack("<q", blob[:8])[0]) if blob[:8] != b"\0" * 8 else b""


def _pack(low: np.ndarray) -> bytes:
    """Sorted 32-bit hashes: steps, their bytes of one rank together."""
    steps = np.diff(low.astype(np.int64), prepend=0).astype("<u4")
    return _squeeze(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T))


def _unpack(blob: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(_expand(blob), np.uint8).reshape(4, -1).T).view("<u4")
    return np.cumsum(steps.ravel(), dtype=np.int64).astype(np.uint32)


def _place(value: np.ndarray, context: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each anchor, and the 32 bits that tell the contexts of a bucket apart."""
    return ((value >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), context.astype(np.uint32)


def _asked(bucket: np.ndarray, low: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a batch asks the buckets, sorted: each context once, twice if two documents of the batch have it."""
    order = np.lexsort((doc, low, bucket))
    bucket, low, doc = bucket[order], low[order], doc[order]
    head = np.ones(len(low), bool)
    head[1:] = (low[1:] != low[:-1]) | (bucket[1:] != bucket[:-1])
    starts = np.flatnonzero(head)
    second = np.zeros(len(low), bool)
    second[1:] = ~head[1:] & (doc[1:] != doc[:-1])
    times = 1 + (np.add.reduceat(second, starts) > 0) if len(starts) else np.zeros(0, np.int64)
    return np.repeat(bucket[starts], times), np.repeat(low[starts], times)


class SuffixLevels:
    """A logarithmic family of suffix arrays over strings, given in order of their documents."""

    def __init__(self, length: int = LENGTH, smallest: int = LEVEL) -> None:
        self.length, self.smallest = length, smallest
        self.levels: list[np.ndarray] = []  # sorted suffixes, cut to ``length`` bytes

    def add(self, data: np.ndarray, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Index the suffixes of ``data`` at ``at``, of the documents ``doc``
        (in order, none indexed before); tell which start with ``length``
        bytes that a smaller document has too."""
        view = np.ndarray((max(0, len(data) - self.length + 1),), f"S{self.length}", np.ascontiguousarray(data), strides=(1,))
        keys = view[at]
        order = np.argsort(keys, kind="stable")  # the batch's suffix array; equal prefixes in order of documents
        keys, owner = keys[order], doc[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        heads = np.flatnonzero(new)
        earlier = owner > np.repeat(owner[heads], np.diff(np.append(heads, len(keys))))
        heads_known = np.zeros(len(heads), bool)
        unique = keys[heads]
        for level in self.levels:
            place = np.searchsorted(level, unique)
            place[place == len(level)] = 0
            heads_known |= level[place] == unique
        earlier |= np.repeat(heads_known, np.diff(np.append(heads, len(keys))))
        self._join(unique[~heads_known])
        out = np.zeros(len(at), bool)
        out[order] = earlier
        return out

    def _join(self, level: np.ndarray) -> None:
        if not len(level):
            return
        while self.levels and len(self.levels[-1]) <= 2 * len(level):
            level = np.sort(np.concatenate([self.levels.pop(), level]), kind="stable")
        self.levels.append(level)


def _shared_contexts(pdf: pd.DataFrame, hot: int, since: int | None = None) -> pd.DataFrame:
    """A bucket's answer to each batch, bits for what it asked: which contexts another document has too (and a batch from ``since`` on), and which of them very many batches have."""
    parts = [_unpack(b) for b in pdf["blob"]]
    keeps = [np.ones(len(p), bool) for p in parts]
    if since is not None:
        new = [p for batch, p in zip(pdf["batch"], parts) if batch >= since]
        wanted = np.unique(np.concatenate(new)) if new else np.zeros(0, np.uint32)
        keeps = [keep if batch >= since else np.isin(p, wanted) for batch, p, keep in zip(pdf["batch"], parts, keeps)]
    _, inverse, counts = np.unique(np.concatenate([p[keep] for p, keep in zip(parts, keeps)]), return_inverse=True, return_counts=True)
    ends = np.cumsum([keep.sum() for keep in keeps])
    rows = []
    for batch, keep, n in zip(pdf["batch"], keeps, np.split(counts[inverse], ends[:-1])):
        if (n > 1).any():
            shared, busy = keep.copy(), keep.copy()
            shared[keep], busy[keep] = n > 1, n > hot
            rows.append((batch, pdf["bucket"].iloc[0], bool(busy.any()), _squeeze(np.packbits(shared), np.packbits(busy))))
    return pd.DataFrame(rows, columns=["batch", "bucket", "hot", "blob"])


def _stretches(batch: int, payload: bytes, answers: list[tuple[int, bytes]], id_col: str, text_col: str, length: int, gram: int, buckets: int, busy: bool = False) -> tuple[list[tuple[int, bytes]], bytes | None]:
    """What a batch sends to the buckets, and the runs of windows settled in it.

    Either the stretches of shared contexts, or (``busy``) the windows of those
    that very many batches have.
    """
    rows = _open(payload)
    ids, has_id = _ids(rows, id_col)
    data, starts = _texts(rows, text_col)
    value, context, first, last, owner = anchors(data, starts, length, gram)
    value, context, first, last, owner = (x[has_id[owner]] for x in (value, context, first, last, owner))
    bucket, low = _place(value, context, buckets)
    wanted = np.zeros(len(value), bool)
    asked_bucket, asked = _asked(bucket, low, ids[owner])
    asked_edges = np.searchsorted(asked_bucket, np.arange(buckets + 1))
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b, blob in answers:
        mine, known = order[edges[b] : edges[b + 1]], asked[asked_edges[b] : asked_edges[b + 1]]
        shared, many = (np.unpackbits(x, count=len(known)).astype(bool) for x in np.frombuffer(_expand(blob), np.uint8).reshape(2, -1))
        wanted[mine] = (many if busy else shared & ~many)[np.searchsorted(known, low[mine])]
    chosen = np.flatnonzero(wanted)
    p, q, to, row = first[chosen], last[chosen], bucket[chosen], owner[chosen]
    if busy:  # windows one by one
        n = q - p + 1
        p, row = np.repeat(p - np.cumsum(n) + n, n) + np.arange(n.sum()), np.repeat(row, n)
        q, to = p, np.full(len(p), -1)
    elif len(p):  # an anchor's contexts side by side are one stretch
        v = value[chosen]
        new = np.append(True, (v[1:] != v[:-1]) | (row[1:] != row[:-1]) | (p[1:] != q[:-1] + 1))
        q = q[np.append(new[1:], True)]
        p, to, row = p[new], to[new], row[new]
    order = np.argsort(ids[row], kind="stable")
    p, q, to, row = p[order], q[order], to[order], row[order]
    size = q - p + length
    settled = _earlier(data, p, size, ids[row])
    if (spread := (to < 0) & ~settled).any():
        to[spread] = (string_hashes(data, p[spread], size[spread]) % np.uint64(buckets)).astype(np.int64) + buckets
    sent, own = np.flatnonzero(~settled), np.flatnonzero(settled)
    at = p - starts[row]
    return _entries(to[sent], ids[row[sent]], row[sent], at[sent], size[sent], data, p[sent]), _runs(row[own], at[own], (q - p + 1)[own])


def _runs(row: np.ndarray, at: np.ndarray, windows: np.ndarray) -> bytes | None:
    """Repeated runs of windows of a batch."""
    return _squeeze(np.stack([row, at, windows], axis=1).astype(np.int32)) if len(row) else None


def _entries(to: np.ndarray, doc: np.ndarray, row: np.ndarray, at: np.ndarray, size: np.ndarray, data: np.ndarray, begin: np.ndarray) -> list[tuple[int, bytes]]:
    """Stretches by the bucket they go to; they are in order of their documents."""
    out = []
    order = np.argsort(to, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
        if len(part):
            steps = np.diff(doc[part], prepend=0)  # in order of ids: small steps
            out.append((int(to[part[0]]), _squeeze(np.int32([len(part)]), steps, *(x[part].astype(np.int32) for x in (row, at, size)), _bytes_of(data, begin[part], size[part]))))
    return out


def _opened(pdf: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """The stretches of a bucket in order of documents: batch, document, row, first window, size, begin; and all their bytes."""
    docs, batches, rows, at, sizes, texts = [], [], [], [], [], []
    for batch, blob in zip(pdf["batch"], pdf["blob"]):
        raw = _expand(blob)
        n = struct.unpack_from("<i", raw)[0]
        docs.append(np.cumsum(np.frombuffer(raw, np.int64, n, 4)))
        for k, part in enumerate((rows, at, sizes)):
            part.append(np.frombuffer(raw, np.int32, n, 4 + 8 * n + 4 * n * k).astype(np.int64))
        batches.append(np.full(n, batch, np.int64))
        texts.append(np.frombuffer(raw, np.uint8, offset=4 + 20 * n))
    doc, row, start, size, source = (np.concatenate(x) for x in (docs, rows, at, sizes, batches))
    order = np.argsort(doc, kind="stable")
    begin = np.cumsum(size) - size
    return (*(x[order] for x in (source, doc, row, start, size, begin)), np.concatenate(texts))


def _by_batch(source: np.ndarray, row: np.ndarray, at: np.ndarray, windows: np.ndarray) -> list[tuple[int, bytes]]:
    order = np.argsort(source, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(source[order])) + 1)
    return [(int(source[p[0]]), _runs(row[p], at[p], windows[p])) for p in parts if len(p)]


def _folded(pdf: pd.DataFrame, length: int, buckets: int) -> pd.DataFrame:
    """A share of a bucket's batches: of equal strings those of the least document go on, the others are settled."""
    source, doc, row, start, size, begin, data = _opened(pdf)
    settled = _earlier(data, begin, size, doc)
    own = np.flatnonzero(settled)
    rows = [(-1 - batch % buckets, batch, blob) for batch, blob in _by_batch(source[own], row[own], start[own], size[own] - length + 1)]
    left = np.flatnonzero(~settled)
    bucket = int(pdf["bucket"].iloc[0])
    for batch in np.unique(source[left]).tolist():
        part = left[source[left] == batch]
        rows += [(to, batch, blob) for to, blob in _entries(np.full(len(part), bucket), doc[part], row[part], start[part], size[part], data, begin[part])]
    return pd.DataFrame(rows, columns=["bucket", "batch", "blob"])


def _indexed(pdf: pd.DataFrame, length: int, level: int) -> pd.DataFrame:
    """A bucket's repeats: per batch the runs of windows that a smaller document has.

    Buckets below zero hold runs that batches have settled themselves.
    Stretches that a smaller document has whole are told first; of the others
    those windows go to the suffix arrays whose hash another one has.
    """
    if pdf["bucket"].iloc[0] < 0:
        return pdf[["batch", "blob"]]
    source, doc, row, start, size, begin, data = _opened(pdf)
    known = _earlier(data, begin, size, doc)
    whole, fresh = np.flatnonzero(known), np.flatnonzero(~known)
    index = SuffixLevels(length, level)
    windows = size[fresh] - length + 1
    which = np.repeat(fresh, windows)
    place = np.repeat(begin[fresh] - np.cumsum(windows) + windows, windows) + np.arange(len(which))
    hashes = np.empty(len(which), np.uint64)
    for k in range(0, len(which), 1 << 16):
        hashes[k : k + (1 << 16)] = string_hashes(data, place[k : k + (1 << 16)], np.full(len(which[k : k + (1 << 16)]), length))
    order = np.argsort(hashes)
    same = hashes[order[1:]] == hashes[order[:-1]]
    twice = np.zeros(len(which), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    del hashes, order, same
    which, place = which[twice], place[twice]
    found: list[np.ndarray] = []
    lo = 0
    while lo < len(which):
        hi = min(lo + level, len(which))
        hi = int(np.searchsorted(doc[which], doc[which[hi - 1]], "right"))  # a document isn't split
        found.append(lo + np.flatnonzero(index.add(data, place[lo:hi], doc[which[lo:hi]])))
        lo = hi
    hit = np.concatenate(found) if found else np.zeros(0, np.int64)
    own, at = which[hit], place[hit] - begin[which[hit]]
    heads = np.flatnonzero(np.append(True, (np.diff(own) != 0) | (np.diff(at) != 1)))[: len(own)]
    many = np.diff(np.append(heads, len(own)))
    own, at = own[heads], at[heads]
    rows = _by_batch(np.concatenate([source[whole], source[own]]), np.concatenate([row[whole], row[own]]), np.concatenate([start[whole], start[own] + at]), np.concatenate([size[whole] - length + 1, many]))
    return pd.DataFrame({"batch": pd.Series([b for b, _ in rows], dtype="int64"), "blob": pd.Series([x for _, x in rows], dtype=object)})


def _cut(payload: bytes, blobs: list[bytes], id_col: str, text_col: str, length: int) -> tuple[pa.RecordBatch, dict[str, list]]:
    """A batch's documents, and what is left of each."""
    rows = _open(payload)
    data, starts = _texts(rows, text_col)
    depth = np.zeros(len(data) + 1, np.int32)
    for blob in blobs:
        runs = np.frombuffer(_expand(blob), np.int32).reshape(-1, 3).astype(np.int64)
        base = starts[runs[:, 0]] + runs[:, 1]
        np.add.at(depth, base, 1)
        np.add.at(depth, base + runs[:, 2] - 1 + length, -1)
    gone = np.cumsum(depth[:-1]) > 0
    made: dict[str, list] = {"n_bytes": np.diff(starts).tolist(), "n_removed": [], "n_spans": [], "kept": []}
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        mask = gone[a:b]
        n = int(mask.sum())
        made["n_removed"].append(n)
        made["n_spans"].append(int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum()) if n else 0)
        made["kept"].append((data[a:b][~mask] if n else data[a:b]).tobytes())
    return rows, made


def _with_blobs(batches: DataFrame, blobs: DataFrame) -> DataFrame:
    """Batches with the blobs sent to them: at most one from each bucket, and their own."""
    listed = blobs.groupBy("batch").agg(F.collect_list(F.struct("bucket", "blob")).alias("blobs"))
    return batches.join(listed, "batch", "left")


def _sent(batches: DataFrame, id_col: str, text_col: str, length: int, gram: int, buckets: int) -> DataFrame:
    """(bucket, batch, blob): the contexts of each batch, by the buckets of their anchors."""

    def send(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in found:
            for batch, payload in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                rows = _open(payload)
                data, starts = _texts(rows, text_col)
                value, context, _, _, owner = anchors(data, starts, length, gram)
                ids, has_id = _ids(rows, id_col)
                bucket, low = _place(value, context, buckets)
                bucket, low = _asked(*(x[has_id[owner]] for x in (bucket, low, ids[owner])))
                cuts = np.flatnonzero(np.diff(bucket)) + 1
                for b, l in zip(np.split(bucket, cuts), np.split(low, cuts)):
                    if len(b):
                        yield pa.RecordBatch.from_pydict({"bucket": pa.array([int(b[0])], pa.int64()), "batch": pa.array([batch], pa.int64()), "blob": pa.array([_pack(l)], pa.binary())})

    return batches.select("batch", "payload").mapInArrow(send, "bucket long, batch long, blob binary")


def _settled(batches: DataFrame, sent: DataFrame, id_col: str, text_col: str, length: int, gram: int, buckets: int, hot: int, level: int, since: int | None = None) -> DataFrame:
    """(batch, blob): the repeated runs of windows of the batches, or of those from ``since`` on.

    Then batches before it only take part where they share a context with those.
    """
    answers = durable(sent.groupBy("bucket").applyInPandas(lambda pdf: _shared_contexts(pdf, hot, since), "batch long, bucket long, hot boolean, blob binary"))
    _let_go(answers.sparkSession, buckets)
    # One plan from here on: all joins read the same exchange of the batches.
    batches = batches.select("batch", "payload")

    def stretches(asked: DataFrame, busy: bool) -> DataFrame:
        def stretch(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in found:
                for batch, payload, blobs in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()):
                    if busy and not blobs:
                        continue
                    out, settled = _stretches(batch, payload, [(x["bucket"], x["blob"]) for x in blobs or []], id_col, text_col, length, gram, buckets, busy)
                    out += [(-1 - batch % buckets, settled)] if settled is not None else []
                    for b, blob in out:
                        yield pa.RecordBatch.from_pydict({"bucket": pa.array([b], pa.int64()), "batch": pa.array([batch], pa.int64()), "blob": pa.array([blob], pa.binary())})

        listed = _with_blobs(batches, asked)
        if since is not None:
            listed = listed.where(F.col("blobs").isNotNull())
        return listed.select("batch", "payload", "blobs").mapInArrow(stretch, "bucket long, batch long, blob binary")

    sent_on = stretches(answers, False)
    if answers.where("hot").limit(1).count():
        # Windows of hot contexts, in buckets of their own, are folded in shares of the batches before each bucket has them all.
        # They alone are written and exchanged on the way.
        windows = durable(stretches(answers.where("hot"), True))
        _let_go(answers.sparkSession, buckets)
        n = windows.where(F.col("bucket") >= buckets).groupBy("bucket").count().agg(F.max("count")).first()[0] or 0
        while n > hot:
            salted = windows.where(F.col("bucket") >= buckets).withColumn("share", F.pmod(F.xxhash64("batch", F.lit(n)), F.lit(-(-n // hot))))
            folded = salted.groupBy("bucket", "share").applyInPandas(lambda pdf: _folded(pdf.drop(columns="share"), length, buckets), "bucket long, batch long, blob binary")
            windows = durable(windows.where(F.col("bucket") < buckets).unionAll(folded))
            del salted, folded  # they hold what was written before
            _let_go(answers.sparkSession, buckets)
            left = windows.where(F.col("bucket") >= buckets).groupBy("bucket").count().agg(F.max("count")).first()[0] or 0
            if left > n // 2:
                break
            n = left
        sent_on = sent_on.unionAll(windows)
    indexed = sent_on.groupBy("bucket").applyInPandas(lambda pdf: _indexed(pdf, length, level), "batch long, blob binary")
    if since is not None:
        indexed = indexed.where(F.col("batch") >= since)
    return indexed.select("batch", F.lit(0).cast("long").alias("bucket"), "blob")


def _let_go(spark: SparkSession, buckets: int) -> None:
    """Let shuffle files go of plans that were cut off: else they stay until the driver happens to collect its garbage."""
    if buckets >= FREED_BUCKETS:
        for _ in range(2):
            gc.collect()
            time.sleep(1.5)  # Py4J drops its references once a second
            spark.sparkContext._jvm.System.gc()


def _found(docs: DataFrame, id_col: str, text_col: str, length: int, gram: int, batch_bytes: int, bucket_bytes: int, hot: int, level: int) -> DataFrame:
    """(batch, payload, blobs): each batch with its repeated runs of windows."""
    batches = durable(_batches(docs, text_col, batch_bytes))
    total = batches.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(8, -(-total // bucket_bytes))
    batches = batches.select("batch", "payload")
    sent = _sent(batches, id_col, text_col, length, gram, buckets)
    return _with_blobs(batches, _settled(batches, sent, id_col, text_col, length, gram, buckets, hot, level))


class Index:
    """A family of levels in one folder that takes batch after batch of documents.

    Each level holds documents and the contexts of their windows; a new batch
    is a level of its own, and levels are merged while the one before isn't
    more than twice as large, so there are few and each document is rewritten
    a logarithmic number of times.  Contexts of a new batch are looked up in all
    levels, and of older documents only those are opened that share one; their
    stretches and the new ones meet in the suffix arrays.

    A manifest tells which folders hold; it is written last, so a call that
    breaks off leaves the index as it was.  One writer at a time.  The number
    of buckets holds for the life of an index: about one for every
    ``BUCKET_BYTES`` it will have.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 1024, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, batch_bytes: int = BATCH_BYTES, hot: int = HOT_BATCHES, level: int = LEVEL) -> None:
        self.spark, self.path, self.id_col, self.text_col = spark, path, id_col, text_col
        self.length, self.gram, self.batch_bytes, self.hot, self.level = length, gram, batch_bytes, hot, level
        self.buckets = (self._manifest() or {"buckets": buckets})["buckets"]

    def _files(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _manifest(self) -> dict | None:
        fs, make = self._files()
        folder = make(f"{self.path}/manifest")
        if not fs.exists(folder):
            return None
        names = [f.getPath().getName() for f in fs.listStatus(folder)]
        done = sorted(n for n in names if fs.exists(make(f"{self.path}/manifest/{n}/_SUCCESS")))
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{done[-1]}").first()[0]) if done else None

    def levels(self) -> list[int]:
        """The bytes of text in each level, the oldest first."""
        return [n for _, n in (self._manifest() or {"levels": []})["levels"]]

    def add(self, docs: DataFrame) -> DataFrame:
        """Index ``docs``, and give the rows of ``removed`` for them.

        What counts are documents of smaller id in this batch, and all of the
        batches before, whose ids have to be smaller.  An empty batch changes
        nothing.  Null ids are kept and match nothing, as in ``removed``.
        """
        rows = _id_and_text(docs, self.id_col, self.text_col)
        kind = dict(rows.dtypes)["doc_id"]
        old = self._manifest() or {"levels": [], "buckets": self.buckets, "next": 0, "last": None, "version": 0}
        ends = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
        if None not in (ends[0], old["last"]) and ends[0] <= old["last"]:
            raise ValueError(f"id {ends[0]} isn't beyond {old['last']}")
        name = f"{self.path}/level-{old['version'] + 1}"
        shift = old["next"] << 48
        _batches(rows, "text", self.batch_bytes).withColumn("batch", F.col("batch") + shift).write.mode("overwrite").parquet(f"{name}/batches")
        new = self.spark.read.parquet(f"{name}/batches")
        size = new.agg(F.sum("n_bytes")).first()[0] or 0
        new = new.select("batch", "payload")
        plan = ("doc_id", "text", self.length, self.gram, self.buckets)
        _sent(new, *plan).write.mode("overwrite").parquet(f"{name}/contexts")
        before = [folder for folder, _ in old["levels"]]
        batches = reduce(DataFrame.unionAll, [self.spark.read.parquet(f"{f}/batches").select("batch", "payload") for f in before], new)
        sent = reduce(DataFrame.unionAll, [self.spark.read.parquet(f"{f}/contexts") for f in [*before, name]])
        runs = durable(_settled(batches, sent, *plan, self.hot, self.level, shift))
        out = durable(_with_blobs(new, runs).select("payload", "blobs").mapInArrow(_cutter(_digest, "doc_id", "text", self.length), f"doc_id {kind}, {_DIGEST}"))
        if size or ends[1] is not None:
            self._join([*old["levels"], [name, size]], old, ends[1])
        return out

    def _join(self, levels: list[list], old: dict, last: int | None) -> None:
        """Merge levels of like sizes, and let the new ones hold."""
        version, gone = old["version"] + 1, []
        while len(levels) > 1 and levels[-2][1] <= 2 * levels[-1][1]:
            (a, n), (b, m) = levels[-2:]
            name = f"{self.path}/level-{version}-{len(levels)}"
            for part in ("batches", "contexts"):
                self.spark.read.parquet(f"{a}/{part}").unionAll(self.spark.read.parquet(f"{b}/{part}")).write.mode("overwrite").parquet(f"{name}/{part}")
            levels, gone = [*levels[:-2], [name, n + m]], [*gone, a, b]
        made = {"levels": levels, "buckets": self.buckets, "next": old["next"] + 1, "last": last if last is not None else old["last"], "version": version}
        self.spark.createDataFrame([(json.dumps(made),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest/{version:09d}")
        fs, make = self._files()
        for folder in gone:
            fs.delete(make(folder), True)


def _id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


_DIGEST = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _digest(batch: pa.RecordBatch, made: dict[str, list]) -> pa.RecordBatch:
    digests = [hashlib.sha256(k).hexdigest() for k in made["kept"]]
    ints = [pa.array(made[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")]
    return pa.RecordBatch.from_arrays([batch.column(0), *ints, pa.array(digests, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _cutter(make: Callable[[pa.RecordBatch, dict[str, list]], pa.RecordBatch], id_col: str, text_col: str, length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for payload, blobs in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                yield make(*_cut(payload, [x["blob"] for x in blobs or []], id_col, text_col, length))

    return cut


def _run(docs: DataFrame, schema, make: Callable[[pa.RecordBatch, dict[str, list]], pa.RecordBatch], id_col: str, text_col: str, options: dict[str, int]) -> DataFrame:
    o = {"length": LENGTH, "gram": GRAM, "batch_bytes": BATCH_BYTES, "bucket_bytes": BUCKET_BYTES, "hot": HOT_BATCHES, "level": LEVEL} | options
    if o["gram"] % 8 or o["gram"] > o["length"]:
        raise ValueError("gram is a multiple of 8, at most length")
    found = _found(docs, id_col, text_col, **o)
    return found.select("payload", "blobs").mapInArrow(_cutter(make, id_col, text_col, o["length"]), schema)


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are their UTF-8 bytes, a null text none.  A byte goes if a string of
    ``length`` bytes that covers it also starts in a document of smaller id,
    judged on the input; rows of equal id don't count against each other.  A
    null id neither removes nor loses anything.  Spans are maximal runs of
    removed bytes; the digest is that of the bytes left, joined.  Repeated
    rows and empty texts are kept, other columns ignored; an empty table gives
    an empty result.  Ids are integers.
    """
    rows = _id_and_text(docs, id_col, text_col)
    return _run(rows, f"doc_id {dict(rows.dtypes)['doc_id']}, {_DIGEST}", _digest, "doc_id", "text", options)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """The documents, all columns kept, with repeated bytes cut out of their texts.

    The bytes of a character that is cut in part are dropped, so texts stay
    valid.  A row of which nothing is left is dropped; texts that were null or
    empty stay as they are.
    """
    names = docs.columns
    at = names.index(text_col)

    def make(batch: pa.RecordBatch, made: dict[str, list]) -> pa.RecordBatch:
        old = batch.column(at)
        texts = [t if not n else k.decode("utf-8", "ignore") for t, n, k in zip(old.to_pylist(), made["n_removed"], made["kept"])]
        keep = pa.array([not n or bool(t) for t, n in zip(texts, made["n_removed"])])
        columns = [*batch.columns]
        columns[at] = pa.array(texts, old.type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(keep)

    return _run(docs, docs.schema, make, id_col, text_col, options)

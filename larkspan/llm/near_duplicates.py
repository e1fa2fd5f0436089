"""SimHash near-duplicate search by random bit sampling.

Texts get 256-bit SimHash fingerprints of their sets of 5-word shingles.
Several tables each sample coordinates of the fingerprint at random; documents
that agree in a table's first few sampled bits share a bucket.  The number of
those bits follows the number of documents, so buckets keep their size, and the
number of tables follows from the bits and the recall wanted at the threshold.
Buckets are counted first: the rows of one beyond its cap are spread over blocks
of about the cap, and every two blocks meet in a group of their own, so that no
pair of a bucket is left out, and no task holds more than two blocks at a time,
however many rows agree.  The comparisons of such a bucket grow with its square.

Candidates are pairs within a bucket whose Hamming distance and numbers of
shingles allow the similarity.  A bucket never emits its pairs: it sends a
spanning forest of them, at most one edge a row, which connects the same rows.
What the forests connect is a *group*, within which every pair is then settled
exactly: the shingle sets of a group (of two blocks of one, if it is large) meet
in one task, which counts the shingles that rows share by a matrix product and
sends a spanning forest of the links it finds.  Classes are the connected
components of those.  Equal texts share one node from the start, so copies cost
one row each.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import durable, map_slices

SHINGLE, SIMILARITY = 5, 0.8
BITS = 256
#: Documents of a bucket on average, and of a block, of which two at most are compared with each other at once.
BUCKET, CAP = 512, 4096
#: Chance that a pair just at the threshold meets in no table.
MISS = 0.001
#: Standard deviations of the distance of a pair just at the threshold that still count as near.
SLACK = 3.5
#: Up to so many rows of a group are compared one by one, not by a matrix.
FEW = 12
#: Rows, and shingles, of a block of a group; two blocks at most are compared with each other at once.
GROUP_ROWS, GROUP_SHINGLES = 2048, 1 << 20
#: Texts of so few shingles have bits that agree less often than those of large sets.
SMALL = 32
WORD_CACHE = 500_000
#: Oversized buckets and groups are broadcast up to so many; beyond, joined by shuffle.
BROADCAST_ROWS = 1_000_000
_SEED = 20_240_607
_SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


class _Words(dict):
    """64-bit hashes of words; bounded."""

    def __missing__(self, word: str) -> int:
        import xxhash

        n = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = n
        return n


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingles:
    """Sets of hashed shingles, and their fingerprints."""

    def __init__(self, width: int = SHINGLE) -> None:
        self.width, self.words = width, _Words()

    def set(self, text: str) -> np.ndarray:
        """Sorted hashes of the distinct shingles; a text of fewer words is one shingle, of none no shingle."""
        words = text.split()
        if not words:
            return np.zeros(0, np.uint64)
        n = len(words)
        hashes = np.fromiter(map(self.words.__getitem__, words), np.uint64, n)
        k = min(self.width, n)
        total = hashes[: n - k + 1].copy()
        for i in range(1, k):
            total = total * np.uint64(0x100000001B3) + hashes[i : n - k + 1 + i]
        return np.unique(_mix(total + np.uint64(k)))

    @staticmethod
    def fingerprint(shingles: np.ndarray) -> bytes:
        counts = np.zeros(BITS, np.int64)
        for at in range(0, len(shingles), 255):
            part = shingles[at : at + 255]
            bits = np.unpackbits(_mix(part[:, None] + _SALTS).view(np.uint8).reshape(len(part), BITS // 8), axis=1)
            counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
        return np.packbits(2 * counts > len(shingles)).tobytes()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def agreement(similarity: float) -> float:
    """Share of agreeing bits of two equally large sets of that Jaccard similarity."""
    return 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi


def plan(n: int, similarity: float = SIMILARITY, bucket: int = BUCKET, miss: float = MISS) -> tuple[int, int, int]:
    """Bits of a bucket's key, tables, and the largest near distance, for n documents."""
    bits = min(48, max(1, math.ceil(math.log2(max(2, n / bucket)))))
    p = agreement(similarity)
    tables = math.ceil(math.log(miss) / math.log(1 - p**bits))
    near = BITS * (1 - p) + SLACK * math.sqrt(BITS * p * (1 - p))
    return bits, tables, int(near)


@functools.cache
def small_agreement(similarity: float = SIMILARITY, largest: int = SMALL) -> float:
    """The least share of agreeing bits of two sets of at most ``largest`` shingles and that similarity.

    Majorities of few shingles tie, so their bits agree less often than those
    of large sets.
    """

    def heads(n: int) -> list[float]:
        return [math.comb(n, k) / 2**n for k in range(n + 1)]

    least = agreement(similarity)
    for b in range(1, largest + 1):
        for a in range(math.ceil(similarity * b - 1e-9), b + 1):
            both = math.ceil(similarity * (a + b) / (1 + similarity) - 1e-9)
            if both > a:
                continue
            agree = 0.0
            for c, pc in enumerate(heads(both)):
                one = sum(p for k, p in enumerate(heads(a - both)) if 2 * (c + k) > a)
                two = sum(p for k, p in enumerate(heads(b - both)) if 2 * (c + k) > b)
                agree += pc * (one * two + (1 - one) * (1 - two))
            least = min(least, agree)
    return least


def plan_small(bits: int, tables: int, near: int, similarity: float = SIMILARITY, miss: float = MISS) -> tuple[int, int]:
    """Tables, and the largest near distance, for texts of few shingles."""
    p = small_agreement(similarity)
    more = math.ceil(math.log(miss) / math.log(1 - p**bits))
    return max(tables, more), max(near, int(BITS * (1 - p) + SLACK * math.sqrt(BITS * p * (1 - p))))


def _samples(tables: int) -> np.ndarray:
    rng = np.random.default_rng(_SEED)
    return np.stack([rng.permutation(BITS)[:64] for _ in range(tables)])


def _table_rows(prints: DataFrame, bits: int, tables: int, more: int, counted: bool = False) -> DataFrame:
    """A row per document and table: bucket (of one table), node, print, n; ``counted``: buckets only.

    Texts of few shingles are in ``more`` tables.
    """
    samples, shift = _samples(more), np.int64(64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                sampled = None
                for t in range(more):
                    if t in (0, tables):
                        if t:
                            part = part.filter(pc.less_equal(part.column(2), SMALL))
                            if not part.num_rows:
                                break
                        raw = np.frombuffer(b"".join(part.column(0).to_pylist()), np.uint8).reshape(-1, BITS // 8)
                        sampled = np.unpackbits(raw, axis=1)
                    key = np.ascontiguousarray(np.packbits(sampled[:, samples[t]], axis=1)).view(">u8").reshape(-1).astype(np.uint64) ^ np.uint64(1 << 63)
                    bucket = pa.array((key.view(np.int64) >> shift) + (np.int64(t) << np.int64(52)))
                    yield pa.RecordBatch.from_arrays([bucket, *part.columns[: 0 if counted else 3]], names=["bucket", "print", "node", "n"][: 1 if counted else 4])

    rows = prints.select("print", "node", "n")
    if counted:
        return rows.mapInArrow(run, "bucket long")
    return rows.mapInArrow(run, "bucket long, print binary, node long, n int")


def _in_blocks(rows: DataFrame, key: str, large: DataFrame, columns: list[str]) -> DataFrame:
    """The rows with their ``piece``: 0, or of a key in ``large`` (key, blocks) the two blocks that meet and the row's side.

    A row of a key of n blocks is in n groups, one with each block, its own included.
    """
    n = large.limit(BROADCAST_ROWS + 1).count()
    if not n:
        return rows.select(*columns, F.lit(0).cast("long").alias("piece"))
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int")
    met = rows.join(F.broadcast(large) if n <= BROADCAST_ROWS else large, key, "left").withColumn("own", F.coalesce(own, F.lit(0)))
    each = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    low, high = F.least("own", "other").cast("long"), F.greatest("own", "other").cast("long")
    return each.select(*columns, (F.shiftleft(low, 32) + F.shiftleft(high, 1) + (F.col("own") > F.col("other")).cast("long")).alias("piece"))


def _middle(pieces: np.ndarray) -> int | None:
    """Where the second of two blocks begins; None for one block (or a whole key), compared with itself."""
    first = int(pieces[0])
    return None if first >> 32 == (first & 0xFFFFFFFF) >> 1 else int(np.searchsorted(pieces & 1, 1))


class _Forest:
    """Joins rows; keeps the pairs that joined two sets."""

    def __init__(self, n: int) -> None:
        self.root, self.pairs = np.arange(n), []

    def join(self, i: int, others: np.ndarray) -> None:
        roots = self.root[others]
        if (roots == self.root[i]).all():
            return
        for r, at in zip(*np.unique(roots, return_index=True)):
            if r != self.root[i]:
                self.pairs.append((int(others[at]), i))
                self.root[self.root == r] = self.root[i]


class _Buckets:
    """Turns sorted rows of one partition into forests of near pairs, a bucket or two blocks of one at a time."""

    def __init__(self, near: int, near_small: int, similarity: float) -> None:
        self.near, self.near_small, self.similarity = near, near_small, similarity
        self.bucket = np.zeros(0, np.int64)
        self.piece = np.zeros(0, np.int64)
        self.node = np.zeros(0, np.int64)
        self.prints = np.zeros((0, 4), np.uint64)
        self.n = np.zeros(0, np.int32)

    def add(self, bucket: np.ndarray, piece: np.ndarray, node: np.ndarray, prints: np.ndarray, n: np.ndarray, final: bool) -> Iterator[np.ndarray]:
        self.bucket, self.piece = np.concatenate([self.bucket, bucket]), np.concatenate([self.piece, piece])
        self.node, self.prints = np.concatenate([self.node, node]), np.concatenate([self.prints, prints])
        self.n = np.concatenate([self.n, n])
        edges = np.flatnonzero((np.diff(self.bucket) != 0) | (np.diff(self.piece >> np.int64(1)) != 0)) + 1
        ends = [*edges.tolist(), *([len(self.bucket)] if final and len(self.bucket) else [])]
        start = 0
        for end in ends:
            yield from self._pairs(start, end, _middle(self.piece[start:end]))
            start = end
        keep = slice(start, None)
        self.bucket, self.piece, self.node, self.prints, self.n = self.bucket[keep], self.piece[keep], self.node[keep], self.prints[keep], self.n[keep]

    def _pairs(self, start: int, end: int, middle: int | None) -> Iterator[np.ndarray]:
        """A forest of the near pairs of rows before and from ``middle`` on, or of all rows."""
        size = end - start
        if size < 2:
            return
        node, prints, n = self.node[start:end], self.prints[start:end], self.n[start:end]
        forest = _Forest(size)
        for at in range(1 if middle is None else middle, size, 256):
            stop = min(at + 256, size)
            limit = stop if middle is None else middle
            if not limit:
                return
            distance = np.zeros((stop - at, limit), np.uint16)
            for w in range(4):
                distance += np.bitwise_count(prints[at:stop, w][:, None] ^ prints[None, :limit, w])
            if middle is None:
                distance[np.arange(limit)[None, :] >= np.arange(at, stop)[:, None]] = 9999
            for i in np.flatnonzero(distance.min(axis=1) <= self.near_small):
                close = np.flatnonzero(distance[i] <= self.near_small)
                low, high = np.minimum(n[close], n[at + i]), np.maximum(n[close], n[at + i])
                far = np.where(high <= SMALL, self.near_small, self.near)
                close = close[(distance[i][close] <= far) & (low >= self.similarity * high)]
                if len(close):
                    forest.join(at + i, close)
        if forest.pairs:
            found = node[np.array(forest.pairs)]
            yield np.stack([found.min(axis=1), found.max(axis=1)], axis=1)


def _near_edges(prints: DataFrame, bits: int, tables: int, near: int, cap: int, similarity: float) -> DataFrame:
    """Pairs (a, b) that connect what near pairs connect."""
    more, near_small = plan_small(bits, tables, near, similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets(near, near_small, similarity)

        def made(found: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for e in found:
                yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(-1, 4)
                yield from made(buckets.add(batch.column(0).to_numpy(), batch.column(4).to_numpy(), batch.column(2).to_numpy(), raw, batch.column(3).to_numpy(), False))
        none = np.zeros(0, np.int64)
        yield from made(buckets.add(none, none, none, np.zeros((0, 4), np.uint64), none.astype(np.int32), True))

    # The partitions only spread the buckets: each bucket, or pair of blocks, is whole in one of them.
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = _table_rows(prints, bits, tables, more, counted=True).groupBy("bucket").count()
    large = durable(counts.where(F.col("count") > cap).select("bucket", F.ceil(F.col("count") / cap).cast("int").alias("blocks")))
    rows = _in_blocks(_table_rows(prints, bits, tables, more), "bucket", large, ["bucket", "print", "node", "n"])
    return rows.repartition(parts, "bucket", F.shiftright("piece", 1)).sortWithinPartitions("bucket", "piece", "node").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): node and label, the least node it is linked to.

    Labels spread along edges and jump along labels until none changes; every
    round is cut off from the one before.
    """
    ways = F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = durable(edges.select(F.inline(ways)).distinct())
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("other"))
        near = labels.join(seen, "node").select("node", "label", F.least("label", "other").alias("near"))
        jump = near.join(labels.select(F.col("node").alias("near"), F.col("label").alias("far")), "near")
        after = durable(jump.select("node", F.least("near", "far").alias("label"), (F.least("near", "far") < F.col("label")).alias("changed")))
        labels = after.select("node", "label")
        if not after.where("changed").limit(1).count():
            return labels


def shared_shingles(sets: list[np.ndarray], middle: int | None = None) -> np.ndarray:
    """How many shingles rows share: of rows before ``middle`` (or all) with rows from there on (or all).

    Shingles of few rows are counted pair by pair, the others by products of
    0/1 matrices of some columns at a time, so memory is bounded by the rows.
    """
    n = len(sets)
    left, right, first = (middle, n - middle, middle) if middle is not None else (n, n, 0)
    values = np.concatenate(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")  # equal shingles in order of rows
    values, row = values[order], row[order]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    heads = np.flatnonzero(new)
    counts = np.diff(np.append(heads, len(values)))
    out = np.zeros((left, right), np.float32)
    few = max(4, n // 64)
    rare = np.repeat((counts > 1) & (counts <= few), counts)
    ids, at = np.repeat(np.arange(len(heads)), counts)[rare], row[rare]
    for d in range(1, few):
        one, two = at[:-d], at[d:]
        hit = ids[:-d] == ids[d:]
        if not hit.any():
            break
        if middle is not None:
            hit &= (one < middle) & (two >= middle)
        np.add.at(out, (one[hit], two[hit] - first), 1)
    common = np.flatnonzero(counts > few)
    for k in range(0, len(common), 2048):
        some = common[k : k + 2048]
        block = np.zeros((n, len(some)), np.float32)
        for c, g in enumerate(some.tolist()):
            block[row[heads[g] : heads[g] + counts[g]], c] = 1
        out += block[:left] @ block[first:].T
    return out


def linked(sets: list[np.ndarray], middle: int | None = None, similarity: float = SIMILARITY, few: int = FEW) -> list[tuple[int, int]]:
    """Pairs of that Jaccard similarity that connect all rows which such pairs connect.

    Pairs are of a row before and one from ``middle`` on, or of any two rows.
    """
    n, forest = len(sets), _Forest(len(sets))
    if n <= few:
        for i in range(1 if middle is None else middle, n):
            for j in range(i if middle is None else middle):
                if forest.root[i] != forest.root[j] and jaccard(sets[i], sets[j]) >= similarity:
                    forest.join(i, np.array([j]))
        return forest.pairs
    if middle in (0, n):
        return []
    for i in range(1 if middle is None else middle, n):  # near copies of one text need no matrix
        if jaccard(sets[i], sets[0]) >= similarity:
            forest.join(i, np.array([0]))
    if middle is not None or len(forest.pairs) < n - 1:
        sizes = np.array([len(s) for s in sets], np.float64)
        both = shared_shingles(sets, middle)
        for i in range(1 if middle is None else middle, n):
            limit = i if middle is None else middle
            with_i = both[:limit, i - (middle or 0)].astype(np.float64)
            close = np.flatnonzero(with_i / (sizes[:limit] + sizes[i] - with_i) >= similarity)
            if len(close):
                forest.join(i, close)
    return forest.pairs


def _links(groups: DataFrame, docs: DataFrame, nodes: DataFrame, similarity: float, width: int, few: int, rows: int, shingles: int) -> DataFrame:
    """Links (a, b) that connect what pairs of that similarity within ``groups`` (node, label) connect."""
    members = durable(groups.join(nodes.select("node", "first", "n_shingles"), "node"))
    sizes = members.groupBy("label").agg(F.greatest(F.ceil(F.count(F.lit(1)) / rows), F.ceil(F.sum("n_shingles") / shingles)).cast("int").alias("blocks"))
    large = durable(sizes.where("blocks > 1"))
    wanted = members.select(F.col("first").alias("doc_id"), "node", "label")
    texts = docs.join(wanted, "doc_id").where(F.xxhash64("text") == F.col("node")).select("node", "label", "text")

    def pack():
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        return lambda part: {"node": part.column(0), "label": part.column(1), "packed": [squeeze(t.encode()) for t in part.column(2).to_pylist()]}

    packed = map_slices(texts, "node long, label long, packed binary", pack).dropDuplicates(["node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand, make = zstandard.ZstdDecompressor().decompress, Shingles(width)
        key, held = None, []

        def found() -> Iterator[pa.RecordBatch]:
            pairs = linked([x[2] for x in held], _middle(np.array([x[0] for x in held])), similarity, few) if len(held) > 1 else []
            if pairs:
                a, b = zip(*(sorted((held[i][1], held[j][1])) for i, j in pairs))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for label, piece, node, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (label, piece >> 1):
                    yield from found()
                    key, held = (label, piece >> 1), []
                held.append((piece, node, make.set(expand(blob).decode())))
        yield from found()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = _in_blocks(packed, "label", large, ["label", "node", "packed"]).select("label", "piece", "node", "packed")
    return placed.repartition(parts, "label", F.shiftright("piece", 1)).sortWithinPartitions("label", "piece", "node").mapInArrow(run, "a long, b long")


def _classes(docs: DataFrame, similarity: float, width: int, id_col: str, text_col: str, bucket: int = BUCKET, cap: int = CAP, few: int = FEW, block_rows: int = GROUP_ROWS, block_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """A row per document: doc_id, node (hash of its text), n_shingles, class (a node), class_id."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def each():
        shingles = Shingles(width)

        def step(part: pa.RecordBatch) -> dict:
            sets = [shingles.set(t) for t in part.column(2).to_pylist()]
            return {"doc_id": part.column(0), "node": part.column(1), "n_shingles": [len(s) for s in sets], "print": [shingles.fingerprint(s) for s in sets]}

        return step

    made = durable(map_slices(rows.select("doc_id", F.xxhash64("text").alias("node"), "text"), f"doc_id {kind}, node long, n_shingles long, print binary", each))
    known = made.where(F.col("doc_id").isNotNull())
    nodes = durable(known.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("print").alias("print"), F.max("n_shingles").alias("n_shingles")))
    prints = nodes.where("n_shingles > 0").select("node", "print", F.col("n_shingles").cast("int").alias("n"))
    bits, tables, near = plan(prints.count(), similarity, bucket)
    groups = components(_near_edges(prints, bits, tables, near, cap, similarity))
    labels = components(_links(groups, rows, nodes, similarity, width, few, block_rows, block_shingles))
    least = labels.join(nodes.select("node", "first"), "node").groupBy("label").agg(F.min("first").alias("class_id"))
    classes = labels.join(least, "label")
    of = nodes.select("node", "first").join(classes, "node", "left").select("node", F.coalesce("label", "node").alias("class"), F.coalesce("class_id", "first").alias("class_id"))
    return made.select("doc_id", "node", "n_shingles").join(of, "node", "left")


def near_duplicate_classes(docs: DataFrame, similarity: float = SIMILARITY, width: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """One row per document: doc_id, class_id, n_shingles.

    ``class_id`` is the least doc_id of the documents linked to this one,
    directly or through others, by equal texts or by shingle sets of at least
    that Jaccard similarity.  Words are separated by white space; a text of
    fewer than ``width`` words is one shingle, one without words is only like
    equal texts; a null text is the empty one.  A row with a null id is kept
    with a null class and links nothing.  Repeated rows share their class.
    Other columns are ignored; an empty table gives an empty result.  Equal
    texts are told by their 64-bit hashes.
    """
    found = _classes(docs, similarity, width, id_col, text_col, **options)
    return found.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"), "n_shingles")


def one_of_each_class(docs: DataFrame, similarity: float = SIMILARITY, width: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns kept, that are the least of their class.

    Of a class the least id stays; where several rows have it, that of the
    text of least 64-bit hash, and one of rows that have both in common.  Rows
    of one id with texts that aren't alike are in classes of their own, and
    each stays if it is the least of its class.  Rows with a null id all stay.
    """
    classes = _classes(docs, similarity, width, id_col, text_col)
    stay = durable(classes.where("doc_id is not null").groupBy("class").agg(F.min(F.struct("doc_id", "node")).alias("m")).select("m.*"))
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("doc_id"), key.alias("node"))
    kept = marked.where("doc_id is not null").join(stay, ["doc_id", "node"], "left_semi").dropDuplicates(["doc_id", "node"])
    return kept.select("row.*").unionByName(docs.where(F.col(id_col).isNull()))

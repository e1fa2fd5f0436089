"""Sharding by a minimax contiguous partition.

Rows with equal texts form an atomic group.  Groups are ordered by the hash of
their text, and the ordered groups are cut into ``shards`` contiguous runs so
that the largest run is as small as any such cut allows: the capacity is found
by binary search, each candidate checked greedily.

The group sizes are never collected.  The driver holds a histogram of the hash
range instead (a few thousand segments).  A segment can be cut nowhere or
anywhere as far as the driver knows, which bounds the answer from both sides;
only the segments in which a cut may fall are split further, one aggregation a
round, until the bounds meet.  A round splits each open segment by as many bits
of its own width, so the number of rounds grows with the logarithm of the
groups, and what a round brings to the driver with the open segments alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.llm.common import durable

#: Segments of the first histogram, as bits of the hash.
FIRST_BITS = 12
#: A segment in doubt is split into so many, as bits.
FANOUT_BITS = 8
#: Rows that are numbered in one sort; of a cell with more, such as a text that very many rows have, several are.
SORTED_ROWS = 1_000_000


@dataclass(frozen=True)
class Segment:
    """Groups whose unsigned hash is in [low, low + 2**bits)."""

    low: int
    bits: int
    size: int
    largest: int
    groups: int


def _walk(segments: list[Segment], capacity: int, shards: int, hopeful: bool) -> list[int]:
    """Greedy cuts: the segments in which shards 1, 2, ... begin, up to ``shards``.

    ``hopeful``: as if a segment of several groups could be cut at any byte;
    else as if it were one group.
    """
    cuts: list[int] = []
    used = 0
    for i, s in enumerate(segments):
        if used + s.size <= capacity:
            used += s.size
            continue
        cuts.append(i)
        if hopeful and s.groups > 1:
            used += s.size - capacity
            while used > capacity and len(cuts) < shards:
                used -= capacity
                cuts.append(i)
        else:
            used = s.size
        if len(cuts) >= shards:
            break
    return cuts


def _least(segments: list[Segment], shards: int, hopeful: bool, low: int) -> int:
    high = max(low, sum(s.size for s in segments))
    while low < high:
        middle = (low + high) // 2
        fits = hopeful or all(s.size <= middle for s in segments)
        if fits and len(_walk(segments, middle, shards, hopeful)) < shards:
            high = middle
        else:
            low = middle + 1
    return low


def minimax_cuts(groups: DataFrame, shards: int, first_bits: int = FIRST_BITS, fanout_bits: int = FANOUT_BITS) -> tuple[int, list[int]]:
    """The smallest capacity, and the hashes at which shards 1, 2, ... begin.

    ``groups``: one row per group with ``h`` (long, ordered as unsigned) and
    ``size``.
    """
    order = F.col("h").bitwiseXOR(F.lit(-(2**63)))  # unsigned order, as a signed long

    def histogram(frame: DataFrame, bits: Column) -> list[Segment]:
        rows = frame.groupBy(bits.cast("int").alias("b"), F.call_function("shiftright", order, bits.cast("int")).alias("k")).agg(F.sum("size").alias("s"), F.max("size").alias("m"), F.count(F.lit(1)).alias("n"), F.min(order).alias("at")).collect()
        return [Segment(r.at if r.n == 1 else r.k << r.b, 0 if r.n == 1 else r.b, r.s, r.m, r.n) for r in rows]

    segments = sorted(histogram(groups, F.lit(64 - first_bits)), key=lambda s: s.low)
    if not segments:
        return 0, []
    while True:
        floor = max(max(s.largest for s in segments), -(-sum(s.size for s in segments) // shards))
        low, high = _least(segments, shards, True, floor), _least(segments, shards, False, floor)
        # A greedy cut lies between where the two walks put it.
        slow, fast = _walk(segments, low, shards, False), _walk(segments, high, shards, True)
        doubt: set[int] = set()
        for j in range(max(len(slow), len(fast))):
            a, b = (x[j] if j < len(x) else len(segments) - 1 for x in (slow, fast))
            doubt.update(range(min(a, b), max(a, b) + 1))
        open_ = [i for i in sorted(doubt) if segments[i].groups > 1]
        if not open_:
            return high, [segments[i].low for i in _walk(segments, high, shards, False)]
        # Each by its own width: a wide segment beside a narrow one isn't split as finely.
        # Large ones first: they are why others are in doubt, which may be settled without splitting them.
        largest = max(segments[i].size for i in open_)
        open_ = [i for i in open_ if segments[i].size * 8 >= largest]
        wanted = [segments[i] for i in open_]
        bits, within = F.lit(None), F.lit(False)
        for width in sorted({s.bits for s in wanted}):
            own = F.lit(False)
            for a, b in _runs([s for s in wanted if s.bits == width]):
                own = own | order.between(F.lit(a), F.lit(b))
            bits, within = F.when(own, F.lit(max(0, width - fanout_bits))).otherwise(bits), within | own
        finer = histogram(groups.where(within), bits)
        known = set(open_)
        closed = [s for i, s in enumerate(segments) if i not in known]
        segments = sorted([*closed, *finer], key=lambda s: s.low)


def _runs(segments: list[Segment]) -> list[tuple[int, int]]:
    """Inclusive ranges of the hash that cover the segments, joined where they touch."""
    out: list[tuple[int, int]] = []
    for s in segments:
        a, b = s.low, s.low + (1 << s.bits) - 1
        if out and out[-1][1] + 1 == a:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", first_bits: int = FIRST_BITS, fanout_bits: int = FANOUT_BITS, sorted_rows: int = SORTED_ROWS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the text's UTF-8 bytes plus 1 (null: 1), ``text_crc32`` its
    unsigned CRC-32 (null: that of no bytes, 0), ``law`` is ``bytes`` and
    ``grown_shard`` null (only laws by key have it).  Equal texts share a
    shard, a null text counting as the empty one; rows of equal hash do too.
    ``slot`` numbers a shard's rows from 0 without gaps.  Repeated rows each
    get a slot.  An empty table gives an empty result; fewer groups than
    shards leave the last shards empty.  Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = durable(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("h")))
    groups = durable(rows.groupBy("h").agg(F.sum("size").alias("size")))
    _, cuts = minimax_cuts(groups, shards, first_bits, fanout_bits)
    order = F.col("h").bitwiseXOR(F.lit(-(2**63)))
    shard = F.lit(0)
    for at in cuts:
        shard = shard + F.when(order >= F.lit(at), 1).otherwise(0)
    # Slots: rows are numbered within small cells; a cell's first slot is the count of all rows before it.
    placed = rows.withColumns({"shard": shard.cast("int"), "cell": F.shiftright(order, 64 - first_bits)})
    counts = placed.groupBy("shard", "cell").agg(F.ceil(F.count(F.lit(1)) / sorted_rows).alias("parts"))  # 2**first_bits + shards rows at most
    placed = placed.join(F.broadcast(counts), ["shard", "cell"]).withColumn("salt", F.pmod(F.xxhash64("doc_id", "h"), F.col("parts")).cast("int")).drop("parts")
    cells = placed.groupBy("shard", "cell", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("cell", "salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("shard", "cell", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))  # as many rows and one more for every sorted_rows
    rank = F.row_number().over(Window.partitionBy("shard", "cell", "salt").orderBy("doc_id", "h"))
    return (
        placed.withColumn("rank", rank)
        .join(F.broadcast(starts), ["shard", "cell", "salt"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )

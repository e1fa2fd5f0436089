"""LM scoring by compression cross-entropy.

A text's cross-entropy under a corpus is taken as the bits a byte that
zstandard needs for it with a dictionary of that corpus.  Two dictionaries are
built, one from in-domain documents and one from all: the words of *every*
document are counted in one distributed aggregation.  What both dictionaries
would hold alike tells nothing, so a dictionary's raw content is first the words
of its side by which most bytes are saved *against the other side*: savings
times the logarithm of how much more frequent the word is there.  What room is
left goes to the words that save most anywhere.  The best ones come last, where
zstandard reaches them most cheaply.  The score is the difference of the two
sizes over the size without a dictionary; higher is more in-domain.
"""

from __future__ import annotations

import pickle

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import MAX_BROADCAST_BYTES, durable, id_and_text, map_slices

#: Least bytes of a dictionary, and counted bytes of the corpus for one byte of it beyond.
DICTIONARY_BYTES, CORPUS_BYTES = 65_536, 1024
LEVEL = 3
#: Ids of in-domain documents are broadcast up to so many; beyond, joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Words up to so many characters are counted whole, longer ones by windows of so many.
WORD_CHARS, WINDOW_CHARS = 16, 8
#: Of the windows of a long word those are counted whose first characters hash to a multiple of this.
EVERY = 4


def _pieces(word: Column) -> Column:
    """A word whole, or the windows of a long one.

    A long word, such as a line in a script without spaces, is cut into
    windows where its own characters say, so equal passages give equal windows
    wherever they stand; the window at its begin always counts.
    """
    step = 504  # a substring is reached by counting characters, so long words are taken in parts that overlap
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.char_length(word) - WINDOW_CHARS) / step).cast("int")), lambda i: F.substring(word, i * step + 1, F.lit(step + WINDOW_CHARS - 1)))
    windows = lambda part: F.transform(
        F.filter(F.sequence(F.lit(1), F.char_length(part) - WINDOW_CHARS + 1), lambda p: (p == 1) | (F.pmod(F.xxhash64(F.substring(part, p, F.lit(3))), F.lit(EVERY)) == 0)),
        lambda p: F.substring(part, p, F.lit(WINDOW_CHARS)),
    )
    return F.when(F.char_length(word) <= WORD_CHARS, F.array(word)).otherwise(F.flatten(F.transform(parts, windows)))


def word_counts(docs: DataFrame, in_domain: Column, text_col: str = "text") -> DataFrame:
    """Occurrences of every word in all documents and in the in-domain ones.

    Words are what white space separates, long ones counted by their windows;
    partial sums are formed before the one shuffle, so a frequent word is one
    row a task.
    """
    words = docs.select(F.explode(F.split(F.col(text_col), r"\s+")).alias("run"), F.when(in_domain, 1).otherwise(0).alias("in")).where("run <> ''")
    return words.select(F.explode(_pieces(F.col("run"))).alias("word"), "in").groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("in").alias("n_in"))


def dictionary(counts: DataFrame, column: str, size: int = DICTIONARY_BYTES, weight: Column | None = None) -> bytes:
    """Raw content: the words that save most, the best last.  At most ``size`` bytes.

    Savings are multiplied by ``weight``; words of none or less aren't taken.
    """
    saved = F.col(column) * F.char_length("word") * (F.lit(1.0) if weight is None else weight)
    step = F.floor(F.log(saved) * 16).alias("step")
    found = counts.where((F.col(column) > 1) & (saved > 0))
    # A histogram tells which words can fit at all, so that no task offers more than its share of them.
    room, least = size, 0
    for r in sorted(found.groupBy(step).agg(F.sum(F.octet_length("word") + 1).alias("bytes")).collect(), reverse=True):
        least, room = r.step, room - r.bytes
        if room <= 0:
            break
    rows = found.where(F.floor(F.log(saved) * 16) >= least).orderBy(saved.desc(), "word").select("word").limit(size // 3).toArrow().column(0)
    content, held = [], 0
    for r in rows:
        piece = r.as_py().encode() + b" "
        if held + len(piece) > size:
            break
        content.append(piece)
        held += len(piece)
    return b"".join(reversed(content))


def dictionaries(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", good: Column | None = None, size: int | None = None) -> tuple[bytes, bytes]:
    """The in-domain and the general dictionary.

    In-domain are the documents that ``labels`` marks (``good``: quality = 1);
    several rows of one id count as one mark.  Their size follows the bytes of
    the counted words unless given; what can't be broadcast is refused.
    """
    marked = labels.where(F.col("quality") == 1 if good is None else good).select(F.col(label_id).alias("_id")).where(F.col("_id").isNotNull()).distinct()
    size_of = marked.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(F.col("_id").cast("string"))), F.lit(0)).alias("bytes")).first()
    few = size_of.n <= BROADCAST_ROWS and size_of.bytes <= MAX_BROADCAST_BYTES
    marked = marked.withColumn("_in", F.lit(True))
    rows = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    joined = rows.join(F.broadcast(marked) if few else marked, F.col("_doc") == F.col("_id"), "left").select("text", "_in")
    counts = durable(word_counts(joined, F.col("_in")).where("n > 1"))
    sums = counts.agg(F.sum(F.col("n") * (F.octet_length("word") + 1)).alias("bytes"), F.sum("n").alias("n"), F.sum("n_in").alias("in")).first()
    if size is None:
        size = max(DICTIONARY_BYTES, (sums.bytes or 0) // CORPUS_BYTES)
    if 2 * size > MAX_BROADCAST_BYTES:
        raise ValueError(f"the dictionaries have {2 * size} bytes")
    ratio = F.log((F.col("n_in") + 0.5) * max(1, sums.n or 0) / ((F.col("n") + 0.5) * max(1, sums["in"] or 0)))

    def content(column: str, weight: Column) -> bytes:
        apart = dictionary(counts, column, size, weight)
        return dictionary(counts.where(weight <= 0), column, size - len(apart)) + apart

    return content("n_in", ratio), content("n", -ratio)


class Scorer:
    """Sizes of texts under the two dictionaries and none."""

    def __init__(self, in_domain: bytes, general: bytes, level: int = LEVEL) -> None:
        import zstandard

        def compressor(content: bytes | None):
            options = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
            if not content:
                return zstandard.ZstdCompressor(level=level, **options)
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            if len(content) <= DICTIONARY_BYTES:
                data.precompute_compress(level=level)
                return zstandard.ZstdCompressor(level=level, dict_data=data, **options)
            # Tables and window grow with the content, or its earlier words would be out of reach.
            log = len(content).bit_length()
            sizes = {"window_log": log + 1, "hash_log": max(17, log - 1), "chain_log": max(16, log - 2)}
            params = zstandard.ZstdCompressionParameters.from_level(level, dict_size=len(content), **sizes, **options)
            data.precompute_compress(compression_params=params)
            return zstandard.ZstdCompressor(dict_data=data, compression_params=params)

        self.compressors = [compressor(c) for c in (in_domain, general, None)]

    def sizes(self, text: bytes) -> tuple[int, int, int]:
        return tuple(len(c.compress(text)) for c in self.compressors)


def score(docs: DataFrame, in_domain: bytes, general: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, in_bits, general_bits, score.

    ``in_bits`` and ``general_bits`` are bits a byte; ``score`` is (general -
    in-domain) / plain size.  A null or empty text has 0 bytes and null bits
    and score.  Null ids and repeated rows are kept, other columns ignored.
    """
    kind = dict(docs.select(F.col(id_col).alias("doc_id")).dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps((in_domain, general)))

    def each():
        scorer = Scorer(*pickle.loads(shared.value))

        def step(part: pa.RecordBatch) -> dict:
            texts = [t.encode() for t in part.column(1).to_pylist()]
            sizes = [scorer.sizes(t) if t else None for t in texts]
            return {
                "doc_id": part.column(0),
                "n_bytes": [len(t) for t in texts],
                "in_bits": [8 * s[0] / len(t) if s else None for s, t in zip(sizes, texts)],
                "general_bits": [8 * s[1] / len(t) if s else None for s, t in zip(sizes, texts)],
                "score": [(s[1] - s[0]) / s[2] if s else None for s in sizes],
            }

        return step

    return map_slices(id_and_text(docs, id_col, text_col), f"doc_id {kind}, n_bytes long, in_bits double, general_bits double, score double", each)

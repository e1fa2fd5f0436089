"""Shared plumbing: reading tables, bounded Arrow batches, durable cut points."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.sources.durable import durable

__all__ = ["MAX_BROADCAST_BYTES", "SLICE_BYTES", "durable", "filter_slices", "id_and_text", "map_slices", "slices", "table"]

#: Bytes of text that one Python step holds at a time.
SLICE_BYTES = 8 << 20
#: A broadcast table may not be larger than this; every caller checks it.
MAX_BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the two columns an operator works on; a null text is the empty text."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds at most ``limit`` bytes (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def map_slices(df: DataFrame, schema: str, each: Callable[[], Callable[[pa.RecordBatch], dict | None]], column: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """``mapInArrow`` with bounded slices.

    ``each()`` runs once per task and returns the function that turns a slice
    into a dict of output columns.
    """
    out = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = each()
        for part in slices(batches, column, limit):
            if (made := step(part)) is not None:
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, out)


def filter_slices(df: DataFrame, text_col: str, each: Callable[[], Callable[[list[str | None]], list[bool]]], limit: int = SLICE_BYTES) -> DataFrame:
    """The rows of ``df``, all columns as they are, whose texts the step keeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = each()
        for part in slices(batches, text_col, limit):
            yield part.filter(pa.array(step(part.column(part.schema.get_field_index(text_col)).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)

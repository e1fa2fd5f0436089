"""The folder that all executors share, and cutting lineage in it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.errors import StaticError


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, which all executors share.

    Where it is unset a temporary folder is made, on one machine only: on a
    cluster the executors couldn't read it, so that is refused.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise StaticError("no_shared_folder", "set spark.checkpoint.dir")
    return tempfile.mkdtemp(prefix="larkspan-")


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, cut off from how it was made.

    The files stay until the driver ends, or are cleaned when no longer used
    where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Sorted rows, written once, with their place in the order from 0; a number per partition comes to the driver."""
    bits = 33  # of a row's place in its partition, as monotonically_increasing_id gives it
    kept = durable(df).withColumn("__id", F.monotonically_increasing_id())
    part = F.shiftright("__id", bits)
    sizes = {r.p: r.n for r in kept.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, so_far = {}, 0
    for p in sorted(sizes):
        before[p], so_far = so_far, so_far + sizes[p]
    offsets = F.create_map(*[F.lit(x).cast("long") for pair in before.items() for x in pair]) if before else F.lit(None).cast("map<bigint,bigint>")
    return kept.withColumn(name, F.try_element_at(offsets, part) + F.col("__id") - F.shiftleft(part, bits)).drop("__id")

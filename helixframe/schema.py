"""Conventional columns and the union of mixed records.

A stream of records is a wide DataFrame: a key that a record lacks is null. Records are ordered by ``__ord``, which sources
assign; operators that need an order take it, or the columns named by ``order_by``.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ORD = "__ord"
GAPS = ".-_~"
#: Lowest and highest score, and the character of score 0 of the two encodings.
SCORE_MIN, SCORE_MAX, BASE_33, BASE_64 = 0, 40, 33, 64


class DataError(ValueError):
    """Records that an operator can't work on."""


def has(df: DataFrame, *names: str) -> bool:
    """Whether all columns are there."""
    return all(n in df.columns for n in names)


def present(*names: str) -> Column:
    """True for records that have all keys."""
    return reduce(lambda a, b: a & b, [F.col(f"`{n}`").isNotNull() for n in names])


def mixed(*frames: DataFrame) -> DataFrame:
    """All records of all frames; keys that a frame lacks are null in its records."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def order_columns(df: DataFrame, order_by: str | list[str] | None) -> list[str]:
    """The columns that order the records; an error where there are none."""
    names = [order_by] if isinstance(order_by, str) else list(order_by or [])
    if not names and ORD in df.columns:
        names = [ORD]
    if not names:
        raise DataError(f"an order is needed: give order_by, or records with {ORD}")
    return names


def with_ordinal(df: DataFrame, name: str, order_by: str | list[str] | None = None) -> DataFrame:
    """Adds dense numbers from 0 in order, without a window over all rows.

    Rows are range partitioned, sorted, and written to the checkpoint folder with the number of their partition and of
    their place in it, so that a second run can't deal them otherwise. A row's number is its place and how many rows the
    partitions before have; the number of rows of a partition is all that reaches the driver, and is broadcast. Rows are
    shuffled once.
    """
    keys = [F.col(f"`{c}`") for c in order_columns(df, order_by)]
    # a partition has its number in the upper 31 bits of the ids, from 0 on in the lower 33
    dealt = checkpointed(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id()))
    part, place = F.shiftright("__id", 33).cast("int"), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    starts, base = [], 0
    for row in dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():
        starts.append((row["part"], base))
        base += row["n"]
    before = F.broadcast(df.sparkSession.createDataFrame(starts, "__part int, __before long"))
    return dealt.join(before, part == F.col("__part")).withColumn(name, place + F.col("__before")).drop("__id", "__part", "__before")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or what was set as the checkpoint folder.

    Where there is none, a local session (as in tests) gets a temporary one; on a cluster that is an error, as no executor
    could read what another one wrote.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not named and not sc.master.startswith("local"):
            raise DataError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="helixframe-checkpoint-"))
    return (named or sc._jsc.sc().getCheckpointDir().get()).rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so that several jobs read it and lost executors don't redo it.

    It is a Parquet table, whose size Spark knows: the size that it keeps for a checkpoint is an estimate of the plan
    before, which in a loop of joins grows without bound. Only rows with types that Parquet lacks are checkpointed.
    """
    folder = shared_folder(df.sparkSession)
    if any(t in df.schema.simpleString() for t in ("void", "interval")):
        return df.checkpoint()
    path = f"{folder}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sequence_records(df: DataFrame, source) -> DataFrame:
    """Records of a FASTA file, or a DataFrame with SEQ_NAME and SEQ as it is."""
    if isinstance(source, DataFrame):
        return source
    from .sources.fasta import read_fasta

    return read_fasta(df.sparkSession, None, input=source)

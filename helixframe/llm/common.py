"""Helpers that the operators of this package share."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..schema import checkpointed as frozen

__all__ = ["arrow_map", "default_vocabulary", "fold", "frozen", "frozen_texts", "heavy_keys", "id_and_text", "in_fold", "labelled_sample", "salted_join", "slices", "small_batches", "table", "utf8"]

#: A key is hot if it has more than this part of the rows, so that there are fewer hot keys than that.
HOT_SHARE = 1000
#: Over how many salts the rows of a hot key are dealt.
SALTS = 64
#: About how many bytes of a batch a Python worker takes apart at once.
AT_ONCE = 1 << 20
#: How many rows with texts Spark hands to a Python worker at once.
BATCH_ROWS = 500
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table through Spark, which alone may be able to open its path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, schema: str, each: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]]) -> DataFrame:
    """``mapInArrow`` for functions that yield a dict of columns for each batch."""
    out = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in each(batches):
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch], most: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most`` bytes, a row at least, so that what is made of them stays small.

    Spark's batches are of up to 10,000 rows or 64 MB, and a worker would hold the lists and results of whole ones.
    """
    for batch in batches:
        if batch.nbytes <= most:
            yield batch
            continue
        sizes = np.full(batch.num_rows, 8 * batch.num_columns, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
                sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(sizes) - sizes) // most
        cuts = np.flatnonzero(part[1:] != part[:-1]) + 1
        for i, j in itertools.pairwise([0, *cuts.tolist(), batch.num_rows]):
            yield batch.slice(i, j - i)


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Jobs begun within it hand Python workers at most ``rows`` rows at once; then the session's own setting holds again.

    With Spark's 10,000 rows the buffers of texts outside an executor's heap are of tens of MB each, grown by doubling and
    not given back, some hundreds of MB in time. Jobs of other threads of the session may get such batches meanwhile.
    """
    before = spark.conf.get(_BATCH_ROWS, None)
    if before is None or int(before) <= 0 or int(before) > rows:
        spark.conf.set(_BATCH_ROWS, rows)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BATCH_ROWS)
        else:
            spark.conf.set(_BATCH_ROWS, before)


def frozen_texts(df: DataFrame, rows: int = BATCH_ROWS) -> DataFrame:
    """:func:`frozen`, for a function of whole texts in Python workers, which get them in small batches."""
    with small_batches(df.sparkSession, rows):
        return frozen(df)


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id as ``doc_id`` (long) and the text as ``text``, whatever other columns there are."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo ``parts``; null ids have a null fold."""
    return F.crc32(F.col(id_col).cast("long").cast("string")) % F.lit(parts)


def in_fold(id_col: str, parts: int, held_out: int) -> Column:
    """Whether the id is in the held-out fold; an id that is null has no remainder and isn't."""
    return F.coalesce(fold(id_col, parts) == held_out, F.lit(False))


def labelled_sample(documents: DataFrame, labels: DataFrame, target: str, parts: int, held_out: int, most: int, most_bytes: int = 256 << 20) -> DataFrame:
    """At most ``most`` labelled documents outside the held-out fold, of ``most_bytes`` together, as (doc_id, text, label).

    The ids are drawn from ``labels`` by a hash of the id, so that the sample is the same at every run. An id that is
    labelled both ways teaches nothing and is left out; of rows that share an id the least text stands. The drawn ids are
    broadcast, ``most`` of them, so that no text is shuffled but the sample's, which is written to the shared folder.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold("doc_id", parts) != held_out))
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = id_and_text(documents).where("text IS NOT NULL").join(F.broadcast(drawn), "doc_id")
    sample = frozen(texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label")))
    sizes = sample.select("doc_id", F.xxhash64("doc_id").alias("h"), F.octet_length("text").alias("n")).orderBy("h", "doc_id").collect()  # ``most`` rows
    held = 0
    for k, r in enumerate(sizes):
        held += r.n
        if held > most_bytes:
            within = sample.sparkSession.createDataFrame([(r.doc_id,) for r in sizes[:k]], "doc_id long")
            return sample.join(F.broadcast(within), "doc_id", "left_semi")
    return sample


def heavy_keys(counts: DataFrame, keys: list[str], total: int, n: str = "n") -> DataFrame:
    """The hot keys of (keys, n): those with more than a ``HOT_SHARE``-th of ``total`` rows, of which there are fewer than that."""
    return counts.where(F.col(n) * HOT_SHARE > F.lit(total)).select(*keys)


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], heavy: DataFrame, how: str = "inner", by_merge: bool = False) -> DataFrame:
    """``left`` joined with ``right``, a row a key; a hot key's rows are dealt over salts by the partition that they come from.

    ``heavy`` has the hot keys, a bounded number (see :func:`heavy_keys`), which are broadcast. Keys must not be null. With
    ``by_merge`` neither side is, whatever size Spark takes it to have: it doesn't count the rows that ``explode`` adds.
    """
    hot = F.broadcast(heavy.select(*keys, F.lit(True).alias("__hot")))
    salt = F.when(F.col("__hot"), F.pmod(F.spark_partition_id(), F.lit(SALTS))).otherwise(0)
    salts = F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    dealt = left.join(hot, keys, "left").withColumn("__salt", salt).drop("__hot")
    spread = right.join(hot, keys, "left").withColumn("__salt", salts).drop("__hot")
    return dealt.join(spread.hint("merge") if by_merge else spread, [*keys, "__salt"], how).drop("__salt")


def default_vocabulary(name: str) -> str:
    """Path of a public tokenizer file; every operator takes the path as a parameter."""
    import public_tokenizers

    return str(Path(public_tokenizers.path(name)))

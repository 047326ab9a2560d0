"""Lines of text files, numbered without a shuffle."""

from __future__ import annotations

import bz2
import gzip
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import options as O
from ..schema import ORD, mixed


#: What a compressed file begins with, and the ending by which Spark knows it.
MAGIC = {b"\x1f\x8b": (".gz", gzip.open), b"BZh": (".bz2", bz2.open)}


def _misnamed(path: str):
    """How to open a local file whose ending doesn't tell how it is compressed, or None where Spark reads it rightly."""
    if not os.path.isfile(path):
        return None
    with open(path, "rb") as f:
        head = f.read(3)
    ending, opener = next((v for k, v in MAGIC.items() if head.startswith(k)), ("", open))
    by_name = next((e for e, _ in MAGIC.values() if path.endswith(e)), "")
    return None if ending == by_name or not head else opener


def _streamed(spark: SparkSession, path: str, opener, separator: str | None, size: int = 1 << 20) -> DataFrame:
    """The lines of a file that no reader of Spark's opens, read by one task as a stream, as such files can't be cut."""
    end = (separator or "\n").encode()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = lambda lines: pa.RecordBatch.from_arrays([pa.array([line.decode("utf-8", "replace") for line in lines], pa.string())], ["value"])
        for batch in batches:
            if not batch.num_rows:
                continue
            rest = b""
            with opener(path, "rb") as f:
                while block := f.read(size):
                    *lines, rest = (rest + block).split(end)
                    if lines:
                        yield pack(lines)
            if rest:
                yield pack([rest])

    return spark.range(0, 1, 1, 1).mapInArrow(read, "value string")


def numbered_lines(spark: SparkSession, paths, separator: str | None = None) -> DataFrame:
    """(file, n, value): lines with the index of their file, in the order given, and their number in it from 0.

    Spark reads the files in blocks and decompresses by file extension; local files whose first bytes belie their extension
    are decompressed by what they hold. The rows of each block are counted in a first pass
    over the files; these counts, one for a block, go to the driver and give each block its first number.
    """
    files = O.expand(paths)
    texts = []
    for i, path in enumerate(files):
        if opener := _misnamed(path):
            place = F.lit(path).alias("path"), F.lit(0).cast("long").alias("block")
            rows = _streamed(spark, path, opener, separator)
        else:
            place = F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")
            rows = (spark.read.option("lineSep", separator) if separator else spark.read).text(path)
        rows = rows.select("value", *place, F.monotonically_increasing_id().alias("id"))
        texts.append(rows.select(F.lit(i).alias("file"), "path", "block", "id", "value"))
    if not texts:
        return spark.createDataFrame([], "file int, n long, value string")
    rows = texts[0]
    for more in texts[1:]:
        rows = rows.union(more)
    blocks = rows.groupBy("file", "path", "block").agg(F.min("id").alias("first"), F.count("*").alias("rows")).orderBy("file", "path", "block").collect()
    starts, file, so_far = [], None, 0
    for b in blocks:
        if b.file != file:
            file, so_far = b.file, 0
        starts.append((b.file, b.path, b.block, so_far - b.first))
        so_far += b["rows"]
    shift = spark.createDataFrame(starts, "file int, path string, block long, shift long")
    return rows.join(shift, ["file", "path", "block"]).select("file", (F.col("id") + F.col("shift")).alias("n"), "value")


def in_order(rows: DataFrame, before: DataFrame | None, first: int | None, last: int | None) -> DataFrame:
    """Records read from files after those that came before, all in one order, and only the first or last if asked for."""
    from ..operators.order import first_records, last_records

    if first:
        rows = first_records(rows, first)
    elif last:
        rows = last_records(rows, last)
    if before is None:
        return rows
    if ORD in before.columns:
        end = before.agg(F.max(ORD)).first()[0]
        rows = rows.withColumn(ORD, F.col(ORD) + F.lit((end if end is not None else -1) + 1))
    return mixed(before, rows)


def check_input(o: dict) -> None:
    """An input that exists, and not both first and last."""
    O.required(o, "input")
    O.files_exist(o, "input")
    O.at_most_one(o, "first", "last")
    O.check(o, "first > 0", "last > 0")


#: Room for the records of one file in ``__ord``.
FILE_SPAN = 1 << 40

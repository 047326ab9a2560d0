"""Sorting, the first and last records, and counting them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import options as O
from ..pipeline import command
from ..schema import ORD, mixed, order_columns


@command(check=lambda o: O.required(o, "key"), key=None, reverse=False, block_size=None)
def sort(df: DataFrame, key: str, reverse: bool = False, block_size: int | None = None) -> DataFrame:
    """Records by a key, ties in their order. Spark sorts by ranges and spills; ``block_size`` is accepted and not needed."""
    keys = [F.col(f"`{key}`").desc() if reverse else F.col(f"`{key}`").asc()]
    return df.orderBy(*keys, *[F.col(ORD)] * (ORD in df.columns and key != ORD))


def first_records(df: DataFrame, number: int, order_by=None) -> DataFrame:
    """The first records in order."""
    return df.orderBy(*order_columns(df, order_by)).limit(number)


def last_records(df: DataFrame, number: int, order_by=None) -> DataFrame:
    """The last records, in order."""
    names = order_columns(df, order_by)
    return df.orderBy(*[F.col(f"`{c}`").desc() for c in names]).limit(number).orderBy(*names)


def check_first_last(o: dict) -> None:
    """At most one of the two, and positive."""
    O.at_most_one(o, "first", "last")
    O.check(o, "first > 0", "last > 0")


@command(check=check_first_last, first=None, last=None, order_by=None, show=True)
def dump(df: DataFrame, first: int | None = None, last: int | None = None, order_by=None, show: bool = True) -> DataFrame:
    """Prints records and passes them on; with ``first`` or ``last`` only those. No more than 20 are printed without."""
    if first:
        df = first_records(df, first, order_by) if order_by or ORD in df.columns else df.limit(first)
    elif last:
        df = last_records(df, last, order_by)
    if show:
        for row in df.limit(first or last or 20).toLocalIterator():
            print({k: v for k, v in row.asDict().items() if v is not None and k != ORD})
    return df


@command(check=lambda o: O.not_yet_there(o, "output"), output=None, force=False)
def count(df: DataFrame, output: str | None = None, force: bool = False) -> DataFrame:
    """Appends a record with the number of records; ``output`` also gets it as a table."""
    total = df.agg(F.lit("count").alias("RECORD_TYPE"), F.count("*").alias("COUNT"))
    if output:
        from ..sinks.text import write_lines

        write_lines(total.select(F.concat(F.lit("#RECORD_TYPE\tCOUNT\ncount\t"), F.col("COUNT").cast("string")).alias("value")), output, force=force)
    return mixed(df, total)

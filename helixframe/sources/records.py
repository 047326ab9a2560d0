"""Records that are tables already."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import options as O
from ..pipeline import command
from ..schema import mixed


@command(source=True, check=lambda o: O.required(o, "input"), input=None, format="parquet")
def read_records(spark: SparkSession, before: DataFrame | None, input: str, format: str = "parquet") -> DataFrame:
    """A table in any format that Spark reads; its own columns order the records."""
    rows = spark.read.format(format).load(input)
    return rows if before is None else mixed(before, rows)

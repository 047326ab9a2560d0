"""Cluster and search results in the tabular .uc format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..pipeline import command
from ..schema import ORD
from .lines import FILE_SPAN, check_input, in_order, numbered_lines


@command(source=True, check=check_input, input=None, first=None, last=None)
def read_uc(spark: SparkSession, before: DataFrame | None, input, first=None, last=None) -> DataFrame:
    """TYPE, CLUSTER, CLUSTER_SIZE of clusters (C), SEQ_LEN and STRAND and CIGAR of others, IDENT and S_ID of hits (H), Q_ID."""
    rows = numbered_lines(spark, input).where(F.length(F.trim("value")) > 0).withColumn("f", F.split("value", "\t", -1))
    part = lambda k: F.try_element_at("f", F.lit(k + 1))
    kind, cluster, hit = part(0), part(0) == "C", part(0) == "H"
    out = rows.select(
        (F.col("file") * F.lit(FILE_SPAN) + F.col("n")).alias(ORD), kind.alias("TYPE"), part(1).try_cast("long").alias("CLUSTER"), F.when(cluster, part(2).try_cast("long")).alias("CLUSTER_SIZE"), F.when(~cluster, part(2).try_cast("long")).alias("SEQ_LEN"),
        F.when(hit, part(3).try_cast("double")).alias("IDENT"), F.when(~cluster, part(4)).alias("STRAND"), F.when(~cluster, part(7)).alias("CIGAR"), part(8).alias("Q_ID"), F.when(hit, part(9)).alias("S_ID"),
    )
    return in_order(out, before, first, last)

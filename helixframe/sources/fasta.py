"""FASTA."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..pipeline import command
from ..schema import ORD
from .lines import FILE_SPAN, check_input, in_order, numbered_lines


def parse_fasta(text: str) -> Iterator[tuple[str, str]]:
    """(name, sequence) of each entry of a small text."""
    for entry in ("\n" + text).split("\n>")[1:]:
        name, _, seq = entry.partition("\n")
        yield name.strip(), "".join(seq.split())


@command(source=True, check=check_input, input=None, first=None, last=None)
def read_fasta(spark: SparkSession, before: DataFrame | None, input, first: int | None = None, last: int | None = None) -> DataFrame:
    """Entries as SEQ_NAME, SEQ and SEQ_LEN, files in the order given, after the records that came before.

    Entries are split where a line begins with ``>``, so large files are read in blocks. An empty name, or text before the
    first name, fails when it is reached.
    """
    rows = numbered_lines(spark, input, "\n>").where(F.length(F.trim("value")) > 0)
    entry = F.when((F.col("n") == 0) & ~F.ltrim("value").startswith(">"), F.raise_error(F.concat(F.lit("no FASTA entry: "), F.substring("value", 1, 40))).cast("string")).otherwise(F.regexp_replace("value", r"^\s*>", ""))
    name = F.trim(F.regexp_replace(F.substring_index("entry", "\n", 1), "\r", ""))
    seq = F.when(F.instr("entry", "\n") > 0, F.regexp_replace(F.expr("substring(entry, instr(entry, '\n') + 1)"), r"\s+", "")).otherwise("")
    named = F.when(name == "", F.raise_error(F.lit("a FASTA entry without a name")).cast("string")).otherwise(name)
    out = rows.withColumn("entry", entry).select((F.col("file") * F.lit(FILE_SPAN) + F.col("n")).alias(ORD), named.alias("SEQ_NAME"), seq.alias("SEQ"))
    return in_order(out.withColumn("SEQ_LEN", F.length("SEQ").cast("long")), before, first, last)

"""FASTQ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import options as O
from ..functions import sequence as S
from ..pipeline import command
from ..schema import BASE_33, BASE_64, ORD, DataError
from .lines import FILE_SPAN, check_input, in_order, numbered_lines


def _check(o: dict) -> None:
    check_input(o)
    O.files_exist(o, "input2")
    O.allowed_values(o, encoding=("auto", "base_33", "base_64"))
    O.tie(o, reverse_complement="input2")


def _entries(spark: SparkSession, paths) -> DataFrame:
    """(file, entry, name, seq, scores): four lines each, by their number, whatever they begin with."""
    lines = numbered_lines(spark, paths).withColumn("entry", F.floor(F.col("n") / 4)).withColumn("part", F.col("n") % 4)
    part = lambda k: F.max(F.when(F.col("part") == k, F.regexp_replace("value", "\r$", "")))
    entries = lines.groupBy("file", "entry").agg(part(0).alias("head"), part(1).alias("seq"), part(2).alias("plus"), part(3).alias("scores"))
    entries = entries.where(F.length(F.trim(F.coalesce("head", F.lit("")))) > 0)
    sound = F.col("head").startswith("@") & F.col("plus").startswith("+") & (F.length("seq") == F.length("scores"))
    name = F.when(sound, F.expr("substring(head, 2)")).otherwise(F.raise_error(F.concat(F.lit("no FASTQ entry: "), F.col("head"))).cast("string"))
    return entries.select("file", "entry", name.alias("name"), "seq", "scores")


def _base(entries: DataFrame, encoding: str) -> Column:
    """The base of the scores of each file: given, or by the characters of its first 1000 entries."""
    if encoding != "auto":
        return F.lit(BASE_33 if encoding == "base_33" else BASE_64)
    head = entries.where("entry < 1000").groupBy("file").agg(F.max(S.is_base_33("scores")).alias("low"), F.max(S.is_base_64("scores")).alias("high")).collect()
    bases = {}
    for r in head:
        if not (r.low or r.high):
            raise DataError("the encoding of the scores can't be told; give base_33 or base_64")
        bases[r.file] = BASE_33 if r.low else BASE_64
    return F.create_map(*[F.lit(x) for kv in (bases or {0: BASE_33}).items() for x in kv])[F.col("file")]


def _records(entries: DataFrame, encoding: str) -> DataFrame:
    base = _base(entries, encoding)
    scores = F.when(base == BASE_64, S.scores_convert("scores", BASE_64, BASE_33)).otherwise(F.col("scores"))
    return entries.withColumn("scores", S.scores_coerce(scores))


@command(source=True, check=_check, input=None, input2=None, encoding="auto", first=None, last=None, reverse_complement=False)
def read_fastq(spark: SparkSession, before: DataFrame | None, input, input2=None, encoding: str = "auto", first: int | None = None, last: int | None = None, reverse_complement: bool = False) -> DataFrame:
    """Entries as SEQ_NAME, SEQ, SEQ_LEN and SCORES (base 33, 0 to 40). Mates of ``input2`` follow those of ``input`` each."""
    one = _records(_entries(spark, input), encoding)
    at = F.col("file") * F.lit(FILE_SPAN) + F.col("entry")
    if input2:
        two = _records(_entries(spark, input2), encoding)
        if reverse_complement:
            two = two.withColumn("seq", S.reverse_complement("seq")).withColumn("scores", F.reverse("scores"))
        mate = lambda df, k: df.select("file", "entry", F.struct("name", "seq", "scores", F.lit(k).alias("mate")).alias(f"m{k}"))
        both = mate(one, 0).join(mate(two, 1), ["file", "entry"]).select("file", "entry", F.explode(F.array("m0", "m1")).alias("m"))
        rows = both.select((2 * at + F.col("m.mate")).alias(ORD), "m.name", "m.seq", "m.scores")
    else:
        rows = one.select(at.alias(ORD), "name", "seq", "scores")
    out = rows.select(ORD, F.col("name").alias("SEQ_NAME"), F.col("seq").alias("SEQ"), F.length("seq").cast("long").alias("SEQ_LEN"), F.col("scores").alias("SCORES"))
    return in_order(out, before, first, last)

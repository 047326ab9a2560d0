"""Operators that select records."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import options as O
from ..functions import sequence as S
from ..pipeline import command
from ..schema import ORD, order_columns, sequence_records, with_ordinal

_MODES = ("select", "select_file", "reject", "reject_file", "evaluate")
_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def _check_grab(o: dict) -> None:
    O.one_of(o, *_MODES)
    O.conflict(o, keys_only="values_only", ignore_case="exact")
    O.conflict(o, evaluate="exact")
    O.files_exist(o, "select_file", "reject_file")


@command(check=_check_grab, select=None, select_file=None, reject=None, reject_file=None, evaluate=None, keys=None, keys_only=False, values_only=False, ignore_case=False, exact=False)
def grab(df: DataFrame, select=None, select_file=None, reject=None, reject_file=None, evaluate=None, keys=None, keys_only=False, values_only=False, ignore_case=False, exact=False) -> DataFrame:
    """Records where a pattern matches a key or a value, or those where none does.

    Patterns are regular expressions, or with ``exact`` whole values of the same type. ``keys`` restricts what is looked
    at; the names of such keys count even in records that lack them. ``evaluate`` is an expression in which ``:KEY`` is
    the value of a key; records that lack one are left out. Patterns of a file with ``exact`` are joined, as there may be
    many.
    """
    if evaluate is not None:
        return df.where(_expression(df, evaluate))
    inverted = reject is not None or reject_file is not None
    names = O.listed(keys) if keys else [c for c in df.columns if c != ORD]
    file = select_file or reject_file
    if file and exact:
        return _grab_listed(df, file, names, keys, inverted, keys_only, values_only)
    patterns = _lines(file) if file else O.listed(select if select is not None else reject)
    tests: list[Column] = []
    for name in names:
        here = F.col(f"`{name}`").isNotNull() if name in df.columns else F.lit(False)
        if not values_only and _name_hit(name, patterns, exact, ignore_case):
            tests.append(F.lit(True) if keys else here)
        if not keys_only and name in df.columns:
            tests.append(here & _value_test(df, name, patterns, exact, ignore_case))
    hit = reduce(lambda a, b: a | b, tests, F.lit(False))
    return df.where(~hit if inverted else hit)


def _lines(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        return [line.strip() for line in f if line.strip()]


def _name_hit(name: str, patterns: list, exact: bool, ignore_case: bool) -> bool:
    if exact:
        return name in patterns
    return any(re.search(str(p), name, re.I if ignore_case else 0) for p in patterns)


def _value_test(df: DataFrame, name: str, patterns: list, exact: bool, ignore_case: bool) -> Column:
    col = F.col(f"`{name}`")
    if not exact:
        prefix = "(?i)" if ignore_case else ""
        return reduce(lambda a, b: a | b, [col.cast("string").rlike(prefix + str(p)) for p in patterns], F.lit(False))
    number = isinstance(df.schema[name].dataType, _NUMBERS)
    same = [p for p in patterns if isinstance(p, (int, float)) == number]
    return col.isin(*same) if same else F.lit(False)


def _grab_listed(df: DataFrame, file: str, names: list[str], keys, inverted: bool, keys_only: bool, values_only: bool) -> DataFrame:
    """Exact values of a file: a semi or anti join for each key, broadcast by Spark if the list is small."""
    wanted = df.sparkSession.read.text(file).select(F.trim("value").alias("__wanted")).where("__wanted <> ''").distinct()
    if not values_only:
        hit = {r[0] for r in wanted.where(F.col("__wanted").isin(*names)).collect()}  # no more than there are keys
        named = [F.lit(True) if keys else F.col(f"`{n}`").isNotNull() for n in names if n in hit and (keys or n in df.columns)]
    else:
        named = []
    by_name = reduce(lambda a, b: a | b, named, F.lit(False))
    texts = [] if keys_only else [n for n in names if n in df.columns and isinstance(df.schema[n].dataType, T.StringType)]
    marked = df.withColumn("__hit", by_name)
    for n in texts:
        marked = marked.join(wanted.select(F.col("__wanted").alias("__w"), F.lit(True).alias("__found")), F.col(f"`{n}`") == F.col("__w"), "left")
        marked = marked.withColumn("__hit", F.col("__hit") | F.coalesce("__found", F.lit(False))).drop("__w", "__found")
    return marked.where(~F.col("__hit") if inverted else F.col("__hit")).drop("__hit")


def _expression(df: DataFrame, text: str) -> Column:
    """An expression over ``:KEY`` tokens as SQL; it is parsed by Spark and never evaluated as a program."""
    used = []

    def column(m: re.Match) -> str:
        used.append(m[1])
        return f"`{m[1]}`"

    sql = re.sub(r"(?<![\w:]):([A-Za-z_]\w*)", column, text)
    sql = re.sub(r"==", "=", sql).replace("&&", " AND ").replace("||", " OR ")
    if any(k not in df.columns for k in used):
        return F.lit(False)
    return F.coalesce(F.expr(sql), F.lit(False))


@command(check=lambda o: O.required(o, "key"), key=None, invert=False, order_by=None)
def unique_values(df: DataFrame, key: str, invert: bool = False, order_by=None) -> DataFrame:
    """The first record of each value, or with ``invert`` the others; records without the key pass in both cases.

    The first of each value is found by an aggregation with map-side combining and joined back, so that a value that many
    records share doesn't meet in one sort.
    """
    if key not in df.columns:
        return df
    order = [F.col(f"`{c}`") for c in order_columns(df, order_by)]
    first = df.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("__key")).agg(F.min(F.struct(*order)).alias("__first"))
    joined = df.withColumn("__at", F.struct(*order)).join(first, F.col(f"`{key}`") == F.col("__key"), "left")
    is_first = F.col("__at") == F.col("__first")
    keep = F.col(f"`{key}`").isNull() | (~is_first if invert else is_first)
    return joined.where(keep).select(*df.columns)


def _check_random(o: dict) -> None:
    O.required(o, "number")
    O.check(o, "number > 0")


@command(check=_check_random, number=None, pairs=False, seed=42, order_by=None)
def random(df: DataFrame, number: int, pairs: bool = False, seed: int = 42, order_by=None) -> DataFrame:
    """A random sample of exactly ``number`` records (all, if fewer), or of ``number / 2`` pairs of successive records.

    The sample is drawn by a hash of the order and the seed, so that it is the same at every run.
    """
    names = order_columns(df, order_by)
    if not pairs:
        draw = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(f"`{c}`").cast("string") for c in names]))
        return df.withColumn("__draw", draw).orderBy("__draw", *names).limit(number).drop("__draw").orderBy(*names)
    numbered = with_ordinal(df, "__n", names).withColumn("__pair", F.floor(F.col("__n") / 2))
    whole = numbered.groupBy("__pair").agg(F.count("*").alias("n")).where("n = 2")
    drawn = whole.withColumn("__draw", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("__pair").cast("string")))).orderBy("__draw", "__pair").limit(number // 2).select("__pair")
    return numbered.join(drawn, "__pair", "left_semi").select(*df.columns).orderBy(*names)


def _check_reference(name: str):
    def check(o: dict) -> None:
        O.required(o, name)
        if not isinstance(o[name], DataFrame):
            O.files_exist(o, name)

    return check


@command(check=_check_reference("ref_fasta"), ref_fasta=None, ref_index=None, kmer_size=12, shared=0.5)
def filter_rrna(df: DataFrame, ref_fasta, ref_index=None, kmer_size: int = 12, shared: float = 0.5) -> DataFrame:
    """Drops sequences that share at least this part of their k-mers with the reference sequences of either strand.

    A native stand-in for an alignment program: ``ref_index`` is accepted and not needed.
    """
    if "SEQ" not in df.columns:
        return df
    refs = sequence_records(df, ref_fasta).select("SEQ")
    both = refs.union(refs.select(S.reverse_complement("SEQ")))
    known = both.select(F.explode(S.kmers("SEQ", kmer_size)).alias("kmer")).distinct()
    keyed = df.withColumn("__id", F.xxhash64("SEQ"))
    seqs = keyed.where("SEQ IS NOT NULL").select("__id", "SEQ").dropDuplicates(["__id", "SEQ"])
    kmers = seqs.select("__id", S.kmers("SEQ", kmer_size).alias("all")).select("__id", F.size("all").alias("n"), F.explode("all").alias("kmer"))
    hits = kmers.join(known, "kmer", "left_semi").groupBy("__id", "n").agg(F.count("*").alias("common")).where(F.col("common") >= shared * F.col("n"))
    return keyed.join(hits.select("__id").distinct(), "__id", "left_anti").select(*df.columns)


@command(check=_check_reference("database"), database=None, cpus=1, kmer_size=8, margin=0.2)
def uchime_ref(df: DataFrame, database, cpus: int = 1, kmer_size: int = 8, margin: float = 0.2) -> DataFrame:
    """Keeps sequences that aren't chimeras of two database sequences.

    A native heuristic: the database sequence that shares most k-mers is found for each half. A chimera's halves have
    different ones, and each is better in its half, by more than ``margin`` of the k-mers, than the other's.
    """
    if "SEQ" not in df.columns:
        return df
    refs = sequence_records(df, database).select(F.xxhash64("SEQ_NAME", "SEQ").alias("ref"), F.explode(S.kmers("SEQ", kmer_size)).alias("kmer"))
    keyed = df.withColumn("__id", F.xxhash64("SEQ"))
    half = F.floor(F.length("SEQ") / 2).cast("int")
    halves = F.explode(F.array(F.struct(F.lit(0).alias("half"), F.substring(F.col("SEQ"), F.lit(1), half).alias("part")), F.struct(F.lit(1).alias("half"), F.substring(F.col("SEQ"), half + 1, F.length("SEQ")).alias("part"))))
    parts = keyed.where("SEQ IS NOT NULL").select("__id", "SEQ").dropDuplicates(["__id"]).select("__id", halves.alias("h"))
    parts = parts.select("__id", "h.half", F.explode(S.kmers("h.part", kmer_size)).alias("kmer"))
    size = parts.groupBy("__id", "half").agg(F.count("*").alias("n"))
    shared = parts.join(refs, "kmer").groupBy("__id", "half", "ref").agg(F.count("*").alias("common"))
    scored = shared.join(size, ["__id", "half"]).withColumn("share", F.col("common") / F.col("n"))
    wide = scored.groupBy("__id", "ref").agg(*[F.coalesce(F.max(F.when(F.col("half") == h, F.col("share"))), F.lit(0.0)).alias(f"s{h}") for h in (0, 1)])
    best = wide.groupBy("__id").agg(*[F.max(F.struct(f"s{h}", f"s{1 - h}", "ref")).alias(f"b{h}") for h in (0, 1)])
    chimera = best.where((F.col("b0.ref") != F.col("b1.ref")) & (F.col("b0.s0") > F.col("b1.s0") + margin) & (F.col("b1.s1") > F.col("b0.s1") + margin))
    return keyed.join(chimera.select("__id"), "__id", "left_anti").select(*df.columns)

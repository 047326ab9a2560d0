"""Operators that join records with tables and sequence databases."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import options as O
from ..functions import search
from ..functions import sequence as S
from ..pipeline import command
from ..schema import DataError, mixed, sequence_records


def _check_merge_table(o: dict) -> None:
    O.required(o, "input", "key")
    if isinstance(o["input"], str):
        O.files_exist(o, "input")


@command(check=_check_merge_table, input=None, key=None, keys=None, columns=None, skip=0, delimiter=None, unique=True)
def merge_table(df: DataFrame, input, key: str, keys=None, columns=None, skip: int = 0, delimiter=None, unique: bool = True) -> DataFrame:
    """The columns of a table (a file or a DataFrame) for records that share its key; the table's values win.

    Records without a match stay as they are. A key that occurs twice in the table is an error. Spark broadcasts the table
    if it is small enough, and shuffles both sides otherwise.
    """
    if isinstance(input, DataFrame):
        table = input
    else:
        from ..sources.table import read_table

        table = read_table(df.sparkSession, None, input=input, keys=keys, select=columns, skip=skip, delimiter=delimiter).drop("__ord")
    if key not in df.columns or key not in table.columns:
        return df
    if unique:
        twice = table.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").first()
        if twice is not None:
            raise DataError(f"{key} occurs {twice['count']} times in the table: {twice[0]}")
    others = [c for c in table.columns if c != key]
    side = table.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__t_{c}") for c in others])
    joined = df.join(side, F.col(f"`{key}`") == F.col("__key"), "left")
    merged = {c: F.coalesce(F.col(f"__t_{c}"), F.col(c).cast(table.schema[c].dataType)) if c in df.columns else F.col(f"__t_{c}") for c in others}
    return joined.withColumns(merged).drop("__key", *[f"__t_{c}" for c in others])


#: Shorter k-mers than this are shared by so many sequences that comparing all of a fitting length costs less.
LEAST_KMER = 6


def similar(queries: DataFrame, targets: DataFrame, identity: float, size: int = 8, strand: str = "plus", local: bool = False) -> DataFrame:
    """(q_id, q, s_id, s, ident, strand): pairs of sequences at least this similar.

    ``queries`` has q_id and q, ``targets`` s_id and s. A query of n residues in which the identity allows e edits is cut by
    them into at most e + 1 runs that stay whole, so that it shares a k-mer of k = n / (e + 1) residues (``size`` at most) with each
    similar target; residues are of any alphabet. Pairs that share enough k-mers are found by joining them. Queries for which k
    is below ``LEAST_KMER``, unless no edit is allowed, are compared with all targets of a length that fits. All pairs are then
    verified: identity is 1 less edit distance by the greater length, or for ``local`` 1 less the fewest edits between the query
    and any stretch of the target, by the length of the query.
    """
    turned = queries.withColumn("strand", F.lit("+"))
    if strand == "both":
        turned = turned.union(queries.select("q_id", S.reverse_complement("q"), F.lit("-")))
    allowed = lambda n: F.floor((1 - identity) * n + 1e-6).cast("long")  # noqa: E731  (0.1 * 10 is one edit)
    n, m = F.length("q"), F.length("s")
    most = allowed(n) if local else allowed(n / F.lit(identity))  # a similar target is no longer than n / identity
    k = F.least(F.lit(size), F.floor(n / (most + 1)))
    turned = turned.withColumn("q", F.upper("q")).where("length(q) > 0")
    turned = turned.withColumn("k", F.when((k >= min(size, LEAST_KMER)) | (most == 0), k).otherwise(0).cast("int"))
    targets = targets.withColumn("s", F.upper("s")).where("length(s) > 0")
    edits = allowed(n) if local else allowed(F.greatest(n, m))
    pairs = ["q_id", "q", "strand", "s_id", "s"]

    near = m >= n - allowed(n) if local else (F.least(n, m) >= F.greatest(n, m) - edits)
    by_length = turned.where("k = 0")
    if local or identity >= 1:
        found = by_length.join(targets, near).select(*pairs)
    else:  # lengths that fit are in one class or in two that are neighbours
        of = lambda x: F.floor(F.log(x) / -math.log(identity)).cast("long")
        around = by_length.withColumn("class", F.explode(F.array(*[of(n) + d for d in (-2, -1, 0, 1, 2)])))
        found = around.join(targets.withColumn("class", of(m)), "class").where(near).select(*pairs)
    for width in sorted(r.k for r in turned.where("k > 0").select("k").distinct().collect()):  # no more than ``size``
        left = turned.where(F.col("k") == width).select("q_id", "strand", F.array_distinct(S.naive_kmers("q", width)).alias("all"))
        left = left.select("q_id", "strand", F.size("all").alias("n"), F.explode("all").alias("kmer"))
        right = targets.select("s_id", F.explode(F.array_distinct(S.naive_kmers("s", width))).alias("kmer"))
        shared = left.join(right, "kmer").groupBy("q_id", "strand", "s_id", "n").agg(F.count("*").alias("common"))
        both = shared.join(turned.where(F.col("k") == width), ["q_id", "strand"]).join(targets, "s_id")
        # each edit can cost as many k-mers as one has residues
        found = found.union(both.where(near & (F.col("common") >= F.greatest(F.lit(1), F.col("n") - edits * width))).select(*pairs))
    distance = F.levenshtein("q", "s")
    if local:  # the rest of the target costs its residues, and up to as many more as there are edits
        found = found.where(distance - F.greatest(m - n, F.lit(0)) <= 2 * allowed(n)).withColumn("ident", 1 - search.fitting_distance("q", "s") / n)
    else:
        found = found.withColumn("ident", 1 - distance / F.greatest(n, m))
    return found.where(F.col("ident") >= identity - 1e-9).select("q_id", "q", "s_id", "s", "ident", "strand")


def _check_search(o: dict) -> None:
    O.required(o, "database", "identity")
    if not isinstance(o["database"], DataFrame):
        O.files_exist(o, "database")
    O.allowed_values(o, strand=("plus", "both"))
    O.check(o, "identity > 0.0", "identity <= 1.0", "cpus >= 1")


def _search(df: DataFrame, database, identity: float, strand: str, local: bool, kmer_size: int) -> DataFrame:
    if not {"SEQ", "SEQ_NAME"} <= set(df.columns):
        return df
    queries = df.where("SEQ IS NOT NULL AND SEQ_NAME IS NOT NULL").select(F.col("SEQ_NAME").alias("q_id"), F.col("SEQ").alias("q")).distinct()
    targets = sequence_records(df, database).select(F.col("SEQ_NAME").alias("s_id"), F.col("SEQ").alias("s"))
    found = similar(queries, targets, identity, kmer_size, strand, local)
    best = Window.partitionBy("q_id").orderBy(F.desc("ident"), "s_id", "strand")
    hits = found.withColumn("n", F.row_number().over(best)).where("n = 1")
    rows = hits.select(
        F.lit("usearch").alias("RECORD_TYPE"), F.lit("H").alias("TYPE"), F.length("q").cast("long").alias("SEQ_LEN"), F.round(100 * F.col("ident"), 1).alias("IDENT"), F.col("strand").alias("STRAND"), F.col("q_id").alias("Q_ID"), F.col("s_id").alias("S_ID"),
    )
    return mixed(df, rows)


@command(check=_check_search, database=None, identity=None, strand="plus", cpus=1, kmer_size=8)
def usearch_global(df: DataFrame, database, identity: float, strand: str = "plus", cpus: int = 1, kmer_size: int = 8) -> DataFrame:
    """Appends a hit record for the most similar database sequence of each sequence, end to end."""
    return _search(df, database, identity, strand, False, kmer_size)


@command(check=_check_search, database=None, identity=None, strand="plus", cpus=1, kmer_size=8)
def usearch_local(df: DataFrame, database, identity: float, strand: str = "plus", cpus: int = 1, kmer_size: int = 8) -> DataFrame:
    """Appends a hit record for the database sequence with the stretch that is most similar to each whole sequence."""
    return _search(df, database, identity, strand, True, kmer_size)


def maximal_matches(queries: DataFrame, targets: DataFrame, least: int = 20, direction: str = "both", seed: int = 12) -> DataFrame:
    """(q_id, s_id, dir, q_beg, s_beg, hit_len): maximal exact matches of sequences, places from 0.

    Shared k-mers are joined; those on one diagonal that follow each other closely are islands, and a match is an island
    that is long enough. ``queries`` has id and seq, and so has ``targets``.
    """
    size = min(seed, least)
    q = queries.select(F.col("id").alias("q_id"), F.upper("seq").alias("seq"), F.lit("forward").alias("dir"))
    turned = queries.select(F.col("id").alias("q_id"), S.reverse_complement(F.upper("seq")).alias("seq"), F.lit("reverse").alias("dir"))
    q = q.union(turned) if direction == "both" else turned if direction == "reverse" else q
    at = lambda df: F.posexplode(S.naive_kmers("seq", size)).alias("pos", "kmer")
    left = q.select("q_id", "dir", at(q)).withColumnRenamed("pos", "q_pos")
    s = targets.select(F.col("id").alias("s_id"), F.upper("seq").alias("seq"))
    right = s.select("s_id", at(s)).withColumnRenamed("pos", "s_pos")
    seeds = left.join(right, "kmer").select("q_id", "s_id", "dir", (F.col("s_pos") - F.col("q_pos")).alias("diagonal"), "q_pos")
    w = Window.partitionBy("q_id", "s_id", "dir", "diagonal").orderBy("q_pos")
    islands = seeds.withColumn("island", F.col("q_pos") - F.row_number().over(w))
    runs = islands.groupBy("q_id", "s_id", "dir", "diagonal", "island").agg(F.min("q_pos").alias("q_beg"), F.count("*").alias("n"))
    return runs.select("q_id", "s_id", "dir", "q_beg", (F.col("q_beg") + F.col("diagonal")).alias("s_beg"), (F.col("n") + size - 1).alias("hit_len")).where(F.col("hit_len") >= least)

"""Operators that aggregate records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import options as O
from ..functions import sequence as S
from ..pipeline import command
from ..schema import has, mixed, order_columns


def _check_keys(o: dict) -> None:
    O.required(o, "keys")
    O.list_unique(o, "keys")


@command(check=_check_keys, keys=None)
def count_values(df: DataFrame, keys) -> DataFrame:
    """How often a record's value of each key occurs, as KEY_COUNT; null without the key.

    Values are counted with map-side combining and joined back. Spark broadcasts the counts of keys with few values, and
    splits the join where a value is hot.
    """
    out = df
    for key in O.listed(keys):
        if key in df.columns:
            counts = df.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("__key")).agg(F.count("*").alias(f"{key}_COUNT"))
            out = out.drop(f"{key}_COUNT").join(counts, F.col(f"`{key}`") == F.col("__key"), "left").drop("__key")
    return out


@command(ignore_case=False, order_by=None)
def dereplicate_seq(df: DataFrame, ignore_case: bool = False, order_by=None) -> DataFrame:
    """The first record of each sequence with SEQ_COUNT; other records pass unchanged."""
    if "SEQ" not in df.columns:
        return df
    order = [F.col(f"`{c}`") for c in order_columns(df, order_by)]
    key = F.lower("SEQ") if ignore_case else F.col("SEQ")
    rest = [c for c in df.columns if c != "SEQ_COUNT"]
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*order)).alias("r")
    unique = df.where("SEQ IS NOT NULL").groupBy(key.alias("__key")).agg(first, F.count("*").alias("SEQ_COUNT")).select("r.*", "SEQ_COUNT")
    return mixed(df.where("SEQ IS NULL"), unique)


@command(samples=None)
def collect_otus(df: DataFrame, samples=None) -> DataFrame:
    """Appends a record for each OTU with the number of its hits in each sample; 0 where there are none.

    The samples are read in one small job unless they are given, as they become columns.
    """
    if not has(df, "TYPE", "S_ID", "SAMPLE"):
        return df
    hits = df.where("TYPE = 'H' AND S_ID IS NOT NULL AND SAMPLE IS NOT NULL").withColumn("__s", F.upper("SAMPLE"))
    names = [s.upper() for s in samples] if samples else sorted(r[0] for r in hits.select("__s").distinct().collect())
    number = F.coalesce(F.col("SEQ_COUNT"), F.lit(1)) if "SEQ_COUNT" in df.columns else F.lit(1)
    sums = [F.sum(F.when(F.col("__s") == s, number).otherwise(0)).cast("long").alias(f"{s}_COUNT") for s in names]
    if not sums:
        return df
    otus = hits.groupBy(F.col("S_ID").alias("OTU")).agg(*sums)
    return mixed(df, otus.select(F.lit("OTU").alias("RECORD_TYPE"), "*"))


@command(order_by=None)
def collapse_otus(df: DataFrame, order_by=None) -> DataFrame:
    """One record for each taxonomy, regardless of confidences: counts are summed, the rest is the first record's."""
    if not has(df, "TAXONOMY"):
        return df
    order = F.struct(*[F.col(f"`{c}`") for c in order_columns(df, order_by)])
    counts = [c for c in df.columns if c.endswith("_COUNT")]
    rest = [c for c in df.columns if c not in counts]
    key = F.regexp_replace("TAXONOMY", r"\(\d+\)", "")
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), order).alias("r")
    grouped = df.where("TAXONOMY IS NOT NULL").groupBy(key.alias("__key")).agg(first, *[F.sum(f"`{c}`").alias(c) for c in counts])
    return mixed(df.where("TAXONOMY IS NULL"), grouped.select("r.*", *[f"`{c}`" for c in counts]))


def residue_counts(df: DataFrame, most: int | None = None, block: int = 1 << 22) -> DataFrame:
    """(pos, residue, n): upper-case residues at each place from 0; the long form, for alignments of any width.

    Residues are counted by blocks of ``block`` of them within each batch, and only the counts are shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t]
            held, size = [], 0
            for t in texts:
                held.append(t)
                size += len(t)
                if size >= block:
                    yield _counted(held)
                    held, size = [], 0
            if held:
                yield _counted(held)

    seq = F.upper("SEQ") if most is None else F.substring(F.upper("SEQ"), 1, most)
    counted = df.where("SEQ IS NOT NULL").select(seq.alias("s")).mapInArrow(count, "pos int, residue string, n long")
    return counted.groupBy("pos", "residue").agg(F.sum("n").alias("n"))


def _counted(texts: list[str]) -> pa.RecordBatch:
    """The residues of some sequences, counted by place."""
    size = np.array([len(t) for t in texts])
    raw = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    pos = np.arange(len(raw)) - np.repeat(np.cumsum(size) - size, size)
    letters, code = np.unique(raw, return_inverse=True)
    key = pos * len(letters) + code.ravel()
    if int(size.max()) * len(letters) <= 4 * len(raw):
        n = np.bincount(key)
        key = np.flatnonzero(n)
        n = n[key]
    else:
        key, n = np.unique(key, return_counts=True)
    residue = [chr(letters[c]) for c in range(len(letters))]
    columns = pa.array(key // len(letters), pa.int32()), pa.array([residue[c] for c in key % len(letters)], pa.string()), pa.array(n, pa.int64())
    return pa.RecordBatch.from_arrays(list(columns), names=["pos", "residue", "n"])


@command(percent=False)
def analyze_residue_distribution(df: DataFrame, percent: bool = False) -> DataFrame:
    """Appends a record for each residue: V0 the residue, V1 and on how often it occurs at each place, or its whole percentage.

    There is a column for each place; :func:`residue_counts` has the same as rows.
    """
    if "SEQ" not in df.columns:
        return df
    width = df.agg(F.max(F.length("SEQ"))).first()[0] or 0
    counts = residue_counts(df)
    value = F.col("n")
    if percent:
        total = counts.groupBy("pos").agg(F.sum("n").alias("total"))
        counts = counts.join(total, "pos")
        value = F.floor(100 * F.col("n") / F.col("total"))
    if not width:
        return df
    places = F.map_from_entries(F.collect_list(F.struct("pos", value.cast("long").alias("value"))))  # no more than the width
    rows = counts.groupBy(F.col("residue").alias("V0")).agg(places.alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda p: F.coalesce(F.try_element_at("m", p), F.lit(0)))
    rows = rows.select("V0", dense.alias("d"))
    return mixed(df, rows.select(F.lit("residue distribution").alias("RECORD_TYPE"), "V0", *[F.col("d")[p].alias(f"V{p + 1}") for p in range(width)]))


def n50(df: DataFrame, length: str = "SEQ_LEN") -> DataFrame:
    """(contig_n50, contig_min, contig_max): the first length, from the greatest, up to which half of all residues lie.

    Lengths are counted first, so that the running sum is over distinct lengths.
    """
    lengths = df.where(F.col(length).isNotNull()).groupBy(F.col(length).cast("long").alias("len")).agg(F.count("*").alias("n"))
    all_of = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    longer = Window.orderBy(F.desc("len")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = lengths.withColumn("so_far", F.sum(F.col("len") * F.col("n")).over(longer)).withColumn("total", F.sum(F.col("len") * F.col("n")).over(all_of))
    return sums.agg(F.max(F.when(2 * F.col("so_far") >= F.col("total"), F.col("len"))).alias("contig_n50"), F.min("len").alias("contig_min"), F.max("len").alias("contig_max"))

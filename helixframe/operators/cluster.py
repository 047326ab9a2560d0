"""Greedy clustering of sequences around centroids."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import options as O
from ..functions import search
from ..functions import sequence as S
from ..pipeline import command
from ..schema import DataError, checkpointed, has, mixed, order_columns
from .join import similar


def greedy_centroids(seqs: DataFrame, identity: float, strand: str = "plus", kmer_size: int = 8, rounds: int | None = None) -> DataFrame:
    """(id, centroid, ident, strand) of sequences (id, seq, rank): each belongs to the centroid it is most similar to.

    In the order of ``rank`` a sequence is a centroid unless it is similar to an earlier one. All sequences whose similar
    earlier ones are decided are decided in one round, which gives the same centroids as going through them one by one.
    Rounds go on until all are decided, each of them deciding the first that is left; more than ``rounds`` are an error.
    """
    q, s = seqs.select(F.col("id").alias("q_id"), F.col("seq").alias("q")), seqs.select(F.col("id").alias("s_id"), F.col("seq").alias("s"))
    ranks = seqs.select("id", "rank")
    pairs = similar(q, s, identity, kmer_size, strand).select("q_id", "s_id", "ident", "strand").where("q_id <> s_id")
    pairs = pairs.join(ranks.select(F.col("id").alias("q_id"), F.col("rank").alias("q_rank")), "q_id").join(ranks.select(F.col("id").alias("s_id"), F.col("rank").alias("s_rank")), "s_id")
    earlier = checkpointed(pairs.where("s_rank < q_rank").groupBy("q_id", "s_id").agg(F.max(F.struct("ident", "strand")).alias("best")))
    state = checkpointed(seqs.select("id", F.lit(0).alias("kind")))  # 0 undecided, 1 centroid, 2 member
    for done in itertools.count():
        if state.where("kind = 0").isEmpty():
            break
        if done == rounds:
            raise DataError(f"sequences are undecided after {rounds} rounds")
        around = earlier.join(state.select(F.col("id").alias("s_id"), "kind"), "s_id").groupBy("q_id").agg(F.max((F.col("kind") == 1).cast("int")).alias("near"), F.max((F.col("kind") == 0).cast("int")).alias("open"))
        seen = state.join(around, F.col("id") == F.col("q_id"), "left")
        kind = F.when(F.col("kind") > 0, F.col("kind")).when(F.coalesce("near", F.lit(0)) == 1, 2).when(F.coalesce("open", F.lit(0)) == 0, 1).otherwise(0)
        state = checkpointed(seen.select("id", kind.alias("kind")))
    centroids = state.where("kind = 1").select(F.col("id").alias("s_id"))
    chosen = earlier.join(centroids, "s_id").groupBy("q_id").agg(F.max_by("s_id", F.struct("best.ident", F.col("s_id"))).alias("centroid"), F.max("best").alias("best"))
    members = state.where("kind = 2").join(chosen, F.col("id") == F.col("q_id"))
    return members.select("id", "centroid", F.col("best.ident").alias("ident"), F.col("best.strand").alias("strand")).union(state.where("kind = 1").select("id", F.col("id"), F.lit(1.0), F.lit("+")))


def _check_uclust(o: dict) -> None:
    O.required(o, "identity")
    O.allowed_values(o, strand=("plus", "both"))
    O.check(o, "identity > 0.0", "identity <= 1.0", "cpus >= 1")


def _ranked(df: DataFrame, order: list) -> DataFrame:
    """Distinct sequences with an id and their place in an order; the first record of each stands for it."""
    first = df.where("SEQ IS NOT NULL").groupBy(F.upper("SEQ").alias("seq")).agg(F.min(F.struct(*order)).alias("rank"))
    return first.select(F.xxhash64("seq").alias("id"), "seq", "rank")


def _aligned(found: DataFrame, seqs: DataFrame) -> DataFrame:
    """(id, __aligned): each sequence laid over its centroid, with room for what any of the cluster has between its places."""
    centre = seqs.select(F.col("id").alias("centroid"), F.col("seq").alias("centre"))
    pairs = found.join(seqs.select("id", "seq"), "id").join(centre, "centroid")
    turned = F.when(F.col("strand") == "-", S.reverse_complement("seq")).otherwise(F.col("seq"))
    laid = checkpointed(pairs.select("id", "centroid", search.laid_over(turned, "centre").alias("l")).select("id", "centroid", "l.*"))
    room = laid.select("centroid", F.explode("runs").alias("at", "run")).groupBy("centroid", "at").agg(F.max(F.length("run")).alias("room"))
    rooms = room.groupBy("centroid").agg(F.map_from_entries(F.collect_list(F.struct("at", "room"))).alias("rooms"))  # no more than the centroid's places
    before = lambda p: F.rpad(F.coalesce(F.try_element_at("runs", p), F.lit("")), F.coalesce(F.try_element_at("rooms", p), F.lit(0)), F.lit("-"))
    whole = S.let(S.letters("columns"), lambda c: F.transform(F.sequence(F.lit(0), F.size(c)), lambda p: F.concat(before(p), F.coalesce(F.try_element_at(c, p + 1), F.lit("")))))
    return laid.join(rooms, "centroid", "left").select("id", F.array_join(whole, "").alias("__aligned"))


@command(check=_check_uclust, identity=None, strand="plus", align=False, cpus=1, kmer_size=8, order_by=None)
def uclust(df: DataFrame, identity: float, strand: str = "plus", align: bool = False, cpus: int = 1, kmer_size: int = 8, order_by=None) -> DataFrame:
    """Adds CLUSTER, TYPE (S for centroids, else H), IDENT and STRAND to sequences; a native greedy clustering.

    Clusters are numbered by the order of their centroids. With ``align`` SEQ becomes the sequence in upper case, on its
    centroid's strand and with gaps, as long as all of its cluster.
    """
    if not has(df, "SEQ"):
        return df
    order = [F.col(f"`{c}`") for c in order_columns(df, order_by)]
    seqs = checkpointed(_ranked(df, order))
    found = greedy_centroids(seqs, identity, strand, kmer_size)
    heads = found.where("id = centroid").join(seqs, "id").select(F.col("id").alias("centroid"), (F.row_number().over(Window.orderBy("rank")) - 1).cast("long").alias("CLUSTER"))
    rows = found.join(heads, "centroid").join(seqs.select("id", "seq"), "id")
    kind = F.when(F.col("id") == F.col("centroid"), "S").otherwise("H").alias("TYPE")
    extra = []
    if align:
        rows, extra = rows.join(_aligned(found, seqs), "id"), ["__aligned"]
    rows = rows.select(*extra, F.col("seq").alias("__seq"), "CLUSTER", kind, F.round(100 * F.col("ident"), 1).alias("IDENT"), F.col("strand").alias("STRAND"))
    out = df.drop("CLUSTER", "TYPE", "IDENT", "STRAND").withColumn("__s", F.upper("SEQ")).join(rows, F.col("__s") == F.col("__seq"), "left").drop("__s", "__seq")
    if align:
        out = out.withColumn("SEQ", F.coalesce("__aligned", "SEQ")).withColumn("SEQ_LEN", F.length("SEQ").cast("long")).drop("__aligned")
    return out


def _check_cluster(o: dict) -> None:
    O.check(o, "identity > 0.0", "identity <= 1.0")


@command(check=_check_cluster, identity=0.97, kmer_size=8)
def cluster_otus(df: DataFrame, identity: float = 0.97, kmer_size: int = 8) -> DataFrame:
    """The centroids of a greedy clustering by falling SEQ_COUNT, with their clusters' counts summed; other records pass."""
    if not has(df, "SEQ"):
        return df
    if "SEQ_COUNT" not in df.columns:
        raise DataError("SEQ_COUNT is needed; dereplicate first")
    seqs = df.where("SEQ IS NOT NULL").groupBy(F.upper("SEQ").alias("seq")).agg(F.sum("SEQ_COUNT").alias("n"))
    seqs = checkpointed(seqs.select(F.xxhash64("seq").alias("id"), "seq", F.struct((-F.col("n")).alias("less"), F.col("seq")).alias("rank"), "n"))
    found = greedy_centroids(seqs.select("id", "seq", "rank"), identity, "plus", kmer_size)
    sums = found.join(seqs.select("id", "n"), "id").groupBy("centroid").agg(F.sum("n").alias("__sum"))
    heads = sums.join(seqs.select(F.col("id").alias("centroid"), F.col("seq").alias("__seq")), "centroid").select("__seq", "__sum")
    rest = [c for c in df.columns if c != "SEQ_COUNT"]
    rows = df.where("SEQ IS NOT NULL").groupBy(F.upper("SEQ").alias("__key")).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("r"))
    out = rows.join(heads, F.col("__key") == F.col("__seq")).select("r.*", F.col("__sum").alias("SEQ_COUNT"))
    return mixed(df.where("SEQ IS NULL"), out)

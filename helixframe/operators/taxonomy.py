"""A taxonomy index of shared k-mers, and classification by it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import options as O
from ..functions import sequence as S
from ..pipeline import command
from ..schema import has

#: From the kingdom to the species; names are ``K#..;P#..;C#..;O#..;F#..;G#..;S#..``.
LEVELS = "KPCOFGS"


def build_index(df: DataFrame, kmer_size: int = 8, step_size: int = 1) -> tuple[DataFrame, DataFrame]:
    """Nodes (path, depth, level, name, parent, seq_id) and k-mers (depth, kmer, path) of named sequences.

    A node is known by the path of names that leads to it; the root has an empty one. A sequence's k-mers belong to its
    deepest named node and to all nodes above. Names must have all levels, and none after one that is empty.
    """
    taxon = F.regexp_extract("SEQ_NAME", r"((?:[A-Za-z]#[^;]*;){6}[A-Za-z]#[^;]*)$", 1)
    names = F.transform(F.split("taxon", ";"), lambda x: F.substring_index(x, "#", -1))
    rows = df.where("SEQ IS NOT NULL AND SEQ_NAME IS NOT NULL").select("SEQ_NAME", "SEQ", taxon.alias("taxon")).withColumn("names", names)
    depth = F.size(F.filter("names", lambda x: x != ""))
    gap = F.exists(F.slice(F.col("names"), F.lit(1), depth), lambda x: x == "") | (F.col("taxon") == "")
    depth = F.when(gap, F.raise_error(F.concat(F.lit("no taxonomy name, or one with a gap: "), F.col("SEQ_NAME"))).cast("int")).otherwise(depth)
    named = rows.withColumn("depth", depth).withColumn("at", F.explode(F.expr("sequence(0, depth)")))
    path = lambda n: F.when(n > 0, F.array_join(F.slice("names", F.lit(1), n), ";")).otherwise("")
    level = F.when(F.col("at") == 0, "R").otherwise(F.substring(F.lit(LEVELS), F.col("at"), F.lit(1)))
    steps = named.select("SEQ", "SEQ_NAME", F.col("at").alias("depth"), path(F.col("at")).alias("path"), path(F.col("at") - 1).alias("parent"), level.alias("level"), F.when(F.col("at") > 0, F.try_element_at("names", F.col("at"))).otherwise("root").alias("name"))
    nodes = steps.groupBy("path", "depth", "level", "name", "parent").agg(F.min("SEQ_NAME").alias("seq_id"))
    kmers = steps.select("depth", F.explode(S.kmers("SEQ", kmer_size, step_size)).alias("kmer"), "path").distinct()
    return nodes, kmers


def _check_index(o: dict) -> None:
    O.required(o, "output_dir")
    O.check(o, "kmer_size > 0", "kmer_size <= 12", "step_size > 0", "step_size <= 12")
    O.not_yet_there({"output_dir": f"{o['output_dir']}/{o['prefix']}_nodes", "force": o["force"]}, "output_dir")


@command(check=_check_index, output_dir=None, kmer_size=8, step_size=1, prefix="taxonomy", force=False)
def index_taxonomy(df: DataFrame, output_dir: str, kmer_size: int = 8, step_size: int = 1, prefix: str = "taxonomy", force: bool = False) -> DataFrame:
    """Writes the index as two Parquet tables and passes the records on."""
    if has(df, "SEQ", "SEQ_NAME"):
        nodes, kmers = build_index(df, kmer_size, step_size)
        mode = "overwrite" if force else "errorifexists"
        nodes.write.mode(mode).parquet(f"{output_dir}/{prefix}_nodes")
        kmers.write.mode(mode).parquet(f"{output_dir}/{prefix}_kmers")
    return df


def classify(queries: DataFrame, kmers: DataFrame, kmer_size: int = 8, step_size: int = 1, hits_max: int = 50, consensus: float = 0.51, coverage: float = 0.9, best_only: bool = True) -> DataFrame:
    """(seq, TAXONOMY, TAXONOMY_HITS) of the distinct ``seq`` values of ``queries`` by an index's ``kmers``.

    The deepest level counts at which some nodes share at least ``coverage`` of the k-mers; of these the best (and those
    equal to it), or the best ``hits_max``. For each level, the words of the hits' names that enough hits have in one place
    make its name.
    """
    seqs = queries.select("seq").distinct().withColumn("kmers", S.kmers("seq", kmer_size, step_size))
    asked = seqs.select("seq", F.size("kmers").alias("n"), F.explode("kmers").alias("kmer"))
    shared = asked.join(kmers, "kmer").groupBy("seq", "n", "depth", "path").agg(F.count("*").alias("common"))
    enough = shared.where(F.col("common") >= F.col("n") * coverage)
    deepest = enough.groupBy("seq").agg(F.max(F.struct("depth", "common")).alias("top"))
    hits = enough.join(deepest, "seq").where(F.col("depth") == F.col("top.depth"))
    if best_only:
        hits = hits.where(F.col("common") == F.col("top.common"))
    order = Window.partitionBy("seq").orderBy(F.desc("common"), "path")
    hits = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= hits_max)
    sizes = hits.groupBy("seq").agg(F.count("*").alias("hits"))
    levels = hits.where("path <> ''").select("seq", F.posexplode(F.split("path", ";")).alias("level", "name"))
    words = levels.select("seq", "level", F.posexplode(F.split("name", "_")).alias("pos", "word")).groupBy("seq", "level", "pos", "word").agg(F.count("*").alias("c"))
    agreed = words.join(sizes, "seq").where(F.col("c") >= F.col("hits") * consensus)
    agreed = agreed.select("seq", "level", F.struct("pos", (-F.col("c")).alias("less"), "word", F.floor(100 * F.col("c") / F.col("hits")).alias("percent")).alias("w"))
    named = agreed.groupBy("seq", "level").agg(F.array_sort(F.collect_list("w")).alias("w"))
    label = F.concat(F.substring(F.lit(LEVELS), F.col("level") + 1, F.lit(1)), F.lit("#"), F.array_join(F.col("w.word"), " "), F.lit("("), F.array_join(F.transform("w.percent", lambda p: p.cast("string")), "/"), F.lit(")"))
    listed = named.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("level", label.alias("label")))).alias("l"))
    unbroken = F.filter("l", lambda x, i: x["level"] == i)
    texts = listed.select("seq", F.array_join(F.transform(unbroken, lambda x: x["label"]), ";").alias("text"))
    found = seqs.select("seq").join(sizes, "seq", "left").join(texts, "seq", "left")
    return found.select("seq", F.coalesce(F.nullif("text", F.lit("")), F.lit("Unclassified")).alias("TAXONOMY"), F.coalesce("hits", F.lit(0)).cast("long").alias("TAXONOMY_HITS"))


def _check_classify(o: dict) -> None:
    O.required(o, "dir")
    O.dirs_exist(o, "dir")
    O.check(o, "kmer_size > 0", "kmer_size <= 12", "step_size > 0", "step_size <= 12", "hits_max > 0", "consensus >= 0", "consensus <= 1", "coverage >= 0", "coverage <= 1")


@command(check=_check_classify, dir=None, prefix="taxonomy", kmer_size=8, step_size=1, hits_max=50, consensus=0.51, coverage=0.9, best_only=True)
def classify_seq(df: DataFrame, dir: str, prefix: str = "taxonomy", kmer_size: int = 8, step_size: int = 1, hits_max: int = 50, consensus: float = 0.51, coverage: float = 0.9, best_only: bool = True) -> DataFrame:
    """TAXONOMY and TAXONOMY_HITS of each sequence by an index."""
    if "SEQ" not in df.columns:
        return df
    kmers = df.sparkSession.read.parquet(f"{dir}/{prefix}_kmers")
    found = classify(df.where("SEQ IS NOT NULL").select(F.col("SEQ").alias("seq")), kmers, kmer_size, step_size, hits_max, consensus, coverage, best_only)
    return df.join(found.withColumnRenamed("seq", "__seq"), F.col("SEQ") == F.col("__seq"), "left").drop("__seq")


def wang_classifier(queries: DataFrame, references: DataFrame, kmer_size: int = 8, bootstraps: int = 100, seed: int = 1) -> DataFrame:
    """(seq, taxon, confidence): naive Bayes over k-mers (Wang et al. 2007).

    A k-mer's probability in a taxon is (its sequences + prior) / (sequences + 1), the prior being (sequences with it +
    0.5) / (all + 1). Confidence is the share of bootstraps, each of an eighth of the k-mers drawn by a hash, that give
    the same taxon. ``references`` has taxon and seq.
    """
    refs = references.select("taxon", F.monotonically_increasing_id().alias("id"), F.explode(S.kmers("seq", kmer_size)).alias("kmer"))
    total = references.count()
    sizes = references.groupBy("taxon").agg(F.count("*").alias("m"))
    prior = refs.groupBy("kmer").agg(((F.countDistinct("id") + 0.5) / F.lit(total + 1)).alias("prior"))
    present = refs.groupBy("taxon", "kmer").agg(F.count("*").alias("c")).join(sizes, "taxon").join(prior, "kmer")
    # log of the probability with the k-mer, less that without it, so that only shared k-mers are joined
    gain = F.log((F.col("c") + F.col("prior")) / (F.col("m") + 1)) - F.log(F.col("prior") / (F.col("m") + 1))
    gains = present.select("kmer", "taxon", gain.alias("gain"))
    asked = queries.select("seq").distinct().select("seq", F.explode(S.kmers("seq", kmer_size)).alias("kmer"))
    drawn = asked.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(bootstraps))))
    drawn = drawn.where((F.col("b") == 0) | (F.pmod(F.xxhash64("kmer", "b", F.lit(seed)), F.lit(8)) == 0))
    base = drawn.join(prior, "kmer").groupBy("seq", "b").agg(F.count("*").alias("k"))
    shared = drawn.join(gains, "kmer").groupBy("seq", "b", "taxon").agg(F.sum("gain").alias("gain"))
    scored = shared.join(base, ["seq", "b"]).join(sizes, "taxon").withColumn("score", F.col("gain") - F.col("k") * F.log(F.col("m") + 1))
    best = scored.groupBy("seq", "b").agg(F.max_by("taxon", F.struct("score", "taxon")).alias("taxon"))
    whole = best.where("b = 0").select("seq", "taxon")
    votes = best.where("b > 0").groupBy("seq", "taxon").agg(F.count("*").alias("v"))
    return whole.join(votes, ["seq", "taxon"], "left").select("seq", "taxon", F.floor(100 * F.coalesce("v", F.lit(0)) / bootstraps).alias("confidence"))

"""Work that other programs are usually called for: run the program where it is installed, or a native method.

``tool="native"`` (the default) needs no program. Any other value names a program; it must be installed on every
executor, and a missing one is an error when the operator is written down.
"""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import options as O
from ..functions import search, sequence as S
from ..pipeline import command
from ..schema import checkpointed, has, mixed, sequence_records
from . import taxonomy as taxonomy_module
from .aggregate import n50


def find_tool(name: str) -> str:
    """The path of a program; an error without it."""
    path = shutil.which(name)
    if path is None:
        raise O.OptionError(f"the program {name} isn't installed")
    return path


def through_tool(df: DataFrame, argv: list[str], schema: str, parse) -> DataFrame:
    """Runs a program on the sequences of each partition as FASTA. ``{in}``, ``{out}`` and ``{dir}`` in ``argv`` are paths.

    ``parse`` gets the folder and the path of the output and returns a pandas DataFrame of ``schema``. Files are temporary
    and local to the task.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with tempfile.TemporaryDirectory() as folder:
            source, target = os.path.join(folder, "in.fasta"), os.path.join(folder, "out")
            with open(source, "w", encoding="utf-8") as f:
                for batch in batches:
                    f.writelines(f">{n}\n{s}\n" for n, s in zip(batch["SEQ_NAME"], batch["SEQ"], strict=True))
            if os.path.getsize(source):
                subprocess.run([a.format(**{"in": source, "out": target, "dir": folder}) for a in argv], check=True, capture_output=True)
                yield parse(folder, target)

    return df.where("SEQ IS NOT NULL AND SEQ_NAME IS NOT NULL").select("SEQ_NAME", "SEQ").mapInPandas(work, schema)


def _check_tool(*needed: str):
    def check(o: dict) -> None:
        O.required(o, *needed)
        O.files_exist(o, *[n for n in needed if not isinstance(o[n], DataFrame)])
        O.check(o, "cpus >= 1", "confidence >= 0", "confidence <= 100", "kmer_min > 0", "kmer_max > 0", "contig_min > 0")
        if o.get("tool", "native") != "native":
            find_tool(o["tool"])

    return check


def _fasta_frame(folder: str, target: str) -> pd.DataFrame:
    from ..sources.fasta import parse_fasta

    path = target if os.path.exists(target) else os.path.join(folder, "contigs.fasta")
    with open(path, encoding="utf-8") as f:
        return pd.DataFrame(list(parse_fasta(f.read())), columns=["SEQ_NAME", "SEQ"])


# --- gene calling


@command(check=_check_tool(), type="dna", procedure="single", closed_ends=False, masked=False, size_min=90, tool="native")
def genecall(df: DataFrame, type: str = "dna", procedure: str = "single", closed_ends: bool = False, masked: bool = False, size_min: int = 90, tool: str = "native") -> DataFrame:
    """Appends gene records with S_BEG, S_END, S_LEN and STRAND.

    Natively the genes are the longest open reading frames of each stop on both strands, of at least ``size_min`` residues:
    from the first start codon to the next stop codon in its frame, whatever stops there are in other frames.
    """
    if not has(df, "SEQ", "SEQ_NAME"):
        return df
    if tool != "native":
        argv = [tool, "-i", "{in}", "-o", "{out}.coords", "-a" if type == "protein" else "-d", "{out}", "-p", procedure, *["-c"] * closed_ends, *["-m"] * masked]
        rows = through_tool(df, argv, "SEQ_NAME string, SEQ string", _fasta_frame)
        head = F.split("SEQ_NAME", " # ")
        found = rows.select(head[0].alias("SEQ_NAME"), "SEQ", head[1].cast("long").alias("S_BEG"), head[2].cast("long").alias("S_END"), F.when(head[3] == "1", "+").otherwise("-").alias("STRAND"))
    else:
        seqs = df.where("SEQ IS NOT NULL AND SEQ_NAME IS NOT NULL").select("SEQ_NAME", "SEQ", F.length("SEQ").alias("n"))
        strands = seqs.select("SEQ_NAME", "n", F.explode(F.array(F.struct(F.lit("+").alias("strand"), F.col("SEQ").alias("s")), F.struct(F.lit("-").alias("strand"), S.reverse_complement("SEQ").alias("s")))).alias("x"))
        genes = strands.select("SEQ_NAME", "n", "x.strand", F.explode(search.genes(F.col("x.s"), size_min)).alias("g"))
        plus = F.col("strand") == "+"
        found = genes.select("SEQ_NAME", F.col("g.seq").alias("SEQ"), F.when(plus, F.col("g.start") + 1).otherwise(F.col("n") - F.col("g.stop")).cast("long").alias("S_BEG"), F.when(plus, F.col("g.stop") + 1).otherwise(F.col("n") - F.col("g.start")).cast("long").alias("S_END"), F.col("strand").alias("STRAND"))
        if type == "protein":
            found = found.withColumn("SEQ", S.translate("SEQ"))
    columns = found.withColumn("SEQ_LEN", F.length("SEQ").cast("long")).withColumn("S_LEN", F.col("S_END") - F.col("S_BEG") + 1)
    return mixed(df, columns.select(F.lit("genecall").alias("RECORD_TYPE"), F.lit(type).alias("SEQ_TYPE"), "*"))


# --- alignment and classification against a template


def align_pair(query: str, template: str) -> str:
    """A query laid over a template: its gapped form, as long as the template.

    Global alignment to the template without its gaps (match 1, mismatch -1, gap -2); residues between two columns of the
    template are left out, so that all sequences aligned to it are equally long.
    """
    places = [i for i, c in enumerate(template) if c not in ".-_~"]
    out = ["-" if c not in ".-_~" else c for c in template]
    for i, j, paired in search.alignment_path(query, "".join(template[p] for p in places)):
        if paired:
            out[places[j]] = query[i]
    return "".join(out)


@command(check=_check_tool("template_file"), template_file=None, cpus=1, kmer_size=8, tool="native")
def align_seq_mothur(df: DataFrame, template_file=None, cpus: int = 1, kmer_size: int = 8, tool: str = "native") -> DataFrame:
    """Sequences aligned to the template that shares most k-mers with them."""
    if not has(df, "SEQ", "SEQ_NAME"):
        return df
    if tool != "native":
        argv = [tool, "#align.seqs(candidate={in}, template=" + str(template_file) + ")"]
        parse = lambda folder, target: _fasta_frame(folder, os.path.join(folder, "in.align"))
        found = through_tool(df, argv, "SEQ_NAME string, SEQ string", parse)
        return mixed(df.where("SEQ IS NULL OR SEQ_NAME IS NULL"), found.withColumn("SEQ_LEN", F.length("SEQ").cast("long")))
    templates = sequence_records(df, template_file).select(F.col("SEQ_NAME").alias("t_name"), F.col("SEQ").alias("t"))
    keys = templates.select("t_name", F.explode(S.kmers(S.indels_remove("t"), kmer_size)).alias("kmer"))
    seqs = df.where("SEQ IS NOT NULL").select(F.col("SEQ").alias("q")).distinct()
    shared = seqs.select("q", F.explode(S.kmers("q", kmer_size)).alias("kmer")).join(keys, "kmer").groupBy("q", "t_name").agg(F.count("*").alias("n"))
    best = shared.groupBy("q").agg(F.max_by("t_name", F.struct("n", "t_name")).alias("t_name")).join(templates, "t_name")

    @F.pandas_udf("string")
    def lay(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([align_pair(a, b) for a, b in zip(q, t, strict=True)], dtype=object)

    aligned = best.select("q", lay("q", "t").alias("aligned"))
    joined = df.join(aligned, F.col("SEQ") == F.col("q"), "left").withColumn("SEQ", F.coalesce("aligned", "SEQ")).drop("q", "aligned")
    return joined.withColumn("SEQ_LEN", F.length("SEQ").cast("long"))


@command(check=_check_tool("database", "taxonomy"), database=None, taxonomy=None, confidence=80, cpus=1, kmer_size=8, bootstraps=100, tool="native")
def classify_seq_mothur(df: DataFrame, database=None, taxonomy=None, confidence: int = 80, cpus: int = 1, kmer_size: int = 8, bootstraps: int = 100, tool: str = "native") -> DataFrame:
    """TAXONOMY of each sequence by naive Bayes over k-mers, to the levels of enough confidence.

    ``taxonomy`` is a file of ``name <tab> level;level;...`` for the sequences of ``database``, or a DataFrame of SEQ_NAME and
    taxon; ``database`` may be a DataFrame too.
    """
    from .project import filter_taxonomy

    if not has(df, "SEQ", "SEQ_NAME"):
        return df
    if tool != "native":
        argv = [tool, f"#classify.seqs(fasta={{in}}, reference={database}, taxonomy={taxonomy}, method=wang)"]

        def parse(folder: str, target: str) -> pd.DataFrame:
            (path,) = [f for f in os.listdir(folder) if f.endswith(".wang.taxonomy")]
            return pd.read_csv(os.path.join(folder, path), sep="\t", names=["SEQ_NAME", "TAXONOMY"])

        found = through_tool(df, argv, "SEQ_NAME string, TAXONOMY string", parse).withColumnRenamed("SEQ_NAME", "__n")
        return filter_taxonomy(df.drop("TAXONOMY").join(found, F.col("SEQ_NAME") == F.col("__n"), "left").drop("__n"), confidence=confidence)
    if isinstance(taxonomy, DataFrame):
        names = taxonomy.select("SEQ_NAME", "taxon")
    else:
        names = df.sparkSession.read.text(taxonomy).select(F.substring_index("value", "\t", 1).alias("SEQ_NAME"), F.regexp_replace(F.substring_index("value", "\t", -1), ";$", "").alias("taxon"))
    refs = sequence_records(df, database).select("SEQ_NAME", "SEQ").join(names, "SEQ_NAME").select("taxon", F.col("SEQ").alias("seq"))
    asked = df.where("SEQ IS NOT NULL").select(F.col("SEQ").alias("seq"))
    found = taxonomy_module.wang_classifier(asked, refs, kmer_size, bootstraps)
    labelled = found.select(F.col("seq").alias("__s"), F.array_join(F.transform(F.split("taxon", ";"), lambda x: F.concat(x, F.lit("("), F.col("confidence").cast("string"), F.lit(")"))), ";").alias("TAXONOMY"))
    return filter_taxonomy(df.drop("TAXONOMY").join(labelled, F.col("SEQ") == F.col("__s"), "left").drop("__s"), confidence=confidence)


# --- assembly


def unitigs(df: DataFrame, k: int, least_depth: int = 1) -> DataFrame:
    """Maximal unbranched paths (SEQ) of the de Bruijn graph of all k-mers of ``df.SEQ`` and their other strands.

    A k-mer is joined to the next where each is the other's only neighbour. Paths are ranked by pointer doubling, in a
    number of rounds that grows with the logarithm of the longest path; rings are cut at their least k-mer. Of a path and
    its other strand the lesser is kept.
    """
    seqs = df.where("SEQ IS NOT NULL").select(F.upper("SEQ").alias("s"))
    both = seqs.union(seqs.select(S.reverse_complement("s")))
    kmers = both.select(F.explode(S.naive_kmers("s", k)).alias("kmer")).where(F.col("kmer").rlike("^[ACGT]+$")).groupBy("kmer").agg(F.count("*").alias("n")).where(F.col("n") >= least_depth)
    kmers = checkpointed(kmers.select("kmer", F.substring(F.col("kmer"), F.lit(2), F.lit(k - 1)).alias("suffix"), F.substring("kmer", 1, k - 1).alias("prefix")))
    outs, ins = kmers.groupBy("suffix").agg(F.count("*").alias("outs")), kmers.groupBy("prefix").agg(F.count("*").alias("ins"))
    edges = kmers.select(F.col("kmer").alias("a"), "suffix").join(outs.where("outs = 1"), "suffix").join(kmers.select(F.col("kmer").alias("b"), F.col("prefix").alias("suffix")), "suffix")
    edges = edges.join(ins.where("ins = 1").select(F.col("prefix").alias("suffix")), "suffix", "left_semi").where("a <> b").select("a", "b")
    ranked, rings = _path_ranks(kmers, edges)
    if not rings.isEmpty():
        ranked, _ = _path_ranks(kmers, edges.join(rings, "b", "left_anti"))
    paths = ranked.groupBy("up").agg(F.array_sort(F.collect_list(F.struct("dist", "kmer"))).alias("p"))
    seq = F.concat(F.col("p")[0]["kmer"], F.array_join(F.transform(F.slice("p", 2, 1 << 30), lambda x: F.substring(x["kmer"], F.lit(k), F.lit(1))), ""))
    return paths.select(seq.alias("s")).select(F.least("s", S.reverse_complement("s")).alias("SEQ")).distinct()


def _path_ranks(kmers: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kmer, up, dist): the beginning of each k-mer's path and how far it is; and (b): the least k-mer of each ring.

    Every k-mer points to its predecessor, and in each round to where that one points. Of a path, fewer k-mers move in each
    round until none does; so once as many move as in the round before, they all lie on rings, none of which is longer than
    that number.
    """
    pointed = kmers.join(edges.select(F.col("b").alias("kmer"), F.col("a").alias("up")), "kmer", "left")
    state = checkpointed(pointed.select("kmer", F.coalesce("up", "kmer").alias("up"), F.col("up").isNotNull().cast("long").alias("dist"), F.least("kmer", F.coalesce("up", "kmer")).alias("low")))
    moved, seen = -1, 1  # k-mers that moved in the last round; how far back the least k-mer is known
    while True:
        further = state.select(F.col("kmer").alias("up"), F.col("up").alias("up2"), F.col("dist").alias("more"), F.col("low").alias("low2"))
        step = checkpointed(state.join(further, "up").select("kmer", F.col("up2").alias("up"), (F.col("dist") + F.col("more")).alias("dist"), F.least("low", "low2").alias("low"), "more"))
        state, seen = step.drop("more"), 2 * seen
        moving = step.where("more > 0").count()
        if not moving or (moving == moved and seen >= moving):
            break
        moved = moving
    return state.select("kmer", "up", "dist"), step.where("more > 0").select(F.col("low").alias("b")).distinct()


def _contigs(df: DataFrame, k: int, contig_min: int) -> DataFrame:
    rows = unitigs(df, k).where(F.length("SEQ") >= contig_min)
    return rows.select(F.concat(F.lit("contig_"), F.substring(F.md5("SEQ"), 1, 12)).alias("SEQ_NAME"), "SEQ", F.length("SEQ").cast("long").alias("SEQ_LEN"))


def _assembled(df: DataFrame, kmers: list[int], contig_min: int) -> DataFrame:
    """The contigs of the k with the greatest N50."""
    if not has(df, "SEQ"):
        return df
    best = None
    for k in kmers:
        contigs = _contigs(df, k, contig_min).persist()
        size = n50(contigs).first()[0] or 0
        if best is None or size > best[0]:
            if best:
                best[1].unpersist()
            best = (size, contigs)
        else:
            contigs.unpersist()
    return mixed(df.where("SEQ IS NULL"), best[1]) if best else df


def _assembler(df: DataFrame, argv: list[str]) -> DataFrame:
    """A program that needs all reads on one machine."""
    found = through_tool(df.where("SEQ IS NOT NULL").coalesce(1), argv, "SEQ_NAME string, SEQ string", _fasta_frame)
    return mixed(df.where("SEQ IS NULL"), found.withColumn("SEQ_LEN", F.length("SEQ").cast("long")))


@command(check=_check_tool(), kmer_min=24, kmer_max=48, contig_min=1, cpus=1, tool="native")
def assemble_seq_idba(df: DataFrame, kmer_min: int = 24, kmer_max: int = 48, contig_min: int = 1, cpus: int = 1, tool: str = "native") -> DataFrame:
    """Contigs instead of reads. Natively the unbranched paths of the best of three lengths of k-mers."""
    if tool != "native":
        return _assembler(df, [tool, "--read", "{in}", "--mink", str(kmer_min), "--maxk", str(kmer_max), "--num_threads", str(cpus), "-o", "{dir}"])
    return _assembled(df, sorted({kmer_min, (kmer_min + kmer_max) // 2, kmer_max}), contig_min)


@command(check=_check_tool(), kmer_min=21, kmer_max=49, contig_min=500, cpus=1, tool="native")
def assemble_seq_ray(df: DataFrame, kmer_min: int = 21, kmer_max: int = 49, contig_min: int = 500, cpus: int = 1, tool: str = "native") -> DataFrame:
    """Contigs instead of reads, of the odd k with the greatest N50."""
    if tool != "native":
        return _assembler(df, [tool, "-n", str(cpus), "Ray", "-k", str(kmer_min), "-s", "{in}", "-o", "{out}"])
    return _assembled(df, [k for k in range(kmer_min, kmer_max + 1) if k % 2], contig_min)


@command(check=_check_tool(), careful=False, kmers="21,33,55", contig_min=1, cpus=1, tool="native")
def assemble_seq_spades(df: DataFrame, careful: bool = False, kmers="21,33,55", contig_min: int = 1, cpus: int = 1, tool: str = "native") -> DataFrame:
    """Contigs instead of reads, of the best of some lengths of k-mers."""
    if tool != "native":
        return _assembler(df, [tool, "-s", "{in}", "-o", "{dir}", "-t", str(cpus), "-k", str(kmers), *["--careful"] * careful])
    return _assembled(df, [int(k) for k in O.listed(kmers)], contig_min)

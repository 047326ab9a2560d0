"""Operators that change records one by one. Records that lack what an operator works on pass unchanged."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import options as O
from ..functions import search, sequence as S
from ..pipeline import command
from ..schema import GAPS, DataError, has, present, with_ordinal


def _set(df: DataFrame, when: Column, **columns: Column) -> DataFrame:
    """Columns set where a condition holds; elsewhere they stay, or are null if new."""
    return df.withColumns({n: F.when(when, c).otherwise(F.col(n)) if n in df.columns else F.when(when, c) for n, c in columns.items()})


def _check_add_key(o: dict) -> None:
    O.required(o, "key")
    O.one_of({k: True for k in ("value", "prefix") if o.get(k) is not None}, "value", "prefix")


@command(check=_check_add_key, key=None, value=None, prefix=None, order_by=None)
def add_key(df: DataFrame, key: str, value=None, prefix: str | None = None, order_by=None) -> DataFrame:
    """A constant, or ``prefix`` and the record's number in order from 0."""
    if prefix is None:
        return df.withColumn(key, F.lit(value))
    return with_ordinal(df, "__n", order_by).withColumn(key, F.concat(F.lit(prefix), F.col("__n").cast("string"))).drop("__n")


def _check_merge_values(o: dict) -> None:
    O.required(o, "keys")
    O.list_unique(o, "keys")


@command(check=_check_merge_values, keys=None, delimiter="_")
def merge_values(df: DataFrame, keys, delimiter: str = "_") -> DataFrame:
    """The values of all keys, joined, as the first key's; only where all are there."""
    keys = O.listed(keys)
    if not has(df, *keys):
        return df
    return df.withColumn(keys[0], F.when(present(*keys), F.concat_ws(delimiter, *[F.col(f"`{k}`").cast("string") for k in keys])).otherwise(F.col(f"`{keys[0]}`").cast("string")))


def _check_split_values(o: dict) -> None:
    O.required(o, "key")
    O.list_unique(o, "keys")


@command(check=_check_split_values, key=None, keys=None, delimiter="_", order_by=None)
def split_values(df: DataFrame, key: str, keys=None, delimiter: str = "_", order_by=None) -> DataFrame:
    """Parts of a value as KEY_0, KEY_1 and so on, or as ``keys``; values without the delimiter stay whole.

    Empty parts at the end don't count. The first record that can be split sets the types of the parts (whole number,
    number or text); later values that don't fit are null. One small job reads that record and the most parts of any.
    """
    import re

    if key not in df.columns:
        return df
    quoted = re.escape(delimiter)
    parts = F.split(F.regexp_replace(F.col(f"`{key}`").cast("string"), f"({quoted})+$", ""), quoted, -1)
    split = df.withColumn("__parts", F.when(F.size(parts) > 1, parts))
    order = [F.col(c) for c in ([order_by] if isinstance(order_by, str) else order_by or (["__ord"] if "__ord" in df.columns else []))]
    known = split.where("__parts IS NOT NULL").agg(F.max(F.size("__parts")), F.min_by("__parts", F.struct(*order)) if order else F.min("__parts")).first()
    if known[0] is None:
        return df
    names = O.listed(keys) if keys else [f"{key}_{i}" for i in range(known[0])]
    kinds = {int: "bigint", float: "double", str: "string"}
    typed = [kinds[type(O.to_number(known[1][i]))] if i < len(known[1]) else "string" for i in range(len(names))]
    return split.withColumns({n: F.try_element_at("__parts", F.lit(i + 1)).try_cast(t) for i, (n, t) in enumerate(zip(names, typed, strict=True))}).drop("__parts")


@command()
def reverse_seq(df: DataFrame) -> DataFrame:
    """Sequence and scores back to front."""
    return df.withColumns({n: F.reverse(n) for n in ("SEQ", "SCORES") if n in df.columns})


@command(check=lambda o: O.allowed_values(o, type=("dna", "rna")), type=None)
def complement_seq(df: DataFrame, type: str | None = None) -> DataFrame:
    """The IUPAC complement; without ``type`` each sequence's kind is guessed, and a protein fails when it is reached."""
    if "SEQ" not in df.columns:
        return df
    if type:
        return df.withColumn("SEQ", S.complement("SEQ", type))
    kind = S.type_guess("SEQ")
    protein = F.raise_error(F.concat(F.lit("no complement of a protein: "), F.substring("SEQ", 1, 40))).cast("string")
    return df.withColumn("SEQ", F.when(F.col("SEQ").isNull(), None).when(kind == "dna", S.complement("SEQ")).when(kind == "rna", S.complement("SEQ", "rna")).otherwise(protein))


def _with_length(df: DataFrame, **columns: Column) -> DataFrame:
    """Sets columns where there is a sequence, and then its length."""
    return _set(_set(df, F.col("SEQ").isNotNull(), **columns), F.col("SEQ").isNotNull(), SEQ_LEN=F.length("SEQ").cast("long"))


def _check_slice(o: dict) -> None:
    O.required(o, "start")


@command(check=_check_slice, start=None, stop=None, exclusive=False)
def slice_seq(df: DataFrame, start: int, stop: int | None = None, exclusive: bool = False) -> DataFrame:
    """The residue at ``start``, or those from ``start`` to ``stop``; scores likewise."""
    if "SEQ" not in df.columns:
        return df
    return _with_length(df, **{n: S.slice_seq(n, start, stop, exclusive) for n in ("SCORES", "SEQ") if n in df.columns})


@command(check=lambda o: O.allowed(o, "columns_only"), columns_only=False)
def degap_seq(df: DataFrame, columns_only: bool = False) -> DataFrame:
    """Without gaps; with ``columns_only`` without the columns of an alignment that are gaps in every sequence.

    Each partition tells which columns hold a residue, a row a column, so that no residue is shuffled; the mask, as long as
    the alignment is wide, goes to the driver and back to the tasks.
    """
    if "SEQ" not in df.columns:
        return df
    if not columns_only:
        columns = {"SEQ": S.indels_remove("SEQ")}
        if "SCORES" in df.columns:
            columns = {"SCORES": F.when(F.length("SEQ") == F.length("SCORES"), S.scores_without_gaps("SEQ", "SCORES")).otherwise(F.col("SCORES")), **columns}
        return _with_length(df, **columns)
    seqs = df.where("SEQ IS NOT NULL").select("SEQ")
    widths = seqs.agg(F.min(F.length("SEQ")), F.max(F.length("SEQ"))).first()
    if widths[0] != widths[1]:
        raise DataError(f"aligned sequences must be equally long, not {widths[0]} to {widths[1]}")
    solid = np.zeros(widths[0] or 0, bool)
    solid[[r.pos for r in _solid_columns(seqs, len(solid)).collect()]] = True

    @F.pandas_udf("string")
    def pick(texts: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else _code_points(s)[solid].tobytes().decode("utf-32-le") for s in texts], dtype=object)

    return _with_length(df, SEQ=pick("SEQ"))


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _solid_columns(seqs: DataFrame, width: int) -> DataFrame:
    """(pos): the columns of equally long sequences that aren't gaps in all of them."""
    gaps = _code_points(GAPS)

    def solid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(width, bool)
        for batch in batches:
            for s in batch.column(0).to_pylist():
                held |= ~np.isin(_code_points(s), gaps)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(held), pa.int32())], names=["pos"])

    return seqs.mapInArrow(solid, "pos int").distinct()


def _check_mask(o: dict) -> None:
    O.allowed_values(o, mask=("soft", "hard"))
    O.check(o, "quality_min >= 0", "quality_min <= 40")


@command(check=_check_mask, quality_min=20, mask="soft")
def mask_seq(df: DataFrame, quality_min: int = 20, mask: str = "soft") -> DataFrame:
    """Residues with low scores in lower case, or as N."""
    if not has(df, "SEQ", "SCORES"):
        return df
    masked = _set(df, present("SEQ", "SCORES"), SEQ=S.mask("SEQ", "SCORES", quality_min, mask == "hard"))
    return _set(masked, present("SEQ", "SCORES"), SEQ_LEN=F.length("SEQ").cast("long"))


def _check_trim(o: dict) -> None:
    O.allowed_values(o, mode=("left", "right", "both"))
    O.check(o, "quality_min >= 0", "quality_min <= 40", "length_min > 0")


@command(check=_check_trim, quality_min=20, length_min=3, mode="both")
def trim_seq(df: DataFrame, quality_min: int = 20, length_min: int = 3, mode: str = "both") -> DataFrame:
    """Ends cut off up to ``length_min`` good scores in a row."""
    if not has(df, "SEQ", "SCORES"):
        return df
    cut = {n: S.trim(n, "SCORES", quality_min, length_min, mode) for n in ("SEQ", "SCORES")}
    trimmed = _set(df, present("SEQ", "SCORES"), **cut)
    return _set(trimmed, present("SEQ", "SCORES"), SEQ_LEN=F.length("SEQ").cast("long"))


@command(check=lambda o: O.check(o, "window_size > 1"), local=False, window_size=5)
def mean_scores(df: DataFrame, local: bool = False, window_size: int = 5) -> DataFrame:
    """SCORES_MEAN to two places, or the least mean of a window as SCORES_MEAN_LOCAL."""
    if "SCORES" not in df.columns:
        return df
    if local:
        return df.withColumn("SCORES_MEAN_LOCAL", S.scores_mean_local("SCORES", window_size).cast("double"))
    return df.withColumn("SCORES_MEAN", S.scores_mean_hundredths("SCORES") / 100)


def _check_primer(o: dict) -> None:
    O.required(o, "primer", "direction")
    O.allowed_values(o, direction=("forward", "reverse"))
    O.check(o, *[f"{k}_percent {c} {v}" for k in ("mismatch", "insertion", "deletion") for c, v in ((">=", 0), ("<=", 100))], "search_distance > 0", "overlap_min > 0")


def _budget(primer: str, *percents: int) -> list[int]:
    """Whole numbers of edits for percentages of a primer's length."""
    return [int(len(primer) * p * 0.01 + 0.5) for p in percents]


@command(check=_check_primer, primer=None, direction=None, reverse_complement=False, search_distance=None, mismatch_percent=0, insertion_percent=0, deletion_percent=0)
def clip_primer(
    df: DataFrame, primer: str, direction: str, reverse_complement: bool = False, search_distance: int | None = None, mismatch_percent: int = 0, insertion_percent: int = 0, deletion_percent: int = 0
) -> DataFrame:
    """What follows a primer (forward) or comes before it (reverse), with where and how it was found.

    Forward, the primer is looked for among the first ``search_distance`` residues; reverse, among the last. Records
    without it stay, but for CLIP_PRIMER columns of an earlier search.
    """
    if "SEQ" not in df.columns:
        return df
    from ..functions import alphabet as A

    names = [f"CLIP_PRIMER_{n}" for n in ("DIR", "POS", "LEN", "PAT")]
    df = df.drop(*names)
    pattern = A.reverse_complement(primer) if reverse_complement else primer
    edits = _budget(primer, mismatch_percent, insertion_percent, deletion_percent)
    start, stop = 0, None
    if search_distance is not None:
        start, stop = (0, max(0, search_distance - len(primer))) if direction == "forward" else (-search_distance, None)
    hit = search.patmatch("SEQ", pattern, *edits, start=start, stop=stop)
    df = df.withColumn("__hit", hit)
    found = F.col("__hit").isNotNull()
    begin = F.col("__hit.pos") + F.col("__hit.length") + 1
    cut = (lambda n: F.substring(F.col(n), begin, F.length(n))) if direction == "forward" else (lambda n: F.substring(F.col(n), F.lit(1), F.col("__hit.pos")))
    columns = {n: cut(n) for n in ("SEQ", "SCORES") if n in df.columns}
    columns |= dict(zip(names, (F.lit(direction.upper()), F.col("__hit.pos").cast("long"), F.col("__hit.length").cast("long"), F.col("__hit.match")), strict=True))
    return _set(_set(df, found, **columns), found, SEQ_LEN=F.length("SEQ").cast("long")).drop("__hit")


@command(check=_check_primer, primer=None, direction=None, reverse_complement=False, overlap_min=1, mismatch_percent=0, insertion_percent=0, deletion_percent=0)
def trim_primer(
    df: DataFrame, primer: str, direction: str, reverse_complement: bool = False, overlap_min: int = 1, mismatch_percent: int = 0, insertion_percent: int = 0, deletion_percent: int = 0
) -> DataFrame:
    """A primer, or as much of it as there is, cut from an end of the sequence.

    Forward, ever shorter ends of the primer are looked for at the beginning; reverse, ever shorter beginnings at the end,
    down to ``overlap_min`` residues. Each record is searched on its own.
    """
    if "SEQ" not in df.columns:
        return df
    from ..functions import alphabet as A

    names = [f"TRIM_PRIMER_{n}" for n in ("DIR", "POS", "LEN", "PAT")]
    df = df.drop(*names)
    pattern = A.reverse_complement(primer) if reverse_complement else primer
    kind = "struct<pos:int,length:int,match:string>"
    hits = []
    for n in range(len(pattern), overlap_min - 1, -1):
        part = pattern[-n:] if direction == "forward" else pattern[:n]
        edits = _budget(part, mismatch_percent, insertion_percent, deletion_percent)
        if any(edits):
            hits.append((part, edits))
        else:
            hits.append((part, None))
    if all(e is None for _, e in hits):  # exact: an unrolled comparison in SQL, the longest first
        tries = []
        for part, _ in hits:
            n = len(part)
            piece = F.substring("SEQ", 1, n) if direction == "forward" else F.substring(F.col("SEQ"), F.length("SEQ") - n + 1, F.lit(n))
            pos = F.lit(0) if direction == "forward" else F.length("SEQ") - n
            tries.append(F.when((F.length("SEQ") >= n) & piece.rlike(f"^{A.as_regex(part)}$"), F.struct(pos.cast("int").alias("pos"), F.lit(n).alias("length"), piece.alias("match"))))
        hit = F.coalesce(*tries) if tries else F.lit(None).cast(kind)
    else:
        hit = _end_search(hits, direction)(F.col("SEQ"))
        hit = F.when(hit["pos"].isNotNull(), hit)
    df = df.withColumn("__hit", hit)
    found = F.col("__hit").isNotNull()
    cut = (lambda n: F.substring(F.col(n), F.col("__hit.length") + 1, F.length(n))) if direction == "forward" else (lambda n: F.substring(F.col(n), F.lit(1), F.col("__hit.pos")))
    columns = {n: cut(n) for n in ("SEQ", "SCORES") if n in df.columns}
    columns |= dict(zip(names, (F.lit(direction.upper()), F.col("__hit.pos").cast("long"), F.col("__hit.length").cast("long"), F.col("__hit.match")), strict=True))
    return _set(_set(df, found, **columns), found, SEQ_LEN=F.length("SEQ").cast("long")).drop("__hit")


def _end_search(parts: list, direction: str):
    """A function that looks for the first of some patterns at the beginning or the end of sequences."""
    @F.pandas_udf("struct<pos:int,length:int,match:string>")
    def find(texts: pd.Series) -> pd.DataFrame:
        patterns = [(len(p), search.FuzzyPattern(p, *(e or (0, 0, 0)))) for p, e in parts]
        rows = []
        for s in texts:
            hit = None
            for n, p in patterns if s else ():
                if direction == "forward":
                    hit = p.first(s, 0, 0)
                else:
                    starts = range(max(0, len(s) - n), len(s))
                    hit = next((h for at in starts if (h := p.first(s, at, at)) and sum(h) == len(s)), None)
                if hit:
                    break
            rows.append((hit[0], hit[1], s[hit[0] : sum(hit)]) if hit else (None, None, None))
        return pd.DataFrame(rows, columns=["pos", "length", "match"]).astype({"pos": "Int32", "length": "Int32"})

    return find


def _check_slice_align(o: dict) -> None:
    O.at_most_one(o, "start", "forward", "forward_rc")
    O.at_most_one(o, "stop", "reverse", "reverse_rc")
    O.files_exist(o, "template_file")
    O.check(o, *[f"max_{k} {c} {v}" for k in ("mismatches", "insertions", "deletions") for c, v in ((">=", 0), ("<=", 5))])
    if o.get("start") is None and not (o.get("forward") or o.get("forward_rc")):
        raise O.OptionError("give start (and stop), or a forward and a reverse primer")


@command(check=_check_slice_align, start=None, stop=None, forward=None, forward_rc=None, reverse=None, reverse_rc=None, max_mismatches=2, max_insertions=1, max_deletions=1, template_file=None, order_by=None)
def slice_align(
    df: DataFrame, start=None, stop=None, forward=None, forward_rc=None, reverse=None, reverse_rc=None, max_mismatches: int = 2, max_insertions: int = 1, max_deletions: int = 1, template_file=None, order_by=None
) -> DataFrame:
    """Columns of an alignment: from ``start`` to ``stop``, or from a forward to a reverse primer, both included.

    Primers are looked for in the first sequence without its gaps, or in the template, whose ungapped places ``start`` and
    ``stop`` then are too. The place is found once, on the driver, from that one sequence.
    """
    if "SEQ" not in df.columns:
        return df
    if template_file:
        from ..sources.fasta import parse_fasta

        with open(template_file, encoding="utf-8") as f:
            template = next(parse_fasta(f.read()), (None, ""))[1]
    else:
        order = [F.col(c) for c in ([order_by] if isinstance(order_by, str) else order_by or (["__ord"] if "__ord" in df.columns else []))]
        seqs = df.where("SEQ IS NOT NULL")
        row = (seqs.orderBy(*order) if order else seqs).select("SEQ").first()
        if row is None:
            return df
        template = row[0]
    bare = "".join(c for c in template if c not in ".-_~")
    places = [i for i, c in enumerate(template) if c not in ".-_~"]
    if start is not None:
        first, last = (places[start], places[stop if stop is not None else start]) if template_file else (start, stop if stop is not None else start)
    else:
        from ..functions import alphabet as A

        limits = max_mismatches, max_insertions, max_deletions
        hits = []
        for given, turned in ((forward, forward_rc), (reverse, reverse_rc)):
            primer = given or (A.reverse_complement(turned) if turned else None)
            hit = search.FuzzyPattern(primer, *limits).first(bare) if primer else None
            if hit is None:
                raise DataError(f"primer not found: {primer}")
            hits.append(hit)
        first, last = places[hits[0][0]], places[sum(hits[1]) - 1]
    return _with_length(df, **{n: S.slice_seq(n, first, last) for n in ("SCORES", "SEQ") if n in df.columns})


@command(check=lambda o: O.check(o, "confidence >= 0", "confidence <= 100"), key="TAXONOMY", confidence=80)
def filter_taxonomy(df: DataFrame, key: str = "TAXONOMY", confidence: int = 80) -> DataFrame:
    """The levels of ``name(conf);...`` whose confidence is high enough; ``Unclassified`` if none is."""
    if key not in df.columns:
        return df
    sure = F.filter(F.split(key, ";"), lambda x: F.regexp_extract(x, r"\((\d+)\)$", 1).try_cast("int") >= confidence)
    return df.withColumn(key, F.when(F.col(key).isNotNull(), F.when(F.size(sure) > 0, F.array_join(sure, ";")).otherwise("Unclassified")))

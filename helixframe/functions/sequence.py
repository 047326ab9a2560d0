"""Column functions on sequences and score strings: SQL expressions, but for k-mers, which are Arrow-batched numpy."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import BASE_33, GAPS, SCORE_MAX
from . import alphabet as A


_TWO_BITS = np.full(256, -1, np.int64)
for _residues, _code in (("Aa", 0), ("TtUu", 1), ("Cc", 2), ("Gg", 3)):
    _TWO_BITS[[ord(c) for c in _residues]] = _code


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once a row, however often a lambda in it is called."""
    return F.transform(F.array(value), then)[0]


def letters(seq: Column | str) -> Column:
    """The residues as an array; an empty sequence has none."""
    return F.filter(F.split(_c(seq), ""), lambda x: x != "")


def type_guess(seq: Column | str) -> Column:
    """``protein``, ``rna`` or ``dna`` by the first 100 residues."""
    head = F.lower(F.substring(_c(seq), 1, 100))
    return F.when(head.rlike("[flpqie]"), "protein").when(head.rlike("u"), "rna").otherwise("dna")


def reverse(seq: Column | str) -> Column:
    """Back to front."""
    return F.reverse(_c(seq))


def complement(seq: Column | str, kind: str = "dna") -> Column:
    """IUPAC complement that keeps case; other characters stay."""
    to = A.COMPLEMENT_DNA if kind == "dna" else A.COMPLEMENT_DNA.replace("T", "U")
    return F.translate(_c(seq), A.COMPLEMENT_FROM + A.COMPLEMENT_FROM.lower(), to + to.lower())


def reverse_complement(seq: Column | str, kind: str = "dna") -> Column:
    """The other strand."""
    return reverse(complement(seq, kind))


def to_rna(seq: Column | str) -> Column:
    """T as U."""
    return F.translate(_c(seq), "Tt", "Uu")


def to_dna(seq: Column | str) -> Column:
    """U as T."""
    return F.translate(_c(seq), "Uu", "Tt")


def indels(seq: Column | str) -> Column:
    """Number of gap characters."""
    return F.length(_c(seq)) - F.length(indels_remove(seq))


def indels_remove(seq: Column | str) -> Column:
    """Without gap characters."""
    return F.translate(_c(seq), GAPS, "")


def scores_without_gaps(seq: Column | str, scores: Column | str) -> Column:
    """The scores of the residues that aren't gaps."""
    kept = F.filter(F.arrays_zip(letters(seq).alias("s"), letters(scores).alias("q")), lambda x: ~x["s"].isin(*GAPS))
    return F.array_join(F.transform(kept, lambda x: x["q"]), "")


def slice_seq(seq: Column | str, start: int, stop: int | None = None, exclusive: bool = False) -> Column:
    """Residues from ``start`` to ``stop``, counted from 0 or, if negative, from the end; outside there is nothing.

    Without ``stop`` one residue.
    """
    seq = _c(seq)
    n = F.length(seq)
    begin = F.lit(start) if start >= 0 else n + start
    if stop is None:
        end = begin + 1
    else:
        end = (F.lit(stop) if stop >= 0 else n + stop) + (0 if exclusive else 1)
    return F.when((begin < 0) | (begin >= n) | (end <= begin), F.when(seq.isNotNull(), "")).otherwise(F.substring(seq, begin + 1, end - begin))


def score_values(scores: Column | str) -> Column:
    """Scores as an array of integers."""
    return F.transform(letters(scores), lambda c: F.ascii(c) - BASE_33)


def scores_sum(scores: Column | str) -> Column:
    """Sum of the scores."""
    return F.aggregate(score_values(scores), F.lit(0), lambda a, b: a + b)


def scores_mean(scores: Column | str) -> Column:
    """Mean score; null for an empty string."""
    return scores_sum(scores) / F.nullif(F.length(_c(scores)), F.lit(0))


def scores_mean_hundredths(scores: Column | str) -> Column:
    """Mean score in hundredths, rounded half up in integers."""
    return F.floor((200 * scores_sum(scores) + F.length(_c(scores))) / F.nullif(2 * F.length(_c(scores)), F.lit(0)))


def scores_min(scores: Column | str) -> Column:
    """Least score."""
    return F.array_min(score_values(scores))


def scores_max(scores: Column | str) -> Column:
    """Greatest score."""
    return F.array_max(score_values(scores))


def scores_mean_local(scores: Column | str, window: int = 5) -> Column:
    """Least of the means of all windows, each rounded down; null for strings shorter than a window."""
    n = F.length(_c(scores))
    least = let(score_values(scores), lambda q: F.array_min(F.transform(F.sequence(F.lit(1), F.size(q) - window + 1), lambda i: F.floor(F.aggregate(F.slice(q, i, window), F.lit(0), lambda a, b: a + b) / window))))
    return F.when(n >= window, least)


def is_base_33(scores: Column | str) -> Column:
    """Whether characters occur that only the encoding from 33 has."""
    return _c(scores).rlike("[!-:]")


def is_base_64(scores: Column | str) -> Column:
    """Whether characters occur that only the encoding from 64 has."""
    return _c(scores).rlike("[K-h]")


def scores_valid(scores: Column | str, base: int = BASE_33) -> Column:
    """Whether all scores lie between 0 and 40."""
    return _c(scores).rlike(f"^[\\x{base:02x}-\\x{base + SCORE_MAX:02x}]*$")


def scores_coerce(scores: Column | str, base: int = BASE_33) -> Column:
    """Scores below 0 as 0 and above 40 as 40."""
    printable = [chr(c) for c in range(33, 127)]
    clamped = [chr(min(max(ord(c), base), base + SCORE_MAX)) for c in printable]
    return F.translate(_c(scores), "".join(printable), "".join(clamped))


def scores_convert(scores: Column | str, from_base: int, to_base: int) -> Column:
    """From one encoding to the other."""
    shift = to_base - from_base
    moved = [c for c in range(33, 127) if 33 <= c + shift < 127]
    return F.translate(_c(scores), "".join(map(chr, moved)), "".join(chr(c + shift) for c in moved))


_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_IS_GAP = np.isin(np.arange(256), [ord(c) for c in GAPS])


def _masked(seq: str | None, scores: str | None, quality_min: int, hard: bool) -> str | None:
    if seq is None or scores is None:
        return None
    seq = seq.upper()
    q = np.frombuffer(scores.encode("latin-1", "replace"), np.uint8)[: len(seq)]
    low = q < BASE_33 + quality_min
    if not seq.isascii():
        return "".join([("N" if hard else c.lower()) if k < len(low) and low[k] and c not in GAPS else c for k, c in enumerate(seq)])
    residues = np.frombuffer(seq.encode(), np.uint8).copy()
    part = residues[: len(low)]
    part[:] = np.where(low & ~_IS_GAP[part], ord("N") if hard else _LOW[part], part)
    return residues.tobytes().decode()


def mask(seq: Column | str, scores: Column | str, quality_min: int, hard: bool = False) -> Column:
    """Upper case, but residues whose score is too low in lower case, or N; gaps and residues without a score stay."""

    @F.pandas_udf("string")
    def masked(seqs: pd.Series, qualities: pd.Series) -> pd.Series:
        return pd.Series([_masked(s, q, quality_min, hard) for s, q in zip(seqs, qualities, strict=True)], dtype=object)

    return masked(_c(seq), _c(scores))


def trim_bounds(scores: Column | str, quality_min: int, length_min: int) -> tuple[Column, Column]:
    """How many residues to cut on the left, and where to end, so that runs of ``length_min`` good scores begin and end it.

    Without such a run the left cut is -1 and the end is 0.
    """
    good = bytes(ord("G") if BASE_33 + quality_min <= c < 127 else ord("B") for c in range(256))
    run = b"G" * length_min

    @F.pandas_udf("struct<left:int,end:int>")
    def bounds(texts: pd.Series) -> pd.DataFrame:
        marks = [None if t is None else (t.encode() if t.isascii() else bytes(ord(c) if c < "\x7f" else 255 for c in t)).translate(good) for t in texts]
        rows = [(None, None) if m is None else (m.find(run), m.rfind(run) + length_min if run in m else 0) for m in marks]
        return pd.DataFrame(rows, columns=["left", "end"]).astype("Int32")

    found = bounds(_c(scores))
    return found["left"], found["end"]


def trim(text: Column | str, scores: Column | str, quality_min: int = 20, length_min: int = 3, mode: str = "both") -> Column:
    """A sequence or its scores trimmed by the scores. ``right`` alone keeps one residue after the last good run."""
    text = _c(text)
    left, right = trim_bounds(scores, quality_min, length_min)
    if mode == "right":
        return F.substring(text, F.lit(1), right + 1)
    cut = F.substring(text, left + 1, F.length(text) if mode == "left" else right - left)
    return F.when(left < 0, F.when(text.isNotNull(), "")).otherwise(cut)


def hamming(a: Column | str, b: Column | str, ambiguity: bool = False) -> Column:
    """Number of places that differ, regardless of case; null unless the lengths are equal. With ``ambiguity`` codes match as sets."""
    a, b = F.upper(_c(a)), F.upper(_c(b))
    if ambiguity:
        pairs = F.zip_with(code_bits(a), code_bits(b), lambda x, y: x.bitwiseAND(y) == 0)
    else:
        pairs = F.zip_with(letters(a), letters(b), lambda x, y: x != y)
    return F.when(F.length(a) == F.length(b), F.size(F.filter(pairs, lambda x: x)))


def code_bits(seq: Column | str) -> Column:
    """IUPAC codes as bit sets; 0 for other characters."""
    codes = F.create_map(*[F.lit(x) for kv in A.IUPAC.items() for x in kv])
    return F.transform(letters(F.upper(_c(seq))), lambda c: F.coalesce(F.try_element_at(codes, c), F.lit(0)))


def edit_distance(a: Column | str, b: Column | str) -> Column:
    """Levenshtein distance regardless of case."""
    return F.levenshtein(F.upper(_c(a)), F.upper(_c(b)))


def _kmers_of(text: str | None, quality: str | None, size: int, step: int = 1, score_min: int = 40) -> np.ndarray | None:
    if text is None:
        return None
    codes = _TWO_BITS[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]
    if quality is not None:
        low = np.frombuffer(quality.encode("latin-1", "replace"), np.uint8)[: len(codes)] < BASE_33 + score_min
        codes = np.where(np.pad(low, (0, len(codes) - len(low))), -1, codes)
    n = len(codes) - size + 1
    if n < 1:
        return np.empty(0, np.int64)
    value = np.zeros(n, np.int64)
    for i in range(size):
        value = value * 4 + np.maximum(codes[i : i + n], 0)
    bad = np.concatenate(([0], np.cumsum(codes < 0)))
    whole = (bad[size:] == bad[:-size]) & ((np.arange(n) + size - 1) % step == 0)
    return np.unique(value[whole])


def kmer_counts(df: DataFrame, seq: str = "SEQ", size: int = 8, step: int = 1) -> DataFrame:
    """(kmer, n): in how many sequences each k-mer occurs, summed within each batch before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_kmers_of(t, None, size, step) for t in batch.column(0).to_pylist() if t]
            if found:
                kmer, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(kmer, pa.int64()), pa.array(n, pa.int64())], names=["kmer", "n"])

    return df.select(_c(seq).alias("s")).mapInArrow(count, "kmer long, n long").groupBy("kmer").agg(F.sum("n").alias("n"))


def kmers(seq: Column | str, size: int = 8, step: int = 1, scores: Column | str | None = None, score_min: int = 40) -> Column:
    """Sorted distinct k-mers as integers of two bits a residue (A 0, T and U 1, C 2, G 3).

    K-mers with other residues are left out, and with ``scores`` those that hold a score below ``score_min``. ``step``
    counts by where k-mers end, from the first residue.
    """
    if not 0 < size <= 31:
        raise ValueError(f"bad k-mer size: {size}")

    def of(text: str | None, quality: str | None) -> np.ndarray | None:
        return _kmers_of(text, quality, size, step, score_min)

    if scores is None:

        @F.pandas_udf("array<bigint>")
        def found(texts: pd.Series) -> pd.Series:
            return pd.Series([of(t, None) for t in texts], dtype=object)

        return found(_c(seq))

    @F.pandas_udf("array<bigint>")
    def scored(texts: pd.Series, qualities: pd.Series) -> pd.Series:
        return pd.Series([of(t, q) for t, q in zip(texts, qualities, strict=True)], dtype=object)

    return scored(_c(seq), _c(scores))


def kmer_oligo(kmer: Column | str, size: int) -> Column:
    """A k-mer integer as a sequence."""
    return F.translate(F.lpad(F.conv(_c(kmer).cast("string"), 10, 4), size, "0"), "0123", "ATCG")


def naive_kmers(seq: Column | str, size: int = 8, step: int = 1) -> Column:
    """All k-mers as they stand, in order and with repeats."""
    q = F.upper(_c(seq))
    found = let(letters(q), lambda r: F.transform(F.sequence(F.lit(1), F.size(r) - size + 1, F.lit(step)), lambda i: F.array_join(F.slice(r, i, size), "")))
    return F.when(F.length(q) >= size, found).when(q.isNotNull(), F.array().cast("array<string>"))


def to_key(seq: Column | str) -> Column:
    """A short sequence as an integer of two bits a residue (A 0, C 1, G 2, T 3)."""
    return F.conv(F.translate(F.upper(_c(seq)), "ACGT", "0123"), 4, 10).cast("long")


def translate(seq: Column | str) -> Column:
    """Protein of a DNA sequence by table 11, without the last residue (the stop).

    Null unless the length is a multiple of 3, the first codon can start a protein and all codons are known.
    """
    q = F.upper(_c(seq))
    codons = F.create_map(*[F.lit(x) for kv in A.CODONS.items() for x in kv])
    triples = F.regexp_extract_all(q, F.lit("(.{3})"), 1)
    proteins = F.transform(F.slice(triples, 2, 1 << 30), lambda t: F.try_element_at(codons, t))
    whole = let(proteins, lambda p: F.when(F.forall(p, lambda x: x.isNotNull()), F.concat(F.lit("M"), F.array_join(p, ""))))
    valid = (F.length(q) >= 3) & (F.length(q) % 3 == 0) & F.substring(q, 1, 3).isin(*A.START_CODONS)
    return F.when(valid, F.substring(whole, F.lit(1), (F.length(q) / 3).cast("int") - 1))


def hard_mask(seq: Column | str) -> Column:
    """Percentage of N of the residues without gaps, to two places."""
    return F.round(100.0 * F.regexp_count(F.upper(_c(seq)), F.lit("N")) / F.nullif(F.length(indels_remove(seq)), F.lit(0)), 2)


def soft_mask(seq: Column | str) -> Column:
    """Percentage of lower case of the residues without gaps, to two places."""
    return F.round(100.0 * F.regexp_count(_c(seq), F.lit("[a-z]")) / F.nullif(F.length(indels_remove(seq)), F.lit(0)), 2)


def composition(seq: Column | str) -> Column:
    """Map of upper-case residues to their numbers."""
    parts = letters(F.upper(_c(seq)))
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(parts)), lambda r: F.struct(r, F.size(F.filter(parts, lambda x: x == r)))))


def wrapped(seq: Column | str, width: int | None) -> Column:
    """Lines of ``width`` residues."""
    return F.regexp_replace(_c(seq), f"(.{{{width}}})(?=.)", "$1\n") if width else _c(seq)


def to_fasta(name: Column | str, seq: Column | str, wrap: int | None = None) -> Column:
    """An entry of FASTA."""
    return F.concat(F.lit(">"), _c(name), F.lit("\n"), wrapped(seq, wrap))


def to_fastq(name: Column | str, seq: Column | str, scores: Column | str) -> Column:
    """An entry of FASTQ."""
    return F.concat(F.lit("@"), _c(name), F.lit("\n"), _c(seq), F.lit("\n+\n"), _c(scores))


def pair_base(name: Column | str) -> Column:
    """What the names of two mates share: ``X`` of ``X/1`` or ``X 1:...``; null for other names."""
    name = _c(name)
    base = F.regexp_extract(name, r"^(.*?)(?:/[12]$| [12]:)", 1)
    return F.when(name.rlike(r"/[12]$| [12]:"), base)


def exact_position(seq: Column | str, pattern: str) -> Column:
    """Where an IUPAC pattern matches first, from 0; -1 without a match."""
    return F.regexp_instr(_c(seq), F.lit(f"({A.as_regex(pattern)})")) - 1


def dist_point2point(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of two points."""
    return F.sqrt(F.pow(x2 - x1, 2) + F.pow(y2 - y1, 2))


def dist_point2line(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point from the line through two points."""
    return F.abs((x2 - x1) * (y1 - py) - (x1 - px) * (y2 - y1)) / dist_point2point(x1, y1, x2, y2)


def to_num(text: Column | str) -> Column:
    """A number of decimal text as a double; null for other text."""
    return F.when(_c(text).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), _c(text).cast("double"))


def commify(number: Column | str) -> Column:
    """With thousands separators; doubles keep their decimals."""
    text = _c(number).cast("string")
    return F.concat(F.regexp_replace(F.regexp_extract(text, r"^(-?\d+)", 1), r"(?<=\d)(?=(\d{3})+$)", ","), F.regexp_extract(text, r"^-?\d+(.*)$", 1))


def generate_oligos(size: int, kind: str = "dna") -> list[str]:
    """All sequences of a length, in alphabetical order of the alphabet."""
    return ["".join(x) for x in itertools.product({"dna": "atcg", "rna": "aucg", "protein": "flsycwphqrimtnkvadeg"}[kind], repeat=size)]


def generate(length: int, kind: str = "dna", seed: int | None = None) -> Column:
    """A random sequence in each row."""
    alphabet = {"dna": "ATCG", "rna": "AUCG", "protein": "FLSYCWPHQRIMTNKVADEG"}[kind]
    pool = F.array(*[F.lit(c) for c in alphabet])
    picks = [F.element_at(pool, (F.floor(F.rand(None if seed is None else seed + i) * len(alphabet)) + 1).cast("int")) for i in range(length)]
    return F.concat(*picks) if picks else F.lit("")


def shuffle_seq(seq: Column | str, seed: int | None = None) -> Column:
    """The residues in random order."""
    return F.array_join(F.shuffle(letters(seq), seed), "")


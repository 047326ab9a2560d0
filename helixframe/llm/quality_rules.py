"""Quality rules as weak supervision: rules vote or abstain, and expectation-maximisation weighs them without labels.

Texts are read as UTF-8; bytes that aren't are read as U+FFFD.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, frozen, frozen_texts, id_and_text, slices, table, utf8

#: Name, statistic, the most of a good vote and the least of a bad one; between the two the rule abstains.
RULES = (
    ("symbols", "symbols_per_word", 0.05, 0.3),
    ("duplicate_lines", "dup_line_share", 0.1, 0.5),
    ("repetition", "repeat_share", 0.15, 0.4),
    ("capitals", "capital_share", 0.2, 0.5),
    ("exclamations", "exclaim_per_word", 0.05, 0.4),
    ("long_words", "word_length", 10.0, 14.0),
    ("separators", "bare_token_share", 0.05, 0.2),
    ("plain_words", "odd_word_share", 0.1, 0.4),
)
SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"
_CAPITAL, _SMALL = (bytes(b for b in range(256) if not first <= b < first + 26) for first in (65, 97))


def base_statistics(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a whole UTF-8 text."""
    words = text.split()
    seen: set[bytes] = set()
    duplicates = 0
    for line in text.split(b"\n"):
        if line in seen:
            duplicates += 1
        elif line and not line.isspace():
            seen.add(line)
    code_points = len(text.decode("utf-8", "replace"))
    spaces = len(text) - len(text.translate(None, _SPACE))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return len(words), code_points - spaces, symbols, duplicates, _repeated(words)


def _repeated(words: list[bytes]) -> int:
    """How many words lie in 3-word windows that occur twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter([number.setdefault(w, len(number)) for w in words], np.int64, len(words))
    _, pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)  # so that a window fits one integer
    _, window, count = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    begins = count[window] > 1
    inside = np.zeros(len(words), bool)
    for k in range(3):
        inside[k : k + n] |= begins
    return int(np.count_nonzero(inside))


def failed_base(n_words: int, n_repeat_words: int) -> bool:
    """Too short, or more than half of the words in repeated windows."""
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def values(text: bytes, base: tuple[int, int, int, int, int]) -> dict[str, float]:
    """The statistics that the rules look at, of a text with words."""
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat = base
    capital, small = len(text.translate(None, _CAPITAL)), len(text.translate(None, _SMALL))
    lines = sum(1 for line in text.split(b"\n") if line and not line.isspace())
    ends = [w.rstrip(b".,;:!?)\"'") for w in text.split()]  # what is left of a word without punctuation after it
    bare = sum(1 for w in ends if not w.strip(SYMBOLS + b"-=_~"))
    odd = sum(1 for w in ends if w.strip(SYMBOLS) != w)
    return {
        "symbols_per_word": n_symbols / n_words,
        "dup_line_share": n_dup_lines / lines,
        "repeat_share": n_repeat / n_words,
        "capital_share": capital / max(1, capital + small),
        "exclaim_per_word": text.count(b"!") / n_words,
        "word_length": word_chars / n_words,
        "bare_token_share": bare / n_words,
        "odd_word_share": odd / n_words,
    }


def votes(text: bytes, base: tuple[int, int, int, int, int]) -> list[int]:
    """A vote of each rule: 1 good, 2 bad, 0 abstains, as all do on a text without words."""
    if not base[0]:
        return [0] * len(RULES)
    value = values(text, base)
    return [1 if value[k] <= good else 2 if value[k] >= bad else 0 for _, k, good, bad in RULES]


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, close: float = 1e-9, rounds: int = 100_000) -> np.ndarray:
    """The posterior probability of good quality for each vote pattern.

    Votes are independent given the quality; each rule has its own rates of good, bad and abstaining for either quality.
    It begins with every document suspect that a rule votes against. The rates are smoothed by fixed pseudo counts; a rule
    that always abstains says nothing. Data without any bad vote leave every document good. It ends when no posterior
    moves by ``close`` any more; more than ``rounds`` are an error.
    """
    post = np.where((patterns == 2).any(axis=1), 0.05, 0.95)
    if not (patterns == 2).any():
        return post
    onehot = np.stack([patterns == v for v in range(3)], axis=2).astype(float)
    for _ in range(rounds):
        logs = []
        for weight, lean in ((counts * post, (0.5, 0.45, 0.05)), (counts * (1 - post), (0.5, 0.2, 0.3))):
            rates = np.einsum("p,prv->rv", weight, onehot) + np.array(lean)
            rates /= rates.sum(axis=1, keepdims=True)
            share = (weight.sum() + 1) / (counts.sum() + 2)
            logs.append(np.log(share) + np.einsum("prv,rv->p", onehot, np.log(rates)))
        new = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -500, 500)))
        if np.abs(new - post).max(initial=0) < close:
            return new
        post = new
    raise ArithmeticError(f"the posteriors still move after {rounds} rounds")


def _code(pattern: list[int]) -> int:
    return sum(v * 3**k for k, v in enumerate(pattern))


def fit_votes(codes: DataFrame) -> dict[int, float]:
    """Posterior by vote pattern from (pattern) rows; there are at most 3 ** len(RULES) patterns."""
    rows = codes.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").collect()
    patterns = np.array([[r.pattern // 3**k % 3 for k in range(len(RULES))] for r in rows], int).reshape(-1, len(RULES))
    post = expectation_maximisation(patterns, np.array([r.n for r in rows], float))
    return {r.pattern: float(p) for r, p in zip(rows, post, strict=True)}


STATISTICS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, pattern int"


def statistics(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The base statistics and the vote pattern of every text; null counts as empty."""
    names = [f.split()[0] for f in STATISTICS.split(", ")][1:]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            texts = utf8(batch.column("text"))
            bases = [base_statistics(t) for t in texts]
            rows = [(*b, _code(votes(t, b))) for t, b in zip(texts, bases, strict=True)]
            yield {"doc_id": batch.column("doc_id"), **dict(zip(names, zip(*rows, strict=True) if rows else [[]] * 6, strict=True))}

    return arrow_map(id_and_text(documents, id_col, text_col), STATISTICS, each)


def quality_rules(documents: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The base statistics, ``base_failed``, the posterior ``quality`` and ``kept`` of every row.

    A row is kept if it doesn't fail the base rules and its posterior reaches ``threshold``. Null and empty texts fail.
    """
    rows = frozen(statistics(documents, id_col, text_col))
    quality = fit_votes(rows.select("pattern"))
    known = F.create_map(*[F.lit(x) for kv in quality.items() for x in kv]) if quality else F.create_map(F.lit(0), F.lit(0.0))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed).withColumn("quality", F.try_element_at(known, F.col("pattern")))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold)).drop("pattern")


def keep_good(documents: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``documents`` that :func:`quality_rules` keeps, with all their columns.

    Each text is voted on once: the rows are written to the shared folder with their votes, which are fitted and then
    filtered by, so that no text is shuffled.
    """
    names = documents.columns
    numbered = documents.toDF(*map(str, range(len(names))))  # whatever the names are, and whichever they clash with
    text = names.index(text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            codes = []
            for t in utf8(batch.column(text)):
                base = base_statistics(t)
                codes.append(2 * _code(votes(t, base)) + failed_base(base[0], base[4]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.int32())], names=[*batch.schema.names, "votes"])

    voted = frozen_texts(numbered.mapInArrow(each, T.StructType([*numbered.schema.fields, T.StructField("votes", T.IntegerType())])))
    quality = fit_votes(voted.select(F.shiftright("votes", 1).alias("pattern")))
    kept = [2 * pattern for pattern, q in quality.items() if q >= threshold]  # no more than there are patterns
    return voted.where(F.col("votes").isin(kept)).drop("votes").toDF(*names)


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The rules' verdict on all ``documents``."""
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"]
    return quality_rules(table(spark, sf_dir, "documents")).select(*names)

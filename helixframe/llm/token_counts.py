"""Exact token counts from a histogram of encoded lengths."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, default_vocabulary, frozen, table, utf8
from .encoding import blocks, encoder


def length_histogram(documents: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """(n_tokens, n_docs): how many documents have each encoded length, without special tokens.

    Every row counts, repeated ones too; null and empty texts have length 0. Each batch is counted before it leaves its
    task, so the shuffle carries lengths, not documents.
    """
    path = path or default_vocabulary("word_bpe_49k.json")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encode = encoder(path).encode
        for batch in batches:
            texts = utf8(batch.column("text"))
            for i, j in blocks(texts):
                lengths, docs = np.unique([len(ids) // 4 for ids in encode(texts[i:j])], return_counts=True)
                yield {"n_tokens": lengths, "n": docs}

    counted = arrow_map(documents.select(F.col(f"`{text_col}`").cast("string").alias("text")), "n_tokens long, n long", each)
    return counted.groupBy("n_tokens").agg(F.sum("n").alias("n_docs"))


def _suffix_sums(histogram: DataFrame, step: int = 128) -> DataFrame:
    """Adds docs_from and tokens_from: documents, and their tokens, of this length or more.

    Lengths are summed by ranges of ``step`` first, so that no window holds more than a range or the list of ranges.
    """
    h = histogram.withColumn("range", F.floor(F.col("n_tokens") / step)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    later = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = h.groupBy("range").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    after = ranges.select("range", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t"))
    inside = Window.partitionBy("range").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = h.withColumn("ds", F.sum("n_docs").over(inside)).withColumn("ts", F.sum("tokens").over(inside))
    return sums.join(after, "range").select("n_tokens", "n_docs", (F.col("ds") + F.col("d")).alias("docs_from"), (F.col("ts") + F.col("t")).alias("tokens_from"))


def context_limits(histogram: DataFrame) -> DataFrame:
    """For every length that occurs, taken as a context limit: what fits, what truncation leaves, and the length's quantile.

    Columns: n_tokens, n_docs, docs_from, tokens_from, docs_total, tokens_total, truncated_total (tokens left if documents
    are cut at this limit), docs_over (documents longer than it), quantile (share of documents up to it).
    Between two lengths every answer is linear in the limit, so these rows answer all limits; see :func:`answers`.
    """
    histogram = frozen(histogram)  # a row for each length; else the texts are encoded again for each sum
    totals = histogram.agg(F.sum("n_docs"), F.sum(F.col("n_docs") * F.col("n_tokens"))).first()
    docs, tokens = totals[0] or 0, totals[1] or 0
    kept = F.lit(tokens) - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")
    over = F.col("docs_from") - F.col("n_docs")
    return _suffix_sums(histogram).select(
        "n_tokens", "n_docs", "docs_from", "tokens_from", F.lit(docs).cast("long").alias("docs_total"), F.lit(tokens).cast("long").alias("tokens_total"),
        kept.alias("truncated_total"), over.alias("docs_over"), ((F.lit(docs) - over) / F.lit(max(1, docs))).alias("quantile"),
    )


def answers(limits: DataFrame, context: list[int]) -> DataFrame:
    """(context, truncated_total, docs_over) for given context limits, from :func:`context_limits`.

    Each is answered by the suffix sums of the least length above it: the documents from there on are cut to the limit, and
    what is left of all tokens are those of the other documents. One aggregation finds these lengths for all limits.
    """
    spark = limits.sparkSession
    if not context:
        return spark.createDataFrame([], "context long, truncated_total long, docs_over long")
    above = [F.min_by(F.struct("docs_from", "tokens_from"), F.when(F.col("n_tokens") > int(c), F.col("n_tokens"))) for c in context]
    found = limits.agg(F.max("tokens_total"), *[F.max(F.col("n_tokens") > int(c)) for c in context], *above).first()
    rows = []
    for k, c in enumerate(context):
        docs, tokens = found[1 + len(context) + k] if found[1 + k] else (0, 0)
        rows.append((int(c), (found[0] or 0) - tokens + int(c) * docs, docs))
    return spark.createDataFrame(rows, "context long, truncated_total long, docs_over long")


def quantile_lengths(limits: DataFrame, quantiles: list[float]) -> DataFrame:
    """(quantile, n_tokens): the least length that at least that share of the documents doesn't exceed; null without documents.

    Documents are counted in integers: a share q of n documents is the least whole number that isn't below q * n, q being
    the decimal number that was written.
    """
    spark = limits.sparkSession
    if not quantiles:
        return spark.createDataFrame([], "quantile double, n_tokens long")
    docs = limits.agg(F.max("docs_total")).first()[0] or 0
    upto = F.col("docs_total") - F.col("docs_over")
    needed = [-(-(Fraction(str(q)) * docs) // 1) for q in quantiles]
    found = limits.agg(*[F.min(F.when(upto >= F.lit(int(n)), F.col("n_tokens"))) for n in needed]).first()
    return spark.createDataFrame([(float(q), n) for q, n in zip(quantiles, found, strict=True)], "quantile double, n_tokens long")


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    """The answers for every context limit over all ``documents``."""
    return context_limits(length_histogram(table(spark, sf_dir, "documents")))

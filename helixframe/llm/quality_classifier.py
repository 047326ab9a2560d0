"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, frozen_texts, id_and_text, in_fold, labelled_sample, slices, table, utf8

#: Byte classes that statistics count.
_CLASSES = {
    "small": b"abcdefghijklmnopqrstuvwxyz", "capital": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t\x0b\x0c\r", "line": b"\n", "end": b".", "comma": b",;:", "loud": b"!?", "symbol": b"#*$%&@^~+=_", "bracket": b"|<>{}[]()/\\", "quote": b"\"'-",
}
_OF_BYTE = np.full(256, len(_CLASSES))
for _k, _chars in enumerate(_CLASSES.values()):
    _OF_BYTE[list(_chars)] = _k
N_STATISTICS = len(_CLASSES) + 1 + 9


def statistics(text: bytes) -> list[float]:
    """Numbers that describe a whole text: shares of byte classes, lengths of words and lines, repetition."""
    n = max(1, len(text))
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = np.sqrt(np.bincount(_OF_BYTE, weights=counts, minlength=len(_CLASSES) + 1) / n)
    words = text.split()
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    n_words, n_lines = max(1, len(words)), max(1, len(lines))
    p = counts[counts > 0] / n
    return [
        *shares.tolist(),
        np.log1p(len(words)) / 4,
        np.log1p(len(words) / n_lines) / 2,
        (n - counts[32]) / n_words / 8,
        len(set(lines)) / n_lines,
        len(set(words)) / n_words * min(1.0, np.sqrt(n_words / 200)),
        float(-(p * np.log2(p)).sum()) / 4,
        sum(map(bytes.isalpha, words)) / n_words,
        sum(1 for w in words if len(w) <= 3) / n_words * 3,
        repeated_pairs(words),
    ]


def repeated_pairs(words: list[bytes]) -> float:
    """The share of pairs of neighbouring words that occurred before in the text."""
    pairs = len(words) - 1
    return 1 - len(set(itertools.pairwise(words))) / pairs if pairs > 0 else 0.0


@dataclass
class QualityModel:
    """Standardisation, random frequencies and phases, ridge weights, and the knots of the calibration."""

    centre: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features: their inner products approximate a Gaussian kernel of the standardised statistics."""
        z = np.clip((x - self.centre) / self.scale, -6, 6) @ self.frequencies + self.phases
        return np.hstack([np.cos(z) * np.sqrt(2 / len(self.phases)), np.ones((len(x), 1))])

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Calibrated probability that a text's quality is 1."""
        if not len(texts):
            return np.empty(0)
        raw = self.features(np.array([statistics(t) for t in texts])) @ self.weights
        return np.interp(raw, self.knots, self.values)


def pooled(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centre, mean, number) of the pools of the non-decreasing least-squares fit of y over x (pool adjacent violators).

    Points with one x are one point, of their mean and number, so that their order doesn't matter.
    """
    different, at, number = np.unique(x, return_inverse=True, return_counts=True)
    pools: list[list[float]] = []  # sum of y, number, sum of x
    for v, s, n in zip(different.tolist(), np.bincount(at.ravel(), weights=y, minlength=len(different)).tolist(), number.tolist(), strict=True):
        pools.append([s, n, v * n])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    total, n, weight = np.array(pools).T
    return weight / n, total / n, n


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and values of the calibration: the pools' means at their centres, between which it is linear.

    Each pool is smoothed by half a label of either kind; beyond the outer centres values go on half way to 0 and to 1 over
    a length of the whole range, so that scores differ there too.
    """
    centre, mean, n = pooled(x, y)
    values = np.maximum.accumulate((mean * n + 0.5) / (n + 1))
    reach = max(1e-6, float(x.max() - x.min()))
    return np.concatenate(([centre[0] - reach], centre, [centre[-1] + reach])), np.concatenate(([values[0] / 2], values, [(1 + values[-1]) / 2]))


def fit(sample: DataFrame, features: int = 256, width: float = 4.0, ridge: float = 1e-3, parts: int = 8, seed: int = 7) -> QualityModel:
    """Fit on (doc_id, text, label), which must be of bounded size.

    Statistics are taken on the executors. Each of ``parts`` partitions sums its own normal equations, for each of two
    halves of the sample by a hash of the id; the driver adds the ``parts`` matrices up. Scores for the calibration come
    from the weights of the other half; then the weights are fitted on both. Without labels of both kinds every text
    scores the share of label 1.
    """

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            yield {"x": [statistics(t) for t in utf8(b.column("text"))], "label": b.column("label"), "half": b.column("half")}

    half = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(2)).cast("int").alias("half")
    described = arrow_map(sample.select("text", "label", half), "x array<double>, label int, half int", describe).repartition(parts).persist()
    try:
        ones = F.array(*[F.avg(F.col("x")[i]) for i in range(N_STATISTICS)])
        spread = F.array(*[F.stddev_pop(F.col("x")[i]) for i in range(N_STATISTICS)])
        centre, scale, n, good = described.agg(ones, spread, F.count("*"), F.sum("label")).first()
        rng = np.random.default_rng(seed)
        frequencies, phases = rng.normal(size=(N_STATISTICS, features)) / width, rng.uniform(0, 2 * np.pi, features)
        flat = np.array([(good + 1) / (n + 2)] * 2) if n else np.array([0.5, 0.5])
        if not n or good in (0, n):
            return QualityModel(np.zeros(N_STATISTICS), np.ones(N_STATISTICS), frequencies, phases, np.zeros(features + 1), np.array([0.0, 1.0]), flat)
        model = QualityModel(np.array(centre), np.maximum(scale, 1e-3), frequencies, phases, np.zeros(features + 1), np.array([0.0, 1.0]), flat)
        balance = np.sqrt(n / good), np.sqrt(n / (n - good))

        def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            d = features + 1
            sums = np.zeros((2, d, d + 1))
            for b in batches:
                if len(b):
                    z, y, h = model.features(np.array(b.column("x").to_pylist())), np.array(b.column("label")), np.array(b.column("half"))
                    w = np.where(y == 1, *balance)[:, None]
                    for k in range(2):
                        on = h == k
                        sums[k] += (z[on] * w[on]).T @ np.hstack([z[on], y[on, None]])
            yield {"sums": [sums.tobytes()]}

        sums = sum(np.frombuffer(r.sums).reshape(2, features + 1, features + 2) for r in arrow_map(described, "sums binary", equations).collect())

        def solved(s: np.ndarray) -> np.ndarray:
            return np.linalg.solve(s[:, :-1] + (ridge * np.trace(s[:, :-1]) / len(s) + 1e-9) * np.eye(len(s)), s[:, -1])

        rows = described.collect()  # of the bounded sample
        x, y, h = np.array([r.x for r in rows]), np.array([r.label for r in rows], float), np.array([r.half for r in rows])
        z = model.features(x)
        raw = np.where(h == 0, z @ solved(sums[1]), z @ solved(sums[0]))
        model.knots, model.values = isotonic(raw, y)
        model.weights = solved(sums.sum(axis=0))
        return model
    finally:
        described.unpersist()


def training_rows(documents: DataFrame, labels: DataFrame, parts: int = 4, held_out: int = 2, most: int = 20_000) -> DataFrame:
    """The labelled rows that may be learned from: at most ``most`` of those outside the held-out fold."""
    return labelled_sample(documents, labels, "quality", parts, held_out, most)


def score_quality(documents: DataFrame, model: QualityModel, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for every row; null and empty texts are scored like any other, by their statistics."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            scores = model.score(utf8(b.column("text")))
            yield {"doc_id": b.column("doc_id"), "score": scores, "predicted": (scores >= threshold).astype(np.int32)}

    return arrow_map(id_and_text(documents, id_col, text_col), "doc_id long, score double, predicted int", each)


def keep_predicted(documents: DataFrame, model: QualityModel, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``documents``, with all their columns, whose score reaches ``threshold``; they are written to the shared folder."""

    names = documents.columns
    numbered, text = documents.toDF(*map(str, range(len(names)))), names.index(text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.filter(pa.array(model.score(utf8(b.column(text))) >= threshold, pa.bool_()))

    return frozen_texts(numbered.mapInArrow(each, numbered.schema)).toDF(*names)


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """The quality score of all ``documents``."""
    documents = table(spark, sf_dir, "documents")
    model = fit(training_rows(documents, table(spark, sf_dir, "labels")))
    return score_quality(documents, model).select("doc_id", in_fold("doc_id", 4, 2).alias("held_out"), "score", "predicted")

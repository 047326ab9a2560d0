"""Toxicity: a linear-chain conditional random field over the tokens of whole texts.

Labels are given for documents. Token labels are derived from them: a token of a toxic document is toxic if its word or one
of the word's beginnings is tied to toxic documents by the number of different contexts (neighbouring words) that it occurs
in, which copies of a document don't raise. The field has two states; a token's features are its word, the beginnings of it,
and the words before and after, each with a weight if it is tied to toxic documents. All weights, the bias of a toxic token
and the transition from one toxic token to the next are fitted together, to the greatest penalised likelihood of the token
labels of the sample. Forward-backward gives each token's marginal. Tokens without a weighted feature share one potential,
so runs of them are powers of one 2 x 2 matrix, and whole texts of any length take time in proportion to their featured
tokens. A document's score is a logistic function of its marginals.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, id_and_text, in_fold, labelled_sample, table, utf8

_TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+(?:['\-][0-9A-Za-z\x80-\xff]+)*")
#: Lengths of the word beginnings that are features beside the word itself.
PREFIXES = (4, 6)


def features_of(token: bytes) -> list[bytes]:
    """A lower-case token's own features: the word, and its beginnings if it is longer than they are."""
    return [b"=" + token, *[b"^" + token[:n] for n in PREFIXES if len(token) > n]]


def context_of(before: bytes, after: bytes) -> list[bytes]:
    """The features of a token's neighbours; at either end of a text there is an empty word."""
    return [b"<" + before, b">" + after]


@dataclass
class ToxicField:
    """The weights of the field and of the document score."""

    weights: dict[bytes, float] = field(default_factory=dict)
    bias: float = -4.0
    stay: float = 1.0  # weight of a toxic token after a toxic one
    document: tuple[float, ...] = (-4.0, 6.0, 0.0, 1.0, 1.0, 0.0)  # constant, and the weights of :func:`evidence`

    def __post_init__(self) -> None:
        self._known: dict[bytes, float] = {}
        self._before = {f[1:]: w for f, w in self.weights.items() if f[:1] == b"<"}
        self._after = {f[1:]: w for f, w in self.weights.items() if f[:1] == b">"}

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_known": {}}

    def potential(self, token: bytes) -> float:
        """Sum of the weights of a token's own features; 0 for a token without any."""
        return sum(self.weights.get(f, 0.0) for f in features_of(token))

    def featured(self, text: bytes) -> tuple[int, list[int], list[float]]:
        """Number of tokens, and the positions and potentials of those with a feature."""
        known = self._known
        if len(known) > 500_000:
            known.clear()
        tokens = _TOKEN.findall(text.lower())
        potentials = [known.get(t) for t in tokens]
        if None in potentials:
            for i, p in enumerate(potentials):
                if p is None:
                    potentials[i] = known[tokens[i]] = self.potential(tokens[i])
        if self._before and tokens:
            potentials = [p + self._before.get(t, 0.0) for p, t in zip(potentials, [b"", *tokens], strict=False)]
        if self._after and tokens:
            potentials = [p + self._after.get(t, 0.0) for p, t in zip(potentials, [*tokens[1:], b""], strict=True)]
        at = [i for i, p in enumerate(potentials) if p]
        return len(tokens), at, [potentials[i] for i in at]

    def marginals(self, n: int, at: list[int], potentials: list[float]) -> tuple[np.ndarray, float, float]:
        """Toxic marginal of each featured token, the probability that any token is toxic, and the log partition function.

        Forward and backward vectors are kept at the featured tokens only and scaled to sum to 1.
        """
        run = _Runs(self.bias, self.stay)
        if not n:
            return np.empty(0), 0.0, 0.0
        forward, total, previous = [], 0.0, -1
        a0, a1 = 1.0, 0.0  # before the first token, as if after a clean one
        for i, p in zip(at, potentials, strict=True):
            a0, a1, s = run.forward(a0, a1, i - previous - 1)
            total += s
            e = math.exp(min(200.0, self.bias + p))
            a0, a1 = a0 + a1, (a0 + a1 * run.stay) * e
            s = a0 + a1
            a0, a1, total, previous = a0 / s, a1 / s, total + math.log(s), i
            forward.append(a1)
        a0, a1, s = run.forward(a0, a1, n - previous - 1)
        total += s + math.log(a0 + a1)
        any_toxic = -math.expm1(min(0.0, -total))  # the weight of the path without a toxic token is 1
        b0, b1, out, after = 1.0, 1.0, [0.0] * len(at), n
        for k in range(len(at) - 1, -1, -1):
            b0, b1 = run.backward(b0, b1, after - at[k] - 1)
            f1 = forward[k]
            z = (1 - f1) * b0 + f1 * b1
            out[k] = f1 * b1 / z
            e = math.exp(min(200.0, self.bias + potentials[k]))
            b0, b1 = b0 + e * b1, b0 + run.stay * e * b1
            s = b0 + b1
            b0, b1, after = b0 / s, b1 / s, at[k]
        return np.array(out), any_toxic, total

    def summary(self, text: bytes) -> tuple[float, float, list[tuple[int, float]]]:
        """Greatest marginal and expected number of featured toxic tokens, and (token, marginal) pairs.

        Tokens without a feature are no evidence, so that a text isn't suspect for being long.
        """
        n, at, potentials = self.featured(text)
        p, _, _ = self.marginals(n, at, potentials)
        return float(p.max(initial=0.0)), float(p.sum()), list(zip(at, p.tolist(), strict=True))

    def score(self, text: bytes) -> float:
        """Probability that the document is toxic."""
        greatest, expected, _ = self.summary(text)
        z = sum(w * x for w, x in zip(self.document, evidence(greatest, expected), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def spans(self, text: bytes, threshold: float = 0.5) -> list[tuple[int, int, float]]:
        """Byte offsets (begin, end) and greatest marginal of the runs of tokens whose marginal reaches ``threshold``."""
        places = [m.span() for m in _TOKEN.finditer(text.lower())]
        out: list[tuple[int, int, float]] = []
        last = -2
        for i, p in self.summary(text)[2]:
            if p >= threshold:
                joined = last == i - 1 and out
                begin, most = (out[-1][0], max(out[-1][2], p)) if joined else (places[i][0], p)
                out[-1:] = [*([] if joined else out[-1:]), (begin, places[i][1], most)]
                last = i
        return out


def evidence(greatest: float, expected: float) -> tuple[float, ...]:
    """What the document score weighs: 1, the greatest marginal and its square, and how many toxic tokens there are, from one, two and three on."""
    return 1.0, greatest, greatest * greatest, math.log1p(expected), math.log1p(max(0.0, expected - 1)), math.log1p(max(0.0, expected - 2))


class _Runs:
    """Powers of the matrix of a token without features: clean to clean 1, to toxic e; toxic to clean 1, to toxic stay * e."""

    def __init__(self, bias: float, stay: float):
        self.stay, self.e = math.exp(stay), math.exp(bias)
        t, d = 1 + self.stay * self.e, self.stay * self.e - self.e  # trace and determinant
        r = math.sqrt(max(t * t / 4 - d, 1e-300))
        self.high, self.low = t / 2 + r, t / 2 - r

    def _power(self, n: int) -> tuple[float, float]:
        """Coefficients (x, y) with M ** n = high ** n * (x * M + y * I)."""
        q = (self.low / self.high) ** n
        x = (1 - q) / (self.high - self.low)
        return x, (self.high * q - self.low) / (self.high - self.low)

    def forward(self, a0: float, a1: float, n: int) -> tuple[float, float, float]:
        """A row vector after n such tokens, and the log of its scale."""
        if not n:
            return a0, a1, 0.0
        x, y = self._power(n)
        b0, b1 = x * (a0 + a1) + y * a0, x * self.e * (a0 + self.stay * a1) + y * a1
        s = b0 + b1
        return b0 / s, b1 / s, n * math.log(self.high) + math.log(s)

    def backward(self, b0: float, b1: float, n: int) -> tuple[float, float]:
        """A column vector before n such tokens, up to scale."""
        if not n:
            return b0, b1
        x, y = self._power(n)
        return x * (b0 + self.e * b1) + y * b0, x * (b0 + self.stay * self.e * b1) + y * b1


def _sketch(text: bytes, size: int = 64) -> bytes:
    """The least hashes, under ``size`` hash functions, of the pairs of words that follow each other."""
    import xxhash

    tokens = _TOKEN.findall(text.lower())
    pairs = {xxhash.xxh64_intdigest(x + b" " + y) for x, y in zip(tokens, tokens[1:], strict=False)} or {xxhash.xxh64_intdigest(b" ".join(tokens))}
    hashes, rng = np.fromiter(pairs, np.uint64, len(pairs)), np.random.default_rng(size)
    factors = rng.integers(0, 1 << 63, size, np.uint64) * np.uint64(2) + np.uint64(1)
    return np.array([(hashes * f).min() >> np.uint64(32) for f in factors], np.uint32).tobytes()


def copy_groups(sketches: list[bytes], alike: float = 0.4) -> list[int]:
    """A group for each sketch: that of the first one which begins a group and shares at least ``alike`` of its hashes."""
    if not sketches:
        return []
    rows = np.frombuffer(b"".join(sketches), np.uint32).reshape(len(sketches), -1)
    heads, m, groups = np.empty_like(rows), 0, []
    for row in rows:
        near = np.flatnonzero((heads[:m] == row).mean(axis=1) >= alike) if m else ()
        if not len(near):
            heads[m] = row
            m += 1
        groups.append(int(near[0]) if len(near) else m - 1)
    return groups


def toxic_features(sample: DataFrame, least: int = 4, ratio: float = 16.0) -> list[bytes]:
    """All features tied to label 1, from (text, label) rows of bounded number and size.

    Exact copies count once, and near copies of one label (see :func:`copy_groups`) are a group that counts as one document.
    In toxic documents a feature counts once for each pair of neighbouring words, and no more often than there are groups
    with it, so that near copies add nothing and take nothing from the evidence of other documents. It must occur in
    ``least`` contexts, and the likelihood ratio of its groups (G squared against the share of toxic ones) must reach
    ``ratio``. Groups are then counted for such features alone, documents without copies summed within each batch before
    the shuffle.
    """
    distinct = sample.select("text", "label").groupBy(F.md5(F.col("text").cast("binary")).alias("text_md5")).agg(F.first("text").alias("text"), F.max("label").alias("label"))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        import xxhash

        for b in batches:
            for text in utf8(b.column("text")):
                tokens = [b"", *_TOKEN.findall(text.lower()), b""]
                seen: set[tuple[bytes, int]] = set()
                for i in range(1, len(tokens) - 1):
                    context = xxhash.xxh64_intdigest(tokens[i - 1] + b" " + tokens[i + 1]) >> 1
                    seen.update((f, context) for f in features_of(tokens[i]))
                    beside = xxhash.xxh64_intdigest(tokens[i]) >> 1
                    seen.update((f, beside) for f in context_of(tokens[i - 1], tokens[i + 1]))
                if seen:
                    yield {"feature": [f for f, _ in seen], "context": [c for _, c in seen]}

    found = arrow_map(distinct.where("label = 1").select("text"), "feature binary, context long", contexts).distinct()
    varied = found.groupBy("feature").agg(F.count("*").alias("contexts")).where(F.col("contexts") >= least)
    candidates = {bytes(r.feature): r.contexts for r in varied.collect()}  # no more than the bounded sample's words / least
    if not candidates:
        return []

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            yield {"text_md5": b.column("text_md5"), "label": b.column("label"), "sketch": [_sketch(t) for t in utf8(b.column("text"))]}

    known = sorted(arrow_map(distinct, "text_md5 string, label int, sketch binary", sketches).collect())
    sizes, groups = {}, {}
    for label in (0, 1):
        rows = [r for r in known if r.label == label]
        at = copy_groups([bytes(r.sketch) for r in rows])
        sizes[label] = len(set(at))
        copied = np.bincount(at, minlength=1) > 1
        groups |= {r.text_md5: g for r, g in zip(rows, at, strict=True) if copied[g]}
    toxic, total = sizes[1], sizes[0] + sizes[1]
    if not sizes[0]:
        return []

    def documents_with(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            counts: dict[tuple[bytes, int, int], int] = {}
            for text, label, md5 in zip(utf8(b.column("text")), b.column("label").to_pylist(), b.column("text_md5").to_pylist(), strict=True):
                group = groups.get(md5, -1)
                tokens = _TOKEN.findall(text.lower())
                here = {f for t in set(tokens) for f in (*features_of(t), b"<" + t, b">" + t)}
                if tokens:  # the last word comes before none, the first after none
                    here |= {b"<", b">"}
                    here -= {b"<" + tokens[-1]} - {b"<" + t for t in tokens[:-1]}
                    here -= {b">" + tokens[0]} - {b">" + t for t in tokens[1:]}
                for f in here & candidates.keys():
                    counts[f, label, group] = counts.get((f, label, group), 0) + 1 if group < 0 else 1
            yield {"feature": [f for f, _, _ in counts], "label": [k for _, k, _ in counts], "copies": [g for _, _, g in counts], "n": list(counts.values())}

    counted = arrow_map(distinct, "feature binary, label int, copies long, n long", documents_with)
    counted = counted.groupBy("feature", "label", "copies").agg(F.when(F.col("copies") < 0, F.sum("n")).otherwise(1).alias("n"))
    counted = counted.groupBy("feature").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic"), F.sum("n").alias("n"))
    share, kept = toxic / total, []
    for r in counted.collect():
        t, n = min(r.toxic, candidates[bytes(r.feature)]), r.n
        clean = n - r.toxic
        g = 2 * (t * math.log(t / ((t + clean) * share)) + (clean * math.log(clean / ((t + clean) * (1 - share))) if clean else 0.0))
        if g >= ratio and (t + 0.1) / (clean + 0.1) > 8 * share / (1 - share):
            kept.append((-g, bytes(r.feature)))
    return [f for _, f in sorted(kept)]


def fit(sample: DataFrame, rounds: int = 80, penalty: float = 0.5) -> ToxicField:
    """Fit the field and the document score on (doc_id, text, label) rows of bounded number and size.

    The executors reduce each text to its featured tokens; these reach the driver, where the likelihood is climbed.
    """
    rows = sample.persist()
    try:
        features = toxic_features(rows)
        number = {f: k for k, f in enumerate(features)}
        own = np.array([f[:1] in b"=^" for f in features], bool)

        def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for b in batches:
                out = {"label": b.column("label"), "n": [], "at": [], "hit": [], "feature": []}
                for text in utf8(b.column("text")):
                    tokens = [b"", *_TOKEN.findall(text.lower()), b""]
                    at, hit, ids = [], [], []
                    for i in range(1, len(tokens) - 1):
                        found = [number[f] for f in (*features_of(tokens[i]), *context_of(tokens[i - 1], tokens[i + 1])) if f in number]
                        if found:
                            hit += [len(at)] * len(found)
                            ids += found
                            at.append(i - 1)
                    out["n"].append(len(tokens) - 2)
                    for name, values in (("at", at), ("hit", hit), ("feature", ids)):
                        out[name].append(np.array(values, np.int32).tobytes())
                yield out

        docs = arrow_map(rows, "label int, n long, at binary, hit binary, feature binary", reduce).collect()
    finally:
        rows.unpersist()
    docs = sorted((d.label, d.n, bytes(d.at), bytes(d.hit), bytes(d.feature)) for d in docs)  # the order of the files says nothing
    ints = lambda x: np.frombuffer(x, np.int32).astype(np.int64)
    chains = Chains([(label, n, ints(at), ints(hit), ints(ids)) for label, n, at, hit, ids in docs], len(features), own)
    theta = chains.climb(rounds, penalty)
    model = ToxicField(weights=dict(zip(features, theta[:-2].tolist(), strict=True)), bias=float(theta[-2]), stay=float(theta[-1]))
    _fit_document(model, chains, theta)
    return model


class Chains:
    """The featured tokens of some documents, for forward-backward over all of them at once.

    A document is (label, number of tokens, positions of featured tokens, and pairs of such a token and a feature). The
    parameters are a weight for each feature, then the bias and the transition.
    """

    def __init__(self, docs: list[tuple], features: int, own: np.ndarray):
        docs = sorted(docs, key=lambda d: -len(d[2]))  # so that those that go on at a step are the first ones
        self.label = np.array([d[0] for d in docs], float)
        self.n = np.array([d[1] for d in docs], np.int64)
        self.size = np.array([len(d[2]) for d in docs], np.int64)
        self.first = np.cumsum(self.size) - self.size
        empty = [np.empty(0, np.int64)]
        self.at = np.concatenate(empty + [d[2] for d in docs])
        self.hit = np.concatenate(empty + [d[3] + f for d, f in zip(docs, self.first.tolist(), strict=True)])
        self.feature = np.concatenate(empty + [d[4] for d in docs])
        self.features = features
        of = np.repeat(np.arange(len(docs)), self.size)
        suspect = np.zeros(len(self.at), bool)
        suspect[self.hit[own[self.feature]]] = True
        self.toxic = suspect & (self.label[of] == 1)  # the derived label of each featured token; all other tokens are clean
        follows = (of[1:] == of[:-1]) & (np.diff(self.at) == 1)
        self.pairs = int(np.count_nonzero(follows & self.toxic[1:] & self.toxic[:-1]))
        self.observed = np.bincount(self.feature, weights=self.toxic[self.hit], minlength=features)

    def potentials(self, theta: np.ndarray) -> np.ndarray:
        """The sum of the weights at each featured token."""
        return np.bincount(self.hit, weights=theta[self.feature], minlength=len(self.at))

    @staticmethod
    def _runs(bias: np.ndarray, stay: np.ndarray) -> tuple:
        """What :class:`_Runs` has, for several pairs of parameters at once."""
        s, e = np.exp(stay)[:, None], np.exp(bias)[:, None]
        t, d = 1 + s * e, s * e - e
        r = np.sqrt(np.maximum(t * t / 4 - d, 1e-300))
        high, low = t / 2 + r, t / 2 - r

        def power(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            q = (low / high) ** n.astype(float)
            return (1 - q) / (high - low), (high * q - low) / (high - low)

        return e, s, np.log(high), power

    def forward(self, potentials: np.ndarray, bias: np.ndarray, stay: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For pairs of a bias and a transition, a row each: the log partition function of each document; and, for the first
        pair, the forward share of toxic at each featured token."""
        e, s, grow, power = self._runs(bias, stay)
        own = np.exp(np.minimum(200.0, bias[:, None] + potentials))
        shape = len(bias), len(self.n)
        a0, a1, total, previous = np.ones(shape), np.zeros(shape), np.zeros(shape), np.full(len(self.n), -1)
        share = np.empty(len(self.at))

        def skip(c0: np.ndarray, c1: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            x, y = power(n)
            b0, b1 = x * (c0 + c1) + y * c0, x * e * (c0 + s * c1) + y * c1
            scale = b0 + b1
            return b0 / scale, b1 / scale, n * grow + np.log(scale)

        for k in range(int(self.size.max(initial=0))):
            m = int(np.searchsorted(-self.size, -k))  # documents with more than k featured tokens
            here = self.first[:m] + k
            c0, c1, more = skip(a0[:, :m], a1[:, :m], self.at[here] - previous[:m] - 1)
            c0, c1 = c0 + c1, (c0 + c1 * s) * own[:, here]
            scale = c0 + c1
            a0[:, :m], a1[:, :m] = c0 / scale, c1 / scale
            total[:, :m] += more + np.log(scale)
            share[here], previous[:m] = a1[0, :m], self.at[here]
        c0, c1, more = skip(a0, a1, self.n - previous - 1)
        return np.where(self.n > 0, total + more + np.log(c0 + c1), 0.0), share

    def marginals(self, potentials: np.ndarray, share: np.ndarray, bias: float, stay: float) -> np.ndarray:
        """The toxic marginal of each featured token, by a backward pass over what :meth:`forward` found."""
        e, s, _, power = self._runs(np.array([bias]), np.array([stay]))
        e, s = e.item(), s.item()
        own = np.exp(np.minimum(200.0, bias + potentials))
        b0, b1, after = np.ones(len(self.n)), np.ones(len(self.n)), self.n.copy()
        out = np.empty(len(self.at))
        for k in range(int(self.size.max(initial=0)) - 1, -1, -1):
            m = int(np.searchsorted(-self.size, -k))
            here = self.first[:m] + k
            x, y = (v[0] for v in power(after[:m] - self.at[here] - 1))
            c0, c1 = b0[:m], b1[:m]
            c0, c1 = x * (c0 + e * c1) + y * c0, x * (c0 + s * e * c1) + y * c1
            f = share[here]
            out[here] = f * c1 / ((1 - f) * c0 + f * c1)
            c0, c1 = c0 + own[here] * c1, c0 + s * own[here] * c1
            b0[:m], b1[:m], after[:m] = c0 / (c0 + c1), c1 / (c0 + c1), self.at[here]
        return out

    def likelihood(self, theta: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
        """The penalised log likelihood of the token labels, and its gradient: observed less expected counts.

        Those of the bias and the transition count all tokens; they are differences of the partition function, as its
        derivatives are the expected numbers of toxic tokens and of pairs of them.
        """
        bias, stay = theta[-2:]
        potentials, h = self.potentials(theta), 1e-5
        log_z, share = self.forward(potentials, bias + np.array([0, h, -h, 0, 0]), stay + np.array([0, 0, 0, h, -h]))
        p = self.marginals(potentials, share, bias, stay)
        expected = np.bincount(self.feature, weights=p[self.hit], minlength=self.features)
        tokens, pairs = (log_z[1] - log_z[2]).sum() / (2 * h), (log_z[3] - log_z[4]).sum() / (2 * h)
        toxic = int(np.count_nonzero(self.toxic))
        value = potentials[self.toxic].sum() + bias * toxic + stay * self.pairs - log_z[0].sum() - penalty / 2 * (theta @ theta)
        return float(value), np.concatenate((self.observed - expected, [toxic - tokens, self.pairs - pairs])) - penalty * theta

    def climb(self, rounds: int, penalty: float, memory: int = 8) -> np.ndarray:
        """The parameters of the greatest penalised likelihood, by steps of limited-memory BFGS (Nocedal 1980) with halving."""
        theta = np.zeros(self.features + 2)
        theta[-2] = math.log((np.count_nonzero(self.toxic) + 0.5) / (self.n.sum() + 1))
        value, gradient = self.likelihood(theta, penalty)
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        for _ in range(rounds):
            if np.abs(gradient).max() < 0.05:
                break
            d, kept = gradient.copy(), []
            for s, y in reversed(steps):
                a = (s @ d) / (s @ y)
                d -= a * y
                kept.append(a)
            if steps:
                s, y = steps[-1]
                d *= (s @ y) / (y @ y)
            for (s, y), a in zip(steps, reversed(kept), strict=True):
                d += (a - (y @ d) / (s @ y)) * s
            d /= max(1.0, np.abs(d).max())  # no weight moves by more than 1 at once
            size, rise = 1.0, gradient @ d
            while size > 1e-6:
                new = theta + size * d
                found, slope = self.likelihood(new, penalty)
                if found >= value + 1e-4 * size * rise:
                    break
                size /= 2
            else:
                break
            s, y = new - theta, gradient - slope
            if s @ y > 1e-10:
                steps = [*steps, (s, y)][-memory:]
            theta, value, gradient = new, found, slope
        return theta


def _fit_document(model: ToxicField, chains: Chains, theta: np.ndarray) -> None:
    """Logistic regression of the document label on its marginals, in which evidence never counts against toxicity.

    Evidence whose weight comes out negative is left out, the most negative first, and the others are fitted again.
    """
    if not len(chains.n):
        return
    potentials = chains.potentials(theta)
    p = chains.marginals(potentials, chains.forward(potentials, theta[-2:-1], theta[-1:])[1], *theta[-2:])
    found = zip(chains.first.tolist(), chains.size.tolist(), strict=True)
    x = np.array([evidence(float(p[a : a + n].max(initial=0.0)), float(p[a : a + n].sum())) for a, n in found])
    used, w = list(range(x.shape[1])), np.zeros(0)
    while True:
        w = _logistic(x[:, used], chains.label)
        k = int(np.argmin(w[1:])) + 1 if len(used) > 1 else 0
        if not k or w[k] >= 0:
            break
        del used[k]
    model.document = tuple(float(w[used.index(k)]) if k in used else 0.0 for k in range(x.shape[1]))


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression, by penalised Newton steps; the first column is the constant."""
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-3] + [1e-1] * (x.shape[1] - 1))
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + penalty, x.T @ (y - q) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def training_rows(documents: DataFrame, labels: DataFrame, parts: int = 5, held_out: int = 0, most: int = 8_000) -> DataFrame:
    """The labelled rows that may be learned from: at most ``most`` of those outside the held-out fold, 64 MB together."""
    return labelled_sample(documents, labels, "toxic", parts, held_out, most, 64 << 20)


def score_toxicity(documents: DataFrame, model: ToxicField, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = False) -> DataFrame:
    """(doc_id, score, predicted) for every row, and the offending spans if asked for; null and empty texts count as clean."""
    schema = "doc_id long, score double, predicted int" + ", spans array<struct<begin:long,end:long,marginal:double>>" * with_spans

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            texts = utf8(b.column("text"))
            scores = [model.score(t) for t in texts]
            out = {"doc_id": b.column("doc_id"), "score": scores, "predicted": [int(s >= 0.5) for s in scores]}
            if with_spans:
                out["spans"] = [[dict(zip(("begin", "end", "marginal"), s, strict=True)) for s in model.spans(t)] for t in texts]
            yield out

    return arrow_map(id_and_text(documents, id_col, text_col), schema, each)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """The toxicity score of all ``documents``."""
    documents = table(spark, sf_dir, "documents")
    model = fit(training_rows(documents, table(spark, sf_dir, "labels")))
    return score_toxicity(documents, model).select("doc_id", in_fold("doc_id", 5, 0).alias("held_out"), "score", "predicted")

"""Exact top-k inner-product search over an impact-ordered index, score at a time.

Vectors become integers floor(256 * x). A shard keeps a posting (row, value) for each component that isn't zero, by
dimension and in segments of descending quantised impact: magnitudes are quantised by their quantiles in the shard. For a
block of queries the segments are processed from the greatest impact down, a posting adding its product to the accumulators
of its row for all queries that are still open. After each segment a row's score lies around its accumulator, by no more
than the length of what is unseen of the row times the query's (Cauchy-Schwarz), or the greatest impact to come times the
sum of the query's weights, whichever is less; both are kept for each row and query, not for each posting. A query closes
once the rows that these bounds leave possible are so few that scoring them exactly takes fewer products than the postings
still to come; they are scored exactly, in integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table

#: In how many segments, of equally many postings, a shard's magnitudes are quantised.
SEGMENTS = 12


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """(id, v): the integer components of each row.

    Rows with a null id, a null vector or a null, NaN or infinite component take no part. Rows that repeat an id stand each
    for itself.
    """
    x = F.col("x")
    usable = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("x"))
    rows = rows.where(F.col("id").isNotNull() & x.isNotNull() & usable)
    return rows.select("id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))


class Shard:
    """The impact-ordered index of some vectors. ``products`` counts the multiplications that searches took."""

    def __init__(self, vectors: np.ndarray, segments: int = SEGMENTS):
        self.vectors, self.products = vectors, 0
        n, dims = vectors.shape
        size = np.abs(vectors)
        seen = np.sort(size[size > 0])
        edges = np.unique(seen[(len(seen) * np.arange(segments)) // segments]) if len(seen) else np.empty(0, np.int64)  # least magnitude of each
        self.squares = size.astype(np.float64) ** 2
        self.segments: list[tuple[list, int, np.ndarray]] = []  # postings by dimension, their number, squared length of what is unseen after it
        self.to_come = [int(e) for e in edges[::-1][1:]] + [0] if len(edges) else []
        unseen = self.squares.sum(axis=1)
        above = np.iinfo(np.int64).max
        for k, least in enumerate(edges[::-1].tolist()):
            here = (size >= least) & (size < above)
            lists = []
            for d in range(dims):
                rows = np.flatnonzero(here[:, d])
                if len(rows):
                    lists.append((d, rows, vectors[rows, d].astype(np.float64)[:, None]))
            unseen = np.maximum(0.0, unseen - np.where(here, self.squares, 0.0).sum(axis=1))
            last = k == len(edges) - 1
            self.segments.append((lists, int(np.count_nonzero(here)), np.zeros(n) if last else unseen.copy()))
            # the greatest magnitude that is still to come is below this segment's least
            self.to_come[k] = 0 if last else int(least) - 1
            above = least

    def search(self, queries: np.ndarray, k: int, own: tuple[np.ndarray, np.ndarray] = (np.empty(0, int), np.empty(0, int)), price: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, row) among which are each query's best k rows, leaving out the pairs ``own`` (query, row).

        ``price`` is what an exact product costs, in products of a posting.
        """
        n, dims = self.vectors.shape
        m = len(queries)
        if not n or not m:
            return np.empty(0, int), np.empty(0, int)
        excluded = np.zeros((n, m), bool)
        excluded[own[1], own[0]] = True
        if n <= k or not self.segments:
            return tuple(reversed(np.nonzero(~excluded)))
        q = queries.astype(np.float64)
        length, weight = np.sqrt((q**2).sum(axis=1)), np.abs(q).sum(axis=1)
        rounding = 4 * (dims + 1) * 2.0**-53 * np.sqrt(self.squares.sum(axis=1))  # of sums of products as floats, for a query of length 1
        live = np.arange(m)
        acc = np.zeros((n, m))
        left = sum(count for _, count, _ in self.segments)
        out_q, out_r = [], []
        for (lists, count, unseen), most in zip(self.segments, self.to_come, strict=True):
            part = np.ascontiguousarray(q[live].T)
            for d, rows, values in lists:
                acc[rows] += values * part[d]
            self.products += count * len(live)
            left -= count
            error = np.minimum(np.sqrt(unseen)[:, None] * (length[live] * (1 + 1e-12)), most * weight[live]) + rounding[:, None] * length[live]
            low = np.where(excluded[:, live], -np.inf, acc - error)
            least = np.partition(low, n - k, axis=0)[n - k]  # the k-th best lower bound
            possible = (acc + error >= least) & ~excluded[:, live]
            few = possible.sum(axis=0)
            close = few * dims * price <= left if left else np.ones(len(live), bool)
            if close.any():
                r, j = np.nonzero(possible[:, close])
                out_q.append(live[close][j])
                out_r.append(r)
                live = live[~close]
                if not len(live):
                    break
                acc = np.ascontiguousarray(acc[:, ~close])
        return np.concatenate(out_q), np.concatenate(out_r)

    def scores(self, queries: np.ndarray, at_q: np.ndarray, at_r: np.ndarray) -> np.ndarray:
        """Exact integer scores of pairs; an OverflowError where one doesn't fit 64 bits."""
        dims = self.vectors.shape[1]
        self.products += len(at_q) * dims
        bound = dims * int(np.abs(self.vectors).max(initial=0)) * int(np.abs(queries).max(initial=0))
        if bound >= 1 << 63:
            found = [sum(a * b for a, b in zip(queries[i].tolist(), self.vectors[j].tolist(), strict=True)) for i, j in zip(at_q.tolist(), at_r.tolist(), strict=True)]
            return np.array(found, np.int64)
        score = np.empty(len(at_q), np.int64)
        for s in range(0, len(at_q), 1 << 16):
            i, j = at_q[s : s + (1 << 16)], at_r[s : s + (1 << 16)]
            score[s : s + (1 << 16)] = np.einsum("ij,ij->i", queries[i], self.vectors[j])
        return score


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """Integer rows, shorter ones filled up with zeros."""
    out = np.zeros((len(lists), dims), np.int64)
    flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    lengths = np.diff(offsets)
    out[np.repeat(np.arange(len(lists)), lengths), np.arange(offsets[-1] - offsets[0]) - np.repeat(offsets[:-1] - offsets[0], lengths)] = flat[offsets[0] : offsets[-1]]
    return out


def best_of_shard(cell: pa.Table, k: int, block: int = 128) -> dict:
    """The best k of one shard for each query of a block, without rows that have the query's own id.

    ``cell`` has id, v and asks: the rows of the shard and, where ``asks`` is true, the queries.
    """
    asks = cell["asks"].to_numpy()
    v = cell["v"].combine_chunks()
    v = v.chunk(0) if isinstance(v, pa.ChunkedArray) else v
    everything = _matrix(v, max(1, int(np.diff(v.offsets.to_numpy()).max(initial=0))))
    ids, vectors = cell["id"].to_numpy()[~asks], everything[~asks]
    qids, wanted = cell["id"].to_numpy()[asks], everything[asks]
    del everything
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    shard, out = Shard(vectors), ([], [], [])
    for b in range(0, len(qids), block):
        part, mine = wanted[b : b + block], qids[b : b + block]
        first, end = np.searchsorted(ids, mine), np.searchsorted(ids, mine, side="right")
        own_q = np.repeat(np.arange(len(mine)), end - first)
        own_r = np.concatenate([np.empty(0, int), *[np.arange(x, y) for x, y in zip(first, end, strict=True)]])
        at_q, at_r = shard.search(part, k, (own_q, own_r))
        score = shard.scores(part, at_q, at_r)
        best = np.lexsort((ids[at_r], -score, at_q))
        at_q, at_r, score = at_q[best], at_r[best], score[best]
        top = np.arange(len(at_q)) - np.searchsorted(at_q, at_q) < k
        for column, values in zip(out, (mine[at_q[top]], ids[at_r[top]], score[top]), strict=True):
            column.append(values)
    return dict(zip(("query_id", "vec_id", "score"), (np.concatenate(c or [np.array([], np.int64)]) for c in out), strict=True))


def exact_top_k(df: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 8192, query_rows: int = 16384) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every``, the best k of all rows with other ids.

    Scores are exact; one that doesn't fit 64 bits is an error. Shorter vectors count as filled up with zeros. Ties go to
    the smaller id. Queries without any other row have no result. Rows that repeat an id are candidates each; queries that
    do are one query, whose best k are the best of all its rows' pairs. Each cell of the work holds one shard of rows and
    one block of queries, both of bounded size: a row is sent to each block of queries, a query to each shard, in one shuffle.
    """
    total = df.count()
    parallel = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards, blocks = max(-(-total // shard_rows), min(parallel, -(-total // 1024)), 1), max(1, -(-total // (every * query_rows)))
    place = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")
    cell = lambda shard, block, asks: F.struct(shard.alias("shard"), block.alias("block"), F.lit(asks).alias("asks"))
    as_row = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: cell(place(shards), b, False))
    as_query = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: cell(s, place(blocks), True))
    cells = F.when(F.pmod("id", F.lit(every)) == 0, F.concat(as_row, as_query)).otherwise(as_row)
    dealt = integer_vectors(df, id_col, vector_col).select("id", "v", F.explode(cells).alias("c")).select("id", "v", "c.*")

    def search(rows: pa.Table) -> pa.Table:
        found = best_of_shard(rows, k)
        return pa.table({name: pa.array(values, pa.int64()) for name, values in found.items()})

    found = dealt.groupBy("shard", "block").applyInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_exact_top_k(spark, sf_dir: str) -> DataFrame:
    """Best 5 of all ``embeddings`` for every 50th row."""
    return exact_top_k(table(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.e, r.e)::BIGINT AS score
  FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM scored
)
SELECT query_id, n::INTEGER AS "rank", vec_id, score FROM ranked WHERE n <= 5
"""

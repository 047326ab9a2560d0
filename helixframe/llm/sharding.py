"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Equal texts are a group and stay together. A group goes to the shard where the dot product of its size (its shares of a
shard's bytes, tokens and rows) with the shard's residual capacity is highest, largest groups first. Groups of more than a
small part of the whole, of which there can be but few, are placed on the driver; only one that is too large for a shard is
split. The rest are dealt by a hash over tasks, a bounded number of groups to each, and a task places its groups one by one
in its part of the capacity that is left.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, default_vocabulary, frozen, id_and_text, table, utf8
from .encoding import blocks, encoder

#: What counts of bytes, tokens and rows in the dot product; bytes weigh most, as their balance is the law that is promised.
WEIGHTS = (4.0, 1.0, 1.0)


def facts(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, tokens, grp): UTF-8 bytes and one, token ids of the vocabulary, and a digest of the text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        counts = encoder(path).counts
        for batch in batches:
            texts, ids = utf8(batch.column("text")), batch.column("doc_id")
            for i, j in blocks(texts):
                part = texts[i:j]
                yield {
                    "doc_id": ids.slice(i, j - i), "size": [len(t) + 1 for t in part], "text_crc32": [zlib.crc32(t) for t in part],
                    "tokens": counts(part), "grp": [hashlib.md5(t).digest() for t in part],
                }

    return arrow_map(id_and_text(documents, id_col, text_col), "doc_id long, size long, text_crc32 long, tokens long, grp binary", each)


def place(sizes: list[tuple[float, float, float]], residual: list[list[float]]) -> list[int]:
    """The shard of each item, in the order given: that of the highest dot product of size and residual capacity.

    A shard that would exceed its bytes takes an item only if every one would; then the one with most bytes left does. Ties
    go to the first shard. ``residual`` is what is left afterwards.
    """
    w0, w1, w2 = WEIGHTS
    out = []
    for b, t, n in sizes:
        x, y, z = w0 * b, w1 * t, w2 * n
        chosen, best = -1, 0.0
        for s, (rb, rt, rn) in enumerate(residual):
            if rb >= b:
                fit = rb * x + rt * y + rn * z
                if chosen < 0 or fit > best:
                    chosen, best = s, fit
        if chosen < 0:
            chosen = max(range(len(residual)), key=lambda s: (residual[s][0], -s))
        left = residual[chosen]
        left[0], left[1], left[2] = left[0] - b, left[1] - t, left[2] - n
        out.append(chosen)
    return out


def vector_shards(
    documents: DataFrame, shards: int = 8, heavy_part: int = 4096, groups_per_task: int = 50_000, path: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, size, text_crc32, tokens, shard, slot) for every row; slots number each shard's rows without gaps.

    The sizes of the shards are near equal. Null and empty texts are one group, of size 1 and without tokens a row; repeated
    rows keep a slot each. ``tokens`` are those of the vocabulary ``path``. The driver sees the groups that hold more than a
    ``heavy_part``-th of all bytes, tokens or rows, of which there are at most three times that many.
    """
    rows = frozen(facts(documents, path or default_vocabulary("word_bpe_49k.json"), id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    names = ("bytes", "tokens", "rows")
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    groups = frozen(rows.groupBy("grp").agg(*sums))
    whole = [x or 0 for x in groups.agg(*[F.sum(n) for n in names]).first()]
    unit = [max(1, x) / shards for x in whole]  # a shard's part
    is_heavy = " OR ".join(f"{n} * {heavy_part} > {x}L" for n, x in zip(names, whole, strict=True))
    spark = documents.sparkSession

    # heavy groups, on the driver; what is too large for a shard in chunks of at most a heavy_part-th
    items, dealt = [], []  # (bytes, tokens, rows, grp, chunk); (grp, chunks)
    for g in groups.where(is_heavy).collect():
        parts = max(-(-g[n] * heavy_part // max(1, x)) for n, x in zip(names, whole, strict=True)) if g.bytes * shards > whole[0] else 1
        parts = min(parts, g["rows"])
        dealt.append((bytes(g.grp), parts))
        if parts == 1:
            items.append((g.bytes, g.tokens, g["rows"], bytes(g.grp), 0))
    heavy = F.broadcast(spark.createDataFrame(dealt, "grp binary, chunks long"))
    chunk = F.pmod(F.xxhash64("row"), F.col("chunks"))
    split = rows.join(F.broadcast(spark.createDataFrame([d for d in dealt if d[1] > 1], "grp binary, chunks long")), "grp").withColumn("chunk", chunk)
    if any(parts > 1 for _, parts in dealt):
        items += [(r.bytes, r.tokens, r["rows"], bytes(r.grp), r.chunk) for r in split.groupBy("grp", "chunk").agg(*sums).collect()]
    share = lambda r: tuple(x / u for x, u in zip(r[:3], unit, strict=True))
    items.sort(key=lambda r: (-max(share(r)), r[3], r[4]))
    residual = [[1.0, 1.0, 1.0] for _ in range(shards)]
    placed = [(grp, at, s) for (_, _, _, grp, at), s in zip(items, place([share(r) for r in items], residual), strict=True)]

    # light groups, in tasks; each has of every shard's residual capacity the part that its groups are of all light ones
    light = groups.where(f"NOT ({is_heavy})")
    tasks = max(1, -(-light.count() // groups_per_task))
    of_all = [max(1e-12, sum(r[d] for r in residual)) for d in range(3)]

    def each(group: pa.Table) -> pa.Table:
        sizes = np.stack([group[n].to_numpy() / u for n, u in zip(names, unit, strict=True)], axis=1)
        digest = group["grp"].to_pylist()
        order = sorted(range(len(digest)), key=lambda i: (-sizes[i].max(), digest[i]))
        part = sizes.sum(axis=0) / of_all
        found = place(sizes[order].tolist(), [[r * p for r, p in zip(left, part.tolist(), strict=True)] for left in residual])
        return pa.table({"grp": pa.array([digest[i] for i in order], pa.binary()), "light_shard": pa.array(found, pa.int32())})

    light = light.withColumn("task", F.pmod(F.xxhash64("grp"), F.lit(tasks))).groupBy("task").applyInArrow(each, "grp binary, light_shard int")
    kept = ["doc_id", "size", "text_crc32", "tokens", "row"]
    of_light = rows.join(heavy, "grp", "left_anti").join(light, "grp").select(*kept, F.col("light_shard").alias("shard"))
    places = F.broadcast(spark.createDataFrame(placed, "grp binary, chunk long, shard int"))
    of_heavy = rows.join(heavy, "grp").withColumn("chunk", chunk).join(places, ["grp", "chunk"]).select(*kept, "shard")

    # slots: rows are numbered within parts of bounded size, which follow each other
    parts = max(1, -(-whole[2] // (shards * 100_000)))
    sharded = frozen(of_light.union(of_heavy).withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts))))
    used, bases = [0] * shards, []
    for r in sharded.groupBy("shard", "part").agg(F.count("*").alias("n")).orderBy("shard", "part").collect():
        bases.append((r.shard, r.part, used[r.shard]))
        used[r.shard] += r.n
    before = F.broadcast(spark.createDataFrame(bases, "shard int, part long, base long"))
    number = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row"))
    numbered = sharded.withColumn("n", number).join(before, ["shard", "part"])
    return numbered.select("doc_id", "size", "text_crc32", "tokens", "shard", (F.col("base") + F.col("n") - 1).alias("slot"))


def op9_vector_sharding(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` in 8 shards of near equal bytes."""
    found = vector_shards(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")

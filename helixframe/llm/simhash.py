"""SimHash near-duplicates: exact linking of 64-bit fingerprints by bit-sliced comparison.

Fingerprints at most ``radius`` bits apart agree wholly on at least ``shared`` of ``radius + shared`` blocks of bits, so
each distinct fingerprint goes to one bucket for every choice of ``shared`` blocks and no link can be missed; the more
fingerprints there are, the more blocks, so that buckets by chance stay small. Buckets with more than ``cell`` members are cut into chunks, and each pair of chunks is a cell of its own. Within a cell the bits are
stored as vertical planes (big integers, a bit for each member); all members are compared with their s-th neighbours at
once by adding differing planes into carry-save counters, and a shift is abandoned once every pair exceeds the radius.
A cell yields a spanning forest of its links, never all pairs; components come from alternating star contraction. Joins
deal the rows of hot buckets, nodes, components and fingerprints over salts. The rows of the buckets, of which there are
many for each fingerprint, are never broadcast.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, frozen, frozen_texts, heavy_keys, id_and_text, salted_join, slices, utf8

#: Byte value -> its eight bits in the eight byte lanes of a 64-bit integer (lowest bit in the lowest lane).
_LANES = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")).view(np.uint64).ravel()


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of a UTF-8 text: majority of the XXH64 bits of its word shingles (repeats count); 0 without words."""
    import xxhash

    words = text.lower().split()  # ASCII letters and ASCII white space only, as these are bytes
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1]
    hashes = np.fromiter([digest(joined[i:j], seed) for i, j in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64, len(starts))
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits set in more than half of the hashes."""
    lanes = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    counts = np.zeros((8, 8), np.int64)  # byte, bit
    for k in range(8):
        spread = _LANES[lanes[:, k]]
        for start in range(0, len(spread), 255 * 64):  # a lane holds at most 255 ones
            part = spread[start : start + 255 * 64]
            rows = np.add.reduceat(part, np.arange(0, len(part), 255))
            counts[k] += rows.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts.ravel() > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp): a signed 64-bit integer with the fingerprint's bits. Null and empty texts have fingerprint 0.

    ``carried`` names columns of longs that go along.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in slices(batches):
            fps = np.array([fingerprint(t, width) for t in utf8(b.column("text"))], dtype=np.uint64)
            yield {"doc_id": b.column("doc_id"), "fp": fps.view(np.int64), **{c: b.column(c) for c in carried}}

    columns = F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")
    return arrow_map(documents.select(*columns, *carried), ", ".join(["doc_id long", "fp long", *[f"{c} long" for c in carried]]), each)


def _masks(radius: int, shared: int) -> list[int]:
    """Signed 64-bit masks, one for each choice of ``shared`` of ``radius + shared`` blocks."""
    n = radius + shared
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(edges)]
    masks = [sum(chosen) for chosen in itertools.combinations(blocks, shared)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def blocks_for(count: int, radius: int) -> int:
    """How many shared blocks make buckets that hold, by chance, about 64 of ``count`` fingerprints or fewer."""
    shared = 2
    while shared < 8 and count >> 64 * shared // (radius + shared) > 64:
        shared += 1
    return shared


def planes(fps: np.ndarray) -> list[int]:
    """The 64 vertical bit planes of the fingerprints, each as one big integer with a bit for each fingerprint."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    return [int.from_bytes(row.tobytes(), "little") for row in packed]


def near(columns: list[int], shift: int, alive: int, radius: int) -> int:
    """Of the pairs (i, i + shift) in ``alive``, those that differ in at most ``radius`` bits, as a bit set of i.

    Carry-save counters of ``radius.bit_length()`` bits saturate into ``alive``: a pair leaves it on reaching radius + 1.
    """
    width = (radius + 1).bit_length()
    counter = [0] * width
    for k, column in enumerate(columns):
        carry = (column ^ (column >> shift)) & alive
        for j in range(width):
            counter[j], carry = counter[j] ^ carry, counter[j] & carry
            if not carry:
                break
        if k >= radius:
            reached = alive
            for j in range(width):
                reached &= counter[j] if (radius + 1) >> j & 1 else ~counter[j]
            if reached:
                alive &= ~reached
                if not alive:  # every pair of the block exceeds the radius
                    return 0
    return alive


def linked(fps: np.ndarray, groups: np.ndarray, radius: int) -> np.ndarray:
    """For rows sorted by group, the row each is linked to: the root of a spanning forest of the links within groups."""
    parent = np.arange(len(fps))
    starts = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1]))) if len(fps) else np.array([], int)
    sizes = np.diff(np.append(starts, len(fps)))
    of_row = np.repeat(sizes, sizes)
    kept, shift = np.arange(len(fps)), 1
    columns: list[int] = []
    while True:
        live = int(np.count_nonzero(of_row > shift))
        if not live:
            return parent
        if not columns or 2 * live <= len(kept):  # leave out the rows of groups that are done
            kept = np.flatnonzero(of_row > shift)
            columns = planes(fps[kept])
            ends = np.repeat(np.cumsum(sizes[sizes > shift]), sizes[sizes > shift])
        alive = ends - np.arange(len(kept)) > shift
        pairs = near(columns, shift, int.from_bytes(np.packbits(alive, bitorder="little").tobytes(), "little"), radius)
        if pairs:
            bits = np.frombuffer(pairs.to_bytes((len(kept) + 7) // 8, "little"), np.uint8)
            i = np.flatnonzero(np.unpackbits(bits, bitorder="little"))
            a, b = kept[i], kept[i + shift]
            apart = parent[a] != parent[b]
            if apart.any():
                _union(parent, a[apart].tolist(), b[apart].tolist())
        shift += 1


def _union(parent: np.ndarray, a: list[int], b: list[int]) -> None:
    def find(x: int) -> int:
        while (up := int(parent[x])) != x:
            parent[x] = parent[up]
            x = up
        return x

    for x, y in zip(a, b, strict=True):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    while True:
        up = parent[parent]
        if (up == parent).all():
            return
        parent[:] = up


def links(distinct: DataFrame, radius: int = 4, shared: int | None = None, cell: int = 2048) -> DataFrame:
    """Links (a, b) with a > b that span the same components as all pairs of ``distinct.fp`` within ``radius`` bits.

    Without ``shared`` the number of blocks is chosen by the number of fingerprints (see :func:`blocks_for`).
    """
    count = distinct.count()
    shared = shared or blocks_for(count, radius)
    keys = F.array(*[F.struct(F.lit(t).cast("short").alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(_masks(radius, shared))])
    members = distinct.select("fp", F.explode(keys).alias("k")).select("k.t", "k.key", "fp")
    crowded = members.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / cell).cast("int")
    own = F.pmod(F.xxhash64("fp"), chunks.cast("long")).cast("int")
    hot = heavy_keys(crowded, ["t", "key"], count * len(_masks(radius, shared)))
    split = salted_join(members, crowded, ["t", "key"], hot, by_merge=True).select("t", "key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other"))
    cells = split.select(F.xxhash64("t", "key", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "fp")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held_c, held_f = np.array([], np.int64), np.array([], np.int64)

        def found(c: np.ndarray, f: np.ndarray) -> dict:
            root = f[linked(f.view(np.uint64), c, radius)]
            apart = root != f
            return {"a": np.maximum(f, root)[apart], "b": np.minimum(f, root)[apart]}

        for batch in batches:
            held_c = np.concatenate((held_c, batch.column("cell").to_numpy(zero_copy_only=False)))
            held_f = np.concatenate((held_f, batch.column("fp").to_numpy(zero_copy_only=False)))
            if len(held_c) and held_c[0] != held_c[-1]:
                whole = int(np.flatnonzero(held_c != held_c[-1])[-1]) + 1  # the last cell may go on in the next batch
                yield found(held_c[:whole], held_f[:whole])
                held_c, held_f = held_c[whole:], held_f[whole:]
        if len(held_c):
            yield found(held_c, held_f)

    near_by = cells.repartition(F.col("cell")).sortWithinPartitions("cell", "fp")
    return arrow_map(near_by, "a long, b long", each).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component, for all nodes that have an edge (a, b).

    Alternating large-star and small-star contraction; each round is aggregations and joins on the node, in which hot nodes
    are salted, and is written to the shared folder. Every round keeps what is connected. It ends when each node has one
    edge, to a node that has none itself: then these are the roots, however many rounds it took.
    """
    edges = frozen(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        count, nodes = edges.agg(F.count("*"), F.countDistinct("a")).first()
        roots = edges.select(F.col("b").alias("node")).distinct()
        if count == nodes and roots.join(edges.select(F.col("a").alias("node")), "node", "left_semi").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = edges.union(edges.select("b", "a")).withColumnRenamed("a", "node")
        low = both.groupBy("node").agg(F.min("b").alias("low"), F.count("*").alias("n"))
        hot = heavy_keys(low, ["node"], 2 * count)
        low = low.select("node", F.least("node", "low").alias("low"))
        # large star: every larger neighbour of a node goes to the smallest of its neighbourhood
        large = frozen(salted_join(both.where("b > node"), low, ["node"], hot).select(F.col("b").alias("node"), "low").distinct())
        # small star: every smaller neighbour, and the node itself, goes to the smallest of them
        least = large.groupBy("node").agg(F.min("low").alias("least"), F.count("*").alias("n"))
        small = salted_join(large, least.select("node", "least"), ["node"], heavy_keys(least, ["node"], 2 * count)).select(F.col("low").alias("a"), F.col("least").alias("b"))
        edges = frozen(small.union(least.select("node", "least")).where("a <> b").distinct())


def component_roots(fps: DataFrame, radius: int = 4) -> DataFrame:
    """(fp, n, root) of the distinct ``fp`` values of ``fps``: how many rows have it, and the smallest fingerprint it reaches."""
    distinct = frozen(fps.groupBy("fp").agg(F.count("*").alias("n")))
    roots = components(links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    return frozen(distinct.join(roots, "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("root")))


def with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows``, which have fp, with the root of :func:`component_roots`; fingerprints that many rows share are salted."""
    total = roots.agg(F.sum("n")).first()[0] or 0
    return salted_join(rows, roots.select("fp", "root"), ["fp"], heavy_keys(roots, ["fp"], total))


def near_duplicates(documents: DataFrame, radius: int = 4, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): each document's fingerprint and the smallest doc_id reachable over links.

    Fingerprints link at ``radius`` or fewer differing bits. Null and empty texts have fingerprint zero and link like any
    other. Repeated rows each get a row; rows with a null doc_id are members but never name a component (null if all are).
    """
    docs = frozen_texts(fingerprints(documents, id_col, text_col, width))
    roots = component_roots(docs.select("fp"), radius)
    rooted = with_roots(docs, roots)
    named = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    sizes = roots.groupBy("root").agg(F.sum("n").alias("n"))
    total = roots.agg(F.sum("n")).first()[0] or 0
    return salted_join(rooted, named, ["root"], heavy_keys(sizes, ["root"], total)).select("doc_id", "fp", "component_id")


def one_of_each_component(documents: DataFrame, radius: int = 4, width: int = 4, id_col: str = "doc_id", text_col: str = "text", most_broadcast: int = 2_000_000) -> DataFrame:
    """Of each component one row of ``documents``, with all its columns: the one with the smallest id, then the least digest.

    Rows without an id come last. The decision is taken on narrow rows (fingerprint, id and a 128-bit digest of the whole
    row), so that texts are read again but not shuffled while the digests of the rows to drop are few enough to be broadcast
    (``most_broadcast``, checked by counting them); if there are more, they are joined by a shuffle. Rows that repeat a kept
    row in all columns are reduced to one among themselves.
    """
    columns = [F.col(f"`{c}`") for c in documents.columns]
    simple = [c.cast("string") for c in columns]
    there = F.concat(*[F.when(c.isNull(), "0").otherwise("1") for c in columns])
    h1, h2 = (F.xxhash64(F.lit(seed), there, *simple) for seed in (1, 2))
    marked = documents.withColumns({"__h1": h1, "__h2": h2})
    rows = frozen_texts(fingerprints(marked, id_col, text_col, width, ("__h1", "__h2")))
    roots = component_roots(rows.select("fp"), radius)
    rank = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "__h1", "__h2")
    each = rows.groupBy("fp").agg(F.min(rank).alias("first")).join(roots.select("fp", "root"), "fp").groupBy("root").agg(F.min("first").alias("first"))
    kept = frozen(each.select("first.__h1", "first.__h2"))
    counted = rows.groupBy("__h1", "__h2").agg(F.count("*").alias("n"))
    judged = frozen(counted.join(kept.withColumn("kept", F.lit(True)), ["__h1", "__h2"], "left"))
    dropped = judged.where("kept IS NULL OR n > 1").select("__h1", "__h2", F.col("kept").isNotNull().alias("twice"))
    few = dropped.count() <= most_broadcast
    dropped = F.broadcast(dropped) if few else dropped
    looked = marked.join(dropped, ["__h1", "__h2"], "left")
    once = looked.where("twice IS NULL").select(*columns)
    repeated = looked.where("twice").dropDuplicates(["__h1", "__h2"]).select(*columns)
    return once.union(repeated)


def op4_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """SimHash near-duplicates of all ``documents``."""
    from .common import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

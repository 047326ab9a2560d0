"""Best-fit packing of encoded documents into sequences of bounded length.

Bounded-space online best-fit: each partition keeps at most ``open_bins`` open bins in a bit set keyed by free space, puts
a piece into the bin it fits most tightly, and closes the fullest bin when a new one is needed. The bins still open at
the end of the partitions are packed again as items, groups of partitions at a time, until one group is left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import arrow_map, default_vocabulary, frozen, frozen_texts, id_and_text, table, utf8
from .encoding import blocks, encoder

#: More rows than elsewhere, so that few blocks of texts are cut short by the end of a batch: each block costs time of its own.
BATCH_ROWS = 2000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class BestFit:
    """Online best-fit over a bounded number of open bins."""

    def __init__(self, capacity: int, open_bins: int):
        self._capacity, self._most = capacity, open_bins
        self._free = 0  # bit f is set if an open bin has f free
        self._bins: dict[int, list] = {}
        self._open = 0

    def place(self, length: int, new_bin: int) -> tuple[int, int]:
        """The bin for an item and its place there; ``new_bin`` names the bin if one must be opened."""
        fitting = self._free >> length
        if fitting:
            free = (fitting & -fitting).bit_length() - 1 + length
            chosen = self._take(free)
        else:
            if self._open == self._most:
                self._take((self._free & -self._free).bit_length() - 1)  # the fullest closes
            chosen, free = new_bin, self._capacity
        if free > length:
            self._bins.setdefault(free - length, []).append(chosen)
            self._free |= 1 << free - length
            self._open += 1
        return chosen, self._capacity - free

    def _take(self, free: int) -> int:
        same = self._bins[free]
        chosen = same.pop()
        if not same:
            del self._bins[free]
            self._free ^= 1 << free
        self._open -= 1
        return chosen

    def still_open(self) -> list[tuple[int, int]]:
        """(bin, used) of the open bins."""
        return [(b, self._capacity - free) for free, same in sorted(self._bins.items()) for b in same]


def placed_pieces(documents: DataFrame, path: str, capacity: int, open_bins: int, end_id: int) -> DataFrame:
    """The pieces of all documents with their bin and place; rows with piece -1 name the bins open at a partition's end."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encode, pack = encoder(path).encode, BestFit(capacity, open_bins)
        end = np.asarray([end_id], "<u4").tobytes()
        partition = TaskContext.get().partitionId()
        fresh = partition << 33
        names = [f.split()[0] for f in PIECES.split(", ")]
        for batch in batches:
            texts, ids = utf8(batch.column("text")), batch.column("doc_id").to_pylist()
            for i, j in blocks(texts):
                rows = []
                for doc, encoded in zip(ids[i:j], encode(texts[i:j]), strict=True):
                    encoded += end
                    for piece, at in enumerate(range(0, len(encoded), 4 * capacity)):
                        part = encoded[at : at + 4 * capacity]
                        bin_id, offset = pack.place(len(part) // 4, fresh)
                        fresh += bin_id == fresh
                        rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part), bin_id, offset))
                yield dict(zip(names, zip(*rows, strict=True), strict=True))
        if left := pack.still_open():
            yield dict(zip(names, zip(*[(None, -1, 0, used, partition, b, 0) for b, used in left], strict=True), strict=True))

    return arrow_map(documents, PIECES, each)


def repacked(left: DataFrame, capacity: int, open_bins: int, fan_in: int) -> DataFrame:
    """(bin, sequence_id, shift) for the bins left open, packed by groups of ``fan_in`` partitions, then of such groups.

    ``left`` has (bin, used, part). An item carries the bins it is made of; it has at most ``capacity`` of them. Within a
    group, of ``fan_in * open_bins`` items at most, all bins stay open; of these the ``open_bins`` emptiest go on to the next.
    """
    kind = "members array<struct<bin:long,shift:long>>, used long, part long, open boolean"
    here = F.array(F.struct("bin", F.lit(0).cast("long").alias("shift")))
    items = left.select(here.alias("members"), F.col("used").cast("long").alias("used"), (F.col("part") / fan_in).cast("long").alias("part"), F.lit(True).alias("open"))

    out = to_arrow_schema(T.StructType.fromDDL(kind))

    def each(group: pa.Table) -> pa.Table:
        pack, made, part = BestFit(capacity, max(1, group.num_rows)), [], group["part"][0].as_py()
        members, used = group["members"].to_pylist(), group["used"].to_pylist()
        for i in sorted(range(len(used)), key=lambda i: (-used[i], members[i][0]["bin"])):
            b, at = pack.place(used[i], len(made))
            if b == len(made):
                made.append([])
            made[b] += [{"bin": m["bin"], "shift": m["shift"] + at} for m in members[i]]
        is_open = dict(sorted(pack.still_open(), key=lambda b: b[1])[:open_bins])
        columns = made, [is_open.get(b, capacity) for b in range(len(made))], [part // fan_in] * len(made), [b in is_open for b in range(len(made))]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    done = None
    parts = items.agg(F.max("part")).first()[0] or 0
    while True:
        packed = frozen(items.groupBy("part").applyInArrow(each, kind))
        closed = packed.where("NOT open") if parts else packed
        done = closed if done is None else done.union(closed)
        if not parts:
            break
        items, parts = packed.where("open"), parts // fan_in
    return done.select(F.explode("members").alias("m"), F.col("members")[0]["bin"].alias("sequence_id")).select(F.col("m.bin").alias("bin"), "sequence_id", F.col("m.shift").alias("shift"))


def best_fit_packing(
    documents: DataFrame, capacity: int = 4096, path: str | None = None, end_id: int = 1, open_bins: int = 64, fan_in: int = 64, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Where each piece of each document lies: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    A document is its token ids and ``end_id``; only longer ones than ``capacity`` are cut. Null and empty texts are a
    piece of one id. Repeated rows are packed as often as they occur.
    """
    pieces = frozen_texts(placed_pieces(id_and_text(documents, id_col, text_col), path or default_vocabulary("word_bpe_49k.json"), capacity, open_bins, end_id), BATCH_ROWS)
    left = pieces.where("piece = -1").select(F.col("sequence_id").alias("bin"), F.col("length").alias("used"), F.col("ids_crc32").alias("part"))
    moved = repacked(left, capacity, open_bins, fan_in)
    rows = pieces.where("piece >= 0").withColumnRenamed("sequence_id", "bin").join(moved, "bin", "left")
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("sequence_id", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of at most 4096 tokens."""
    return best_fit_packing(table(spark, sf_dir, "documents"))

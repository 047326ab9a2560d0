"""FASTA, FASTQ, tables and trees as text."""

from __future__ import annotations

import glob
import itertools
import os
import pickle
import re
import shutil
import tempfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import options as O
from ..functions import sequence as S
from ..operators.order import check_first_last, first_records, last_records
from ..pipeline import command
from ..schema import BASE_33, BASE_64, ORD, DataError, has, present


def write_lines(rows: DataFrame, output: str, force: bool = False, codec: str | None = None, single: bool | None = None) -> None:
    """Write ``value`` (in the order of ``__ord`` if there is one) as lines of one local file, or as a folder of parts.

    The parts are written in parallel and sorted by ranges. For one file (``single``; by default in local sessions only) the
    driver puts them together, which compressed parts allow too; it is an error if it doesn't see what the executors wrote.
    Paths with a scheme, such as a store's, always become folders.
    """
    if ORD in rows.columns:
        rows = rows.orderBy(ORD)
    if single is None:
        single = rows.sparkSession.sparkContext.master.startswith("local")
    single = single and "://" not in output
    folder = f"{output}.parts" if single else output
    writer = rows.select("value").write.mode("overwrite" if force or single else "errorifexists")
    (writer.option("compression", codec) if codec else writer).text(folder)
    if single:
        if not os.path.exists(os.path.join(folder, "_SUCCESS")):
            raise DataError(f"the driver doesn't see {folder}; give single=False, or a path that is shared with the executors")
        with open(output, "wb") as out:
            for part in sorted(glob.glob(os.path.join(folder, "part-*"))):
                with open(part, "rb") as f:
                    shutil.copyfileobj(f, out)
        shutil.rmtree(folder)


def _check_output(o: dict) -> None:
    O.required(o, "output")
    O.not_yet_there(o, "output")
    O.at_most_one(o, "gzip", "bzip2")


def _codec(gzip: bool, bzip2: bool) -> str | None:
    return "gzip" if gzip else "bzip2" if bzip2 else None


def _checked(*names: str) -> Column:
    """Raises where one of the values is empty."""
    empty = F.lit(False)
    for n in names:
        empty = empty | (F.length(n) == 0)
    return F.when(empty, F.raise_error(F.concat(F.lit("empty name or sequence: "), F.col("SEQ_NAME"))).cast("string")).otherwise("")


def _check_fasta(o: dict) -> None:
    _check_output(o)
    O.check(o, "wrap > 0")


@command(check=_check_fasta, output=None, force=False, wrap=None, gzip=False, bzip2=False, single=None)
def write_fasta(df: DataFrame, output: str, force: bool = False, wrap: int | None = None, gzip: bool = False, bzip2: bool = False, single: bool | None = None) -> DataFrame:
    """Records with SEQ_NAME and SEQ as FASTA."""
    if has(df, "SEQ_NAME", "SEQ"):
        rows = df.where(present("SEQ_NAME", "SEQ")).select(*[ORD] * (ORD in df.columns), F.concat(_checked("SEQ_NAME", "SEQ"), S.to_fasta("SEQ_NAME", "SEQ", wrap)).alias("value"))
        write_lines(rows, output, force, _codec(gzip, bzip2), single)
    return df


def _check_fastq(o: dict) -> None:
    _check_output(o)
    O.allowed_values(o, encoding=("base_33", "base_64"))


@command(check=_check_fastq, output=None, force=False, encoding="base_33", gzip=False, bzip2=False, single=None)
def write_fastq(df: DataFrame, output: str, force: bool = False, encoding: str = "base_33", gzip: bool = False, bzip2: bool = False, single: bool | None = None) -> DataFrame:
    """Records with SEQ_NAME, SEQ and SCORES as FASTQ."""
    if has(df, "SEQ_NAME", "SEQ", "SCORES"):
        scores = S.scores_convert("SCORES", BASE_33, BASE_64) if encoding == "base_64" else F.col("SCORES")
        rows = df.where(present("SEQ_NAME", "SEQ", "SCORES")).select(*[ORD] * (ORD in df.columns), F.concat(_checked("SEQ_NAME", "SEQ"), S.to_fastq("SEQ_NAME", "SEQ", scores)).alias("value"))
        write_lines(rows, output, force, _codec(gzip, bzip2), single)
    return df


def _check_table(o: dict) -> None:
    O.at_most_one(o, "keys", "skip")
    O.list_unique(o, "keys", "skip")
    O.conflict(o, pretty="delimiter")
    O.tie(o, commify="pretty", gzip="output", bzip2="output")
    O.at_most_one(o, "gzip", "bzip2")
    O.not_yet_there(o, "output")
    check_first_last(o)


def _headings(df: DataFrame, keys, skip) -> list[str]:
    """The columns to write: those asked for, or all in order, V0, V1 and so on by their numbers."""
    if keys:
        return [k for k in O.listed(keys) if k in df.columns]
    names = [c for c in df.columns if c != ORD and c not in (O.listed(skip) if skip else [])]
    if all(re.fullmatch(r"V\d+", c) for c in names):
        names.sort(key=lambda c: int(c[1:]))
    return names


@command(check=_check_table, keys=None, skip=None, output=None, force=False, header=False, pretty=False, commify=False, delimiter=None, first=None, last=None, gzip=False, bzip2=False, single=None)
def write_table(
    df: DataFrame, keys=None, skip=None, output=None, force=False, header=False, pretty=False, commify=False, delimiter=None, first=None, last=None, gzip=False, bzip2=False, single=None
) -> DataFrame:
    """Values as delimited lines, or as a boxed table for reading (``pretty``, with thousands separators by ``commify``).

    Records without any of the columns aren't written. All others are written to ``output``, or printed without it.
    """
    names = _headings(df, keys, skip)
    if not names:
        return df
    chosen = df
    if first:
        chosen = first_records(df, first) if ORD in df.columns else df.limit(first)
    elif last:
        chosen = last_records(df, last)
    any_value = F.coalesce(*[F.col(f"`{n}`").cast("string") for n in names]).isNotNull()
    rows = chosen.where(any_value)
    if pretty:
        boxed = rows.select(*[ORD] * (ORD in df.columns), *[f"`{n}`" for n in names])
        if output:
            with open(output, "w", encoding="utf-8") as f:
                f.writelines(line + "\n" for line in pretty_table(boxed, names, header, commify))
        else:
            for line in pretty_table(boxed, names, header, commify):
                print(line)
        return df
    joined = F.concat_ws(delimiter or "\t", *[F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("")) for n in names])
    lines = rows.select(*[ORD] * (ORD in df.columns), joined.alias("value"))
    title = "#" + (delimiter or "\t").join(names)
    if not output:
        for line in itertools.chain([title] * header, (r.value for r in (lines.orderBy(ORD) if ORD in lines.columns else lines).toLocalIterator())):
            print(line)
        return df
    if header:
        top = df.sparkSession.createDataFrame([(-1, title)], f"{ORD} long, value string")
        lines = top.unionByName(lines if ORD in lines.columns else lines.withColumn(ORD, F.monotonically_increasing_id()))
    write_lines(lines, output, force, _codec(gzip, bzip2), single)
    return df


def pretty_table(df: DataFrame, names: list[str], header: bool = True, commify: bool = False) -> Iterator[str]:
    """The lines of a boxed table of all records, numbers to the right.

    Records are streamed through a temporary file while the widths are taken, so that the driver holds few at once.
    """
    rows = df.orderBy(ORD) if ORD in df.columns else df
    number = {n: isinstance(df.schema[n].dataType, (T.LongType, T.IntegerType, T.DoubleType, T.FloatType)) for n in names}
    cell = lambda v, n: "" if v is None else f"{v:,}" if commify and number[n] else str(v)
    width = [len(n) if header else 0 for n in names]
    with tempfile.TemporaryFile() as spool:
        count = 0
        for r in rows.toLocalIterator():
            cells = [cell(r[n], n) for n in names]
            width = [max(w, len(c)) for w, c in zip(width, cells, strict=True)]
            pickle.dump(cells, spool)
            count += 1
        spool.seek(0)
        rule = "+" + "+".join("-" * (w + 2) for w in width) + "+"
        line = lambda c: "| " + " | ".join(x.rjust(w) if number[n] else x.ljust(w) for x, w, n in zip(c, width, names, strict=True)) + " |"
        yield from [rule, *([line(names), rule] if header else [])]
        for _ in range(count):
            yield line(pickle.load(spool))
        yield rule


def _check_tree(o: dict) -> None:
    O.not_yet_there(o, "output")
    O.allowed_values(o, type=("dna", "rna", "protein"))


@command(check=_check_tree, output=None, force=False, type="dna", most=1000)
def write_tree(df: DataFrame, output: str | None = None, force: bool = False, type: str = "dna", most: int = 1000) -> DataFrame:
    """Aligned sequences as a Newick tree by neighbour joining of the shares of places that differ.

    A native stand-in for a tree program; it is meant for up to ``most`` sequences, and more are an error.
    """
    if has(df, "SEQ_NAME", "SEQ"):
        rows = df.where(present("SEQ_NAME", "SEQ")).select("SEQ_NAME", "SEQ").limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} sequences")
        tree = newick([r.SEQ_NAME for r in rows], [r.SEQ.upper() for r in rows])
        if output:
            with open(output, "w", encoding="utf-8") as f:
                f.write(tree + "\n")
        else:
            print(tree)
    return df


def newick(names: list[str], seqs: list[str]) -> str:
    """Neighbour joining over the shares of places that differ, leaving out gaps."""
    import numpy as np

    if len(names) < 2:
        return f"({names[0]});" if names else "();"
    codes = np.array([list(s.encode("latin-1", "replace")) for s in seqs])
    solid = ~np.isin(codes, list(b".-_~"))
    n = len(names)
    d = np.zeros((n, n))
    for i in range(n):
        both = solid & solid[i]
        d[i] = ((codes != codes[i]) & both).sum(axis=1) / np.maximum(1, both.sum(axis=1))
    label = list(names)
    while len(label) > 2:
        total, k = d.sum(axis=1), len(label)
        q = (k - 2) * d - total[:, None] - total[None, :]
        np.fill_diagonal(q, np.inf)
        i, j = sorted(divmod(int(q.argmin()), k))
        a = d[i, j] / 2 + (total[i] - total[j]) / (2 * (k - 2))
        joined = f"({label[i]}:{a:.5f},{label[j]}:{d[i, j] - a:.5f})"
        row = (d[i] + d[j] - d[i, j]) / 2
        rest = [x for x in range(k) if x not in (i, j)]
        d = np.block([[d[np.ix_(rest, rest)], row[rest][:, None]], [row[rest][None, :], np.zeros((1, 1))]])
        label = [label[x] for x in rest] + [joined]
    return f"({label[0]}:{d[0, 1]:.5f},{label[1]}:0.00000);"

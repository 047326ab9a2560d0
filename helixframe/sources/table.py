"""Tables of delimited text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import options as O
from ..pipeline import command
from ..schema import ORD, DataError, mixed
from .lines import FILE_SPAN, check_input, in_order, numbered_lines


def _check(o: dict) -> None:
    check_input(o)
    O.at_most_one(o, "select", "reject")
    O.list_unique(o, "keys", "select", "reject")
    O.check(o, "skip >= 0")
    O.allowed_values(o, mode=("strict", "lenient"))


def _chosen(names: list[str], select, reject) -> list[int]:
    """The columns to keep, in the order asked for, by name or number."""

    def index(x) -> int:
        if isinstance(x, int) or (isinstance(x, str) and x.isdigit() and x not in names):
            if not 0 <= int(x) < len(names):
                raise DataError(f"no column {x}")
            return int(x)
        if x not in names:
            raise DataError(f"no column {x}")
        return names.index(x)

    if select is not None:
        return [index(x) for x in O.listed(select)]
    out = {index(x) for x in O.listed(reject)} if reject is not None else set()
    return [i for i in range(len(names)) if i not in out]


@command(source=True, check=_check, input=None, first=None, last=None, select=None, reject=None, keys=None, skip=0, delimiter=None, mode="strict")
def read_table(spark: SparkSession, before: DataFrame | None, input, first=None, last=None, select=None, reject=None, keys=None, skip: int = 0, delimiter: str | None = None, mode: str = "strict") -> DataFrame:
    """Rows of text files; blank lines don't count. Without ``delimiter`` fields are what white space separates.

    A first line with ``#`` names the columns, else they are V0, V1 and so on; further lines with ``#`` are comments.
    ``select`` picks and orders columns, ``reject`` drops some, ``keys`` renames the first ones. The first row of each
    file sets the types; in later rows text in a number's place is an error, or 0 if ``mode`` is lenient.
    """
    frames = []
    for i, path in enumerate(O.expand(input)):
        lines = numbered_lines(spark, [path]).where(F.length(F.trim("value")) > 0)
        head = [r.value for r in lines.orderBy("n").limit(skip + 50).collect()][skip:]
        header = next((line for line in head[:1] if line.startswith("#")), None)
        row = next((line for line in head if not line.startswith("#")), None)
        if row is None:
            row = (lines.where(~F.col("value").startswith("#")).orderBy("n").first() or [None, None, None])[2]
        if row is None:
            continue
        cut = (lambda s: s.split()) if delimiter is None else (lambda s: s.rstrip("\r").split(delimiter))
        fields = cut(row)
        names = cut(header[1:]) if header else [f"V{k}" for k in range(len(fields))]
        if len(names) < len(fields):
            names += [f"V{k}" for k in range(len(names), len(fields))]
        kept = _chosen(names[: len(fields)], select, reject)
        renamed = [names[k] for k in kept]
        if keys:
            renamed[: len(O.listed(keys))] = O.listed(keys)
        rows = lines
        if skip:
            start = lines.orderBy("n").limit(skip + 1).agg(F.max("n")).first()[0]
            rows = lines.where(F.col("n") >= start)
        rows = rows.where(~F.col("value").startswith("#"))
        text = F.trim(F.regexp_replace("value", r"\s+", " ")) if delimiter is None else F.regexp_replace("value", "\r$", "")
        parts = F.split(text, " " if delimiter is None else re.escape(delimiter), -1)
        width = F.when(F.size("parts") != len(fields), F.raise_error(F.concat(F.lit(f"{len(fields)} fields expected: "), F.col("value"))).cast("int")).otherwise(0)
        columns = []
        for k, name in zip(kept, renamed, strict=True):
            kind = {int: "bigint", float: "double", str: "string"}[type(O.to_number(fields[k]))]
            part = F.element_at("parts", F.lit(k + 1) + F.col("width"))
            value = part if kind == "string" else F.coalesce(part.try_cast(kind), F.lit(0).cast(kind)) if mode == "lenient" else part.cast(kind)
            columns.append(value.alias(name))
        if first or last:  # before the fields are parsed, as other rows needn't be sound
            rows = rows.orderBy("n" if first else F.desc("n")).limit(first or last)
        rows = rows.withColumn("parts", parts).withColumn("width", width)
        frames.append(rows.select((F.lit(i).cast("long") * FILE_SPAN + F.col("n")).alias(ORD), *columns))
    if not frames:
        return before if before is not None else spark.createDataFrame([], f"{ORD} long")
    return in_order(mixed(*frames), before, first, last)

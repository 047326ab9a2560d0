"""The numbers behind plots, as DataFrames, and small SVG or text renderings of them."""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import options as O
from ..functions import sequence as S
from ..pipeline import command
from ..schema import ORD, DataError, has
from .aggregate import residue_counts


def histogram(df: DataFrame, key: str, value: str | None = None, widest: int = 10_000_000) -> DataFrame:
    """(key, n): how many records, or the sum of another key, for each value; whole numbers from 0 on without gaps.

    Whole numbers of ``widest`` or more are an error, as there would be a row for every number up to them.
    """
    here = df.where(F.col(f"`{key}`").isNotNull())
    counts = here.groupBy(F.col(f"`{key}`").alias("key")).agg((F.sum(f"`{value}`") if value else F.count("*")).alias("n"))
    if not isinstance(df.schema[key].dataType, (T.IntegerType, T.LongType, T.ShortType)):
        return counts
    top = here.agg(F.max(f"`{key}`")).first()[0]
    if top is None or top < 0:
        return counts
    if top >= widest:
        raise DataError(f"{key} reaches {top}; a histogram without gaps ends before {widest}")
    all_keys = df.sparkSession.range(int(top) + 1).select(F.col("id").alias("key"))
    return all_keys.join(counts.withColumn("key", F.col("key").cast("long")), "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("n"))


def residue_distribution(df: DataFrame) -> DataFrame:
    """(pos, residue, percent, depth): share of each residue at each place, and how many sequences reach it, as a share."""
    counts = residue_counts(df)
    total = counts.groupBy("pos").agg(F.sum("n").alias("total"))
    most = df.where("SEQ IS NOT NULL").count()
    return counts.join(total, "pos").select("pos", "residue", (100 * F.col("n") / F.col("total")).alias("percent"), (100 * F.col("total") / F.lit(max(1, most))).alias("depth"))


def score_profile(df: DataFrame) -> DataFrame:
    """(pos, mean, n, depth): mean score at each place, how many strings reach it, and that scaled to 40."""
    rows = df.where("SCORES IS NOT NULL").select(F.posexplode(S.score_values("SCORES")).alias("pos", "q"))
    means = rows.groupBy("pos").agg(F.avg("q").alias("mean"), F.count("*").alias("n"))
    most = df.where("length(SCORES) > 0").count()
    return means.withColumn("depth", 40 * F.col("n") / F.lit(max(1, most)))


def match_vectors(df: DataFrame, direction: str = "both") -> DataFrame:
    """(x0, y0, x1, y1, dir) of matches: forward ones rise, reverse ones fall."""
    strand = F.col("STRAND") if "STRAND" in df.columns else F.lit(None).cast("string")
    named = F.col("DIRECTION") if "DIRECTION" in df.columns else F.lit(None).cast("string")
    kind = F.when((strand == "+") | (F.lower(named) == "forward"), "forward").when((strand == "-") | (F.lower(named) == "reverse"), "reverse")
    rows = df.where("Q_BEG IS NOT NULL AND S_BEG IS NOT NULL").withColumn("dir", kind).where("dir IS NOT NULL")
    forward = F.col("dir") == "forward"
    out = rows.select(F.col("Q_BEG").alias("x0"), F.when(forward, F.col("S_BEG")).otherwise(F.col("S_END")).alias("y0"), F.col("Q_END").alias("x1"), F.when(forward, F.col("S_END")).otherwise(F.col("S_BEG")).alias("y1"), "dir")
    return out if direction == "both" else out.where(F.col("dir") == direction)


def _check_plot(o: dict) -> None:
    O.not_yet_there(o, "output")
    O.allowed_values(o, terminal=("dumb", "svg"))
    O.at_most_one(o, "keys", "skip")


_PLOT = {"output": None, "force": False, "terminal": "dumb", "title": None, "xlabel": None, "ylabel": None, "most": 100_000}


def _bounded(rows: DataFrame, most: int) -> list:
    """All rows, for the driver to draw; more than ``most`` are an error."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise DataError(f"more than {most} things to draw; raise most, or draw fewer")
    return found


def _draw(rows: list, kind: str, output, terminal: str, title, xlabel, ylabel) -> None:
    """Bars, lines or cells of (x, y, ...) rows as SVG or text."""
    if terminal == "svg" or (output and str(output).endswith(".svg")):
        text = _svg(rows, kind, title, xlabel, ylabel)
    else:
        top = max([abs(r[1]) for r in rows if r[1] is not None] or [1]) or 1
        text = "\n".join([*([title] if title else []), *(f"{r[0]!s:>12} | {'#' * int(50 * (r[1] or 0) / top)} {r[1]}" for r in rows)])
    if output:
        with open(output, "w", encoding="utf-8") as f:
            f.write(text + "\n")
    else:
        print(text)


def _svg(rows: list, kind: str, title, xlabel, ylabel) -> str:
    w, h = 640, 400
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="-60 -40 {w + 80} {h + 90}" font-family="sans-serif" font-size="12">']
    out += [f'<text x="{w / 2}" y="-20" text-anchor="middle">{html.escape(str(title or ""))}</text>', f'<text x="{w / 2}" y="{h + 40}" text-anchor="middle">{html.escape(str(xlabel or ""))}</text>', f'<text x="-50" y="-8">{html.escape(str(ylabel or ""))}</text>']
    out.append(f'<path d="M0 0V{h}H{w}" fill="none" stroke="#555"/>')
    if kind == "segments":
        top = max([v for r in rows for v in r[:4]] or [1]) or 1
        out += [f'<line x1="{w * r[0] / top:.1f}" y1="{h - h * r[1] / top:.1f}" x2="{w * r[2] / top:.1f}" y2="{h - h * r[3] / top:.1f}" stroke="{"#1f6f8b" if r[4] == "forward" else "#b5482a"}"/>' for r in rows]
    else:
        top, step = max([r[1] or 0 for r in rows] or [1]) or 1, w / max(1, len(rows))
        out += [f'<rect x="{i * step:.1f}" y="{h - h * (r[1] or 0) / top:.1f}" width="{max(1, step - 2):.1f}" height="{h * (r[1] or 0) / top:.1f}" fill="#1f6f8b"><title>{html.escape(str(r[0]))}: {r[1]}</title></rect>' for i, r in enumerate(rows)]
    return "\n".join([*out, "</svg>"])


@command(check=lambda o: (_check_plot(o), O.required(o, "key")) and None, key=None, value=None, ylogscale=False, test=False, **_PLOT)
def plot_histogram(df: DataFrame, key: str, value=None, ylogscale=False, test=False, output=None, force=False, terminal="dumb", title=None, xlabel=None, ylabel=None, most=100_000) -> DataFrame:
    """Draws :func:`histogram` and passes the records on."""
    if key in df.columns:
        _draw([(r.key, r.n) for r in _bounded(histogram(df, key, value).orderBy("key"), most)], "bars", output, terminal, title, xlabel or key, ylabel or value or "n")
    return df


@command(check=_check_plot, keys=None, skip=None, logscale=False, **_PLOT)
def plot_heatmap(df: DataFrame, keys=None, skip=None, logscale=False, output=None, force=False, terminal="dumb", title=None, xlabel=None, ylabel=None, most=100_000) -> DataFrame:
    """Draws the numeric columns as a matrix and passes the records on."""
    names = heatmap_columns(df, keys, skip)
    rows = _bounded((df.orderBy(ORD) if ORD in df.columns else df).select(*names).dropna(how="all"), most)
    text = "\n".join([*([title] if title else []), "\t".join(names), *("\t".join("" if v is None else str(v) for v in r) for r in rows)])
    if output:
        with open(output, "w", encoding="utf-8") as f:
            f.write(text + "\n")
    else:
        print(text)
    return df


def heatmap_columns(df: DataFrame, keys=None, skip=None) -> list[str]:
    """The numeric columns asked for, V0, V1 and so on by their numbers."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, (T.NumericType,)) and f.name != ORD]
    names = [k for k in O.listed(keys) if k in numeric] if keys else [n for n in numeric if n not in (O.listed(skip) if skip else [])]
    return sorted(names, key=lambda c: int(c[1:])) if names and not keys and all(re.fullmatch(r"V\d+", c) for c in names) else names


@command(check=lambda o: (_check_plot(o), O.allowed_values(o, direction=("both", "forward", "reverse"))) and None, direction="both", **_PLOT)
def plot_matches(df: DataFrame, direction="both", output=None, force=False, terminal="svg", title=None, xlabel=None, ylabel=None, most=100_000) -> DataFrame:
    """Draws :func:`match_vectors` and passes the records on."""
    if has(df, "Q_BEG", "Q_END", "S_BEG", "S_END"):
        rows = [tuple(r) for r in _bounded(match_vectors(df, direction), most)]
        _draw(rows, "segments", output, "svg", title, xlabel, ylabel)
    return df


@command(check=_check_plot, count=False, **_PLOT)
def plot_residue_distribution(df: DataFrame, count=False, output=None, force=False, terminal="dumb", title=None, xlabel=None, ylabel=None, most=100_000) -> DataFrame:
    """Draws the most frequent residue's share at each place and passes the records on."""
    if "SEQ" in df.columns:
        rows = _bounded(residue_distribution(df).groupBy("pos").agg(F.max(F.struct("percent", "residue")).alias("m"), F.max("depth").alias("depth")).orderBy("pos"), most)
        _draw([(f"{r.pos} {r.m.residue}", r.depth if count else r.m.percent) for r in rows], "bars", output, terminal, title, xlabel, ylabel)
    return df


@command(check=_check_plot, count=False, **_PLOT)
def plot_scores(df: DataFrame, count=False, output=None, force=False, terminal="dumb", title=None, xlabel=None, ylabel=None, most=100_000) -> DataFrame:
    """Draws the mean score at each place and passes the records on."""
    if "SCORES" in df.columns:
        rows = _bounded(score_profile(df).orderBy("pos"), most)
        _draw([(r.pos, r.depth if count else r.mean) for r in rows], "bars", output, terminal, title, xlabel, ylabel)
    return df

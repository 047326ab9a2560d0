"""Counts of each stage, gathered while the pipeline runs and without a job of their own."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def _sum(name: str):
    return lambda df: F.coalesce(F.sum(F.col(f"`{name}`")), F.lit(0)) if name in df.columns else None


def _count(name: str, missing: bool = False):
    return lambda df: F.count(F.when(F.col("SEQ").isNotNull() & (F.col(name).isNull() if missing else F.col(name).isNotNull()), 1)) if {name, "SEQ"} <= set(df.columns) else None


#: What else is counted in the records that leave some operators: name -> aggregate of a DataFrame, or None if it can't be.
EXTRA = {
    "assemble_pairs": {
        "overlap_sum": _sum("OVERLAP_LEN"), "hamming_sum": _sum("HAMMING_DIST"),
        "assembled": lambda df: F.count(F.when(F.col("OVERLAP_LEN") > 0, 1)) if "OVERLAP_LEN" in df.columns else None,
        "unassembled": lambda df: F.count(F.when(F.col("SEQ").isNotNull() & (F.coalesce("OVERLAP_LEN", F.lit(0)) == 0), 1)) if "OVERLAP_LEN" in df.columns else None,
    },
    "clip_primer": {"pattern_hits": _count("CLIP_PRIMER_POS"), "pattern_misses": _count("CLIP_PRIMER_POS", True)},
    "trim_primer": {"pattern_hits": _count("TRIM_PRIMER_POS"), "pattern_misses": _count("TRIM_PRIMER_POS", True)},
    "mask_seq": {"masked": lambda df: F.coalesce(F.sum(F.regexp_count("SEQ", F.lit("[a-z]"))), F.lit(0)) if "SEQ" in df.columns else None},
    "mean_scores": {
        "min_mean": lambda df: F.min("SCORES_MEAN") if "SCORES_MEAN" in df.columns else None, "max_mean": lambda df: F.max("SCORES_MEAN") if "SCORES_MEAN" in df.columns else None,
        "mean_mean": lambda df: F.avg("SCORES_MEAN") if "SCORES_MEAN" in df.columns else None,
    },
    "collect_otus": {"otus": lambda df: F.count(F.when(F.col("RECORD_TYPE") == "OTU", 1)) if "RECORD_TYPE" in df.columns else None},
    "usearch_global": {"hits": lambda df: F.count(F.when(F.col("RECORD_TYPE") == "usearch", 1)) if "RECORD_TYPE" in df.columns else None},
    "usearch_local": {"hits": lambda df: F.count(F.when(F.col("RECORD_TYPE") == "usearch", 1)) if "RECORD_TYPE" in df.columns else None},
    "uclust": {"clusters": lambda df: F.max("CLUSTER") + 1 if "CLUSTER" in df.columns else None},
    "classify_seq": {"classified": lambda df: F.count(F.when(F.col("TAXONOMY") != "Unclassified", 1)) if "TAXONOMY" in df.columns else None},
}


class StageMetrics:
    """Records, sequences and residues that leave a stage, and how they differ from what the stage before let out."""

    def __init__(self, name: str, text: str, before: StageMetrics | None):
        self.name, self.text, self.before = name, text, before
        self._seen: Observation | None = None

    def observe(self, df: DataFrame) -> DataFrame:
        """``df``, counted when an action runs on it."""
        self._seen = Observation(f"{self.name}-{id(self)}")
        counts = [F.count(F.lit(1)).alias("records")]
        if "SEQ" in df.columns:
            counts += [F.count("SEQ").alias("sequences"), F.coalesce(F.sum(F.length("SEQ")), F.lit(0)).alias("residues")]
        extra = {name: make(df) for name, make in EXTRA.get(self.name.partition(":")[2], {}).items()}
        counts += [c.alias(name) for name, c in extra.items() if c is not None]
        return df.observe(self._seen, *counts)

    def counts(self) -> dict:
        """The counts; waits for an action."""
        return dict(self._seen.get)

    def status(self) -> dict:
        """Counts out, and with a stage before: counts in, deltas and their percentages."""
        out = self.counts()
        found = {"stage": self.text, **{f"{k}_out" if k in ("records", "sequences", "residues") else k: v for k, v in out.items()}}
        if self.before:
            came_in = self.before.counts()
            for k in [k for k in ("records", "sequences", "residues") if k in came_in]:
                came, went = came_in[k], out.get(k, 0)
                found |= {f"{k}_in": came, f"{k}_delta": went - came, f"{k}_delta_percent": round(100 * (went - came) / max(went, came, 1), 2)}
        return found


def report(stages: list[StageMetrics], path: str | None = None, kind: str = "json") -> str:
    """The status of all stages as JSON or as an HTML page, written to ``path`` if there is one."""
    rows = [m.status() for m in stages]
    if kind == "json":
        text = json.dumps(rows, indent=1)
    else:
        cells = "".join(f"<tr><th colspan=2>{html.escape(r.pop('stage'))}</th></tr>" + "".join(f"<tr><td>{k}</td><td>{v}</td></tr>" for k, v in r.items()) for r in rows)
        text = f"<!doctype html><meta charset=utf-8><title>Pipeline</title><table>{cells}</table>"
    if path:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    return text

"""Pipelines on streaming DataFrames.

Only operators that look at each record on its own are allowed: they need no state, watermark or output mode, and a
streaming DataFrame goes through them as a batch one does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..options import OptionError
from ..pipeline import Pipeline

STATELESS = frozenset(
    "reverse_seq complement_seq slice_seq degap_seq mask_seq trim_seq mean_scores clip_primer trim_primer merge_values split_pair_seq filter_taxonomy grab add_key".split()
)


def run_stream(pipeline: Pipeline, records: DataFrame) -> DataFrame:
    """The streaming DataFrame after all stages; an operator that needs other records than the one at hand is an error."""
    for stage in pipeline.stages:
        needs_more = stage.command.name not in STATELESS or stage.options.get("columns_only") or stage.options.get("prefix") is not None
        if needs_more or (stage.options.get("exact") and (stage.options.get("select_file") or stage.options.get("reject_file"))):
            raise OptionError(f"{stage.command.name} can't work on a stream")
    return pipeline.run(records)

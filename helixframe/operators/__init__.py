"""Operators on records. Importing this registers them as methods of pipelines."""

from . import aggregate, cluster, external, filters, join, order, pairs, plots, project, taxonomy  # noqa: F401

"""Readers. Importing this registers them as methods of pipelines."""

from . import fasta, fastq, records, table, uc  # noqa: F401

"""Pipelines: immutable chains of checked operators over a DataFrame of records."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from . import options as O
from .metrics import StageMetrics

CONFIGURATION = os.path.join(os.path.expanduser("~"), ".helixframerc")


@dataclass(frozen=True)
class Command:
    """An operator: how it works, its defaults, and the check of its options."""

    name: str
    work: Callable[..., DataFrame]
    defaults: Mapping[str, Any]
    check: Callable[[dict], None] | None = None
    source: bool = False


_COMMANDS: dict[str, Command] = {}


def command(name: str | None = None, *, source: bool = False, check: Callable[[dict], None] | None = None, **defaults: Any) -> Callable:
    """Register a function of (records, **options) as an operator; ``defaults`` lists all options that it takes.

    A source is called with (spark, records or None, **options) and appends what it reads to the records.
    """

    def add(work: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        key = name or work.__name__
        _COMMANDS[key] = Command(key, work, defaults, check, source)
        return work

    return add


def commands() -> list[str]:
    """Names of all operators."""
    _load()
    return sorted(_COMMANDS)


def _load() -> None:
    from . import operators, sinks, sources  # noqa: F401


@dataclass(frozen=True)
class Stage:
    """A command with its options."""

    command: Command
    options: Mapping[str, Any]

    def __str__(self) -> str:
        return f"{self.command.name}({', '.join(f'{k}={v!r}' for k, v in self.options.items())})"


class Pipeline:
    """``Pipeline().read_fasta(input=f).grab(select="ATC$", keys="SEQ").run(spark=spark)``.

    Every operator is a method; options are checked when it is called. A pipeline isn't changed by that: each call
    returns a longer one. ``a + b`` and ``a | b`` chain pipelines. Nothing is computed before an action on what ``run``
    returns, sinks apart.
    """

    def __init__(self, stages: tuple[Stage, ...] = (), configuration: str = CONFIGURATION):
        self.stages, self._configuration, self.metrics = stages, configuration, []

    @staticmethod
    def register(name: str, work: Callable[..., DataFrame], check: Callable[[dict], None] | None = None, **defaults: Any) -> None:
        """Make a function of (records, **options) an operator."""
        command(name, check=check, **defaults)(work)

    def add(self, name: str, **options: Any) -> Pipeline:
        """One more operator; wrong options raise here."""
        _load()
        if name not in _COMMANDS:
            raise AttributeError(f"no such operator: {name}")
        c = _COMMANDS[name]
        O.allowed(options, *c.defaults)
        options = O.layered(options, c.defaults, {k: v for k, v in O.read_configuration(self._configuration, name).items() if k in c.defaults})
        if c.check:
            c.check(options)
        return Pipeline((*self.stages, Stage(c, options)), self._configuration)

    def __getattr__(self, name: str) -> Callable[..., Pipeline]:
        if name.startswith("_"):
            raise AttributeError(name)
        _load()
        if name not in _COMMANDS:
            raise AttributeError(f"no such operator: {name}")
        return lambda **options: self.add(name, **options)

    def __add__(self, other: Pipeline) -> Pipeline:
        return Pipeline(self.stages + other.stages, self._configuration)

    __or__ = __add__

    def __len__(self) -> int:
        return len(self.stages)

    def pop(self) -> tuple[Pipeline, Stage]:
        """The pipeline without its last stage, and that stage."""
        if not self.stages:
            raise IndexError("the pipeline is empty")
        return Pipeline(self.stages[:-1], self._configuration), self.stages[-1]

    def describe(self) -> str:
        """The pipeline as text."""
        return ".".join(["Pipeline()", *map(str, self.stages)])

    __str__ = describe

    def run(self, records: DataFrame | None = None, spark: SparkSession | None = None, status: bool = False) -> DataFrame:
        """The records after all stages; ``records`` go into the first one.

        With ``status``, each stage counts records, sequences and residues while an action runs; ``metrics`` has them.
        """
        spark = spark or (records.sparkSession if records is not None else SparkSession.getActiveSession())
        if not self.stages:
            raise O.OptionError("the pipeline is empty")
        self.metrics = []
        for k, stage in enumerate(self.stages):
            if records is None and not stage.command.source:
                raise O.OptionError(f"{stage.command.name} needs records: begin with a reader or give records")
            before = self.metrics[-1] if self.metrics else None
            records = stage.command.work(spark, records, **stage.options) if stage.command.source else stage.command.work(records, **stage.options)
            if status:
                m = StageMetrics(f"{k}:{stage.command.name}", str(stage), before)
                records = m.observe(records)
                self.metrics.append(m)
        return records

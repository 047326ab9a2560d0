"""Checks of operator options, made when a pipeline is written down and not when it runs."""

from __future__ import annotations

import glob
import operator
import os
import re
from collections.abc import Iterable, Mapping
from typing import Any

_COMPARE = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "==": operator.eq, "!=": operator.ne}


class OptionError(ValueError):
    """An option that an operator doesn't take, lacks, or can't work with."""


def _given(options: Mapping, names: Iterable[str]) -> list[str]:
    return [n for n in names if options.get(n) not in (None, False)]


def allowed(options: Mapping, *names: str) -> None:
    """No other options than these."""
    if unknown := sorted(set(options) - set(names)):
        raise OptionError(f"unknown option: {', '.join(unknown)}; allowed: {', '.join(names)}")


def allowed_values(options: Mapping, **values: Iterable) -> None:
    """An option that is given must have one of its values."""
    for name, choice in values.items():
        if name in _given(options, [name]) and options[name] not in list(choice):
            raise OptionError(f"{name} must be one of {', '.join(map(str, choice))}, not {options[name]}")


def required(options: Mapping, *names: str) -> None:
    """All of these."""
    if missing := [n for n in names if options.get(n) is None]:
        raise OptionError(f"missing option: {', '.join(missing)}")


def at_most_one(options: Mapping, *names: str) -> None:
    """None or one of these."""
    if len(both := _given(options, names)) > 1:
        raise OptionError(f"only one of these can be given: {', '.join(both)}")


def one_of(options: Mapping, *names: str) -> None:
    """Exactly one of these."""
    at_most_one(options, *names)
    if not _given(options, names):
        raise OptionError(f"one of these must be given: {', '.join(names)}")


def list_unique(options: Mapping, *names: str) -> None:
    """No value twice in a list."""
    for name in _given(options, names):
        values = listed(options[name])
        if len(set(values)) != len(values):
            raise OptionError(f"{name} has a value twice: {values}")


def tie(options: Mapping, **needs: str) -> None:
    """An option that needs another one."""
    for name, other in needs.items():
        if _given(options, [name]) and not _given(options, [other]):
            raise OptionError(f"{name} needs {other}")


def conflict(options: Mapping, **excludes: str) -> None:
    """An option that excludes another one."""
    for name, other in excludes.items():
        if len(_given(options, [name, other])) == 2:
            raise OptionError(f"{name} excludes {other}")


def check(options: Mapping, *expressions: str) -> None:
    """Comparisons such as ``"size > 0"``; skipped where the option isn't given."""
    for expression in expressions:
        name, compare, value = expression.split()
        if options.get(name) is not None and not _COMPARE[compare](options[name], float(value)):
            raise OptionError(f"{name} must be {compare} {value}, not {options[name]}")


def files_exist(options: Mapping, *names: str) -> None:
    """Input files, or at least one file for a pattern."""
    for name in _given(options, names):
        for pattern in listed(options[name]):
            if "://" not in pattern and not any(os.path.isfile(f) for f in expand([pattern])) and not os.path.isdir(pattern):
                raise OptionError(f"no such file: {pattern}")


def dirs_exist(options: Mapping, *names: str) -> None:
    """Input folders."""
    for name in _given(options, names):
        if "://" not in options[name] and not os.path.isdir(options[name]):
            raise OptionError(f"no such folder: {options[name]}")


def not_yet_there(options: Mapping, *names: str) -> None:
    """Output paths, unless ``force`` is given."""
    for name in _given(options, names):
        if "://" not in options[name] and os.path.exists(options[name]) and not options.get("force"):
            raise OptionError(f"{options[name]} exists; force overwrites it")


def listed(value: Any) -> list:
    """A list, a single value, or a comma-separated string as a list."""
    if isinstance(value, str):
        return [v.strip() for v in value.split(",")]
    return list(value) if isinstance(value, (list, tuple, set)) else [value]


def expand(patterns: str | Iterable[str]) -> list[str]:
    """Files of comma-separated or listed patterns, those of each pattern sorted; paths of other stores stay as they are."""
    out = []
    for pattern in listed(patterns):
        out += [pattern] if "://" in pattern or not re.search(r"[*?\[]", pattern) else sorted(f for f in glob.glob(pattern) if os.path.isfile(f))
    return out


def layered(options: Mapping, defaults: Mapping, configured: Mapping | None = None) -> dict:
    """Options as given, then as configured, then by default."""
    return {**defaults, **(configured or {}), **{k: v for k, v in options.items() if v is not None}}


def read_configuration(path: str, command: str) -> dict:
    """Defaults for a command from lines of ``command option value``; a missing file has none."""
    out: dict[str, Any] = {}
    if os.path.isfile(path):
        with open(path, encoding="utf-8") as f:
            for line in f:
                parts = line.split(None, 2)
                if len(parts) == 3 and parts[0] == command:
                    out[parts[1]] = to_number(parts[2].strip())
    return out


def to_number(text: str) -> int | float | str:
    """An int, else a float, else the text itself."""
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text

"""Readable job names."""

from __future__ import annotations

import re
from collections.abc import Sequence

#: Most characters that a name's sources, and a whole name, may take.
SOURCES_LENGTH, NAME_LENGTH = 75, 175
#: What planners append to make a sink unique.
_SUFFIX = re.compile(r"_\d+_[0-9a-fA-F]{32}$")


def shortened(text: str, most: int) -> str:
    return text if len(text) <= most else text[: most - 3] + "..."


def leaf(path: str) -> str:
    """The last part of a path without a unique suffix; a number gets its parent put before it."""
    parts = [p for p in _SUFFIX.sub("", path.rstrip("/")).split("/") if p]
    if not parts:
        return path
    return "/".join(parts[-2:]) if len(parts) > 1 and parts[-1].isdigit() else parts[-1]


def job_name(flow: str, step: int, steps: int, sources: Sequence[str], sinks: Sequence[str]) -> str:
    """``flow [(i/n) sources] -> sinks``."""
    inputs = shortened(", ".join(leaf(s) for s in sources), SOURCES_LENGTH)
    return shortened(f"{flow} [({step}/{steps}) {inputs}] -> {', '.join(leaf(s) for s in sinks)}", NAME_LENGTH)


def checked_name(name: str) -> str:
    """A name that may become part of a checkpoint's path."""
    if not re.fullmatch(r"[a-zA-Z0-9\-_]+", name):
        raise ValueError(f"{name!r} has characters other than letters, digits, - and _")
    return name

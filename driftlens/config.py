"""Options of a comparison and the numbers that are part of its meaning."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

# Fixed values.
THRESHOLD = 0.5
SIGNIFICANCE = 10.83
SMOOTHING = 0.5
TRACKED_VALUES, MIN_REPEATS = 10, 5.0
TRACKED_SOURCES, MIN_EXPECTED = 64, 8.0
BLOCK_GAP, GONE_GAP, MIN_TEMPLATES = 2, 16, 2
WATCHES, GROUP_KEYS, POOLED_VALUES, GROUPED_VALUES = 16, 4, 64, 256
GROUP_BYTES, POINTER_BYTES, VALUE_BYTES, RECORD_BYTES, EXCERPT_BYTES, CONTEXT_BYTES, CONTEXT_LINES = 4096, 1024, 4096, 1 << 20, 4096, 8192, 10


@dataclass(frozen=True)
class CustomMask:
    """A pattern of the user's and what stands in its place."""

    pattern: str
    placeholder: str = "<CUSTOM>"

    @classmethod
    def inline(cls, pattern: str) -> "CustomMask":
        re.compile(pattern)
        return cls(pattern)

    @classmethod
    def from_line(cls, line: str) -> "CustomMask":
        """``NAME=REGEX``, or a bare pattern."""
        name, eq, rest = line.partition("=")
        if eq and name and re.fullmatch(r"[A-Za-z0-9_]+", name):
            re.compile(rest)
            return cls(rest, f"<{name.upper()}>")
        return cls.inline(line)

    @classmethod
    def load(cls, lines) -> list["CustomMask"]:
        """A mask file: blank lines and those that begin with ``#`` don't count."""
        return [cls.from_line(x.strip()) for x in lines if x.strip() and not x.strip().startswith("#")]


@dataclass(frozen=True)
class DiffOptions:
    threshold: float = THRESHOLD
    significance: float = SIGNIFICANCE
    group: bool = True
    context: int = 0
    watch_fields: tuple[str, ...] = ()
    watch_by: tuple[str, ...] = ()
    watch_rate_change: float | None = None
    masks: tuple[CustomMask, ...] = field(default_factory=tuple)

    def __post_init__(self):
        check_threshold(self.threshold)
        if not (math.isfinite(self.significance) and self.significance >= 0):
            raise ValueError("significance must be a finite number of 0 or more")
        if self.context < 0:
            raise ValueError("context must be a number of lines of 0 or more")
        pointers(self.watch_fields, WATCHES)
        pointers(self.watch_by, GROUP_KEYS)
        if self.watch_by and not self.watch_fields:
            raise ValueError("grouping a watch takes a watched field")
        if self.watch_rate_change is not None:
            if not self.watch_fields:
                raise ValueError("a rate change takes a watched field")
            if not (math.isfinite(self.watch_rate_change) and 0 < self.watch_rate_change <= 100):
                raise ValueError("a rate change must be over 0 and at most 100 percentage points")
            if self.significance == 0:
                raise ValueError("a rate change takes a significance over 0")


def check_threshold(threshold: float) -> None:
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be over 0 and at most 1")


def pointers(given: tuple[str, ...], limit: int) -> list[list[str]]:
    """JSON pointers as their decoded steps."""
    if len(given) > limit:
        raise ValueError(f"at most {limit} pointers")
    if len(set(given)) != len(given):
        raise ValueError("the same pointer twice")
    out = []
    for p in given:
        if not p.startswith("/") or len(p.encode()) > POINTER_BYTES or re.search(r"~(?![01])", p):
            raise ValueError(f"not a JSON pointer: {p!r}")
        out.append([s.replace("~1", "/").replace("~0", "~") for s in p[1:].split("/")])
    return out


def check_stdin(paths) -> None:
    """Standard input can be read once."""
    if sum(p == "-" for p in paths) > 1:
        raise ValueError("standard input can be given once")

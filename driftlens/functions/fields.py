"""Exact JSON scalars of a record, as they are written; runs inside tasks."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftlens.config import CONTEXT_BYTES, CONTEXT_LINES, EXCERPT_BYTES, RECORD_BYTES
from driftlens.functions.text import Ambiguous, docker, envelope


class _Raw(str):
    """A scalar's own spelling."""


class _Object(list):
    """Members in order, duplicates kept."""


def _refuse(text):
    raise ValueError(text)


def _load(text: str):
    value = json.loads(text, object_pairs_hook=_Object, parse_int=_Raw, parse_float=_Raw, parse_constant=_refuse)
    return value


def payload(raw: str) -> tuple[str, object]:
    """("ok", the JSON object) or (why not, None)."""
    if len(raw.encode("utf-8", "surrogatepass")) > RECORD_BYTES:
        return "oversized", None
    text = envelope(raw)[1]
    if not text.lstrip().startswith("{"):
        return "non_json", None
    try:
        value = _load(text)
    except (ValueError, RecursionError):
        return "invalid_json", None
    names = [k for k, _ in value]
    if set(names) <= {"log", "stream", "time", "attrs"} and {"log", "stream"} <= set(names) and len(set(names)) < len(names):
        return "ambiguous", None
    try:
        wrapped = docker(text)
    except Ambiguous:
        return "ambiguous", None
    except ValueError:
        wrapped = None
    if wrapped:
        inner = envelope(wrapped[1])[1]
        if not inner.lstrip().startswith("{"):
            return "non_json", None
        try:
            value = _load(inner)
        except (ValueError, RecursionError):
            return "invalid_json", None
    return "ok", value


def select(value, steps: list[str]) -> tuple[str, str | None]:
    """("ok", the scalar's JSON) at a pointer, or (missing, ambiguous, non_scalar, invalid_json; None)."""
    for step in steps:
        if isinstance(value, _Object):
            found = [v for k, v in value if k == step]
            if len(found) > 1:
                return "ambiguous", None
            if not found:
                return "missing", None
            value = found[0]
        elif isinstance(value, list):
            if not (step.isascii() and step.isdigit()) or (len(step) > 1 and step[0] == "0") or int(step) >= len(value):
                return "missing", None
            value = value[int(step)]
        else:
            return "missing", None
    if isinstance(value, list):
        return "non_scalar", None
    if isinstance(value, _Raw):
        return "ok", str(value)
    if isinstance(value, str):
        text = json.dumps(value, ensure_ascii=False)
        try:
            text.encode()
        except UnicodeEncodeError:
            return "invalid_json", None
        return "ok", text
    return "ok", {True: "true", False: "false", None: "null"}[value]


# A line of this grammar is JSON whatever else it says; strings have no escapes, numbers are short.
_STRING = r'"[^"\\\x00-\x1f]*+"'
_SCALAR = rf"(?:{_STRING}|-?(?:0|[1-9][0-9]{{0,14}}+)(?![0-9])(?:\.[0-9]{{1,14}}+(?![0-9]))?+|true|false|null)"
_WS = "[ ]*+"
_FLAT = rf"(?:\{{{_WS}(?:{_STRING}{_WS}:{_WS}{_SCALAR}{_WS}(?:,{_WS}(?=\")|(?=\}})))*+\}}|\[{_WS}(?:{_SCALAR}{_WS}(?:,{_WS}(?=[^\]])|(?=\])))*+\])"
_VALUE = rf"(?:{_SCALAR}|{_FLAT})"
#: Characters of a line that the pattern is tried on; Java's patterns go deeper with every member.
SIMPLE_CHARS = 4000


def _members(name: str, value: str, other: str) -> str:
    """An object's members, one of which has this name, once, and the value that is caught."""
    quoted = re.escape(name)
    more = rf"(?!\"{quoted}\"){_STRING}{_WS}:{_WS}{other}{_WS}"
    return rf"\{{{_WS}(?:{more},{_WS})*+\"{quoted}\"{_WS}:{_WS}{value}{_WS}(?:,{_WS}{more})*+\}}"


def simple(steps: list[str]) -> str | None:
    """A pattern of whole lines that catches the scalar at a pointer of one or two steps, as it is written; None for others.

    It matches only lines that are JSON objects in which every name on the way comes once,
    so what it catches is what ``payload`` and ``select`` give.
    """
    if not 1 <= len(steps) <= 2 or any(re.search(r'["\\\x00-\x1f]', s) for s in steps):
        return None
    value = f"({_SCALAR})"
    if len(steps) == 2:
        value = _members(steps[1], value, _SCALAR)
    return rf"\A{_members(steps[0], value, _VALUE)}{_WS}\z"


def excerpt(raw: str, limit: int = EXCERPT_BYTES) -> tuple[str, bool]:
    """The first ``limit`` bytes up to a whole character, and whether more was there."""
    b = raw.encode("utf-8", "surrogatepass")
    return (raw, False) if len(b) <= limit else (b[:limit].decode("utf-8", "ignore"), True)


def clipped(raw: Column, limit: int = EXCERPT_BYTES) -> tuple[Column, Column]:
    """``excerpt`` as Columns: a character's bytes after its first are 80 to BF, so at most three bytes less are taken."""
    data = raw.cast("binary")
    within = lambda at: F.hex(F.substr(data, F.lit(at + 1), F.lit(1))).between("80", "BF")
    end = F.when(~within(limit), limit).when(~within(limit - 1), limit - 1).when(~within(limit - 2), limit - 2).otherwise(limit - 3)
    over = F.octet_length(raw) > limit
    return F.when(over, F.substr(data, F.lit(1), end).cast("string")).otherwise(raw), over


def bounded_window(before: list[tuple[int, str]], after: list[tuple[int, str]]) -> tuple[list, list, bool]:
    """The lines of a window that are shown with a watched value, and whether some were left out or clipped.

    The nearest lines come first, a line before and one after in turn, ``CONTEXT_LINES`` a side,
    ``EXCERPT_BYTES`` of a line and ``CONTEXT_BYTES`` in all.
    """
    sides = (before[::-1], after)
    out: tuple[list, list] = ([], [])
    cut, room = any(len(x) > CONTEXT_LINES for x in sides), CONTEXT_BYTES
    for k in range(CONTEXT_LINES):
        for side, kept in zip(sides, out, strict=True):
            if k < len(side):
                number, raw = side[k]
                text, more = excerpt(raw, min(EXCERPT_BYTES, room))
                cut |= more
                if text or not raw:
                    kept.append((number, text))
                    room -= len(text.encode("utf-8", "surrogatepass"))
    return out[0][::-1], out[1], cut

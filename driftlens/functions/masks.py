"""The maskers and envelopes as Column functions: built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftlens.functions import patterns as P

_UNICODE = "(?U)"


def _sub(c: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(c, F.lit(_UNICODE + pattern), F.lit(to.replace("\\", "\\\\").replace("$", "\\$")))


def strip_escapes(c: Column) -> Column:
    return F.regexp_replace(c, F.lit(P.ESCAPES.replace("[@-~]", "[@-~]")), F.lit(""))


def masker(name: str):
    """The masker of this name as a function of a column."""
    pattern, to = next((p, to) for n, p, to in P.SIMPLE if n == name)
    return lambda c: _sub(c, pattern, to)


MASKERS = {name: masker(name) for name, _, _ in P.SIMPLE}


def _segment(s: Column) -> Column:
    return (
        F.when(s.rlike(_UNICODE + P.UUID), "<UUID>").when(s.rlike(_UNICODE + P.ISO) | s.rlike(_UNICODE + P.EPOCH), "<TS>")
        .when(s.rlike(r"\A(?:[0-9]+|(?=[0-9]*[a-fA-F])[0-9a-fA-F]{6,})\z"), "<ID>").otherwise(s)
    )


def mask_url(url: Column) -> Column:
    """One URL with its credentials, query and path ids masked."""
    rest = F.regexp_extract(url, r"(?s)\A.*?://(.*)\z", 1)
    before = F.substring_index(rest, "?", 1)
    host = F.substring_index(before, "/", 1)
    path = F.regexp_extract(before, r"(?s)\A[^/]*(/.*)?\z", 1)
    return F.concat(
        F.substring_index(url, "://", 1), F.lit("://"),
        F.when(host.contains("@"), F.concat(F.lit("<CRED>@"), F.substring_index(host, "@", -1))).otherwise(host),
        F.array_join(F.transform(F.split(path, "/"), _segment), "/"),
        F.when(rest.rlike(r"(?s)\A[^?]*\?."), "?<QUERY>").otherwise(""),
    )


def mask_urls(c: Column) -> Column:
    """Every URL of a text masked inside."""
    marked = F.regexp_replace(c, F.lit(_UNICODE + "(" + P.URL + ")"), F.lit("\u0001\u0002$1\u0001"))
    parts = F.split(marked, "\u0001")
    return F.when(
        c.contains("://"),
        F.array_join(F.transform(parts, lambda p: F.when(p.startswith("\u0002"), mask_url(F.substr(p, F.lit(2)))).otherwise(p)), ""),
    ).otherwise(c)


def mask_progress(c: Column) -> Column:
    """Test runners' lines of dots and the counters after them; white space stays as it is."""
    words = F.split(c, r"(?U)(?<=\S)(?=\s)|(?<=\s)(?=\S)")

    def is_run(w):
        dots = F.length(w) - F.length(F.replace(w, F.lit("."), F.lit("")))
        return w.rlike(r"\A[.FEsSxX*URIfe]{4,}\z") & (dots >= 3) & (2 * dots >= F.length(w))

    def marked(words, first):
        return F.transform(
            words,
            lambda w, i: F.when(is_run(w), F.when(w.rlike("[FE]"), "<PROGRESS!>").otherwise("<PROGRESS>"))
            .when((i >= first) & w.rlike(r"\A(?=.*[0-9])[0-9%/\[\]()]+\z"), F.regexp_replace(w, "[0-9]+", "<NUM>")).otherwise(w),
        )

    # bound once a line: within a lambda they would be found again for every word
    masked = _bound(words, lambda ws: _bound(F.array_position(F.transform(ws, is_run), True), lambda first: F.when(first > 0, F.array_join(marked(ws, first), ""))))
    return F.when((F.length(c) - F.length(F.replace(c, F.lit("."), F.lit("")))) < 3, c).otherwise(F.coalesce(masked, c))


def _bound(value: Column, f) -> Column:
    """``f`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def mask_body(c: Column) -> Column:
    """All maskers in their order."""
    c = mask_progress(mask_urls(c))
    for name, pattern, to in P.SIMPLE:
        c = _sub(c, pattern, to)
    return c


def mask_line(c: Column, masks=()) -> Column:
    c = strip_escapes(c)
    for m in masks:
        c = F.regexp_replace(c, F.lit(m.pattern), F.lit(m.placeholder.replace("\\", "\\\\").replace("$", "\\$")))
    return mask_body(c)


def cri(c: Column) -> Column:
    """STRUCT<stream, payload> of a CRI line, else null."""
    p = "(?Ud)" + P.CRI.replace(r"\Z", r"\z")
    return F.when(c.rlike(p), F.struct(F.regexp_extract(c, p, 1).alias("stream"), F.regexp_extract(c, p, 2).alias("payload")))


def journald(c: Column) -> Column:
    """STRUCT<process, payload> of a journald line, else null."""
    p = "(?Ud)" + P.JOURNALD.replace(r"\Z", r"\z")
    return F.when(c.rlike(p), F.struct(F.regexp_replace(F.regexp_extract(c, p, 1), r"\[\d+\]", "[<NUM>]").alias("process"), F.regexp_extract(c, p, 2).alias("payload")))


def strip_leading_timestamp(c: Column) -> Column:
    return F.regexp_replace(c, F.lit(_UNICODE + P.LEADING), F.lit(""))


def is_placeholder(c: Column) -> Column:
    return c.startswith("<") & c.endswith(">") & (F.length(c) > 2)


def attribute_key(c: Column) -> Column:
    k = F.regexp_extract(c, P.ATTRIBUTE, 1)
    return F.when(k != "", k)


def is_wildcard(c: Column) -> Column:
    return (c == "<*>") | (c.endswith("=<*>") & attribute_key(c).isNotNull())

"""Column maskers and envelopes on lines of any characters, held to the Python ones."""

import os
import re

import pytest

from driftlens.functions import patterns as P
from driftlens.functions import text as T
from driftlens.queries import ENVELOPES, PROGRESS_SAMPLE, QUERIES, SAMPLES, enveloped, masked

SF = "/root/testdata/sf0.001"
LINES = [
    "", "plain 1234", "é1234 \t12 ms", "naïve@example.com von 10.0.0.1é", "日本12345語 1234 日本", "tab\t500\t....F [ 12%]", "....F　[ 12%]\r", "３１２３４５ 3.4µs 3.4μs ٣٣٣٣٣",
    "Jan　15　10:23:45 às 1700000000 \ufeff1700000000", " : -\u2003x yz\x85", "0xDEADbeefé deadbeef1語 /tmp/é/b", "ß 3.11.4 ü", "[é] Ünï 01/15/2024 10:23:45\x0b",
]


def by_python(line):
    want = {n: re.sub(p, to, f"{SAMPLES[n]} {line}") for n, p, to in P.SIMPLE}
    heads = {n: head + line for n, (head, _) in ENVELOPES.items()}
    c, j, t = (p.match(heads[n]) for n, p in (("cri", T._CRI), ("journald", T._JOURNALD), ("timestamp", T._LEADING)))
    out = {"stream": c[1], "cri": c[2], "process": re.sub(r"\[\d+\]", "[<NUM>]", j[1]), "journald": j[2], "timestamp": heads["timestamp"][t.end() :]}
    return want | {"progress": T.mask_progress(PROGRESS_SAMPLE + line)}, out


def held_to_python(lines):
    text = {(r["doc_id"], r["i"]): r["line"] for r in lines.collect()}
    for k, make in enumerate((masked, enveloped)):
        got = make(lines).collect()
        assert len(got) == len(text)
        for r in got:
            assert {c: r[c] for c in r.asDict() if c not in ("doc_id", "i")} == by_python(text[r["doc_id"], r["i"]])[k]


def test_accents_tabs_and_cjk(spark):
    held_to_python(spark.createDataFrame([(1, i, x) for i, x in enumerate(LINES)], "doc_id long, i int, line string"))


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_every_line_of_the_table(spark):
    from driftlens.queries import _document_lines

    texts = [r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    n = sum(t.count("\n") + 1 for t in texts)
    whole = [f"mask_{m}_all" for m in [*SAMPLES, "progress"]] + [f"envelope_{e}_all" for e in ENVELOPES]
    assert {q: QUERIES[q](spark, SF).count() for q in whole} == dict.fromkeys(whole, n)
    held_to_python(_document_lines(spark, SF))


def test_progress_of_a_long_line(spark):
    """Work is linear in the words of a line; quadratic work takes minutes here."""
    line = "....F " + "word 12% " * 10_000
    (row,) = masked(spark.createDataFrame([(1, 0, line)], "doc_id long, i int, line string")).select("progress").collect()
    assert row["progress"] == T.mask_progress(PROGRESS_SAMPLE + line)

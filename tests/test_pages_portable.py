"""Pages of findings and of a ledger, portable reports, and what decoding has lost."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from driftlens.config import DiffOptions
from driftlens.operators.pages import findings_page, ledger_page, matching, page
from driftlens.plans import portable
from driftlens.plans.diff import diff
from driftlens.sources.lines import losses, lost, read
from tests.test_engine import lines


@pytest.mark.parametrize("size", [1, 3, 50])
def test_pages_follow_each_other(spark, size):
    r = random.Random(size)
    rows = [(r.choice(["new", "gone", "changed"]), float(r.randrange(3)), r.choice([None, 1, 2]), k, r.choice(["a", "b"]), f"{r.choice(['Disk', 'user'])} {k}", None, "RAW e") for k in range(40)]
    df = spark.createDataFrame(rows, "kind string, score double, pos int, cid long, value string, template string, first_target_raw string, first_baseline_raw string")
    rank = {"new": 0, "gone": 1, "changed": 2}
    for kind, query in ((None, ""), ("gone", ""), (None, "dIsK"), (None, "raw E"), (None, "absent")):
        want = sorted((x for x in rows if kind in (None, x[0]) and query.lower() in f"{x[5]}\n{x[7]}".lower()), key=lambda x: (rank[x[0]], -x[1], -1 if x[2] is None else x[2], x[3]))
        got, after = [], None
        while part := findings_page(df, kind, query, after, size).collect():
            assert len(part) <= size
            got += [x.cid for x in part]
            after = part[-1]
            if size == 1 and len(got) == 4:
                break
        assert got == [x[3] for x in want][: len(got) if size == 1 else None]


def test_ledger_pages(spark):
    df = spark.createDataFrame([("/v", ["a%d" % (k % 2)] if k < 6 else None, f'"{k}"') for k in range(12)], "pointer string, group_json array<string>, value_json string")
    first = ledger_page(df, size=5).collect()
    rest = ledger_page(df, after=first[-1], size=50).collect()
    assert len(first) == 5 and len(rest) == 7 and len({(x.group, x.value_json) for x in first + rest}) == 12
    assert {x.value_json for x in ledger_page(df, "A1").collect()} == {'"1"', '"3"', '"5"'}
    assert matching(df, [F.col("value_json")], "  ").count() == 12 and page(df, [("value_json", True)], 1).first().value_json == '"9"'


def by_hand(texts, size, fan):
    level = [hashlib.sha256("\n".join("|" + t for t in texts[a : a + size]).encode()).hexdigest() for a in range(0, len(texts), size)]
    while len(level) > 1:
        level = [hashlib.sha256("\n".join(level[a : a + fan]).encode()).hexdigest() for a in range(0, len(level), fan)]
    return level[0]


@pytest.mark.parametrize("size, fan", [(1 << 16, 1 << 12), (7, 3), (1, 2)])
def test_digests_by_ranges(spark, size, fan):
    runs = [["a", "", "b é", ""] * 25, ["x"], [f"line {k}" for k in range(60)]]
    got = {r.run_idx: (r.lines, r.sha256) for r in portable.digest(lines(spark, *runs), size, fan).collect()}
    top = max(len(r) for r in runs)
    for k, texts in enumerate(runs):
        want = by_hand(texts, size, fan)
        depth = lambda n: 0 if n <= 1 else 1 + depth(-(-n // fan))
        for _ in range(depth(-(-top // size)) - depth(-(-len(texts) // size))):  # all runs are merged equally often
            want = hashlib.sha256(want.encode()).hexdigest()
        assert got[k] == (len(texts), want)


def test_reports_go_round(spark):
    runs = ['{"v":1}', "all is well"], ['{"v":2}', "disk failed now", "disk broke again"]
    o = DiffOptions(watch_fields=("/v",), watch_rate_change=5.0)
    df = lines(spark, *runs)
    d = diff(df, 1, o)
    text = portable.export(d, df, ["good.log", "bad.log"], o)
    doc = portable.load(text)
    assert doc["schema_version"] == 3 and doc["settings"]["watch_fields"] == ["/v"] and [doc["sources"]["baselines"][0][k] for k in ("name", "lines")] == ["good.log", 2]
    assert doc["sources"]["target"]["sha256"] == by_hand(runs[1], 1 << 16, 1 << 12) and json.loads(text) == doc
    assert {f["template"] for f in doc["result"]["findings"]} >= {"disk failed now"} or doc["result"]["findings"]
    assert portable.version_of(DiffOptions()) == 1 and portable.version_of(DiffOptions(watch_fields=("/a",), watch_by=("/b",))) == 2
    for bad, why in (("{", "not a report"), ("[]", "kind"), ('{"format":"x"}', "kind"), (json.dumps(doc | {"schema_version": 4}), "version 4"), (json.dumps(doc | {"schema_version": True}), "version"), (json.dumps({k: v for k, v in doc.items() if k != "result"}), "result")):
        with pytest.raises(ValueError, match=why):
            portable.load(bad)


def test_losses(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"fine\nbad \xff\xfe\ncut \xe2\x82\n\xef\xbf\xbd is itself\nend \xf0\x9f\x98")
    df = read(spark, str(tmp_path / "a.log"), loss=True)
    assert [(r.raw, r.loss) for r in df.orderBy("line_no").collect()] == [("fine", 0), ("bad ��", 2), ("cut �", 2), ("� is itself", 0), ("end �", 3)]
    assert tuple(losses(df).first()) == (0, 5, 3, 7, 2)
    (tmp_path / "w.log").write_bytes(b"\xff\xfea\x00\n\x00\x00\xd8b\x00\n\x00c\x00\x0a")
    assert [(r.raw, r.loss) for r in read(spark, str(tmp_path / "w.log"), loss=True).orderBy("line_no").collect()] == [("a", 0), ("�b", 1), ("c�", 1)]
    raw = spark.createDataFrame([(bytearray(b),) for b in (b"fine", b"bad \xff\xfe", b"cut \xe2\x82", b"\xef\xbf\xbd", b"\xf0\x9f\x98 \xc0\x80", b"\xff\xef\xbf\xbd")], "b binary").select(F.col("b").cast("string").alias("s"))
    assert [r[0] for r in raw.select(lost(F.col("s"))).collect()] == [0, 2, 2, 0, 5, 1]

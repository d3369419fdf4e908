"""Mining, comparisons, blocks, fields, streams and sources."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from driftlens.config import CustomMask, DiffOptions, check_stdin, pointers
from driftlens.functions.text import mask_line, signature, tokenize
from driftlens.operators import blocks as B
from driftlens.operators.mining import chunks, mine, templates
from driftlens.plans.diff import diff, diff_runs
from driftlens.sources.lines import from_lines, gunzip_bounded, read_any, read_lines


def lines(spark, *runs):
    return spark.createDataFrame([(r, i + 1, x) for r, run in enumerate(runs) for i, x in enumerate(run)], "run_idx int, line_no long, raw string").repartition(3)


def in_order(texts, threshold=0.5):
    """Templates one line after another, all compared with all: the plain reading of the rules."""
    made, ids = [], []
    for text in texts:
        tokens = tokenize(text)
        shapes, keys, kinds, route = signature(tokens)
        best, score = None, 0.0
        for n, c in enumerate(made):
            if len(c["shapes"]) != len(shapes) or c["route"] != route or c["keys"] != keys:
                continue
            words = sum(a == b and k == 2 for a, b, k in zip(c["shapes"], shapes, kinds, strict=True))
            attributes = sum(a == b and k == 1 for a, b, k in zip(c["shapes"], shapes, kinds, strict=True))
            if c["words"]:
                s = words / c["words"]
            elif 2 in kinds:
                s = 0.0
            elif c["attributes"]:
                s = attributes / c["attributes"]
            else:
                s = float(all(a in (None, b) for a, b in zip(c["shapes"], shapes, strict=True)))
            if s >= threshold and s > score:
                best, score = n, s
        if best is None:
            best = len(made)
            made.append({"shapes": list(shapes), "keys": keys, "route": route, "words": kinds.count(2), "attributes": kinds.count(1)})
        else:
            made[best]["shapes"] = [a if a == b else None for a, b in zip(made[best]["shapes"], shapes, strict=True)]
        ids.append(best)
    return ids


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mining_equals_the_plain_fold(spark, seed):
    r = random.Random(seed)
    vocabulary = ["red", "green", "up", "down", "k=1", "k=2", "m=", "12", "7", "x1", "x2", "[a b]", "99999"]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 5))) for _ in range(400)]
    got = mine(lines(spark, texts)).assigned.orderBy("line_no").collect()
    assert [g.cid for g in got] == in_order(texts)


@pytest.mark.parametrize("size", [1, 3, 50])
def test_one_bucket_over_many_chunks(spark, size):
    """Templates change between equal lines of a chunk; lines are read by many tasks, and one folds."""
    r = random.Random(size)
    texts = [f"go {r.choice('abcd')} {r.choice('abc')} {r.choice('ab')} {r.choice('a')}" for _ in range(300)]
    df = lines(spark, texts).repartitionByRange(7, "line_no").sortWithinPartitions("line_no")
    got = mine(df, 0.8, size=size)
    ids = in_order(texts, 0.8)
    assert [g.cid for g in got.assigned.orderBy("line_no").collect()] == ids
    assert chunks(df, size=size).count() == sum(-(-n // size) for n in df.rdd.glom().map(len).collect())
    firsts = {c: texts[ids.index(c)] for c in set(ids)}
    assert {c.cid: c.first_raw for c in got.clusters.collect()} == firsts
    assert {c.cid: c["count"] for c in got.clusters.collect()} == {c: ids.count(c) for c in firsts}
    for g in got.groups.collect():
        assert g.raw == texts[g.line_no - 1] and g.n == len(g.offsets) and g.last_line == g.line_no + g.offsets[-1]


def test_template_text(spark):
    rows = ["user alice logged in level=info", "user bob logged in level=info", "user carol logged in level=warn", "", ""]
    got = {r.cid: (r.template, r["count"]) for r in templates(lines(spark, rows), None).collect()}
    assert got == {0: ("user <*> logged in level=<*>", 3), 1: ("", 2)}
    top = templates(lines(spark, ["b x"] * 2 + ["a y"] * 2 + ["c z"]), 2).collect()
    assert [(r.cid, r.template) for r in top] == [(0, "b x"), (1, "a y")]


def test_findings(spark):
    base = ["start ok"] + ["tick tock"] * 50 + ["old thing here"] * 3 + ["sometimes seen line"]
    other = ["start ok"] + ["tick tock"] * 50 + ["old thing here"] * 3
    target = ["start ok"] + ["tick tock"] * 400 + ["brand fresh failure"]
    d = diff(lines(spark, base, other, target), 2)
    got = {r.template: (r.kind, r.direction) for r in d.findings.collect()}
    assert got == {"brand fresh failure": ("new", "up"), "old thing here": ("gone", "down"), "tick tock": ("changed", "up")}
    assert d.exit_code() == 1 and (d.baseline_totals, d.target_total, d.total_templates) == ([55, 54], 402, 5)
    alone = diff(lines(spark, ["a b", "c d"]), 0)
    assert {r.kind for r in alone.findings.collect()} == {"new"}
    assert diff(lines(spark, base, base), 1).exit_code() == 0


def test_values_and_sources(spark):
    base = [f"[svc-search-{k % 3}] health check ok" for k in range(180)] + ["test one PASSED"] * 6 + ["test one SKIPPED"] * 6
    target = [f"[svc-search-{k % 2}] health check ok" for k in range(180)] + ["test one FAILED"] + ["test one PASSED"] * 6
    d = diff(lines(spark, base, target), 1)
    v = d.value_findings.collect()
    assert [(r.template, r.position, r.new_value, r.baseline_values, r.established) for r in v] == [("test one <*>", 2, "FAILED", ["PASSED", "SKIPPED"], 6.0)]
    gone = d.findings.where("kind = 'gone'").collect()
    assert [(r.template, r.baseline_counts, r.first_baseline_line_no, r.block) for r in gone] == [("[svc-search-2] health check ok", [60], 3, None)]


def test_blocks_and_context(spark):
    base = [f"known line {w}" for w in ("aa", "bb", "cc")] * 5
    target = base[:6] + ["panic at start now", "  caused by disk", "known line aa", "stack frame one"] + base[6:] + ["panic at start now"]
    d = diff(lines(spark, base, target), 1, DiffOptions(context=1))
    b = d.blocks.collect()
    assert [(x.kind, x.first_line_no, x.last_line_no, x.line_count) for x in b] == [("new", 7, 10, 2)]
    assert d.findings.where("kind = 'new'").count() == 3 and d.findings.where("kind = 'new' AND block IS NULL").count() == 1
    c = {r.line_no: (r.before, r.after) for r in d.context.collect()}
    assert [tuple(x) for x in c[7][0]] == [(6, target[5])] and [tuple(x) for x in c[7][1]] == [(8, target[7])]


@pytest.mark.parametrize("seed", range(3))
def test_new_runs_are_gaps_of_more_than_two(spark, seed, monkeypatch):
    monkeypatch.setattr(B, "SPAN", 16)
    r = random.Random(seed)
    at = sorted(r.sample(range(1, 300), 90))
    want, run = [], None
    for i, n in enumerate(at):
        if i == 0 or n - at[i - 1] > 3:
            run = n
        want.append((n, run))
    df = spark.createDataFrame([(n, n % 5) for n in at], "line_no long, cid long")
    assert [(x.line_no, x.run) for x in B.new_runs(df).orderBy("line_no").collect()] == want


def joined(chains):
    """Chains one after another on one stack: for each, the first chain of what it is joined to."""
    stack = []
    for k, (first, covered, placed) in enumerate(chains):
        stack.append([first, covered, placed, [k]])
        while len(stack) > 1:
            a, b = stack[-2:]
            end = max(a[1], b[1])
            if b[0] - a[1] - 1 > 16 or 3 * (a[2] + b[2]) < end - a[0] + 1:
                break
            stack[-2:] = [[a[0], end, a[2] + b[2], a[3] + b[3]]]
    return sorted((s[3][0], s[0], s[1], s[2]) for s in stack)


@pytest.mark.parametrize("seed", range(4))
def test_joined_chains(spark, seed, monkeypatch):
    monkeypatch.setattr(B, "SPAN", 64)
    assert joined([(1, 5, 5), (10, 14, 5), (100, 101, 2)]) == [(0, 1, 14, 10), (2, 100, 101, 2)]
    r, chains, at = random.Random(seed), [], 1
    for _ in range(300):
        size = r.randrange(1, 9)
        chains.append((at, at + size - 1, r.randrange(1, size + 1)))
        at += size + r.randrange(3, (12, 18, 30, 9)[seed])
    want = joined(chains)
    assert 20 < len(want) < 280
    # two templates a chain, one of which may end behind all that is joined
    rows = [(2 * k + j, f, c + 500 * (j and k % 7 == 0), c, p - p // 2 if j else p // 2, k) for k, (f, c, p) in enumerate(chains) for j in (0, 1)]
    df = spark.createDataFrame(rows, "cid long, first long, last long, covered long, placed long, chain long").repartition(5)
    assert sorted(tuple(x) for x in B.joined_chains(df).collect()) == want
    blocks = {}
    for cid, _, last, _, _, k in rows:
        n, first, to, _ = next(w for w in reversed(want) if w[0] <= k)
        if last <= to:
            blocks.setdefault((first, to), []).append(cid)
    assert sorted((x.first, x.last, sorted(x.members)) for x in B.gone_blocks(df).collect()) == sorted((*k, sorted(v)) for k, v in blocks.items() if len(v) > 1)
    assert B.joined_chains(df.limit(0)).count() == B.gone_blocks(df.limit(0)).count() == 0


def record(route, status):
    return f'{{"route":"{route}","http":{{"status":{status}}}}}'


def test_fields(spark):
    base = [record("/a", 200)] * 99 + [record("/a", 503)] + ["plain"]
    target = [record("/a", 200)] * 80 + [record("/a", 503)] * 20 + [record("/a", "200.0"), record("/b", 200)]
    o = DiffOptions(watch_fields=("/http/status",), watch_by=("/route",), watch_rate_change=5.0)
    d = diff(lines(spark, base, base, target), 2, o)
    w = d.watches[0]
    v = {(r.group_json[0], r.value_json): (r.baseline_counts, r.target_count, r.is_new, r.group_seen_in_baseline) for r in w.values.collect()}
    assert v == {('"/a"', "200"): ([99, 99], 80, False, True), ('"/a"', "503"): ([1, 1], 20, False, True), ('"/a"', "200.0"): ([0, 0], 1, True, True), ('"/b"', "200"): ([0, 0], 1, True, False)}
    assert {r.group_json[0]: r.status for r in w.rate_groups.collect()} == {'"/a"': "compared", '"/b"': "no_baseline_observations"}
    assert {r.value_json for r in w.rate_changes.collect()} == {"200", "503"}
    assert d.exit_code() == 2  # a group without baseline


def test_field_problems(spark):
    from driftlens.operators.fields import ledger, observed

    odd = ['{"k":1,"k":2}', '{"k":[1]}', "{bad", "text", '{"x":1}', '{"k":1e400}', '{"k":"ü"}', '{"log":"{\\"k\\":5}","stream":"stdout"}', '{"log":"x","log":"y","stream":"stdout"}', '{"k":"' + "界" * 4096 + '"}']
    seen = observed(lines(spark, odd), ("/k",))
    assert [(r.status, r.value_json if r.value_json and len(r.value_json) < 99 else None) for r in seen.orderBy("line_no").collect()] == [
        ("ambiguous", None), ("non_scalar", None), ("invalid_json", None), ("non_json", None), ("missing", None), ("matched", "1e400"), ("matched", '"ü"'), ("matched", "5"), ("ambiguous", None), ("matched", None)]
    cover, values = ledger(seen, 0, False)
    assert cover.first()["untracked"] == 1
    many = observed(lines(spark, [f'{{"k":{n}}}' for n in range(70)]), ("/k",))
    cover, values = ledger(many, 0, False)
    assert values.count() == 64 and cover.first()["untracked"] == 6 and values.agg(F.max(F.col("value_json").cast("int"))).first()[0] == 63


def test_options():
    assert pointers(("/a~1b/~0",), 16) == [["a/b", "~"]]
    for bad in (dict(threshold=0), dict(significance=-1), dict(watch_by=("/a",)), dict(watch_fields=("a",)), dict(watch_fields=("/a", "/a")), dict(watch_rate_change=5.0), dict(watch_fields=("/a",), watch_rate_change=101.0)):
        with pytest.raises(ValueError):
            DiffOptions(**bad)
    with pytest.raises(ValueError):
        check_stdin(["-", "x", "-"])
    masks = CustomMask.load(["# no", "", "SHARD=shard-[a-z]+", r"\d+x"])
    assert mask_line("shard-ab 12x", tuple(masks)) == "<SHARD> <CUSTOM>"


def test_native_maskers_agree(spark):
    from driftlens.functions import masks as M
    from driftlens.queries import SAMPLES

    texts = [*SAMPLES.values(), "GET https://u:p@h:80/api/users/42?x=1 ok", "....s..F. [ 63%]", "plain words only", "\x1b[1mx\x1b[0m 12345"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(M.mask_line(F.col("t"))).collect()
    assert [r[0] for r in got] == [mask_line(t) for t in texts]


def test_sources(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"\xef\xbb\xbfone\r\ntwo\rhalf\n\nbad \xff byte")
    got = [(r.line_no, r.raw) for r in read_lines(spark, str(tmp_path / "a.log")).orderBy("line_no").collect()]
    assert got == [(1, "one"), (2, "two\rhalf"), (3, ""), (4, "bad � byte")]
    (tmp_path / "packed").write_bytes(gzip.compress(b"x\ny\n") + gzip.compress(b"z\n"))
    assert [r.raw for r in read_any(spark, str(tmp_path / "packed")).orderBy("line_no").collect()] == ["x", "y", "z"]
    (tmp_path / "wide").write_bytes("é\nb\n".encode("utf-16"))
    assert [r.raw for r in read_any(spark, str(tmp_path / "wide")).orderBy("line_no").collect()] == ["é", "b"]
    (tmp_path / "binary").write_bytes(b"a\0b\n")
    with pytest.raises(Exception, match="binary"):
        read_any(spark, str(tmp_path / "binary")).collect()
    with pytest.raises(ValueError):
        gunzip_bounded(gzip.compress(b"x" * 100), 50)
    big = tmp_path / "big.log"
    big.write_text("".join(f"line {n}\n" for n in range(60_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        r = read_lines(spark, str(big))
        assert r.where(F.col("raw") != F.concat(F.lit("line "), F.col("line_no") - 1)).count() == 0 and r.count() == 60_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("few", [100, 0])
def test_novel_batch_and_stream(spark, tmp_path, monkeypatch, few):
    from driftlens.streaming import novel as module
    from driftlens.streaming.novel import live as one_by_one
    from driftlens.streaming.novel import model, novel, watch

    monkeypatch.setattr(module, "FEW", few)  # with 0, lines meet templates by a join

    base = lines(spark, ["user alice logged in", "user bob logged in", "job 12345 done", ""])
    live = ["user carol logged in", "disk failed badly", "job 99999 done", "", "user carol logged out now"]
    m = model(base)
    want = ["disk failed badly", "user carol logged out now"]
    assert [r.raw for r in novel(lines(spark, live), m).orderBy("line_no").collect()] == want == list(one_by_one(live, m))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("\n".join(live))
    q = watch(spark, str(tmp_path / "in"), m).writeStream.format("memory").queryName(f"novel_test{few}").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.raw for r in spark.table(f"novel_test{few}").collect()) == sorted(want)


def test_reports_and_cli(spark, tmp_path, capsys):
    from driftlens.cli import main
    from driftlens.plans import report

    (tmp_path / "a.log").write_text("start ok\nall fine here\nbye\n")
    (tmp_path / "b.log").write_text("start ok\nError: it broke\nstack frame `x`\nbye\n")
    a, b = str(tmp_path / "a.log"), str(tmp_path / "b.log")
    assert main(["diff", a, b], spark) == 1
    assert "NEW        2 templates" in capsys.readouterr().out
    assert main(["diff", a, b, "--flat", "--markdown"], spark) == 1
    assert "`` stack frame `x` ``" in capsys.readouterr().out
    assert main(["diff", a, a], spark) == 0
    assert main(["templates", a, "-n", "2"], spark) == 0
    assert main(["novel", "--baseline", a, b], spark) == 1
    assert capsys.readouterr().out.endswith("Error: it broke\nstack frame `x`\n")
    assert main(["diff", a, b, "--threshold", "2"], spark) == 2
    d = diff_runs([from_lines(spark, ["a b", "c d"])], from_lines(spark, ["a b", "e f"]))
    assert [f["kind"] for f in report.document(d)["findings"]] == ["new", "gone"]
    assert report.excerpt(["x"] * 30, 12) == [*range(8), *range(26, 30)]
    assert 15 in report.excerpt(["x"] * 15 + ["ValueError: no"] + ["x"] * 14, 3)
    assert report.excerpt(["x"] * 5, 0) == [0, 1, 2, 3, 4] and report.clip("x" * 500)[-1] == "…" and report.code("a`b") == "``a`b``"

"""The command line: input by content, exit codes, ranges, live lines, field watches."""

import gzip
import json
import os
import subprocess
import sys
from pathlib import Path

import pytest

from driftlens.cli import _read, main


def test_reader_by_first_bytes(spark, tmp_path):
    text = "one 1\nzwei é\n"
    files = {"plain.log": text.encode(), "packed.log": gzip.compress(text.encode()), "wide.log": b"\xff\xfe" + text.encode("utf-16-le"), "big.log": b"\xfe\xff" + text.encode("utf-16-be")}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
        assert [r["raw"] for r in _read(spark, str(tmp_path / name)).orderBy("line_no").collect()] == ["one 1", "zwei é"]
    (tmp_path / "none.log").write_bytes(b"")
    assert _read(spark, str(tmp_path / "none.log")).count() == 0


def test_templates_of_packed_and_wide_files(spark, tmp_path, capsys):
    for name, data in (("packed", gzip.compress(b"user 1234567 in\n" * 3)), ("wide", "user 1234567 in\n".encode("utf-16") * 1)):
        (tmp_path / name).write_bytes(data)
        assert main(["templates", str(tmp_path / name)], spark) == 0
        assert "user <NUM> in" in capsys.readouterr().out


def test_errors_are_two(spark, tmp_path, capsys):
    good = tmp_path / "good.log"
    good.write_text("a line\n")
    (tmp_path / "binary.log").write_bytes(b"a\0b\n")
    (tmp_path / "cut.log").write_bytes(gzip.compress(b"x\n" * 1000)[:-9])
    a = str(good)
    for argv, says in (
        (["templates", str(tmp_path / "missing")], "missing"), (["diff", a, str(tmp_path / "missing")], "missing"), (["templates", str(tmp_path / "binary.log")], "binary"),
        (["templates", str(tmp_path / "cut.log")], "ends early"), (["templates", a, "--threshold", "7"], "threshold"), (["novel", "--baseline", a, a, "--threshold", "0"], "threshold"),
        (["templates", a, "--threshold", "nan"], "threshold"), (["diff", a, a, "--significance", "-1"], "significance"), (["templates", a, "--mask", "("], ""), (["diff", a], "baseline"),
        (["diff", a, a, "--watch-field", "x"], "pointer"), (["novel", "--baseline", "-", "-"], "once"), (["templates", a, "--mask-file", str(tmp_path / "missing")], "missing"),
    ):
        assert main(argv, spark) == 2, argv
        err = capsys.readouterr().err
        assert err.startswith("driftlens: ") and says in err, (argv, err)


def test_watch_of_empty_runs_is_incomplete(spark, tmp_path, capsys):
    (tmp_path / "e").write_text("")
    e = str(tmp_path / "e")
    assert main(["diff", e, e, "--watch-field", "/a", "--watch-field", "/b", "--json"], spark) == 2
    watched = json.loads(capsys.readouterr().out)["watched_fields"]
    assert [(w["pointer"], w["complete"], [(c["run_idx"], c["lines"], c["matched"], c["untracked"]) for c in w["coverage"]]) for w in watched] == [(p, False, [(0, 0, 0, 0), (1, 0, 0, 0)]) for p in ("/a", "/b")]
    assert main(["diff", e, e], spark) == 0 and main(["templates", e], spark) == 0


def test_live_lines_come_at_once(tmp_path):
    """A novel line of a pipe is printed before the pipe ends."""
    (tmp_path / "base.log").write_text("user alice in\nuser bob in\n")
    env = os.environ | {"PYTHONPATH": str(Path(__file__).resolve().parents[1]), "PYSPARK_SUBMIT_ARGS": "--conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 --master local[2] pyspark-shell"}
    with subprocess.Popen([sys.executable, "-m", "driftlens.cli", "novel", "--baseline", str(tmp_path / "base.log")], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True, env=env, cwd=tmp_path) as p:
        try:
            p.stdin.write("user carol in\ndisk failed badly\n")
            p.stdin.flush()
            assert p.stdout.readline() == "disk failed badly\n"  # the pipe is still open
            p.stdin.write("user dave in\nnothing known here\n")
            p.stdin.close()
            assert p.stdout.read() == "nothing known here\n" and p.wait(60) == 1
        finally:
            p.kill()


def watched(spark, capsys, tmp_path, baseline, target, *argv):
    for name, text in (("b", baseline), ("t", target)):
        (tmp_path / name).write_text(text)
    status = main(["diff", str(tmp_path / "b"), str(tmp_path / "t"), "--json", *argv], spark)
    return status, json.loads(capsys.readouterr().out)


def test_first_problem_and_excerpts(spark, capsys, tmp_path):
    for problem, kind in (('{"v":{}}', "non_scalar"), ('{"v":500', "invalid_json"), ('{"v":1,"v":2}', "ambiguous")):
        status, doc = watched(spark, capsys, tmp_path, '{"v":200}\n', '{"v":200}\n' + problem + "\n", "--watch-field", "/v")
        (w,) = doc["watched_fields"]
        cover = w["coverage"][1]
        assert (status, w["complete"], cover[kind], cover["first_problem"]["line_no"]) == (2, False, 1, 2)
        assert "first_problem" not in w["coverage"][0] and all(v.get("is_new") is None for v in w["values"])
    many = "".join(f'{{"v":{i}}}\n' for i in range(66))
    status, doc = watched(spark, capsys, tmp_path, '{"v":0}\n', many, "--watch-field", "/v")
    (w,) = doc["watched_fields"]
    assert (status, len(w["values"]), w["coverage"][1]["untracked"], w["coverage"][1]["first_problem"]["line_no"]) == (2, 64, 2, 65)
    status, doc = watched(spark, capsys, tmp_path, '{"v":0}\n', json.dumps({"v": "界" * 4096}, ensure_ascii=False) + "\n", "--watch-field", "/v")
    cover = doc["watched_fields"][0]["coverage"][1]
    assert (status, cover["untracked"], cover["first_problem"]["truncated"]) == (2, 1, True)
    line = json.dumps({"v": 1, "pad": "x" * 3 + "界" * 2000}, ensure_ascii=False)
    status, doc = watched(spark, capsys, tmp_path, '{"v":0}\n', line + "\n", "--watch-field", "/v")
    (new,) = [v for v in doc["watched_fields"][0]["values"] if v.get("is_new")]
    at = new["first_target"]
    assert status == 1 and at["truncated"] and line.startswith(at["raw"]) and 4093 <= len(at["raw"].encode()) <= 4096
    (old,) = [v for v in doc["watched_fields"][0]["values"] if not v.get("is_new")]
    assert old["first_baseline"] == {"baseline_index": 0, "line_no": 1, "raw": '{"v":0}', "truncated": False}


def test_bounded_context(spark, capsys, tmp_path):
    from driftlens.functions.fields import bounded_window

    before, after = [(k, "b" * 3000) for k in range(1, 4)], [(k, "a" * 3000) for k in range(5, 8)]
    got = bounded_window(before, after)
    assert [(n, len(t)) for n, t in got[0]] == [(3, 3000)][:1] + [] or [(n, len(t)) for n, t in got[0]] == [(2, 2192), (3, 3000)]
    assert sum(len(t) for side in got[:2] for _, t in side) == 8192 and got[2]
    assert bounded_window([(1, "")], []) == ([(1, "")], [], False)
    assert len(bounded_window([(k, "x") for k in range(30)], [])[0]) == 10
    base = "".join(f'{{"v":200,"n":"{k}"}}\n' for k in range(5))
    target = base + "plain words here\n" + '{"v":500,"n":"x"}\n' + "more of them\n"
    status, doc = watched(spark, capsys, tmp_path, base, target, "--watch-field", "/v", "-C", "1", "--flat")
    assert status == 1
    (new,) = [v for v in doc["watched_fields"][0]["values"] if v.get("is_new")]
    assert [x["raw"] for x in new["context"]["before"]] == ["plain words here"] and [x["raw"] for x in new["context"]["after"]] == ["more of them"]
    assert new["context_truncated"] is False and all("context" not in v for v in doc["watched_fields"][0]["values"] if not v.get("is_new"))
    found = {f["template"]: f for f in doc["findings"]}
    assert [x["line_no"] for x in found["plain words here"]["context"]["before"]] == [5]
    assert main(["diff", str(tmp_path / "b"), str(tmp_path / "t"), "--watch-field", "/v", "-C", "1", "--flat"], spark) == 1
    out = capsys.readouterr().out
    assert ">      6 | plain words here" in out and "       5 | " in out


def test_markdown_tables(spark, capsys, tmp_path):
    (tmp_path / "b").write_text("start ok\n" + '{"v":1}\n')
    (tmp_path / "t").write_text("start ok\na | b `c` d\n" + '{"v":2}\n')
    assert main(["diff", str(tmp_path / "b"), str(tmp_path / "t"), "--watch-field", "/v", "--markdown", "--flat"], spark) == 1
    out = capsys.readouterr().out
    assert "| Score | Baseline | Target | Template | First seen |\n| ---: | ---: | ---: | --- | --- |" in out
    assert "``a \\| b `c` d``" in out and "| `2` | 0 | 1 | new |" in out and "| Run | Lines | Matched |" in out


def test_counts_before_grouping(spark):
    from driftlens.plans.diff import diff_runs
    from driftlens.sources.lines import from_lines

    d = diff_runs([from_lines(spark, ["a b", "c d"])], from_lines(spark, ["a b", "new one here", "other thing now"]))
    assert (d.report_count(), d.finding_count()) == (2, 3)


def test_locations():
    from driftlens.plans.report import code, truncate_location

    assert truncate_location("a/b.log", ":7", 20) == "a/b.log:7" and truncate_location("x" * 30 + "/b.log", ":7", 12) == "…xxx/b.log:7"
    assert code("a|b", True) == "`a\\|b`" and code("a|b") == "`a|b`" and code(" x ") == "`  x  `" and code("") == "<code></code>"


@pytest.mark.parametrize("changed", [False, True])
def test_finding_values(spark, changed):
    from driftlens.operators.fields import finding_values

    values = spark.createDataFrame([("/a", None, "1", True), ("/a", None, "2", False), ("/a", None, "3", None)], "pointer string, group_json array<string>, value_json string, is_new boolean")
    rates = spark.createDataFrame([("/a", None, "2"), ("/a", None, "1")], "pointer string, group_json array<string>, value_json string") if changed else None
    assert sorted(r.value_json for r in finding_values(values, rates).collect()) == (["1", "2"] if changed else ["1"])

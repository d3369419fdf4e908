"""A stream of novel lines that is killed and begun again, and the ranges of options."""

import os
import signal
import subprocess
import sys
import time
from pathlib import Path

import pytest

from driftlens.cli import main
from driftlens.config import DiffOptions
from driftlens.streaming.novel import follow, followed, model
from tests.test_engine import lines


def test_each_novel_line_once_over_crashes(spark, tmp_path):
    """The query dies after a batch is written, before it is noted as done; begun again, it writes that batch over."""
    base = model(lines(spark, ["user alice in", "user bob in"]))
    (tmp_path / "in").mkdir()
    want: list[str] = []

    def come(name, n):
        want.extend(f"disk {name} failed in {chr(97 + k)} bay" for k in range(n))
        (tmp_path / "in" / f"{name}.log").write_text("".join(f"user u{k} in\ndisk {name} failed in {chr(97 + k)} bay\n" for k in range(n)))

    for turn in range(3):
        come(f"turn{turn}", 5)
        come(f"more{turn}", 3)
        done = follow(spark, str(tmp_path / "in"), base, str(tmp_path / "out"), str(tmp_path / "out" / "_checkpoint"), once=True)
        if turn == 1:  # this one is stopped while it runs
            done.stop()
            done = follow(spark, str(tmp_path / "in"), base, str(tmp_path / "out"), str(tmp_path / "out" / "_checkpoint"), once=True)
        done.awaitTermination(120)
        # the last batch counts as not done: its note goes, as in a crash between writing and noting
        notes = sorted((tmp_path / "out" / "_checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
        for p in (notes[-1], notes[-1].with_name(f".{notes[-1].name}.crc")):
            p.unlink(missing_ok=True)
        again = follow(spark, str(tmp_path / "in"), base, str(tmp_path / "out"), str(tmp_path / "out" / "_checkpoint"), once=True)
        again.awaitTermination(120)
        assert sorted(r.raw for r in followed(spark, str(tmp_path / "out")).collect()) == sorted(want)


def test_the_command_is_killed_and_begun_again(tmp_path):
    (tmp_path / "base.log").write_text("user alice in\nuser bob in\n")
    (tmp_path / "in").mkdir()
    env = os.environ | {"PYTHONPATH": str(Path(__file__).resolve().parents[1]), "PYSPARK_SUBMIT_ARGS": "--conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 --master local[2] pyspark-shell"}
    argv = [sys.executable, "-m", "driftlens.cli", "novel", "--baseline", str(tmp_path / "base.log"), "--follow", str(tmp_path / "in"), "--out", str(tmp_path / "out")]
    (tmp_path / "in" / "one.log").write_text("user carol in\ndisk failed badly\n")
    p = subprocess.Popen(argv, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, env=env, cwd=tmp_path, start_new_session=True)
    try:
        until = time.time() + 120
        while time.time() < until and not list((tmp_path / "out").glob("batch=*/*.parquet")):
            time.sleep(0.5)
    finally:
        os.killpg(p.pid, signal.SIGKILL)
        p.wait()
    (tmp_path / "in" / "two.log").write_text("user dave in\nnothing known here\n")
    done = subprocess.run([*argv, "--once"], stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, env=env, cwd=tmp_path, timeout=200)
    assert done.returncode == 1
    import pyarrow.dataset as ds

    kept = ds.dataset([str(f) for f in (tmp_path / "out").glob("batch=*/*.parquet")]).to_table()
    assert sorted(kept.column("raw").to_pylist()) == ["disk failed badly", "nothing known here"]


def test_ranges_of_options(spark, tmp_path, capsys):
    (tmp_path / "a").write_text("x y\n")
    a = str(tmp_path / "a")
    for argv in (["diff", a, a, "-C", "-2"], ["diff", a, a, "--block-lines", "-3"], ["templates", a, "-n", "-1"], ["diff", a, a, "-C", "x"]):
        with pytest.raises(SystemExit) as e:
            main(argv, spark)
        assert e.value.code == 2
    with pytest.raises(ValueError, match="context"):
        DiffOptions(context=-1)
    for argv in (["novel", "--baseline", a, "--follow", a], ["novel", "--baseline", a, "--once", a], ["novel", "--baseline", a, a, "--follow", a, "--out", a]):
        assert main(argv, spark) == 2
    assert capsys.readouterr().err.count("driftlens: --follow takes") == 3
    assert main(["templates", a, "-n", "0"], spark) == 0

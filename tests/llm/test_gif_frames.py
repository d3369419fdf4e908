"""Frames of given GIFs as rows, and that the query reads its rendered frames."""

import struct

import numpy as np
import pytest

from driftlens.llm import gif as G


def screen(palette, *frames):
    return b"GIF89a" + struct.pack("<HHBBB", 2, 1, 0x81, 0, 0) + bytes(palette) + b"".join(frames) + b"\x3b"


def frame(indexes, dispose=0, clear=None, at=(0, 0), size=(2, 1), delay=5, palette=None):
    control = b"\x21\xf9\x04" + struct.pack("<BHBB", dispose << 2 | (clear is not None), delay, clear or 0, 0)
    bits = 0 if palette is None else 0x81
    return control + b"\x2c" + struct.pack("<HHHHB", *at, *size, bits) + bytes(palette or []) + b"\x08" + G._blocks(G.lzw_pack(bytes(indexes)))


SHARED = [9, 9, 9, 200, 0, 0, 0, 60, 0, 0, 0, 70]
RED, GREEN, BLUE, OWN, NONE = [200, 0, 0, 255], [0, 60, 0, 255], [0, 0, 70, 255], [40, 80, 120, 255], [0, 0, 0, 0]


def test_a_row_a_frame_with_rendered_colours(spark):
    gif = screen(
        SHARED, frame([1, 2], 1), frame([3, 0], 3, clear=0, delay=7), frame([2], 2, at=(1, 0), size=(1, 1)), frame([0, 0], 1, clear=0),
        frame([1], at=(0, 0), size=(1, 1), palette=[0, 0, 0, 40, 80, 120, 0, 0, 0, 0, 0, 0]), frame([1, 1, 1], at=(1, 0), size=(3, 1)),
    )
    broken = screen(SHARED, frame([1, 2]))[:-1] + b"?"
    rows = spark.createDataFrame([("a", gif, 1), ("b", None, 2), ("c", b"text", 3), ("d", broken, 4)], "name string, gif binary, n int")
    got = G.gif_frames(rows, "gif").orderBy("n", "frame").collect()
    shown = [(r["name"], r["frame"], r["start_ms"], r["duration_ms"], [*map(list, np.frombuffer(r["pixels"], np.uint8).reshape(-1, 4).tolist())]) for r in got if r["error"] is None]
    assert shown == [
        ("a", 0, 0, 50, [RED, GREEN]), ("a", 1, 50, 70, [BLUE, GREEN]), ("a", 2, 120, 50, [RED, GREEN]), ("a", 3, 170, 50, [RED, NONE]),
        ("a", 4, 220, 50, [OWN, NONE]), ("a", 5, 270, 50, [OWN, RED]), ("d", 0, 0, 50, [RED, GREEN]),
    ]
    assert [(r["name"], r["n"], r["frame"]) for r in got if r["error"]] == [("b", 2, 0), ("c", 3, 0), ("d", 4, 1)]
    hist = [np.reshape(r["histogram"], (3, 8)).tolist() for r in got if r["name"] == "a"]
    at = lambda *c: [[sum(v >> 5 == b for v in x) for b in range(8)] for x in zip(*(p[:3] for p in c), strict=True)]
    assert hist == [at(RED, GREEN), at(BLUE, GREEN), at(RED, GREEN), at(RED), at(OWN), at(OWN, RED)]
    with pytest.raises(ValueError):
        G.gif_frames(rows.withColumnRenamed("name", "frame"), "gif")


def test_media_reads_back_rendered_frames(spark):
    assert G.decode(G.encode(bytes(range(192)) * 5, rows=2))[2].drawn[:, :, 0].tobytes() == bytes(range(192))
    docs = spark.createDataFrame([(1, "é plain text"), (2, "x" * 192 * 5000)], "doc_id long, text string")
    for r in G.media(docs, keep_media=True).collect():
        frames = G.decode(bytes(r["media"]))
        index = np.concatenate([f.indexes.ravel() for f in frames])
        share = np.bincount(index >> 5, minlength=8) / len(index)
        assert r["feature"] == f"frames={len(frames)};ms={100 * len(frames)};hist=" + ",".join(f"{v:.6f}" for v in share)

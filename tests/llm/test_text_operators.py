"""Operators on texts against plain versions, and the odd cases of each."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

P = pytest.importorskip("public_tokenizers")

ODD = [
    (1, "plain text of some words, more words."), (2, None), (3, ""), (4, "~ a ~ b <|endoftext|>X. <|ENDOFTEXT|>"), (5, "É.,x it's I'LL x...  .. İIi ǅ.ΑΣ"),
    (6, "word " * 9000), (6, "word " * 9000), (7, "x" * 70_000), (None, "no id"), (8, "a\n\nb\n"), (9, " \t\x0b\r\n"), (10, "日本語 テキスト 😀"),
]
SCHEMA = "doc_id long, text string, n_tokens string, _of int, drop string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "clash", 1, "clash") for i, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


def key(r):
    return (r["doc_id"] is None, r["doc_id"])


def test_token_counts_are_the_librarys(odd, empty, library):
    from driftlens.llm.tokens import token_counts

    path = P.path("word_bpe_49k.json")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(odd, path, huge=2000).collect())
    n = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t in ODD]
    assert got == sorted((i is None, i or 0, len((t or "").encode()), k, k > 2048) for (i, t), k in zip(ODD, n, strict=True))
    assert token_counts(empty, path).count() == 0


@pytest.mark.parametrize("chunk, overlap", [(50, 4), (64, 16), (1000, 10)])
def test_chunks_splice_to_the_whole(library, chunk, overlap):
    from driftlens.llm.tokens import chunked_ids

    text = "Some words, <|endoftext|> more-words " * 20 + "x" * 300 + " end  of\nit " * 10 + "y" * 200
    assert [i for part in chunked_ids(library, text, chunk, overlap) for i in part] == library.encode(text, add_special_tokens=False).ids


def test_packing_is_gapless_and_tight(odd, empty, library, spark):
    from driftlens.llm.packing import pack, sum_of_squares

    path = P.path("word_bpe_49k.json")
    rows = pack(odd, path, capacity=64).collect()
    ids = [[*library.encode(t or "", add_special_tokens=False).ids, 0] for _, t in ODD]
    want = sorted((i is None, i or 0, k, k * 64, len(x[k * 64 : k * 64 + 64]), zlib.crc32(np.array(x[k * 64 : k * 64 + 64], "<u4").tobytes())) for (i, _), x in zip(ODD, ids, strict=True) for k in range(-(-len(x) // 64)))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) <= sum(map(len, ids)) / 64 * 1.05 + 2
    assert pack(empty, path).count() == 0
    lengths = np.sort(np.random.default_rng(1).integers(1, 2049, 3000))[::-1]
    assert sum_of_squares(lengths)[0].max() + 1 <= -(-lengths.sum() // 2048) * 1.02


def test_gif_round_trip_and_features(odd, empty):
    from driftlens.llm.gif import media, padded

    rows = media(odd).collect()
    assert len(rows) == len(ODD) and media(empty).count() == 0
    by = {r.doc_id: r for r in rows}
    for i, t in ODD:
        p = padded((t or "").encode())
        r = by[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    assert by[2].feature == by[3].feature and by[2].media_sha256 == by[3].media_sha256


def plain_gif(gif):
    """(payload, milliseconds) by the format's rules, a bit at a time; a second decoder that shares nothing with the first."""
    assert gif[:6] in (b"GIF87a", b"GIF89a")
    at, ms, out = 13 + (3 << (gif[10] & 7) + 1 if gif[10] & 128 else 0), 0, []
    palette = gif[13:at]
    while gif[at] != 0x3B:
        if gif[at] == 0x21:
            if gif[at + 1] == 0xF9:
                ms += 10 * (gif[at + 4] | gif[at + 5] << 8)
            at += 2
        else:
            assert gif[at] == 0x2C and not gif[at + 9] & 0xC0  # no palette of its own, not interlaced
            size = (gif[at + 5] | gif[at + 6] << 8) * (gif[at + 7] | gif[at + 8] << 8)
            least = gif[at + 10]
            at += 11
            data, k = b"", at
            while gif[k]:
                data += gif[k + 1 : k + 1 + gif[k]]
                k += gif[k] + 1
            bits = "".join(format(b, "08b")[::-1] for b in data)
            names, width, pos, before, pixels = {}, least + 1, 0, b"", b""
            while True:
                code = int(bits[pos : pos + width][::-1], 2)
                pos += width
                if code == 1 << least:
                    names, width, before = {i: bytes([i]) for i in range(1 << least)}, least + 1, b""
                    names[1 << least] = names[(1 << least) + 1] = b""
                    continue
                if code == (1 << least) + 1:
                    break
                now = names[code] if code in names else before + before[:1]
                if before and len(names) < 4096:
                    names[len(names)] = before + now[:1]
                    if len(names) == 1 << width and width < 12:
                        width += 1
                pixels += now
                before = now
            out.append(bytes(palette[3 * p] for p in pixels[:size]))
        while gif[at]:
            at += gif[at] + 1
        at += 1
    return b"".join(out), ms


def test_gif_by_another_decoder(spark):
    """Stored form, payload and feature of texts, some over several frames, by a plain decoder."""
    from driftlens.llm import gif

    rng = np.random.default_rng(2)
    texts = ["", "short", "é" * 500, "ab" * 3000, "".join(rng.choice(list("abcdefgh \n"), 20_000)), "".join(map(chr, rng.integers(32, 1000, 4000)))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for r in gif.media(df, keep_media=True).collect():
        payload, ms = plain_gif(bytes(r.media))
        assert payload == gif.padded(texts[r.doc_id].encode()) and hashlib.sha256(payload).hexdigest() == r.payload_sha256
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(bytes(r.media)).hexdigest())
        frames = -(-len(payload) // (gif.WIDTH * gif.ROWS))
        # grey pixels: red, green and blue are the sample
        counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256).reshape(gif.BINS, -1).sum(1)
        assert r.feature == f"frames={frames};ms={ms};hist=" + ",".join(f"{v:.6f}" for v in counts / counts.sum())
        assert ms == 10 * gif.DELAY * frames == sum(r.frame_duration_ms) and r.frame_start_ms == [10 * gif.DELAY * k for k in range(frames)]
        assert r.histogram == counts.tolist() * 3
    long = rng.integers(0, 256, 192 * 100, np.uint8).tobytes()
    assert plain_gif(gif.encode(long, rows=7)) == (long, 10 * gif.DELAY * 15)


def test_gif_rules():
    import struct

    from driftlens.llm.gif import _blocks, decode, encode, lzw_pack, lzw_unpack

    rng = np.random.default_rng(0)
    for data in (bytes(192 * 4000), rng.integers(0, 256, 192 * 400, np.uint8).tobytes(), b"ab" * 96 * 300):
        assert lzw_unpack(lzw_pack(data), 8) == data
        assert b"".join(f.indexes.tobytes() for f in decode(encode(data, rows=100))) == data
    # codes 4, 1, 1, 1, 5 of three bits: clear, three ones, end
    bits = "".join(format(c, "03b")[::-1] for c in (4, 1, 1, 1, 5))
    stream = bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))
    assert lzw_unpack(stream, 2) == bytes([1, 1, 1])

    def frame(pixels, dispose, clear=None, at=(0, 0), size=(2, 1), bits=0, delay=5):
        control = b"\x21\xf9\x04" + struct.pack("<BHBB", dispose << 2 | (clear is not None), delay, clear or 0, 0)
        return control + b"\x2c" + struct.pack("<HHHHB", *at, *size, bits) + b"\x08" + _blocks(lzw_pack(bytes(pixels)))

    head = b"GIF89a" + struct.pack("<HHBBB", 2, 1, 0x81, 0, 0) + bytes([9, 9, 9, 50, 0, 0, 0, 60, 0, 0, 0, 70])
    gif = head + frame([1, 2], 1) + frame([3, 0], 3, clear=0) + frame([2], 2, at=(1, 0), size=(1, 1)) + frame([0, 0], 0, clear=0) + b"\x3b"
    shown = [f.pixels[0].tolist() for f in decode(gif)]
    red, green, blue = [50, 0, 0, 255], [0, 60, 0, 255], [0, 0, 70, 255]
    assert shown == [[red, green], [blue, green], [red, green], [red, [0, 0, 0, 0]]]
    assert [f.start_ms for f in decode(gif)] == [0, 50, 100, 150]
    rows = b"GIF89a" + struct.pack("<HHBBB", 1, 5, 0x81, 0, 0) + bytes(12) + frame([0, 1, 2, 3, 0], 0, size=(1, 5), bits=0x40) + b"\x3b"
    assert decode(rows)[0].indexes.ravel().tolist() == [0, 3, 2, 0, 1]


def lines_by_hand(docs, min_docs):
    held = {}
    for n, (_, t) in enumerate(docs):
        for line in (t or "").split("\n"):
            k = re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
            held.setdefault(k, set()).add(n)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (k := re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))) or len(held[k]) < min_docs]
        out.append((i, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("bits", "most"), [(64, 1000), (1 << 20, 1000), (None, 0)])
def test_line_dedup(spark, odd, empty, bits, most):
    from driftlens.llm.lines import dedup_lines

    rng = np.random.default_rng(3)
    pool = ["Header Line", " header line\t", "É x", "", "common", "foo bar"] + [f"line {k}" for k in range(40)]
    docs = [(i, "\n".join(rng.choice(pool, rng.integers(0, 9)))) for i in range(60)] + [(60, None), (61, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = dedup_lines(df, min_docs=4, bits=bits, most_keys=most).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == lines_by_hand(docs, 4)
    out = dedup_lines(odd, min_docs=2, bits=bits, most_keys=most)
    assert out.count() == len(ODD) and set(odd.columns) <= set(out.columns)
    assert {r.doc_id for r in out.where("n_dropped > 0").collect()} == {6}  # the repeated row
    assert dedup_lines(empty, bits=bits, most_keys=most).count() == 0
    again = [(7, "same"), (7, "same"), (7, "same\nother")]  # each row is a document
    assert [r.n_dropped for r in dedup_lines(spark.createDataFrame(again, "doc_id long, text string"), min_docs=3, bits=bits, most_keys=most).collect()] == [1, 1, 1]


def test_ftrl_against_plain_python():
    """The rule coordinate by coordinate, with no arrays."""
    from driftlens.llm.toxicity import train

    rng = np.random.default_rng(11)
    rows = [np.unique(rng.integers(0, 30, rng.integers(0, 9))) for _ in range(40)]
    labels = [int(3 in r.tolist()) for r in rows]
    alpha, beta, l1, l2, epochs = 2.0, 1.0, 0.2, 0.1, 3
    z, n, order = [0.0] * 31, [0.0] * 31, np.random.default_rng(0)

    def weight(i):
        if i == 30:  # the bias has no L1 penalty
            return -z[i] / ((beta + n[i] ** 0.5) / alpha + l2)
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - (l1 if z[i] > 0 else -l1)) / ((beta + n[i] ** 0.5) / alpha + l2)

    for _ in range(epochs):
        for k in order.permutation(len(rows)).tolist():
            active = [*rows[k].tolist(), 30]
            w = {i: weight(i) for i in active}
            p = 1 / (1 + np.exp(-sum(w.values())))
            for i in active:
                g = p - labels[k]
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha * w[i]
                n[i] += g * g
    got = train(rows, labels, 30, alpha=alpha, beta=beta, l1=l1, l2=l2, epochs=epochs)
    dense = np.zeros(30)
    dense[got.index] = got.weight
    assert np.allclose(dense, [weight(i) for i in range(30)]) and np.isclose(got.bias, weight(30))
    assert np.count_nonzero(dense) < 30 and dense[3] > 0


def test_toxicity_sample_is_bounded(spark):
    """Texts that don't fit the sample's bytes are passed over; columns named like the outputs don't clash."""
    from driftlens.llm.toxicity import fit, score

    rows = [(i, ("vile nasty " if i % 2 else "plain kind ") + f"word{i % 7}", 1.0, 2) for i in range(200)] + [(500, "vile " * 100_000, 0.5, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, predicted int")
    known = spark.createDataFrame([(r[0], int(r[0] % 2)) for r in rows], "doc_id long, toxic int")
    model = fit(docs, known, sample_bytes=4000)
    got = {r.doc_id: r.predicted for r in score(docs, model).collect()}
    assert all(got[i] == i % 2 for i in range(200))


def test_toxicity(spark, odd, empty):
    from driftlens.llm.toxicity import fit, keep_clean, score

    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    bad = ["nasty", "rotten", "vile"]
    rows, labels = [], []
    for i in range(900):
        toxic = int(i % 4 == 0)
        w = list(rng.choice(words, 40)) + (list(rng.choice(bad, 2)) if toxic else [])
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, toxic))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1), (5000, None)], "doc_id long, toxic int")
    model = fit(docs, known)
    got = {r.doc_id: r for r in score(docs, model).collect()}
    for i, toxic in labels:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    held = [(got[i].predicted, t) for i, t in labels if got[i].held_out]
    assert np.mean([p == t for p, t in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    kept = {r.doc_id for r in keep_clean(docs, model).collect()}
    assert kept == {i for i in got if not got[i].predicted}
    assert score(odd, model).count() == len(ODD) and score(empty, model).count() == 0
    assert fit(docs, known.limit(0)).score(pa.array(["x", None]), np.zeros(1 << 22)).max() < 0.5


def test_sentencepiece(odd, empty):
    import sentencepiece

    from driftlens.llm.pieces import PieceCoder, encode_decode

    path = P.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [t or "" for _, t in ODD] + ["  a  b\n c\t", " x", "x ", "if   (a  ==  b)    {  }", "́e ﬁ"]
    coder = PieceCoder(path)
    assert [x.tolist() for x in coder.encode_column(pa.array(texts))] == library.encode(texts)
    rows = encode_decode(odd, path, keep_ids=True).collect()
    assert len(rows) == len(ODD) and all(r.round_trip and r.n_pieces == len(r.ids) for r in rows)
    assert encode_decode(empty, path).count() == 0
    viterbi = PieceCoder(path, "unigram")
    for text in ("▁hello", "▁thethe", "▁abcab"):
        best = {0: 0.0}
        for j in range(1, len(text) + 1):
            best[j] = max(best[k] + viterbi.score[viterbi.id_of[text[k:j]]] for k in range(j) if text[k:j] in viterbi.id_of)
        ids = viterbi.known(text)
        assert "".join(viterbi.text_of[i] for i in ids) == text and abs(sum(viterbi.score[i] for i in ids) - best[len(text)]) < 1e-6


def test_html(spark):
    from driftlens.llm.html import blocks, made_page, main_text, predict, stored, vectors

    page = (
        "<html><head><title>t</title><script>var t='</p>';</script></head><body><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><div class=ad>Buy now.</div>"
        "<article><h1>A &amp; B</h1><p>First  long\nparagraph of the text, with words.<p>Second one &lt;here&gt;.</article><section class=comments><p>Nice one.</p></section><footer>&copy; x</footer>"
    )
    found = blocks(page)
    assert [b.text for b in found] == ["Home", "News", "Buy now.", "A & B", "First long paragraph of the text, with words.", "Second one <here>.", "Nice one.", "© x"]
    weights = stored()
    rng = np.random.default_rng(123)
    right = total = 0
    for _ in range(150):
        made, truth = made_page(rng)
        mine = blocks(made)
        assert len(mine) == len(truth)
        right += int(((predict([vectors(mine)], weights)[0] >= 0.5) == np.array(truth)).sum())
        total += len(truth)
    assert right / total > 0.95
    rows = [(1, "u", page, "x"), (2, None, None, "x"), (3, "", "", "x"), (4, "u", "<p>" * 3000 + "x", "x"), (5, "u", "no tags < here", "x"), (1, "u", page, "x")]
    out = main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), weights)
    got = {r.page_id: r for r in out.collect()}
    assert out.count() == 6 and got[1].text.startswith("A & B\nFirst long") and "Buy" not in got[1].text and "Nice" not in got[1].text
    assert (got[2].text, got[2].n_chars, got[3].text) == ("", 0, "")
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_html_deep_and_long_pages(spark, monkeypatch):
    """Work is linear in nesting, and a page of very many blocks gives what it would give at once."""
    import time

    from driftlens.llm import html

    for page, n in (("<div>x" * 50_000, 50_000), ("<b>" + "<div></b>" * 50_000, 0), ("<span>" * 50_000 + "<p>x</p>" * 20_000, 20_000), ("<div>" * 50_000 + "x" + "</span>" * 50_000, 1)):
        began = time.time()
        assert len(html.blocks(page)) == n
        assert time.time() - began < 5
    made = "".join(html.made_page(np.random.default_rng(k))[0] for k in range(12))
    found = html.blocks(made)
    whole = html.predict([html.vectors(found)], html.stored())[0]
    assert np.allclose(whole, html.predict_long(found, html.stored(), 50), atol=1e-5)
    monkeypatch.setattr(html, "WINDOW", 64)
    rows = spark.createDataFrame([(1, "u", made, "n", 7)], "page_id long, url string, html string, text string, n_chars int")
    (row,) = html.main_text(rows).collect()
    assert row.n_chars == len(row.text) > 0


def test_html_training():
    """The stored weights' maker learns: a small run is better than always saying no."""
    from driftlens.llm.html import blocks, made_page, predict, trained, vectors

    weights = trained(pages=150, passes=3)
    rng, right, total, yes = np.random.default_rng(5), 0, 0, 0
    for _ in range(40):
        made, truth = made_page(rng)
        right += int(((predict([vectors(blocks(made))], weights)[0] >= 0.5) == np.array(truth)).sum())
        total, yes = total + len(truth), yes + sum(truth)
    assert right > max(yes, total - yes) * 1.1

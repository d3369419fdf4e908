"""Template mining as an ordered fold over buckets of chunks.

A line can only join a template of its own length, route word, keys and of its own kind
(with words or without), which makes its bucket.  Tasks mask and split lines where they are
read and pack each stretch of successive lines into a few *chunk* rows, one a bucket: the
distinct token lists, and which line has which as numbers.  Only chunks are shuffled, by
bucket, and put in order by Spark's sorter.  The fold looks at a token list of a chunk once
and then again only after a template has changed, and passes on runs of lines between those
places as arrays; so lines that a third of a log has in common cost their bucket's task a
few bytes each.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from math import ceil
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.config import THRESHOLD
from driftlens.functions.text import ATTRIBUTE, WORD, attribute_key, is_wildcard, signature
from driftlens.functions.words import Lexicon
from driftlens.operators.joins import lookup
from driftlens.operators.lineage import durable
from driftlens.operators.ranking import ranked

#: Lines of a chunk at most, and signatures of a bucket whose answer is remembered.
CHUNK, REMEMBERED = 65_536, 400_000
#: Lines of a bucket that one task folds at most.
FOLDED = 8_000_000
_CHUNK = "bucket string, run_idx int, base long, tokens array<array<string>>, raws array<string>, codes binary, offsets binary"


class _Stretch:
    """Successive lines of a run on their way into chunks, as rows of token numbers."""

    def __init__(self, run: int, base: int):
        self.run, self.base, self.n = run, base, 0
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # token numbers, begins, sizes
        self.raws: list[pa.Array] = []

    def add(self, rows: tuple[np.ndarray, np.ndarray, np.ndarray], raw: pa.Array, a: int, b: int) -> None:
        """Lines ``a`` to ``b`` of what a lexicon has read."""
        self.parts.append((rows[0], rows[1][a:b], rows[2][a:b]))
        self.raws.append(raw.slice(a, b - a))
        self.n += b - a

    def rows(self, words: Lexicon) -> pa.RecordBatch:
        before = np.cumsum([0, *(len(flat) for flat, _, _ in self.parts)])
        flat, size = (np.concatenate([p[k] for p in self.parts]) for k in (0, 2))
        start = np.concatenate([p[1] + x for p, x in zip(self.parts, before, strict=False)])
        first, which = words.alike(flat, start, size)
        raws = pa.concat_arrays(self.raws).take(pa.array(first)).to_pylist()
        names: dict[str, int] = {}
        lists, texts, own, place = [], [], np.empty(len(first), np.int64), np.empty(len(first), np.int32)
        for k, (s, n) in enumerate(zip(start[first].tolist(), size[first].tolist(), strict=True)):
            tokens = words.list_of(flat, s, n)
            bucket = bucket_of(tokens)
            b = own[k] = names.setdefault(bucket, len(names))
            if b == len(lists):
                lists.append([])
                texts.append([])
            place[k] = len(lists[b])
            lists[b].append(tokens)
            texts[b].append(raws[k])
        order = np.argsort(own[which], kind="stable")  # lines by bucket, in their order
        cuts = np.searchsorted(own[which][order], np.arange(len(names) + 1)).tolist()
        codes, offsets = place[which][order].astype("<i4"), order.astype("<i4")
        each = lambda v: [v[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
        m = len(names)
        cols = [list(names), [self.run] * m, [self.base] * m, lists, texts, each(codes), each(offsets)]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.list_(pa.list_(pa.string())), pa.list_(pa.string()), pa.binary(), pa.binary()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [f.split(" ")[0] for f in _CHUNK.split(", ")])


def chunks(lines: DataFrame, masks=(), size: int = CHUNK) -> DataFrame:
    """``lines`` (run_idx, line_no, raw) as chunk rows; a chunk ends where the next row isn't the next line."""
    masks = tuple(masks)

    def run(batches):
        words, now = Lexicon(masks), None
        for b in batches:
            if not b.num_rows:
                continue
            r, n, raw = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)
            read, at = words.read(raw), 0
            breaks = [*(np.flatnonzero((r[1:] != r[:-1]) | (n[1:] != n[:-1] + 1)) + 1).tolist(), b.num_rows]
            while at < b.num_rows:
                if now is not None and (now.n >= size or r[at] != now.run or n[at] != now.base + now.n):
                    yield now.rows(words)
                    now = None
                if now is None:
                    now = _Stretch(int(r[at]), int(n[at]))
                stop = min(breaks[bisect_right(breaks, at)], at + size - now.n)
                now.add(read, raw, at, stop)
                at = stop
            if words.full():  # begun afresh, so what has been read with it goes out
                yield now.rows(words)
                words, now = Lexicon(masks), None
        if now is not None:
            yield now.rows(words)

    own = lines.select(F.col("run_idx").cast("int"), F.col("line_no").cast("long"), F.coalesce(F.col("raw").cast("string"), F.lit("")).alias("raw"))
    return own.mapInArrow(run, _CHUNK)


def bucket_of(tokens: list[str]) -> str:
    _, keys, kinds, route = signature(tokens)
    return "\x1f".join([str(len(tokens)), "w" if WORD in kinds else "", route, *(k or "" for k in keys)])


def similarity(own: list[str | None], words: int, attributes: int, shapes: list[str], kinds: list[int]) -> float:
    """Share of a template's words (without any: of its attributes) at which a line has the shape of all before."""
    if words or attributes:
        kind, of = (WORD, words) if words else (ATTRIBUTE, attributes)
        return sum(k == kind and a == b for a, b, k in zip(own, shapes, kinds, strict=True)) / of
    return float(all(a is None or a == b for a, b in zip(own, shapes, strict=True)))


class Template:
    """A cluster on its way: what it shows, and the shapes that all its lines have had."""

    def __init__(self, tokens: list[str], shapes: list[str], kinds: list[int], run: int, line: int, raw: str | None):
        self.shown, self.shapes = list(tokens), list(shapes)
        self.words, self.attributes = kinds.count(WORD), kinds.count(ATTRIBUTE)
        self.run, self.line, self.raw, self.count = run, line, raw, 0
        self._fix()

    @classmethod
    def known(cls, shown, shapes, words: int, attributes: int, run: int, line: int, raw: str | None) -> "Template":
        """A template as it stood after some lines."""
        t = cls.__new__(cls)
        t.shown, t.shapes, t.words, t.attributes = list(shown), list(shapes), words, attributes
        t.run, t.line, t.raw, t.count = run, line, raw, 0
        t._fix()
        return t

    def _fix(self) -> None:
        """Which positions still show a literal, and the literals."""
        self.at = [i for i, t in enumerate(self.shown) if not is_wildcard(t)]
        self.pick = itemgetter(*self.at) if self.at else lambda _: ()
        self.literal = self.pick(self.shown)

    def similarity(self, shapes: list[str], kinds: list[int]) -> float:
        return similarity(self.shapes, self.words, self.attributes, shapes, kinds)

    def take(self, tokens: list[str], shapes: list[str]) -> tuple[bool, bool]:
        """Generalise by one more line; whether what it shows has changed, and whether it has lost a shape."""
        shown = self.pick(tokens) != self.literal
        if shown:
            for i in self.at:
                if tokens[i] != self.shown[i]:
                    key = attribute_key(tokens[i])
                    self.shown[i] = f"{key}=<*>" if key is not None and not tokens[i].endswith("=") else "<*>"
            self._fix()
        lost = False
        if self.shapes != shapes:
            for i, (a, b) in enumerate(zip(self.shapes, shapes, strict=True)):
                if a is not None and a != b:
                    self.shapes[i] = None
                    lost = True
        return shown, lost


SAME, LOST, MADE = range(3)


class Bucket:
    """The fold of one bucket.

    Templates are found by an index: for each position and shape, the templates that have
    or had it there, oldest first.  A template that takes a line agrees with it at no less
    than ``threshold`` of its words, so at ``least`` of them, and is met in all but the
    ``least`` - 1 longest of the line's lists; those that are met are compared.  An answer
    for a signature holds until its template loses a shape at which both agreed, or until a
    later template agrees more.
    """

    def __init__(self, threshold: float):
        self.threshold, self.templates = threshold, []
        self.known: dict[tuple, tuple[int, float, int, int]] = {}  # template, score, templates and losses of it when it was asked
        self.lost: list[int] = []
        self.index: dict[tuple[int, str], list[int]] = {}
        self.plain: dict[tuple, int] = {}  # templates without words and attributes: these never change
        self.fewest = 0  # words (or attributes) of the indexed template with the fewest
        self.events: list[tuple] | None = None

    def enter(self, t: Template) -> None:
        """One more template."""
        k = len(self.templates)
        self.templates.append(t)
        self.lost.append(0)
        n = t.words or t.attributes
        if n:
            self.fewest = min(self.fewest or n, n)
            for at in enumerate(t.shapes):
                if at[1] is not None:
                    self.index.setdefault(at, []).append(k)
        else:
            self.plain.setdefault(tuple(t.shapes), k)

    def best(self, shapes: list[str], kinds: list[int], since: int = 0) -> tuple[int | None, float]:
        """(the template that agrees most, the oldest of equals, of those from ``since`` on; how much)."""
        found, score = None, 0.0
        kind = WORD if WORD in kinds else ATTRIBUTE
        lists = [v for i, k in enumerate(kinds) if k == kind and (v := self.index.get((i, shapes[i]))) is not None and v[-1] >= since]
        least = max(1, ceil(self.threshold * self.fewest - 1e-9))
        if len(lists) >= least:
            if since:
                lists = [v[bisect_left(v, since) :] for v in lists]
            lists.sort(key=len)
            met: Iterator = chain.from_iterable(lists[: len(lists) - least + 1])
            for k, n in Counter(met).items():
                t = self.templates[k]
                if n + least - 1 >= max(self.threshold, score) * (t.words or t.attributes) - 1e-9:
                    s = t.similarity(shapes, kinds)
                    if s >= self.threshold and (s > score or s == score and k < found):
                        found, score = k, s
        if kind == ATTRIBUTE and self.plain and (k := self.plain.get(tuple(shapes))) is not None and k >= since and (score < 1.0 or k < found):
            found, score = k, 1.0
        return found, score

    def add(self, tokens: list[str], run: int, line: int, raw: str | None) -> tuple[int, int]:
        """(number of the template that takes the line, whether that has LOST a shape or was MADE)."""
        shapes, _, kinds, _ = signature(tokens)
        key, done, k = tuple(shapes), SAME, None
        answer = self.known.get(key)
        if answer is not None:
            k, score, seen, lost = answer
            if self.lost[k] != lost and self.templates[k].similarity(shapes, kinds) != score:
                k = None
            elif seen < len(self.templates):
                other, more = self.best(shapes, kinds, seen)
                if more > score:
                    k, score = other, more
        if k is None:
            k, score = self.best(shapes, kinds)
            if k is None:
                k, score, done = len(self.templates), 1.0, MADE
                self.enter(Template(tokens, shapes, kinds, run, line, raw))
        changed, lost = self.templates[k].take(tokens, shapes)
        if lost:
            self.lost[k] += 1
            done = LOST
        if self.events is not None and (done or changed):
            self.events.append((tokens, run, line, raw))
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self.known[key] = k, score, len(self.templates), self.lost[k]
        return k, done

    def fold(self, run: int, base: int, lists: list[list[str]], raws: list[str], codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The template's number of each line of a chunk."""
        place, met = np.full(len(lists), -1, np.int32), np.zeros(len(lists), bool)
        out, at, step = np.empty(len(codes), np.int32), 0, 256
        while at < len(codes):
            part = place[codes[at : at + step]]
            open_ = np.flatnonzero(part < 0)
            stop = int(open_[0]) if len(open_) else len(part)
            out[at : at + stop] = part[:stop]
            at += stop
            step = min(step * 4, CHUNK)
            if len(open_):
                c = codes[at]
                # the raw line is at hand for the first of equal ones alone
                k, done = self.add(lists[c], run, base + int(offsets[at]), None if met[c] else raws[c])
                if done == MADE:
                    place[:] = -1
                elif done == LOST:  # what others have taken, they still take
                    place[place == k] = -1
                met[c], place[c], out[at] = True, k, k
                at, step = at + 1, 256
        for k, n in enumerate(np.bincount(out, minlength=len(self.templates)).tolist()):
            self.templates[k].count += n
        return out


_OUT = "run_idx int, line_no long, last_line long, n long, raw string, tokens array<string>, offsets array<int>, first_run int, first_line long, bucket string, shapes array<string>, words int, attributes int"


def group_rows(bucket: str, run: int, base: int, lists, raws, codes, offsets, out, templates) -> Iterator[tuple]:
    """Rows of a chunk: the lines of the same tokens that the same template took."""
    both = codes.astype(np.int64) * len(templates) + out
    order = np.argsort(both, kind="stable")
    cuts = [0, *(np.flatnonzero(np.diff(both[order])) + 1).tolist(), len(order)]
    first = {}
    for a, b in zip(cuts, cuts[1:], strict=False):
        c = int(codes[order[a]])
        first[c] = min(first.get(c, len(codes)), int(order[a]))
    for a, b in zip(cuts, cuts[1:], strict=False):
        c, t, own = int(codes[order[a]]), templates[out[order[a]]], offsets[order[a:b]]
        raw = raws[c] if first[c] == order[a] else None
        yield run, base + int(own[0]), base + int(own[-1]), b - a, raw, lists[c], own - own[0], t.run, t.line, bucket, None, None, None


_NAMES = [f.split(" ")[0] for f in _OUT.split(", ")]
_KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.int32()]


def out_batch(rows) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES)


def _fold(threshold: float, groups: bool, limit: int):
    def run(batches: Iterator[pa.RecordBatch]):
        name, now, lines = None, None, 0

        def closed():
            if lines > limit:  # too much for one task: only its name
                return [(*[None] * 9, name, None, None, None)]
            return [(None, None, None, t.count, t.raw, t.shown, None, t.run, t.line, name, t.shapes, t.words, t.attributes) for t in now.templates] if now else []

        for b in batches:
            for bucket, r, base, lists, raws, codes, offsets in zip(*(iter(c) for c in b.columns), strict=True):
                if bucket.as_py() != name:
                    if rows := closed():
                        yield out_batch(rows)
                    name, now, lines = bucket.as_py(), Bucket(threshold), 0
                codes = np.frombuffer(codes.as_buffer(), "<i4")
                lines += len(codes)
                if lines > limit:
                    continue
                chunk = r.as_py(), base.as_py(), lists.as_py(), raws.as_py(), codes, np.frombuffer(offsets.as_buffer(), "<i4")
                out = now.fold(*chunk)
                if groups:
                    yield out_batch(group_rows(name, *chunk, out, now.templates))
        if rows := closed():
            yield out_batch(rows)

    return run


def _with_raw(out: DataFrame, lines: DataFrame) -> DataFrame:
    """Raw lines filled in where a chunk didn't have them, which takes a template that changed between equal lines."""
    own = lines.select(F.col("run_idx").cast("int").alias("_run"), F.col("line_no").cast("long").alias("_line"), F.coalesce(F.col("raw").cast("string"), F.lit("")).alias("raw"))
    at = (F.coalesce("run_idx", "first_run") == F.col("_run")) & (F.coalesce("line_no", "first_line") == F.col("_line"))
    filled = out.where("raw IS NULL").drop("raw").join(own, at).select(*out.columns)
    return durable(out.where("raw IS NOT NULL").unionByName(filled))


@dataclass
class Mined:
    """``groups``: lines of a chunk with the same tokens and template (first_run, first_line).
    ``clusters``: every template; cids count in the order of first lines."""

    groups: DataFrame
    clusters: DataFrame

    @property
    def assigned(self) -> DataFrame:
        """Every line (run_idx, line_no, tokens) with its cid."""
        return self.with_cid().select("run_idx", F.explode("offsets").alias("at"), "line_no", "tokens", "cid").select("run_idx", (F.col("line_no") + F.col("at")).alias("line_no"), "tokens", "cid")

    def with_cid(self) -> DataFrame:
        """``groups`` with their cid; a template that very many groups have is looked up by broadcast."""
        key = ["first_run", "first_line"]
        sizes = self.groups.groupBy(*key).agg(F.count("*").alias("_n"))
        ids = self.clusters.select("cid", "first_run", F.col("first_line_no").alias("first_line")).join(sizes, key)
        return lookup(self.groups, durable(ids), key)


def _mined(lines: DataFrame, threshold: float, masks, groups: bool, size: int, limit: int) -> DataFrame:
    packed = chunks(lines, masks, size)
    dealt = packed.repartition("bucket").sortWithinPartitions("bucket", "run_idx", "base")
    out = durable(dealt.mapInArrow(_fold(threshold, groups, limit), _OUT))
    if out.where("raw IS NULL").isEmpty():
        return out
    large = out.where("first_run IS NULL").select("bucket")  # of more than ``limit`` lines each, so few
    if not large.isEmpty():
        from driftlens.operators.ranges import fold_by_ranges

        large = durable(large)
        more = fold_by_ranges(packed.join(F.broadcast(large), "bucket", "left_semi"), threshold, groups, _OUT)
        out = durable(out.join(F.broadcast(large), "bucket", "left_anti").select(*out.columns).unionByName(more))
    return _with_raw(out, lines)


def _clusters(out: DataFrame) -> DataFrame:
    made = ranked(out.where("line_no IS NULL"), ["first_run", "first_line"], "cid")
    return made.select(
        "cid", F.col("tokens").alias("template_tokens"), F.array_join("tokens", " ").alias("template"), F.col("n").alias("count"),
        F.col("first_run"), F.col("first_line").alias("first_line_no"), F.col("raw").alias("first_raw"), "bucket", "shapes", "words", "attributes",
    )


def mine(lines: DataFrame, threshold: float = THRESHOLD, masks=(), size: int = CHUNK, limit: int = FOLDED) -> Mined:
    """Mine templates from ``lines`` (run_idx, line_no, raw) in the order of (run_idx, line_no).

    A bucket of more than ``limit`` lines is folded range by range (see ``ranges``), others by one task each.
    """
    out = _mined(lines, threshold, masks, True, size, limit)
    groups = out.where("line_no IS NOT NULL").select("run_idx", "line_no", "last_line", "n", "raw", "tokens", "offsets", "first_run", "first_line")
    return Mined(groups, _clusters(out))


def clusters(lines: DataFrame, threshold: float = THRESHOLD, masks=(), size: int = CHUNK, limit: int = FOLDED) -> DataFrame:
    """The templates of ``mine`` alone."""
    return _clusters(_mined(lines, threshold, masks, False, size, limit))


def templates(lines: DataFrame, n: int | None = 20, threshold: float = THRESHOLD, masks=()) -> DataFrame:
    """The most frequent templates, the older first of equals; all in cid order where ``n`` is None."""
    c = clusters(lines, threshold, masks).select("cid", "template", "count", "first_line_no", "first_raw")
    return c.orderBy("cid") if n is None else c.orderBy(F.desc("count"), "cid").limit(n)

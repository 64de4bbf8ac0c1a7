"""Splitting oversized items at natural boundaries, by content-defined chunking.

A rolling hash of the last GRAIN code points marks landmarks; the cut is the natural boundary nearest to the first landmark
between the least and the largest size. Both depend on nearby text only, so after an edit the cuts fall into step
again within a few pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chars import powers, rolling_hash

#: Characters per token, by the measure of the configuration.
CHARS_PER_TOKEN = 4
GRAIN = 32
#: Code points analysed at once.
SLICE = 1 << 20
#: Configurations that one call may have: each is applied to every text in one pass.
MAX_CONFIGS = 1000

LEVELS = ("forced", "word", "sentence", "paragraph", "section")
_HEADING = re.compile(r"(?:\A|(?<=[\r\n]))(#{1,6})[ \t]+([^\r\n]*[^\s#])")
#: White space as str.isspace has it (fixed values).
_SPACE = np.array([9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288], np.uint32)
_STOPS = np.array([ord(c) for c in ".!?…。:;"], np.uint32)
_CLOSERS = np.array([ord(c) for c in "\"')]”’»"], np.uint32)


@dataclass(frozen=True)
class Limits:
    """Sizes in code points: the largest piece, the overlap, and the least core of a piece (but for the last)."""

    config_id: str
    largest: int
    overlap: int
    least: int

    @classmethod
    def of(cls, config_id: str, max_tokens: int, overlap_tokens: int, min_tokens: int) -> Limits:
        largest = max_tokens * CHARS_PER_TOKEN + CHARS_PER_TOKEN - 1
        overlap = overlap_tokens * CHARS_PER_TOKEN if overlap_tokens < max_tokens else largest // 2
        return cls(config_id, largest, overlap, max(1, min(min_tokens * CHARS_PER_TOKEN, largest - overlap)))


class _Slice:
    """Boundaries by level and hashes of a stretch of code points; positions are relative to its start."""

    def __init__(self, x: np.ndarray, p):
        n = len(x)
        space = np.isin(x, _SPACE)
        cut = np.zeros(n + 1, bool)
        cut[1:n] = space[:-1] | space[1:]
        self.word = np.flatnonzero(cut)
        begins = np.flatnonzero(space[:-1] & ~space[1:]) + 1 if n > 1 else np.empty(0, np.int64)  # first characters of words
        last = np.maximum.accumulate(np.where(space, -1, np.arange(n)))[begins - 1] if len(begins) else begins
        breaks = (x == 10) | ((x == 13) & np.r_[x[1:] != 10, True]) | (x == 0x2029)
        lines = np.r_[0, np.cumsum(breaks)]
        n_breaks = lines[begins] - lines[np.maximum(last + 1, 0)]
        end = x[np.maximum(last, 0)]
        end = np.where(np.isin(end, _CLOSERS), x[np.maximum(last - 1, 0)], end)
        section = (x[begins] == 35) & (n_breaks > 0)
        self.section = begins[section]
        self.paragraph = begins[section | (n_breaks > 1)]
        self.sentence = begins[section | (n_breaks > 0) | np.isin(end, _STOPS)]
        self.hash = np.zeros(n + 1, np.uint64)  # of the GRAIN code points before a position
        if n >= GRAIN:
            self.hash[GRAIN:] = rolling_hash(x, GRAIN, p)


def _nearest(at: np.ndarray, mark: int, low: int, high: int, reach: int) -> int | None:
    i = int(np.searchsorted(at, mark))
    near = [int(v) for v in at[max(0, i - 1) : i + 1] if low <= v <= high and abs(int(v) - mark) <= reach]
    return min(near, key=lambda v: (abs(v - mark), v)) if near else None


def _next_cut(s: _Slice, c: int, k: Limits) -> tuple[int, int]:
    """The end of the piece whose core begins at c, and the level of the cut."""
    core = k.largest - k.overlap
    low, high = c + k.least, c + core
    room = high - low
    h = s.hash[low : high + 1]
    marks = np.flatnonzero(h < np.uint64(2**64 // max(2, room // 2 + 1)))
    mark = low + int(marks[0] if len(marks) else np.argmin(h))
    for level, at, reach in ((4, s.section, room), (3, s.paragraph, room // 2), (2, s.sentence, room // 3), (1, s.word, room)):
        if (cut := _nearest(at, mark, low, high, reach)) is not None:
            return cut, level
    i = int(np.searchsorted(s.word, c, "right"))
    j = int(np.searchsorted(s.word, high, "right"))
    if j > i:  # only before the least size
        return int(s.word[j - 1]), 1
    if j < len(s.word) and s.word[j] <= c + k.largest:  # an unbroken stretch takes the room of the overlap
        return int(s.word[j]), 1
    return high, 0


def split_text(x: np.ndarray, limits: list[Limits], p=None) -> Iterator[tuple[Limits, int, int, int, int, int]]:
    """(limits, number, start, core start, end, level of the cut at its end or -1 for the last) of each piece of a text."""
    n = len(x)
    p = p or powers(min(n, SLICE) + 1)
    first = _Slice(x[:SLICE], p) if any(n > k.largest for k in limits) else None
    for k in limits:
        s, base, c, number, previous = first, 0, 0, 0, 0
        while True:
            start = max(previous, c - k.overlap)
            if n - c <= k.largest - (c - start):
                yield k, number, start, c, n, -1
                break
            if c + k.largest + 1 > base + SLICE and base + SLICE < n:
                base = c
                s = _Slice(x[base : base + max(SLICE, 4 * k.largest)], p if k.largest * 4 <= SLICE else powers(4 * k.largest + 1))
            end, level = _next_cut(s, c - base, k)
            if not level and n - c <= k.largest:  # an unbroken stretch up to the end takes the room of the overlap
                yield k, number, max(start, n - k.largest), c, n, -1
                break
            end += base
            start = max(start, end - k.largest)
            yield k, number, start, c, end, level
            previous, c, number = start, end, number + 1


def _headings(text: str) -> list[tuple[int, list[str]]]:
    """Positions of headings with the path that holds from there on."""
    out, stack = [], []
    for m in _HEADING.finditer(text):
        level = len(m[1])
        stack = [h for h in stack if h[0] < level] + [(level, m[2].strip())]
        out.append((m.start(), [t for _, t in stack]))
    return out


_PIECE = "config_id string, number long, char_start long, core_start long, char_end long, n_chars long, section_path array<string>, cut string, oversized boolean"


def split(docs: DataFrame, configs: DataFrame, doc_id: str = "document_id", text: str = "body") -> DataFrame:
    """Ordered pieces of each text for each configuration: doc_id, version, and config_id, number (from 0), char_start,
    core_start, char_end (half open, code points), n_chars of the text, section_path, cut (what the piece ends at:
    'section', 'paragraph', 'sentence', 'word', 'forced' or 'end') and oversized (whether the text was above the limit).

    configs: config_id, max_tokens, overlap_tokens, min_tokens; a size is floor(code points / 4) tokens. A piece repeats
    the overlap_tokens before core_start (half the limit where overlap_tokens is max_tokens or more; less where the
    piece before is shorter, or where an unbroken stretch needs the room), and cores follow each other without a gap.
    A core has min_tokens or more (but at most what the limit leaves beside the overlap), except the last one and
    where an unbroken stretch leaves no boundary beyond them. Pieces are cut inside an unbroken stretch ('forced') only
    if that stretch alone exceeds the limit. A text within the limit, also an empty one, is one
    piece. Null ids or texts, and configurations with a null id or a max_tokens that is null or not positive, give
    nothing; null overlap or minimum counts as 0. Repeated rows give their pieces once; version, a hash of the text,
    tells different texts of one id apart.
    """
    rows = configs.where("config_id IS NOT NULL AND max_tokens > 0").select("config_id", "max_tokens", F.coalesce("overlap_tokens", F.lit(0)).alias("o"), F.coalesce("min_tokens", F.lit(0)).alias("m")).distinct().limit(MAX_CONFIGS + 1).collect()
    if len(rows) > MAX_CONFIGS:
        raise ValueError(f"more than {MAX_CONFIGS} configurations")
    limits = [Limits.of(str(r[0]), r[1], max(0, r[2]), max(0, r[3])) for r in sorted(rows)]
    kind = dict(docs.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = powers(SLICE + 1)
        types = [pa.string(), *[pa.int64()] * 5, pa.list_(pa.string()), pa.string(), pa.bool_()]
        names = [f.split()[0] for f in _PIECE.split(", ")]
        for b in batches:
            cols, at = [[] for _ in names], []

            def batch():
                return pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at, pa.int64())), b.column("version").take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, types))], names=["id", "version", *names])

            for i, body in enumerate(b.column("text").to_pylist()):
                x = np.frombuffer(body.encode("utf-32-le", "surrogatepass"), np.uint32)
                heads = _headings(body)
                places = np.array([h[0] for h in heads], np.int64)
                for k, number, start, core, end, level in split_text(x, limits, p):
                    h = int(np.searchsorted(places, core + len(body[core:end]) - len(body[core:end].lstrip()), "right"))
                    at.append(i)
                    for c, v in zip(cols, (k.config_id, number, start, core, end, len(body), heads[h - 1][1] if h else [], LEVELS[level] if level >= 0 else "end", len(body) > k.largest)):
                        c.append(v)
                if len(at) > 20_000:
                    yield batch()
                    cols, at = [[] for _ in names], []
            yield batch()

    d = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("version"), F.col(text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    pieces = d.mapInArrow(run, f"id {kind}, version long, {_PIECE}").dropDuplicates(["id", "version", "config_id", "number"])
    return pieces.withColumnRenamed("id", doc_id)


def cut_kinds(pieces: DataFrame, doc_id: str = "document_id") -> DataFrame:
    """config_id, doc_id and cut_kind of the oversized texts: 'forced' if any piece ends inside an unbroken stretch."""
    forced = F.when(F.max((F.col("cut") == "forced").cast("int")) == 1, "forced").otherwise("boundary")
    return pieces.where("oversized").groupBy("config_id", doc_id).agg(forced.alias("cut_kind"))

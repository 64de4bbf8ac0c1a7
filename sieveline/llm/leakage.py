"""Evaluation texts leaking into training text: prefix-filtered set join with exact verification.

A test item leaks if `size` consecutive words of it (all of it, if it is shorter) stand in a document. Each such window of
an item is a set of word shingles of which a leaking document must contain all; so its prefix in the order of rarity is
one shingle, the rarest over the whole corpus. Documents are joined with the windows on that shingle; the windows'
length and the shingle's position in it give the only stretch of the document that can match, which is compared word by
word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import small, staged
from .chars import BASE
from .sieve import POWER, filter_array, passes

SIZE, SHINGLE = 13, 5
#: Windows that may be broadcast with their words (about 300 bytes each); beyond it they are joined by shuffle.
MAX_PREFIXES = 200_000
#: Places per shingle in that shuffle, so that a passage that a third of all documents hold fills no single task.
SALTS = 8
#: Words worked on at once.
BLOCK = 1 << 19

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """Maximal runs of letters and digits, in lower case."""
    return _WORD.findall(text.lower())


def _hashes(words: list[str], known: dict[str, int]) -> np.ndarray:
    """64-bit hashes of words, the same in every process; known caches them."""
    import xxhash

    out = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        h = known.get(w)
        if h is None:
            if len(known) > 1_000_000:
                known.clear()
            h = known[w] = xxhash.xxh64_intdigest(w)
        out[i] = h
    return out


def shingle_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every `width` consecutive words, from their hashes."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = (out ^ h[i : i + n]) * np.uint64(BASE)
        out ^= out >> np.uint64(31)
    return out


def _windows(size: int, shingle: int):
    """Windows of items: item, window, length, words, and its shingles with their offset. Short items give one window
    with one shingle of all their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            cols = [[] for _ in range(7)]
            for item, text in zip(b.column("item").to_pylist(), b.column("text").to_pylist()):
                words = words_of(text)
                if not words:
                    continue
                length = min(size, len(words))
                width = min(shingle, length)
                s = shingle_hashes(_hashes(words, known), width).view(np.int64).tolist()
                for first in range(len(words) - length + 1):
                    joined = " ".join(words[first : first + length])
                    for offset in range(length - width + 1):
                        for c, v in zip(cols, (item, first, length, joined, width, s[first + offset], offset)):
                            c.append(v)
            types = (b.schema.field("item").type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["item", "first", "length", "words", "width", "shingle", "offset"])

    return run


def _scan(widths: list[int], wanted: np.ndarray, size: int, count: bool):
    """Shingles of documents that pass the filter. count: (shingle, n) per batch; else each with its place:
    (doc, shingle, width, words before it, words from it on), as far as a window can reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            docs = b.column("doc")
            for group in _blocks(b.column("text").to_pylist()):
                words = [w for _, ws in group for w in ws]
                if not words:
                    continue
                h = _hashes(words, known)
                ends = np.cumsum([len(ws) for _, ws in group])
                rows = np.array([i for i, _ in group])
                found = []
                for width in widths:
                    s = shingle_hashes(h, width).view(np.int64)
                    at = np.flatnonzero(passes(s, wanted))
                    of = np.searchsorted(ends, at, "right")
                    inside = at + width <= ends[of]
                    found.append((at[inside], of[inside], s[at[inside]], np.full(inside.sum(), width)))
                at, of, s, width = (np.concatenate(x) for x in zip(*found))
                if count:
                    o = np.lexsort((s, of))
                    s, of = s[o], of[o]
                    new = np.r_[True, (s[1:] != s[:-1]) | (of[1:] != of[:-1])][: len(s)]  # once per document
                    key, n = np.unique(s[new], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n, pa.int64())], names=["shingle", "n"])
                    continue
                begins = ends - np.array([len(ws) for _, ws in group])
                before = [" ".join(words[max(begins[o], a - size) : a]) for a, o in zip(at.tolist(), of.tolist())]
                after = [" ".join(words[a : min(ends[o], a + size)]) for a, o in zip(at.tolist(), of.tolist())]
                yield pa.RecordBatch.from_arrays([docs.take(pa.array(rows[of])), pa.array(s), pa.array(width, pa.int64()), pa.array(before, pa.string()), pa.array(after, pa.string())], names=["doc", "shingle", "width", "before", "after"])

    return run


def _blocks(texts: list[str]) -> Iterator[list[tuple[int, list[str]]]]:
    held, n = [], 0
    for i, t in enumerate(texts):
        ws = words_of(t)
        held.append((i, ws))
        n += len(ws)
        if n > BLOCK:
            yield held
            held, n = [], 0
    if held:
        yield held


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", size: int = SIZE, shingle: int = SHINGLE, filter_power: int = POWER, max_prefixes: int = MAX_PREFIXES) -> DataFrame:
    """doc_id, item_id and leaked_windows (distinct windows of the item found in the document), one row per pair.

    Words are maximal runs of letters and digits in lower case, so layout, punctuation and case don't matter. Documents
    and items with a null id, or a text that is null or without words, leak nothing; repeated rows count once. An item
    of fewer than `size` words leaks only as a whole. Texts are read whole. Columns not named are ignored.

    Only shingles that pass a filter of the items' shingles leave a task, the first time with their counts, the second
    time, through a filter of the windows' rarest shingles alone, with the words around them; joins on the shingle drop
    what passed by chance. The windows are broadcast if they are at most max_prefixes (checked), else shuffled, with
    the shingles of documents spread over SALTS places each.
    """
    d = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).where("doc IS NOT NULL AND text IS NOT NULL")
    i = items.select(F.col(item_id).alias("item"), F.col(text).alias("text")).where("item IS NOT NULL AND text IS NOT NULL").distinct()
    kind, doc_kind = dict(i.dtypes)["item"], dict(d.dtypes)["doc"]
    windows = i.mapInArrow(_windows(size, shingle), f"item {kind}, first long, length long, words string, width long, shingle long, offset long")
    windows = staged(windows.groupBy("item", "words", "length", "width", "shingle").agg(F.min("first").alias("first"), F.min("offset").alias("offset")), "leak-windows")
    shingles = windows.select("shingle").distinct()
    widths = sorted(r[0] for r in windows.select("width").distinct().collect())  # at most `shingle` numbers
    if not widths:
        return d.select(F.col("doc").alias(doc_id), F.lit(None).cast(kind).alias(item_id), F.lit(0).cast("long").alias("leaked_windows")).limit(0)

    counts = d.mapInArrow(_scan(widths, filter_array(shingles, filter_power), size, True), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    rarest = W.partitionBy("item", "words").orderBy("n", "shingle", "offset")
    ranked = windows.join(counts, "shingle", "left").fillna(0, ["n"]).withColumn("place", F.row_number().over(rarest))
    # A window with a shingle that no document has cannot occur: its rarest shingle has n = 0.
    prefix = staged(ranked.where("place = 1 AND n > 0").select("item", "words", "length", "width", "shingle", "offset"), "leak-prefixes")
    rare = filter_array(prefix.select("shingle").distinct(), filter_power)
    hits = d.mapInArrow(_scan(widths, rare, size, False), f"doc {doc_kind}, shingle long, width long, before string, after string")
    if small(prefix, max_prefixes):
        joined = hits.join(F.broadcast(prefix), ["shingle", "width"])
    else:
        spread = prefix.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = hits.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")).join(spread, ["shingle", "width", "salt"])
    before, after = F.when(F.col("before") == "", F.array().cast("array<string>")).otherwise(F.split("before", " ")), F.split("after", " ")
    # The bounds: enough words before and after the shingle for the window to lie there.
    fits = (F.size(before) >= F.col("offset")) & (F.size(after) >= F.col("length") - F.col("offset"))
    stretch = F.concat_ws(" ", F.slice(before, F.greatest(F.size(before) - F.col("offset").cast("int") + 1, F.lit(1)), F.col("offset").cast("int")), F.slice(after, F.lit(1), (F.col("length") - F.col("offset")).cast("int")))
    same = F.when(fits, stretch == F.col("words")).otherwise(False)
    return joined.where(same).groupBy(F.col("doc").alias(doc_id), F.col("item").alias(item_id)).agg(F.countDistinct("words").alias("leaked_windows"))

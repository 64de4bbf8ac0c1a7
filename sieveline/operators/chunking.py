"""Three ways to cut documents into chunks, and statistics of chunks.

The cutters are small functions over one body; Spark spreads the bodies. Offsets are 0-based, half open, and always
satisfy text == body[char_start:char_end].
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import token_estimate
from .analysis import distribution_percentiles

#: Characters of a chunk, of its overlap and of the least chunk, at four characters a token.
LARGEST, OVERLAP, LEAST = 1600, 200, 80
#: The path of text under no heading, and the sections whose blocks stay whole.
WHOLE, API, ENDPOINTS = ["Document"], "API Documentation", "Endpoints"
_NUMBER = re.compile(r"^\d+\.\s*")
_HEADING = re.compile(r"^(#{1,6})[ \t]+(.+?)\s*$", re.M)

Span = tuple[int, int]


def section_spans(body: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, path of headings) of the sections of a body; text before the first heading has the path of WHOLE."""
    marks = list(_HEADING.finditer(body))
    out, path = [], []
    if not marks or marks[0].start() > 0:
        out.append((0, marks[0].start() if marks else len(body), WHOLE))
    for m, after in zip(marks, [*marks[1:], None]):
        depth = len(m[1])
        path = [p for p in path if p[0] < depth] + [(depth, m[2])]
        out.append((m.start(), after.start() if after else len(body), [t for _, t in path]))
    return [s for s in out if body[s[0] : s[1]].strip()]


def _pieces(body: str, start: int, end: int, separator: str) -> list[Span]:
    """The stretch cut after each separator."""
    cuts, at = [start], start
    while (at := body.find(separator, at, end)) >= 0:
        at += len(separator)
        cuts.append(at)
    cuts.append(end)
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


def section_aware(body: str, category: str | None = None, largest: int = LARGEST, least: int = LEAST) -> list[tuple[int, int, list[str]]]:
    """One chunk per section; a longer section is filled up paragraph by paragraph, and a short rest joins the chunk before. The
    blocks of a section on endpoints stay whole in API documentation, each under its own heading; so does a body
    without a heading."""
    out = []
    sections = section_spans(body)
    for start, end, path in sections:
        whole = path == WHOLE and len(sections) == 1 or category == API and any(_NUMBER.sub("", p) == ENDPOINTS for p in path)
        held: list[Span] = []
        for a, b in _pieces(body, start, end, "\n\n") if end - start > largest and not whole else [(start, end)]:
            if held and b - held[-1][0] <= largest:
                held[-1] = (held[-1][0], b)
            else:
                held.append((a, b))
        if len(held) > 1 and held[-1][1] - held[-1][0] < least:
            held[-2:] = [(held[-2][0], held[-1][1])]
        out += [(a, b, path) for a, b in held]
    return out


def fixed_size(body: str, category: str | None = None, largest: int = LARGEST, overlap: int = OVERLAP, least: int = LEAST) -> list[tuple[int, int, list[str]]]:
    """Windows of at most largest characters that end after the last paragraph in them, if any ends there. The next one begins
    overlap characters before that end, or after the next paragraph that ends in the overlap. The last one ends with
    the body; a rest shorter than least joins the window before. The path is that of the section at the middle."""
    sections = section_spans(body)
    starts = [s[0] for s in sections]
    out: list[tuple[int, int, list[str]]] = []
    start, n = 0, len(body)
    while start < n:
        end = min(n, start + largest)
        if end < n and (at := body.rfind("\n\n", start, end)) >= 0:
            end = at + 2
        following = max(start + 1, end - overlap)
        if not body[start:end].strip():
            following = end
        elif end == n and out and end - start < least:
            out[-1] = (out[-1][0], n, out[-1][2])
        else:
            i = bisect_right(starts, (start + end) // 2) - 1
            out.append((start, end, (sections[i] if i >= 0 and (start + end) // 2 < sections[i][1] else sections[0])[2]))
        if end == n:
            break
        if following < end and (at := body.find("\n\n", max(0, following - 2), end - 1)) >= 0:
            following = at + 2
        start = following
    return out


def recursive(body: str, category: str | None = None, largest: int = LARGEST, separators: tuple[str, ...] = ("\n\n", ". ", "\n", " ")) -> list[tuple[int, int, list[str]]]:
    """Sections cut at the coarsest separator first, and only pieces that are still too long at the next; hard cuts last. A body
    without a heading is cut by fixed_size."""

    def cut(a: int, b: int, level: int) -> Iterator[Span]:
        if b - a <= largest:
            yield a, b
        elif level == len(separators):
            yield from ((x, min(b, x + largest)) for x in range(a, b, largest))
        else:
            for x, y in _pieces(body, a, b, separators[level]):
                yield from cut(x, y, level + 1)

    sections = section_spans(body)
    if [s[2] for s in sections] == [WHOLE]:
        return fixed_size(body, category, largest)
    return [(x, y, path) for a, b, path in sections for x, y in cut(a, b, 0)]


CUTTERS = {"section_aware": section_aware, "fixed_size": fixed_size, "recursive": recursive}


def chunk(docs: DataFrame, strategy: str = "section_aware") -> DataFrame:
    """chunk_id ('<document_id>-C<nnn>'), document_id, section_path, text, char_start, char_end, token_estimate, chunk_strategy of
    all bodies (document_id, body, and category if there is one), white-space pieces left out; null ids and bodies give
    nothing. One row per document."""
    cutter = CUTTERS[strategy]
    names = ["chunk_id", "document_id", "section_path", "text", "char_start", "char_end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, body, category in zip(*(b.column(c).to_pylist() for c in ("document_id", "body", "category"))):
                spans = [s for s in cutter(body, category) if body[s[0] : s[1]].strip()]
                rows += [(f"{doc}-C{i:03d}", doc, path, body[x:y], x, y) for i, (x, y, path) in enumerate(spans, 1)]
            cols = list(zip(*rows)) or [()] * 6
            types = (pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    category = F.col("category") if "category" in docs.columns else F.lit(None).cast("string").alias("category")
    rows = docs.where("document_id IS NOT NULL AND body IS NOT NULL").select("document_id", "body", category)
    cut = rows.mapInArrow(run, "chunk_id string, document_id string, section_path array<string>, text string, char_start int, char_end int")
    return cut.withColumn("token_estimate", token_estimate(F.col("text"))).withColumn("chunk_strategy", F.lit(strategy))


def chunk_statistics(chunks: DataFrame, *by: str) -> DataFrame:
    """Per group: chunks, documents, chunks with a table, tokens (mean, least, most) and chunks per document (mean, most)."""
    rows = chunks.where("chunk_id IS NOT NULL").withColumn("t", token_estimate(F.coalesce("text", F.lit(""))))
    table = F.col("text").contains("| --- |")
    docs = rows.groupBy(*by, "document_id").agg(F.count("*").alias("n"), F.sum("t").alias("s"), F.min("t").alias("lo"), F.max("t").alias("hi"), F.count(F.when(table, 1)).alias("n_table"))
    return docs.groupBy(*by).agg(
        F.sum("n").alias("n_chunks"), F.count("*").alias("n_documents"), F.sum("n_table").alias("n_table_chunks"), F.round(F.sum("s") / F.sum("n"), 4).alias("avg_tokens"),
        F.min("lo").alias("min_tokens"), F.max("hi").alias("max_tokens"), F.round(F.avg("n"), 4).alias("avg_chunks_per_document"), F.max("n").alias("max_chunks_per_document"),
    )


def token_percentiles(chunks: DataFrame, *by: str) -> DataFrame:
    rows = chunks.where("chunk_id IS NOT NULL").withColumn("t", token_estimate(F.coalesce("text", F.lit(""))))
    return distribution_percentiles(rows, "t", (25, 50, 75, 90, 95), *by)

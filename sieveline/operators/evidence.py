"""Where evidence lies: sections, quotations, offsets in intervals, and backward as-of matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def sections(docs: DataFrame, doc_id: str = "document_id", body: str = "body") -> DataFrame:
    """document_id, section_no, heading, char_start, char_end (0-based, half open): a body cut before each line that begins with
    '#'. What precedes the first heading is section 0 with a null heading."""
    parts = docs.where(F.col(doc_id).isNotNull() & F.col(body).isNotNull()).select(F.col(doc_id).alias("document_id"), F.posexplode(F.split(body, "\n#")).alias("section_no", "part"))
    parts = parts.withColumn("n", F.length("part") + F.when(F.col("section_no") > 0, 1).otherwise(0))
    before = F.coalesce(F.sum(F.col("n") + 1).over(W.partitionBy("document_id").orderBy("section_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    title = F.trim(F.regexp_extract("part", r"^#*[ \t]*([^\r\n]*)", 1))
    head = F.when((F.col("section_no") > 0) | F.col("part").startswith("#"), title)
    return parts.withColumn("char_start", before).select("document_id", "section_no", head.alias("heading"), "char_start", (F.col("char_start") + F.col("n")).alias("char_end"))


def locate_quotes(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """quotes (chunk_id, document_id, text) with found_at: the 0-based offset of the first occurrence of the text in the body of
    its document; null if the document or the text is not there."""
    one = docs.where("document_id IS NOT NULL").groupBy("document_id").agg(F.max("body").alias("body"))
    at = F.expr("CASE WHEN text <> '' THEN nullif(locate(text, body), 0) - 1 END")
    return quotes.join(one, "document_id", "left").select("chunk_id", "document_id", at.alias("found_at"))


def containing(points: DataFrame, intervals: DataFrame, last: bool = False) -> DataFrame:
    """points (document_id, point_id, at) with the first (or the last) interval (document_id, no, start, end) of the document that holds
    `at`, start <= at < end; points in none are kept with nulls. An equi-join on the document, bounded by the intervals of
    one document."""
    p, i = points.alias("p"), intervals.alias("i")
    hit = (F.col("p.document_id") == F.col("i.document_id")) & (F.col("i.start") <= F.col("p.at")) & (F.col("p.at") < F.col("i.end"))
    pick = F.max if last else F.min
    return p.join(i, hit, "left").groupBy("p.document_id", "p.point_id", "p.at").agg(pick(F.struct("i.no", "i.start", "i.end")).alias("x")).select("document_id", "point_id", "at", "x.no")


def as_of(points: DataFrame, marks: DataFrame) -> DataFrame:
    """points (key, point_id, at) with the mark (key, mark_id, at) of the same key that is nearest before or at `at`; if all are
    later, the first one. One sort of points and marks together, without joining every pair; ties take the smaller mark_id."""
    both = points.select("key", "at", "point_id", F.lit(None).cast("string").alias("mark_id"), F.lit(1).alias("side")).unionByName(marks.groupBy("key", "at").agg(F.min("mark_id").alias("mark_id")).select("key", "at", F.lit(None).cast(dict(points.dtypes)["point_id"]).alias("point_id"), "mark_id", F.lit(0).alias("side")))
    w = W.partitionBy("key").orderBy("at", "side")
    last = F.last("mark_id", True).over(w.rowsBetween(W.unboundedPreceding, 0))
    first = F.first("mark_id", True).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return both.select("key", "at", "point_id", "side", F.coalesce(last, first).alias("mark_id")).where("side = 1").drop("side")


def first_and_last(rows: DataFrame, key: str, at: str, value: str, order: str) -> DataFrame:
    """Per key: the value of its first and last row by (at, order), and the number of rows; combined before the shuffle."""
    by = F.struct(F.col(at), F.col(order))
    return rows.where(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(key).agg(F.min_by(value, by).alias("first_value"), F.max_by(value, by).alias("last_value"), F.count("*").alias("n"))


def first_rows(rows: DataFrame, key: str, order: list[str], n: int = 2) -> DataFrame:
    """The first n rows of each key."""
    w = W.partitionBy(key).orderBy(*order)
    return rows.where(F.col(key).isNotNull()).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def first_pairs(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """key, first, second: the first two rows of each key side by side; keys with one row have no pair."""
    two = first_rows(rows, key, order, 2).groupBy(key).agg(F.max(F.when(F.col("place") == 1, F.col(value))).alias("first"), F.max(F.when(F.col("place") == 2, F.col(value))).alias("second"))
    return two.where("second IS NOT NULL")


def replacements(docs: DataFrame, old: str, new: str, by: tuple[str, ...]) -> DataFrame:
    """document_id, replacement: for each row of status old the first (by document_id) live row of status new with the same values
    of by; null if there is none. Null values of by match nothing."""
    fresh = docs.where((F.col("status") == new) & F.col("deleted_at").isNull()).groupBy(*by).agg(F.min("document_id").alias("replacement"))
    return docs.where(F.col("status") == old).select("document_id", *by).join(fresh, list(by), "left").select("document_id", "replacement")


def chunks_at(points: DataFrame, chunks: DataFrame) -> DataFrame:
    """points (document_id, point_id, at) with the chunk (chunk_id, document_id, char_start, char_end) of the document that holds
    `at`, the first of several; where none does, the one that begins last before it, or else the first one."""
    marks = chunks.where("chunk_id IS NOT NULL AND document_id IS NOT NULL AND char_start IS NOT NULL")
    within = marks.where("char_end IS NOT NULL").select("document_id", F.struct(F.col("char_start").cast("long").alias("a"), "chunk_id").alias("no"), F.col("char_start").alias("start"), F.col("char_end").alias("end"))
    held = containing(points, within).select("point_id", F.col("no.chunk_id").alias("held"))
    near = as_of(points.select(F.col("document_id").alias("key"), "point_id", "at"), marks.select(F.col("document_id").alias("key"), F.col("chunk_id").alias("mark_id"), F.col("char_start").cast("long").alias("at")))
    return near.join(held, "point_id").select(F.col("key").alias("document_id"), "point_id", "at", F.coalesce("held", "mark_id").alias("chunk_id"))

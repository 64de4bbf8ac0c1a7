"""Markdown tables and numbered sections inside texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def table_rows(chunks: DataFrame) -> DataFrame:
    """chunk_id, line_no, cells, is_header of the lines of markdown tables in chunks (chunk_id, text). A line counts if it
    begins and ends with '|'; separator lines are left out; a header is the line before a separator."""
    lines = chunks.where("chunk_id IS NOT NULL AND text LIKE '%|%'").select("chunk_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line", F.trim(F.regexp_replace("line", "\r", "")))
    rows = lines.where("line RLIKE '^[|].*[|]$'").withColumn("separator", F.col("line").rlike("^[|]([ ]*:?-+:?[ ]*[|])+$"))
    w = W.partitionBy("chunk_id").orderBy("line_no")
    next_ = F.lead("separator").over(w) & (F.lead("line_no").over(w) == F.col("line_no") + 1)
    inner = F.expr("substring(line, 2, length(line) - 2)")
    cells = F.transform(F.split(inner, "[|]"), lambda c: F.trim(c))
    return rows.withColumn("is_header", F.coalesce(next_, F.lit(False))).where("NOT separator").select("chunk_id", "line_no", cells.alias("cells"), "is_header")


def fitted(rows: DataFrame) -> DataFrame:
    """table_rows with every row padded or cut to the width of its header (the last one above it); rows without one as they are."""
    w = W.partitionBy("chunk_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    width = F.last(F.when(F.col("is_header"), F.size("cells")), True).over(w)
    padded = F.slice(F.concat("cells", F.array_repeat(F.lit(""), F.greatest(width - F.size("cells"), F.lit(0)))), F.lit(1), width)
    return rows.withColumn("width", width).withColumn("cells", F.when(F.col("width").isNull(), F.col("cells")).otherwise(padded))


def numbered_sections(docs: DataFrame) -> DataFrame:
    """document_id, number, title of headings '<n>. <title>' that count 1, 2, 3, ... from the first line on: a fold over the lines
    that accepts only the next number, titles of at most five words that don't end in a stop. docs: document_id, body."""
    heading = F.regexp_extract_all(F.regexp_replace("body", "\r\n?", "\n"), F.lit(r"(?:\A|\n[ \t]*\n)(?:#+ )?(\d{1,4}\. [^\n]+)(?=\n|\z)"), 1)
    good = F.filter(heading, lambda h: ~h.endswith(".") & (F.size(F.split(F.regexp_replace(h, r"^\d+\. +", ""), " +")) <= 5))
    start = F.array().cast("array<string>")
    kept = F.aggregate(good, start, lambda acc, h: F.when(F.regexp_extract(h, r"^(\d+)\.", 1).cast("int") == F.size(acc) + 1, F.concat(acc, F.array(h))).otherwise(acc))
    rows = docs.where("document_id IS NOT NULL AND body IS NOT NULL").select("document_id", F.posexplode(kept).alias("i", "h"))
    return rows.select("document_id", (F.col("i") + 1).alias("number"), F.trim(F.regexp_replace("h", r"^\d+\. +", "")).alias("title"))

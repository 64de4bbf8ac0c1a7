"""Text functions as column expressions: tokens, question types, slots, citations and plans."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of identifiers, kept whole and taken out in this order.
ID_PATTERNS = (
    r"\b(HY-[A-Z]+-\d+)\b",
    r"\b(HR-POL-\d+|TRAVEL-POL-\d+|SEC-POL-\d+|API-DOC-\d+|SYS-DES-\d+|MTG-\d+)\b",
    r"\b(PRJ-[\w-]+)\b",
    r"\b(HYID|HYDeploy|HYMonitor|HYDataLake)\b",
    r"\b([A-Z]+-\d{3})\b",
    r"""(/api/v\d+[^\s,;"'<>]*)""",
    r"\b(v\d+(?:\.\d+)*)\b",
    r"\b(\d{4}-\d{2}-\d{2})\b",
    r"\b(ADR-[A-Z]+-\d+)\b",
)
#: What a text must contain, one of each, for the pattern in the same place to match at all: spares most texts most patterns.
ID_MARKS = (("HY-",), ("-POL-", "API-DOC-", "SYS-DES-", "MTG-"), ("PRJ-",), ("HY",), ("-",), ("/api/v",), ("v",), ("-",), ("ADR-",))
#: A run of what words consist of; one of a single character would be dropped anyway.
WORD = r"[a-z0-9_/-]{2,}"
#: Words that the index leaves out.
STOP_WORDS = (
    "a an the and or but in on at to for of with by from is are was were be been being have has had do does did will would "
    "shall should may might can could this that these those it its as if not no nor all any each few more most other such "
    "than too very so while when where which who whom what how then there here their they we our us you your he she him her "
    "his hers i me my mine"
).split()
#: Question types in the order in which they are tried; what matches none is single_hop.
QUESTION_TYPES = (
    ("temporal", r"\b(before|after|since|during|when|version|v\d|q[1-4]\s*20\d\d|20\d\d|overhaul|release)\b"),
    ("exception", r"\b(except|unless|exempt|waiver|special case|override|exempt)\b"),
    ("multi_hop", r"\b(same .{0,30} (as|used by)|which .{0,30} (use|require|follow) .{0,30} (same|documented|described))\b"),
    ("aggregation", r"\b(all|every|each|list|count|how many|enumerate)\b"),
    ("comparison", r"\b(compare|versus|vs\.?|difference|contrast|senior|junior|between)\b"),
)


def index_text(section_path: str = "section_path", text: str = "text") -> Column:
    """What is indexed of a chunk: its section path and its text."""
    return F.concat_ws(" ", F.concat_ws(" ", section_path), F.col(text))


#: Marks an identifier among raw tokens: it passes as it is.
_MARK = "\u0001"


def raw_tokens(text: Column) -> Column:
    """Identifiers (marked) and what lies between them, split into lower-case words: for finished_token, row by row."""
    found, rest = [], F.coalesce(text, F.lit(""))
    for pattern in ID_PATTERNS:
        found.append(F.transform(F.regexp_extract_all(rest, F.lit(pattern), 1), lambda t: F.concat(F.lit(_MARK), F.lower(t))))
        rest = F.regexp_replace(rest, pattern, " ")
    return F.concat(*found, F.regexp_extract_all(F.lower(rest), F.lit(WORD), 0))


def with_raw_tokens(df: DataFrame, text: Column, out: str = "raw") -> DataFrame:
    """df with raw_tokens(text) as a column. Each pattern is a step of its own, so every replacement runs once per text; as one
    expression the nested replacements would be evaluated again for each pattern."""
    df = df.withColumn("_rest", F.coalesce(text, F.lit("")))
    for i, (pattern, marks) in enumerate(zip(ID_PATTERNS, ID_MARKS)):
        may = functools.reduce(lambda a, b: a | b, (F.col("_rest").contains(m) for m in marks))
        ids = F.when(may, F.regexp_extract_all("_rest", F.lit(pattern), 1)).otherwise(F.array().cast("array<string>"))
        df = df.withColumn(f"_id{i}", ids).withColumn("_rest", F.when(may, F.regexp_replace("_rest", pattern, " ")).otherwise(F.col("_rest")))
    found = [f"_id{i}" for i in range(len(ID_PATTERNS))]
    marked = F.transform(F.concat(*found), lambda t: F.concat(F.lit(_MARK), F.lower(t)))
    return df.withColumn(out, F.concat(marked, F.regexp_extract_all(F.lower("_rest"), F.lit(WORD), 0))).drop("_rest", *found)


def finished_token(raw: Column, keep_stop_words: bool = False) -> Column:
    """The token of a raw token, or null for one that is dropped: words of one character, and stop words unless kept."""
    word = F.btrim(raw, F.lit("_-"))
    keep = F.length(word) >= 2
    if not keep_stop_words:
        keep = keep & ~word.isin(*STOP_WORDS)
    return F.when(raw.startswith(_MARK), F.substring(raw, 2, 1 << 30)).when(keep, word)


def tokens(text: Column, keep_stop_words: bool = False) -> Column:
    """Tokens of a text as an array: identifiers whole, then lower-case words of two characters or more, without stop
    words unless kept. Null or empty text gives an empty array."""
    return F.filter(F.transform(raw_tokens(text), lambda w: finished_token(w, keep_stop_words)), lambda w: w.isNotNull())


def question_type(text: Column) -> Column:
    """Type of a question by its wording; null for null."""
    out = F.when(text.isNull(), F.lit(None).cast("string"))
    for name, pattern in QUESTION_TYPES:
        out = out.when(F.lower(text).rlike(pattern), name)
    return out.otherwise("single_hop")


#: The question types whose wording is a signal, and its name.
SIGNALS = {"temporal": "temporal_reasoning", "exception": "exception_handling"}


def signals(text: Column) -> Column:
    """Names of the signals in the wording of a question, in order; none for null."""
    patterns = dict(QUESTION_TYPES)
    found = F.array(*(F.when(F.lower(text).rlike(patterns[kind]), name) for kind, name in SIGNALS.items()))
    return F.filter(found, lambda s: s.isNotNull())


def slots(text: Column) -> Column:
    """Names in braces, in order, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\{(\w+)\}"), 1))


def fill_slot(text: Column, name: str, value: Column) -> Column:
    return F.replace(text, F.lit("{" + name + "}"), value)


def citations(text: Column, count: Column) -> Column:
    """Numbers in square brackets from 1 to count, sorted, each once."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d{1,6})\]"), 1), lambda n: n.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda n: (n >= 1) & (n <= count))))


def outer_json(text: Column) -> Column:
    """From the first opening to the last closing brace; null if there is no such stretch."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def is_chunk_id(c: Column) -> Column:
    return c.rlike(r"^.+-C\d{3}$")


def parent_id(chunk_id: Column) -> Column:
    """The document part of a chunk id: what stands before its last '-C'."""
    return F.regexp_extract(chunk_id, r"^(.*)-C", 1)


def plain_name(c: Column) -> Column:
    """A name of a fixed set, however it is spelt: trimmed, in lower case, hyphens and blanks as '_'."""
    return F.translate(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), "- ", "__")

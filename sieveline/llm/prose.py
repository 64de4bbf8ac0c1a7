"""Per-document text quality statistics, fixed thresholds with a recorded reason per failure, and the kind of a text.

All measures are taken on whole columns: the texts of a block become a column of lines, the lines a column of words, and
counts go back to lines and texts by sums over groups. No text, line or word is looked at on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters measured at once (at least one text).
BLOCK = 1_500_000

# Patterns over lines and words (RE2, where \s and \b know ASCII only).
_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_NO_WORD = r"[^\p{L}\p{N}]+"
_BULLET = r"^(?:[-*•‣◦–+]|\[[ xX]\]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)])(?:\s|$)"
_COUNTED = r"^(?:\[[xX]\]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)])(?:\s|$)"  # a marker that holds a word of its own
_END = r"[.!?…。\"”»’)]$"
_INNER_END = r"[\p{Ll}\p{Lo}\p{N}][.!?…。][\"”»’)]*(?:\s|$)"
_ELLIPSIS = r"(?:\.\.\.|…|\.{4,}\s*\d*)$"
_UNIT = r"([.!?…])\s+"
_HEX = r"^(?:[0-9a-f]{2}|[0-9a-f]{8})$"
_GAP = r"\S {2,}\S"
_VERB_END = r"(?:다|까|요)[.?!]?(?:\s|$)"
_EDGES = ".,;:!?…()[]\"'«»“”„*_`"
#: Marks of text decoded with a wrong character set: replacement signs, pairs that UTF-8 leaves behind, signs inside words.
_BROKEN = r"\x{FFFD}|â€|[ÂÃ][\x{80}-\x{BF}]|\p{Ll}[ÂÃ]|\p{L}¤|¤\p{L}|\p{L}\?\p{L}"
_NOISE = r"[^\p{L}\p{N}\p{M}_\s\p{Z}.,;:!?'\"()\[\]\-/%#&€$£¥+*=|<>@§°·•–—„“”«»’…¿¡。、！？，：；（）「」『』・]|[~^`\\]"
_VOWELS = r"[aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýāēīōūąęőűаеёиоуыэюяіїє]"
_ALPHABETS = r"[a-zß-ɏа-џ]"
_NO_SPACES = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]"

STATS = (
    "n_chars long, n_words long, mean_word_length double, symbol_ratio double, alpha_word_ratio double, n_lines long, end_punct_ratio double, "
    "bullet_ratio double, ellipsis_ratio double, common_ratio double, repeat_ratio double, sentence_share double, list_share double, table_share double, junk_share double, entry_ratio double"
)


def _np(x) -> np.ndarray:
    return (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x).to_numpy(zero_copy_only=False)


def _has(x: pa.Array, pattern: str) -> np.ndarray:
    return _np(pc.match_substring_regex(x, pattern))


def _count(x: pa.Array, pattern: str) -> np.ndarray:
    return _np(pc.count_substring_regex(x, pattern)).astype(np.int64)


def _split(x: pa.Array, pattern: str | None) -> tuple[pa.Array, np.ndarray]:
    """The parts of each value between pattern (white space if None) that are not empty, and the place of the value each is from."""
    parts = pc.split_pattern_regex(x, pattern) if pattern else pc.utf8_split_whitespace(x)
    flat, of = pc.list_flatten(parts), _np(pc.list_parent_indices(parts))
    keep = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(keep), of[_np(keep)]


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=b > 0)


def _often(key: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value how often it stands in its text, and whether it is the first of its kind there."""
    both = of.astype(np.int64) * (int(key.max(initial=0)) + 1) + key
    _, first, back, n = np.unique(both, return_index=True, return_inverse=True, return_counts=True)
    new = np.zeros(len(key), bool)
    new[first] = True
    return n[back], new


def _codes(x: pa.Array) -> np.ndarray:
    return _np(x.dictionary_encode().indices).astype(np.int64)


def _repetition(n: int, texts: pa.Array, line: pa.Array, doc: np.ndarray, size: np.ndarray, word: pa.Array, word_doc: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Share of each text that is one fragment over and over: lines or sentences that stand more than three times, or so few
    different words that hardly any three of them follow each other anew."""
    n_lines, total = np.bincount(doc, minlength=n), np.bincount(doc, size, n)
    often, _ = _often(_codes(line), doc)
    by_line = np.where(n_lines >= 8, _share(np.bincount(doc, size * (often > 3), n), total), 0.0)
    unit, unit_doc = _split(pc.replace_substring_regex(texts, _UNIT, "\\1\n"), _BREAK)
    unit = pc.utf8_trim_whitespace(unit)
    chars = _np(pc.utf8_length(unit)).astype(np.int64)
    unit, unit_doc, chars = unit.filter(pa.array(chars > 0)), unit_doc[chars > 0], chars[chars > 0]
    n_units = np.bincount(unit_doc, minlength=n)
    often, new = _often(_codes(unit), unit_doc)
    by_unit = np.where(n_units >= 6, _share(np.bincount(unit_doc, chars * (often > 3), n), np.bincount(unit_doc, chars, n)), 0.0)
    varied = (n_units >= 6) & (np.bincount(unit_doc, new, n) > 0.5 * n_units)  # sentences that differ, if only in a number
    code = _codes(word)
    _, new = _often(code, word_doc)
    different = np.bincount(word_doc, new, n)
    few = (n_words >= 30) & ~varied & (different < 0.3 * n_words)
    poor = few & (different <= np.maximum(20, 0.03 * n_words)) & (different < 0.2 * n_words)
    at = np.flatnonzero(few[word_doc])
    if len(at) > 2:
        c, d = code[at].astype(np.uint64), word_doc[at]
        three = ((c[:-2] * np.uint64(1_000_003) + c[1:-1]) * np.uint64(1_000_003) + c[2:]) & np.uint64(0x7FFFFFFF)
        same = d[:-2] == d[2:]
        _, new = _often(three[same].astype(np.int64), d[:-2][same])
        poor |= few & (np.bincount(d[:-2][same], new, n) < 0.12 * n_words)
    return np.where(poor, 1.0, np.maximum(by_line, by_unit))


def text_statistics(texts: pa.Array, common: pa.Array) -> dict[str, np.ndarray]:
    """The columns of STATS for a column of texts without nulls; common: frequent words in lower case."""
    n = len(texts)
    parts = pc.split_pattern_regex(texts, _BREAK)
    line, doc = pc.utf8_trim_whitespace(pc.list_flatten(parts)), _np(pc.list_parent_indices(parts))
    size = _np(pc.utf8_length(line)).astype(np.int64)
    line, doc, size = line.filter(pa.array(size > 0)), doc[size > 0], size[size > 0]
    m = len(line)
    sums = lambda x: np.bincount(doc, x, n)
    n_lines = np.bincount(doc, minlength=n)

    # Words of lines.
    lower = pc.utf8_lower(line)
    word, at = _split(lower, _NO_WORD)
    length = _np(pc.utf8_length(word)).astype(np.int64)
    all_words, letters = np.bincount(at, minlength=m), np.bincount(at, length, m)
    frequent = np.bincount(at, _np(pc.is_in(word, common)), m)
    digits = np.bincount(at, _np(pc.utf8_is_digit(word)), m)
    spaced, spaced_at = _split(lower, None)
    solid = np.bincount(spaced_at, _np(pc.utf8_length(spaced)), m)
    n_words = sums(all_words).astype(np.int64)

    # A marker like 'a)' is no word of its entry.
    bullet, counted = _has(line, _BULLET), _has(line, _COUNTED)
    words = all_words - counted
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.empty(0, np.int64)
    marker = np.zeros(m, np.int64)
    marker[at[first]] = length[first]
    marker *= counted
    signs = np.where(bullet, np.maximum(size - solid, 1), size - solid)
    core = size - signs - _count(line, r"\.") - np.where(bullet, 1, 0) - marker
    symbols = np.where(core > 0, 1 - (letters - marker) / np.maximum(core, 1), 0.0)

    # Sentences, by frequent words or verb endings; where a text has next to none of these words, by words that can be spoken and stops.
    known = np.bincount(spaced_at, _np(pc.is_in(pc.utf8_trim(spaced, _EDGES), common)), m)
    n_spaced = np.bincount(spaced_at, minlength=m) - bullet
    share = _share(known, n_spaced)
    regular = (words >= 4) & (symbols <= 0.25)
    sentence = regular & ((share >= 0.15) | ((share > 0) | (words >= 5)) & _has(line, _VERB_END))
    common_ratio = _share(sums(frequent), n_words)
    foreign = common_ratio < 0.05
    if foreign.any():
        i = np.flatnonzero(foreign[doc])
        some, low = line.take(pa.array(i)), lower.take(pa.array(i))
        alphabet, vowels, of_words = _count(low, _ALPHABETS), _count(low, _VOWELS), words[i] + _count(low, _NO_SPACES) // 2
        spoken = (alphabet < 0.5 * letters[i]) | (vowels >= 0.27 * alphabet) & (vowels <= 0.65 * alphabet)
        running = spoken & (symbols[i] <= 0.25) & (of_words >= 4) & (digits[i] <= 0.3 * words[i])
        stops = np.bincount(doc[i], running * _count(some, _INNER_END), n)
        enough = (stops > 0) & (stops * 40 >= np.bincount(doc[i], running * of_words, n))
        sentence[i] |= running & enough[doc[i]]

    # Cells: rows with empty cells have fewer gaps, so only commas, which sentences have too, must be as many in each row.
    commas = _count(line, ",")
    separator = np.select(
        [(_count(line, r"\|") >= 2) & (_count(line, " > ") == 0), _has(line, r"\t"), _has(line, _GAP), _has(line, ";."), commas > 0],
        [1, 2, 3, 4, 10 + commas],
        0,
    )
    rows, _ = _often(separator, doc)
    cells = (separator > 0) & (rows >= 3) & (rows >= 0.3 * n_lines[doc]) & ~bullet & ~sentence

    marked = (sums(bullet) >= 3) & (sums(bullet) >= 0.3 * n_lines)  # markers that recur tell entries of any length
    entry = bullet & marked[doc]
    damage = (3 * _count(line, _BROKEN) + 2 * _count(line, _NOISE)) / np.maximum(solid, 1)
    pairs = np.flatnonzero((length == 2) | (length == 8))
    dump = (words > 9) & (np.bincount(at[pairs], _has(word.take(pa.array(pairs)), _HEX), m) > 0.8 * words)
    no_entry = ~entry & ((size > 200) | (words > 14)) | (words <= 0) | _has(line, r"\S{40}")
    kind = np.select([dump, cells, (symbols > 0.4) | (damage > 0.12), sentence, no_entry], [4, 3, 4, 1, 4], 2)
    # A short line after a sentence line that ends in a stop is the end of a wrapped sentence.
    after = np.r_[False, (kind[:-1] == 1) & (doc[1:] == doc[:-1])] if m else np.empty(0, bool)
    ends = _has(line, _END)
    kind[~bullet & after & (words < 4) & (size < 60) & ends & ((kind == 2) | (kind == 4) & (words > 0) & (symbols <= 0.4))] = 1

    total = sums(size)
    of = lambda k: _share(sums(size * (kind == k)), total)
    all_solid = sums(solid)
    return {
        "n_chars": _np(pc.utf8_length(texts)).astype(np.int64), "n_words": n_words, "mean_word_length": _share(sums(letters), n_words), "symbol_ratio": _share(all_solid - sums(letters), all_solid),
        "alpha_word_ratio": _share(n_words - sums(digits), n_words), "n_lines": n_lines.astype(np.int64), "end_punct_ratio": _share(sums(ends), n_lines), "bullet_ratio": _share(sums(bullet), n_lines),
        "ellipsis_ratio": _share(sums(_has(line, _ELLIPSIS)), n_lines), "common_ratio": common_ratio, "repeat_ratio": _repetition(n, texts, line, doc, size, word, doc[at], n_words),
        "sentence_share": of(1), "list_share": of(2), "table_share": of(3), "junk_share": of(4), "entry_ratio": _share(sums((kind == 2) | (kind == 3)), n_lines),
    }


def _blocks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Stretches of a column of about BLOCK bytes, at least one text each."""
    upto = np.cumsum(_np(pc.binary_length(texts)).astype(np.int64))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + BLOCK, "right")))
        yield a, b
        a = b


def statistics(docs: DataFrame, common_words: DataFrame, id_: str = "doc_id", text: str = "text", max_words: int = 100_000) -> DataFrame:
    """id and the columns of STATS, one row per row of docs with a text that is neither null nor blank.

    A word is a maximal run of letters and digits, a line what stands between line breaks and is not blank. The shares
    tell how many of the characters stand in lines that are sentences, list entries, rows of cells, or matter that
    nobody reads; repeat_ratio how many belong to fragments that come again and again.

    common_words (word) is a short list; more than max_words distinct words are refused, as the list goes to every task.
    """
    words = [r[0] for r in common_words.select(F.lower("word")).where("word IS NOT NULL").distinct().limit(max_words + 1).collect()]
    if len(words) > max_words:
        raise ValueError(f"more than {max_words} common words")
    types = {c.split()[0]: pa.int64() if c.endswith("long") else pa.float64() for c in STATS.split(", ")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = pa.array(words, pa.string())
        for b in batches:
            ids, texts = b.column("id"), b.column("text")
            for x, y in _blocks(texts):
                part = texts.slice(x, y - x)
                values = text_statistics(part, common)
                yield pa.RecordBatch.from_arrays([ids.slice(x, y - x), *(pa.array(values[c], t) for c, t in types.items())], names=["id", *types])

    kind = dict(docs.dtypes)[id_]
    rows = docs.select(F.col(id_).alias("id"), F.col(text).alias("text")).where(F.col("text").rlike(r"(?U)\S"))
    return rows.mapInArrow(run, f"id {kind}, {STATS}").withColumnRenamed("id", id_)


def _failed(rules: dict[str, Column]) -> Column:
    return F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())), lambda r: r.isNotNull())


def failed_rules() -> Column:
    """Names of the failed rules; thresholds as published for large web corpora (word count, word length, symbols,
    bullets, ellipses, alphabetic words, stop words, terminal punctuation, repetition)."""
    return _failed(
        {
            "word_count": ~F.col("n_words").between(50, 100_000),
            "mean_word_length": ~F.col("mean_word_length").between(3, 10),
            "symbol_ratio": F.col("symbol_ratio") > 0.1,
            "bullet_lines": F.col("bullet_ratio") > 0.9,
            "ellipsis_lines": F.col("ellipsis_ratio") > 0.3,
            "alphabetic_words": F.col("alpha_word_ratio") < 0.8,
            "stop_words": F.col("common_ratio") * F.col("n_words") < 2,
            "line_punctuation": F.col("end_punct_ratio") < 0.12,
            "repetition": F.col("repeat_ratio") > 0.2,
        }
    )


def majority_rules(sentence: float = 0.5, repeated: float = 0.6) -> Column:
    """Why a text is no prose, by fixed thresholds on its shares: 'mostly_repeated' if one fragment makes up most of it; if less
    than half of it are sentences, one of 'mostly_junk', 'mostly_table' and 'mostly_list', whichever share is the largest."""
    few, largest = F.col("sentence_share") < sentence, F.greatest("junk_share", "table_share", "list_share")
    junk, table = F.col("junk_share") == largest, F.col("table_share") == largest
    return _failed({"mostly_repeated": F.col("repeat_ratio") >= repeated, "mostly_junk": few & junk, "mostly_table": few & ~junk & table, "mostly_list": few & ~junk & ~table})


def text_kind(reasons: str = "failed_rules") -> Column:
    """The kind that the recorded reasons stand for."""
    has = lambda r: F.array_contains(reasons, r)
    return F.when(has("mostly_repeated") | has("mostly_junk"), "junk").when(has("mostly_table"), "table").when(has("mostly_list"), "list").otherwise("prose")


def judged(docs: DataFrame, common_words: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """statistics with failed_rules (one reason per failed rule, published rules first) and text_kind, read from these reasons."""
    reasons = F.concat(failed_rules(), majority_rules())
    return statistics(docs, common_words, id_, text).withColumn("failed_rules", reasons).withColumn("text_kind", text_kind())

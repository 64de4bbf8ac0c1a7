"""Operators for training data against brute force and on edge cases."""

import math
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sieveline.llm import chars, leakage, mixing, pairs, prose, sieve, spans, splitting, topn

rnd = random.Random(7)

# --- top n ------------------------------------------------------------------------------------------------------------

ROWS = "run string, q string, item string, score double, rank int, position string"


def best(rows, n):
    """By brute force: first n distinct items of each group."""
    key = lambda r: (-r[3], math.inf if r[4] is None else r[4], r[2])
    out, seen = {}, set()
    for r in sorted((r for r in rows if None not in r[:4] and not math.isnan(r[3])), key=key):
        g = out.setdefault(r[:2], [])
        if (r[:3]) not in seen and len(g) < n:
            seen.add(r[:3])
            g.append(r[2])
    return {(*g, i, c) for g, cs in out.items() for i, c in enumerate(cs, 1)}


def top_rows(n):
    out = []
    for i in range(n):
        q = "hot" if rnd.random() < 0.5 else f"q{rnd.randrange(60)}"
        score = rnd.choice([None, float("nan"), -1.0, 0.0, 0.5, 0.5, 1.0, float(rnd.randrange(4))])
        out.append((f"r{rnd.randrange(2)}" if i % 50 else None, q, f"c{rnd.randrange(300)}" if i % 37 else None, score, rnd.choice([None, 1, 2, 3]), "x"))
    return out + out[:100]


@pytest.mark.parametrize("min_rows, broadcast", [(4, 1000), (4, 0), (10**9, 1000)])
def test_top_n_equals_brute_force(spark, min_rows, broadcast):
    rows = top_rows(3000)
    got = topn.top_n(spark.createDataFrame(rows, ROWS).repartition(5), ["run", "q"], "item", "score", "rank", 3, min_rows=min_rows, broadcast_rows=broadcast)
    assert {(r["run"], r["q"], r["position"], r["item"]) for r in got.collect()} == best(rows, 3)


def test_top_n_all_tied_and_empty(spark):
    rows = [("r", "q", f"c{i:05d}", 1.0, None, "x") for i in range(2000)]
    df = spark.createDataFrame(rows, ROWS)
    got = topn.top_n(df, ["run", "q"], "item", "score", "rank", 3, min_rows=4)
    assert [r["item"] for r in got.orderBy("position").collect()] == ["c00000", "c00001", "c00002"]
    assert topn.top_n(df.limit(0), ["run", "q"], "item", "score", "rank", 3).count() == 0


def test_local_bounds_cut_their_buffer(monkeypatch):
    monkeypatch.setattr(topn, "BUFFER_ROWS", 100)
    batches = [pa.RecordBatch.from_arrays([pa.array([1] * 50), pa.array([2] * 50), pa.array([float(b * 50 + i) for i in range(50)]), pa.array([1] * 50), pa.array([f"c{b}-{i}" for i in range(50)])], ["g1", "g2", "score", "place", "item"]) for b in range(20)]
    out = pa.Table.from_batches(list(topn._local_bounds(3, 64)(iter(batches)))).to_pylist()
    assert [(r["score"], r["item"]) for r in out] == [(997.0, "c19-47")]


# --- shared spans -----------------------------------------------------------------------------------------------------


def words(n):
    return " ".join("".join(rnd.choice("abcdéfg한") for _ in range(rnd.randrange(2, 9))) for _ in range(n))


def shared_brute(records, length):
    at = {}
    for kind, id_, owner, text in records:
        if None not in (id_, owner, text):
            for i in range(len(text) - length + 1):
                at.setdefault((kind, text[i : i + length]), {}).setdefault((id_, owner), set()).add(i)
    pairs_, covered = set(), {}
    for (kind, _), who in at.items():
        if len({o for _, o in who}) > 1:
            for (a, oa), pos in who.items():
                covered.setdefault((kind, a), set()).update(x for i in pos for x in range(i, i + length))
                pairs_.update((kind, *sorted((a, b))) for b, ob in who if ob != oa and a != b)
    return pairs_, {k: len(v) for k, v in covered.items()}


def span_records():
    common = [words(30) for _ in range(4)]
    boiler = words(9)[:48]
    out = []
    for i in range(60):
        text = words(20) + boiler + words(25)
        for c in common:
            if rnd.random() < 0.15:
                a = rnd.randrange(len(c) // 3)
                text += c[a:] + words(5)
        out.append((rnd.choice(["document", "chunk"]), f"d{i}", f"o{i % 50}", text))
    a = words(40)
    out += [("chunk", "same1", "s", a), ("chunk", "same2", "s", a), ("document", "x", "x", "ab" * 300), ("document", "y", "y", "ab" * 200), ("document", "n", "n", None), ("document", None, "n", a), ("document", "e", "e", "")]
    return out + out[:5]


@pytest.mark.parametrize("max_strings, block", [(2048, 512), (4, 1), (0, 512)])
def test_shared_spans_equal_brute_force(spark, monkeypatch, max_strings, block):
    monkeypatch.setattr(spans, "FURTHER", ((15, spans.FURTHER[0][1]), (10, spans.FURTHER[1][1])))
    monkeypatch.setattr(spans, "PAIR_BLOCK", block)
    rows = span_records()
    df = spark.createDataFrame(rows, "record_type string, id string, owner string, text string").withColumn("bucket", F.lit("clash"))
    s = spans.find_shared(df, 60, 20, max_strings)
    pairs_, covered = shared_brute(rows, 60)
    assert {tuple(r) for r in spans.shared_pairs(s).collect()} == pairs_ and pairs_
    amounts = {(r["record_type"], r["id"]): r["shared_chars"] for r in spans.shared_amounts(df, s).collect()}
    assert {k: v for k, v in amounts.items() if v} == covered
    assert ("document", "e") in amounts and ("document", "n") not in amounts


def test_shared_spans_of_nothing(spark):
    df = spark.createDataFrame([], "record_type string, id string, owner string, text string")
    s = spans.find_shared(df)
    assert spans.shared_pairs(s).count() == spans.shared_amounts(df, s).count() == 0


def test_long_texts_in_segments(monkeypatch):
    monkeypatch.setattr(chars, "BLOCK", 500)
    text = "".join(rnd.choice("abcdefgh") for _ in range(5000))
    b = pa.RecordBatch.from_pydict({"record_type": ["d", "d"], "id": ["i", "k"], "owner_hash": [1, 2], "version": [1, 2], "text": [text, "x" * 199]})
    out = pa.Table.from_batches(list(spans._super_kmers(200, 64)(iter([b])))).to_pylist()
    assert sorted(w for r in out for w in range(r["at"], r["at"] + r["windows"])) == list(range(4801))


def test_rolling_hash_and_minimum():
    x = np.array([ord(c) for c in "abcabcabd" * 50], np.uint32)
    h = chars.rolling_hash(x, 4, chars.powers(len(x)))
    text = "abcabcabd" * 50
    by = {}
    for i, v in enumerate(h.tolist()):
        assert by.setdefault(text[i : i + 4], v) == v
    assert len(set(by.values())) == len(by)
    assert chars.sliding_min(h, 7).tolist() == [min(h[i : i + 7].tolist()) for i in range(len(h) - 6)]


# --- splitting --------------------------------------------------------------------------------------------------------

CONFIGS = [("A", 100, 10, 5), ("B", 30, 0, 2), ("C", 40, 400, None), ("bad", 0, 1, 1), ("none", None, 1, 1), (None, 5, 1, 1)]
CFG = "config_id string, max_tokens int, overlap_tokens int, min_tokens int"


def prose_text(n):
    parts = []
    for i in range(n):
        parts.append(f"{'#' * (1 + i % 3)} Head {i}" if i % 5 == 0 else " ".join(words(rnd.randrange(3, 12)).capitalize() + "." for _ in range(rnd.randrange(1, 6))))
    return rnd.choice(["\n\n", "\r\n\r\n"]).join(parts)


def test_pieces_keep_limits_and_overlap(spark):
    bodies = {"p": prose_text(60), "one": "short", "empty": "", "blank": " " * 900, "run": "x" * 700, "mixed": "word " * 30 + "y" * 500 + " tail" * 40, "edge": "z" * 403 + " a" * 300, "ko": "한국어 문장입니다. " * 90}
    docs = spark.createDataFrame([*bodies.items(), ("p", bodies["p"]), ("null", None), (None, "x")], "document_id string, body string").withColumn("number", F.lit(1))
    cfg = spark.createDataFrame(CONFIGS, CFG)
    pieces = splitting.split(docs, cfg)
    by = {}
    for r in pieces.collect():
        by.setdefault((r["config_id"], r["document_id"]), []).append(r)
    limits = {c: splitting.Limits.of(c, m, o, s or 0) for c, m, o, s in CONFIGS[:3]}
    assert set(by) == {(c, d) for c in limits for d in bodies}
    for (c, d), rows in by.items():
        body, k = bodies[d], limits[c]
        rows.sort(key=lambda r: r["number"])
        assert [r["number"] for r in rows] == list(range(len(rows)))
        assert rows[0]["core_start"] == rows[0]["char_start"] == 0 and rows[-1]["char_end"] == len(body)
        for a, b in zip(rows, rows[1:]):
            assert b["core_start"] == a["char_end"] > a["core_start"]
            assert b["core_start"] - b["char_start"] == min(k.overlap, b["core_start"] - a["char_start"], k.largest - (b["char_end"] - b["core_start"]))
        assert all(r["char_end"] - r["char_start"] <= k.largest for r in rows)
        stretch = max((len(w) for w in body.split()), default=0)
        assert any(r["cut"] == "forced" for r in rows) == (stretch > k.largest), (c, d)
    kinds = {(r["config_id"], r["document_id"]): r["cut_kind"] for r in splitting.cut_kinds(pieces).collect()}
    assert set(kinds) == {(c, d) for c, k in limits.items() for d, b in bodies.items() if len(b) // 4 > (k.largest - 3) // 4}
    assert splitting.split(docs.limit(0), cfg).count() == splitting.split(docs, cfg.limit(0)).count() == 0


@pytest.mark.parametrize("overlap", [0, 10, 50])
@pytest.mark.parametrize("slice_size", [None, 4000])
def test_an_unbroken_end_within_the_limit_is_not_cut(monkeypatch, overlap, slice_size):
    if slice_size:
        monkeypatch.setattr(splitting, "SLICE", slice_size)
    k = splitting.Limits.of("A", 100, overlap, 5)
    for n_before in (1, 40, 2000):
        before = "word " * n_before
        for length in (k.largest - k.overlap, k.largest - k.overlap + 1, k.largest - 1, k.largest, k.largest + 1):
            body = before + "x" * length
            pieces = [t[1:] for t in splitting.split_text(np.frombuffer(body.encode("utf-32-le"), np.uint32), [k])]
            assert any(level == 0 for *_, level in pieces) == (length > k.largest), (n_before, length)
            assert pieces[0][2] == 0 and pieces[-1][3] == len(body) and all(a[3] == b[2] for a, b in zip(pieces, pieces[1:]))
            assert all(end - start <= k.largest and k.overlap >= core - start >= 0 for _, start, core, end, _ in pieces)
            if length <= k.largest < len(body):  # the last piece repeats as much as its room allows
                _, start, core, end, _ = pieces[-1]
                assert core - start == min(k.overlap, core - pieces[-2][1], k.largest - (end - core))


def test_the_least_size_is_obeyed():
    codes = np.frombuffer(prose_text(300).encode("utf-32-le"), np.uint32)
    sizes = {}
    for least in (0, 20, 60, 1_000_000):
        k = splitting.Limits.of("A", 100, 10, least)
        assert k.least == max(1, min(4 * least, k.largest - k.overlap))
        cores = [end - core for _, _, _, core, end, level in splitting.split_text(codes, [k]) if level >= 0]
        sizes[least] = sum(cores) / len(cores)
        if least < 1000:
            assert min(cores) >= k.least
    assert sizes[0] < sizes[20] < sizes[60] < sizes[1_000_000]
    assert splitting.Limits.of("A", 100, 90, 0).overlap == 360 and splitting.Limits.of("A", 100, 100, 0).overlap == 201


def test_an_edit_changes_only_nearby_pieces():
    body = prose_text(300)
    k = splitting.Limits.of("A", 100, 0, 5)
    codes = lambda s: np.frombuffer(s.encode("utf-32-le"), np.uint32)
    cut = lambda s: {s[c:e] for _, _, _, c, e, _ in splitting.split_text(codes(s), [k])}
    at = body.index(" ", len(body) // 2)
    before, after = cut(body), cut(body[:at] + " an inserted clause," + body[at:])
    assert len(before - after) <= 6 < len(before) / 4


def test_slices_of_a_very_long_text_change_nothing_but_their_size(monkeypatch):
    body = prose_text(200)
    k = [splitting.Limits.of("A", 100, 10, 5)]
    x = np.frombuffer(body.encode("utf-32-le"), np.uint32)
    whole = [t[1:] for t in splitting.split_text(x, k)]
    monkeypatch.setattr(splitting, "SLICE", 4000)
    parts = [t[1:] for t in splitting.split_text(x, k)]
    assert parts[0] == whole[0] and parts[-1][3] == len(x) and all(e - s <= k[0].largest for _, s, _, e, _ in parts)
    assert len({p[3] for p in parts} & {p[3] for p in whole}) > 0.9 * len(whole)


# --- pairs ------------------------------------------------------------------------------------------------------------

PROMPT = "Which travel rules apply to Verona after 2024-01-02?"
DONE = "Keyword search finds the code best, so lexical matching should lead. "
CASES = [
    ("ok1", '{"selected_strategy":"bm25","confidence":0.7,"reasoning":"' + DONE.strip() + '"}', None),
    ("ok2", "```json\n{\"reasoning\": \"" + DONE.strip() + "\"}\n```", None),
    ("ok3", DONE + "Strategy: hybrid.", None),
    ("ok4", '{"reasoning": "The user can decline a waiver; refusal clauses are spread over tickets, so lexical matching should lead."}\n\nLet me know if more detail helps.', None),
    ("ok5", '{"reasoning": "Keyword search finds the code best, so lexical matching should lead"}', None),
    ("ok6", '{"reasoning": "I am sorry to add load, but this one needs both indexes since the code refuses to appear, so lexical matching should lead."}', None),
    ("ok7", '{"reasoning": "The question \\"' + PROMPT + '\\" asks for one fact, so lexical matching should lead."}', None),
    *((f"empty{i}", r, "empty") for i, r in enumerate([None, "", " \n\t", "{}", "[]", '""', "null", "```json\n```", "```\n\n```", '{"selected_strategy": null, "confidence": null, "reasoning": " "}'])),
    ("cut1", '{"selected_strategy": "bm25", "reason', "truncated"),
    ("cut2", '```json\n{"reasoning": "Keyword search"}', "truncated"),
    ("cut3", '{"reasoning": "Keyword search finds the code best, so lexical mat"}', "truncated"),
    ("cut4", "Keyword search finds the code best because the", "truncated"),
    ("no1", "I'm sorry, but I can't help with this request.", "refusal"),
    ("no2", '{"selected_strategy": null, "reasoning": "No answer will be given, as the content is restricted."}', "refusal"),
    ("no3", "Leider kann ich diese Anfrage nicht beantworten.", "refusal"),
    ("no4", "Désolé, je ne peux pas répondre à cette demande.", "refusal"),
    ("no5", "Lo siento, no se me permite tratar este tema.", "refusal"),
    ("no6", "죄송하지만 이 요청에는 답변할 수 없습니다.", "refusal"),
    ("copy1", PROMPT, "copy"),
    ("copy2", f"{PROMPT} {PROMPT}", "copy"),
    ("copy3", '{"selected_strategy":"bm25","reasoning":"> ' + PROMPT.upper() + '"}', "copy"),
    ("lang1", "Weil der Plan ohne Nummer beschrieben wird, ist die Suche nach Bedeutung besser und das ist der Grund.", "language"),
    ("lang2", "질문에 코드가 직접 나오므로 정확한 단어 검색이 가장 알맞습니다.", "language"),
]
COMMON = [("en", w) for w in "the of and to in a is that for it as on so but this one since".split()] + [("de", w) for w in "der die das und ist nach wird ohne weil".split()] + [("fr", w) for w in "le la les de et est pour".split()] + [("ko", "그리고")]


def test_pairs(spark):
    rows = [(i, PROMPT, r, "en") for i, r, _ in CASES] + [("nolang", None, "Weil der Plan ohne Nummer ist, wird das nach der Suche.", None), (None, PROMPT, "", "en")]
    rows += [(f"more{i}", PROMPT, DONE + f"The site {i} is known.", "en") for i in range(5)] + rows[:3]
    got = pairs.defects(spark.createDataFrame(rows, "id string, prompt string, response string, lang string").withColumn("defect", F.lit(1)), spark.createDataFrame(COMMON, "lang string, word string"))
    assert {r["id"]: r["defect"] for r in got.collect()} == {i: d for i, _, d in CASES if d}
    empty = spark.createDataFrame([], "id string, prompt string, response string, lang string")
    assert pairs.defects(empty, spark.createDataFrame([], "lang string, word string")).count() == 0


@pytest.mark.parametrize(
    "text, open_",
    [
        ('The plan is: {"selected_strategy": "bm25", "reasoning": "Keyword search.', "{j"), ("He said “keyword search finds the code best.", "“"), ("Searches (for example by keyword.", "("),
        ("```\na b\n``` and then ```\nc d", "fence"), ("<ul><li>one</li>\nKeyword search is best.", "<ul"), ("Steps:\n- one\n- two\n- ", "list"), ("1. one\n2. two\n3.", "list"), ("| a | b |\n| c | d", "row"),
        ("It is **bold", "**"), ("Use `code", "`"), ("Er sagte „so geht es.", "„"), ("Il dit « oui.", "«"), ('She said "no and left.', '"'), ("An array [1, 2.", "["),
        ('{"a": "x } \\" y", "b": [1, {"c": "two words"}]} tail', None), ("```json\n{\"a\": \"b\"}\n```\nDone.", None), ("ok {id} and [1] (fine) \"yes\" 5\" pipe :( a) b)", None), ("Er sagte „so“ und »so«, « oui », “no”.", None),
        ("<p>one<br>two <b>three</b>", None), ("It's `a[0` and **b** and 2 ** 3.", None), ("The answer is\n42.", None), ("| a | b |\n| c | d |", None), ("", None),
    ],
)
def test_structure(text, open_):
    got = pairs.structure(text)[0]
    assert got[:1] == ([open_] if open_ else []), got


def tiled_brute(answer, prompt, least=2):
    free = [True] * len(answer)
    least = min(least, len(prompt))
    runs = {tuple(prompt[a:b]) for a in range(len(prompt)) for b in range(a + 1, len(prompt) + 1)}
    for n in range(len(answer), least - 1, -1):
        for i in range(len(answer) - n + 1):
            if all(free[i : i + n]) and tuple(answer[i : i + n]) in runs:
                free[i : i + n] = [False] * n
    return 1 - sum(free) / len(answer)


def test_tiling_equals_brute_force_and_is_fast():
    import time

    for _ in range(200):
        a, p = ([rnd.choice("abcd") for _ in range(rnd.randrange(1, 25))] for _ in range(2))
        assert pairs.tiled(a, p)[0] == pytest.approx(tiled_brute(a, p))
    p = [rnd.choice("abcdefgh") for _ in range(20_000)]
    began = time.time()
    assert pairs.tiled(p + p, p) == (1.0, 1.0)
    assert time.time() - began < 5


LONG = " It is about the travel desk and the rules that hold for Verona, which are written down in the file of the team." * 5


@pytest.mark.parametrize(
    "text, refused",
    [
        ("I'm sorry, but I can't help with this request." + LONG, True), ("I'm sorry. Thank you for asking. The topic is restricted. I cannot answer it." + LONG, True), (LONG + " I can't help with more.", False),
        ("Mi dispiace, non posso rispondere a questa domanda.", True), ("К сожалению, я не могу ответить на этот вопрос.", True), ("Desculpe, não posso responder a esta pergunta.", True), ("Helaas kan ik deze vraag niet beantwoorden.", True),
        ("The user can decline a waiver. The team will help with the rest.", False),
    ],
)
def test_refusals_of_any_length_and_language(text, refused):
    assert pairs.refuses(text) == refused


def test_answers_without_a_stop_in_a_small_corpus(spark):
    rows = [("whole", "The travel policy covers hotels in Verona"), ("function word", "The travel policy covers hotels in the"), ("others have stops", "The policy is old. It covers hotels in Ver"), ("longer word known", "All of it covers hot"), ("tail", "- one\n- two\n-")]
    df = spark.createDataFrame([(i, "What is covered by it?", r, "en") for i, r in rows] + [("polish", "Co to jest?", "Wszystko dobrze działa.", "pl")], "id string, prompt string, response string, lang string")
    got = {r["id"]: (r["defect"], r["judged"]) for r in pairs.assessed(df, spark.createDataFrame(COMMON, "lang string, word string")).collect()}
    assert {k for k, v in got.items() if v[0] == "truncated"} == {"function word", "others have stops", "longer word known", "tail"}
    assert got["whole"] == (None, True) and got["polish"] == (None, False)


def test_pushdown_parser_and_tiling():
    assert pairs.parse('{"a": "x } \\" y", "b": [1, {"c": "two words"}]} tail')[:2] == (True, True)
    assert not pairs.parse('{"a": [1, 2}')[0] and not pairs.parse('{"a": "x')[0]
    assert pairs.tiled("a b c x".split(), "a b c".split()) == (0.75, 1.0)


# --- leakage ----------------------------------------------------------------------------------------------------------


def leak_brute(docs, items, size=13):
    out = set()
    for i, t in items:
        w = leakage.words_of(t or "")
        n = min(size, len(w))
        grams = {tuple(w[a : a + n]) for a in range(len(w) - n + 1)} if n else set()
        for d, text in docs:
            v = leakage.words_of(text or "")
            if d is not None and i is not None and any(tuple(v[a : a + n]) in grams for a in range(len(v) - n + 1)) and n:
                out.add((d, i))
    return out


@pytest.mark.parametrize("power, most", [(21, 10**6), (6, 0)])
def test_leaks_equal_brute_force(spark, power, most):
    vocabulary = [f"w{i}" for i in range(40)] + ["Straße", "한국"]
    say = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(rnd.choice([1, 3, 5, 9, 13, 20, 40])))) for i in range(25)] + [(90, ""), (91, None), (92, "—!"), (None, "w1 w2"), (3, "w1")]
    docs = []
    for d in range(80):
        parts = say(60)
        if d % 2:
            w = leakage.words_of(rnd.choice(items[:25])[1])
            a = rnd.randrange(max(1, len(w) - 12))
            parts[30:30] = w[a : a + rnd.choice([12, 13, 16])]
        docs.append((d, rnd.choice([" ", " | ", "_\n* "]).join(p.upper() if d % 3 == 0 else p for p in parts)))
    docs += [(200, None), (201, ""), (202, " ... "), (None, "w1 w2 w3"), docs[1]]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("shingle", F.lit(1))
    got = leakage.leaks(d, spark.createDataFrame(items, "item_id long, text string"), filter_power=power, max_prefixes=most)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == leak_brute(docs, items)


def test_every_shingle_passes_its_filter(spark):
    held = [rnd.getrandbits(64) - 2**63 for _ in range(500)]
    bits = sieve.filter_array(spark.createDataFrame([(x,) for x in held], "shingle long"))
    assert sieve.passes(np.array(held, np.int64), bits).all()
    assert sieve.passes(np.array([rnd.getrandbits(64) - 2**63 for _ in range(10_000)], np.int64), bits).mean() < 0.05
    keys = spark.createDataFrame([(x,) for x in held], "k long")
    for power in (21, 6):
        got = {r["k"] for r in sieve.sifted(keys.unionByName(spark.range(5000).select(F.xxhash64("id").alias("k"))).withColumn("at", F.lit(1)), "k", keys, power).collect()}
        assert got >= set(held) and (power == 6 or len(got) < 700)
    assert sieve.sifted(keys, "k", keys.limit(0)).count() == 0
    assert len(sieve.filter_array(spark.createDataFrame([(x,) for x in held], "shingle long"), 6)) == 64


def test_leaks_of_nothing(spark):
    d, i = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert leakage.leaks(d.limit(0), i).count() == leakage.leaks(d, i.limit(0)).count() == 0
    assert leakage.leaks(d, i).count() == 1


# --- mixing -----------------------------------------------------------------------------------------------------------


def test_mixture_reaches_its_shares(spark):
    rows = [(i, rnd.choices(["a", "b", "c", "x"], [70, 20, 5, 5])[0], rnd.randrange(20, 400)) for i in range(3000)] + [(9000, "a", None), (9001, "a", 0), (None, "a", 50), (9002, None, 50), (7, "b", 100)]
    targets = [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 4), ("absent", 0.0, 1)]
    df = spark.createDataFrame(rows, "id long, source string, n_tokens long").withColumn("block", F.lit("clash"))
    uses, report = mixing.mix(df, spark.createDataFrame(targets, "source string, target_share double, max_repeats int"), 128)
    uses = uses.collect()
    share, cap = {s: t for s, t, _ in targets}, {s: c for s, _, c in targets}
    total = sum(r["n_tokens"] * r["repeats"] for r in uses)
    for r in report.collect():
        given = sum(u["n_tokens"] * u["repeats"] for u in uses if u["source"] == r["source"])
        assert given == r["tokens_used"] and abs(given / total - share[r["source"]]) < 0.02 and r["most_repeats"] <= cap[r["source"]]
    assert all(u["source"] in "abc" and u["repeats"] <= cap[u["source"]] for u in uses)


def test_mixture_beyond_its_caps_and_of_nothing(spark):
    df = spark.createDataFrame([(i, "a" if i % 2 else "b", 100) for i in range(100)], "id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2), ("none", 0.1, 1)], "source string, target_share double, max_repeats int")
    report = {r["source"]: r for r in mixing.mix(df, targets, 100, total_tokens=10**6)[1].collect()}
    assert (report["a"]["tokens_used"], report["b"]["tokens_used"], report["none"]["tokens_used"]) == (5000, 10000, 0)
    assert mixing.mix(df.limit(0), targets)[0].count() == 0 and mixing.mix(df, targets.limit(0))[1].count() == 0


def test_schedule_is_even(spark):
    got = mixing.schedule([("a", 3.0), ("b", 1.0)], 1000, spark).collect()
    assert sorted(r["slot"] for r in got) == list(range(1000))
    for s, w in (("a", 0.75), ("b", 0.25)):
        slots = sorted(r["slot"] for r in got if r["source"] == s)
        assert sorted(r["nth"] for r in got if r["source"] == s) == list(range(len(slots)))
        assert all(abs(sum(x < n for x in slots) - w * n) < 3 for n in range(0, 1001, 50))


@pytest.mark.skipif(not os.path.exists(mixing.VOCABULARY), reason="no vocabulary")
def test_token_counts(spark):
    got = spark.createDataFrame([("hello world",), (None,), ("",)], "t string").select(mixing.token_count("t")).collect()
    assert [r[0] for r in got] == [2, None, 0]


# --- prose ------------------------------------------------------------------------------------------------------------

class Sentences:
    def format(self, i):
        w = ["".join(rnd.choice("bdklmnrst") + rnd.choice("aeiou") for _ in range(3)) for _ in range(9)]
        return f"The {w[0]} moved the {w[1]} to the {w[2]} because it was {w[3]}, and that is the {w[4]} of the {w[5]}. It has to be {w[6]} by the {w[7]} of {w[8]} {i}. "


SENTENCE = Sentences()
TEXTS = {
    "prose": "".join(SENTENCE.format(i) for i in range(8)),
    "lines": "\n".join(SENTENCE.format(i).strip(". ") for i in range(9)),
    "wrapped": "".join(SENTENCE.format(i) for i in range(6)).replace(" the ", "\nthe "),
    "bullets of sentences": "\n".join("- " + SENTENCE.format(i) for i in range(6)),
    "list": "\n".join(f"{i}. retention label {i}" for i in range(20)),
    "contents": "\n".join(f"1.{i} Retention label ....... {i}" for i in range(20)),
    "lettered list with a sentence": SENTENCE.format(0) + "\n" + "\n".join(f"{c}) budget line {c}x" for c in "abcdefghijklmnopqrst"),
    "table": "| a | b | c |\n| --- | --- | --- |\n" + "\n".join(f"| x{i} | {i} | {i * 7} |" for i in range(20)),
    "csv": "code,limit,site\n" + "\n".join(f"REQ-{i},{i * 31},site{i}" for i in range(20)),
    "columns": "\n".join(f"REQ-{i}   {i * 31}   site{i}" for i in range(20)),
    "noise": "".join(rnd.choice("abc%$#~^*!;&19 ") for _ in range(900)),
    "letters": " ".join("".join(rnd.choice("asdfghjkl") for _ in range(7)) for _ in range(90)),
    "base64": "\n".join("".join(rnd.choice("abcdefABCDEF0123+/") for _ in range(76)) for _ in range(12)),
    "navigation": " | ".join(rnd.choice(["Home", "Menu", "Login", "Next"]) for _ in range(90)),
    "again": "The plan of the team is in the file. " * 40,
    "dump": "\n".join(f"{i:08x}  " + " ".join(f"{rnd.randrange(256):02x}" for _ in range(16)) for i in range(0, 160, 16)),
    "short noise": "lgf ghdgdk jsj fjklsgs gjhsdjldjhs gfsjfj dhjalfj kakgjkfaa gadf jlfajl gljljdla hslgaf aafjs fgh gkl",
    "empty cells": "code;limit;site\n" + "\n".join(f"n/a;{i};;" for i in range(20)),
    "code": "".join(f"function a{i}(t,e){{return t[{i}]&&e.u||!{i}}};" for i in range(60)),
}
KIND = {k: "list" for k in ("list", "contents", "lettered list with a sentence")} | {k: "table" for k in ("table", "csv", "columns", "empty cells")} | {k: "junk" for k in ("noise", "letters", "base64", "navigation", "again", "code", "dump", "short noise")}


def test_text_kinds(spark):
    rows = [*TEXTS.items(), ("null", None), ("empty", ""), ("blank", " \n\t"), ("one", "x")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").withColumn("n_words", F.lit("clash"))
    common = spark.createDataFrame([("en", w) for w in "the to of it is and that by was has be because".split()] + [(None, None)], "lang string, word string")
    got = {r["doc_id"]: r for r in prose.judged(docs, common).collect()}
    assert set(got) == set(TEXTS) | {"one"}
    assert {k: got[k]["text_kind"] for k in TEXTS} == {k: KIND.get(k, "prose") for k in TEXTS}
    assert got["prose"]["failed_rules"] == [] and "word_count" in got["one"]["failed_rules"] and "repetition" in got["again"]["failed_rules"]
    p = got["prose"]
    ws = leakage.words_of(TEXTS["prose"])
    assert p["n_words"] == len(ws) and p["mean_word_length"] == pytest.approx(sum(map(len, ws)) / len(ws)) and p["end_punct_ratio"] == 1.0
    assert prose.judged(docs.limit(0), common).count() == 0


def kinds_of(texts):
    common = pa.array("the to of it is and that by was has be because".split())
    got = prose.text_statistics(pa.array(texts), common)
    return [max(("sentence", "list", "table", "junk"), key=lambda k: got[f"{k}_share"][i]) for i in range(len(texts))], got


def test_kinds_do_not_depend_on_size():
    word = lambda: "".join(rnd.choice("bdklmnrst") + rnd.choice("aeiou") for _ in range(3))
    wrapped = lambda n: "\n".join(f"It was the {word()} of the {word()} that is to be\n{word()} {word()}." for _ in range(n))
    wide = "\n".join("| " + " | ".join(f"{word()} {i}" for i in range(60)) + " |" for _ in range(10))
    entries = "\n".join("- " + " ".join(word() for _ in range(40)) for _ in range(10))
    kinds, got = kinds_of([wrapped(20), wrapped(300), wide, entries, entries.replace("- ", ""), "a. " + " ".join(word() for _ in range(200))])
    assert kinds == ["sentence", "sentence", "table", "list", "junk", "junk"]
    assert all(got[f"{k}_share"][i] == 1.0 for i, k in enumerate(kinds)) and min(map(len, wide.split("\n"))) > 400


def test_sentences_of_any_language_and_legal_signs():
    kinds, _ = kinds_of([
        "\n".join(f"Das regelt § {n} BGB und § {n + 1} HGB in dem Vertrag der Firma." for n in range(430, 440)),
        "Il fornitore consegna i materiali ogni lunedì mattina. Nessuno controlla le bolle prima di mezzogiorno. Domani arrivano altri tecnici dalla sede centrale.",
        "Поставщик привозит материалы каждое утро. Никто не проверяет накладные до обеда. Завтра приедут другие техники из главного офиса.",
        "Поставщик привозит материалы каждое\nутро понедельника. Никто не проверяет все\nнакладные до обеда. Завтра приедут другие\nтехники из главного офиса.",
        "供应商每天早上送来材料。中午之前没有人检查送货单。明天总部会派其他技术人员过来。",
        "lgf ghdgdk jsj fjklsgs gjhsdjl. Dhjalfj kakgjkf gadf jlfjl gljljdl. Hslgf fjs fgh gkl jhg dfgh.",
    ])
    assert kinds == ["sentence"] * 5 + ["junk"]


def test_a_column_gives_what_its_texts_give_alone():
    common = pa.array("the to of it is and that by was has be because".split())
    together = prose.text_statistics(pa.array(list(TEXTS.values())), common)
    for i, t in enumerate(TEXTS.values()):
        alone = prose.text_statistics(pa.array([t]), common)
        assert {k: v[0] for k, v in alone.items()} == {k: v[i] for k, v in together.items()}

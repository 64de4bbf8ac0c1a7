"""Broken prompt and response pairs: empty, truncated, refusing, copying and wrong-language answers.

A pushdown parser follows fences, brackets, quotations, lists and markup anywhere in a response to tell a whole one from one
that breaks off, and to take the wording out of its envelope; the wording is then held against refusal grammars, greedy
string tiling with the prompt, and the scripts and function words of languages. Only where an answer ends without a
stop and its own structure leaves the matter open, the sentences of all responses break the tie.
"""

from __future__ import annotations

import heapq
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged

_CLOSER = {"{": "}", "[": "]", "(": ")", "“": "”", "«": "»", "„": "“", "»": "«"}
_OPENER = {"}": "{", "]": "[", ")": "("}
#: Words that stand for no content when they stand alone.
_NOTHING = ("null", "none", "nil", "undefined", "nan", "n/a")
#: Elements of markup that have to be closed (fixed values); others, like 'br' or 'li', may stay open.
_ELEMENTS = frozenset("a b i u em strong code pre ul ol dl table thead tbody blockquote div span section article h1 h2 h3 h4 h5 h6 html body answer think".split())
_TOKEN = re.compile(r"```|\\.|\*\*|[`\"“”„«»()\[\]{}]|<(/?)([A-Za-z][A-Za-z0-9]*)(?:\s[^<>]*)?(/?)>", re.S)
_STRING_END = re.compile(r"[^\"\\]*(?:\\.[^\"\\]*)*\"", re.S)
_FENCE = re.compile(r"```[\w+-]*[ \t]*(?:\r?\n|\Z)?")
_MARKER = re.compile(r"(?m)^[ \t]*(?:>+|[-*•]|#{1,6}|\d{1,3}[.)])[ \t]+")
_LAST_MARKER = re.compile(r"(?:\A|\n)[ \t]*(?:([-*•+])|(\d{1,3})[.)])[ \t]*\Z")
_WORD = re.compile(r"[^\W_]+")
_LABEL = re.compile(r"^\W*\w{1,12}:\s+")
_STOP = re.compile(r"[.!?…。][\"'”»“)\]*_`]*$")
_INNER_STOP = re.compile(r"[.!?…。][\"'”»)\]]*\s+\S")
_SENTENCE = re.compile(r"(?<=[.!?…。])[\"'”»)\]]*\s+|[\r\n]+")
_QUOTED = re.compile(r"\"[^\"]*\"|“[^”]*”|«[^»]*»|„[^“”]*[“”]")
_HANGUL = re.compile(r"[가-힣]+")
_CYRILLIC = re.compile(r"[Ѐ-ӿ]+")
_LATIN = re.compile(r"[A-Za-zÀ-ɏ]+")

_ACTS = r"(?:help|answer|assist|respond|repl(?:y|ying)|provid|choos|discuss|decid|decision|comply|complet|fulfil|process|share|support|give|offer|select|recommend|continu|engag|address|advis|comment)\w*"
_CANNOT = r"(?:can(?:no|')t|can not|won't|will not|(?:am|are|'m|'re) (?:not able|unable|not allowed|not permitted|not authori[sz]ed|not in a position) to|must (?:decline|refuse)|have to (?:decline|refuse)|(?:respectfully )?(?:decline|refuse) to|prefer not to|may not|'d rather not|would rather not)"
#: Per language, what declines to answer: someone who answers, cannot or will not, and the act of answering (fixed wording).
GRAMMARS: dict[str, tuple[str, ...]] = {
    "en": (
        rf"\b(?:i|we)\b(?:'m|'re)?[^.!?;]{{0,20}}?{_CANNOT}\b[^.!?;]{{0,40}}?\b{_ACTS}",
        rf"\b(?:i|we)(?:'m|'re) (?:not able|unable|not allowed|not permitted) to\b[^.!?;]{{0,40}}?\b{_ACTS}",
        r"\b(?:outside|beyond|not) (?:what|something|anything) (?:i|we)\b[^.!?;]{0,15}\b(?:allowed|permitted|able|can|authori[sz]ed)\b",
        r"\bno (?:answer|response|decision|information) (?:will|can|may) be (?:given|provided|made|shared)\b",
        r"\b(?:request|question|topic)\b[^.!?;]{0,20}\b(?:cannot|can't|can not|will not|won't) be (?:answered|processed|completed|discussed)\b",
    ),
    "de": (
        r"\b(?:kann|darf|möchte|werde|will|muss)\s+(?:ich|wir)\b[^.!?;]{0,60}?\b(?:nicht|keine[nrsm]?|ablehnen)\b",
        r"\b(?:ich|wir)\s+(?:kann|können|darf|dürfen|möchte|möchten|werde|werden|bin|sind|muss)\b[^.!?;]{0,60}?\b(?:nicht|keine[nrsm]?|ablehnen)\b",
    ),
    "fr": (
        r"\b(?:je|nous)\s+(?:ne|n['’])\s?(?:peux|puis|pouvons|suis|sommes|souhaite|dois|vais)\b[^.!?;]{0,25}?\b(?:pas|répondre|autorisé|en mesure)\b",
        r"\bje (?:dois|préfère) (?:refuser|décliner)\b|\baucune réponse ne (?:sera|peut être)\b|\bil ne m['’]est pas (?:possible|permis)\b",
    ),
    "es": (
        r"\bno (?:puedo|podemos|debo|voy a|me es posible|se me permite|se nos permite|estoy autorizad\w|tengo permitido|tengo permiso)\b[^.!?;]{0,60}?\b(?:respond|trat|ayud|contest|ofrec|proporcion|d[ae]r|comparti|proces|habl|eleg|decid|facilit)\w*",
        r"\bno se (?:dará|puede dar|ofrecerá) (?:ninguna )?respuesta\b|\bdebo (?:negarme|declinar|rechazar)\b",
    ),
    "ko": (r"(?:답변|안내|도와|도움|제공|처리|공유|응답|대답|논의|말씀)[^.!?]{0,14}(?:수 없|수가 없|못합|않겠|거절|불가)|거절(?:합니다|하겠습니다)|허용되지 않",),
    "it": (r"\bnon (?:posso|possiamo|sono autorizzat\w|siamo autorizzat\w|mi è possibile|mi è permesso|sono in grado di|intendo)\b[^.!?;]{0,60}?\b(?:rispond|aiut|forni|tratt|discut|parl|scegli|sceglie|decid|dare|elabor)\w*", r"\b(?:devo|preferisco) (?:rifiutare|declinare)\b"),
    "pt": (r"\bnão (?:posso|podemos|devo|vou|estou autorizad\w|me é permitido|me é possível)\b[^.!?;]{0,60}?\b(?:respond|ajud|fornec|trat|discut|fal|escolh|decid|dar|process)\w*", r"\b(?:devo|prefiro) (?:recusar|declinar)\b"),
    "nl": (r"\b(?:kan|mag|wil|zal|moet) (?:ik|wij|we)\b[^.!?;]{0,60}?\b(?:niet|geen|weigeren)\b", r"\b(?:ik|wij|we) (?:kan|kunnen|mag|mogen|wil|willen|zal|zullen|moet|moeten)\b[^.!?;]{0,60}?\b(?:niet|geen|weigeren)\b"),
    "ru": (r"\b(?:я|мы)?\s*не (?:могу|можем|буду|будем|вправе|имею права|имеем права|в состоянии|уполномочен\w*)\b[^.!?;]{0,60}?\b(?:ответ|отвеч|помоч|помог|предостав|обсужд|обсуд|выбра|выбир|реш|дать|обработ)\w*", r"\b(?:вынужден\w*|должен|должна|должны) отказать(?:ся)?\b"),
}
#: Per language, words of which every refusal of its grammar has one ("can't" is 'can' and 't'); Korean parts of words.
_DENIALS = {
    "en": "t not no cannot unable decline refuse outside beyond", "de": "nicht keine keinen keiner keines keinem ablehnen", "fr": "ne n refuser décliner aucune", "es": "no negarme declinar rechazar",
    "it": "non rifiutare declinare", "pt": "não recusar declinar", "nl": "niet geen weigeren", "ru": "не отказать отказаться",
}
_GRAMMARS = [(frozenset(words.split()), tuple(re.compile(p, re.I) for p in GRAMMARS[k])) for k, words in _DENIALS.items()]
_KOREAN, _KOREAN_DENIALS = tuple(re.compile(p) for p in GRAMMARS["ko"]), ("없", "못합", "않", "거절", "불가")
#: Sentences that only lead up to an answer: an apology or thanks.
_COURTESY = re.compile(r"\b(?:sorry|apologi[sz]e|apologies|unfortunately|thank|thanks|regret|leider|tut mir leid|entschuldig\w*|danke|désolé\w*|merci|malheureusement|siento|lamento|gracias|lamentablemente|spiac\w*|scus\w*|grazie|desculp\w*|obrigad\w*|helaas|bedankt|извин\w*|сожалени\w*|спасибо)\b|죄송|감사|유감", re.I)
#: Sentences of an answer's opening, courtesies not counted, that a refusal may stand in.
OPENING = 2


def structure(s: str) -> tuple[list[str], list[tuple[int, int]], list[tuple[int, int]]]:
    """What is still open at the end of s, its closed envelopes (objects and arrays of quoted strings, outermost only) and its
    fence marks, as stretches of s: one pass with a stack over fences, brackets, quotations, markup and code.

    Inside an envelope a quotation is a string, in which only escapes and its end count. Closing marks without an
    opening one, marks of lists like 'a)' and inch signs are no structure."""
    stack: list[tuple[str, int]] = []
    depth: Counter = Counter()
    envelopes: list[tuple[int, int]] = []
    fences: list[tuple[int, int]] = []
    skip = 0

    def push(kind: str, at: int) -> None:
        stack.append((kind, at))
        depth[kind] += 1

    def pop_to(kind: str) -> None:
        while stack:
            k, _ = stack.pop()
            depth[k] -= 1
            if k == kind:
                break

    for m in _TOKEN.finditer(s):
        t, i = m[0], m.start()
        if i < skip:
            continue
        top = stack[-1][0] if stack else ""
        if top == "`":
            if t == "`":
                pop_to("`")
            continue
        if t == "```":
            fence = _FENCE.match(s, i)
            if depth["fence"]:
                fences.append((i, i + 3))
                if not depth["{j"] and not depth["[j"]:
                    pop_to("fence")
            else:
                fences.append((i, fence.end()))
                push("fence", i)
                skip = fence.end()
            continue
        before, after = s[i - 1 : i], s[i + len(t) : i + len(t) + 1]
        if t in "{[":
            follow = s[i + 1 : i + 40].lstrip()[:1]
            quoted = bool(top.endswith("j")) or follow in ('"', "}", "]") or (t == "[" and follow in ("{", "[")) or (not s[i + 1 :].strip())
            push(t + "j" if quoted else t, i)
        elif t in "}]":
            o = _OPENER[t]
            if top == o + "j":
                at = stack[-1][1]
                pop_to(top)
                if not depth["{j"] and not depth["[j"]:
                    envelopes.append((at, i + 1))
            elif not top.endswith("j") and depth[o]:
                pop_to(o)
        elif top.endswith("j"):
            if t == '"':
                end = _STRING_END.match(s, i + 1)
                if end is None:
                    push("string", i)
                    break
                skip = end.end()
        elif t == "(":
            if before not in (":", ";", "="):
                push(t, i)
        elif t == ")":
            if depth["("]:
                pop_to("(")
        elif t == '"':
            if depth['"']:
                pop_to('"')
            elif after.strip() and not (before.isdigit() and not after.isalnum()):
                push('"', i)
        elif t in "„«“":
            if t == "“" and depth["„"]:
                pop_to("„")
            elif t == "«" and depth["»"]:
                pop_to("»")
            else:
                push(t, i)
        elif t == "”":
            pop_to("“" if depth["“"] else "„") if depth["“"] or depth["„"] else None
        elif t == "»":
            if depth["«"]:
                pop_to("«")
            elif not before.strip() and after.strip():
                push("»", i)
        elif t == "**":
            if depth["**"]:
                pop_to("**")
            elif after.strip() and not before.isalnum():
                push("**", i)
        elif t == "`":
            if after.strip() and not before.isalnum():
                push("`", i)
        elif t[0] == "<" and (name := m[2].lower()) in _ELEMENTS and not m[3]:
            if not m[1]:
                push("<" + name, i)
            elif depth["<" + name]:
                pop_to("<" + name)
    open_ = [k for k, _ in stack]
    last = _LAST_MARKER.search(s)
    if last and (head := s[: last.start()].rstrip()):
        mark = rf"{re.escape(last[1])}[ \t]" if last[1] else rf"{int(last[2]) - 1}[.)]"
        if head.endswith(":") or re.search(rf"(?m)^[ \t]*{mark}", head):
            open_.append("list")
    rows = s.rstrip().rsplit("\n", 2)[-2:]
    if len(rows) == 2 and rows[1].lstrip().startswith("|") and not rows[1].rstrip().endswith("|") and re.match(r"\s*\|.*\|\s*$", rows[0]):
        open_.append("row")
    return open_, envelopes, fences


def parse(text: str) -> tuple[bool, bool, str, str]:
    """(whole, enveloped, wording, rest): whether all that opens also closes, also inside the strings of an envelope; whether
    there is an envelope; the wording in it (or the text itself), and the text outside of it."""
    s = text.strip()
    open_, envelopes, fences = structure(s)
    if any(k in ("string", "{j", "[j") for k in open_):  # an envelope that never ends
        return False, True, " ".join(re.findall(r'"((?:[^"\\]|\\.)*)"?', s)), ""
    cut, at = [], 0
    for a, b in sorted(envelopes + [f for f in fences if not any(x <= f[0] < y for x, y in envelopes)]):
        if a >= at:
            cut.append(s[at:a])
            at = b
    outside = " ".join("".join([*cut, s[at:]]).split()) if envelopes else "".join([*cut, s[at:]]).strip()
    if envelopes:
        held = [w for a, b in envelopes for w in _strings(s[a:b])]
        whole = not open_ and not any(structure(w)[0] for w in held)
        return whole, True, " ".join(held), "" if outside.lower() in _NOTHING else outside
    if outside.lower().strip("\"'") in _NOTHING:
        return not open_, True, "", ""
    return not open_, bool(fences), " ".join(_MARKER.sub("", outside).split()), ""


def _strings(s: str) -> list[str]:
    """The wording of a closed envelope: its strings, without keys, numbers, nulls and one-word labels if there is any other."""
    try:
        found: list[str] = []
        held = [json.loads(s, strict=False)]
        while held:
            x = held.pop()
            if isinstance(x, dict):
                held += reversed(x.values())
            elif isinstance(x, list):
                held += reversed(x)
            elif x is not None and not isinstance(x, bool):
                found.append(str(x))
    except (ValueError, RecursionError):
        found = re.findall(r'"((?:[^"\\]|\\.)*)"(?!\s*:)', s)
    found = [v.strip() for v in found if v.strip()]
    long_ = [v for v in found if len(v.split()) > 1 or _HANGUL.search(v)]
    return long_ or found


def _longest_matches(answer: list[str], prompt: list[str]) -> list[tuple[int, int]]:
    """For each place of the answer the length of the longest run from there that stands in the prompt, and where that ends in
    the prompt: by an automaton of all runs of the prompt read backwards, in linear time."""
    link, length, ends, steps = [-1], [0], [0], [{}]
    last = 0
    m = len(prompt)
    for j in range(m - 1, -1, -1):
        w = prompt[j]
        new = len(link)
        link.append(0)
        length.append(length[last] + 1)
        ends.append(j)
        steps.append({})
        p = last
        while p != -1 and w not in steps[p]:
            steps[p][w] = new
            p = link[p]
        if p != -1:
            q = steps[p][w]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(link)
                link.append(link[q])
                length.append(length[p] + 1)
                ends.append(ends[q])
                steps.append(dict(steps[q]))
                while p != -1 and steps[p].get(w) == q:
                    steps[p][w] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    out: list[tuple[int, int]] = [(0, 0)] * len(answer)
    state = n = 0
    for i in range(len(answer) - 1, -1, -1):
        w = answer[i]
        while state and w not in steps[state]:
            state = link[state]
            n = length[state]
        if w in steps[state]:
            state, n = steps[state][w], n + 1
        else:
            state = n = 0
        out[i] = (n, ends[state])
    return out


def tiled(answer: list[str], prompt: list[str], least: int = 2) -> tuple[float, float]:
    """Shares of the answer's and of the prompt's words in common tiles, longest tiles first (greedy string tiling); the
    prompt may be used again, as a copy may repeat it. A tile is cut off at most once by a longer one behind it, so the
    work grows as n log n."""
    if not answer or not prompt:
        return 0.0, 0.0
    best = _longest_matches(answer, prompt)
    free, used = [True] * len(answer), [False] * len(prompt)
    least = min(least, len(prompt))
    heap = [(-n, i) for i, (n, _) in enumerate(best) if n >= least]
    heapq.heapify(heap)
    while heap:
        n, i = heapq.heappop(heap)
        n = -n
        if not free[i]:
            continue
        room = next((k for k in range(n) if not free[i + k]), n)
        if room < n:
            if room >= least:
                heapq.heappush(heap, (-room, i))
            continue
        free[i : i + n] = [False] * n
        j = best[i][1]
        used[j : j + n] = [True] * n
    return 1 - sum(free) / len(answer), sum(used) / len(prompt)


def is_copy(wording: str, prompt: str) -> bool:
    """Whether the wording is made of the prompt's words and of nothing else; a leading label ('Question:') is no wording."""
    wording = _LABEL.sub("", wording)
    a, p = _WORD.findall(wording.lower()), _WORD.findall(prompt.lower())
    if not a or not p or len(a) < 0.6 * len(p):
        return False
    known = set(p)
    if sum(w in known for w in a) < 0.9 * len(a):
        return False
    of_answer, of_prompt = tiled(a, p)
    return of_answer >= 0.9 and of_prompt >= 0.8


def refuses(wording: str) -> bool:
    """Whether the opening of an answer of any length declines to answer: one of its first sentences, courtesies not counted."""
    seen = 0
    for sentence in _SENTENCE.split(wording.replace("’", "'")):
        if not sentence.strip():
            continue
        words = set(_WORD.findall(sentence.lower()))
        if any(not denials.isdisjoint(words) and any(p.search(sentence) for p in grammar) for denials, grammar in _GRAMMARS):
            return True
        if not sentence.isascii() and any(d in sentence for d in _KOREAN_DENIALS) and any(p.search(sentence) for p in _KOREAN):
            return True
        if not _COURTESY.search(sentence):
            seen += 1
            if seen == OPENING:
                return False
    return False


def _scripts(s: str) -> tuple[int, int, int]:
    """Letters of Hangul, Latin and Cyrillic."""
    latin = sum(map(len, _LATIN.findall(s)))
    return (0, latin, 0) if s.isascii() else (sum(map(len, _HANGUL.findall(s))), latin, sum(map(len, _CYRILLIC.findall(s))))


def language(wording: str, prompt: str, expected: str, speakers: dict[str, tuple[str, ...]]) -> tuple[str | None, str | None]:
    """(other, own) of a wording: the language it is in if that is plainly another one than expected, else None; and the
    language it is in as far as scripts and function words tell, else None. Quotations and words of the prompt don't count
    for other. speakers: the languages of each function word."""
    expected = expected.lower()[:2]
    said = _QUOTED.sub(" ", wording)
    hangul, latin, cyrillic = _scripts(said)
    if cyrillic > 0.5 * (hangul + latin + cyrillic):
        return (None if expected in ("", "ru", "uk", "bg", "sr", "mk", "be") or cyrillic < 8 else "ru"), "ru"
    if hangul > 0.4 * (hangul + latin):
        return (None if expected in ("", "ko") or hangul + latin < 8 else "ko"), "ko"
    hits: Counter = Counter()
    words = _WORD.findall(said.lower())
    for w in words:
        for k in (langs := [k for k in speakers.get(w, ()) if k != "ko"]):
            hits[k] += 1 / len(langs)
    own = max(hits, key=lambda k: (hits[k], k)) if hits else None
    if hangul + latin + cyrillic < 8 or not expected:
        return None, own
    if expected == "ko":
        if hits and hangul < 0.15 * (hangul + latin):
            return own, own
        quoted = set(_WORD.findall(prompt.lower()))
        return ("?" if hangul == 0 and sum(w not in quoted for w in words) >= 4 else None), own
    if own is None or not any(expected in langs for langs in speakers.values()):
        return None, own
    others = [k for k in hits if k != expected]
    best = max(others, key=lambda k: (hits[k], k)) if others else None
    return (best if best and hits[best] >= 1.5 and hits[best] >= 1.5 * hits[expected] else None), own


def _plain(word: str) -> str:
    return re.sub(r"\d+", "0", word.strip("\"'()[],;:*_.!?…").lower())


#: Of a response: its defect (null: none so far), whether its language has a refusal grammar, and of an answer that ends without a
#: stop the last two words, whether its other sentences have stops, and whether it ends in a function word. Of the sentences of all
#: responses: how often two words stand together, and how often they end a sentence.
_JUDGED = "defect string, judged boolean, prev string, word string, stops boolean, function boolean, n long, n_final long"


def _judge(profiles: dict[str, frozenset[str]]):
    speakers = {w: tuple(sorted(k for k, ws in profiles.items() if w in ws)) for w in frozenset().union(*profiles.values())}

    def one(response: str | None, prompt: str | None, lang: str | None) -> tuple[tuple, str]:
        none = (None, False, False)
        if response is None or not response.strip():
            return ("empty", True, None, *none), ""
        whole, enveloped, wording, rest = parse(response)
        if whole and not _WORD.search(wording) and not _WORD.search(rest):
            return ("empty", True, None, *none), wording
        if refuses(wording) or rest and not wording and refuses(rest):
            return ("refusal", True, None, *none), wording
        if whole and prompt and is_copy(wording, prompt) and (not rest or is_copy(rest, prompt)):
            return ("copy", True, None, *none), wording
        if not whole:
            return ("truncated", True, None, *none), wording
        text = rest if rest and not enveloped else wording
        other, own = language(wording or rest, prompt or "", lang if lang and prompt else "", speakers)
        words = text.split()
        defect = "language" if other else None
        if len(words) > 1 and not _STOP.search(text.rstrip()):
            prev, word = _plain(words[-2]), _plain(words[-1])
            function = word in profiles.get(other or (lang or "").lower()[:2], ())
            return (defect, own in GRAMMARS, prev, word, bool(_INNER_STOP.search(text)), function), wording
        return (defect, own in GRAMMARS, None, *none), wording

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, bool]] = {}
        for b in batches:
            rows, total, final = [], Counter(), Counter()
            for r in zip(*(b.column(c).to_pylist() for c in ("response", "prompt", "lang"))):
                row, wording = one(*r)
                rows.append(row)
                words = []
                for w in wording.split():
                    if w not in known:
                        if len(known) > 200_000:
                            known.clear()
                        known[w] = (_plain(w), bool(_STOP.search(w)))
                    words.append(known[w])
                if words and not words[-1][1]:
                    words.pop()  # not known to be an end
                for (a, _), (w, end) in zip(words, words[1:]):
                    total[a, w] += 1
                    if end:
                        final[a, w] += 1
            cols = [list(c) for c in zip(*rows)] or [[] for _ in range(6)]
            none = [None] * len(total)
            ids = pa.concat_arrays([b.column("id"), pa.nulls(len(total), b.schema.field("id").type)])
            values = (cols[0] + none, cols[1] + none, cols[2] + [a for a, _ in total], cols[3] + [w for _, w in total], cols[4] + none, cols[5] + none, [None] * len(rows) + list(total.values()), [None] * len(rows) + [final[k] for k in total])
            types = (pa.string(), pa.bool_(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(v, t) for v, t in zip(values, types))], names=["id", *(c.split()[0] for c in _JUDGED.split(", "))])

    return run


def assessed(pairs: DataFrame, common_words: DataFrame, ends: float = 0.5, enough: int = 20, max_words: int = 100_000) -> DataFrame:
    """id, defect (null: none) and judged of each pair: pairs has id, prompt, response, lang (of the prompt).

    'empty': no response (also null), or an envelope without content. 'refusal': its opening declines to answer, by the
    GRAMMARS of some languages; judged is false where no grammar speaks the language of the answer. 'copy': says only
    what the prompt says. 'truncated': a fence, bracket, string, quotation, list, table row or element of markup stays
    open, or the last sentence has no stop and breaks off. Whether it does is told, in this order, by: its last two
    words, if the sentences of all responses know them (they end a sentence less than `ends` of the time); a longer
    word that responses have in the place of the last one and that begins with it; a function word at the end; stops
    after the answer's other sentences; the word before the last, if it stands `enough` times and hardly ever one word
    before an end. Without such evidence the answer is taken as complete. 'language': worded in another language than
    lang. A pair gets the first of these that holds. With a null prompt or lang, copies and languages can't be told and
    are not reported. Rows with a null id are left out; repeated rows are judged alike and reported once. common_words
    (lang, word) is a short list, refused above max_words.
    """
    words = common_words.select(F.lower("lang").alias("lang"), F.lower("word").alias("word")).where("lang IS NOT NULL AND word IS NOT NULL").distinct().limit(max_words + 1).collect()
    if len(words) > max_words:
        raise ValueError(f"more than {max_words} common words")
    profiles = {k: frozenset(w for x, w in words if x == k) for k in sorted({x for x, _ in words})}
    rows = pairs.select("id", "prompt", "response", "lang").where("id IS NOT NULL")
    both = staged(rows.mapInArrow(_judge(profiles), f"id {dict(pairs.dtypes)['id']}, {_JUDGED}"), "pairs-judged")
    judged = both.where("n IS NULL")
    open_ = judged.where("prev IS NOT NULL").select("id", "defect", "judged", "prev", "word", "stops", "function")
    # How the words of open ends stand in all responses; only what open ends need is kept of the counts.
    tails = open_.select("prev", "word").distinct()
    befores = tails.select("prev").distinct()
    counts = both.where("n IS NOT NULL").join(befores, "prev", "left_semi").groupBy("prev", "word").agg(F.sum("n").alias("n"), F.sum("n_final").alias("n_final"))
    counts = staged(counts, "pairs-endings")
    context = counts.groupBy("prev").agg(F.sum("n").alias("n_prev"), F.sum("n_final").alias("n_prev_final"))
    lengths = tails.select("prev", F.length("word").alias("len")).distinct()
    longer = counts.join(lengths, "prev").where("len > 0 AND length(word) > len").select("prev", F.expr("substring(word, 1, len)").alias("word")).distinct().withColumn("cut", F.lit(True))
    told = tails.join(counts, ["prev", "word"], "left").join(longer, ["prev", "word"], "left").join(context, "prev", "left")
    broken = (
        F.when(F.col("n") >= 2, F.col("n_final") < ends * F.col("n"))
        .when(F.col("cut") | F.col("function") | F.col("stops"), True)
        .otherwise(F.coalesce((F.col("n_prev") >= enough) & (F.col("n_prev_final") * enough < F.col("n_prev")), F.lit(False)))
    )
    open_ = open_.join(told, ["prev", "word"]).withColumn("defect", F.when(broken, "truncated").otherwise(F.col("defect")))
    return judged.where("prev IS NULL").select("id", "defect", "judged").unionByName(open_.select("id", "defect", "judged")).distinct()


def defects(pairs: DataFrame, common_words: DataFrame, **options) -> DataFrame:
    """id and defect of each broken pair: assessed without the whole ones."""
    return assessed(pairs, common_words, **options).where("defect IS NOT NULL").select("id", "defect").distinct()

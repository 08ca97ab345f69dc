"""Problem 6: sentence units in many languages.

Pass one counts, for each language and over all documents, how often each type
stands with and without a final period, what follows a period, and what follows
a certain sentence end.  From these, log-likelihood ratios give (unsupervised)
the abbreviations, the sentence starters and the collocations over a period
(ordinals and their nouns).  Pass two classifies every possible end with them,
minding quotations, brackets, hard wraps, headings, list items and scripts
without spaces or full stops.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.language import LanguageModel, code_of, learn_languages
from docloom.runtime import spread, written

# A type must make up at least this share of its language's tokens to enter a
# model; hence a model has at most 1 / FLOOR entries, however large the corpus.
FLOOR = 2e-6
LEAST = 3

# fixed values: verbs of saying, for quotations followed by who said it
SAYING = {
    "en": "said says told asked added replied explained noted stated answered wrote announced",
    "vi": "nói hỏi kể đáp biết thêm",
    "fr": "dit déclaré affirmé expliqué demandé ajouté répondu raconté précisé indiqué",
    "de": "sagte sagten erklärte fragte meinte betonte berichtete antwortete sagt",
    "es": "dijo dijeron afirmó explicó preguntó añadió respondió declaró señaló dice",
    "hi": "कहा पूछा बताया बोला बोले",
}
SAYING_UNSPACED = "说 表示 称 指出 问道 说道 補充 补充 回答 述べた 言った 語った 話した กล่าว บอก"


@lru_cache(1)
def _heads():
    return re.compile(r"(?:\A|\n\s*\n|।)\s*[\"“«„]?([^\s\"“”«»„]+)").findall


_BEFORE, _AFTER = "\"“«„(‘[（", "\"”»“’),;:"
_LAST = frozenset(".!?…\"”»“’)")
_TYPE = re.compile(r"[^\W\d_]")


def _tally(text: str, words: Counter, pairs: Counter) -> None:
    tokens = text.split()
    words.update(tokens)
    for token, after in zip(tokens, tokens[1:], strict=False):
        if token[-1] not in _LAST:
            continue
        core = token.rstrip("\"”»“’)")
        stem = core.rstrip(".!?…")
        if len(stem) == len(core):
            continue
        after = after.lstrip(_BEFORE)
        if not after:
            continue
        if core[len(stem) :] == ".":
            before = stem.lstrip(_BEFORE)
            pairs[(before, after)] += 1
            if len(before) > 1 and (before.islower() or len(before) > 5) and "." not in before:
                pairs[("", after)] += 1  # few of these are abbreviations
        elif after[0].isupper() or "ऀ" <= after[0]:
            pairs[("", after)] += 1
    for after in _heads()(text):
        pairs[("", after)] += 1


def _spaced(word: str) -> bool:
    """Is this a word of a script that puts spaces between words?"""
    return not ("\u0e00" <= word[0] <= "\u0eff" or "\u1000" <= word[0] <= "\u109f" or "\u1780" <= word[0] <= "\u17ff" or "\u2e80" <= word[0] <= "\u9fff")


def counts(docs: DataFrame, text: str = "text", lang: str = "lang", languages: LanguageModel | None = None) -> DataFrame:
    """kind, lang, a, b, n.  Kind `type`: the type a (with its period, if it has
    one) occurs n times, of tokens in all as a = ''; `start`: b starts a sentence
    n times; `pair`: b follows `a.`.  Documents without a language count under
    the one that ``languages`` guesses."""
    shared = docs.sparkSession.sparkContext.broadcast(languages or LanguageModel())
    kept = spread(docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        pairs: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for code in words:
                types: Counter = Counter()
                for w, n in words[code].items():
                    types[""] += n
                    w = w.lstrip(_BEFORE).rstrip(_AFTER)
                    if w and _spaced(w) and (_TYPE.match(w) or _ORDINAL.match(w)):
                        types[w] += n
                rows = [("type", code, w, None, n) for w, n in types.items()]
                rows += [("pair" if a else "start", code, a, b, n) for (a, b), n in pairs[code].items()]
                for at in range(0, len(rows), 20000):
                    part = list(zip(*rows[at : at + 20000], strict=True))
                    yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.string()) for c in part[:4]], pa.array(part[4], pa.int64())], names=["kind", "lang", "a", "b", "n"])
            words.clear()
            pairs.clear()

        for batch in batches:
            for t, code in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if t and (code := shared.value.code(code, t)):
                    if code not in words:
                        words[code], pairs[code] = Counter(), Counter()
                    _tally(t, words[code], pairs[code])
            if sum(map(len, words.values())) + sum(map(len, pairs.values())) > 600_000:
                yield from out()
        yield from out()

    partial = kept.mapInArrow(run, "kind string, lang string, a string, b string, n long")
    return partial.groupBy("kind", "lang", "a", "b").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", languages: LanguageModel | None = None) -> dict[str, dict]:
    """{language: {"lead", "trail", "start", "after_number"}}.

    ``lead`` abbreviations stand before a name or number and end nothing,
    ``trail`` ones may end a sentence; ``start`` are frequent sentence
    starters, ``after_number`` words that follow an ordinal's period.
    """
    languages = languages or learn_languages(docs, text, lang)
    table = written(counts(docs, text, lang, languages), "sentence-counts")
    types = written(table.where("kind = 'type' and a <> ''").select("lang", "a", "n"), "sentence-types")
    pairs = written(table.where("kind <> 'type'").select("kind", "lang", "a", "b", "n"), "sentence-pairs")
    all_n = table.where("kind = 'type' and a = ''").select("lang", F.col("n").alias("all_n"))
    dots = types.where("a like '%.'").groupBy("lang").agg(F.sum("n").alias("dots"))
    size = F.broadcast(all_n.join(dots, "lang"))  # one row for each two-letter code
    # starters: share of a type's occurrences that open a sentence
    opens = pairs.where("kind = 'start'").select("lang", "b", F.col("n").alias("k"))
    starters = (
        opens.join(size, "lang")
        .where((F.col("k") >= F.lit(FLOOR) * F.col("all_n")) & (F.col("k") >= LEAST))
        .join(types.select("lang", F.col("a").alias("b"), F.col("n").alias("c")), ["lang", "b"])
        .join(F.broadcast(opens.groupBy("lang").agg(F.sum("k").alias("all_k"))), "lang")
    )
    # log likelihood of the type at starts against elsewhere, one-sided
    p1, p0 = F.col("k") / F.col("all_k"), F.greatest(F.col("c") - F.col("k"), F.lit(0.5)) / F.col("all_n")
    starters = starters.where((p1 > p0) & (F.col("k") * F.log(p1 / p0) > 7.88) & (F.col("k") > 0.4 * F.col("c")) & ~F.col("b").endswith(".")).select("lang", "b")
    starters = written(starters, "sentence-starters")
    # abbreviations
    with_dot = types.where("a like '%.'").select("lang", F.expr("substring(a, 1, length(a) - 1)").alias("w"), F.col("n").alias("c1"))
    without = types.where("a not like '%.'").select("lang", F.col("a").alias("w"), F.col("n").alias("c0"))
    letters = F.length(F.regexp_replace("w", r"\.", ""))
    inner = F.length("w") - letters
    cand = (
        with_dot.join(size, "lang")
        .where(F.col("w").rlike(r"^[\p{L}\p{M}]+(?:[.\-]+[\p{L}\p{M}]+)*$") & ~F.col("w").contains(".."))
        .where((F.col("c1") >= F.lit(FLOOR) * F.col("all_n")) & (F.col("c1") >= LEAST))
        .join(without, ["lang", "w"], "left")
        .fillna(0, ["c0"])
    )
    null = F.col("dots") / F.col("all_n")
    ratio = 2 * (F.col("c1") * F.log(F.lit(0.99) / null) + F.col("c0") * F.log(F.lit(0.01) / (1 - null)))
    cand = cand.withColumn("score", ratio * F.exp(-letters) * (inner + 1) * F.pow(letters.cast("double"), -F.least(F.greatest(F.col("c0") - 0.1 * F.col("c1"), F.lit(0.0)), F.lit(60.0))))
    cand = cand.where((F.col("score") > 0.3) | ((letters == 1) & (ratio > 0)))
    follow = pairs.where("kind = 'pair'").select("lang", F.col("a").alias("w"), "b", "n")
    cand = written(cand, "sentence-abbreviations")
    follow = follow.join(cand.select("lang", "w"), ["lang", "w"], "left_semi").join(starters.select("lang", "b", F.lit(1).alias("s")), ["lang", "b"], "left")
    lower, digit = F.col("b").rlike(r"^[\p{Ll}]"), F.col("b").rlike(r"^\p{N}")
    shares = follow.groupBy("lang", "w").agg(
        F.sum("n").alias("f"),
        F.sum(F.when(lower & ~F.col("b").rlike(r"^\p{Ll}\p{Lu}"), F.col("n")).otherwise(0)).alias("low"),
        F.sum(F.when(digit, F.col("n")).otherwise(0)).alias("num"),
        F.sum(F.when(F.col("s") == 1, F.col("n")).otherwise(0)).alias("st"),
    )
    abbr = cand.join(shares, ["lang", "w"], "left").fillna(0, ["f", "low", "num", "st"])
    rows = abbr.select("lang", "w", "c1", "f", "low", "num", "st", "score").collect()  # at most 1 / FLOOR a language
    # ordinals: a word that mostly follows a number with a period
    bare = F.regexp_replace("b", r"[.,;:!?]+$", "").alias("a")
    after = pairs.where("kind = 'pair'").where(F.col("a").rlike(r"^\d{1,3}$")).select("lang", bare, "n").groupBy("lang", "a").agg(F.sum("n").alias("k"))
    after = after.join(size, "lang").where((F.col("k") >= F.lit(FLOOR) * F.col("all_n")) & (F.col("k") >= LEAST))
    whole = types.select("lang", F.regexp_replace("a", r"[.!?]+$", "").alias("a"), "n").groupBy("lang", "a").agg(F.sum("n").alias("c"))
    ordinal = after.join(whole, ["lang", "a"]).where("k > 0.25 * c").select("lang", "a").collect()
    models: dict[str, dict] = {}

    def model(code: str) -> dict:
        return models.setdefault(code, {"lead": set(), "trail": set(), "start": set(), "after_number": set()})

    for r in starters.select("lang", "b").collect():
        model(r["lang"])["start"].add(r["b"])
    for r in rows:
        m, f = model(r["lang"]), max(r["f"], 1)
        names = r["f"] - r["low"] - r["num"] - r["st"]
        if r["low"] + r["num"] >= 0.08 * f and r["f"]:
            kind = "lead" if r["low"] < 0.05 * f or r["num"] >= 0.5 * f else "trail"
        elif names >= 0.85 * f and r["f"] >= 6:
            kind = "lead"
        elif "." in r["w"] or r["score"] > 40:
            kind = "trail"
        else:
            continue
        m[kind].add(r["w"])
    for r in ordinal:
        model(r["lang"])["after_number"].add(r["a"])
    return models


# ---------------------------------------------------------------- pass two

_OPEN = {"“": "”", "«": "»", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "„": "“", "‹": "›", "【": "】"}
_QUOTES = frozenset("”»」』“\"›’'")
_BRACKETS = frozenset(")）]】")
_CLOSERS = _QUOTES | _BRACKETS
_UNSEEN = frozenset("\u00ad\u180e\u200b\u200c\u200d\u200e\u200f\u2060\ufeff")
_MARK_RE = re.compile(r"[“”«»「」『』()（）\[\]„\"‹›【】]")
_END_RE = re.compile(r"[.!?…。！？।]+")
_LIST_RE = re.compile(r"(?:[-*•–—·◦▪‣]|\(?\d{1,3}[.)]|\(?(?:[A-Za-z]|[ivxIVX]{1,4})\))[^\S\n]+(?=\S)")
_LINE_RE = re.compile(r"[^\n]+")
_URL_RE = re.compile(r"(?:www\.|https?://|@)|\.\w+/")
_NUMBER_RE = re.compile(r"^\d+$")
_INITIAL_RE = re.compile(r"^(?:[^\W\d_]\.?-?){1,3}$")
_THAI = re.compile(r"[ก-๛]")
_ORDINAL = re.compile(r"\d{1,3}\.$")
_THAI_GAP = re.compile(r"(?<=[^\s\d])[^\S\n]+(?=[^\s\d])")
_UNSPACED_SAID = re.compile(r"[^。！？\s“”「」]{0,24}?(?:" + "|".join(SAYING_UNSPACED.split()) + r")[^。！？：:“「]{0,12}[。！？]")
_JA_GOES_ON = re.compile(r"と|って|など|を|は|が|に|も|の|で")


@lru_cache(1)
def _said():
    verbs = "|".join(sorted({v for words in SAYING.values() for v in words.split()}, key=len, reverse=True))
    return re.compile(r"[\"”»“]?\s*(?:[^\s.!?:“\"«]+\.?\s+){0,7}?(?:" + verbs + r")(?![\wऀ-ॣ])[^.!?।:“\"«\n]{0,60}[.!?।,;]")


def _is_upper(text: str, at: int) -> bool:
    c = text[at]
    return c.isupper() or c.istitle() or (c.islower() and at + 1 < len(text) and text[at + 1].isupper())


def _segments(text: str) -> list[tuple[int, int]]:
    """Stretches that no line break divides: hard-wrapped lines are joined."""
    if "\n" not in text:
        return [(0, len(text))]
    lines = [m.span() for m in _LINE_RE.finditer(text)]
    lines = [(a, b) for a, b in lines if text[a:b].strip()]
    if len(lines) < 2:
        return lines
    sizes = [len(text[a:b].rstrip()) for a, b in lines]
    solid = [n > 45 and " " not in text[a:b].strip() for n, (a, b) in zip(sizes, lines, strict=True)]
    # A line that stops in mid-sentence before a small letter shows that the text
    # is wrapped; where such lines break gives the width, and by it the other breaks
    # are told apart.  Edits may have made lines longer since.
    room: dict[int, int] = {}
    sure: list[int] = []
    widest = max((n for n, s in zip(sizes, solid, strict=True) if not s), default=0)
    for i in range(len(lines) - 1):
        a, b = lines[i + 1]
        while text[a].isspace():
            a += 1
        if solid[i] or solid[i + 1] or text.count("\n", lines[i][1], lines[i + 1][0]) != 1:
            continue
        inside = text.rfind("(", lines[i][0], lines[i][1]) > text.rfind(")", lines[i][0], lines[i][1])
        if _LIST_RE.match(text, a, b) and not inside:
            continue
        first = text[a:b].split(None, 1)[0]
        room[i] = sizes[i] + 1 + len(first)
        tail = text[lines[i][0] : lines[i][1]].rstrip()[-1]
        if tail in ".!?…।。！？":
            continue
        if text[a].islower() and not _is_upper(text, a):
            sure.append(i)
        elif "\u0900" <= text[a] <= "\u097f" and tail not in "”\"»" and sizes[i] <= 110 and room[i] > 0.9 * widest:
            sure.append(i)
    wraps = [False] * (len(lines) - 1)
    if sure:
        limits = sorted(room[i] for i in sure)
        width = limits[len(limits) // 10] - 1
        for i, n in room.items():
            open_end = text[lines[i][0] : lines[i][1]].rstrip()[-1] not in ".!?…।。！？:;”\"»)" and not _LIST_RE.match(text[lines[i][0] : lines[i][1]].lstrip())
            a = lines[i + 1][0]
            while text[a].isspace():
                a += 1
            open_end = open_end or (text[a].islower() and not _is_upper(text, a))
            wraps[i] = (n > width or open_end and sizes[i] > 0.55 * width) and sizes[i] <= 400
        for i in sure:
            wraps[i] = True
    out, start = [], lines[0][0]
    for i, joined in enumerate(wraps):
        if not joined:
            out.append((start, lines[i][1]))
            start = lines[i + 1][0]
    out.append((start, lines[-1][1]))
    return out


def _spans(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """(position of the opening mark, position of the closing mark), outermost."""
    out, stack = [], []
    for m in _MARK_RE.finditer(text, a, b):
        c, i = m.group(), m.start()
        if c == '"':
            if stack and stack[-1][0] == '"':
                o = stack.pop()[1]
                if not stack:
                    out.append((o, i))
            elif i + 1 < b and not text[i + 1].isspace():
                stack.append(('"', i))
            continue
        if stack and c == stack[-1][0]:
            o = stack.pop()[1]
            if not stack:
                out.append((o, i))
        elif any(c == s[0] for s in stack):
            while stack[-1][0] != c:  # unclosed marks within
                stack.pop()
            o = stack.pop()[1]
            if not stack:
                out.append((o, i))
        elif c in _OPEN:
            stack.append((_OPEN[c], i))
    if stack:  # a mark that is never closed protects nothing, but what it holds may
        o = stack[0][1]
        return sorted(out + _spans(text, o + 1, b))
    return out


_EMPTY: dict = {"lead": set(), "trail": set(), "start": set(), "after_number": set()}


def sentence_spans(text: str | None, lang: str | None, models: dict[str, dict], languages: LanguageModel | None = None) -> list[tuple[int, int]]:
    """Units as (start, end), without white space at either end."""
    if not text or not text.strip():
        return []
    model = models.get(code_of(lang))
    if model is None:
        guess = models.get(languages.guess(text) if languages else "", _EMPTY)
        # of other languages the abbreviations that end nothing, unless the guessed one has them otherwise
        lead = set().union(*(m["lead"] for m in models.values())) - guess["trail"]
        model = {**guess, "lead": lead}
    units: list[tuple[int, int]] = []
    for a, b in _segments(text):
        _cut(text, a, b, model, units)
    return units


def _add(text: str, a: int, b: int, units: list[tuple[int, int]], first: bool) -> None:
    while a < b and text[a].isspace():
        a += 1
    while b > a and text[b - 1].isspace():
        b -= 1
    if a >= b:
        return
    if not first and units and b - a <= 3 and not any(c.isalnum() for c in text[a:b]):
        units[-1] = (units[-1][0], b)  # a symbol after the last sentence
    else:
        units.append((a, b))


def _cut(text: str, a: int, b: int, model: dict, units: list[tuple[int, int]]) -> None:
    while a < b and text[a].isspace():
        a += 1
    start, first = a, True
    mark = _LIST_RE.match(text, a, b)
    at = mark.end() if mark else a
    spans = _spans(text, at, b) if _MARK_RE.search(text, at, b) else []
    thai = bool(_THAI.search(text, at, b))
    ends: list[int] = []
    k = 0
    for m in _END_RE.finditer(text, at, b):
        i, j = m.span()
        while j < b and text[j] in _UNSEEN:
            j += 1
        if j >= b:
            break
        while k < len(spans) and spans[k][1] < i:
            k += 1
        opened, close = -1, -1
        if k < len(spans) and spans[k][0] < i:
            opened, close = spans[k]
            if j != close and not (j < close and all(c in _CLOSERS for c in text[j : close + 1])):
                continue  # inside a quotation or bracket
            j = close + 1
        elif text[j] in _QUOTES and text[j] != "“" and text[j] != "'":
            while j < b and text[j] in _CLOSERS and (j == m.end() or text[j] not in '"“'):
                j += 1
        if j >= b:
            break
        if _is_end(text, b, m.group(), i, j, opened, close, ends[-1] if ends else at, model):
            ends.append(j)
    if thai:
        extra = []
        for m in _THAI_GAP.finditer(text, at, b):
            i = m.start()
            if any(o < i < c for o, c in spans) or text[i - 1] in "–—" or not (text[i - 1].isalnum() or _THAI.match(text[i - 1]) or text[i - 1] in ".!?…”\"»)ฯๆ%"):
                continue
            extra.append(i)
        ends = sorted({*ends, *extra})
    for e in ends:
        _add(text, start, e, units, first)
        start, first = e, False
    _add(text, start, b, units, first)


def _is_end(text: str, b: int, stop: str, i: int, j: int, opened: int, close: int, since: int, model: dict) -> bool:
    p = j
    while p < b and text[p].isspace():
        p += 1
    if p >= b:
        return True
    gap = p > j
    q = p
    while q < b and not (text[q].isalnum() or text[q] >= "ऀ" and text[q].isalpha()):
        if text[q] in ",;:，；：、":
            return False
        q += 1
    follow = text[q] if q < b else ""
    closed = text[close] if close >= 0 else (text[j - 1] if text[j - 1] in _CLOSERS else "")
    if closed in _BRACKETS and closed:
        # a bracket inside a sentence ends nothing; one that is the sentence does
        s = since
        while s < opened and text[s].isspace():
            s += 1
        if opened >= 0 and s != opened:
            return False
    last = stop[-1]
    if last in "。！？।":
        if closed and closed in _QUOTES:
            if last != "।" and (_UNSPACED_SAID.match(text, j, b) or closed in "」』" and _JA_GOES_ON.match(text, j, b)):
                return False
            if last == "।" and _said().match(text, j, min(b, j + 160)):
                return False
        return True
    upper = bool(follow) and _is_upper(text, q)
    lower = bool(follow) and follow.islower() and not upper
    if closed and closed in _QUOTES:
        if lower or (not gap and follow.isalnum() and not upper):
            if last != "." or not gap or lower:
                return False
        return not (_said().match(text, j, min(b, j + 160)) or _UNSPACED_SAID.match(text, j, b))
    if not gap:
        if not upper or q != p:
            return not (lower or follow.isdigit()) and last in "!?" and q == p and bool(follow)
        w = i
        while w > since and not text[w - 1].isspace():
            w -= 1
        token = text[w:i]
        if last in "!?…" or len(stop) > 1:
            return True
        if len(token) < 2 or "." in token or _URL_RE.search(token) or token in model["lead"] or token in model["trail"]:
            return False
        if not (text[i - 1].islower() or text[i - 1].isdigit() or text[i - 1] in "%)”»\"" or text[i - 1] >= "ऀ"):
            return False
        return q + 1 >= b or text[q + 1].islower() or text[q + 1].isspace() or text[q + 1] in "'’.-"
    if lower:
        return False
    if len(stop) > 1 and set(stop) == {"."} or stop == "…" or stop == "……":
        if upper or follow.isdigit():
            return True
        w = q
        while w < b and not text[w].isspace():
            w += 1
        return text[q:w] in model["start"] or not follow
    if stop != ".":
        return True
    w = i
    while w > since and not text[w - 1].isspace():
        w -= 1
    token = text[w:i].lstrip("\"“«„(‘[「")
    if token in model["lead"] or "ก" <= text[i - 1] <= "๛":
        return False
    if token in model["trail"]:
        return upper or not follow or not (follow.isdigit() or follow.isalpha() and not upper)
    if _NUMBER_RE.match(token):
        e = q
        while e < b and text[e].isalnum():
            e += 1
        return not (len(token) <= 3 and text[q:e] in model["after_number"])
    if len(token) == 1 and token.isupper() or (len(token) <= 5 and "." in token and token[0].isupper() and _INITIAL_RE.match(token)):
        return False
    return True


def split_sentences(
    docs: DataFrame, models: dict[str, dict], key: str = "doc_id", text: str = "text", lang: str = "lang", languages: LanguageModel | None = None
) -> DataFrame:
    """``(key, start_char, end_char)``: the sentence units of every document.

    Offsets are code points into the stored text.  Null, empty and blank texts
    have no units; a text without any sentence end is one unit; repeated rows
    give repeated units; a language that is null or unknown is guessed by
    ``languages`` from the whole text; other columns are ignored.  The models
    are broadcast; they have at most 1 / FLOOR entries a language.
    """
    kept = spread(docs.select(F.col(key).alias("_key"), F.col(text).alias("text"), F.col(lang).alias("lang")))
    kind = kept.schema["_key"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((models, languages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, languages = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows, starts, ends = [], [], []
                for n, (t, code) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    for a, b in sentence_spans(t, code, models, languages):
                        rows.append(n)
                        starts.append(a)
                        ends.append(b)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())],
                    names=[key, "start_char", "end_char"],
                )

    return kept.mapInArrow(run, f"`{key}` {kind}, start_char long, end_char long")

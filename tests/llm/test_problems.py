from __future__ import annotations

import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import canonical, language, mixing, neardup, reading, sentences, spans, splitting, tokens, truncation

WORDS = "the of river city tower market because water green small light house under winter paper bridge garden stone train coast".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n))


def clashing(df):
    """Extra columns named like those that operators make for themselves."""
    for c in ("_key", "_text", "rec", "size", "tokens", "kind", "_row", "words", "n"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit("x"))
    return df


# ------------------------------------------------------------------ 1: spans


def brute_spans(texts, n):
    out = set()
    for k, t in texts.items():
        shared = [False] * len(t)
        for i in range(len(t) - n + 1):
            if any(t[i : i + n] in u for j, u in texts.items() if j != k):
                shared[i : i + n] = [True] * n
        i = 0
        while i < len(t):
            if shared[i]:
                j = i
                while j < len(t) and shared[j]:
                    j += 1
                out.add((k, i, j))
                i = j
            i += 1
    return out


@pytest.mark.parametrize("hot", [4096, 2])
def test_spans_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(spans, "HOT", hot)
    rng = random.Random(4)
    passage, other = prose(rng, 60), prose(rng, 40)
    texts = {1: prose(rng, 20) + passage + prose(rng, 30), 2: passage, 3: "é" + passage[:230] + "X" + passage[230:], 4: prose(rng, 80), 5: other + other, 6: prose(rng, 9) + other, 7: passage[:199], 8: "a" * 700, 9: "a" * 300, 10: "b" * 500, 11: passage}
    rows = [*texts.items(), (20, None), (21, ""), (None, passage), (2, passage)]
    pool = clashing(spark.createDataFrame(rows, "rec long, text string"))
    got = {tuple(r) for r in spans.shared_spans(pool).collect()}
    assert got == brute_spans(texts, 200)


def test_the_automaton_finds_the_occurrences():
    """No position is handed to a shard: without the automaton there are no rows."""
    rng = random.Random(8)
    passages = [prose(rng, 9)[:32] for _ in range(5)]
    segments = ["x" + passages[0] + passages[1], passages[0] * 2, passages[3] + "..", "none here", passages[2]]
    shard = np.array([7, 7, 7, 8, 8])
    got = spans.occurrences(segments, shard, passages, np.array([7, 7, 8, 7, 8]))
    assert set(zip(*(x.tolist() for x in got), strict=True)) == {(0, 1, 0), (0, 33, 1), (1, 0, 0), (1, 32, 0), (2, 0, 3), (4, 0, 2)}
    assert [len(x) for x in spans.occurrences(segments, shard, [], np.zeros(0, np.int64))] == [0, 0, 0]


def test_windows_are_compared_by_their_characters(monkeypatch):
    monkeypatch.setattr(spans, "_rolling", lambda codes, width: np.zeros(max(len(codes) - width + 1, 0), np.uint64))
    zeros, none = np.zeros(3, np.int64), np.zeros(3, bool)
    got = spans._shared_windows(zeros, np.array([1, 2, 3]), zeros, ["abcdefgh" * 9, "y" + "abcdefgh" * 9, "z" * 80], none, 70)
    assert list(zip(*(x.tolist() for x in got), strict=True)) == [(1, 0, 72), (2, 1, 73)]


def test_a_stretch_of_several_records_beside_one_that_shares_nothing(spark):
    """A block of which only the stretches of several records have shared windows."""
    got = spans._shared_windows(np.zeros(2, np.int64), np.array([1, 3]), np.zeros(2, np.int64), ["abcdefgh" * 9, "z" * 80], np.array([True, False]), 70)
    assert [len(x) for x in got] == [0, 0, 0]
    rng = random.Random(12)
    whole = prose(rng, 60)
    (_, position, anchor), *_ = spans.winnow([whole], 200)
    passage = whole[position[len(position) // 2] :][: spans.ANCHOR]
    alone = next(t for t in (prose(rng, 30) + passage + prose(rng, 30) for _ in range(200)) if set(anchor.tolist()) & set(next(spans.winnow([t], 200))[2].tolist()))
    texts = {1: whole, 2: whole, 3: alone}
    got = {tuple(r) for r in spans.shared_spans(spark.createDataFrame([*texts.items()], "rec long, text string")).collect()}
    assert got == brute_spans(texts, 200) == {(1, 0, len(whole)), (2, 0, len(whole))}


def test_spans_of_nothing(spark):
    assert spans.shared_spans(spark.createDataFrame([], "rec long, text string")).count() == 0
    docs = spark.createDataFrame([(1, "x" * 250), (2, "x" * 250), (3, "")], "doc_id long, text string")
    refs = spark.createDataFrame([(1, "y" * 300), (2, None)], "ref_id long, text string")
    rows = {(r["record_kind"], r["record_id"]): r["shared_part"] for r in spans.shares(docs, refs).collect()}
    assert rows == {("document", 1): 1.0, ("document", 2): 1.0, ("document", 3): 0.0, ("reference", 1): 0.0}


def test_winnow_of_a_text_longer_than_a_block(monkeypatch):
    monkeypatch.setattr(spans, "BLOCK", 4096)
    rng = random.Random(3)
    shared = prose(rng, 60)
    long = prose(rng, 2000) + shared + prose(rng, 500)
    a, b = ({h for _, _, hs in spans.winnow([t], 200) for h in hs.tolist()} for t in (long, shared))
    assert b & a


# ------------------------------------------------------------- 2: truncation


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("All is well.", "closed"),
        ("He said “all is well.”", "closed"),
        ("They met Dr.", "open"),
        ("It grew by the old mar", "open"),
        ("Done.\nwww.site.example/480", "own"),
        ("Done.\n\nKlofu 2031", "own"),
        ("Done.\nAnna said: Bern 25", "own"),
        ("Done.\n— Anna Bern", "own"),
        ("Done. ☂", "own"),
        ("Done (Anna)", "own"),
        ("- one\n- the green gate", "item"),
        ("- one;\n- two;", "closed"),
        ("成功了。", "closed"),
        ("ends in half a chara�", "broken"),
        ("They built it with 30.", "closed_number"),
    ],
)
def test_endings(text, kind):
    assert truncation.ending_of(text)[0] == kind


def test_truncated_at_a_limit(spark):
    rng = random.Random(7)
    rows = []
    for i in range(400):
        body = ". ".join(prose(rng, rng.randint(4, 9)).capitalize() for _ in range(rng.randint(4, 22))) + "."
        rows.append((i, "m", body[:600] if len(body) > 600 else body, 1))
    rows += [(900, "m", None, 1), (901, "m", "  ", 1), (902, None, "Fine.", 1), (903, "m", "Cut in the mid", 1), (903, "m", "Cut in the middle, whole later.", 2), (None, "m", "x", 1)]
    df = clashing(spark.createDataFrame(rows, "call_id long, llm_model string, text string, loaded_at int"))
    judged = truncation.judge(truncation.latest(df, "llm_result", "call_id", "llm_model", "text", "loaded_at"))
    cut = {r["record_id"] for r in judged.where("truncated").collect()}
    true = {i for i, _, t, _ in rows[:400] if len(t) == 600 and not t.rstrip().endswith(".")}
    assert cut == true
    rates = {r["source"]: r for r in truncation.rates(judged).collect()}
    assert rates["m"]["truncated"] == len(true) and rates[None]["rate"] == 0.0
    empty = truncation.latest(df.limit(0), "llm_result", "call_id", "llm_model", "text", "loaded_at")
    assert truncation.judge(empty).count() == 0


def test_censored_fit_recovers_the_distribution():
    import math

    rng = random.Random(5)
    counts = {}
    for _ in range(20000):
        x = min(int(math.exp(rng.gauss(6, 0.5))), 600)
        counts[x] = counts.get(x, 0) + 1
    mu, sigma, post = truncation.censored_fit(counts, [600])
    assert abs(mu - 6) < 0.03 and abs(sigma - 0.5) < 0.03 and post[600] > 0.9


# --------------------------------------------------------- 3: near-duplicates


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(11)
    texts, n = {}, 0
    for _ in range(12):
        base = prose(rng, 90).split()
        for edits in (0, 0, 4, 9, 14, 20, 40):
            words = list(base)
            for _ in range(edits):
                words[rng.randrange(len(words))] = prose(rng, 1)
            n += 1
            texts[n] = " ".join(words) if edits else ("  ".join(words)).upper()
    texts[500] = "short"
    texts[501] = texts[502] = " " * 400
    rows = [("document", i, t) for i, t in texts.items()] + [("document", 900, None), ("document", None, "x" * 400), ("document", 1, texts[1]), ("chunk", 1, texts[1])]
    records = clashing(spark.createDataFrame(rows, "kind string, id long, text string"))
    got = {(r["id_a"], r["id_b"]) for r in neardup.all_pairs(*neardup.similar(records)).where("record_kind = 'document'").collect()}
    sets = {i: {t[j : j + 8] for j in range(len(t) - 7)} for i, t in ((i, neardup.normal(t)) for i, t in texts.items() if len(t) >= 300)}
    true = {(a, b) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    assert len(true) > 60 and got == true
    few = neardup.all_pairs(*neardup.similar(records), expand=1).where("record_kind = 'document'")
    assert few.count() < len(true)


def test_hot_groups_lose_nothing(spark, monkeypatch):
    rng = random.Random(2)
    base = prose(rng, 120).split()
    rows = []
    for i in range(30):
        words = list(base)
        words[i] = f"changed{i}"
        rows.append(("document", i, " ".join(words)))
    records = spark.createDataFrame(rows, "kind string, id long, text string")
    monkeypatch.setattr(neardup, "HOT", 8)
    monkeypatch.setattr(neardup, "BLOCK", 7)
    monkeypatch.setattr(neardup, "_hot_keys", lambda reps, total, keys: {int(k): 5 for k in keys(neardup._matrix(reps.toArrow()["tokens"])).ravel() if k})
    members, links = neardup.similar(records)
    assert links.count() == 30 * 29 // 2
    assert {r["links"] for r in neardup.classes(members, links).collect()} == {29}
    assert neardup.similar(records.limit(0))[1].count() == 0


def shares_of(tokens, share):
    out = np.zeros((neardup.BINS, neardup.TOKENS), np.float32)
    out[np.arange(neardup.BINS), tokens] = share
    return out


@pytest.mark.parametrize("share", [1e-6, 0.003, 1 / 3])
@pytest.mark.parametrize("threshold", [0.5, 0.6, 0.8])
def test_frequent_tokens_share_keys(share, threshold):
    """Of a million records, a group whose pairs are all at the threshold, its tokens of any frequency."""
    rng, total, n = np.random.default_rng(5), 1_000_000, 300
    base = rng.integers(1, 2**16, neardup.BINS).astype(np.uint16)
    own = rng.integers(1, 2**16, (n, neardup.BINS)).astype(np.uint16)
    kept = threshold**0.5
    tokens = np.where(rng.random((n, neardup.BINS)) < kept, base, own)
    keys = neardup.keys_of(tokens, shares_of(base, share), total, threshold)
    found = np.zeros((n, n), bool)
    for t in range(keys.shape[1]):
        found |= (keys[:, None, t] == keys[None, :, t]) & (keys[:, None, t] != 0)
    missed = 1 - found[np.triu_indices(n, 1)].mean()
    print("missed", missed, "keys", (keys > 0).sum(1).mean())
    assert missed < 0.004


@pytest.mark.parametrize("hot", [4096, 40])
def test_story_of_a_third_of_the_rows(spark, monkeypatch, hot):
    rng = random.Random(7)
    base = [prose(rng, 5) for _ in range(40)]
    texts = {}
    for i in range(360):
        if i % 3:
            texts[i] = prose(rng, 60) + "".join(rng.choices("abcdefghijklmnop ", k=900))
        else:
            texts[i] = " ".join(prose(rng, 5) if rng.random() < 0.14 else part for part in base)
    records = spark.createDataFrame([("document", i, t) for i, t in texts.items()], "kind string, id long, text string")
    monkeypatch.setattr(neardup, "HOT", hot)
    monkeypatch.setattr(neardup, "BLOCK", 20)
    got = {(r["a"], r["b"]) for r in neardup.similar(records)[1].collect()}
    sets = {i: neardup.shingle_hashes(t) for i, t in texts.items()}
    true = {(a, b): x for a in sets for b in sets if a < b and a % 3 == b % 3 == 0 and (x := neardup.likeness(sets[a], sets[b])) >= 0.6}
    assert sum(x < 0.75 for x in true.values()) > 2000
    missed = set(true) - got
    print("missed", len(missed), "of", len(true))
    assert len(missed) <= 0.002 * len(true) and got <= set(true)


def test_other_thresholds(spark):
    rng = random.Random(23)
    base = [prose(rng, 4) for _ in range(50)]
    texts = {i: " ".join(prose(rng, 4) if rng.random() < 0.13 else part for part in base) for i in range(120)}
    records = spark.createDataFrame([("document", i, t) for i, t in texts.items()], "kind string, id long, text string")
    sets = {i: neardup.shingle_hashes(t) for i, t in texts.items()}
    scores = {(a, b): neardup.likeness(sets[a], sets[b]) for a in sets for b in sets if a < b}
    for threshold in (0.5, 0.7):
        got = {(r["a"], r["b"]) for r in neardup.similar(records, threshold)[1].collect()}
        true = {pair for pair, x in scores.items() if x >= threshold}
        assert len(true) > 400 and got <= true and len(true - got) <= 0.003 * len(true)
    with pytest.raises(ValueError):
        neardup.similar(records, 0.1)


def test_normal_codes():
    import pyarrow as pa

    texts = ["A  b\n\tC", "", "  İSTANBUL ΣΑΣ ", "Đường   Ẅ", "x\u3000\u00a0y"]
    codes, lengths = neardup.normal_codes(pa.array(texts))
    at = np.cumsum(lengths)
    got = [codes[b - n : b].tobytes().decode("utf-32-le") for b, n in zip(at, lengths, strict=True)]
    assert got == [re.sub(r"\s+", " ", t.lower()) for t in texts]


def test_only_exact_copies_have_the_short_form(spark):
    text = prose(random.Random(4), 90)
    near = text.rsplit(" ", 4)[0]
    rows = [("document", i, text) for i in (1, 2, 3)] + [("document", i, text.upper()) for i in (4, 5)] + [("document", 6, near)]
    records = spark.createDataFrame(rows, "kind string, id long, text string")
    members, links = neardup.similar(records)
    got = {(r["id_a"], r["id_b"]) for r in neardup.all_pairs(members, links, 2, full_links=True).collect()}
    assert got == {(a, b) for a in range(1, 7) for b in range(a + 1, 7)} - {(2, 3)}


# -------------------------------------------------------------- 4: splitting


def check_pieces(text, pieces, limit=2000, overlap=150):
    assert pieces[0][0] == 0 and pieces[-1][2] == len(text)
    for before, (start, core, end, _) in zip([None, *pieces], pieces, strict=False):
        assert 0 < end - start <= limit
        if before is not None:
            assert core == before[2] and before[0] <= start <= core and core - start <= overlap


@pytest.mark.parametrize(
    "text",
    ["a" * 1990 + " " + "b" * 1900 + ". x", "a" * 2001, "x" * 4500, " " * 5000, "\n" * 4100, "# H\n" + "word " * 900, "。".join("字" * 40 for _ in range(90)), "- item one\n" * 400],
)
def test_pieces_cover_the_text(text):
    import regex

    pieces = splitting.pieces_of(text)
    check_pieces(text, pieces)
    assert any(k == "hard" for *_, k in pieces) == bool(regex.search(r"[^\s\p{P}]{2001}", text))


def test_pieces_of_random_texts():
    rng = random.Random(8)
    for _ in range(60):
        text = "".join(rng.choice(["\n\n", "\n", ". ", ", ", " ", "w" * rng.randint(1, 900), "字。", "# h\n"]) for _ in range(rng.randint(1, 400)))
        if text:
            check_pieces(text, splitting.pieces_of(text, 300, 40), 300, 40)


def test_siblings_are_merged_whole():
    def part(mark, n):
        return mark + "\n\n" + " ".join("word" for _ in range(n // 5)) + ".\n\n"

    # two small sections, a large one with two subsections, another small one
    text = part("# One", 500) + part("# Two", 600) + "# Three\n\n" + part("## A", 1500) + part("## B", 1200) + part("# Four", 300)
    cores = [text[c:e] for _, c, e, _ in splitting.pieces_of(text)]
    assert [x.lstrip().split("\n")[0] for x in cores] == ["# One", "# Three", "## B", "# Four"]
    assert "# Two" in cores[0] and "## A" in cores[1]
    # the tail of an opened section isn't joined with the next section
    text = "# One\n\n" + "\n\n".join("a sentence here. " * 40 for _ in range(4)) + "\n\n# Two\n\n" + "short. " * 20
    cores = [text[c:e] for _, c, e, _ in splitting.pieces_of(text)]
    assert cores[-1].startswith("# Two") and all("# Two" not in x for x in cores[:-1])
    # nested lists: an item with its sub-items is one node
    items = "".join(f"- item {i}\n" + "".join(f"  - sub {i} {j} {'x ' * 60}\n" for j in range(4)) for i in range(9))
    cores = [items[c:e] for _, c, e, _ in splitting.pieces_of(items)]
    assert len(cores) > 2 and all(x.startswith("- item") for x in cores)
    deep = "".join(" " * i + "- " + "deep " * 30 + "\n" for i in range(200))
    check_pieces(deep, splitting.pieces_of(deep))


def test_split_table(spark):
    rows = [(1, "w " * 1500), (1, "w " * 1500), (2, "short"), (3, None), (None, "w " * 1500), (4, "x" * 3000), (5, "")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    out = splitting.split_oversized(df, "doc_id")
    assert {(r["record_id"], r["hard_cut"]) for r in splitting.found(out, "document").collect()} == {(1, 0), (4, 1)}
    assert splitting.split_oversized(df.limit(0), "doc_id").count() == 0
    with pytest.raises(ValueError):
        splitting.split_oversized(df, "doc_id", limit=100, overlap=90)


# -------------------------------------------------------------- 5: canonical

SAME = "Hôm nay ﬁn… 「引用」，全角！ A\tb\nc चौड़े क्‍षा ๒๕ «Ζέφυρος» «Тихий Лад» naïve Straße 👩‍💻 e.g. 42".replace("ﬁ", "fi")
CHANGED = {
    "ｆｕｌｌ １２": "full 12",
    "café": "café",
    "Tiếng Việt trước": "Tiếng Việt trước",
    "ofﬁce ﬃ": "office ffi",
    "zero​width­﻿": "zerowidth",
    "no break thin": "no break thin",
    "\u0441lean \u039alae \u0456s": "clean Klae is",
    "ðiều": "điều",
    "th‌in": "thin",
}


def test_canonical_forms(spark):
    rows = [(i, v) for i, v in enumerate(CHANGED)] + [(100, SAME), (101, None), (102, ""), (103, "plain text"), (104, "​"), (103, "plain text"), (105, "x" * 50000 + "​" + "y. " * 9000)]
    df = clashing(spark.createDataFrame(rows, "id long, value string"))
    out = {r["id"]: (r["value"], r["changed"]) for r in canonical.canonicalize(df, ["id"]).collect()}
    assert {i: out[i][0] for i in range(len(CHANGED))} == dict(enumerate(CHANGED.values()))
    assert out[100] == (SAME, False) and out[101] == (None, False) and out[102] == ("", False) and out[104] == ("", True)
    assert out[105] == ("x" * 50000 + "y. " * 9000, True)
    hit = {r["id"] for r in canonical.affected(df, ["id"]).collect()}
    assert hit == {i for i, (_, c) in out.items() if c} == {*range(len(CHANGED)), 104, 105}
    assert canonical.canonicalize(df.limit(0), ["id"]).count() == 0


def test_composition_equals_the_standard(spark):
    rng = random.Random(1)
    marks = "̧̨̛̣̱̀́̂̃̆̈̉"
    texts = ["".join(rng.choice("aeiouyAOUEnscdXq") + "".join(rng.choice(marks) for _ in range(rng.randint(0, 4))) for _ in range(6)) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, value string")
    out = {r["id"]: r["value"] for r in canonical.canonicalize(df, ["id"]).collect()}
    assert out == {i: unicodedata.normalize("NFC", t) for i, t in enumerate(texts)}


# -------------------------------------------------------------- 6: sentences

MODEL = {
    "en": {"lead": {"Dr", "No", "p", "J", "K"}, "trail": {"Inc", "U.S", "p.m", "i.e"}, "start": {"The", "In", "At"}, "after_number": set()},
    "de": {"lead": {"Dr", "z"}, "trail": {"B"}, "start": {"Die"}, "after_number": {"Mai"}},
}


@pytest.mark.parametrize(
    ("lang", "text", "units"),
    [
        ("en", "Dr. Lee met J. K. Fo. The U.S. branch sold 26.2 boats. It ended.", ["Dr. Lee met J. K. Fo.", "The U.S. branch sold 26.2 boats.", "It ended."]),
        ("en", "It is in the U.S. The end came at 6 p.m. sharp.", ["It is in the U.S.", "The end came at 6 p.m. sharp."]),
        ("en", "“It rose. It fell?” Ann said. Next.", ["“It rose. It fell?” Ann said.", "Next."]),
        ("en", "Ann said: “It rose.” Then (it fell!) we left. Ok", ["Ann said: “It rose.”", "Then (it fell!) we left.", "Ok"]),
        ("en", "It rose... so we left... We ran.Then we slept.", ["It rose... so we left...", "We ran.", "Then we slept."]),
        ("en", "A heading\n\n- first item\n2. second item\n\nText here.", ["A heading", "- first item", "2. second item", "Text here."]),
        ("en", "See www.site.example daily. 🌊 The sea.", ["See www.site.example daily.", "🌊 The sea."]),
        ("de", "Am 3. Mai kam er z. B. an. „Gut!“ sagte Ann. Die Zeit", ["Am 3. Mai kam er z. B. an.", "„Gut!“ sagte Ann.", "Die Zeit"]),
        ("zh", "他来了。“走吧！好。”安说。完", ["他来了。", "“走吧！好。”安说。", "完"]),
        ("ja", "彼は「来た。行く。」と述べた。次", ["彼は「来た。行く。」と述べた。", "次"]),
        ("hi", "वह आया। “क्या?” राम ने कहा। अंत", ["वह आया।", "“क्या?” राम ने कहा।", "अंत"]),
        ("th", "เขามา ที่นี่ราคา 25 บาท แล้วไป", ["เขามา", "ที่นี่ราคา 25 บาท", "แล้วไป"]),
    ],
)
def test_units(lang, text, units):
    assert [text[a:b] for a, b in sentences.sentence_spans(text, lang, MODEL)] == units


def test_hard_wrapped_lines_are_joined():
    text = "The old towns near the long river found\nthe new markets of the north and then\nthey went home. The rest of the people\nstayed. \n\nShort line\nOther"
    units = [text[a:b] for a, b in sentences.sentence_spans(text, "en", MODEL)]
    assert units[0].startswith("The old towns") and units[0].endswith("went home.") and units[1].endswith("stayed.")


def test_sentence_table(spark):
    rows = [(1, "It rained. It poured.", "en"), (2, None, "en"), (3, " \n ", None), (4, "One. Two.", None), (5, "x" * 60000, "xx"), (1, "It rained. It poured.", "en")]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    models = sentences.learn(docs)
    out = sentences.split_sentences(docs, models).groupBy("doc_id").count()
    assert {r["doc_id"]: r["count"] for r in out.collect()} == {1: 4, 4: 2, 5: 1}
    assert sentences.learn(docs.limit(0)) == {}
    assert sentences.split_sentences(docs.limit(0), {}).count() == 0


def test_language_is_learned_from_whole_texts(spark):
    words = {"en": "the houses of and with this which there", "de": "der Häuser und nicht mit dieser welche", "th": "บ้านของเราและที่นี่", "fr": "les maisons et dans une avec où"}
    rng = random.Random(1)
    rows = [(i * 10 + j, " ".join(rng.choices(w.split(), k=40)), code) for i, (code, w) in enumerate(words.items()) for j in range(8)]
    rows += [(500, "x", None), (501, None, "en"), (502, "", "und"), (503, None, None)]
    model = language.learn_languages(clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert model.codes == ("de", "en", "fr", "th")
    foreign = "der Häuser und " * 20
    assert model.guess(foreign + "the houses of and with this which " * 200) == "en"  # a long foreign head doesn't decide
    assert [model.guess(t) for t in (None, "", "x")] == ["", "", ""] and model.code("EN_us", "der Häuser und nicht") == "en"
    assert language.learn_languages(spark.createDataFrame([], "text string, lang string")).guess("abc") == ""
    assert [language.code_of(x) for x in ("vi-VI", " EN ", "und", None, "12", "Français")] == ["vi", "en", "", "", "", ""]


def test_abbreviations_are_learned(spark):
    rng = random.Random(6)
    names = [f"{a}{b}" for a in ("Bran", "Klor", "Stev", "Mour", "Gleb") for b in ("dis", "kun", "tal", "wen")]
    rows = []
    for i in range(150):
        parts = [f"The {rng.choice(WORDS)} saw Dr. {rng.choice(names)} near {rng.choice(WORDS)}." for _ in range(6)]
        parts += [f"In {rng.choice(WORDS)} the Foo Co. sold {rng.choice(WORDS)}."]
        rows.append((i, " ".join(parts), "en"))
    model = sentences.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))["en"]
    assert "Dr" in model["lead"] and "Co" in model["trail"] and {"The", "In"} <= model["start"]
    assert not {w for w in WORDS if len(w) > 3} & (model["lead"] | model["trail"])


# ----------------------------------------------------------------- 7: tokens


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def test_encoding_is_exact(reference, sf_dir):
    import pandas as pd

    texts = pd.read_parquet(f"{sf_dir}/documents.parquet").text.dropna().tolist()
    rng = random.Random(9)
    alphabet = "aab  \n\t'sREt中文字ไทยहिन्दी́🌊0123.,!<|endoftext|>éß"
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(800)] + ["<|endoftext|>", " " * 700, "a" * 3000, "é" * 500]
    encoder = tokens.PrefixEncoder()
    for t in texts:
        assert encoder.encode(t) == reference.encode(t, add_special_tokens=False).ids, repr(t)


def test_memories_may_be_dropped(monkeypatch):
    monkeypatch.setattr(tokens, "MAX_STATES", 50)
    encoder, plain = tokens.PrefixEncoder(), tokens.PrefixEncoder()
    rng = random.Random(2)
    for _ in range(50):
        t = prose(rng, 20)
        assert encoder.encode(t) == plain.encode(t)


def test_growing_text_follows_appends_and_edits():
    encoder, rng = tokens.PrefixEncoder(), random.Random(12)
    text = tokens.GrowingText(encoder, "Start  ")
    for _ in range(120):
        if rng.random() < 0.5:
            text.append(rng.choice([" ", "  x", "don", "'t", "é", "\n\n", "12", "中文"]))
        else:
            a = rng.randint(0, len(text.text))
            text.replace(a, min(len(text.text), a + rng.randint(0, 6)), rng.choice(["", " ", "new", "'s", "\n"]))
        assert text.ids() == encoder.encode(text.text)
    long = tokens.GrowingText(encoder, prose(rng, 4000))
    assert long.replace(9000, 9004, "edit") < 12 and long.ids() == encoder.encode(long.text)


def test_encoded_table(spark):
    rows = [(1, "It is."), (2, None), (3, ""), (4, "  "), (1, "It is."), (None, "x"), (5, "字" * 40000)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    out = [(r["doc_id"], len(r["ids"])) for r in tokens.encode_corpus(df).collect()]
    sizes = {k: v for k, v in out if k is not None}
    assert len(out) == 7 and sizes[2] == sizes[3] == 0 and sizes[4] > 0 and sizes[5] >= 40000
    assert tokens.encode_corpus(df.limit(0)).count() == 0


# ----------------------------------------------------------------- 8: mixing


def test_mix_reaches_its_shares(spark):
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        source = rng.choice(["Big Post", "big post ", "Mid", "Small", None, "unknown"] if i % 40 else ["Tiny"])
        rows.append((i, source, prose(rng, rng.randint(3, 60))))
    rows += [(9001, "Mid", None), (9002, "Mid", "")]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    goals = [("Big Post", 0.45, 1), ("Mid", 0.2, 2), ("Small", 0.2, 3), ("Tiny", 0.1, 4), ("Absent", 0.05, 2), (None, 0.3, 1)]
    targets = spark.createDataFrame(goals, "source string, target_share double, max_repeats int")
    copies, report = mixing.mix(docs, targets, shortfall=0.0)
    got = {r["source"]: r for r in report.collect()}
    assert set(got) == {"Big Post", "Mid", "Small", "Tiny", "Absent"}
    assert got["Absent"]["tokens"] == 0 and got["Absent"]["actual_share"] == 0
    lengths = {r["doc_id"]: len(r["text"].split()) for r in docs.where("text is not null").select("doc_id", "text").collect()}
    of = {r["doc_id"]: " ".join((r["source"] or "").lower().split()) for r in docs.select("doc_id", "source").collect()}
    used = [(r["source"], r["doc_id"], r["copies"]) for r in copies.collect()]
    for name in ("Big Post", "Mid", "Small"):
        all_ = [lengths[i] for i, k in of.items() if k == name.lower() and lengths.get(i)]
        mean = sum(lengths[i] * n for k, i, n in used if k == name) / sum(n for k, _, n in used if k == name)
        assert abs(mean / (sum(all_) / len(all_)) - 1) < 0.1, name
    for name, share, cap in goals[:4]:
        assert abs(got[name]["actual_share"] - share / 0.95) < 0.004
        assert got[name]["most_repeats"] <= cap
    assert copies.groupBy("doc_id").count().where("count > 1").count() == 0
    half = {r["source"]: r for r in mixing.mix(docs, targets, total_tokens=20000)[1].collect()}
    assert abs(sum(r["tokens"] for r in half.values()) - 19000) < 400 and half["Absent"]["missing_tokens"] == 1000
    more = {r["source"]: r for r in mixing.mix(docs, targets, shortfall=0.5)[1].collect()}
    size = more["Absent"]["missing_tokens"] / 0.05
    assert size > 1.1 * sum(r["tokens"] for r in got.values()) and more["Big Post"]["missing_tokens"] > 0 and more["Big Post"]["most_repeats"] == 1
    for name, share, cap in goals[1:4]:
        assert abs(more[name]["size_share"] - share) < 120 / size and more[name]["most_repeats"] <= cap
    empty = mixing.mix(docs.limit(0), targets)[1].collect()
    assert len(empty) == 5 and all(r["tokens"] == 0 for r in empty)


def test_rates_are_the_closest_ones_and_nothing_else_is_computed(spark, monkeypatch):
    lengths = np.array([3, 10, 40, 7, 90.0])
    rate = mixing._rate(60.0, 150, 2)
    assert rate * lengths.sum() == pytest.approx(60)
    distance = lambda r: float((r / r.sum() * np.log(r / r.sum() * len(r))).sum())
    rng = np.random.default_rng(5)
    for _ in range(50):  # other rates with the same tokens are farther from using all alike
        move = rng.normal(size=5)
        move -= lengths * (lengths @ move) / (lengths @ lengths)
        other = rate + 0.3 * move / np.abs(move).max()
        assert other @ lengths == pytest.approx(60) and distance(other) > 1e-9 > abs(distance(np.full(5, rate)))
    assert [mixing._rate(b, 150, 2) for b in (299.9, 300.0, 300.0 - 1e-9)] == [pytest.approx(299.9 / 150), 2.0, 2.0]
    labels, write = [], mixing.written
    monkeypatch.setattr(mixing, "written", lambda df, label: (labels.append(label), write(df, label))[1])
    docs = spark.createDataFrame([(i, "a" if i % 3 else "b", f"word {i} " * (i % 7 + 1)) for i in range(60)], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    report = {r["source"]: r for r in mixing.mix(docs, targets, total_tokens=200)[1].collect()}
    assert labels == ["mix-sizes", "mix-copies", "mix-copies"]
    assert all(abs(r["tokens"] - 100) <= 3 and 0 < r["copies"] for r in report.values())


# ---------------------------------------------------------------- 9: reading


def test_reading_levels_of_held_out_documents(spark):
    rng = random.Random(5)
    plain, hard = [f"cat{i}" for i in "abcdefghij"], [f"jurisdiction{i}" for i in "abcdefghij"]
    rows, truth = [], {}
    for i in range(600):
        level = rng.choice([1, 2, 3])
        pool = plain * (4 - level) + hard * (level - 1) * 2
        truth[i] = level
        rows.append((i, " ".join(rng.choice(pool) for _ in range(90)), rng.choice(["en", "EN-en"])))
    rows += [(900, "short", "en"), (901, None, "en"), (902, " " * 400, "en"), (903, "猫" * 350, None)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    graded = [(i, f"r{k}", truth[i] if rng.random() > 0.05 else 1, k) for i in range(300) for k in range(2)]
    graded += [(0, "r9", None, 1), (1, "r9", 9, 1), (77777, "r1", 2, 1), (None, "r1", 2, 1)]
    labels = spark.createDataFrame(graded, "doc_id long, rater string, reading_level int, rated_at int")
    out = {r["doc_id"]: r["reading_level"] for r in reading.reading_levels(docs, labels).collect()}
    assert set(out) == {*range(600), 903}
    assert sum(out[i] == truth[i] for i in range(300, 600)) > 285
    none = reading.reading_levels(docs, labels.limit(0))
    assert {r["reading_level"] for r in none.collect()} == {2}
    assert reading.reading_levels(docs.limit(0), labels).count() == 0


# ------------------------------------------------------------------- queries


def test_every_query_runs(spark, sf_dir):
    from docloom.llm.queries import ORACLES, QUERIES

    for name in ("p1_found", "p4_pieces", "p5_found", "p6_found", "p7_ids", "p9_profile"):
        assert QUERIES[name](spark, sf_dir).count() > 0
    assert set(ORACLES) <= set(QUERIES)

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as TX
from docloom.functions.phrases import PATTERNS
from docloom.functions.vectors import HashEmbedding, exact_percentile
from docloom.operators import segments


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression.alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("text", "parts"),
    [
        ("v3.5 ok.Next one", ["v3.5 ok.", "Next one"]),
        ("U.S. economy", ["U.", "S.", "economy"]),
        ("ai?có", ["ai?có"]),
        ("tail。次", ["tail。次"]),
        ('He said "Go." Then left.', ['He said "Go." Then left.']),
        ("a...b ...C", ["a...b ...", "C"]),
        ("Alpha beta. Gamma!Delta à?éx", ["Alpha beta.", "Gamma!", "Delta à?", "éx"]),
        ("", []),
        ("  \n", []),
    ],
)
def test_sentences(spark, text, parts):
    assert one(spark, text, TX.split_sentences(F.col("x"))) == parts


def test_normalize_composes_and_strips(spark):
    assert one(spark, " é  a\t\tb\n\n\n\nc \u0085", TX.normalize_text(F.col("x"))) == "é a b\n\nc"
    assert one(spark, None, TX.normalize_text(F.col("x"))) is None


@pytest.mark.parametrize(
    ("words", "expected"),
    [(2, "One two"), (5, "One two three. Four five."), (6, "One two three. Four five."), (9, "One two three. Four five. Six seven eight nine."), (0, "One two three. Four five. Six seven eight nine.")],
)
def test_trim(spark, words, expected):
    assert one(spark, "One two three. Four  five. Six seven eight nine.", TX.trim_to_words(F.col("x"), F.lit(words))) == expected


def test_segments_clip_and_cross_paragraphs(spark):
    docs = spark.createDataFrame([(1, "A a.\n\nB b. C c. D d."), (2, None), (3, " ")], "id int, text string")
    rows = segments.segment_table(docs, ["id"]).orderBy("center").collect()
    assert [r["text"] for r in rows] == ["A a. B b.", "A a. B b. C c.", "B b. C c. D d.", "C c. D d."]
    assert {r["id"] for r in rows} == {1}


def test_greedy_packing(spark):
    got = one(spark, [60, 100, 40, 1600, 10], segments.greedy_groups(F.col("x"), 150, 1500), "array<int>")
    assert got == [0, 0, 1, 2, 3]
    assert one(spark, [], segments.greedy_groups(F.col("x"), 150, 1500), "array<int>") == []


def test_semantic_chunks_own_every_segment_once(spark):
    body = " ".join(f"Sentence number {i} about topic {i // 7}." for i in range(60))
    docs = spark.createDataFrame([(1, body), (2, "Short."), (3, None)], "id int, text string")
    rows = segments.semantic_chunks(docs, ["id"], 40, 90, 50.0, 75).collect()
    centers = sorted(u["center"] for r in rows if r["id"] == 1 for u in r["units"])
    assert centers == list(range(60))
    assert sum(r["id"] == 2 for r in rows) == 1
    assert not any(r["id"] == 3 for r in rows)


def test_semantic_pieces_cut_at_large_distances():
    vectors = HashEmbedding().encode(["a b", "a b", "c d", "c d"])
    assert segments.semantic_pieces(["s1", "s2", "s3", "s4"], vectors, 50, 0) == ["s1 s2", "s3 s4"]
    assert segments.semantic_pieces(["only"], vectors[:1], 50, 0) == ["only"]


def test_hash_embedding_values():
    v = HashEmbedding().encode(["alpha", "beta", "alpha beta beta", ""])
    assert v[0, 211] == -1 and v[1, 19] == -1
    assert round(v[2, 19], 6) == -0.894427 and round(v[2, 211], 6) == -0.447214
    assert not v[3].any()


def test_percentile():
    assert exact_percentile([1, 2, 4, 9], 65) == pytest.approx(3.9)


def test_factual_patterns(spark):
    text = "Rose 12,5 % to $3.5 billion on 12/05/2020; 5 tỷ đồng, USD 20, 1,234,567 in 1999 and 30-4."
    found = {k: one(spark, text, F.regexp_extract_all("x", F.lit(p), F.lit(0))) for k, p in PATTERNS.items()}
    assert found["percent"] == ["12,5 %"]
    assert [m.strip() for m in found["money"]] == ["$3.5 billion", "5 tỷ đồng", "USD 20"]
    assert found["date"] == ["12/05/2020", "1999", "30-4"]
    assert [m.strip() for m in one(spark, "vndmk 5 USD 7 Tỷ 5 TRIỆU 3 ĐỒNG 9", F.regexp_extract_all("x", F.lit(PATTERNS["money"]), F.lit(0)))] == ["USD 7 Tỷ", "5 TRIỆU", "ĐỒNG 9"]


def test_prompt_block(spark):
    prompt = "Intro\n\nSource support (x):\n---\n first line\nsecond \n---\nrest"
    assert one(spark, prompt, TX.prompt_block(F.col("x"), "source support")) == "first line\nsecond"
    assert one(spark, "nothing", TX.prompt_block(F.col("x"), "source support")) == ""

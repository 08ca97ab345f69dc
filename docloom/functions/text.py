"""Text expressions, on the JVM wherever it can express them.

White space means Unicode white space throughout: Java's default class is ASCII
only, so the class is spelled out.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"
SOLID = r"[^\s\x{1c}-\x{1f}\x{85}\p{Z}]"
STOPS = ".!?。！？"
# fixed value: after a stop, white space or a character of this range starts a new sentence
SENTENCE_BREAK = r"(?<=[.!?。！？])" + SPACE + r"+|(?<=[.!?。！？])(?=[A-Z\x{c0}-\x{1ef4}])"

SPACED_BREAK = r"(?<=[.!?。！？])" + SPACE + "+"


@F.pandas_udf(T.StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def normalize_text(text: Column) -> Column:
    """NFC, runs of blanks and tabs to one blank, at most one empty line, stripped.

    Composition has no expression on the JVM; the texts that may need it (those
    with a combining mark or another character that NFC changes) take a pandas
    function, all others stay in generated code.
    """
    loose = r"[\x{300}-\x{36f}\x{483}-\x{489}\x{591}-\x{5c7}\x{610}-\x{670}\x{6d6}-\x{6ed}\x{93c}\x{958}-\x{95f}\x{9be}-\x{fbc}\x{1100}-\x{11ff}\x{1f71}-\x{1fff}\x{2000}\x{2001}\x{2126}\x{212a}\x{212b}\x{2329}\x{232a}\x{3099}\x{309a}\x{f900}-\x{fb4e}]"
    composed = F.when(text.rlike(loose), _nfc(F.when(text.rlike(loose), text))).otherwise(text)
    return strip(F.regexp_replace(F.regexp_replace(composed, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def _nonblank(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def split_paragraphs(text: Column) -> Column:
    """Paragraphs of an already normalised text; blank text gives none."""
    return _nonblank(F.split(text, rf"\n{SPACE}*\n+"))


def split_sentences(text: Column) -> Column:
    return _nonblank(F.split(text, SENTENCE_BREAK))


def count_tokens(text: Column) -> Column:
    """Number of runs of anything but white space; null counts none."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(rf"{SOLID}+"), F.lit(0))), F.lit(0))


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, rf"{SPACE}+", " "))


def normalize_phrase(text: Column) -> Column:
    return F.lower(collapse(text))


def first_words(text: Column, words: Column) -> Column:
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(rf"{SOLID}+"), F.lit(0)), F.lit(1), words), " ")


def trim_to_words(text: Column, words: Column) -> Column:
    """Leading sentences within ``words``; the first is cut if it alone is longer.

    Null or non-positive ``words`` only collapse white space.
    """
    flat = collapse(text)
    parts = F.transform(_nonblank(F.split(flat, SPACED_BREAK)), lambda s: F.struct(s.alias("s"), count_tokens(s).alias("n")))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("n"), F.lit(False).alias("full"))

    def step(acc: Column, x: Column) -> Column:
        fits = ~acc["full"] & (acc["n"] + x["n"] <= words)
        return F.struct(
            F.when(fits, F.concat(acc["kept"], F.array(x["s"]))).otherwise(acc["kept"]).alias("kept"),
            F.when(fits, acc["n"] + x["n"]).otherwise(acc["n"]).alias("n"),
            (acc["full"] | ~fits).alias("full"),
        )

    kept = F.aggregate(parts, start, step)["kept"]
    trimmed = F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(first_words(flat, F.greatest(words, F.lit(1))))
    return F.when(words.isNull() | (words <= 0), flat).otherwise(trimmed)


def prompt_block(prompt: Column, label: str) -> Column:
    """The text between the two --- lines after ``label``; empty if there is none."""
    return F.regexp_extract(prompt, rf"(?is){label}[^\n]*:{SPACE}*---{SPACE}*(.*?){SPACE}*---", 1)


def document_block(number: Column, document_id: Column, title: Column, source: Column, text: Column) -> Column:
    def line(name: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{name}: "), value))

    head = F.concat(F.lit("[Document "), number.cast("string"), F.lit(": "), document_id, F.lit("]"))
    return F.concat_ws("\n", head, line("Title", title), line("Source", source), text)


def language_name(lang: Column) -> Column:
    return F.when(lang == "vi", "Vietnamese").otherwise("English")

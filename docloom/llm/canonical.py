"""Problem 5: one consistent form for text that looks the same.

Values that hold none of the characters in question pass through untouched
(one regular expression on the JVM).  The others are cut into words; words that
hold such a character are exploded into positioned code points, which are
broadcast-joined with the width, ligature, decomposition and look-alike
mappings; combining marks are ordered by class behind their base, recomposed by
broadcast joins pair by pair, and the strings are rebuilt.  All mapping tables
have a fixed size.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.runtime import written

# fixed values: letters of other scripts (and of no script) that look like a letter a reader would type
LOOKALIKES = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d",
    "ԛ": "q", "ԝ": "w", "ӏ": "l", "ё": "ë", "ї": "ï", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O",
    "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ё": "Ë", "Ї": "Ï",
    "к": "k", "ѵ": "v", "Ѵ": "V", "Ү": "Y", "ү": "y",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "α": "a", "ι": "i", "κ": "k", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ε": "e",
    "η": "n", "γ": "y", "σ": "o", "ω": "w", "ϲ": "c", "Ϲ": "C", "ϳ": "j", "ϱ": "p",
    # Armenian
    "օ": "o", "հ": "h", "ո": "n", "ս": "u", "Տ": "S", "Օ": "O", "Լ": "L",
}
# fixed values: Latin letters outside the alphabets in use that look like one of theirs, and letter-like signs
LATIN_LOOKALIKES = {
    "\u00f0": "đ", "\u00d0": "Đ", "\u0189": "Đ", "\u0251": "a", "\u0261": "g", "\u0131": "i", "\u0237": "j", "\u0269": "i",
    "\u028f": "y", "\u01bd": "s", "\u01c0": "l", "\u017f": "s", "\u212a": "K", "\u212b": "Å",
}
MARKS = r"\x{300}-\x{36f}"
# fixed values: kept where Hindi spelling or an emoji needs them
JOINERS = "\u200c\u200d"


def _chars(ranges: list[tuple[int, int]], test) -> list[str]:
    return [chr(c) for a, b in ranges for c in range(a, b) if test(chr(c))]


@lru_cache(1)
def mappings() -> dict[str, list[tuple]]:
    """The mapping tables, made from the character database by rule."""
    width = [(c, unicodedata.normalize("NFKC", c)) for c in _chars([(0xFF01, 0xFF5F)], str.isalnum)]
    joined = [(c, unicodedata.normalize("NFKC", c)) for c in _chars([(0xFB00, 0xFB07), (0x0132, 0x0134), (0x01C7, 0x01CD)], str.isalpha)]
    # emoji tag characters and variation selectors are not invisible characters of their own
    unseen = [
        (c, "")
        for c in _chars([(0, 0x3100), (0xFE00, 0xFFFA)], lambda c: unicodedata.category(c) == "Cf" and not 0x600 <= ord(c) < 0x900)
        if c not in JOINERS
    ] + [(c, "") for c in "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0"]
    spaces = [(c, " ") for c in _chars([(0x80, 0x3001)], lambda c: unicodedata.category(c) == "Zs")]
    letters = _chars([(0xC0, 0x250), (0x370, 0x530), (0x1E00, 0x2000)], str.isalpha)
    parts, pairs = [], []
    for c in letters:
        raw = unicodedata.decomposition(c)
        if raw and not raw.startswith("<") and " " in raw:
            base, mark = (chr(int(x, 16)) for x in raw.split())
            if unicodedata.normalize("NFC", base + mark) == c:
                pairs.append((base, mark, c))
        full = unicodedata.normalize("NFD", c)
        if len(full) > 1:
            parts.append((c, full))
    for a in _chars([(0x3040, 0x3100)], str.isalpha):
        for mark in "\u3099\u309a":
            c = unicodedata.normalize("NFC", a + mark)
            if len(c) == 1:
                pairs.append((a, mark, c))
    classes = [(c, unicodedata.combining(c)) for c in _chars([(0x300, 0x370), (0x3099, 0x309B)], lambda c: unicodedata.combining(c) > 0)]
    return {
        "plain": width + joined + unseen + spaces,
        "latin": list(LATIN_LOOKALIKES.items()),
        "foreign": list(LOOKALIKES.items()),
        "parts": parts,
        "pairs": pairs,
        "classes": classes,
    }


# fixed values: the stretches of the code space with every character that a mapping or composition may touch;
# a superset is fine, but letters and signs of everyday text are left out, and few ranges make the scan fast
SUSPECT = (
    r"[\x{a0}\x{ad}\x{d0}\x{f0}\x{131}-\x{133}\x{17f}\x{189}\x{1bd}-\x{1cc}\x{237}-\x{58f}\x{61c}\x{115f}\x{1160}\x{1680}"
    r"\x{17b4}\x{17b5}\x{180e}\x{2000}-\x{200f}\x{202a}-\x{202f}\x{205f}-\x{206f}\x{212a}\x{212b}\x{3000}\x{3099}\x{309a}\x{3164}"
    r"\x{fb00}-\x{fb06}\x{feff}\x{ff10}-\x{ff19}\x{ff21}-\x{ff3a}\x{ff41}-\x{ff5a}\x{ffa0}\x{fff9}-\x{fffb}]"
)
LETTERS = r"\p{L}\p{M}\p{N}\p{Cf}\p{So}\p{Sk}\x{3000}"


def _table(spark, rows: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema))  # fixed size: a few thousand rows at most


def _runs(column: Column) -> Column:
    """Alternating runs: letters with their marks and joiners, or anything else."""
    return F.regexp_extract_all(column, F.lit(f"[{LETTERS}]+|[^{LETTERS}]+"), F.lit(0))


def fixed_runs(words: DataFrame) -> DataFrame:
    """``(_word, _fixed)`` of the distinct runs ``_word`` that change."""
    spark = words.sparkSession
    m = mappings()
    plain = _table(spark, m["plain"], "ch string, to string")
    latin = _table(spark, m["latin"], "ch string, lat string")
    foreign = _table(spark, m["foreign"], "ch string, look string")
    parts = _table(spark, m["parts"], "out string, full string")
    classes = _table(spark, m["classes"], "ch string, ccc int")

    code = words.select("_word", F.posexplode(F.split("_word", "")).alias("_pos", "ch")).where("ch <> ''")
    code = code.withColumn("_before", F.lag("ch").over(W.partitionBy("_word").orderBy("_pos")))
    joins = r"[\x{94d}\x{9cd}\x{a4d}\x{acd}\x{b4d}\x{bcd}\x{c4d}\x{ccd}\x{d4d}\x{dca}\x{200d}\x{fe0f}\x{2190}-\x{2bff}\x{1f000}-\x{1faff}]"
    needed = F.col("ch").isin(*JOINERS) & F.coalesce(F.col("_before").rlike(joins), F.lit(False))
    wide = (F.col("ch") == "\u3000") & F.coalesce(F.col("_before").rlike(r"[\x{2e80}-\x{9fff}\x{ff00}-\x{ffef}]"), F.lit(False))
    code = code.join(plain, "ch", "left").join(latin, "ch", "left").join(foreign, "ch", "left")
    code = code.withColumn(
        "to", F.when(needed | wide, F.col("ch")).when(F.col("ch").isin(*JOINERS), "").otherwise(F.coalesce("to", "lat"))
    )
    # a foreign letter is a look-alike only in a run with Latin letters, all of whose foreign letters have a twin
    run = W.partitionBy("_word")
    is_latin = F.coalesce(F.col("to"), F.col("ch")).rlike(r"\p{IsLatin}").cast("int")
    no_twin = (F.col("look").isNull() & F.col("ch").rlike(r"\p{IsCyrillic}|\p{IsGreek}|\p{IsArmenian}")).cast("int")
    code = code.withColumn("_mixed", (F.max(is_latin).over(run) == 1) & (F.max(no_twin).over(run) == 0))
    out = F.coalesce(F.col("to"), F.when(F.col("_mixed"), F.col("look")), F.col("ch"))
    code = code.select("_word", "_pos", out.alias("out")).join(parts, "out", "left")
    # decompose: one row for each code point, marks ordered by class behind their base
    atoms = code.select("_word", "_pos", F.posexplode(F.split(F.coalesce("full", "out"), "")).alias("_sub", "ch")).where("ch <> ''")
    atoms = atoms.join(classes, "ch", "left").fillna(0, ["ccc"])
    cluster = F.sum((F.col("ccc") == 0).cast("int")).over(W.partitionBy("_word").orderBy("_pos", "_sub"))
    grouped = atoms.withColumn("_cluster", cluster).groupBy("_word", "_cluster")
    grouped = grouped.agg(F.array_sort(F.collect_list(F.struct("ccc", "_pos", "_sub", "ch"))).alias("g"))
    made = grouped.select(
        "_word", "_cluster", F.get("g", F.lit(0))["ch"].alias("base"), F.slice("g", 2, 1 << 20).alias("marks"), F.lit("").alias("kept"), F.lit(0).alias("block")
    )
    for i in range(4):  # no letter has more marks of its own; further ones stay behind it
        mark = F.get("marks", F.lit(i))
        pair = _table(spark, m["pairs"], "base string, _mark string, _made string")
        made = made.withColumn("_mark", mark["ch"]).join(pair, ["base", "_mark"], "left")
        fits = F.col("_made").isNotNull() & (F.col("block") < mark["ccc"])
        made = made.select(
            "_word",
            "_cluster",
            F.when(fits, F.col("_made")).otherwise(F.col("base")).alias("base"),
            "marks",
            F.when(fits | mark.isNull(), F.col("kept")).otherwise(F.concat("kept", mark["ch"])).alias("kept"),
            F.when(fits | mark.isNull(), F.col("block")).otherwise(mark["ccc"]).alias("block"),
        )
    tail = F.array_join(F.transform(F.slice("marks", 5, 1 << 20), lambda x: x["ch"]), "")
    made = made.select("_word", F.struct("_cluster", F.concat("base", "kept", tail).alias("text")).alias("c"))
    rebuilt = F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda x: x["text"]), "")
    fixed = made.groupBy("_word").agg(rebuilt.alias("_fixed"))
    # runs of nothing but invisible characters have no atoms left
    return words.join(fixed, "_word", "left").select("_word", F.coalesce("_fixed", F.lit("")).alias("_fixed")).where("_fixed <> _word")


def affected(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """The distinct ``keys`` of the values that :func:`canonicalize` changes."""
    hit = df.where(F.col(value).rlike(SUSPECT)).select(*keys, F.explode(F.array_distinct(_runs(F.col(value)))).alias("_word"))
    odd = written(hit.where(F.col("_word").rlike(SUSPECT)), "canonical-runs")
    return odd.join(fixed_runs(odd.select("_word").distinct()), "_word", "left_semi").select(*keys).distinct()


def canonicalize(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """``keys``, ``value`` in canonical form, ``changed`` (boolean).

    Changed are: letters and digits of full width, a base letter and an accent
    stored apart where one character exists for both, joined letters,
    invisible characters, spaces other than the ordinary one, and single
    letters of another script inside a word (or of no alphabet in use) that
    only look like the right one.  Left alone: wide punctuation, words wholly
    in another script, joiners after a Devanagari sign or in an emoji, the
    ellipsis, line breaks, tabs, Devanagari and Thai signs.  Null stays null
    (not changed), empty stays empty.  Rows with equal keys and equal values
    are one row; with equal keys and unequal values each is kept.
    """
    hit = F.coalesce(F.col("_value").rlike(SUSPECT), F.lit(False))
    base = df.select(*keys, F.col(value).alias("_value"))
    clean = base.where(~hit).select(*keys, F.col("_value").alias("value"), F.lit(False).alias("changed"))
    runs = written(base.where(hit).distinct().select(*keys, F.xxhash64("_value").alias("_text"), F.posexplode(_runs(F.col("_value"))).alias("_at", "_word")), "canonical-text")
    lookup = fixed_runs(runs.where(F.col("_word").rlike(SUSPECT)).select("_word").distinct())
    pieces = F.array_sort(F.collect_list(F.struct("_at", F.coalesce("_fixed", "_word").alias("w"))))
    done = (
        runs.join(lookup, "_word", "left")
        .groupBy(*keys, "_text")
        .agg(F.array_join(F.transform(pieces, lambda x: x["w"]), "").alias("value"), F.max(F.col("_fixed").isNotNull()).alias("changed"))
    )
    return clean.unionByName(done.select(*keys, "value", "changed"))


def fields(documents: DataFrame, ref_texts: DataFrame) -> DataFrame:
    """All values of the problem: record_kind, record_id, field_name, value."""
    one = documents.select(
        F.lit("document").alias("record_kind"),
        F.col("doc_id").cast("long").alias("record_id"),
        F.explode(F.create_map(F.lit("text"), F.col("text"), F.lit("title"), F.col("title"))).alias("field_name", "value"),
    )
    two = ref_texts.select(
        F.lit("reference").alias("record_kind"), F.col("ref_id").cast("long").alias("record_id"), F.lit("text").alias("field_name"), F.col("text").alias("value")
    )
    return one.unionByName(two)

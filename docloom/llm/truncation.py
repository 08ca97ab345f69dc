"""Problem 2: texts that were cut off, and how often each source cuts.

Two kinds of evidence are combined as log odds.  By its definition a text that
stops inside a word or sentence is cut, and one that stops with a sentence isn't;
for all other endings the two decide together.

*Length.*  Where a source cuts at a limit, its length distribution has a spike
there.  For each source and unit (code points, bytes, words) the histogram of
lengths is searched for spikes, a log-normal with right-censoring at those
limits is fitted by maximum likelihood (EM over the censored part), and every
value at a limit gets the posterior that it was censored.

*Ending.*  A full stop (with closing marks) ends a text, an abbreviation's dot
or a decimal's doesn't; links, date lines, signatures, names in brackets and
symbols are ends of their own.  List items and scripts without full stops are
judged by how often, in the whole corpus, the last words end a sentence or item.
How likely each of these endings is in cut and in whole texts is fitted to the
records themselves (EM): at a limit the length says how many are cut, elsewhere
the endings that leave no doubt say it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.runtime import spread, written

UNITS = ("chars", "bytes", "words")
SURE = {"open": True, "broken": True, "closed": False}  # cut or not by definition
# first guesses of the log likelihood ratios of the other endings, cut against
# whole; they weigh as much as GUESS records do
GUESSES = {"closed_number": -1.0, "item": -1.0, "bare": -1.0, "own": -3.5, "own_short": -1.0}
GUESS = 8.0
STEP, MOST = 1.0, 6  # width and number (each way) of the classes of the statistic of the last words
FILTER_BITS = 1 << 25  # of the filter for the last words that are counted
TOKENS_PER_END = math.log(12.0)  # words for each end of a sentence or item, about
# fixed values: abbreviations that stand before a name or number, so that a text can't end with them
LEADING = frozenset(
    "dr mr mrs ms st mt gen gov prof no nos p pp vs cf vgl hr fr nr bzw sr sra núm av art ts gs bs pgs ks tx tp q tr ths "
    "approx e.g i.e z d h u ex ej jr rev sen rep col lt capt fig vol ed bd s".split()
)


@lru_cache(1)
def _patterns():
    import regex

    return {
        "stop": regex.compile(r"(?:[.!?…。！？।؟]|[;；:](?=\s*$))[\"'”“»«’」』）)\]]*$"),
        "number_dot": regex.compile(r"(?<![\p{L}\p{N}.,/-])\d{1,4}[.]$"),
        "short_dot": regex.compile(r"(?:^|[\s(\[“\"„«])([\p{L}.\-]{1,6})\.$"),
        "item": regex.compile(r"^\s*(?:[-*•–—]|\(?\w{1,3}[.)])\s+\S"),
        "link": regex.compile(r"^(?:https?://|www\.)\S+\.\p{L}{2,}(/\S*)?$"),
        "date": regex.compile(r"^\p{Lu}[\p{L}\p{M}' .-]{0,40} (\d{1,4})$"),
        "dateline": regex.compile(r"^[\p{L}\p{M}][\p{L}\p{M}' .-]{0,40},? \d{1,2}[./]\d{1,2}[./]\d{2,4}$"),
        "signed": regex.compile(r"^[^:]{2,60}[:：] ?\p{Lu}[\p{L}\p{M}' .-]{0,40} (\d{1,3})$"),
        "dash": regex.compile(r"^[—–] ?\p{Lu}[\p{L}\p{M}'.-]*(?: \p{Lu}[\p{L}\p{M}'.-]*){0,4}$"),
        "symbol": regex.compile(r"[\p{So}\p{Sk}\ufe0f\u200d]$"),
        "bracket": regex.compile(r"[(（\[][^()（）\[\]\n]{1,60}[)）\]]$"),
        "unspaced": regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]$"),
        "stopless": regex.compile(r"[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]"),
        "word": regex.compile(r"\S+"),
    }


def ending_of(text: str) -> tuple[str, str]:
    """(class of the ending, statistic token: the last words or characters)."""
    p = _patterns()
    body = text.rstrip()
    if not body:
        return "closed", ""
    if body.endswith("�"):
        return "broken", ""
    last = body[body.rfind("\n") + 1 :].strip()
    alone = "\n" in body
    if p["symbol"].search(body):
        return "own", ""
    if alone and (m := p["link"].match(last)):
        return ("own" if m[1] and len(m[1]) > 2 else "own_short"), ""
    if alone and p["dateline"].match(last):
        return "own", ""
    if alone and (m := p["signed"].match(last)):
        return ("own" if len(m[1]) > 1 else "own_short"), ""
    if alone and not p["item"].match(last) and (m := p["date"].match(last)):
        return ("own" if len(m[1]) == 4 else "open"), ""
    if alone and p["dash"].match(last):
        return "own", ""
    words = p["word"].findall(last)
    if p["stop"].search(body):
        if body.endswith((";", "；", ":", "：")):
            return ("closed" if p["item"].match(last) and body.endswith((";", "；")) else "open"), ""
        if (m := p["short_dot"].search(last)) and m[1].lower().strip(".") in LEADING:
            return "open", ""
        if p["number_dot"].search(last):
            return "closed_number", " ".join(_shape(w) for w in (words[-2:] if len(words) > 1 else ["", *words])).rstrip(".")
        return "closed", ""
    if p["bracket"].search(body):
        return "own", ""
    token = ""
    if p["unspaced"].search(body):
        token = "\x00" + body[-3:]
    elif words:
        token = " ".join(_shape(w) for w in (words[-2:] if len(words) > 1 else ["", *words]))
    if p["item"].match(last) and len(words) > 1:
        return "item", token
    if p["stopless"].search(body[-40:]):
        return "bare", token
    return "open", token


_DIGITS = re.compile(r"\d+")


def _shape(word: str) -> str:
    return _DIGITS.sub("9", word).lower()


def features(records: DataFrame) -> DataFrame:
    """record_kind, record_id, source, chars, bytes, words, ending, token of
    every non-blank text, one row for each record (the latest of several)."""
    schema = "record_kind string, record_id long, source string, chars int, bytes int, words int, ending string, token string, small boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3).to_pylist()
            ends = [ending_of(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3],
                    pa.array([len(t) for t in texts], pa.int32()),
                    pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int32()),
                    pa.array([len(t.split()) for t in texts], pa.int32()),
                    pa.array([e[0] for e in ends]),
                    pa.array([e[1] for e in ends]),
                    pa.array([(t.split() or [""])[-1][:1].islower() for t in texts]),
                ],
                names=["record_kind", "record_id", "source", "chars", "bytes", "words", "ending", "token", "small"],
            )

    return spread(records.select("record_kind", "record_id", "source", "text")).mapInArrow(run, schema)


def latest(df: DataFrame, kind: str, key: str, source: str, text: str, loaded: str) -> DataFrame:
    """One row for each key: the text of the latest delivery (ties: the longer,
    then the greater text).  Null keys and null or blank texts are left out."""
    best = F.max(F.struct(F.col(loaded).alias("at"), F.length(text).alias("n"), F.col(text).alias("text"), F.col(source).alias("source")))
    return (
        df.where(F.col(key).isNotNull() & F.col(text).isNotNull())
        .groupBy(F.col(key).cast("long").alias("record_id"))
        .agg(best.alias("r"))
        .select(F.lit(kind).alias("record_kind"), "record_id", F.col("r.source").alias("source"), F.col("r.text").alias("text"))
        .where(F.col("text").rlike(r"(?U)\S"))
    )


def _normal(z: float) -> tuple[float, float]:
    return math.exp(-z * z / 2) / math.sqrt(2 * math.pi), 0.5 * math.erfc(z / math.sqrt(2))


def censored_fit(counts: dict[int, int], limits: list[int], rounds: int = 40) -> tuple[float, float, dict[int, float]]:
    """(mu, sigma, {limit: posterior}) of a log-normal, right-censored at limits.

    E step: at a limit the surplus over the fitted density is censored there,
    with the tail's mean and square; M step: moments of the log lengths.
    """
    free = [(math.log(x), n) for x, n in counts.items() if x > 0]
    total = sum(n for _, n in free) or 1
    mu = sum(y * n for y, n in free) / total
    sigma = max(math.sqrt(sum((y - mu) ** 2 * n for y, n in free) / total), 0.05)
    post = dict.fromkeys(limits, 0.9)
    for _ in range(rounds):
        s0 = s1 = s2 = 0.0
        for x, n in counts.items():
            if x <= 0:
                continue
            y, w = math.log(x), post.get(x, 0.0)
            s0, s1, s2 = s0 + n * (1 - w), s1 + n * (1 - w) * y, s2 + n * (1 - w) * y * y
            if w:
                z = (y - mu) / sigma
                pdf, tail = _normal(z)
                ratio = pdf / tail if tail > 1e-12 else z + 1 / max(z, 1.0)
                mean = mu + sigma * ratio
                square = mu * mu + 2 * mu * sigma * ratio + sigma * sigma * (1 + z * ratio)
                s0, s1, s2 = s0 + n * w, s1 + n * w * mean, s2 + n * w * square
        mu = s1 / s0
        sigma = max(math.sqrt(max(s2 / s0 - mu * mu, 0.0)), 0.05)
        for limit in limits:
            z = (math.log(limit) - mu) / sigma
            expected = total * _normal(z)[0] / (sigma * limit)
            around = [counts.get(limit + d, 0) for d in range(-12, 13) if abs(d) > 3]
            expected = max(expected, sum(around) / len(around), 0.02)
            post[limit] = min(max(1 - expected / counts[limit], 0.0), 0.999)
    return mu, sigma, post


def _limits(counts: dict[int, int]) -> list[int]:
    """Lengths whose count stands out from the neighbourhood."""
    out = []
    for x, n in counts.items():
        if n < 5:
            continue
        around = sorted(counts.get(x + d, 0) for d in range(-20, 21) if abs(d) > 3)
        mean = max(sum(around[:-2]) / len(around[:-2]), 0.15)
        # Poisson tail of n or more at that mean, for about a thousand lengths tried
        if n > mean and n * math.log(n / mean) - (n - mean) > 12:
            out.append(x)
    return out


def _fit_limits(pdf: pd.DataFrame) -> pd.DataFrame:
    """One source and unit, already counted: a row for each distinct length."""
    counts = dict(zip(pdf["value"].tolist(), pdf["n"].tolist(), strict=True))
    limits = _limits(counts)
    rows = []
    if limits:
        _, _, post = censored_fit(counts, limits)
        rows = [(pdf["source"].iloc[0], pdf["unit"].iloc[0], x, p, p * counts[x]) for x, p in post.items() if p >= 0.5]
    return pd.DataFrame(rows, columns=["source", "unit", "value", "posterior", "surplus"])


def limits_by_source(feats: DataFrame) -> DataFrame:
    """source, unit, value, posterior, surplus: lengths at which a source cuts.

    A limit in one unit makes faint spikes in the others.  So the unit with the
    largest surplus is taken first, its records set aside, and the next unit
    fitted to the rest.  Word counts say nothing about texts of a few words
    (scripts without spaces).
    """
    rest = feats.select(
        F.coalesce("source", F.lit("")).alias("source"), "record_kind", "record_id", "chars", "bytes", F.when(F.col("words") > 15, F.col("words")).alias("words")
    )
    found = None
    schema = "source string, unit string, value int, posterior double, surplus double"
    for _ in UNITS:
        tall = rest.select("source", F.explode(F.create_map(*[x for u in UNITS for x in (F.lit(u), F.col(u))])).alias("unit", "value"))
        histogram = tall.where("value is not null").groupBy("source", "unit", "value").agg(F.count("*").alias("n"))
        fitted = histogram.groupBy("source", "unit").applyInPandas(_fit_limits, schema)
        if found is not None:
            fitted = fitted.join(found.select("source", "unit").distinct(), ["source", "unit"], "left_anti")
        strongest = fitted.groupBy("source", "unit").agg(F.sum("surplus").alias("s")).groupBy("source").agg(F.max_by("unit", "s").alias("unit"))
        fitted = written(fitted.join(strongest, ["source", "unit"]), "truncation-limits")
        found = fitted if found is None else written(found.unionByName(fitted), "truncation-limits")
        for unit in UNITS:
            at = fitted.where(F.col("unit") == unit).select("source", F.col("value").alias(unit))
            rest = rest.join(at, ["source", unit], "left_anti")
    return found


_CLOSED = re.compile(r"[.!?…。！？।;；][\"'”“»«’」』）)\]]*$")
_CLEAN = ".!?…。！？।;；,\"'”“»«’」』）)]"
_UNSPACED = re.compile(r"[\u0e00-\u0eff\u3040-\u30ff\u4e00-\u9fff]")
_STOPS = re.compile(r"[\s。！？;；」”）]")
_WORDS = re.compile(r"[^\s]+|\n")


def _tally(text: str, seen: Counter, ended: Counter) -> None:
    """Counts the words, the pairs of words and (in scripts without spaces) the
    strings of three characters of a text, and how many end a sentence, item or line."""
    words = [_shape(w) if w != "\n" else w for w in _WORDS.findall(text)]
    before = ""
    for w, after in zip(words, [*words[1:], "\n"], strict=True):
        x = w.rstrip(_CLEAN) if w != "\n" else w
        if x:
            pair = f"{before} {x}"
            seen[x] += 1
            seen[pair] += 1
            if after == "\n" or _CLOSED.search(w):
                ended[x] += 1
                ended[pair] += 1
        before = w
    if _UNSPACED.search(text):
        seen.update(["\x00" + text[i : i + 3] for i in range(len(text) - 2)])
        for m in _STOPS.finditer(text, 3):
            ended["\x00" + text[m.start() - 3 : m.start()]] += 1
        ended["\x00" + text[-3:]] += 1


def end_statistics(records: DataFrame, tokens: DataFrame) -> DataFrame:
    """token, n, ends: how often each of ``tokens`` occurs in the corpus and how
    often it ends a sentence, an item or a line there.

    All texts are counted; a filter of fixed size (4 MB) keeps most strings that
    nobody asks for out of the shuffle, and the join behind it is exact.
    """
    import xxhash

    width = 32768

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) % FILTER_BITS for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([a // width for a in at], pa.int32()), pa.array([a % width for a in at], pa.int64())], names=["slice", "bit"])

    slices = tokens.mapInArrow(spots, "slice int, bit long").groupBy("slice").agg(F.bitmap_construct_agg("bit").alias("bits"))
    field = np.zeros((FILTER_BITS // width, width // 8), np.uint8)
    for r in slices.collect():  # at most FILTER_BITS / 32,768 rows of 4 KB
        field[r["slice"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    shared = records.sparkSession.sparkContext.broadcast(field.ravel())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, seen, ended = shared.value, Counter(), Counter()

        def out() -> Iterator[pa.RecordBatch]:
            rows = []
            for t, n in seen.items():
                a = xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) % FILTER_BITS
                if field[a >> 3] >> (a & 7) & 1:
                    rows.append((t, n, ended[t]))
            for i in range(0, len(rows), 20_000):
                t, n, e = zip(*rows[i : i + 20_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(n, pa.int64()), pa.array(e, pa.int64())], names=["token", "n", "ends"])
            seen.clear()
            ended.clear()

        for batch in batches:
            for t in batch.column(0).to_pylist():
                _tally(t, seen, ended)
                if len(seen) > 400_000:
                    yield from out()
        yield from out()

    counted = spread(records.select("text")).mapInArrow(run, "token string, n long, ends long")
    return counted.groupBy("token").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends")).join(tokens, "token", "left_semi")


def fit_endings(rows: list[tuple[str, int, float | None, int]], rounds: int = 30) -> tuple[float, dict[tuple[str, int], float]]:
    """(share of cut texts away from limits, {(ending, class): log likelihood
    ratio, cut against whole}) from (ending, class, posterior at the limit or
    None, records)."""
    clear = {True: 0.5, False: 5.0}  # pseudo-counts
    for ending, _, post, n in rows:
        if ending in SURE and post is None:
            clear[SURE[ending]] += n
    elsewhere = clear[True] / (clear[True] + clear[False])
    kinds = sorted({(e, c) for e, c, _, _ in rows if e not in SURE})
    ratio = {k: GUESSES[k[0]] + k[1] * STEP for k in kinds}
    guess = dict(ratio)
    for _ in range(rounds):
        cut, whole = dict.fromkeys(kinds, 0.0), dict.fromkeys(kinds, 0.0)
        all_cut = all_whole = 1.0
        for ending, c, post, n in rows:
            prior = elsewhere if post is None else post
            if ending in SURE:
                odds = math.inf if SURE[ending] else 0.0
            else:
                odds = prior / (1 - prior) * math.exp(ratio[(ending, c)])
            share = 1.0 if odds == math.inf else odds / (1 + odds)
            all_cut, all_whole = all_cut + n * share, all_whole + n * (1 - share)
            if ending not in SURE:
                cut[(ending, c)] += n * share
                whole[(ending, c)] += n * (1 - share)
        for k in kinds:
            # the guess takes part as GUESS records that are split as it says
            base = all_cut / all_whole
            odds = base * math.exp(guess[k])
            c, w = cut[k] + GUESS * odds / (1 + odds), whole[k] + GUESS / (1 + odds)
            ratio[k] = math.log(c / w) - math.log(base)
    return elsewhere, ratio


def judge(records: DataFrame) -> DataFrame:
    """record_kind, record_id, source, ending, posterior, score, truncated.

    ``records`` has record_kind, record_id, source, text (see :func:`latest`).
    A null source is a source of its own.  Blank texts are never cut.
    """
    spark = records.sparkSession
    records = written(records, "truncation-texts")
    feats = written(features(records), "truncation")
    limits = limits_by_source(feats)
    scored = feats
    for unit in UNITS:
        own = limits.where(F.col("unit") == unit).select(
            F.col("source").alias("_s"), F.col("value").alias(f"_{unit}"), F.col("posterior").alias(f"at_{unit}")
        )
        scored = scored.join(own, (F.coalesce("source", F.lit("")) == F.col("_s")) & (F.col(unit) == F.col(f"_{unit}")), "left").drop("_s", f"_{unit}")
    scored = scored.withColumn("posterior", F.greatest(*[f"at_{u}" for u in UNITS]))
    judged = feats.where("ending in ('item', 'bare', 'closed_number') and token <> ''")
    last = F.when(F.col("token").startswith("\x00"), F.col("token")).otherwise(F.element_at(F.split("token", " "), -1))
    tokens = judged.select(F.explode(F.array(F.col("token"), last)).alias("token")).distinct()
    stats = written(end_statistics(records, tokens), "truncation-ends")
    scored = scored.withColumn("last", last).join(stats, "token", "left")
    scored = scored.join(stats.select(F.col("token").alias("last"), F.col("n").alias("n1"), F.col("ends").alias("ends1")), "last", "left")

    def ratio(n: str, ends: str) -> Column:
        # the record's own end is one of those counted
        others, ended = F.greatest(F.coalesce(n, F.lit(1)) - 1, F.lit(0)), F.greatest(F.coalesce(ends, F.lit(1)) - 1, F.lit(0))
        return F.log((others + 1.0) / (ended + 0.3)) - TOKENS_PER_END

    few, unseen = F.coalesce("n", F.lit(0)) < 6, F.coalesce("n1", F.lit(0)) < 2
    fragment = unseen & F.col("token").isNotNull() & ~F.col("token").startswith("\x00") & F.col("small")
    stat = F.when(F.col("token") == "", 0.0).when(fragment, 5.0).when(few, ratio("n1", "ends1")).otherwise(ratio("n", "ends"))
    stat = F.when(F.col("ending").isin("item", "bare", "closed_number"), stat).otherwise(0.0)
    place = F.least(F.greatest(F.round(stat / STEP), F.lit(-float(MOST))), F.lit(float(MOST))).cast("int")
    scored = written(scored.withColumn("class", place), "truncation-scored")
    # at most endings x classes x 20 steps of the posterior
    kinds = scored.groupBy("ending", "class", F.round("posterior", 2).alias("post")).agg(F.count("*").alias("n"), F.avg("posterior").alias("p")).collect()
    elsewhere, fitted = fit_endings([(r["ending"], r["class"], r["p"], r["n"]) for r in kinds])
    table = [(e, c, float(x)) for (e, c), x in fitted.items()]
    fit = F.broadcast(spark.createDataFrame(table, "ending string, class int, ending_ratio double"))
    sure = F.when(F.col("ending").isin([k for k, cut in SURE.items() if cut]), 99.0).when(F.col("ending").isin([k for k, cut in SURE.items() if not cut]), -99.0)
    prior = F.coalesce("posterior", F.lit(elsewhere))
    score = F.log(prior / (1 - prior)) + F.coalesce(sure, F.col("ending_ratio"))
    return scored.join(fit, ["ending", "class"], "left").select(
        "record_kind", "record_id", "source", "ending", "token", "chars", "bytes", "words", F.coalesce("posterior", F.lit(0.0)).alias("posterior"), "n", "ends",
        score.alias("score"), (score > 0).alias("truncated"),
    )


def rates(judged: DataFrame) -> DataFrame:
    """source, records, truncated, rate of every source (null: no source named)."""
    return judged.groupBy("source").agg(
        F.count("*").alias("records"),
        F.sum(F.col("truncated").cast("long")).alias("truncated"),
        F.round(F.avg(F.col("truncated").cast("double")), 6).alias("rate"),
    )

"""Problem 9: reading level by harmonic propagation on the document-word graph.

Documents and words are the two sides of a graph.  Documents that people have
graded are clamped; difficulty (as a deviation from the language's mean) flows
to their words, from the words to all documents and back, until it changes no
more.  A word's score is the mean over its documents, an estimated one counting
``trust`` as much as a graded one, and tied to zero where few are known; a
document's score is the mean over its words.  The weight of an edge is fixed
before: it says how far the word stands out among the graded documents alone.  So
the result is the harmonic function of one weighted graph, whatever the number
of rounds, and each round comes closer to it by a constant factor.  The score is
cut into levels by thresholds fitted to the graded documents' scores without
their own grade's influence.

Words live in a fixed number of hash buckets, so that the word side is an array
of known size, whatever the corpus: it is summed up in the executors and the
shuffle, and only this array is broadcast.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.language import learn_languages
from docloom.runtime import spread, written

BUCKETS = 1 << 20  # broadcast: three float arrays of this length, 12 MB, and one of booleans
MIN_LENGTH = 300
LEVELS = (1, 2, 3)
BINS = 400  # score histogram for the thresholds: at most languages x BINS x levels rows
# a word with the vowel signs and marks of Devanagari and its relatives
_WORD = re.compile(r"(?:[^\W\d_]|[\u0900-\u0963\u0970-\u0dff])+")


def bucket_list(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Sorted distinct buckets of the words, each with its class of frequency in
    the document (once, twice, four times, ...).  Scripts without spaces give
    pairs of characters."""
    counts = Counter(_WORD.findall(text.lower()))
    runs = [w for w in counts if w[0] >= "\u2e80" or "\u0e00" <= w[0] <= "\u0eff"]
    for w in runs:
        n = counts.pop(w)
        for i in range(max(len(w) - 1, 1)):
            counts[w[i : i + 2]] += n
    crc, mask, out = zlib.crc32, buckets - 1, []
    for w, n in counts.items():
        h = crc(w.encode("utf-8", "surrogatepass"))
        out.append(h & mask)
        while n > 1:
            n >>= 1
            h = (h * 0x9E3779B1 + 0x7F4A7C15) & 0xFFFFFFFF
            out.append((h >> 7) & mask)
    return np.unique(np.array(out, np.int32))


def _lists(batch_column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(flat values, offsets) of a list column."""
    offsets = np.asarray(batch_column.offsets)
    return np.asarray(batch_column.values)[offsets[0] : offsets[-1]], offsets - offsets[0]


def graph(documents: DataFrame, labels: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """doc_id, lang, label (null if not graded), words (buckets): one row for
    each non-blank document of at least ``min_length`` code points."""
    grades = (
        labels.where(F.col("doc_id").isNotNull() & F.col("reading_level").isin(*LEVELS))
        .groupBy(F.col("doc_id"), "rater")
        .agg(F.max_by("reading_level", F.struct("rated_at", "reading_level")).alias("v"))
        .groupBy("doc_id")
        .agg(F.percentile("v", F.lit(0.5)).alias("label"))
    )
    shared = documents.sparkSession.sparkContext.broadcast(learn_languages(documents))
    kept = documents.where((F.length("text") >= min_length) & F.col("text").rlike(r"(?U)\S"))
    kept = spread(kept.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            lists = [bucket_list(t) for t in texts]
            langs = [shared.value.code(code, t) for code, t in zip(batch.column(1).to_pylist(), texts, strict=True)]
            offsets = np.zeros(len(lists) + 1, np.int32)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            flat = np.concatenate(lists) if lists else np.zeros(0, np.int32)
            words = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), words], names=["doc_id", "lang", "words"])

    return kept.mapInArrow(run, "doc_id long, lang string, words array<int>").join(grades, "doc_id", "left")


class _Shared:
    """Arrays for the tasks, compressed (most buckets are empty) and broadcast.

    ``close`` removes the copies of the executors once they are of no more use.
    """

    def __init__(self, spark, arrays: np.ndarray):
        self.shape, self.kind = arrays.shape, arrays.dtype
        self.held = spark.sparkContext.broadcast(pa.compress(arrays.tobytes(), codec="zstd", asbytes=True))
        self.close = self.held.destroy

    def __getstate__(self):
        return {"shape": self.shape, "kind": self.kind, "held": self.held}

    def read(self) -> np.ndarray:
        size = int(np.prod(self.shape)) * self.kind.itemsize
        return np.frombuffer(pa.decompress(self.held.value, size, codec="zstd"), self.kind).reshape(self.shape)


def _sum_by_bucket(table: DataFrame, prepare, size: int = BUCKETS) -> np.ndarray:
    """Sum (num, den) over all documents into an array [2, size].

    ``prepare()`` is called once in each task and gives the function of a batch
    and the sums.  Each task sums its documents into an array; what isn't zero is added up in
    the shuffle.  At most ``size`` rows reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, per_batch = np.zeros((2, size)), prepare()
        for batch in batches:
            per_batch(batch, total)
        at = np.nonzero(total[1])[0]
        for i in range(0, len(at), 50_000):
            part = at[i : i + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), pa.array(total[0][part]), pa.array(total[1][part])], names=["bucket", "num", "den"]
            )

    rows = table.mapInArrow(run, "bucket int, num double, den double").groupBy("bucket").agg(F.sum("num").alias("num"), F.sum("den").alias("den"))
    got = rows.toArrow()
    out = np.zeros((2, size))
    at = np.asarray(got["bucket"])
    out[0][at], out[1][at] = np.asarray(got["num"]), np.asarray(got["den"])
    return out


def _scores(flat: np.ndarray, offsets: np.ndarray, words: np.ndarray, shrink: float, own_num=None, own_den=None) -> np.ndarray:
    """Weighted mean over each document's words; ``words`` has the rows sum,
    count and weight.  Optionally without the document's own contribution."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    a, b, weight = (x[flat].astype(np.float64) for x in words)
    if own_num is not None:
        a, b = a - own_num[row], b - own_den[row]
    dev = np.where(b > 1e-9, a / (np.maximum(b, 0.0) + shrink), 0.0)
    top, low = np.bincount(row, weight * dev, n), np.bincount(row, weight, n)
    return np.divide(top, low, out=np.zeros(n), where=low > 1e-12)


def _best_cuts(hist: np.ndarray) -> tuple[float, float, int]:
    """Thresholds with the fewest errors on hist[level, bin]; (low, high, number)."""
    at = np.cumsum(hist, axis=1)
    below = np.concatenate([np.zeros((3, 1)), at], axis=1)
    total = below[:, -1]
    # right at cuts i <= j: level 1 below i, level 2 in between, level 3 from j on
    gain_low = below[0] - below[1]
    gain_high = below[1] + (total[2] - below[2])
    best_low = np.maximum.accumulate(gain_low)
    j = int(np.argmax(best_low + gain_high))
    ties_i = np.nonzero(gain_low[: j + 1] == best_low[j])[0]
    i = int(ties_i[len(ties_i) // 2])
    ties_j = np.nonzero((gain_high == gain_high[j]) & (np.arange(len(gain_high)) >= i))[0]
    j = int(ties_j[len(ties_j) // 2])
    return float(i), float(j), int(total.sum())


def reading_levels(
    documents: DataFrame,
    labels: DataFrame,
    min_length: int = MIN_LENGTH,
    tolerance: float = 0.01,
    shrink: float = 2.0,
    trust: float = 0.5,
    min_documents: int = 5,
    own_thresholds: int = 80,
) -> DataFrame:
    """``(doc_id, reading_level long, difficulty double)``, one row for each
    non-blank document of at least ``min_length`` code points.

    Grades that are null or outside 1..3 are ignored; of one rater's grades of
    a document the latest counts; of several raters the median.  Words of fewer
    than ``min_documents`` documents carry nothing.  ``trust`` is the weight
    of all estimated documents together beside all graded ones.  Rounds go on
    until the words' scores change by less than the part ``tolerance``.  A language with fewer than
    ``own_thresholds`` grades uses the common thresholds.  Without any grade
    every document gets the middle level.  Rows that repeat a doc_id give
    repeated rows; null texts and null keys give none; extra columns are ignored.
    """
    spark = documents.sparkSession
    table = written(graph(documents, labels, min_length).where("doc_id is not null"), "reading-graph")
    graded = table.where("label is not null")
    means = {r["lang"]: (r["s"], r["n"]) for r in graded.groupBy("lang").agg(F.sum("label").alias("s"), F.count("*").alias("n")).collect()}
    all_n = sum(n for _, n in means.values())
    common = sum(s for s, _ in means.values()) / all_n if all_n else 2.0
    mean_of = {k: (s + 10 * common) / (n + 10) for k, (s, n) in means.items()}

    def means_of(column) -> np.ndarray:
        return np.array([mean_of.get(x, common) for x in column.to_pylist()])

    def count(batch: pa.RecordBatch, total: np.ndarray) -> None:
        flat, _ = _lists(batch.column("words"))
        total[1] += np.bincount(flat, minlength=BUCKETS)

    used = _sum_by_bucket(table, lambda: count)[1] >= min_documents
    shared = _Shared(spark, used)

    def clamp():
        used = shared.read()

        def per_batch(batch: pa.RecordBatch, total: np.ndarray) -> None:
            flat, offsets = _lists(batch.column("words"))
            z = np.asarray(batch.column("label")) - means_of(batch.column("lang"))
            row = np.repeat(np.arange(len(z)), np.diff(offsets))
            keep = used[flat]
            total[0] += np.bincount(flat[keep], z[row[keep]], BUCKETS)
            total[1] += np.bincount(flat[keep], minlength=BUCKETS)

        return per_batch

    clamped = _sum_by_bucket(graded, clamp)
    apart = clamped[0] / (clamped[1] + shrink)
    weights = apart * apart
    words = np.stack([*clamped, weights]).astype(np.float32)
    shared.close()
    shared = _Shared(spark, used & (weights > 0))  # the others have no edges of any weight
    light = trust * all_n / max(table.count() - all_n, 1)

    def graded_scores(held: _Shared) -> DataFrame:
        """lang, level, grade as a deviation and score without it of the graded documents."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            used, words = shared.read(), held.read()
            for batch in batches:
                flat, offsets = _lists(batch.column("words"))
                label = np.asarray(batch.column("label"))
                z = label - means_of(batch.column("lang"))
                ok = used[flat]
                row = np.repeat(np.arange(len(z)), np.diff(offsets))[ok]
                cut = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(z)))])
                s = _scores(flat[ok], cut, words, shrink, z, np.ones(len(z)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("lang"), pa.array(np.clip(np.rint(label), 1, 3).astype(np.int32)), pa.array(z), pa.array(s)], names=["lang", "level", "z", "s"]
                )

        return graded.mapInArrow(run, "lang string, level int, z double, s double")

    def gain_of(scored: DataFrame) -> float:
        r = scored.agg(F.sum(F.col("z") * F.col("s")).alias("zs"), F.sum(F.col("s") * F.col("s")).alias("ss")).first()
        return r["zs"] / r["ss"] if r["ss"] else 1.0

    change = 1.0 if all_n else 0.0
    while change > tolerance:  # ends: each round shrinks the change by the share of the estimated documents and of the tie to zero
        held = _Shared(spark, words)

        def spread_on(held=held):
            used, words = shared.read(), held.read()

            def per_batch(batch: pa.RecordBatch, total: np.ndarray) -> None:
                flat, offsets = _lists(batch.column("words"))
                label = np.asarray(batch.column("label").fill_null(np.nan))
                n = len(label)
                ok = used[flat]
                row = np.repeat(np.arange(n), np.diff(offsets))[ok]
                flat = flat[ok]
                cut = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
                known = ~np.isnan(label)
                weight = np.where(known, 1.0, light)
                z = np.where(known, label - means_of(batch.column("lang")), _scores(flat, cut, words, shrink)) * weight
                total[0] += np.bincount(flat, z[row], BUCKETS)
                total[1] += np.bincount(flat, weight[row], BUCKETS)

            return per_batch

        before = words[0].astype(np.float64) / (words[1] + shrink)
        sums = _sum_by_bucket(table, spread_on)
        held.close()
        words = np.stack([*sums, weights]).astype(np.float32)
        after, scale = sums[0] / (sums[1] + shrink), (weights * before * before).sum()
        change = float(np.sqrt((weights * (after - before) ** 2).sum() / scale)) if scale > 0 else 0.0

    final = _Shared(spark, words)
    scored = written(graded_scores(final), "reading-graded")
    gain = gain_of(scored)

    def bin_of(score: np.ndarray) -> np.ndarray:
        return np.clip(np.floor((score + 4) * (BINS / 8)), 0, BINS - 1)

    cell = F.floor(F.least(F.greatest((F.col("s") * gain + 4) * (BINS / 8), F.lit(0)), F.lit(BINS - 1))).cast("int")
    hist: dict[str, np.ndarray] = {}
    for r in scored.groupBy("lang", "level", cell.alias("bin")).count().collect():
        for key in (r["lang"], None):
            hist.setdefault(key, np.zeros((3, BINS)))[r["level"] - 1, r["bin"]] += r["count"]
    cuts = {k: _best_cuts(h) for k, h in hist.items()}
    common_cut = cuts.get(None, (BINS / 8 * 3.5, BINS / 8 * 4.5, 0))
    cut_of = {k: v for k, v in cuts.items() if k is not None and v[2] >= own_thresholds}

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, words = shared.read(), final.read()
        for batch in batches:
            flat, offsets = _lists(batch.column("words"))
            n = len(offsets) - 1
            ok = used[flat]
            row = np.repeat(np.arange(n), np.diff(offsets))[ok]
            at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
            s = gain * _scores(flat[ok], at, words, shrink)
            langs = batch.column("lang").to_pylist()
            low = np.array([cut_of.get(x, common_cut)[0] for x in langs])
            high = np.array([cut_of.get(x, common_cut)[1] for x in langs])
            b = bin_of(s)
            level = 1 + (b >= low).astype(np.int64) + (b >= high)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(level), pa.array(np.clip(means_of(batch.column("lang")) + s, 1.0, 3.0))],
                names=["doc_id", "reading_level", "difficulty"],
            )

    return table.mapInArrow(grade, "doc_id long, reading_level long, difficulty double")

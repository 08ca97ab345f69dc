"""Problem 3: near-duplicate records, by combinations of prefix tokens.

A record is the set of its strings of eight code points (lower case, white
space collapsed).  Its *tokens* are drawn from this set alike for all records:
the hash space is cut into 64 bins and the smallest hash of each bin gives a
token, so that two records share a bin's token with a probability equal to their
likeness.  How many records have a token is counted over the whole collection.

Prefixes are taken along fixed orders of the bins and *extended* token by token
until the combination is expected in a few records only, by the frequency
classes of the record's own tokens: a rare token is indexed on its own, frequent
ones in combinations of two, three or four.  A combination of k tokens is shared
with probability likeness ** k, so each record takes as many orders as let a
pair at the threshold miss all of its keys with probability ``MISS``, supposing
that the tokens it shares are its most frequent ones (an edit leaves rare tokens
that nobody shares).  Two records that share a key agree on its length, and the
one that takes fewer orders is safe by itself, so the bound holds for every
pair, however frequent the tokens are.

Records that share a key are compared by four bits of each token at once; what
comes near the threshold is verified on the whole texts.  Keys of very many
records are found beforehand (by a bounded sample, for planning only) and their
groups cut into blocks, any two of which meet in some task.
Copies (equal after lower-casing and collapsing) are one class from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.runtime import spread, written

WIDTH = 8
BINS = 64
TOKENS = 1 << 16  # values of a token
MISS = 2e-3  # a pair exactly at the threshold shares no key with about this probability
EXPECTED = 128  # a combination is long enough when so few records are expected to share it
LONGEST = 4
HOT = 4096  # groups of one key above this are cut into blocks
BLOCK = 2048  # rows of such a block
SAMPLE = 1 << 18  # records (an eighth of all at most) that show which keys are hot
POSTINGS = 1_000_000  # keys a task sorts, about
FILTER_BITS = 1 << 25  # of the filter that keeps texts without a candidate out of the shuffle
_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_POSTING = np.dtype([("key", "<u8"), ("id", "<i8"), ("b0", "<u8"), ("b1", "<u8"), ("b2", "<u8"), ("b3", "<u8"), ("kind", "u1"), ("side", "u1")])
_PLANES = ("b0", "b1", "b2", "b3")


# ------------------------------------------------------------------- sketches


@lru_cache(1)
def _lower() -> np.ndarray:
    """Code point -> its small letter; a space for white space of any kind."""
    table = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x20000):
        small = chr(c).lower()
        if len(small) == 1:
            table[c] = 32 if small.isspace() else ord(small)
    return table


def normal_codes(column: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, lower-cased with white space collapsed, one
    after the other, and the length of each."""
    lengths = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    text = bytes(memoryview(column.buffers()[2])[offsets[0] : offsets[-1]]).decode("utf-8", "surrogatepass") if lengths.sum() else ""
    if "İ" in text or "Σ" in text:  # letters whose small form has another length or depends on the place
        texts = [t.lower() for t in column.to_pylist()]
        text, lengths = "".join(texts), np.array([len(t) for t in texts])
    codes = _lower()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    blank = codes == 32
    again = np.zeros(len(codes), bool)
    again[1:] = blank[1:] & blank[:-1]
    some = lengths > 0
    starts = (np.cumsum(lengths) - lengths)[some]
    again[starts] = False
    if again.any():
        lengths = lengths.copy()
        lengths[some] -= np.add.reduceat(again, starts)
        codes = codes[~again]
    return codes, lengths


def normal(text: str) -> str:
    return normal_codes(pa.array([text], pa.string()))[0].tobytes().decode("utf-32-le", "surrogatepass")


def _hashes(codes: np.ndarray) -> np.ndarray:
    """64-bit hashes of all strings of ``WIDTH`` code points, by doubling."""
    if len(codes) < WIDTH:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h, power, size = codes.astype(np.uint64) + np.uint64(11), _MULT, 1
        while size < WIDTH:
            g = h[:-size] * power
            g += h[size:]
            h, power, size = g, power * power, size * 2
        h ^= h >> np.uint64(31)
        h *= _MIX
        h ^= h >> np.uint64(29)
    return h


def _distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.append(True, h[1:] != h[:-1])] if len(h) else h


def shingle_hashes(text: str) -> np.ndarray:
    """Sorted distinct hashes of the strings of a text; none where it is shorter."""
    return _distinct(_hashes(normal_codes(pa.array([text], pa.string()))[0]))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    common = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - common
    return common / union if union else 0.0


def tokens_of(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Tokens [texts, BINS].  A bin without a hash takes over the token of the
    next one that has some, altered by the distance; a text without any string
    has zeros."""
    n, none = len(lengths), np.uint32(0xFFFFFFFF)
    least = np.full(n * BINS, none, np.uint32)
    h = _hashes(codes)
    at = np.repeat(np.arange(n, dtype=np.int64) * BINS, lengths)[: len(h)]
    at += (h >> np.uint64(58)).astype(np.int64)
    value = (h >> np.uint64(26)).astype(np.uint32)
    ends = np.cumsum(lengths)
    for back in range(1, WIDTH):  # strings over the border of two texts
        over = ends - back
        value[over[(over >= ends - lengths) & (over < len(value))]] = none
    np.minimum.at(least, at, value)
    least = least.reshape(n, BINS)
    tokens, empty = (least & np.uint32(TOKENS - 1)).astype(np.uint16), least == none
    tokens[empty] = 0
    todo = np.nonzero(empty.any(1) & ~empty.all(1))[0]
    if len(todo):
        place = np.arange(2 * BINS)
        held = np.where(np.tile(empty[todo], 2), 2 * BINS, place)
        after = np.minimum.accumulate(held[:, ::-1], axis=1)[:, ::-1][:, :BINS]
        distance = after - place[:BINS]
        tokens[todo] = (np.take_along_axis(tokens[todo], after % BINS, 1).astype(np.int64) + distance * 40503) % TOKENS
    return tokens


def sketches(records: DataFrame, min_length: int) -> DataFrame:
    """kind, id, exact (digest of the text as stored), c1, c2 (digest of the
    normalised text), tokens of the records of at least ``min_length``."""
    import xxhash

    kept = records.where((F.length("text") >= min_length) & F.col("id").isNotNull() & F.col("kind").isNotNull())
    kept = spread(kept.select("kind", F.col("id").cast("long").alias("id"), F.xxhash64("text").alias("exact"), "text"))
    names = ["kind", "id", "exact", "c1", "c2", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                codes, lengths = normal_codes(part.column(3).cast(pa.string()))
                ends = np.cumsum(lengths).tolist()
                digests = b"".join(xxhash.xxh3_128_digest(codes[b - n : b]) for b, n in zip(ends, lengths.tolist(), strict=True))
                cls = np.frombuffer(digests, np.int64).reshape(-1, 2)
                tokens = tokens_of(codes, lengths)
                some = pa.array(tokens.any(1))  # texts of nothing but white space have no strings in common
                rows = [*part.columns[:3], pa.array(cls[:, 0]), pa.array(cls[:, 1]), _packed(tokens)]
                yield pa.RecordBatch.from_arrays(rows, names=names).filter(some)

    return kept.mapInArrow(run, "kind string, id long, exact long, c1 long, c2 long, tokens binary")


def _packed(m: np.ndarray) -> pa.Array:
    width = m.shape[1] * m.itemsize
    offsets = pa.py_buffer((np.arange(len(m) + 1, dtype=np.int32) * width).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(m), [None, offsets, pa.py_buffer(np.ascontiguousarray(m).tobytes())])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BINS)


# ------------------------------------------------------------------ frequencies


def token_shares(reps: DataFrame, total: int) -> np.ndarray:
    """[BINS, TOKENS]: the share of the records that have a token.

    Counted over all records; a task sends its counts as BINS compressed
    vectors, so what reaches the driver has a fixed size (16 MB).
    """
    spark = reps.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BINS * TOKENS, np.int64)
        some = False
        for batch in batches:
            m = _matrix(batch.column(0)).astype(np.int64)
            some |= bool(len(m))
            counts += np.bincount((m + np.arange(BINS) * TOKENS).ravel(), minlength=len(counts))
        if some:
            yield send(counts.reshape(BINS, TOKENS), range(BINS))

    def send(rows: np.ndarray, bins) -> pa.RecordBatch:
        blobs = [pa.compress(r.tobytes(), codec="zstd", asbytes=True) for r in rows]
        return pa.RecordBatch.from_arrays([pa.array(list(bins), pa.int32()), pa.array(blobs, pa.binary())], names=["bin", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(pa.decompress(blob, TOKENS * 8, codec="zstd"), np.int64)
                sums[b] = sums[b] + part if b in sums else part
        if sums:
            yield send(np.array(list(sums.values())), sums)

    kind = "bin int, counts binary"
    tasks = min(spark.sparkContext.defaultParallelism, BINS)
    # fewer, longer tasks send fewer vectors
    counted = reps.select("tokens").coalesce(spark.sparkContext.defaultParallelism).mapInArrow(count, kind)
    rows = counted.repartitionById(tasks, F.col("bin") % tasks).mapInArrow(add, kind).toArrow()
    shares = np.zeros((BINS, TOKENS), np.float32)
    for b, blob in zip(rows["bin"].to_pylist(), rows["counts"].to_pylist(), strict=True):
        shares[b] = np.frombuffer(pa.decompress(blob, TOKENS * 8, codec="zstd"), np.int64) / max(total, 1)
    return shares


# ------------------------------------------------------------------------- keys


@lru_cache(8)
def orders_needed(threshold: float) -> tuple[int, ...]:
    """For keys of 1 .. LONGEST tokens the orders after which a pair at the
    threshold has shared none with probability MISS.  Of the BINS tokens a
    binomial number is equal, and a key's tokens are drawn without repetition."""
    equal = np.arange(BINS + 1)
    weight = np.array([comb(BINS, int(m)) * threshold**m * (1 - threshold) ** (BINS - m) for m in equal.tolist()])
    out, shared = [], np.ones(BINS + 1)
    for k in range(LONGEST):
        shared = shared * np.maximum(equal - k, 0) / (BINS - k)
        low, high = 1, 10_000
        while low < high:
            t = (low + high) // 2
            low, high = (low, t) if (weight * (1 - shared) ** t).sum() <= MISS else (t + 1, high)
        out.append(low)
    return tuple(out)


@lru_cache(8)
def orders_for(threshold: float) -> np.ndarray:
    """The fixed orders of bins [orders, LONGEST]: as many as a record whose
    tokens are all frequent needs.  First places run through all bins in turn."""
    rng = np.random.default_rng(20240229)
    rows: list[list[int]] = []
    n = orders_needed(threshold)[-1]
    while len(rows) < n:
        for first in rng.permutation(BINS).tolist():
            rest = [b for b in rng.permutation(BINS).tolist() if b != first]
            rows.append([first, *rest[: LONGEST - 1]])
    return np.array(rows[:n])


def keys_of(tokens: np.ndarray, shares: np.ndarray, total: int, threshold: float) -> np.ndarray:
    """Keys [records, orders]; 0 where the orders before suffice."""
    orders = orders_for(threshold)
    marked = tokens.astype(np.uint64) | (np.arange(BINS, dtype=np.uint64) << np.uint64(16))
    p = np.maximum(shares[np.arange(BINS), tokens], 1.0 / max(total, 1)).astype(np.float64)
    # orders of each record: keys of its most frequent tokens are this long on average
    bits = -np.log2(np.minimum(p, 0.999))
    most = np.sort(bits, axis=1)[:, : int(np.ceil(threshold * BINS))].mean(1)
    length = np.clip(np.log2(max(total / EXPECTED, 1)) / most + 0.5, 1, LONGEST)
    taken = np.ceil(np.exp(np.interp(length, np.arange(1, LONGEST + 1), np.log(orders_needed(threshold))))).astype(np.int64)
    taken = np.minimum(taken, len(orders))
    keys = np.zeros((len(tokens), len(orders)), np.uint64)
    by_taken = np.argsort(-taken, kind="stable")
    with np.errstate(over="ignore"):
        for t, order in enumerate(orders):
            need = by_taken[: np.count_nonzero(taken > t)]
            if not len(need):
                break
            h = np.full(len(need), np.uint64(t + 1) * _MULT, np.uint64)
            left = np.full(len(need), float(total))
            going = np.ones(len(need), bool)
            for b in order:
                step = (h ^ marked[need, b]) * _MIX
                step ^= step >> np.uint64(29)
                h = np.where(going, step * _MULT, h)
                left = np.where(going, left * p[need, b], left)
                going &= left > EXPECTED
                if not going.any():
                    break
            keys[need, t] = np.maximum(h ^ (h >> np.uint64(32)), np.uint64(1))
    return keys


def _least(threshold: float) -> int:
    """Tokens whose four bits agree that a pair at the threshold practically always has."""
    alike = threshold + (1 - threshold) / 16
    return int(np.floor(BINS * alike - 3.3 * np.sqrt(BINS * alike * (1 - alike))))


def _hot_keys(reps: DataFrame, total: int, keys) -> dict[int, int]:
    """Key -> blocks of the keys that more than about HOT records have.

    Only the plan depends on this (which groups are cut into blocks), no result.
    The sample is bounded, so at most its keys / 64 are hot.
    """
    rate = min(1 / 8, SAMPLE / max(total, 1))
    if total <= HOT:
        return {}
    least = max(HOT * rate, 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                k = keys(_matrix(batch.column(0).slice(i, 2000))).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(k[k != 0].view(np.int64))], names=["key"])

    some = reps.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(rate * (1 << 20))).select("tokens")
    rows = some.mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= least).toArrow()
    found = zip(np.asarray(rows["key"]).view(np.uint64).tolist(), rows["n"].to_pylist(), strict=True)
    return {k: int(np.ceil(n / rate / BLOCK)) for k, n in found}


def _candidates(reps: DataFrame, total: int, threshold: float) -> DataFrame:
    """kind, a, b (a < b): representatives that share a key and whose tokens
    agree in four bits often enough."""
    spark = reps.sparkSession
    kinds = sorted(r[0] for r in reps.select("kind").distinct().collect())  # names of tables
    if len(kinds) > 250:
        raise ValueError("more than 250 kinds of records")
    shared = spark.sparkContext.broadcast((token_shares(reps, total), kinds))  # 16 MB at any scale

    def keys(tokens: np.ndarray) -> np.ndarray:
        return keys_of(tokens, shared.value[0], total, threshold)

    hot = spark.sparkContext.broadcast(_hot_keys(reps, total, keys))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total * 40 // POSTINGS)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                held.append(postings(part))
                if sum(map(len, held)) > POSTINGS:
                    yield packed(np.concatenate(held))
                    held = []
        if held:
            yield packed(np.concatenate(held))

    def postings(part: pa.RecordBatch) -> np.ndarray:
        tokens = _matrix(part.column(2))
        k = keys(tokens)
        row, order = np.nonzero(k)
        out = np.zeros(len(row), _POSTING)
        kind = pc.index_in(part.column(0), pa.array(shared.value[1], pa.string())).to_numpy(zero_copy_only=False).astype(np.uint64)
        with np.errstate(over="ignore"):
            out["key"] = k[row, order] ^ (kind[row] * _MIX)
        out["kind"] = kind[row]
        out["id"] = np.asarray(part.column(1))[row]
        for bit, name in enumerate(_PLANES):
            out[name] = np.packbits(((tokens >> bit) & 1).astype(np.uint8), axis=1).view(np.uint64).ravel()[row]
        if hot.value:
            busy = np.isin(k[row, order], np.fromiter(hot.value, np.uint64, len(hot.value)))
            if busy.any():
                spots = np.nonzero(busy)[0]
                out = np.concatenate([out[~busy], *(blocks(out[s], hot.value[int(k[row[s], order[s]])]) for s in spots)])
        return out

    def blocks(one: np.ndarray, n: int) -> np.ndarray:
        """A posting of a hot key goes to every pair of blocks its own is part of."""
        with np.errstate(over="ignore"):
            own = int((one["id"].astype(np.uint64) * _MULT >> np.uint64(33)) % np.uint64(n))
            other = np.arange(n, dtype=np.uint64)
            out = np.repeat(one, n)
            low, high = np.minimum(other, own), np.maximum(other, own)
            out["key"] ^= (low * np.uint64(n) + high + np.uint64(1)) * _MULT
        out["side"] = np.where(other == own, 0, np.where(other > own, 1, 2))
        return out

    def packed(rows: np.ndarray) -> pa.RecordBatch:
        with np.errstate(over="ignore"):
            part = (((rows["key"] * _MULT) >> np.uint64(33)) % np.uint64(tasks)).astype(np.int32)
        at = np.argsort(part, kind="stable")
        part, rows = part[at], rows[at]
        first = np.nonzero(np.append(True, part[1:] != part[:-1]))[0]
        size = rows.itemsize
        offsets = np.append(first, len(rows)).astype(np.int32) * size
        blobs = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(rows.tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(part[first]), blobs], names=["part", "rows"])

    least = _least(threshold)

    def agree(planes: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for upto in (2, 4):  # two bits tell most pairs apart already
            differ = np.zeros(len(x), np.uint64)
            for name in _PLANES[:upto]:
                differ |= planes[name][x] ^ planes[name][y]
            ok = BINS - np.bitwise_count(differ) >= least
            x, y = x[ok], y[ok]
        return x, y

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [b for batch in batches for b in batch.column(1).to_pylist()]
        if not blobs:
            return
        rows = np.frombuffer(b"".join(blobs), _POSTING)
        del blobs
        rows = rows[np.argsort(rows["key"], kind="stable")]
        planes = {name: np.ascontiguousarray(rows[name]) for name in _PLANES}
        start = np.nonzero(np.append(True, rows["key"][1:] != rows["key"][:-1]))[0]
        length = np.diff(np.append(start, len(rows)))
        for n in np.unique(length[length > 1]).tolist():
            these = start[length == n]
            i, j = np.triu_indices(n, 1) if n <= 256 else (None, None)
            step = max(1, 2_000_000 // (n * n))
            for s in range(0, len(these), step):
                if i is not None:
                    at = these[s : s + step, None]
                    yield from give(rows, *agree(planes, (at + i).ravel(), (at + j).ravel()))
                    continue
                for r in range(0, n, 256):  # one group, a strip of its square at a time
                    x, y = np.meshgrid(np.arange(r, min(r + 256, n)), np.arange(r + 1, n), indexing="ij")
                    inside = y > x
                    yield from give(rows, *agree(planes, these[s] + x[inside], these[s] + y[inside]))

    def give(rows: np.ndarray, x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        side = rows["side"][x] + rows["side"][y]
        ok = (side == 0) | (side == 3)
        x, y = x[ok], y[ok]
        if not len(x):
            return
        a, b = rows["id"][x], rows["id"][y]
        ids = np.stack([np.minimum(a, b), np.maximum(a, b)], 1)
        kind = rows["kind"][x]
        for k in np.unique(kind).tolist():
            own = np.unique(ids[kind == k], axis=0)
            own = own[own[:, 0] < own[:, 1]]
            for s in range(0, len(own), 50_000):
                part = own[s : s + 50_000]
                name = pa.array([shared.value[1][k]] * len(part), pa.string())
                yield pa.RecordBatch.from_arrays([name, pa.array(part[:, 0].copy()), pa.array(part[:, 1].copy())], names=["kind", "a", "b"])

    posted = reps.select("kind", "id", "tokens").mapInArrow(post, "part int, rows binary")
    return posted.repartitionById(tasks, F.col("part")).mapInArrow(pairs, "kind string, a long, b long").distinct()


# ----------------------------------------------------------------- verification


def _wanted(records: DataFrame, nodes: DataFrame) -> DataFrame:
    """``records`` (kind, id, text) of ``nodes`` (kind, id), and by chance some others.

    A filter of fixed size (4 MB) keeps most other texts out of the shuffle; the
    join behind it is exact.
    """
    spot = F.pmod(F.xxhash64("kind", "id"), F.lit(FILTER_BITS))
    slices = nodes.select(spot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("slice")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits"))
    rows = slices.collect()  # at most FILTER_BITS / 32,768 rows of 4 KB
    width = 32768
    field = np.zeros((FILTER_BITS // width + 2, width // 8), np.uint8)
    for r in rows:
        field[r["slice"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    shared = records.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            bucket, bit = np.asarray(batch.column(3)), np.asarray(batch.column(4))
            held = (field[bucket, bit >> 3] >> (bit & 7).astype(np.uint8)) & 1
            yield batch.select(["kind", "id", "text"]).filter(pa.array(held.astype(bool)))

    marked = records.select("kind", "id", "text", F.bitmap_bucket_number(spot).alias("bucket"), F.bitmap_bit_position(spot).alias("bit"))
    return marked.mapInArrow(run, records.select("kind", "id", "text").schema)


def similar(records: DataFrame, threshold: float = 0.6, min_length: int = 300) -> tuple[DataFrame, DataFrame]:
    """``(members, links)``.

    ``members``: kind, id, rep, exact, several: the class of copies of every
    record of at least ``min_length`` code points, named by its smallest id;
    ``exact`` is a digest of the text as stored, ``several`` whether the class
    has more than one record.
    ``links``: kind, a, b, likeness: all pairs of representatives whose likeness
    is at least ``threshold`` (verified on the whole texts).

    ``records`` has kind, id, text; rows that repeat a key are one record (if
    their texts differ, each text is looked at).  Null kinds, ids and texts and
    short texts are left out; an empty table gives empty results.
    """
    if not 0.3 <= threshold <= 1:
        raise ValueError("the threshold must lie between 0.3 and 1")
    rows = written(sketches(records, min_length), "neardup-sketches")
    cls = ["kind", "c1", "c2"]
    best = F.min(F.struct("id", "tokens")).alias("r")
    reps = rows.groupBy(*cls).agg(best, (F.min("id") < F.max("id")).alias("several")).select(*cls, "r.id", "r.tokens", "several")
    reps = written(reps, "neardup-reps")
    stored = rows.groupBy(*cls, "id").agg(F.min("exact").alias("exact"))
    members = stored.join(reps.select(*cls, F.col("id").alias("rep"), "several"), cls).select("kind", "id", "rep", "exact", "several")
    total = reps.count()
    close = written(_candidates(reps, total, threshold), "neardup-close")
    long_ones = records.where((F.length("text") >= min_length) & F.col("id").isNotNull()).select("kind", F.col("id").cast("long").alias("id"), "text")
    nodes = close.select("kind", F.explode(F.array("a", "b")).alias("id"))
    texts = _wanted(long_ones, nodes).repartition("kind", "id").groupBy("kind", "id", F.xxhash64("text").alias("exact")).agg(F.first("text").alias("text"))
    both = (
        close.join(texts.select("kind", F.col("id").alias("a"), F.col("text").alias("ta")), ["kind", "a"])
        .join(texts.select("kind", F.col("id").alias("b"), F.col("text").alias("tb")), ["kind", "b"])
        .select("kind", "a", "b", "ta", "tb")
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for i, (x, y) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                if len(known) > 500:
                    known.clear()
                for t in (x, y):
                    if t not in known:
                        known[t] = shingle_hashes(t)
                scores[i] = likeness(known[x], known[y])
            keep = pa.array(np.nonzero(scores >= threshold - 1e-12)[0])
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(keep) for i in range(3)], pa.array(scores).take(keep)], names=["kind", "a", "b", "likeness"])

    found = both.mapInArrow(verify, "kind string, a long, b long, likeness double")
    links = written(found.groupBy("kind", "a", "b").agg(F.max("likeness").alias("likeness")), "neardup-links")
    return members, links


def all_pairs(members: DataFrame, links: DataFrame, expand: int = 100, full_links: bool = False) -> DataFrame:
    """kind, id_a, id_b (id_a < id_b) with the copies written out.

    Only of more than ``expand`` copies equal byte for byte the pairs among
    themselves aren't multiplied out: each is paired with the smallest id.  That
    one also stands for them in links to other texts, unless ``full_links``.
    Copies stored differently are written out in full.
    """
    same = ["kind", "rep", "exact"]
    copies = written(members.where("several").select(*same, "id"), "neardup-copies")
    size = copies.groupBy(*same).agg(F.count("*").alias("n"), F.min("id").alias("head"))
    copies = copies.join(size, same)
    shown = copies if full_links else copies.where((F.col("n") <= expand) | (F.col("id") == F.col("head")))

    def spelt(pairs: DataFrame, end: str) -> DataFrame:
        own = shown.select("kind", F.col("rep").alias(end), F.col("id").alias("_own"))
        return pairs.join(own, ["kind", end], "left").withColumn(end, F.coalesce("_own", end)).drop("_own")

    across = spelt(spelt(links.select("kind", "a", "b"), "a"), "b").select("kind", F.col("a").alias("x"), F.col("b").alias("y"))
    ids = copies.select(*same, "id")
    # differently stored copies: by pairs of forms, so that equal ones never meet
    forms = size.select(*same).join(size.select("kind", "rep", F.col("exact").alias("other")), ["kind", "rep"]).where("exact < other")
    varied = forms.join(ids.withColumnRenamed("id", "x"), same).join(ids.withColumnRenamed("exact", "other").withColumnRenamed("id", "y"), ["kind", "rep", "other"])
    many = copies.where((F.col("n") > 1) & (F.col("n") <= expand)).select(*same, "id")
    inside = many.withColumnRenamed("id", "x").join(many.withColumnRenamed("id", "y"), same).where("x < y").select("kind", "x", "y")
    star = copies.where((F.col("n") > expand) & (F.col("id") != F.col("head"))).select("kind", F.col("head").alias("x"), F.col("id").alias("y"))
    out = across.unionByName(inside).unionByName(varied.select("kind", "x", "y")).unionByName(star)
    out = out.select(F.col("kind").alias("record_kind"), F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    return out.where("id_a < id_b").distinct()


def classes(members: DataFrame, links: DataFrame) -> DataFrame:
    """record_kind, record_id, class_id (smallest id among its copies), copies,
    links (other texts that are alike beyond the threshold)."""
    ends = links.select("kind", F.explode(F.array("a", "b")).alias("rep"))
    linked = ends.groupBy("kind", "rep").agg(F.count("*").alias("links"))
    size = members.groupBy("kind", "rep").agg(F.count("*").alias("copies"))
    out = members.join(size, ["kind", "rep"]).join(linked, ["kind", "rep"], "left").fillna(0, ["links"])
    return out.select(F.col("kind").alias("record_kind"), F.col("id").alias("record_id"), F.col("rep").alias("class_id"), "copies", "links")

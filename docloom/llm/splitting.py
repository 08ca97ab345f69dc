"""Problem 4: cut oversized texts into pieces at natural boundaries.

A text is parsed into a tree: sections nested by the depth of their headings,
blocks between blank lines, list items nested by their indentation, lines,
sentences, clauses, words.  Packing works bottom-up on it: whole neighbouring
subtrees of one parent are merged while they fit, and only a subtree that is
itself too large is opened.  What comes out of an opened one stays by itself, so
no piece holds the end of one section and the start of another unless it holds
both whole.  A run without white space or punctuation that exceeds the limit has
no natural boundary and is cut hard.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEVELS = ("section", "block", "item", "line", "sentence", "clause", "word", "hard")
NESTED = (0, 2)  # levels whose nodes hold nodes of the same level
DEEPEST = 60  # further levels of indentation are read as lines of their item


@lru_cache(1)
def _patterns():
    import regex

    return {
        "heading": regex.compile(r"^(?:(#{1,6})[^\S\n]|[^\S\n]*\S[^\n]{0,79}\n(={3,}|-{3,})[^\S\n]*$)", regex.M),
        # a short line alone between blank lines that doesn't end like a sentence
        "title": regex.compile(r"(?:\A|\n[^\S\n]*\n)(?=[^\S\n]*\w[^\n]{1,78}(?<![.!?…。！？।:;,，、])[^\S\n]*\n[^\S\n]*\n\s*\S)"),
        "item": regex.compile(r"^([^\S\n]*)(?:[-*•–—◦▪]|\(?\w{1,3}[.)])[^\S\n]+(?=\S)", regex.M),
        "ends": {
            "block": regex.compile(r"\n\s*\n\s*"),
            "line": regex.compile(r"\n\s*"),
            "sentence": regex.compile(r"(?:[.!?…।]+[\p{Pe}\p{Pf}\"']*\s+|[。！？]+[\p{Pe}\p{Pf}\"']*\s*)"),
            "clause": regex.compile(r"[,;:，；：、–—]\s*"),
            "word": regex.compile(r"\s|\p{P}"),
        },
    }


class Tree:
    """The structure of a text; nodes are spans, their children found on demand."""

    def __init__(self, text: str):
        p = _patterns()
        self.text = text
        depths = {m.end(): 7 for m in p["title"].finditer(text)}
        for m in p["heading"].finditer(text):
            depths[m.start()] = len(m[1]) if m[1] else 1 if m[2][0] == "=" else 2
        items = {m.start(): len(m[1].expandtabs()) for m in p["item"].finditer(text)}
        # (places, depth at each) of the two kinds of nested nodes
        self.nested = {0: self._sorted({k: v for k, v in depths.items() if k not in items}), 2: self._sorted(items)}

    @staticmethod
    def _sorted(marks: dict[int, int]) -> tuple[list[int], list[int]]:
        places = sorted(marks)
        return places, [marks[i] for i in places]

    def children(self, start: int, end: int, level: int) -> list[tuple[int, int]]:
        """The node itself if it has none at this level."""
        if level in NESTED:
            places, depths = self.nested[level]
            i, j = bisect_right(places, start), bisect_left(places, end)
            top = min(depths[i:j], default=0)
            cuts = [places[k] for k in range(i, j) if depths[k] == top]
        else:
            cuts = [m.end() for m in _patterns()["ends"][LEVELS[level]].finditer(self.text, start, end) if start < m.end() < end]
        return list(zip([start, *cuts], [*cuts, end], strict=True))

    def pack(self, start: int, end: int, room: int, limit: int, level: int = 0, depth: int = 0) -> list[tuple[int, int, int]]:
        """(start, end, level of the cut at the end) of consecutive cores: at most
        ``room`` long, a single run without a boundary up to ``limit``."""
        if end - start <= room:
            return [(start, end, level)]
        if level == len(LEVELS) - 1:
            if end - start <= limit:
                return [(start, end, level - 1)]
            return [(at, min(at + room, end), level if at + room < end else level - 1) for at in range(start, end, room)]
        parts = self.children(start, end, level)
        if len(parts) == 1:
            return self.pack(start, end, room, limit, level + 1)
        below = level if level in NESTED and depth < DEEPEST else level + 1
        packed: list[tuple[int, int, int]] = []
        whole = False  # may the last piece take up another sibling?
        for a, b in parts:
            if b - a > room:
                opened = self.pack(a, b, room, limit, below, depth + 1 if below == level else 0)
                packed += [*opened[:-1], (opened[-1][0], b, level)]
                whole = False
            elif whole and b - packed[-1][0] <= room:
                packed[-1] = (packed[-1][0], b, level)
            else:
                packed.append((a, b, level))
                whole = True
        return packed


def pieces_of(text: str | None, limit: int = 2000, overlap: int = 150) -> list[tuple[int, int, int, str]]:
    """(start, core_start, end, kind of the cut at the end); ``end`` for the last.

    ``text[start:core_start]`` repeats the end of the piece before (at most
    ``overlap``, shorter where a word would be cut or the piece is full).
    """
    if not text:
        return []
    if len(text) <= limit:
        return [(0, 0, len(text), "end")]
    out: list[tuple[int, int, int, str]] = []
    word = _patterns()["ends"]["word"]
    for a, b, level in Tree(text).pack(0, len(text), limit - overlap, limit):
        start = a
        if out:
            low = max(a - min(overlap, limit - (b - a)), out[-1][0])
            start = next((m.end() for m in word.finditer(text, max(low - 1, 0), a) if low <= m.end() < a), low)
        out.append((start, a, b, LEVELS[level]))
    out[-1] = (*out[-1][:3], "end")
    return out


PIECES = T.ArrayType(
    T.StructType(
        [
            T.StructField("piece_no", T.IntegerType()),
            T.StructField("span_start", T.IntegerType()),
            T.StructField("core_start", T.IntegerType()),
            T.StructField("span_end", T.IntegerType()),
            T.StructField("cut_kind", T.StringType()),
            T.StructField("text", T.StringType()),
        ]
    )
)


def split_oversized(df: DataFrame, key: str, text: str = "text", limit: int = 2000, overlap: int = 150, with_text: bool = True) -> DataFrame:
    """``(record_id, pieces)`` of the records longer than ``limit`` code points.

    Pieces are at most ``limit`` long, consecutive, together they cover the
    text, and each starts with the last ``overlap`` code points or fewer of the
    one before.  Null, empty and short texts give no row; a key that is stored
    several times is one record (the first text of that key in order), rows
    with a null key are dropped; other columns are ignored.  The length filter
    runs on the JVM before any row goes to Python; only long rows are shuffled.
    """
    if overlap * 2 > limit:
        raise ValueError("overlap must be at most half the limit")
    long_ones = (
        df.select(F.col(key).cast("long").alias("record_id"), F.col(text).alias("text"))
        .where(F.length("text") > limit)
        .where("record_id is not null")
        .groupBy("record_id")
        .agg(F.min("text").alias("text"))
    )
    kind = pa.list_(
        pa.struct(
            [
                ("piece_no", pa.int32()),
                ("span_start", pa.int32()),
                ("core_start", pa.int32()),
                ("span_end", pa.int32()),
                ("cut_kind", pa.string()),
                ("text", pa.string()),
            ]
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [
                    [
                        {"piece_no": i, "span_start": s, "core_start": c, "span_end": e, "cut_kind": k, "text": t[s:e] if with_text else None}
                        for i, (s, c, e, k) in enumerate(pieces_of(t, limit, overlap))
                    ]
                    for t in part.column(1).to_pylist()
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, kind)], names=["record_id", "pieces"])

    schema = T.StructType([T.StructField("record_id", T.LongType()), T.StructField("pieces", PIECES)])
    return long_ones.mapInArrow(run, schema)


def found(split: DataFrame, record_kind: str) -> DataFrame:
    """p4_found of one kind: ``hard_cut`` is 1 where a piece ends in a hard cut."""
    hard = F.exists("pieces", lambda p: p["cut_kind"] == "hard").cast("long")
    return split.select(F.lit(record_kind).alias("record_kind"), "record_id", hard.alias("hard_cut"))

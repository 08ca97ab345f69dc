"""The language of texts that are stored without one, learned from the others.

All texts with a language are counted: each language is described by how often
its pairs of neighbouring characters (in small letters, hashed into a fixed
number of cells) occur.  A text without a language gets the one under which its
own pairs, all of them, are likeliest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.runtime import spread

CELLS = 1 << 14  # of a language; there are at most 676 codes of two letters, so 44 MB at any scale


def code_of(lang: str | None) -> str:
    """Two letters, '' if unknown: `vi-VI` and `VI` are `vi`, `und` is unknown."""
    code = (lang or "").strip().lower().replace("_", "-").split("-")[0]
    return code if len(code) == 2 and code.isalpha() and code.isascii() else ""


def cells_of(text: str) -> np.ndarray:
    """The cell of every pair of neighbouring characters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = codes[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(50)).astype(np.int64)


@dataclass(frozen=True)
class LanguageModel:
    """``codes`` and, for each, the log probabilities of the cells."""

    codes: tuple[str, ...] = ()
    logs: np.ndarray | None = None

    def guess(self, text: str | None) -> str:
        """'' for a text without a pair of characters or if nothing was learned."""
        if not self.codes or not text or len(text) < 2:
            return ""
        return self.codes[int(np.argmax(self.logs @ np.bincount(cells_of(text), minlength=CELLS)))]

    def code(self, lang: str | None, text: str | None) -> str:
        return code_of(lang) or self.guess(text)


def learn_languages(docs: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """The model of all documents with a language; empty if none is missing one,
    if none has one, or for an empty table."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null")
    named = F.coalesce(F.lower(F.trim("lang")).rlike(r"\A[a-z]{2}(?:[-_].*)?\z"), F.lit(False))
    if rows.where(~named).isEmpty():
        return LanguageModel()

    def send(code: str, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([code]), pa.array([pa.compress(counts.tobytes(), codec="zstd", asbytes=True)], pa.binary())], names=["code", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part, texts = batch.slice(i, 500), {}
                for t, code in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    texts.setdefault(code_of(code), []).append(t)
                for code, ts in texts.items():
                    if code:
                        n = np.bincount(cells_of("\n".join(ts)), minlength=CELLS)
                        total[code] = total[code] + n if code in total else n
        for code, n in total.items():
            yield send(code, n)

    def read(blob: bytes) -> np.ndarray:
        return np.frombuffer(pa.decompress(blob, CELLS * 8, codec="zstd"), np.int64)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for code, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[code] = total[code] + read(blob) if code in total else read(blob)
        for code, n in total.items():
            yield send(code, n)

    kind = "code string, counts binary"
    got = spread(rows.where(named)).mapInArrow(count, kind).repartition("code").mapInArrow(add, kind).orderBy("code").toArrow()
    if not got.num_rows:
        return LanguageModel()
    n = np.array([read(b) for b in got["counts"].to_pylist()], float)
    logs = np.log((n + 0.05) / (n.sum(1, keepdims=True) + 0.05 * CELLS))
    return LanguageModel(tuple(got["code"].to_pylist()), logs.astype(np.float32))

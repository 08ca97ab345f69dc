"""Problem 7: byte-level BPE encoding by prefix dynamic programming.

For a pre-token every byte prefix has exactly one *valid last token*: the token
its encoding ends with.  A token ``t`` that is a suffix of the prefix is that
last token if and only if the encoding of the prefix before it ends with a
token ``p`` such that the pair ``(p, t)`` stays as it is when it is encoded on
its own.  So the table of last tokens grows byte by byte, appending text never
changes earlier entries, and the ids are read off backwards.

The table only looks back as far as some vocabulary token may still be open.
That window together with its last tokens is a *state*; states are interned and
their transitions by one character remembered, so that running text becomes a
walk through a small automaton.  Memories are bounded and may be dropped at any
time without changing a result.
"""

from __future__ import annotations

import base64
import gc
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.runtime import spread

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the pre-token pattern that belongs to the vocabulary
PRETOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# entries of each memory in a worker: together some 150 MB at most
MAX_STATES = 150_000
MAX_WORDS = 300_000
MAX_PAIRS = 300_000
NEVER = 1 << 62


_NONE: dict = {}
_BYTES = [bytes((b,)) for b in range(256)]


def _read(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


class _State:
    __slots__ = ("base", "lasts", "live", "next")

    def __init__(self, live: bytes, base: int, lasts: tuple[int, ...]):
        self.live = live  # longest suffix that some token may still continue
        self.base = base  # last token before the window, -1 at the start of the pre-token
        self.lasts = lasts  # last token at each byte of the window
        self.next: dict[str, tuple[_State, tuple[int, ...]]] = _NONE  # its own once it has a successor


class _Words(dict):
    """Pre-token -> ids; computes what is missing."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, word: str) -> tuple[int, ...]:
        return self.compute(word)


class PrefixEncoder:
    """Encoder of single texts; ``encode(None)`` and ``encode("")`` are ``[]``."""

    def __init__(self, vocabulary: str | bytes = DEFAULT_VOCABULARY):
        """``vocabulary``: the path of the file or what it holds."""
        import regex

        self.ranks: dict[bytes, int] = {}
        for line in (vocabulary if isinstance(vocabulary, bytes) else _read(vocabulary)).splitlines():
            if line.strip():
                piece, rank = line.split()
                self.ranks[base64.b64decode(piece)] = int(rank)
        self.pieces = {rank: piece for piece, rank in self.ranks.items()}
        self.sizes = {rank: len(piece) for rank, piece in self.pieces.items()}
        self.opens = {piece[:n] for piece in self.ranks for n in range(1, len(piece))}
        pattern = regex.compile(PRETOKEN)
        self.split, self.splits = pattern.findall, pattern.finditer
        self._kept: dict[tuple[int, int], bool] = {}
        self._halves: dict[int, tuple[bytes, bytes] | None] = {}
        self._edges: tuple[dict, dict] = ({}, {})
        self.words = _Words(self.word)
        self._reset()

    def _reset(self) -> None:
        self._states: dict[tuple, _State] = {}
        self._windows: dict[bytes, tuple] = {}
        self.root = self._state(b"", -1, ())

    def _state(self, live: bytes, base: int, lasts: tuple[int, ...]) -> _State:
        key = (live, base, lasts)
        found = self._states.get(key)
        if found is None:
            found = self._states[key] = _State(live, base, lasts)
        return found

    def halves(self, token: int) -> tuple[bytes, bytes] | None:
        """The two parts whose merge makes the token; None for a single byte."""
        if token not in self._halves:
            data = self.pieces[token]
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 2:
                ranked = [(self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1)]
                rank, at = min(ranked)
                if rank == NEVER:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self._halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self._halves[token]

    def edge(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """The pieces that touch the token's right (1) or left (0) end while it
        is merged, each with the rank of the merge that absorbs it."""
        known = self._edges[side].get(token)
        if known is None:
            known, at, absorbed = [], token, NEVER
            while True:
                known.append((self.pieces[at], absorbed))
                parts = self.halves(at)
                if parts is None:
                    break
                at, absorbed = self.ranks[parts[side]], at
            self._edges[side][token] = known
        return known

    def keeps(self, first: int, second: int) -> bool:
        """Does this pair of neighbours survive when encoded together?

        It doesn't if a merge over the border comes before one of the two
        pieces at the border is absorbed; of equal merges the left one is first.
        """
        kept = self._kept.get((first, second))
        if kept is None:
            ranks, kept = self.ranks, True
            for left, until_left in self.edge(first, 1):
                for right, until_right in self.edge(second, 0):
                    rank = ranks.get(left + right)
                    if rank is not None and rank < until_left and rank <= until_right:
                        kept = False
                        break
                if not kept:
                    break
            self._kept[(first, second)] = kept
        return kept

    def _ends(self, live: bytes) -> tuple[tuple[tuple[int, int], ...], int]:
        """Of a window: the tokens that end it, as (start, token) from the longest
        on, and how much of it no token can continue any more."""
        known = self._windows.get(live)
        if known is None:
            ranks, opens, size = self.ranks, self.opens, len(live)
            ends = tuple((i, ranks[live[i:]]) for i in range(size) if live[i:] in ranks)
            cut = 0
            while cut < size and live[cut:] not in opens:
                cut += 1
            known = self._windows[live] = (ends, cut)
        return known

    def _step(self, state: _State, char: str) -> tuple[_State, tuple[int, ...]]:
        live, base, lasts = state.live, state.base, state.lasts
        fresh: tuple[int, ...] = ()
        for byte in char.encode("utf-8", "surrogatepass"):
            live += _BYTES[byte]
            ends, cut = self._ends(live)
            for start, token in ends:
                before = lasts[start - 1] if start else base
                if before < 0 or self.keeps(before, token):
                    break
            lasts = (*lasts, token)
            fresh = (*fresh, token)
            if cut:
                base = lasts[cut - 1]
                live, lasts = live[cut:], lasts[cut:]
        entry = (self._state(live, base, lasts), fresh)
        if state.next is _NONE:
            state.next = {}
        state.next[char] = entry
        return entry

    def last_tokens(self, word: str) -> list[int]:
        """The table of the pre-token: the last token of every byte prefix."""
        state, table = self.root, []
        for char in word:
            known = state.next
            state, fresh = known[char] if char in known else self._step(state, char)
            table += fresh
        return table

    def read_off(self, table: list[int]) -> tuple[int, ...]:
        out, at, sizes = [], len(table) - 1, self.sizes
        add = out.append
        while at >= 0:
            token = table[at]
            add(token)
            at -= sizes[token]
        out.reverse()
        return tuple(out)

    def word(self, word: str) -> tuple[int, ...]:
        whole = self.ranks.get(word.encode("utf-8", "surrogatepass"))
        ids = (whole,) if whole is not None else self.read_off(self.last_tokens(word))
        self.words[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if len(self._states) > MAX_STATES:
            self._reset()
            gc.collect()  # states point at each other
        if len(self.words) > MAX_WORDS:
            self.words.clear()
        if len(self._kept) > MAX_PAIRS:
            self._kept.clear()
        return list(chain.from_iterable(map(self.words.__getitem__, self.split(text))))


class GrowingText:
    """A text whose encoding follows appends and edits exactly.

    Pre-tokens can only change near an edit: a match depends on nothing before it
    and on one character behind it, so splitting starts two pre-tokens before the
    edit and stops as soon as a split behind it falls together with an old one.
    """

    def __init__(self, encoder: PrefixEncoder, text: str = ""):
        self.encoder, self.text = encoder, text
        self.parts = encoder.split(text)

    def append(self, more: str) -> None:
        keep = self.parts[:-2]
        tail = "".join(self.parts[-2:]) + more
        self.text += more
        self.parts = keep + self.encoder.split(tail)

    def replace(self, start: int, end: int, new: str) -> int:
        """Puts ``new`` in the place of ``text[start:end]``; the number of
        pre-tokens that were split again."""
        at, first = 0, 0
        while first < len(self.parts) and at + len(self.parts[first]) <= start:
            at += len(self.parts[first])
            first += 1
        for _ in range(2):
            if first:
                first -= 1
                at -= len(self.parts[first])
        self.text = self.text[:start] + new + self.text[end:]
        # old splits behind the edit: where they are now, and which part starts there
        old, place = first, at
        while old < len(self.parts) and place < end:
            place += len(self.parts[old])
            old += 1
        place += len(new) - (end - start)
        fresh: list[str] = []
        for match in self.encoder.splits(self.text, at):
            while old < len(self.parts) and place < match.start():
                place += len(self.parts[old])
                old += 1
            if old < len(self.parts) and place == match.start():
                break
            fresh.append(match[0])
        else:
            old = len(self.parts)
        self.parts[first:old] = fresh
        return len(fresh)

    def ids(self) -> list[int]:
        return list(chain.from_iterable(map(self.encoder.words.__getitem__, self.parts)))


_ENCODERS: dict[int, PrefixEncoder] = {}


def encoder(vocabulary: bytes) -> PrefixEncoder:
    """One encoder for each worker process and vocabulary."""
    key = hash(vocabulary)
    if key not in _ENCODERS:
        _ENCODERS[key] = PrefixEncoder(vocabulary)
    return _ENCODERS[key]


@contextmanager
def _no_collector():
    """The encoder's memories are large, long-lived and bounded; walking through
    them again and again would cost the collector a fifth of the time."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def _slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``(key, ids array<int>)``, one row for each row of ``docs``.

    Null and empty text give an empty list, blank text is encoded as it
    stands, strings that look like special tokens are ordinary text.  Repeated
    rows stay repeated, other columns (whatever their names) are ignored, an
    empty table gives an empty table.  No shuffle: one pass over two columns.
    """
    kept = spread(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")))
    kind = kept.schema["_key"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(_read(vocabulary))  # the driver reads the file (1 MB), the workers needn't have it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value).encode
        for batch in batches:
            for part in _slices(batch):
                with _no_collector():
                    lists = [encode(t) for t in part.column(1).to_pylist()]
                sizes = np.fromiter(map(len, lists), np.int64, len(lists))
                offsets = np.zeros(len(lists) + 1, np.int32)
                np.cumsum(sizes, out=offsets[1:])
                flat = np.fromiter(chain.from_iterable(lists), np.int32, int(offsets[-1]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[key, "ids"]
                )

    return kept.mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(docs: DataFrame, keep: list[str], text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``tokens`` (int): the length of the encoding."""
    kept = spread(docs.select(*keep, F.col(text).alias("_text")))
    shared = docs.sparkSession.sparkContext.broadcast(_read(vocabulary))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value).encode
        for batch in batches:
            with _no_collector():
                sizes = [len(encode(t)) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(sizes, pa.int32())], names=[*keep, "tokens"])

    return kept.mapInArrow(run, f"{fields}, tokens int")

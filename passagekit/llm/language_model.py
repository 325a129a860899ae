"""Interpolated modified Kneser-Ney n-gram model, counted in Spark and scored from memory-mapped sorted arrays.

Counting: words get dense numbers by the order of their hashes; n-grams are counted per task, then per shard.  A trigram
lies in the shard of its middle word, so that one shard knows all that its trigrams say of their contexts and of the
bigrams behind them; the trigrams of very frequent middle words are spread by their last word, and the statistics of
their contexts are added up in shards of their own.  Each shard becomes files of sorted keys and counts in the shared
folder; what is known of single words becomes dense arrays.  Scoring: workers map the files and look up TEXTS bytes of
documents at a time by binary search, in the order of the shards, so a worker holds in memory only these and visits a
shard once for all of them; the model's pages are the operating system's.

A word is a run of non-space bytes in lower case; every text ends in one end token, which counts as a token, and begins
with start symbols, which do not.
"""

from __future__ import annotations

import io
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, clean, documents, partitions, slices
from .language import held_out
from .textkit import mix, words

FOLDS = 10
END = np.int64(0x45)  # stands for the hash of the end token
ORDER = 3
HOLD = 3_000_000  # distinct n-grams that a counting task holds before it gives them out
SHARD = 4_000_000  # tokens of a shard, about; words of a vocabulary range, at most about half as many
TEXTS = 16 << 20  # bytes of the texts that are scored together, about; one longer text is scored by itself
LOOKUP = 400_000  # tokens that are looked up at a time
WIDTH = np.int64(0xFFFFFFFF)  # a word's number, and the start symbol's, in a packed key
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


# --- files of arrays ---------------------------------------------------------------------------------------------


def put(folder: str, name: str, array: np.ndarray) -> None:
    """Write an array under a name; a repeated task writes the same again, and a half-written file has another name."""
    store, path = pafs.FileSystem.from_uri(folder)
    body = io.BytesIO()
    np.save(body, array)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(body.getbuffer())
    store.move(part, f"{path}/{name}.npy")


@lru_cache(maxsize=1 << 15)
def mapped(folder: str, name: str) -> np.ndarray:
    """A memory-mapped array.  From a folder that cannot be mapped it is copied once an executor, to Spark's own folder for
    files, which goes with the executor."""
    store, path = pafs.FileSystem.from_uri(folder)
    if isinstance(store, pafs.LocalFileSystem):
        return np.load(f"{path}/{name}.npy", mmap_mode="r")
    copy = f"{SparkFiles.getRootDirectory()}/{path.rsplit('/', 1)[-1]}-{name}.npy"
    if not os.path.exists(copy):
        part = f"{copy}.{uuid.uuid4().hex}"
        with store.open_input_stream(f"{path}/{name}.npy") as source, open(part, "wb") as out:
            while block := source.read(1 << 24):
                out.write(block)
        os.replace(part, copy)
    return np.load(copy, mmap_mode="r")


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _unpack(raw: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype)


def _deltas(sorted_keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences, their bytes in eight planes, which compress well."""
    return _pack(np.diff(sorted_keys, prepend=np.int64(0)).view(np.uint8).reshape(-1, 8).T)


def _undelta(raw: bytes) -> np.ndarray:
    planes = _unpack(raw, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.int64).ravel())


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(counts[order], at) if len(at) else counts[:0]


class Tally:
    """Counts of 64-bit keys, gathered over a task."""

    def __init__(self) -> None:
        self.keys, self.counts, self.size = [], [], 0

    def add(self, keys: np.ndarray) -> bool:
        k, c = np.unique(keys, return_counts=True)
        self.keys.append(k)
        self.counts.append(c)
        self.size += len(k)
        return self.size > HOLD

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = _summed(np.concatenate(self.keys), np.concatenate(self.counts)) if self.keys else (np.zeros(0, np.int64),) * 2
        self.__init__()
        return out


def _grouped(context: np.ndarray, word: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in the order of (context, word), equal ones added up."""
    order = np.lexsort((word, context))
    context, word = context[order], word[order]
    at = np.flatnonzero(np.append(True, (context[1:] != context[:-1]) | (word[1:] != word[:-1])))[: len(word)]
    return context[at], word[at], np.add.reduceat(counts[order], at) if len(at) else counts[:0]


class PairTally:
    """Counts of (context, word), gathered over a task."""

    def __init__(self) -> None:
        self.rows, self.size = [], 0

    def add(self, context: np.ndarray, word: np.ndarray) -> bool:
        self.rows.append(_grouped(context, word, np.ones(len(word), np.int64)))
        self.size += len(self.rows[-1][1])
        return self.size > HOLD

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = _grouped(*(np.concatenate([r[i] for r in self.rows]) for i in range(3))) if self.rows else (np.zeros(0, np.int64),) * 3
        self.__init__()
        return out


def _starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1]))[: len(x)]


def _planes(x: np.ndarray) -> bytes:
    """Numbers below 2**32, their bytes in four planes."""
    return _pack(x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T)


def _unplane(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(_unpack(raw, np.uint8).reshape(4, -1).T).view(np.uint32).ravel().astype(np.int64)


_ROWS = "shard int, contexts binary, sizes binary, words binary, counts binary"


def _pack_rows(context: np.ndarray, word: np.ndarray, counts: np.ndarray) -> list[bytes]:
    at = _starts(context)
    return [_deltas(context[at]), _planes(np.diff(np.append(at, len(context)))), _planes(word), _planes(counts)]


def _unpack_rows(contexts: bytes, sizes: bytes, words_: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.repeat(_undelta(contexts), _unplane(sizes)), _unplane(words_), _unplane(counts)


def _put_counts(folder: str, name: str, counts: np.ndarray) -> None:
    """Counts as bytes; those of 255 or more stand in a list of their own, by place."""
    put(folder, name, np.minimum(counts, 255).astype(np.uint8))
    many = np.flatnonzero(counts >= 255)
    put(folder, f"{name}-many", np.stack([many, counts[many]]))


def _get_counts(folder: str, name: str, at: np.ndarray) -> np.ndarray:
    out = mapped(folder, name)[at].astype(np.int64)
    if (full := out == 255).any():
        many = mapped(folder, f"{name}-many")
        out[full] = many[1][np.searchsorted(many[0], at[full])]
    return out


def _put_stats(folder: str, name: str, stats: np.ndarray) -> None:
    """Statistics as rows of the table of all that occur; these are few."""
    table, row = np.unique(stats, axis=1, return_inverse=True)
    put(folder, f"{name}-row", row.ravel().astype(np.uint16 if table.shape[1] < 1 << 16 else np.uint32))
    put(folder, f"{name}-table", table)


def _put_edges(folder: str, name: str, at: np.ndarray, size: int) -> None:
    """Where each run of a longer array begins, and the end."""
    put(folder, name, np.append(at, size).astype(np.uint32 if size < 1 << 32 else np.int64))


def _put_pairs(folder: str, name: str, first: np.ndarray, second: np.ndarray) -> None:
    """Sorted pairs of numbers: each first once, where its run begins, and all seconds."""
    at = _starts(first)
    put(folder, f"{name}-first", first[at])
    _put_edges(folder, f"{name}-edge", at, len(second))
    put(folder, f"{name}-second", second.astype(np.uint32))


def _within(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, want: np.ndarray) -> np.ndarray:
    """The place of each wanted value in its run lo to hi of a mapped array, by binary search; -1 where it is not there."""
    out = np.full(len(want), -1, np.int64)
    live = np.flatnonzero(lo < hi)
    lo, hi = lo.astype(np.int64), hi.astype(np.int64) - 1
    while len(live):
        mid = (lo[live] + hi[live]) >> 1
        seen, asked = values[mid], want[live]
        out[live[seen == asked]] = mid[seen == asked]
        lo[live] = np.where(seen < asked, mid + 1, lo[live])
        hi[live] = np.where(seen > asked, mid - 1, hi[live])
        live = live[(seen != asked) & (lo[live] <= hi[live])]
    return out


def _find_pairs(folder: str, name: str, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The places of pairs, -1 for those that are not there."""
    keys, edge = mapped(folder, f"{name}-first"), mapped(folder, f"{name}-edge")
    i = np.minimum(np.searchsorted(keys, first), len(keys) - 1)
    return _within(mapped(folder, f"{name}-second"), edge[i], np.where(keys[i] == first, edge[i + 1], edge[i]), second)


# --- the model ---------------------------------------------------------------------------------------------------


class Vocabulary:
    """Dense numbers and counts of words, from shards of sorted hashes."""

    def __init__(self, folder: str, shards: list[tuple[int, int, int]]):
        self.folder, self.shards = folder, sorted(shards, key=lambda s: s[1])  # (part, first hash, rows)
        self.first = np.array([s[1] for s in self.shards], np.int64)
        self.base = np.append(0, np.cumsum([s[2] for s in self.shards])).astype(np.int64)

    def __len__(self) -> int:
        return int(self.base[-1])

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number (-1: unknown) and training count of each hash."""
        distinct, back = np.unique(hashes, return_inverse=True)
        number, count = np.full(len(distinct), -1, np.int64), np.zeros(len(distinct), np.int64)
        edge = np.append(np.searchsorted(distinct, self.first[1:]), len(distinct)) if len(self.first) else []
        lo = 0
        for i, hi in enumerate(edge):
            if hi > lo:
                known = mapped(self.folder, f"words-{self.shards[i][0]}")
                at = np.minimum(np.searchsorted(known, distinct[lo:hi]), len(known) - 1)
                hit = known[at] == distinct[lo:hi]
                number[lo:hi][hit] = self.base[i] + at[hit]
                count[lo:hi][hit] = mapped(self.folder, f"counts-{self.shards[i][0]}")[at[hit]]
            lo = hi
        return number[back], count[back]


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all rows' tokens, and the rows' offsets in them; each row has its end token last."""
    w = words(column, lower=True)
    return np.insert(w.hash.view(np.int64), w.first[1:], END), w.first + np.arange(len(w.first))


def _before(number: np.ndarray, at: np.ndarray, start: int, by: int) -> np.ndarray:
    """The number of the token ``by`` places before each; the start symbol's before a row's first."""
    out = np.full_like(number, start)
    out[by:] = number[:-by]
    for i in range(by):
        early = at[:-1] + i
        out[early[early < at[1:]]] = start
    return out


def _shard(v: np.ndarray, w: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    """N-grams lie with the word before their last, but those of frequent ones are spread by the last."""
    place = mix(v.astype(np.uint64))
    place += np.where(np.isin(v, hot), mix(w.astype(np.uint64)), np.uint64(0))
    return (place % np.uint64(shards)).astype(np.int64)


def _hot_shard(context: np.ndarray, shards: int) -> np.ndarray:
    return (mix(context.view(np.uint64)) % np.uint64(shards)).astype(np.int64)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally = Tally()

    def give() -> Iterator[pa.RecordBatch]:
        keys, counts = tally.take()
        for lo in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[lo : lo + 100_000]), pa.array(counts[lo : lo + 100_000], pa.int64())], ["h", "c"])

    for batch in batches:
        for part in slices(batch):
            if tally.add(tokens(part.column(0))[0]):
                yield from give()
    yield from give()


def _write_words(folder: str, hot_count: float):
    """A sorted range of words -> its two files; gives the range's place, and the places of frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not rows:
            return
        keys, counts = (np.concatenate([r[i] for r in rows]) for i in (0, 1))
        part = TaskContext.get().partitionId()
        put(folder, f"words-{part}", keys)
        put(folder, f"counts-{part}", counts)
        hot = np.flatnonzero(counts > hot_count)
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([int(keys[0])]), pa.array([len(keys)], pa.int64()), pa.array([hot.tolist()], pa.list_(pa.int64()))], ["part", "first", "rows", "hot"]
        )

    return run


def _count_ngrams(vocabulary: Vocabulary, hot: np.ndarray, shards: int, order: int):
    """Texts -> counts of n-grams by shard.  A context is (word before, and for trigrams the one before that)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = PairTally()

        def give() -> Iterator[pa.RecordBatch]:
            context, word, counts = tally.take()
            shard = _shard(context >> 32, word, hot, shards)
            place = np.argsort(shard, kind="stable")
            context, word, counts, shard = context[place], word[place], counts[place], shard[place]
            edge = np.searchsorted(shard, np.arange(shards + 1))
            for s in np.unique(shard).tolist():
                own = slice(edge[s], edge[s + 1])
                packed = _pack_rows(context[own], word[own], counts[own])
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)], ["shard", "contexts", "sizes", "words", "counts"])

        for batch in batches:
            for part in slices(batch):
                hashes, at = tokens(part.column(0))
                number, _ = vocabulary.find(hashes)
                context = _before(number, at, len(vocabulary), 1) << 32
                if order > 2:
                    context |= _before(number, at, len(vocabulary), 2)
                if tally.add(context, number):
                    yield from give()
        yield from give()

    return run


def _context_stats(counts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of runs of counts: their sums, and how many are 1, 2 and more."""
    if not len(at):
        return np.zeros((4, 0), np.int64)
    return np.stack([np.add.reduceat(x.astype(np.int64), at) for x in (counts, counts == 1, counts == 2, counts > 2)])


def _counts_of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == i).sum()) for i in (1, 2, 3, 4)] + [len(counts)]


def _write_ngrams(folder: str, vocabulary_base: np.ndarray, hot: np.ndarray, shards: int, order: int):
    """A shard's counts -> its files; gives counts of counts, what it knows of contexts of spread words, and what it knows
    of single words as first and second ones, by range."""
    names = ["kind", "range", "number", "values"]

    def row(kind: str, place: int, number: bytes, values: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([place], pa.int32()), pa.array([number], pa.binary()), pa.array([_pack(values)], pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_shard: dict[int, list] = {}
        for batch in batches:
            for s, *packed in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                by_shard.setdefault(s, []).append(_unpack_rows(*packed))
        for s in sorted(by_shard):
            rows = by_shard.pop(s)
            context, word, counts = _grouped(*(np.concatenate([r[i] for r in rows]) for i in range(3)))
            del rows
            first = counts
            if order > 2:
                at = _starts(context)
                put(folder, f"trigrams-{s}", word.astype(np.uint32))
                _put_edges(folder, f"trigrams-{s}-edge", at, len(word))
                _put_counts(folder, f"trigram-counts-{s}", counts)
                keys, stats = context[at], _context_stats(counts, at)
                _put_pairs(folder, f"contexts-{s}", keys >> 32, keys & WIDTH)
                _put_stats(folder, f"contexts-{s}", stats)
                spread = np.isin(keys >> 32, hot)
                keys, stats = keys[spread], stats[:, spread]
                place = _hot_shard(keys, shards)
                for i in np.unique(place).tolist():
                    yield row("spread", i, _deltas(keys[place == i]), stats[:, place == i])
                first = np.ones(len(counts), np.int64)  # below the highest order a count is of the words before
            top = _counts_of_counts(counts)
            pairs, times = _summed(context >> 32 << 32 | word, first)
            _put_pairs(folder, f"pairs-{s}", pairs >> 32, pairs & WIDTH)
            _put_counts(folder, f"times-{s}", times)
            yield row("totals", s, b"", np.array([top, _counts_of_counts(times)], np.int64))
            v = pairs >> 32
            at = _starts(v)
            w, followed = np.unique(pairs & WIDTH, return_counts=True)
            for kind, number, values in (("context", v[at], _context_stats(times, at)), ("word", w, followed[None])):
                edge = np.searchsorted(number, vocabulary_base)
                edge[-1] = len(number)  # the start symbol has the number behind the last word
                for i in range(len(edge) - 1):
                    if edge[i + 1] > edge[i]:
                        own = slice(edge[i], edge[i + 1])
                        yield row(kind, i, _deltas(number[own]), values[:, own].astype(np.uint32 if kind == "word" else np.int64))

    return run


def _write_spread(folder: str):
    """What shards know of contexts of spread words -> files of these contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for i, number, values in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                held.setdefault(i, []).append((_undelta(number), _unpack(values, np.int64).reshape(4, -1)))
        for i, rows in held.items():
            keys, back = np.unique(np.concatenate([r[0] for r in rows]), return_inverse=True)
            stats = np.zeros((4, len(keys)), np.int64)
            for k, values in enumerate(np.concatenate([r[1] for r in rows], axis=1)):
                np.add.at(stats[k], back, values)
            put(folder, f"spread-{i}-keys", keys)
            _put_stats(folder, f"spread-{i}", stats)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32())], ["range"])

    return run


def discounts(n: np.ndarray) -> np.ndarray:
    """The three discounts of modified Kneser-Ney from the counts of counts 1 to 4, kept within 0 and the count."""
    n1, n2, n3, n4 = (max(float(x), 0.0) for x in n[:4])
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw)])


def _write_dense(folder: str, sizes: list[int], d: np.ndarray):
    """All that shards know of a range of words -> dense files: contexts' totals and weights, and continuations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        base = np.append(0, np.cumsum(sizes))
        for batch in batches:
            for kind, i, number, values in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                context, word = held.setdefault(i, (np.zeros((4, sizes[i] + 1), np.int64), np.zeros(sizes[i] + 1, np.int64)))
                at = _undelta(number) - base[i]
                if kind == "context":
                    context[:, at] += _unpack(values, np.int64).reshape(4, -1)
                else:
                    word[at] += _unpack(values, np.uint32)
        for i, (context, word) in held.items():
            weight = (d[:, None] * context[1:]).sum(axis=0) / np.maximum(context[0], 1)
            put(folder, f"total-{i}", context[0])
            put(folder, f"weight-{i}", weight)
            put(folder, f"before-{i}", word)
            n = [int((word == k).sum()) for k in (1, 2, 3, 4)] + [int((word == 1).sum()), int((word == 2).sum()), int((word > 2).sum())]
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([n], pa.list_(pa.int64()))], ["range", "n"])

    return run


class Model:
    """What scoring needs besides the files."""

    def __init__(self, vocabulary: Vocabulary, hot: np.ndarray, shards: int, ranges: set[int], stats: dict):
        self.vocabulary, self.hot, self.shards, self.ranges = vocabulary, hot, shards, ranges
        self.__dict__.update(stats)  # order, tokens, pairs, filled, spread, d1, d2, d3, spare

    def _dense(self, name: str, number: np.ndarray) -> np.ndarray:
        """The value of each word number in a dense array; 0 for the unknown."""
        out = np.zeros(len(number), np.float64)
        of = np.clip(np.searchsorted(self.vocabulary.base, number, "right") - 1, 0, max(0, len(self.vocabulary.shards) - 1))
        for i in np.unique(of[number >= 0]).tolist():
            if i in self.ranges:
                own = (of == i) & (number >= 0)
                out[own] = mapped(self.vocabulary.folder, f"{name}-{i}")[number[own] - self.vocabulary.base[i]]
        return out

    def _by_shard(self, shard: np.ndarray, there: set[int]) -> Iterator[tuple[int, np.ndarray]]:
        """The rows of each shard that has files."""
        order = np.argsort(shard, kind="stable")
        edge = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s in np.unique(shard).tolist():
            if s in there:
                yield s, order[edge[s] : edge[s + 1]]

    def _pair_counts(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        out, folder = np.zeros(len(v), np.int64), self.vocabulary.folder
        for s, own in self._by_shard(_shard(v, w, self.hot, self.shards), self.filled):
            at = _find_pairs(folder, f"pairs-{s}", v[own], w[own])
            out[own[at >= 0]] = _get_counts(folder, f"times-{s}", at[at >= 0])
        return out

    def _stats(self, name: str, at: np.ndarray) -> np.ndarray:
        """Totals and weights of contexts at places of a file."""
        folder = self.vocabulary.folder
        table = mapped(folder, f"{name}-table")
        both = np.stack([table[0], (self.d3[:, None] * table[1:]).sum(axis=0) / np.maximum(table[0], 1)])
        return both[:, mapped(folder, f"{name}-row")[at]]

    def _trigram_counts(self, context: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each trigram was counted, and its context's total and weight."""
        count, stats, folder = np.zeros(len(w), np.int64), np.zeros((2, len(w))), self.vocabulary.folder
        v = context >> 32
        spread = np.isin(v, self.hot)
        for s, own in self._by_shard(_shard(v, w, self.hot, self.shards), self.filled):
            at = _find_pairs(folder, f"contexts-{s}", v[own], context[own] & WIDTH)
            own, at = own[at >= 0], at[at >= 0]
            local = ~spread[own]
            stats[:, own[local]] = self._stats(f"contexts-{s}", at[local])
            edge = mapped(folder, f"trigrams-{s}-edge")
            place = _within(mapped(folder, f"trigrams-{s}"), edge[at], edge[at + 1], w[own])
            count[own[place >= 0]] = _get_counts(folder, f"trigram-counts-{s}", place[place >= 0])
        far = np.flatnonzero(spread)
        for s, own in self._by_shard(_hot_shard(context[far], self.shards), self.spread):
            keys, own = mapped(folder, f"spread-{s}-keys"), far[own]
            at = np.minimum(np.searchsorted(keys, context[own]), len(keys) - 1)
            hit = keys[at] == context[own]
            stats[:, own[hit]] = self._stats(f"spread-{s}", at[hit])
        return count, stats

    def _chances(self, number: np.ndarray, v: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The probability of each word after v, and after u and v: each order falls back on the one below."""
        size = len(self.vocabulary)
        seen = self._dense("before", number)
        p = (seen - _cut(seen, self.d1)) / max(1, self.pairs) + self.spare / (size + 1)
        total, weight = self._dense("total", v), self._dense("weight", v)
        both = (v >= 0) & (number >= 0)
        times = np.zeros(len(number), np.int64)
        if both.any():
            pair, back = np.unique(v[both] << 32 | number[both], return_inverse=True)
            times[both] = self._pair_counts(pair >> 32, pair & WIDTH)[back]
        p = np.where(total > 0, (times - _cut(times, self.d2)) / np.maximum(total, 1) + weight * p, p)
        if self.order > 2:
            own = np.flatnonzero((u >= 0) & (v >= 0))
            if len(own):
                context, word = v[own] << 32 | u[own], number[own]
                order = np.lexsort((word, context))
                context, word, own = context[order], word[order], own[order]
                new = np.append(True, (context[1:] != context[:-1]) | (word[1:] != word[:-1]))
                times, (total, weight) = self._trigram_counts(context[new], word[new])
                nth = np.cumsum(new) - 1
                times, total, weight = times[nth], total[nth], weight[nth]
                p[own] = np.where(total > 0, (times - _cut(times, self.d3)) / np.maximum(total, 1) + weight * p[own], p[own])
        return p

    def token_scores(self, *columns: pa.Array) -> tuple[np.ndarray, ...]:
        """Offsets of the rows' tokens over all columns, and each token's training count, base score and probability.

        Tokens are looked up in the order of their shards, LOOKUP at a time, so a shard's files are visited once for all.
        """
        size = len(self.vocabulary)
        numbers, before, counts, edges = [], ([], []), [], [np.zeros(1, np.int64)]
        for column in columns:
            hashes, at = tokens(column)
            number, count = self.vocabulary.find(hashes)
            numbers.append(number.astype(np.int32))
            counts.append(count)
            for by in (1, 2):
                before[by - 1].append(_before(number, at, size, by).astype(np.int32))
            edges.append(edges[-1][-1] + at[1:])
        at = np.concatenate(edges)
        number, count = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (numbers, counts))
        v, u = (np.concatenate(x) if x else number for x in before)
        del numbers, before, counts
        base = np.log10((count + 0.1) / (self.tokens + 0.1 * (size + 1)))
        shard = np.concatenate([_shard(v[lo : lo + LOOKUP].astype(np.int64), number[lo : lo + LOOKUP].astype(np.int64), self.hot, self.shards).astype(np.int32) for lo in range(0, len(v), LOOKUP)]) if len(v) else v
        place = np.argsort(shard, kind="stable")
        p = np.zeros(len(number))
        for lo in range(0, len(place), LOOKUP):
            own = place[lo : lo + LOOKUP]
            p[own] = self._chances(*(x[own].astype(np.int64) for x in (number, v, u)))
        return at, count, base, p

    def score(self, *columns: pa.Array) -> tuple[np.ndarray, ...]:
        """Each row's tokens, known tokens, base score and log10 probability."""
        at, count, base, p = self.token_scores(*columns)
        rows = np.arange(len(at) - 1)
        row = np.repeat(rows, np.diff(at))
        return np.diff(at), np.bincount(row, count > 0, len(rows)).astype(np.int64), np.bincount(row, base, len(rows)), np.bincount(row, np.log10(p), len(rows))


def _cut(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The discount of each count."""
    return np.where(counts > 0, d[np.clip(counts, 1, 3).astype(int) - 1], 0)


def train(df: DataFrame, order: int = ORDER) -> Model:
    """Count a model of order 2 or 3 over all (text) rows."""
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    spark = df.sparkSession
    scratch = Scratch(spark, "kneser-ney")
    folder = scratch.path
    counted = scratch.table(df.select("text").mapInArrow(_count_words, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "vocabulary")
    n_tokens, n_words = (x or 0 for x in counted.agg(F.sum("c"), F.count("*")).first())
    if n_words >= 1 << 31:
        raise ValueError("more distinct words than half of a packed key can tell apart")
    shards = max(partitions(spark), -(-n_tokens // SHARD))  # what a task holds does not grow with the input
    ranged = counted.repartitionByRange(max(1, partitions(spark) // 4, -(-n_words * 2 // SHARD)), "h").sortWithinPartitions("h")
    ranges = ranged.mapInArrow(_write_words(folder, max(1000, n_tokens / (4 * shards))), "part int, first long, rows long, hot array<long>").collect()
    vocabulary = Vocabulary(folder, [(r["part"], r["first"], r["rows"]) for r in ranges])
    start = {s[0]: int(vocabulary.base[i]) for i, s in enumerate(vocabulary.shards)}
    hot = np.array(sorted([len(vocabulary), *(start[r["part"]] + i for r in ranges for i in r["hot"])]), np.int64)
    parts = df.select("text").mapInArrow(_count_ngrams(vocabulary, hot, shards, order), _ROWS)
    stats = parts.repartition(shards, "shard").mapInArrow(_write_ngrams(folder, vocabulary.base, hot, shards, order), "kind string, range int, number binary, values binary")
    stats = scratch.table(stats, "statistics")
    totals, filled = np.zeros((2, 5), np.int64), set()
    for r in stats.where("kind = 'totals'").select("range", "values").collect():  # ten numbers a shard
        totals += _unpack(bytes(r["values"]), np.int64).reshape(2, 5)
        filled.add(r["range"])
    d3, d2 = discounts(totals[0]), discounts(totals[1])
    sizes = [s[2] for s in vocabulary.shards]
    dense = stats.where("kind IN ('context', 'word')").repartition(max(1, len(sizes)), "range").mapInArrow(_write_dense(folder, sizes, d2), "range int, n array<long>")
    done = dense.collect()  # seven numbers a range
    spread = stats.where("kind = 'spread'").repartition(shards, "range").mapInArrow(_write_spread(folder), "range int").collect()  # a number a shard
    scratch.drop("statistics")
    scratch.drop("vocabulary")
    n = np.sum([r["n"] for r in done], axis=0) if done else np.zeros(7, np.int64)
    d1 = discounts(n)
    pairs = int(totals[1][4])
    spare = float((d1 * n[4:]).sum() / pairs) if pairs else 1.0
    known = {"order": order, "tokens": int(n_tokens), "pairs": pairs, "filled": filled, "spread": {r["range"] for r in spread}, "d1": d1, "d2": d2, "d3": d3, "spare": spare}
    return Model(vocabulary, hot, shards, {r["range"] for r in done}, known)


def score_documents(df: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, text) -> the contract's columns.

    A null or empty text is its end token alone.  Unknown words get the share that discounting leaves to them; without
    any training text every token is unknown.  Repeated rows score alike, null ids stay null; texts of any length are
    scored whole; an empty table gives an empty result.
    """
    shipped = df.sparkSession.sparkContext.broadcast(model)  # shard bounds and discounts: a few numbers a shard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, held, size = shipped.value, [], 0

        def give() -> pa.RecordBatch:
            n, known, base, score = m.score(*(part.column(2) for part in held))
            ids, out = (pa.concat_arrays([part.column(i) for part in held]) for i in (0, 1))
            return pa.RecordBatch.from_arrays(
                [ids, out, pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(ids), m.tokens, np.int64)), pa.array(base), pa.array(score)],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

        for batch in batches:
            for part in slices(batch):
                if held and size + part.column(2).nbytes > TEXTS:
                    yield give()
                    held, size = [], 0
                held.append(part)
                size += part.column(2).nbytes
        if held:
            yield give()

    return df.mapInArrow(run, SCHEMA)


def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(*clean()).select("doc_id", F.coalesce(held_out(FOLDS), F.lit(False)).alias("held_out"), "text")
    return score_documents(docs, train(docs.where("not held_out")))


def _discount_sql(counts: str) -> str:
    """Three discounts from a relation's column c."""
    return f"""SELECT [least(greatest(CASE WHEN n1 > 0 THEN 1 - 2 * y * n2 / n1 ELSE 0.5 END, 0.05), 0.95), least(greatest(CASE WHEN n2 > 0 THEN 2 - 3 * y * n3 / n2 ELSE 1 END, 0.05), 1.95),
             least(greatest(CASE WHEN n3 > 0 THEN 3 - 4 * y * n4 / n3 ELSE 1.5 END, 0.05), 2.95)] AS d
      FROM (SELECT *, CASE WHEN n1 > 0 THEN n1 / (n1 + 2 * n2) ELSE 0.5 END AS y FROM (
        SELECT count(*) FILTER (WHERE c = 1)::DOUBLE AS n1, count(*) FILTER (WHERE c = 2)::DOUBLE AS n2, count(*) FILTER (WHERE c = 3)::DOUBLE AS n3, count(*) FILTER (WHERE c = 4)::DOUBLE AS n4 FROM {counts}))"""


#: crc32 is not among DuckDB's functions: bit by bit over the digits of the id.
CRC32_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda r, i: xor(r >> 1, 3988292384 * (r & 1)))))"""

OP1_SQL = rf"""
WITH doc AS (SELECT doc_id, {CRC32_SQL} % 10 = 0 AS held_out,
               list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), chr(10)) AS ws FROM documents),
tok AS (SELECT doc_id, held_out, coalesce(lag(w, 2) OVER o, chr(9)) AS u, coalesce(lag(w) OVER o, chr(9)) AS v, w
        FROM (SELECT doc_id, held_out, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM doc) WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
uni AS (SELECT w, count(*) AS c FROM tok WHERE NOT held_out GROUP BY w),
triple AS (SELECT u, v, w, count(*) AS c FROM tok WHERE NOT held_out GROUP BY u, v, w),
pair AS (SELECT v, w, count(*) AS c FROM triple GROUP BY v, w),
before AS (SELECT w, count(*) AS c FROM pair GROUP BY w),
d1 AS ({_discount_sql("before")}), d2 AS ({_discount_sql("pair")}), d3 AS ({_discount_sql("triple")}),
size AS (SELECT (SELECT sum(c) FROM uni)::DOUBLE AS n, (SELECT count(*) FROM uni) AS size, (SELECT count(*) FROM pair)::DOUBLE AS pairs),
low AS (SELECT w, (c - d[least(c, 3)]) / pairs AS p FROM before, d1, size),
spare AS (SELECT sum(d[least(c, 3)]) / any_value(pairs) / (any_value(size) + 1) AS p FROM before, d1, size),
one AS (SELECT v, sum(c)::DOUBLE AS total, sum(d[least(c, 3)]) / sum(c) AS weight FROM pair, d2 GROUP BY v),
two AS (SELECT u, v, sum(c)::DOUBLE AS total2, sum(d[least(c, 3)]) / sum(c) AS weight2 FROM triple, d3 GROUP BY u, v),
mid AS (SELECT v, w, c - d[least(c, 3)] AS c FROM pair, d2),
high AS (SELECT u, v, w, c - d[least(c, 3)] AS c FROM triple, d3),
each AS (SELECT doc_id, held_out, uni.c AS known, n, size, high.c AS c3, total2, weight2,
           CASE WHEN total IS NULL THEN coalesce(low.p, 0) + spare.p ELSE coalesce(mid.c, 0) / total + weight * (coalesce(low.p, 0) + spare.p) END AS p2
         FROM tok LEFT JOIN uni USING (w) LEFT JOIN low USING (w) LEFT JOIN one USING (v) LEFT JOIN mid USING (v, w) LEFT JOIN two USING (u, v) LEFT JOIN high USING (u, v, w), spare, size)
SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(known) AS n_known, any_value(n)::BIGINT AS train_tokens,
       sum(log10((coalesce(known, 0) + 0.1) / (n + 0.1 * (size + 1)))) AS base_score,
       sum(log10(CASE WHEN total2 IS NULL THEN p2 ELSE coalesce(c3, 0) / total2 + weight2 * p2 END)) AS score
FROM each GROUP BY doc_id
"""

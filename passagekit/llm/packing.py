"""Packing token sequences: first-fit decreasing with a tournament tree of bin capacities, in randomised groups.

Documents longer than a sequence are cut into full sequences and a rest; full pieces need no packing.  The rests of a
group, chosen by a hash of the document, are packed together; only lengths travel, never ids.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .byte_bpe import ship
from .common import Scratch, clean, documents, map_batches, slices
from .textkit import words

SEQUENCE = 2048
END_ID = 1
GROUP = 4096  # documents in a group, about
CACHE = 1_500_000  # words kept by a worker
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
SCHEMA = f"{PIECES}, piece long, sequence_id long, offset long"


class WordTokens:
    """Ids of white-space separated words.  The tokenizer drops white space and never merges across it, so the ids of a
    text are those of its words; each word is encoded once and kept under its fingerprint."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.at = self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, and the rows' offsets in them."""
        w = words(column)
        distinct, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > CACHE:
            self.clear()
        where = np.searchsorted(self.known, distinct)
        seen = np.zeros(len(distinct), bool)
        inside = where < len(self.known)
        seen[inside] = self.known[where[inside]] == distinct[inside]
        if not seen.all():
            data = w.data.tobytes()
            new = first[~seen]
            texts = [data[a:b].decode() for a, b in zip(w.start[new].tolist(), w.end[new].tolist(), strict=True)]
            ids = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            size = np.array([len(x) for x in ids], np.int64)
            flat = np.fromiter((i for x in ids for i in x), np.uint32, int(size.sum()))
            at = len(self.flat) + np.cumsum(size) - size
            self.flat = np.concatenate([self.flat, flat])
            slot = where[~seen]
            self.known = np.insert(self.known, slot, distinct[~seen])
            self.at, self.size = np.insert(self.at, slot, at), np.insert(self.size, slot, size)
            where = np.searchsorted(self.known, distinct)
        at, size = self.at[where][inverse], self.size[where][inverse]
        total = np.append(0, np.cumsum(size))
        ids = self.flat[np.arange(total[-1]) + np.repeat(at - total[:-1], size)]
        return ids, total[w.first]


@lru_cache(maxsize=2)
def _loaded(name: str) -> WordTokens:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
    return WordTokens(SparkFiles.get(name))


def token_pieces(df: DataFrame, path: str, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """(doc_id, text) -> pieces of at most ``sequence`` ids that cover each document's ids and its end id once."""
    name = ship(df.sparkSession, path)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        tokens = _loaded(name)
        for part in slices(batch):
            ids, at = tokens.encode(part.column(1).fill_null(""))
            doc, start, length, crc, total = [], [], [], [], []
            for i, key in enumerate(part.column(0).to_pylist()):
                own = np.append(ids[at[i] : at[i + 1]], np.uint32(end_id)).astype("<u4")
                for a in range(0, len(own), sequence):
                    piece = own[a : a + sequence]
                    doc.append(key)
                    start.append(a)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece.tobytes()))
                    total.append(len(own))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, start, length, crc, total)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return map_batches(df, run, PIECES)


class Bins:
    """A tournament tree over bins of one capacity: each inner node holds the larger room of its two children."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Put an item into the first bin with room for it."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        bin_, room[node] = node - self.leaves, room[node] - size
        while node > 1:
            node >>= 1
            room[node] = max(room[2 * node], room[2 * node + 1])
        return bin_


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset in it of each item; equal sizes are placed in the order given."""
    bins, at = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    tree, filled = Bins(len(sizes), capacity), {}
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        b = tree.place(size)
        bins[i], at[i] = b, filled.get(b, 0)
        filled[b] = filled.get(b, 0) + size
    return bins, at


def pack(pieces: DataFrame, group: int = GROUP, sequence: int = SEQUENCE) -> DataFrame:
    """Sequence and offset of each piece.  ``pieces`` must be a written table with a number of its own for each row
    (``piece``): it is counted and then read again.

    The number of groups follows the number of pieces, so that a group stays near ``group`` of them at any size.  Groups
    are chosen by a hash of the row's number, so that repeated ids, or null ones, spread as well; a sequence's id is its
    group's number and its own number in the group.
    """
    rests = pieces.where(F.col("length") < sequence)
    groups = max(1, -(-rests.count() // group))
    key = F.pmod(F.xxhash64("piece", F.lit(5)), F.lit(groups))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("piece", "ascending")])
        bins, at = first_fit_decreasing(table["length"].to_numpy(), sequence)
        ids = (table["group"].to_numpy() << 32) + bins * 2
        return table.drop_columns(["group"]).append_column("sequence_id", pa.array(ids, pa.int64())).append_column("offset", pa.array(at, pa.int64()))

    packed = rests.withColumn("group", key).groupBy("group").applyInArrow(run, SCHEMA)
    # a full piece is a sequence by itself: odd numbers, apart from the even ones of packed sequences
    full = pieces.where(F.col("length") == sequence).withColumn("sequence_id", F.col("piece") * 2 + 1).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(full).drop("piece")


def pack_documents(df: DataFrame, path: str, sequence: int = SEQUENCE, end_id: int = END_ID, group: int = GROUP) -> DataFrame:
    """(doc_id, text) -> pieces with sequence_id and offset.

    A null or empty text is one piece of the end id.  Repeated rows are packed each by itself, null ids too.  Equal
    lengths are placed in the order of the rows.  An empty table gives an empty result.
    """
    scratch = Scratch(df.sparkSession, "packing")
    pieces = token_pieces(df, path, sequence, end_id).withColumn("piece", F.monotonically_increasing_id())
    return pack(scratch.table(pieces, "pieces"), group, sequence)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir).select(*clean()), public_tokenizers.path("word_bpe_49k.json"))

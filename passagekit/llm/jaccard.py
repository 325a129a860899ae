"""N-gram Jaccard join: all links of documents whose shingle sets are similar, and the components that they make.

Texts with equal sets are one node.  Candidates share enough of the rarest shingles: a set's prefix under an order that
puts frequent shingles last, long enough that linked sets share several members of it.  Candidates form clusters.  A
small cluster is searched by itself; a large one is cut into blocks by size and hash, each written once to the shared
folder, and each pair of blocks whose sizes can be similar is read and searched once.  The search is by T-occurrence (DivideSkip) and verifies every link; a task gives
out how many links each node has, and of the links only those that join components.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator
from functools import lru_cache
from math import ceil, log, log2, sqrt

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small, clean, documents, map_batches, partitions, slices
from .graph import components
from .textkit import digest128, mix, shingles, words

WORDS = 5
PERCENT = 80
CELLS_BITS = 24  # of the frequency sketch: 16 MB at any size of the input
CHUNK_BITS = 20
LINEAR = 128  # levels of frequency by steps; the others are by the logarithm
SMALL_LIST = 48  # up to here all pairs of a shared prefix shingle are counted
SHARD = 2_000_000  # prefix shingles that a task counts pairs of, about
BLOCK = 1 << 18  # shingles of a block, about
BUNDLE = 1 << 18  # shingles of the small clusters that are searched in one group, about
PAIRS = 16  # of blocks that a task searches, about
BLOCK_SCHEMA = pa.schema([("doc_id", pa.int64()), ("d1", pa.int64()), ("copies", pa.int64()), ("members", pa.large_binary())])
HEAP = 256  # entries of short lists that a heap merges; more are merged by a sort
STEP = log(1.25)  # linked sets lie in one size class or in neighbouring ones


def least_overlap(n: np.ndarray | int, percent: int = PERCENT):
    """No set of n members reaches the similarity with fewer in common."""
    return (percent * n + 99) // 100


def common_prefix(n):
    """How many members two linked sets must share within their prefixes."""
    return 1 + n // 10


# --- statistics over all documents ---------------------------------------------------------------------------------


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (doc_id, n, d1, d2), and at the end the task's sketch of shingle frequencies in compressed chunks."""
    names = ["doc_id", "n", "d1", "d2", "chunk", "counts"]
    sketch = np.zeros(1 << CELLS_BITS, np.uint8)
    used = False
    for batch in batches:
        for part in slices(batch):
            keys, _, at = shingles(words(part.column(1), lower=True), WORDS)
            d1, d2 = digest128(keys, at)
            cells, count = np.unique(keys >> np.uint64(64 - CELLS_BITS), return_counts=True)
            cells = cells.astype(np.int64)
            sketch[cells] = np.minimum(sketch[cells].astype(np.int64) + count, 255)
            used = True
            none = pa.nulls(part.num_rows)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.diff(at), pa.int64()), pa.array(d1), pa.array(d2), none.cast(pa.int32()), none.cast(pa.binary())], names
            )
    if used:
        pack = zstandard.ZstdCompressor(level=1).compress
        for i, x in enumerate(sketch.reshape(-1, 1 << CHUNK_BITS)):
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64())] * 4 + [pa.array([i], pa.int32()), pa.array([pack(x.tobytes())], pa.binary())], names
            )


def _levels(counts: np.ndarray, least: float, step: float) -> np.ndarray:
    """Counts as levels of a byte: LINEAR of them by steps, beyond that eight for each doubling."""
    x = np.maximum(counts - least, 0) / step
    return np.minimum(np.where(x < LINEAR, x, LINEAR + 8 * np.log2(np.maximum(x, LINEAR) / LINEAR)), 255).astype(np.uint8)


def frequency_levels(profile: DataFrame) -> bytes:
    """One level for each cell of the sketch, compressed: by the count, in steps of half of its deviation where all
    shingles are rare, and by its logarithm far above that.

    A shingle of more than SMALL_LIST documents must stand out from the rare ones that share its cell also where these
    are many: the cells' mean grows with the input, but what chance adds to it only as its root.  Tasks' sketches are
    added in two rounds of groups, so no group holds all of them.
    """
    parts = profile.where(F.col("chunk").isNotNull()).select("chunk", "counts")
    total = profile.agg(F.sum("n")).first()[0] or 0
    tasks = max(1, parts.where("chunk = 0").count())
    mean = total / (1 << CELLS_BITS)
    step, least = max(1.0, sqrt(mean) / 2), max(0.0, mean - 8 * sqrt(mean))

    def add(dtype: type):
        def run(key: tuple, table: pa.Table) -> pa.Table:
            sums, unpack = np.zeros(1 << CHUNK_BITS, np.uint32), zstandard.ZstdDecompressor().decompress
            for x in table["counts"]:
                sums += np.frombuffer(unpack(x.as_py()), dtype)
            if dtype is np.uint32:
                sums = _levels(sums, least, step)
            return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "counts": [zstandard.ZstdCompressor(level=1).compress(sums.tobytes())]})

        return run

    first = parts.groupBy("chunk", F.pmod(F.monotonically_increasing_id(), F.lit(ceil(sqrt(tasks)))).alias("part")).applyInArrow(add(np.uint8), "chunk int, counts binary")
    rows = first.groupBy("chunk").applyInArrow(add(np.uint32), "chunk int, counts binary").collect()
    unpack = zstandard.ZstdDecompressor().decompress
    levels = np.zeros((1 << (CELLS_BITS - CHUNK_BITS), 1 << CHUNK_BITS), np.uint8)
    for r in rows:
        levels[r["chunk"]] = np.frombuffer(unpack(bytes(r["counts"])), np.uint8)
    return zstandard.ZstdCompressor(level=3).compress(levels.tobytes())


# --- candidates ----------------------------------------------------------------------------------------------------


def _size_class(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(n, 1)) / STEP + 1e-9).astype(np.int64)


def _ties(key: np.ndarray, doc: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of long lists, sorted by key -> which row is the first of its list and size class, and edges from the
    others to it.  Neighbouring classes of a list are tied by their first rows."""
    step = _size_class(size)
    order = np.lexsort((doc, step, key))
    k, c, d = key[order], step[order], doc[order]
    new = np.append(True, (k[1:] != k[:-1]) | (c[1:] != c[:-1]))
    lead = np.flatnonzero(new)
    own = lead[np.cumsum(new) - 1]
    a, b = d[own[~new]], d[~new]
    near = np.flatnonzero((k[lead][1:] == k[lead][:-1]) & (c[lead][1:] - c[lead][:-1] == 1))
    first = np.zeros(len(key), bool)
    first[order[lead]] = True
    return first, np.concatenate([a, d[lead][near]]), np.concatenate([b, d[lead][near + 1]])


def _postings(levels, shards: int):
    """(doc_id, text) -> the prefix of each set, by shard of the shingle, as packed columns.

    A task's own long lists are tied at once: of these only the first document of each size class travels, marked by a
    negative size, so that no shard gets a common shingle's documents.  The ties stand under shard -1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(zstandard.ZstdDecompressor().decompress(levels.value), np.uint8)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        pack = zstandard.ZstdCompressor(level=1).compress

        def give(shard: int, key: np.ndarray, doc: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            ids = doc.astype("<u4") if 0 <= doc.min() and doc.max() < 1 << 32 else doc
            columns = [pa.array([shard], pa.int32())] + [pa.array([pack(np.ascontiguousarray(x).tobytes())], pa.binary()) for x in (key, ids, n)]
            return pa.RecordBatch.from_arrays(columns, ["shard", "keys", "docs", "sizes"])

        def flush() -> Iterator[pa.RecordBatch]:
            key, doc, n = (np.concatenate([h[i] for h in held]) for i in range(3))
            held.clear()
            order = np.argsort(key, kind="stable")
            key, doc, n = key[order], doc[order], n[order]
            at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            length = np.diff(np.append(at, len(key)))
            long = np.repeat(length > SMALL_LIST, length)
            if long.any():
                first, a, b = _ties(key[long], doc[long], n[long])
                if len(a):
                    yield give(-1, a.view(np.uint64), b, np.zeros(0, np.int32))
                rows = np.flatnonzero(long)
                n = n.copy()
                n[rows[first]] *= -1
                stay = np.ones(len(key), bool)
                stay[rows[~first]] = False
                key, doc, n = key[stay], doc[stay], n[stay]
            shard = (mix(key) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            key, doc, n, shard = key[order], doc[order], n[order], shard[order]
            edge = np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])), len(shard))
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                yield give(int(shard[lo]), key[lo:hi], doc[lo:hi], n[lo:hi])

        for batch in batches:
            for part in slices(batch):
                key, row, at = shingles(words(part.column(1), lower=True), WORDS)
                order = np.lexsort((key, level[(key >> np.uint64(64 - CELLS_BITS)).astype(np.int64)], row))
                key, n = key[order], np.diff(at)
                size = n - least_overlap(n) + common_prefix(n)
                first = np.arange(len(key)) - at[row] < np.minimum(size, n)[row]
                held.append((key[first], part.column(0).to_numpy()[row[first]], n[row[first]].astype(np.int32)))
            if sum(len(h[0]) for h in held) > 1_000_000:
                yield from flush()
        if held and sum(len(h[0]) for h in held):
            yield from flush()

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All of a shard's postings -> pairs of documents with the number of prefix shingles that they share here.

    Lists beyond SMALL_LIST, which frequent shingles alone have, tie their documents by size classes instead.
    """
    unpack = zstandard.ZstdDecompressor().decompress
    keys, docs, sizes = [], [], []
    for batch in batches:
        for s, k, d, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            k = np.frombuffer(unpack(k), np.uint64)
            raw = unpack(d)
            doc = np.frombuffer(raw, np.uint32 if len(raw) == 4 * len(k) else np.int64).astype(np.int64)
            if s < 0:
                tie = np.unique(np.stack([k.view(np.int64), doc]), axis=1)
                one = pa.array(np.ones(tie.shape[1], np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(tie[0]), pa.array(tie[1]), one, one], ["a", "b", "shared", "need"])
                continue
            keys.append(k)
            docs.append(doc)
            sizes.append(np.frombuffer(unpack(n), np.int32))
    if not keys:
        return
    key, doc, size = np.concatenate(keys), np.concatenate(docs), np.concatenate(sizes).astype(np.int64)
    order = np.lexsort((size, doc, key))
    key, doc, size = key[order], doc[order], size[order]
    new = np.ones(len(key), bool)  # one id may stand on several rows
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    key, doc, size = key[new], doc[new], size[new]
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    length = np.diff(np.append(start, len(key)))
    marked = np.minimum.reduceat(size, start) < 0  # a task has tied some of the list already
    size = np.abs(size)

    def give(x: np.ndarray, y: np.ndarray, count: np.ndarray, need: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (x, y, count, need)], ["a", "b", "shared", "need"])

    short = (length > 1) & (length <= SMALL_LIST) & ~marked
    for n in np.unique(length[short]).tolist():
        i, j = np.triu_indices(n, 1)
        own = start[short & (length == n)]
        for lo in range(0, len(own), step := max(1, 1_000_000 // len(i))):
            s = own[lo : lo + step, None]
            a, b = (s + i).ravel(), (s + j).ravel()
            ok = 100 * np.minimum(size[a], size[b]) >= PERCENT * np.maximum(size[a], size[b])
            a, b = a[ok], b[ok]
            x, y, need = doc[a], doc[b], common_prefix(np.minimum(size[a], size[b]))
            order = np.lexsort((y, x))
            x, y, need = x[order], y[order], need[order]
            at = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])))[: len(x)]
            yield give(x[at], y[at], np.diff(np.append(at, len(x))), need[at])
    long = np.repeat((length > SMALL_LIST) | marked & (length > 1), length)
    if long.any():
        _, a, b = _ties(key[long], doc[long], size[long])
        tie = np.unique(np.stack([a, b]), axis=1)
        one = np.ones(tie.shape[1], np.int64)
        yield give(tie[0], tie[1], one, one)


# --- exact links ---------------------------------------------------------------------------------------------------


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether they were apart."""
        x, y = self.find(x), self.find(y)
        self.up[y] = x
        return x != y


class Lists:
    """Inverted lists over sets: for each shingle the sorted places of the sets that have it."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = max(1, len(sets))
        key = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        place = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        order = np.lexsort((place, key))
        key, self.place = key[order], place[order]
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        self.keys, self.at = key[at], np.append(at, len(key))
        self.both = np.repeat(np.arange(len(at)), np.diff(self.at)) * self.n + self.place  # (shingle, place) as one sorted number

    def found(self, own: np.ndarray) -> np.ndarray:
        """The lists of a set's shingles that have one."""
        if not len(self.keys):
            return np.zeros(0, np.int64)
        i = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        return i[self.keys[i] == own]

    def divide_skip(self, lists: np.ndarray, least: int, below: int) -> tuple[np.ndarray, np.ndarray]:
        """The places under ``below`` that occur in at least ``least`` of the lists, and how often.

        The longest lists are set aside, the others are merged; who occurs often enough there to reach the threshold at
        all is probed in the long lists by binary search, and given up as soon as it cannot reach it.
        """
        size = self.at[lists + 1] - self.at[lists]
        order = np.argsort(size, kind="stable")
        lists, size = lists[order], size[order]
        long = min(max(0, least - 1), int(least / (0.0085 * log2(max(2, int(size[-1])))) + 1), len(lists)) if len(lists) else 0
        short = len(lists) - long
        runs = [self.place[self.at[i] : self.at[i + 1]] for i in lists[:short].tolist()]
        if size[:short].sum() <= HEAP:
            merged = np.fromiter(heapq.merge(*(r.tolist() for r in runs)), np.int64)
        else:
            merged = np.sort(np.concatenate(runs), kind="stable")
        edge = np.flatnonzero(np.append(True, merged[1:] != merged[:-1]))[: len(merged)]
        who, count = merged[edge], np.diff(np.append(edge, len(merged)))
        probe = lists[short:]
        able = (count + long >= least) & (who < below)
        who, count = who[able], count[able]
        if len(who) <= 64:
            want = probe[:, None] * self.n + who
            i = np.minimum(np.searchsorted(self.both, want), len(self.both) - 1) if len(self.both) else want
            count = count + (self.both[i] == want).sum(axis=0) if len(who) and long else count
        else:
            for left, i in enumerate(probe.tolist()):
                own = self.place[self.at[i] : self.at[i + 1]]
                spot = np.minimum(np.searchsorted(own, who), len(own) - 1)
                count = count + (own[spot] == who)
                if left % 8 == 7:
                    able = count + (long - 1 - left) >= least
                    who, count = who[able], count[able]
        able = count >= least
        return who[able], count[able]


def block_links(ids: list[int], sets: list[np.ndarray], copies: np.ndarray, side: np.ndarray | None = None) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """For each set the copies of all others linked with it, and links that join what hangs together.

    Each pair is looked at once; with ``side``, only pairs of different sides are.
    """
    size = np.array([len(x) for x in sets], np.int64)
    order = np.lexsort((np.array(ids, np.int64), size))
    inside = np.ones(len(ids), bool) if side is None else ~side
    asks = np.ones(len(ids), bool) if side is None else side
    stored = order[inside[order]]  # by size, so that places rise with the sizes
    index, stored_size = Lists([sets[i] for i in stored.tolist()]), size[stored]
    place = np.full(len(ids), -1)
    place[stored] = np.arange(len(stored))
    forest, links, edges = Forest(len(ids)), np.zeros(len(ids), np.int64), []
    for i in order[asks[order]].tolist():
        n = int(size[i])
        lists = index.found(sets[i])
        least = int(least_overlap(n))
        if len(lists) < least:
            continue
        who, both = index.divide_skip(lists, least, int(place[i]) if side is None else len(stored))
        ok = 100 * both >= PERCENT * (n + stored_size[who] - both)
        other = stored[who[ok]]
        links[i] += copies[other].sum()
        links[other] += copies[i]
        edges += [(ids[i], ids[j]) for j in other.tolist() if forest.join(i, j)]
    return links, edges


_FOUND = "a long, b long, d1 long, links long"


def _given(ids: list[int], d1: list[int], links: np.ndarray, edges: list[tuple[int, int]]) -> list[tuple]:
    """Rows of links that join (a, b), and of numbers of links (a, d1, links)."""
    return [(a, b, None, None) for a, b in edges] + [(ids[i], None, d1[i], int(links[i])) for i in np.flatnonzero(links).tolist()]


def _search(table: pa.Table) -> pa.Table:
    """Some small clusters, or two blocks of a large one, or a block by itself: links by node, and joining links.  Of two
    blocks the second asks the first.

    A node whose row is repeated in the table stands there more than once, and counts once.
    """
    place = pa.table({"cluster": table["cluster"], "doc_id": table["doc_id"], "d1": table["d1"], "i": np.arange(table.num_rows)})
    table = table.take(place.group_by(["cluster", "doc_id", "d1"]).aggregate([("i", "min")]).sort_by([("cluster", "ascending"), ("i_min", "ascending")])["i_min"])
    cluster, copies, second = (table[c].to_numpy() for c in ("cluster", "copies", "second"))
    ids, d1, members = (table[c].to_pylist() for c in ("doc_id", "d1", "members"))
    edge = np.append(np.flatnonzero(np.append(True, cluster[1:] != cluster[:-1])), len(cluster)).tolist()
    rows = []
    for lo, hi in zip(edge[:-1], edge[1:], strict=True):
        sets = [np.frombuffer(x, np.uint64) for x in members[lo:hi]]
        side = second[lo:hi] if second[lo:hi].any() else None
        rows += _given(ids[lo:hi], d1[lo:hi], *block_links(ids[lo:hi], sets, copies[lo:hi], side))
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("a", "b", "d1", "links"), columns, strict=True)})


def _sets(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, d1, copies, cluster) -> the sets of nodes; another text of a node's id is none."""
    for part in slices(batch):
        key, _, at = shingles(words(part.column(1), lower=True), WORDS)
        own = np.flatnonzero(digest128(key, at)[0] == part.column(2).to_numpy())
        members = pa.array([key[at[i] : at[i + 1]].tobytes() for i in own.tolist()], pa.binary())
        doc, d1, copies, cluster = (part.column(i).take(pa.array(own)) for i in (0, 2, 3, 4))
        yield pa.RecordBatch.from_arrays([doc, d1, members, cluster, copies], ["doc_id", "d1", "members", "cluster", "copies"])


def _small(sets: DataFrame, sized: DataFrame) -> DataFrame:
    """The sets of small clusters, by bundle."""
    small = sized.where(F.col("total") <= BLOCK)
    bundles = max(1, ceil((small.agg(F.sum("total")).first()[0] or 0) / BUNDLE))
    return sets.join(small.select("cluster"), "cluster").select(F.pmod(F.xxhash64("cluster"), F.lit(bundles)).alias("bundle"), F.lit(False).alias("second"), "cluster", "doc_id", "d1", "copies", "members")


def _write_block(folder: str):
    """A block's sets -> its file; a repeated task writes the same rows again, and a half-written file has another name."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        store, path = pafs.FileSystem.from_uri(folder)
        name, part = "-".join(str(k.as_py()) for k in key), f"{path}/.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as out, pa.ipc.new_file(out, BLOCK_SCHEMA) as sink:
            sink.write_table(table.select(BLOCK_SCHEMA.names).cast(BLOCK_SCHEMA))
        store.move(part, f"{path}/{name}")
        return pa.table({name: pa.array([k.as_py()], pa.int64()) for name, k in zip(("cluster", "step", "part"), key, strict=True)})

    return run


def _search_blocks(folder: str):
    """Pairs of blocks -> links by node, and joining links.  A task holds the two blocks that it searches, and no more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = pafs.FileSystem.from_uri(folder)

        @lru_cache(maxsize=2)
        def block(cluster: int, step: int, part: int) -> pa.Table:
            with store.open_input_file(f"{path}/{cluster}-{step}-{part}") as source:
                return pa.ipc.open_file(source).read_all()

        for batch in batches:
            for cluster, step, part, low_step, low_part in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                sides = [block(cluster, low_step, low_part)]
                if (step, part) != (low_step, low_part):
                    sides.append(block(cluster, step, part))  # the higher block asks
                both = pa.concat_tables([t.append_column("second", [pa.array(np.full(t.num_rows, i == 1))]) for i, t in enumerate(sides)])
                yield from _search(both.append_column("cluster", [pa.array(np.full(both.num_rows, cluster, np.int64))])).to_batches()

    return run


def _large(sets: DataFrame, sized: DataFrame, scratch: Scratch) -> DataFrame | None:
    """Links of large clusters: each set is written once, to its block's file, and tasks read the pairs of blocks."""
    n = F.length("members") / 8
    large = sized.where(F.col("total") > BLOCK).select("cluster")
    if not large.limit(1).count():
        return None
    cut = scratch.table(sets.join(large, "cluster").withColumn("step", F.floor(F.log(n) / STEP + 1e-9).cast("long")), "large")
    parts = scratch.table(cut.groupBy("cluster", "step").agg(F.ceil(F.sum(n) / BLOCK).cast("long").alias("parts")), "parts")
    placed = cut.join(parts, ["cluster", "step"]).withColumn("part", F.pmod(F.xxhash64("doc_id", "d1", F.lit(4)), F.col("parts")))
    folder = scratch.folder("blocks")
    written = placed.select("cluster", "step", "part", *BLOCK_SCHEMA.names).groupBy("cluster", "step", "part").applyInArrow(_write_block(folder), "cluster long, step long, part long")
    blocks = scratch.table(written, "block-names")
    scratch.drop("large")
    # a block meets itself, the lower ones of its size class, and those of the class below
    low = blocks.select("cluster", F.col("step").alias("low_step"), F.col("part").alias("low_part"))
    met = blocks.withColumn("low_step", F.explode(F.array("step", F.col("step") - 1))).join(low, ["cluster", "low_step"]).where("low_step < step OR low_part <= part")
    pairs = scratch.table(met.select("cluster", "step", "part", "low_step", "low_part"), "block-pairs")
    tasks = max(partitions(scratch.spark), ceil(pairs.count() / PAIRS))
    ordered = pairs.repartitionByRange(tasks, "cluster", "low_step", "low_part", "step", "part").sortWithinPartitions("cluster", "low_step", "low_part", "step", "part")
    return ordered.mapInArrow(_search_blocks(folder), _FOUND)


def jaccard_components(df: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n_shingles, component_id, n_links: one row for each row.

    Letters A-Z count as lower case.  Null, empty and blank texts have no shingles and are linked with nothing; texts
    of fewer than five words have their whole sequence as one.  Equal sets are always linked.  n_links is the number of
    other rows whose set is linked with the row's.  Rows that repeat an id are one node of a component.  All links count:
    none is capped or sampled.  An empty table gives an empty result.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "jaccard")
    both = scratch.table(df.mapInArrow(_profile, "doc_id long, n long, d1 long, d2 long, chunk int, counts binary"), "profile")
    profile = both.where(F.col("chunk").isNull()).select("doc_id", "n", "d1", "d2")
    # equal sets are written as one node: joins with this table do not sit on its own grouping
    first = scratch.table(profile.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.sum("n").alias("n")), "nodes")
    levels = spark.sparkContext.broadcast(frequency_levels(both))
    reps = scratch.table(first.select(F.col("rep").alias("doc_id")).distinct(), "reps")
    inside = first.agg(F.sum(F.col("n") / F.col("copies"))).first()[0] or 0
    shards = max(partitions(spark), ceil(0.31 * inside / SHARD))
    posted = df.join(broadcast_if_small(reps), "doc_id", "left_semi").mapInArrow(_postings(levels, shards), "shard int, keys binary, docs binary, sizes binary")
    spread = F.when(F.col("shard") >= 0, F.col("shard")).otherwise(F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int"))
    pairs = posted.withColumn("at", spread).repartition(shards, "at").drop("at").mapInArrow(_pairs, "a long, b long, shared long, need long")
    edges = pairs.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("need").alias("need")).where("shared >= need").select("a", "b")
    cluster = components(edges, scratch, "candidates").select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    member = scratch.table(first.join(cluster, "rep").select(F.col("rep").alias("doc_id"), "d1", "copies", "cluster"), "members")
    text = df.join(broadcast_if_small(member), "doc_id").select("doc_id", "text", "d1", "copies", "cluster")
    sets = scratch.table(map_batches(text, _sets, "doc_id long, d1 long, members binary, cluster long, copies long"), "sets")
    sized = scratch.table(sets.groupBy("cluster").agg(F.sum(F.length("members") / 8).alias("total")), "sizes")
    links, large = _small(sets, sized).groupBy("bundle").applyInArrow(_search, _FOUND), _large(sets, sized, scratch)
    found = scratch.table(links if large is None else links.unionByName(large), "links")
    scratch.drop("sets")
    scratch.drop("blocks")
    final = components(found.where("b IS NOT NULL").select("a", "b"), scratch, "final")
    number = found.where("d1 IS NOT NULL").groupBy(F.col("a").alias("rep"), "d1").agg(F.sum("links").alias("links"))
    named = first.join(final, first["rep"] == final["node"], "left").join(number, ["rep", "d1"], "left")
    named = scratch.table(named.select("d1", "d2", F.coalesce("component", "rep").alias("component"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links")), "named")
    out = profile.join(named, ["d1", "d2"], "left")
    linked = F.col("n") > 0
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(linked, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), F.when(linked, F.col("links")).otherwise(0).alias("n_links"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir).select(*clean()))


OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM both_ JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id AS x, doc_id AS r FROM w UNION SELECT edge.y, reach.r FROM reach JOIN edge ON edge.x = reach.x)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, any_value(c.component_id) AS component_id, count(edge.y) AS n_links
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(r) AS component_id FROM reach GROUP BY x) c USING (doc_id) LEFT JOIN edge ON edge.x = w.doc_id GROUP BY w.doc_id
"""

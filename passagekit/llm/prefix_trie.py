"""Prefix trie of conversations by an LCP-aware external mergesort.

A conversation is a sequence of turns, and a turn is known by a 128-bit digest of its role and text, so that sequences
sort by digests and equal turns are equal digests.  Tasks sort what they read into runs that carry the LCP (number of
shared first turns) of each sequence with the one before it; runs are cut at sampled splitters and shuffled in
front-coded blocks, so shared turns are sent once a block.  A partition's runs are merged by a loser tree whose nodes
keep LCPs, so that turns known to be shared are never compared again, and the merged stream feeds a stack of open trie
nodes that gives out each node when the stream has left it.

A node whose sequences lie on both sides of a splitter is a prefix of that splitter's own sequence.  Such nodes, a path
a splitter, are given out in parts, which are added up; all others are whole in one partition.  Ids of conversations
that end at such a node stream through one hash in order, in chunks.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small, partitions
from .language_model import CRC32_SQL

DIGEST = 16
PART = 200_000  # turns and conversations of a merged partition, about
SAMPLE = 20  # sampled sequences a partition
RUN = 16 << 20  # bytes of digests in a sorted run
CHUNK = 1 << 16  # conversation ids in a chunk
WORD = r"[^\x20\x09-\x0D]+"
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
BLOCKS = "part int, run long, conv binary, size binary, lcp binary, tails binary, words binary"
MERGED = (
    "kind string, node long, parent_node long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, words long, ends_sha256 string, part long, place long, ids binary"
)
EMPTY = hashlib.sha256().hexdigest()


# --- sequences ---------------------------------------------------------------------------------------------------


def turns(table: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns as (key, words) in order; rows without a conv_id take no part.

    Turns are ordered by number, null first; turns of one number by their digests, so the order of rows is of no account.
    Repeated rows are repeated turns.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    each = table.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").alias("turn"), key.alias("key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")).alias("one")
    )
    listed = each.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))
    return listed.select("conv_id", F.transform("turns", lambda t: F.struct(t["key"].alias("key"), t["words"].alias("words"))).alias("turns"))


def rebuilt(own: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Each conversation with its first h turns taken from the first conversation of its group; h is a checksum modulo ``most``."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    heads = own.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    joined = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).withColumn("h", h).join(heads, "base", "left")
    head = F.when(F.col("head").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("head", F.lit(1), F.col("h")))
    return joined.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(0)))).alias("turns"))


def packed(sequences: DataFrame) -> DataFrame:
    """(conv_id, turns) -> (conv_id, keys, words): the digests one after the other."""
    return sequences.select(
        "conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["key"])), "")).alias("keys"), F.transform("turns", lambda t: t["words"]).alias("words")
    )


# --- runs --------------------------------------------------------------------------------------------------------


def shared(x: bytes, y: bytes, known: int = 0) -> int:
    """Number of first turns that two sequences share, of which ``known`` are known to be shared."""
    end = min(len(x), len(y))
    at = known * DIGEST
    if x[at:end] == y[at:end]:
        return end // DIGEST
    while x[at : at + DIGEST] == y[at : at + DIGEST]:
        at += DIGEST
    return at // DIGEST


def _blocks(items: list[tuple[bytes, int, np.ndarray]], run: int, cuts: list[tuple[bytes, int]]) -> Iterator[pa.RecordBatch]:
    """A sorted run with its LCPs, front-coded and cut at the splitters."""
    items.sort(key=lambda x: x[:2])
    edges = [0, *(bisect_right(items, cut, key=lambda x: x[:2]) for cut in cuts), len(items)]
    rows = []
    for part, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        if a == b:
            continue
        lcp, tails, words = [], [], []
        before = b""
        for keys, _, own in items[a:b]:
            n = shared(before, keys)
            lcp.append(n)
            tails.append(keys[n * DIGEST :])
            words.append(own[n:])
            before = keys
        size = np.array([len(x[0]) // DIGEST for x in items[a:b]], np.int64)
        conv = np.array([x[1] for x in items[a:b]], np.int64)
        packed = (conv.tobytes(), size.tobytes(), np.array(lcp, np.int64).tobytes(), b"".join(tails), np.concatenate(words).astype(np.int64).tobytes())
        rows.append((part, run, *packed))
    columns = list(zip(*rows, strict=True))
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in BLOCKS.split(", ")])


def _runs(cuts: list[tuple[bytes, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        items, held = [], 0
        for batch in batches:
            for conv, keys, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                items.append((keys, conv, words.values.to_numpy(zero_copy_only=False)))
                held += len(keys) + DIGEST
                if held > RUN:
                    yield from _blocks(items, number, cuts)
                    number, items, held = number + 1, [], 0
        if items:
            yield from _blocks(items, number, cuts)

    return run


def _read(block: dict) -> Iterator[tuple[bytes, int, int, np.ndarray]]:
    """The sequences of a block: (keys, conv_id, LCP with the one before, words of the turns after the LCP)."""
    conv, size, lcp, words = (np.frombuffer(block[c], np.int64) for c in ("conv", "size", "lcp", "words"))
    tails, at, keys = block["tails"], 0, b""
    for c, n, low in zip(conv.tolist(), size.tolist(), lcp.tolist(), strict=True):
        more = n - low
        keys = keys[: low * DIGEST] + tails[at * DIGEST : (at + more) * DIGEST]
        yield keys, c, low, words[at : at + more]
        at += more


class LoserTree:
    """Merges sorted runs of (keys, conv_id, lcp, words); gives (keys, conv_id, lcp, words) where lcp is with the one given before.

    Each inner node keeps the loser of the match played there and that loser's LCP with the winner that passed.  A head that
    shares more turns with the last one given than another is the smaller one, with no turn compared; where both share
    equally many, turns are compared from there on.  ``compared`` counts these comparisons of turns.
    """

    def __init__(self, runs: list[Iterator[tuple[bytes, int, int, np.ndarray]]]):
        self.runs = runs
        self.k = max(1, len(runs))
        self.head = [next(r, None) for r in runs] + [None] * (self.k - len(runs))
        self.lcp = [0 if h else -1 for h in self.head]
        self.node = [-1] * self.k
        self.compared = 0
        self.top = self._play(1)

    def _match(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two runs' heads; the loser's LCP becomes that with the winner."""
        la, lb = self.lcp[a], self.lcp[b]
        if la != lb:
            return (a, b) if la > lb else (b, a)
        if la < 0:
            return a, b
        x, y = self.head[a], self.head[b]
        n = shared(x[0], y[0], la)
        self.compared += n - la + 1
        rest = n * DIGEST
        first = (x[0][rest : rest + DIGEST], x[1]) < (y[0][rest : rest + DIGEST], y[1])
        winner, loser = (a, b) if first else (b, a)
        self.lcp[loser] = n
        return winner, loser

    def _play(self, at: int) -> int:
        if at >= self.k:
            return at - self.k
        winner, self.node[at] = self._match(self._play(2 * at), self._play(2 * at + 1))
        return winner

    def __iter__(self) -> Iterator[tuple[bytes, int, int, np.ndarray]]:
        while self.lcp[self.top] >= 0:
            w = self.top
            keys, conv, _, words = self.head[w]
            yield keys, conv, self.lcp[w], words
            self.head[w] = next(self.runs[w], None)
            self.lcp[w] = self.head[w][2] if self.head[w] else -1
            at = (w + self.k) // 2
            while at:
                w, self.node[at] = self._match(w, self.node[at])
                at //= 2
            self.top = w


# --- open paths --------------------------------------------------------------------------------------------------


class Node:
    __slots__ = ("n", "least", "children", "leaves", "saved", "words", "sha", "shared", "rows", "chunk", "place")

    def __init__(self, words: int, number: int):
        self.n = self.children = self.leaves = self.saved = self.place = 0
        self.least: int | None = None
        self.words, self.shared = words, number  # shared: number of a node that may lie in several partitions, or -1
        self.sha = None
        self.rows: list[int] = []
        self.chunk: list[int] = []


class Paths:
    """The stack of open nodes of one partition, and the rows of finished ones."""

    def __init__(self, part: int, low: tuple[bytes, list[int]], high: tuple[bytes, list[int]]):
        self.part, self.edges = part, [low, high]
        self.rows: list[list] = []
        self.stack = [Node(0, 0)]  # the root may always lie in several partitions

    def add(self, keys: bytes, conv: int, lcp: int, words: list[int]) -> None:
        """The next sequence in order; words are those of its turns after the first ``lcp``."""
        while len(self.stack) > lcp + 1:
            self._finish()
        size = len(keys) // DIGEST
        ids: list[int] = [0]
        for edge, numbers in self.edges:
            n = shared(edge, keys)
            if n + 1 > len(ids):
                ids = numbers[: n + 1]
        for depth in range(lcp + 1, size + 1):
            self.stack.append(Node(words[depth - lcp - 1], ids[depth] if depth < len(ids) else -1))
        top = self.stack[-1]
        top.n += 1
        top.least = conv if top.least is None else min(top.least, conv)
        if top.shared >= 0:
            top.chunk.append(conv)
            if len(top.chunk) == CHUNK:
                self._ends(top)
        elif top.sha is None:
            top.sha = hashlib.sha256(b"%d" % conv)
        else:
            top.sha.update(b",%d" % conv)

    def _ends(self, x: Node) -> None:
        self.rows.append(["ends", x.shared, None, None, None, None, None, None, None, None, None, None, self.part, x.place, np.array(x.chunk, np.int64).tobytes()])
        x.place += 1
        x.chunk = []

    def _finish(self) -> None:
        x, depth = self.stack.pop(), len(self.stack)
        if x.shared >= 0:  # a part of a node: its children here are whole, the rest is added later
            if x.chunk:
                self._ends(x)
            for row in x.rows:
                self.rows[row][2] = x.shared
            self.rows.append(["part", x.shared, None, x.least, depth, None, x.n, x.children, x.leaves, x.saved, x.words, None, None, None, None])
            return
        leaves = x.leaves if x.children else 1
        saved = x.saved + (x.n - 1) * x.words
        for row in x.rows:
            self.rows[row][5] = x.least
        up = self.stack[-1]
        up.n += x.n
        up.least = x.least if up.least is None else min(up.least, x.least)
        up.children += 1
        up.leaves += leaves
        up.saved += saved
        up.rows.append(len(self.rows))
        self.rows.append(["node", None, None, x.least, depth, None, x.n, x.children, leaves, saved, x.words, x.sha.hexdigest() if x.sha else EMPTY, None, None, None])

    def close(self) -> list[list]:
        while self.stack:
            self._finish()
        return self.rows


def _batch(rows: list[list], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)], [name for name, _ in fields])


def _merge(cuts: list[tuple[bytes, int]], numbers: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = (row for batch in batches for i in range(batch.num_rows) for row in batch.slice(i, 1).to_pylist())
        for part, own in groupby(blocks, key=lambda b: b["part"]):
            edge = [(cuts[i][0], numbers[i]) if 0 <= i < len(cuts) else (b"", [0]) for i in (part - 1, part)]
            paths = Paths(part, *edge)
            path_words: list[int] = []
            for keys, conv, lcp, words in LoserTree([_read(b) for b in own]):  # a block a run
                # words come after the run's own LCP, which is at most the merged one: what the merge shares is known
                size = len(keys) // DIGEST
                del path_words[size - len(words) :]
                path_words.extend(words.tolist())
                paths.add(keys, conv, lcp, path_words[lcp:])
            rows = paths.close()
            for i in range(0, len(rows), 20_000):
                yield _batch(rows[i : i + 20_000], MERGED)

    return run


# --- the nodes on splitters --------------------------------------------------------------------------------------


def _numbered(cuts: list[tuple[bytes, int]]) -> tuple[list[list[int]], list[int]]:
    """Numbers of the nodes on each splitter's path, in preorder, and each number's parent; 0 is the root."""
    numbers, parents, before, path = [], [-1], b"", [0]
    for keys, _ in cuts:
        path = path[: shared(before, keys) + 1]
        while len(path) <= len(keys) // DIGEST:
            parents.append(path[-1])
            path.append(len(parents) - 1)
        numbers.append(list(path))
        before = keys
    return numbers, parents


def _fold(parents: list[int]):
    """Whole nodes from the parts' sums: a row a node on a splitter, however many rows the table has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {r["node"]: r for batch in batches for r in batch.to_pylist()}
        for number in sorted(own, reverse=True):  # children have larger numbers
            x = own[number]
            x["n_leaves"] = x["n_leaves"] if x["n_children"] else 1
            x["saved_tokens"] += (x["n_convs"] - 1) * x["words"]
            if (up := own.get(parents[number])) is not None:
                up["conv_id"] = x["conv_id"] if up["conv_id"] is None else min(up["conv_id"], x["conv_id"])
                up["n_children"] += 1
                for c in ("n_convs", "n_leaves", "saved_tokens"):
                    up[c] += x[c]
        for x in own.values():
            x["parent_conv_id"] = own[parents[x["node"]]]["conv_id"] if x["node"] else None
        if own:
            yield _batch([[x[c.split()[0]] for c in FOLDED.split(", ")] for x in own.values()], FOLDED)

    return run


FOLDED = "node long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, part, place, ids) in order -> (node, ends_sha256); holds one chunk."""
    node, sha = None, None
    for batch in batches:
        done = []
        for row in batch.to_pylist():
            text = ",".join(map(str, np.frombuffer(row["ids"], np.int64).tolist())).encode()
            if row["node"] == node:
                sha.update(b"," + text)
            else:
                if node is not None:
                    done.append([node, sha.hexdigest()])
                node, sha = row["node"], hashlib.sha256(text)
        yield _batch(done, "node long, ends_sha256 string")
    if node is not None:
        yield _batch([[node, sha.hexdigest()]], "node long, ends_sha256 string")


# --- the trie ----------------------------------------------------------------------------------------------------


def prefix_trie(sequences: DataFrame, part: int = PART) -> DataFrame:
    """(conv_id, turns array<struct<key binary, words long>>) -> a row for each distinct prefix.

    conv_id, the smallest member; depth; parent_conv_id, null for the root; n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256, the hash of the ids that end there.  Conversations without turns are members of the root; equal ones share
    all their nodes; an empty table has no node, not even the root.  A conversation's digests (16 bytes a turn) are one
    value in a task; conversations as such, equal ones and those of one prefix too, are split over partitions.
    """
    spark = sequences.sparkSession
    scratch = Scratch(spark, "trie")
    held = scratch.table(packed(sequences), "sequences")
    total, size = held.agg(F.count("*"), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
    parts = max(1, -(-(total + size) // part), min(partitions(spark), (total + size) // 1000))
    cuts: list[tuple[bytes, int]] = []
    if parts > 1:  # a bounded sample a partition
        rows = held.orderBy(F.xxhash64("conv_id")).limit(SAMPLE * parts).select("keys", "conv_id").collect()
        sample = sorted((bytes(r["keys"]), r["conv_id"]) for r in rows)
        cuts = [sample[len(sample) * i // parts] for i in range(1, parts)]
    numbers, parents = _numbered(cuts)
    blocks = held.mapInArrow(_runs(cuts), BLOCKS)
    dealt = blocks.repartitionById(parts, "part").sortWithinPartitions("part", "run")
    merged = scratch.table(dealt.mapInArrow(_merge(cuts, numbers), MERGED), "merged")
    scratch.drop("sequences")
    sums = (
        merged.where("kind = 'part'")
        .groupBy("node")
        .agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.max("words").alias("words"))
    )
    folded = sums.coalesce(1).mapInArrow(_fold(parents), FOLDED)
    ends = merged.where("kind = 'ends'").select("node", "part", "place", "ids").repartition("node").sortWithinPartitions("node", "part", "place").mapInArrow(_hash_ends, "node long, ends_sha256 string")
    open_nodes = scratch.table(folded.join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY))), "open")
    up = broadcast_if_small(open_nodes.select(F.col("node").alias("parent_node"), F.col("conv_id").alias("open_parent")))
    inner = merged.where("kind = 'node'").join(up, "parent_node", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "open_parent"))
    return inner.select(*RESULT).union(open_nodes.select(*RESULT))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, null roles and texts as empty, its first turns taken from its group's first conversation."""
    return prefix_trie(rebuilt(turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


OP13_SQL = rf"""
WITH turn AS (SELECT conv_id, turn, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(t ORDER BY turn NULLS FIRST) AS ts, ({CRC32_SQL.replace("doc_id", "conv_id")} % 4)::INT AS h FROM turn GROUP BY conv_id),
seq AS (SELECT o.conv_id, list_concat(coalesce(b.ts[1:o.h], []), o.ts[o.h + 1:]) AS ts FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20),
member AS (SELECT conv_id, ts[1:d] AS path, d, d = len(ts) AS ends FROM (SELECT *, unnest(range(0, len(ts) + 1)) AS d FROM seq)),
node AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ended,
           CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(path[d].text, '[^\x20\x09-\x0D]+')) END AS words FROM member GROUP BY path, d),
child AS (SELECT path[1:d - 1] AS path, count(*) AS children FROM node WHERE d > 0 GROUP BY 1),
full_node AS (SELECT node.*, coalesce(children, 0) AS children FROM node LEFT JOIN child USING (path)),
below AS (SELECT path[1:e] AS path, sum(leaf) AS leaves, sum(saved) AS saved
          FROM (SELECT path, (children = 0)::INT AS leaf, (n - 1) * words AS saved, unnest(range(0, d + 1)) AS e FROM full_node) GROUP BY 1)
SELECT x.conv_id, x.d AS depth, p.conv_id AS parent_conv_id, x.n AS n_convs, x.children AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(x.ended) AS ends_sha256
FROM full_node x JOIN below USING (path) LEFT JOIN node p ON x.d > 0 AND p.path = x.path[1:x.d - 1]
"""

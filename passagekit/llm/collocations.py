"""Collocations by pivot partitioning, as in MG-FSM: each phrase is mined where its rarest word is.

Blocks of text become numbers of a dictionary of their own, the dictionaries are counted in Spark, and each block gets the
numbers of its frequent words by a join; so no task needs the whole vocabulary.  Numbers follow falling frequency, hence
the rarest word of a phrase, its pivot, is its largest number.  Around each occurrence of a frequent word the fragment is
kept in which that word is the pivot: up to four words each way, none rarer than it.  Equal fragments of a block are
counted once, and fragments are routed to their pivot's bucket.  There phrases that hold the pivot grow word by word from
those that are frequent, and only these are given out: a phrase is counted at the leftmost occurrence of its rarest word,
so every occurrence of every phrase is counted exactly once, in one bucket.

A very frequent pivot is split over several buckets by its fragments' contents; the counts of its phrases are parts, and
are added up before they are compared with the bound.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small, documents, partitions, slices
from .textkit import mix, words

MOST = 5  # words of a phrase
LEAST = 100  # occurrences of a phrase
TOP = 2000
BLOCK = 16 << 20  # bytes of text in a block
BUCKET = 500_000  # occurrences of pivots in a bucket, about
SLICE = 600_000  # words of a block whose fragments a task holds at a time
TASKS = 20_000
SIDE = MOST - 1
WIDTH = 2 * SIDE + 1
BLANK = np.zeros(256, bool)
BLANK[[9, 32]] = True
STOP = np.zeros(256, bool)
STOP[[*range(10, 14), *b".,;:!?"]] = True
BLOCKS = "block long, lang string, total long, tokens binary, words array<string>, counts array<long>"
RESULT = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def pack(x: np.ndarray) -> bytes:
    """An array of 32-bit numbers by the planes of their bytes, compressed: small numbers cost little."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(x.astype("<i4").reshape(-1).view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack(raw: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(4, -1).T).view("<i4").reshape(-1)


# --- blocks and their dictionaries -------------------------------------------------------------------------------


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The words at these places of a slice, which may be larger than a string array can hold."""
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)])
    flat = data[np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)]
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat))


class Block:
    """Words of some slices of text, by language, until they are given out."""

    def __init__(self) -> None:
        self.langs: dict[str, int] = {}
        self.salt: list[int] = []
        self.clear()

    def clear(self) -> None:
        self.key, self.text, self.count, self.of = [], [], [], []  # of the slices' distinct words
        self.token, self.opens, self.lang = [], [], []  # of each word: its key, whether a piece opens, its language
        self.bytes = 0

    def add(self, langs: list[str], column: pa.Array) -> None:
        for lang in langs:
            if lang not in self.langs:
                self.langs[lang] = len(self.langs)
                self.salt.append(int.from_bytes(hashlib.md5(lang.encode()).digest()[:8], "little"))
        w = words(column, lower=True, breaks=BLANK | STOP)
        self.bytes += len(w.data)
        if not len(w.start):
            return
        code = np.array([self.langs[x] for x in langs], np.int64)[w.doc]
        stops = np.concatenate([[0], np.cumsum(STOP[w.data])])[w.start]
        opens = np.ones(len(w.start), bool)
        opens[1:] = (stops[1:] != stops[:-1]) | (w.doc[1:] != w.doc[:-1])
        key = mix(w.hash + np.array(self.salt, np.uint64)[code])
        own, first, count = np.unique(key, return_index=True, return_counts=True)
        self.key.append(own)
        self.text.append(_strings(w.data, w.start[first], w.end[first]))
        self.count.append(count)
        self.of.append(code[first])
        self.token.append(key)
        self.opens.append(opens)
        self.lang.append(code)

    def rows(self) -> Iterator[tuple[str, int, bytes, pa.Array, np.ndarray]]:
        """A language at a time: (language, words, packed numbers with 0 before each piece, dictionary, counts)."""
        if not self.key:
            return
        own, first, inverse = np.unique(np.concatenate(self.key), return_index=True, return_inverse=True)
        counts = np.bincount(inverse, np.concatenate(self.count)).astype(np.int64)
        of = np.concatenate(self.of)[first]
        text = pa.chunked_array(self.text).combine_chunks()
        order = np.lexsort((-counts, of))  # by language, frequent words first
        place = np.empty(len(own), np.int64)
        place[order] = np.arange(len(own))
        lang = np.concatenate(self.lang)
        by = np.argsort(lang, kind="stable")
        token, opens = place[np.searchsorted(own, np.concatenate(self.token))][by], np.concatenate(self.opens)[by]
        names = list(self.langs)
        used = np.unique(of)
        dictionary, tokens = np.searchsorted(of[order], used), np.searchsorted(lang[by], used)
        for i, code in enumerate(used.tolist()):
            a, b = dictionary[i], dictionary[i + 1] if i + 1 < len(used) else len(own)
            c, d = tokens[i], tokens[i + 1] if i + 1 < len(used) else len(token)
            stream = np.zeros(d - c + int(opens[c:d].sum()), np.int64)
            stream[np.arange(d - c) + np.cumsum(opens[c:d])] = token[c:d] - a + 1
            # a piece's first word opens it, so the stream begins with 0
            yield names[code], int(d - c), pack(stream), text.take(pa.array(first[order[a:b]])), counts[order[a:b]]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    block = Block()

    def give() -> Iterator[pa.RecordBatch]:
        nonlocal number
        for lang, total, tokens, dictionary, counts in block.rows():
            number += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([lang]), pa.array([total]), pa.array([tokens], pa.binary()), pa.array([dictionary.cast(pa.string()).to_pylist()], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64()))],
                [x.split()[0] for x in BLOCKS.split(", ")],
            )
        block.clear()

    for batch in batches:
        for part in slices(batch, limit=4 << 20):
            block.add(part.column(0).to_pylist(), part.column(1))
            if block.bytes > BLOCK:
                yield from give()
    yield from give()


# --- fragments ---------------------------------------------------------------------------------------------------


def fragments(ids: np.ndarray, start: int = 0, stop: int | None = None) -> np.ndarray:
    """A row for each word, of those from ``start`` to ``stop``, that is the rarest beside a neighbour: the words around it,
    itself in the middle, 0 where a word is rarer, infrequent or of another piece.  Equal words may stand right of the
    pivot only."""
    wide = np.concatenate([np.zeros(SIDE, ids.dtype), ids, np.zeros(SIDE, ids.dtype)])
    at = np.flatnonzero(ids[start:stop] > 0) + start
    pivot = ids[at]
    out = np.zeros((len(at), WIDTH), np.int32)
    out[:, SIDE] = pivot
    for step in (-1, 1):
        open_ = np.ones(len(at), bool)
        for k in range(1, SIDE + 1):
            near = wide[at + SIDE + step * k]
            open_ &= (near > 0) & (near < pivot if step < 0 else near <= pivot)
            out[:, SIDE + step * k] = np.where(open_, near, 0)
    return out[(out[:, SIDE - 1] > 0) | (out[:, SIDE + 1] > 0)]


def counted(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows, their hashes and how often each occurs."""
    h = np.zeros(len(rows), np.uint64)
    for c in range(rows.shape[1]):
        h = mix(h + rows[:, c].astype(np.uint64) + np.uint64(c + 1))
    order = np.argsort(h, kind="stable")
    rows, h = rows[order], h[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    at = np.flatnonzero(new)
    return rows[at], h[at], np.diff(np.append(at, len(rows)))


def _routed(frag: np.ndarray, h: np.ndarray, count: np.ndarray, buckets: int, parts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each bucket that gets fragments."""
    if not len(frag):
        return
    pivot = frag[:, SIDE].astype(np.int64)
    salt = np.zeros(len(frag), np.uint64)
    hot = pivot <= len(parts)
    salt[hot] = (h[hot] >> np.uint64(20)) % parts[pivot[hot] - 1].astype(np.uint64)
    bucket = (mix(pivot.astype(np.uint64) + (salt << np.uint64(40))) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((pivot, bucket))
    table = np.column_stack([frag, count.astype(np.int32)])[order]
    bucket = bucket[order]
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(starts[1:], len(bucket))
    yield pa.RecordBatch.from_arrays([pa.array(bucket[starts], pa.int32()), pa.array([pack(table[a:b].T) for a, b in zip(starts, ends, strict=True)], pa.binary())], ["bucket", "fragments"])


def _route(buckets: int, parts: np.ndarray):
    """parts: into how many buckets the pivots 1, 2, ... are split; the others are whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in ("tokens", "size", "ids")}
                known = row["ids"].values.flatten()
                number = np.zeros(row["size"].as_py() + 1, np.int32)
                number[known[0].to_numpy() + 1] = known[1].to_numpy()
                ids = number[unpack(row["tokens"].as_py())]
                for start in range(0, len(ids), SLICE):
                    yield from _routed(*counted(fragments(ids, start, start + SLICE)), buckets, parts)

    return run


# --- mining ------------------------------------------------------------------------------------------------------


def mine(frag: np.ndarray, weight: np.ndarray, least: int, split: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Phrases that hold their fragments' pivots, length by length: (words of each, occurrences).

    A phrase longer by one word is looked at only where the shorter one with the pivot is frequent.  Phrases of pivots up to
    ``split`` are parts of phrases, and all are kept.
    """
    _, one = np.unique(frag[:, SIDE], return_inverse=True)
    known: dict[int, np.ndarray] = {SIDE: one.astype(np.int64)}  # by the column of the first word: number of the phrase there, or -1
    table = np.unique(frag[:, SIDE])[:, None]
    for size in range(2, MOST + 1):
        grown: dict[int, np.ndarray] = {}
        tables, totals, base = [], [], 0
        # the pivot stands last, and the phrase grows to the left; or it grows to the right
        for left, firsts in ((True, [SIDE + 1 - size]), (False, list(range(SIDE + 2 - size, SIDE + 1)))):
            keys, rows, place = [], [], []
            for s in firsts:
                short, word = (known.get(s + 1), frag[:, s]) if left else (known.get(s), frag[:, s + size - 1])
                if short is None:
                    continue
                at = np.flatnonzero((short >= 0) & (word > 0))
                keys.append(short[at] << 32 | word[at])
                rows.append(at)
                place.append(s)
            if not keys or not sum(map(len, keys)):
                continue
            own, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(inverse, weight[np.concatenate(rows)]).astype(np.int64)
            short, word = table[own >> 32], (own & 0xFFFFFFFF).astype(np.int32)[:, None]
            phrase = np.hstack([word, short] if left else [short, word])
            keep = (total >= least) | (phrase.max(axis=1) <= split)
            number = np.where(keep, base + np.cumsum(keep) - 1, -1)
            start = 0
            for s, at in zip(place, rows, strict=True):
                col = np.full(len(frag), -1, np.int64)
                col[at] = number[inverse[start : start + len(at)]]
                start += len(at)
                grown[s] = col
            tables.append(phrase[keep])
            totals.append(total[keep])
            base += int(keep.sum())
        if not base:
            return
        table, known = np.vstack(tables), grown
        yield table, np.concatenate(totals)


def _mine(least: int, split: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((b, raw) for batch in batches for b, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for _, own in groupby(rows, key=lambda r: r[0]):
            all_ = np.hstack([unpack(raw).reshape(WIDTH + 1, -1) for _, raw in own])
            for phrase, total in mine(np.ascontiguousarray(all_[:WIDTH].T), all_[WIDTH].astype(np.int64), least, split):
                for at in range(0, len(phrase), 50_000):
                    p, t = phrase[at : at + 50_000], total[at : at + 50_000]
                    grams = pa.ListArray.from_arrays(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32), pa.array(p.reshape(-1), pa.int32()))
                    yield pa.RecordBatch.from_arrays([grams, pa.array(t), pa.array(p.max(axis=1) <= split)], ["gram", "a", "part"])

    return run


# --- the operator ------------------------------------------------------------------------------------------------


def phrases(docs: DataFrame, scratch: Scratch, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, text) -> frequent phrases (gram array<int>, a); frequent words (id, lang, word, f); totals (lang, n)."""
    spark = docs.sparkSession
    blocks = scratch.table(docs.select("lang", "text").mapInArrow(_blocks, BLOCKS), "blocks")
    totals = scratch.table(blocks.groupBy("lang").agg(F.sum("total").alias("n")), "totals")
    entries = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "entry")).select("block", "lang", "place", "entry.words", "entry.counts")
    frequent = entries.groupBy("lang", "words").agg(F.sum("counts").alias("f")).where(F.col("f") >= least)
    order = [F.desc("f"), F.col("lang"), F.col("words")]
    ranged = scratch.table(frequent.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "ranged")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("rows"), F.min("at").alias("first"))  # a row a range
    before = sizes.select("part", "first", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    known = scratch.table(ranged.join(F.broadcast(before), "part").select((F.col("before") + F.col("at") - F.col("first") + 1).alias("id"), "lang", F.col("words").alias("word"), "f"), "words")
    n_known, occurrences = known.agg(F.count("*"), F.coalesce(F.sum("f"), F.lit(0))).first()
    if n_known >= 1 << 31:
        raise ValueError("more frequent words than 31 bits can number")
    buckets = max(partitions(spark), -(-occurrences // BUCKET))
    bound = max(1000, -(-occurrences // (2 * buckets)))
    hot = known.where(F.col("f") > bound).orderBy("id").select("f").collect()  # at most two rows a bucket
    parts = np.array([-(-r["f"] // bound) for r in hot], np.int64)
    # every entry is looked up; infrequent ones get no number
    looked = entries.select("block", "lang", "place", F.col("words").alias("word")).join(broadcast_if_small(known.select("id", "lang", "word")), ["lang", "word"], "left")
    number = F.when(F.col("id").isNotNull(), F.struct(F.col("place"), F.col("id").cast("int").alias("id")))
    numbers = looked.groupBy("block").agg(F.collect_list(number).alias("ids"))
    placed = blocks.select("block", "tokens", F.size("words").alias("size")).join(numbers, "block").select("tokens", "size", "ids")
    routed = placed.mapInArrow(_route(buckets, parts), "bucket int, fragments binary")
    dealt = routed.repartitionById(min(buckets, TASKS), "bucket").sortWithinPartitions("bucket")
    mined = scratch.table(dealt.mapInArrow(_mine(least, len(parts)), "gram array<int>, a long, part boolean"), "mined")
    added = mined.where("part").groupBy("gram").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    found = scratch.table(mined.where("NOT part").select("gram", "a").union(added), "phrases")
    for name in ("blocks", "ranged", "mined"):
        scratch.drop(name)
    return found, known, totals


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, text) -> each language's ``top`` collocations, in the contract's columns.

    Null texts have no words, null languages are ``und``; repeated rows count again; texts of any length are read whole.
    A language without a frequent phrase has no row, and an empty table none.
    """
    scratch = Scratch(docs.sparkSession, "collocations")
    found, known, totals = phrases(docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")), scratch, least)
    parts = found.select("gram", F.col("a").alias("f"), F.lit(None).cast("string").alias("lang")).union(known.select(F.array(F.col("id").cast("int")), "f", "lang"))
    longer = found.where(F.size("gram") > 2).select(F.explode(F.array(F.expr("slice(gram, 1, size(gram) - 1)"), F.expr("slice(gram, 2, size(gram) - 1)"))).alias("gram"), F.col("a").alias("longer"))
    longer = longer.groupBy("gram").agg(F.max("longer").alias("longer"))
    # a phrase of as many occurrences holds another one word shorter that has as many too, so one word more is enough
    kept = found.join(longer, "gram", "left").where("longer IS NULL OR longer < a").drop("longer")
    cut = kept.select("gram", "a", F.explode(F.expr("sequence(1, size(gram) - 1)")).alias("k"))
    cut = cut.select("gram", "a", "k", F.expr("slice(gram, 1, k)").alias("head"), F.expr("slice(gram, k + 1, size(gram))").alias("tail"))
    cut = cut.join(parts.select(F.col("gram").alias("head"), F.col("f").alias("l"), "lang"), "head").join(parts.select(F.col("gram").alias("tail"), F.col("f").alias("r")), "tail")
    cuts = cut.groupBy("gram", "a").agg(F.max("lang").alias("lang"), F.collect_list(F.struct("k", "l", "r")).alias("cuts"))
    exact = "CAST({} AS DECIMAL(38, 0))".format
    score = f"({exact(1000)} * {exact('a')} * {exact('n')}) div ({exact('c.l')} * {exact('c.r')})"
    best = cuts.join(totals, "lang").withColumn("best", F.expr(f"array_min(transform(cuts, c -> struct({score} AS score, c.k AS k, c.l AS l, c.r AS r)))"))
    best = best.select("lang", "gram", "a", "n", "best.score", "best.l", "best.r")
    by_lang = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    best = scratch.table(best.withColumn("place", F.rank().over(by_lang)).where(F.col("place") <= top).drop("place"), "best")  # ties stay
    word = best.select("gram", F.posexplode("gram").alias("at", "id")).join(known.select(F.col("id").cast("int").alias("id"), "word"), "id")
    phrase = word.groupBy("gram").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")
    return best.join(phrase, "gram").withColumn("rank", rank).where(F.col("rank") <= top).select(*RESULT)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir, "lang", "text"))


OP11_SQL = rf"""
WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
ws AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM ws GROUP BY lang),
gram AS (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
         FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM ws, range(1, {MOST + 1}) AS s(size))),
f AS (SELECT lang, size, phrase, count(*) AS a FROM gram GROUP BY ALL HAVING count(*) >= {LEAST}),
candidate AS (SELECT x.*, string_split(phrase, ' ') AS w FROM f x WHERE size >= 2
              AND NOT EXISTS (SELECT 1 FROM f y WHERE y.lang = x.lang AND y.size > x.size AND 100 * y.a >= 100 * x.a AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' '))),
cut AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, size)) AS k FROM candidate)),
scored AS (SELECT c.lang, c.phrase, c.a, k, h.a AS l, t.a AS r, n, ((1000::HUGEINT * c.a * n) // (h.a::HUGEINT * t.a))::BIGINT AS score
           FROM cut c JOIN f h ON h.lang = c.lang AND h.phrase = head JOIN f t ON t.lang = c.lang AND t.phrase = tail JOIN n ON n.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score FROM best QUALIFY rank <= {TOP}
"""

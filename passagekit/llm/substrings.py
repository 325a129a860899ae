"""Substring deduplication by level-wise doubling of word windows.

Levels have lengths that double up to the window's.  On each level short of the last, of the short windows inside each
full window only the one with the smallest hash is looked at: two equal full windows choose equal short windows, so no
repeat is lost, and a few hundredths of the positions remain.  Only full windows whose short window repeats in another
document go on to twice the length, until the window is reached or no candidates survive; only full windows that repeat
are removed.  Windows are compared by two 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import Scratch, clean, documents, map_batches, slices
from .textkit import Words, mix, words

WINDOW = 50
LEAST = 20  # words of the shortest level, at least
KEY = ["doc_id", "d1"]  # a row: its id and a hash of its words, for tables that repeat an id
DIGEST = "__words__"  # stands beside columns of any name
HITS = "h long, g long, doc_id long, d1 long, pos int"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def sequence_digests(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each row's word sequence."""
    out = []
    place = np.arange(len(w.hash), dtype=np.uint64) - w.first[w.doc].astype(np.uint64)
    for salt in (0x2545F491, 0x4F6CDD1D):
        sums = np.zeros(len(w.hash) + 1, np.uint64)
        np.cumsum(mix(w.hash ^ mix(place + np.uint64(salt))), out=sums[1:])
        out.append((sums[w.first[1:]] - sums[w.first[:-1]] + np.diff(w.first).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The minimum of each n neighbours."""
    have = 1
    while have < n:
        step = min(have, n - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def levels(window: int) -> list[int]:
    """Lengths that double up to the window: 25, 50 for 50; 25, 50, 100, 200 for 200."""
    out = [window]
    while out[0] >= 2 * LEAST:
        out.insert(0, (out[0] + 1) // 2)
    return out


def anchors(w: Words, window: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each full window: the smallest hash of a window of ``length`` words in it; and whether the full window is of one row."""
    hashes, _ = w.windows(length)
    n = len(w.hash) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    return sliding_min(hashes, window - length + 1)[:n], w.doc[:n] == w.doc[window - 1 :]


def joined(w: Words, row: int, keep: np.ndarray | None = None) -> bytes:
    """The kept words of a row, with one space between."""
    a, b = w.first[row], w.first[row + 1]
    start, end = w.start[a:b], w.end[a:b]
    if keep is not None:
        start, end = start[keep], end[keep]
    data = w.data.data
    return b" ".join(data[s:e] for s, e in zip(start.tolist(), end.tolist(), strict=True))


def _profile(window: int, length: int):
    """(doc_id, text) -> a row's words, the hash it has if nothing goes, and its distinct anchors."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch):
            w = words(part.column(1))
            d1, d2 = sequence_digests(w)
            low, one = anchors(w, window, length)
            low, row = low[one].view(np.int64), w.doc[: len(low)][one]
            new = np.ones(len(low), bool)
            new[1:] = (low[1:] != low[:-1]) | (row[1:] != row[:-1])
            low, row = low[new], row[new]
            at = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(d1),
                    pa.array(d2),
                    pa.array(np.diff(w.first), pa.int64()),
                    pa.array([hashlib.sha256(joined(w, i)).hexdigest() for i in range(part.num_rows)]),
                    pa.ListArray.from_arrays(pa.array(at), pa.array(low)),
                ],
                ["doc_id", "d1", "d2", "n_words", "all_sha256", "anchors"],
            )

    return run


def _longer(window: int, before: int, length: int):
    """(doc_id, d1, text, found) -> of full windows whose window of the length before is among those found: the windows
    of the next length, each once a row; of the full length all, with their places and a second hash."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch):
            w = words(part.column(2))
            low, one = anchors(w, window, before)
            own, _ = anchors(w, window, length)
            second = w.windows(window, 2)[0] if length == window else None
            row, found = w.doc[: len(low)], part.column(3)
            live = np.zeros(len(low), bool)
            for i in range(part.num_rows):
                a, b = w.first[i], max(w.first[i], w.first[i + 1] - window + 1)
                live[a:b] = np.isin(low[a:b].view(np.int64), found[i].values.to_numpy())
            pos = np.flatnonzero(live & one)
            if length < window:
                pos = pos[np.unique(np.stack([row[pos], own[pos].view(np.int64)]), axis=1, return_index=True)[1]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(own[pos].view(np.int64)),
                    pa.array(second[pos].view(np.int64) if second is not None else np.zeros(len(pos), np.int64)),
                    part.column(0).take(pa.array(row[pos])),
                    part.column(1).take(pa.array(row[pos])),
                    pa.array(pos - w.first[row[pos]], pa.int32()),
                ],
                ["h", "g", "doc_id", "d1", "pos"],
            )

    return run


def _cut(window: int):
    """(doc_id, d1, text, found: starts of windows that go) -> the row's result."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch):
            w = words(part.column(2))
            out = []
            for i in range(part.num_rows):
                n = int(w.first[i + 1] - w.first[i])
                starts = part.column(3)[i].values.to_numpy()
                cover = np.cumsum(np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(starts + window, minlength=n + 1)[: n + 1])[:n] > 0
                out.append((int(cover.sum()), hashlib.sha256(joined(w, i, ~cover)).hexdigest(), joined(w, i, ~cover).decode()))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out]), pa.array([x[2] for x in out], pa.string())],
                ["doc_id", "d1", "n_removed", "kept_sha256", "kept"],
            )

    return run


def _search(df: DataFrame, window: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of (doc_id, text): each row's profile; for each word sequence the smallest id that has it; and what is cut."""
    scratch = Scratch(df.sparkSession, "substrings")
    lengths = levels(window)
    profile = scratch.table(
        map_batches(df, _profile(window, lengths[0]), "doc_id long, d1 long, d2 long, n_words long, all_sha256 string, anchors array<long>"), "profile"
    )
    # What is grouped is written before it is joined, here and below: a join on its own grouping's shuffle could not be
    # split where one passage, or one text, is very common.  Of texts with equal words the smallest id stands for all.
    first = scratch.table(profile.groupBy("d1", "d2").agg(F.min("doc_id").alias("first_id")), "first")
    lead = profile.join(first, ["d1", "d2"]).where("doc_id = first_id")
    hits = scratch.table(lead.select(*KEY, F.explode("anchors").alias("h")), "level-0")
    text = with_digest(df).withColumnRenamed(DIGEST, "d1")
    for nth, (before, length) in enumerate(zip(lengths, lengths[1:], strict=False), 1):
        again = scratch.table(hits.groupBy("h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("h"), f"again-{nth}")
        live = hits.join(again, "h", "left_semi").groupBy(*KEY).agg(F.collect_list("h").alias("found"))
        # only texts with a repeated window go on
        text = scratch.table(text.select(*KEY, "text").join(live, KEY).dropDuplicates(KEY), f"texts-{nth}")
        hits = scratch.table(map_batches(text.select(*KEY, "text", "found"), _longer(window, before, length), HITS), f"level-{nth}")
    if len(lengths) == 1:
        whole = profile.select(*KEY, F.col("anchors").alias("found"))
        text = scratch.table(text.select(*KEY, "text").join(whole, KEY).dropDuplicates(KEY), "texts-1")
        hits = scratch.table(map_batches(text, _longer(window, window, window), HITS), "level-1")
    twice = scratch.table(hits.groupBy("h", "g").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("h", "g", "low"), "twice")
    gone = hits.join(twice, ["h", "g"]).where("doc_id > low").groupBy(*KEY).agg(F.collect_list("pos").alias("found"))
    cut = map_batches(text.select(*KEY, "text").join(gone, KEY).select(*KEY, "text", "found"), _cut(window), "doc_id long, d1 long, n_removed long, kept_sha256 string, kept string")
    return profile.drop("anchors"), first, cut


def repeated_windows(df: DataFrame, window: int = WINDOW) -> DataFrame:
    """Remove the words of each (doc_id, text) that a window covers which also starts in a document of smaller id.

    Returns doc_id, n_words, n_removed and kept_sha256.  Null and empty texts have no words; texts shorter than the
    window lose nothing; a later exact copy of a long enough text loses all; repeats inside one document, or between
    rows of one id, stay.  Repeated rows give repeated results; rows without an id are compared with nothing; an empty
    table gives an empty result.
    """
    profile, first, cut = _search(df, window)
    copy = (F.col("doc_id") > F.col("first_id")) & (F.col("n_words") >= window)
    nothing = hashlib.sha256(b"").hexdigest()
    return (
        profile.join(first, ["d1", "d2"])
        .join(cut.drop("kept"), KEY, "left")
        .select(
            "doc_id",
            "n_words",
            F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(copy, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "all_sha256")).alias("kept_sha256"),
        )
    )


def without_repeats(df: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of df, further columns of any name included, with repeated windows cut from ``text``.

    Texts that lose nothing stay as they are, white space included; others have their kept words with one space
    between; rows that lose all their words go.  Rows without an id are compared with nothing and stay as they are.
    """
    profile, first, cut = _search(df.select(*clean()).where("doc_id IS NOT NULL"), window)
    copies = profile.where(F.col("n_words") >= window).join(first, ["d1", "d2"]).where("doc_id > first_id").select(*KEY, F.lit("").alias("kept")).distinct()
    changed = copies.union(cut.select(*KEY, "kept")).select(F.col("doc_id").alias(f"{DIGEST}id"), F.col("d1").alias(DIGEST), F.col("kept").alias(f"{DIGEST}kept"))
    rows = with_digest(df).withColumn(f"{DIGEST}id", F.col("doc_id").cast("long")).join(changed, [f"{DIGEST}id", DIGEST], "left")
    kept = F.col(f"{DIGEST}kept")
    return rows.where(kept.isNull() | (kept != "")).select(*(F.coalesce(kept, "text").alias("text") if c == "text" else F.col(c) for c in df.columns))


def with_digest(df: DataFrame) -> DataFrame:
    """df and a column DIGEST, a hash of the text's words."""
    place = df.columns.index("text")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch):
            d1 = sequence_digests(words(part.column(place)))[0]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(d1)], [*part.schema.names, DIGEST])

    return map_batches(df, run, StructType([*df.schema.fields, StructField(DIGEST, LongType())]))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_windows(documents(spark, sf_dir).select(*clean()))


OP3_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h
        FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 48))) AS i FROM w)),
low AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
gone AS (SELECT doc_id, i FROM win JOIN low USING (h) WHERE doc_id > m),
tok AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
flag AS (SELECT doc_id, tok.i, word,
                max(CASE WHEN gone.i IS NOT NULL THEN 1 ELSE 0 END)
                  OVER (PARTITION BY doc_id ORDER BY tok.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS removed
         FROM tok LEFT JOIN gone USING (doc_id, i)),
per AS (SELECT doc_id, sum(removed) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE removed = 0) AS kept
        FROM flag GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN per USING (doc_id)
"""

"""The stored index against plain dictionaries; sweeps of intervals; rerankers that fail."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from passagekit.operators import inverted as V
from passagekit.operators import retrieval as R
from passagekit.operators.intervals import merged, within

CHUNK = "chunk_id string, source_id long, text string"


def tokens(text):
    return re.findall(r"[a-z0-9]+", (text or "").lower())


def plain(chunks, queries, k, pool=None):
    """Rows by all scores."""
    held = {c: Counter(tokens(t)) for c, _, t in chunks}
    n, average = len(held), sum(sum(h.values()) for h in held.values()) / max(1, len(held))
    df = Counter(t for h in held.values() for t in h)
    out = []
    for q, text in queries:
        scores = {}
        for c, h in held.items():
            if pool is None or c in pool:
                parts = [w * max(math.log((n - df[t] + 0.5) / (df[t] + 0.5)), 1e-6) * h[t] * 2.2 / (h[t] + 1.2 * (0.25 + 0.75 * sum(h.values()) / average)) for t, w in Counter(tokens(text)).items() if t in h]
                if parts:
                    scores[c] = sum(parts)
        best = sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]
        out += [(q, c, round(s, 6), i + 1) for i, (c, s) in enumerate(best)]
    return sorted(out)


def corpus(seed, sources, prefix=""):
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 3000}"
    rows = [(f"{s}_{i}", s, prefix + " ".join(word() for _ in range(rng.randrange(40)))) for s in sources for i in range(rng.randrange(1, 12))]
    return [*rows, (f"null_{seed}", sources[0], None), (f"empty_{seed}", sources[0], "")]


def found(index, queries, spark, k, pool=None):
    got = V.search(index, V.query_terms(spark.createDataFrame(queries, "query_id long, text string")), k, pool)
    return sorted((r.query_id, r.chunk_id, round(r.score, 6), r["rank"]) for r in got.collect())


def test_search_after_every_change(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "SHARD", 60)  # several lists a term
    monkeypatch.setattr(V, "SEED", 20)
    path = f"{tmp_path}/index"
    queries = [(i, t) for i, (_, _, t) in enumerate(corpus(9, list(range(6)))[::4]) if t] + [(900, "w1 w1 w2 w1 w3"), (901, "nothing here"), (902, "w1")]
    have = corpus(1, list(range(40)))
    V.write_segment(spark.createDataFrame(have, CHUNK), path)
    assert found(V.read_index(spark, path), queries, spark, 7) == plain(have, queries, 7)
    more = corpus(2, list(range(40, 60)))
    V.write_segment(spark.createDataFrame(more, CHUNK), path)
    have += more
    assert found(V.read_index(spark, path), queries, spark, 7) == plain(have, queries, 7)
    V.clear_sources(spark, path, spark.createDataFrame([(3,), (3,), (45,), (10_000,)], "source_id long"))
    have = [x for x in have if x[1] not in (3, 45)]
    assert found(V.read_index(spark, path), queries, spark, 7) == plain(have, queries, 7)
    new = corpus(3, [3, 5, 41], "w1 ")
    V.replace_sources(spark.createDataFrame(new, CHUNK), path, sources=spark.createDataFrame([(6,)], "source_id long"))
    have = [x for x in have if x[1] not in (3, 5, 41, 6)] + new
    pool = {x[0] for x in have if x[1] % 2}
    frame = spark.createDataFrame([(c,) for c in pool], "chunk_id string")
    assert found(V.read_index(spark, path), queries, spark, 5, frame) == plain(have, queries, 5, pool)
    V.merge(spark, path, path + "2")
    for own in (path, path + "2"):
        index = V.read_index(spark, own)
        assert found(index, queries, spark, 7) == plain(have, queries, 7)
        assert index.stats.first()["n"] == len(have)


def test_only_the_new_segment_is_written(spark, tmp_path):
    path = f"{tmp_path}/index"
    stamp = lambda: {str(p): p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet") if p.is_file()}
    V.write_segment(spark.createDataFrame(corpus(1, [1, 2, 3]), CHUNK), path)
    before = stamp()
    V.clear_sources(spark, path, spark.createDataFrame([(2,)], "source_id long"))
    assert not [p for p in stamp().keys() - before.keys() if "/lists/" in p]
    V.write_segment(spark.createDataFrame(corpus(2, [2]), CHUNK), path)
    after = stamp()
    assert before.items() <= after.items() and all(f"seg={n}" in p for p in after.keys() - before.keys() for n in [p.split("seg=")[1][0]])


def test_a_search_reads_the_buckets_of_its_terms(spark, tmp_path):
    path = f"{tmp_path}/index"
    V.write_segment(spark.createDataFrame(corpus(1, list(range(30))), CHUNK), path)
    index = V.read_index(spark, path)
    plans = []
    V.search(index, V.query_terms(spark.createDataFrame([(1, "w1 w2")], "query_id long, text string")), 3, keep=lambda df, name: plans.append(df) or df.sparkSession.createDataFrame(df.collect(), df.schema))
    text = "".join(p._jdf.queryExecution().executedPlan().toString() for p in plans)
    assert re.search(r"PartitionFilters: \[.*bucket#\d+ (IN|=|INSET)", text)


def test_an_empty_index(spark, tmp_path):
    path = f"{tmp_path}/index"
    V.write_segment(spark.createDataFrame([], CHUNK), path)
    V.write_segment(spark.createDataFrame([("a", 1, None)], CHUNK), path)
    index = V.read_index(spark, path)
    assert found(index, [(1, "w1")], spark, 3) == [] and tuple(index.stats.first()) == (1, 0.0)


def test_phrases_of_any_length(spark, tmp_path):
    path = f"{tmp_path}/index"
    rng = random.Random(6)
    rows = [(f"c{i}", i % 5, " ".join(rng.choices(["a", "b", "c"], k=rng.randrange(30)))) for i in range(60)] + [("m", 1, "a machine-learning text, machine learning"), ("n", 2, "learning machine")]
    V.write_segment(spark.createDataFrame(rows, CHUNK), path)
    V.clear_sources(spark, path, spark.createDataFrame([(4,)], "source_id long"))
    asked = [["machine", "learning"], ["a"], ["a", "a"], ["a", "b", "a"], ["b", "b", "b", "b"], ["a", "zzz"]]
    want = []
    for no, terms in enumerate(asked):
        for c, s, text in rows:
            ts = tokens(text)
            n = sum(ts[i : i + len(terms)] == terms for i in range(len(ts)))
            if n and s != 4:
                want.append((0, no, c, n))
    got = V.phrase_hits(V.read_index(spark, path), spark.createDataFrame([(0, i, t) for i, t in enumerate(asked)], "query_id long, phrase_no int, terms array<string>"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_han_words_and_columns(spark, tmp_path):
    path = f"{tmp_path}/index"
    columns = {"content": V.search_tokens, "spoken": lambda t: F.split(F.lit("zzz"), " ")}
    V.write_segment(spark.createDataFrame([("a", 1, "机器 学习 Café 3"), ("b", 2, "学"), ("c", 3, "cafe")], CHUNK), path, columns)
    index = V.read_index(spark, path)
    held = defaultdict(set)
    for r in index.ids(index.entries(index.lists, "col", "term")).collect():
        held[r.col, r.chunk_id].add(r.term)
    assert held["content", "a"] == {"机", "器", "学", "习", "机器", "器学", "学习", "cafe", "3"} and held["spoken", "a"] == {"zzz"}
    ask = lambda t: {r.chunk_id for r in V.search(index, V.query_terms(spark.createDataFrame([(0, t)], "query_id long, text string")), 9).collect()}
    assert ask("学习") == {"a"} and ask("学") == {"a", "b"} and ask("CAFÉ") == {"a", "c"} and ask("zzz") == set()


@pytest.mark.parametrize("cell", [1, 7, 4096])
def test_sweeps(spark, monkeypatch, cell):
    import passagekit.operators.intervals as I

    monkeypatch.setattr(I, "CELL", cell)
    rng = random.Random(3)
    intervals, points = [], [(s, p, f"{s}:{p}") for s in range(5) for p in range(-3, 60)] + [(None, 1, "n"), (1, None, "n"), (1, 5, "again")]
    for s in range(4):
        at = -2
        while at < 55:
            end = at + rng.randrange(9)
            intervals.append((s, at, end, len(intervals)))
            at = end + 1 + rng.randrange(3)
    intervals.append((3, 58, 57, 999))  # holds nothing
    got = within(spark.createDataFrame(points, "source_id long, seq int, name string"), "seq", spark.createDataFrame(intervals, "source_id long, a int, b int, no int"), "a", "b", ["no"])
    want = [(s, p, n, no) for s, p, n in points for t, a, b, no in intervals if s == t and p is not None and a <= p <= b]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    loose = [(s, a, a + rng.randrange(-1, 8)) for s in range(3) for a in rng.choices(range(50), k=12)]
    own = merged(spark.createDataFrame(loose, "source_id long, a int, b int"), "a", "b").collect()
    cover = lambda xs: {(s, p) for s, a, b in xs for p in range(a, b + 1)}
    assert cover(own) == cover(loose) and len(cover(own)) == sum(b - a + 1 for _, a, b in own)


def test_one_source_of_a_million_segments(spark):
    n = 1_000_000
    segments = spark.range(n).select(F.lit(7).cast("long").alias("source_id"), F.col("id").alias("seq"))
    sections = spark.range(n // 50).select(F.lit(7).cast("long").alias("source_id"), (F.col("id") * 50).alias("a"), (F.col("id") * 50 + 39).alias("b"), F.col("id").alias("no"))
    got = within(segments, "seq", sections, "a", "b", ["no"])
    assert got.agg(F.count("*"), F.sum(F.expr("CASE WHEN seq DIV 50 = no AND seq % 50 < 40 THEN 0 ELSE 1 END"))).first()[:] == (n // 50 * 40, 0)
    assert "CartesianProduct" not in (p := got._jdf.queryExecution().executedPlan().toString()) and "Join" not in p


def test_rerankers_that_fail(spark):
    hits = spark.createDataFrame([(q, f"c{i}", i + 1) for q in range(5) for i in range(8)], "query_id long, chunk_id string, rank int")
    queries = spark.createDataFrame([(0, "good"), (1, "boom"), (2, "short"), (3, "nan"), (4, None)], "query_id long, text string")
    chunks = spark.createDataFrame([(f"c{i}", "x" * i) for i in range(8)], "chunk_id string, text string")

    def scorer(question, texts):
        if question == "boom":
            raise RuntimeError("no model")
        if question == "nan":
            return [math.nan] * len(texts)
        return [len(t) // 2 for t in texts][: 3 if question == "short" else None]

    out = R.model_rerank(scorer)(hits, queries, chunks).orderBy("query_id", "rank").collect()
    order = lambda q: [r.chunk_id for r in out if r.query_id == q]
    assert [q for q in range(5) if any(r.reranked for r in out if r.query_id == q)] == [0, 4]
    assert order(0) == order(4) == ["c6", "c7", "c4", "c5", "c2", "c3", "c0", "c1"]
    assert order(1) == order(2) == order(3) == [f"c{i}" for i in range(8)]


def test_matches_of_queries_that_ask_alike(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "SHARD", 60)
    monkeypatch.setattr(V, "QUERY_BLOCK", 2)
    path = f"{tmp_path}/index"
    have = corpus(4, list(range(30)))
    V.write_segment(spark.createDataFrame(have, CHUNK), path)
    V.clear_sources(spark, path, spark.createDataFrame([(3,)], "source_id long"))
    queries = [(0, "w1 w2 w2"), (1, "w2 w1"), (2, "nothing"), (3, "w5 w1 w3"), (4, "w1 w2"), (5, "w7"), (6, "w9 w8")]
    want = [(q, c, n) for q, t in queries for c, s, text in have if s != 3 and (n := len(set(tokens(t)) & set(tokens(text))))]
    got = V.match(V.read_index(spark, path), V.query_terms(spark.createDataFrame(queries, "query_id long, text string")))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_what_is_asked_alike_is_searched_once_and_no_entry_is_a_row(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "SHARD", 60)
    path = f"{tmp_path}/index"
    have = corpus(5, list(range(30)))
    V.write_segment(spark.createDataFrame(have, CHUNK), path)
    index, rows = V.read_index(spark, path), {}

    def keep(df, name):
        got = df.collect()
        rows[name] = len(got)
        return df.sparkSession.createDataFrame(got, df.schema)

    queries = [(i, ("w1 w2 w3", "w3 w2 w1")[i % 2]) for i in range(40)]
    got = V.search(index, V.query_terms(spark.createDataFrame(queries, "query_id long, text string")), 3, keep=keep)
    assert sorted((r.query_id, r.chunk_id, round(r.score, 6), r["rank"]) for r in got.collect()) == plain(have, queries, 3)
    shards = index.shards.first()["shards"]
    assert shards > 1 and rows["asked"] == 1 and rows["found"] <= shards


def test_phrases_are_met_in_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "SHARD", 60)
    path = f"{tmp_path}/index"
    have = corpus(6, list(range(30)))
    V.write_segment(spark.createDataFrame(have, CHUNK), path)
    got = V.phrase_hits(V.read_index(spark, path), spark.createDataFrame([(q, 1, ["w1", "w2"]) for q in range(20)], "query_id long, phrase_no int, terms array<string>"))
    want = [(q, 1, c, n) for q in range(20) for c, _, t in have if (n := sum(a == ("w1", "w2") for a in zip(tokens(t), tokens(t)[1:])))]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "explode(arrays_zip(entries" not in got._jdf.queryExecution().analyzed().toString()


def test_lists_made_in_parts_are_those_of_the_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "SHARD", 60)
    have = corpus(7, list(range(30)))
    queries = [(0, "w1 w2 w2"), (1, "w5 w1 w3"), (2, "nothing"), (3, "w9")]
    for piece in (50, 10**6):
        monkeypatch.setattr(V, "PIECE", piece)
        path = f"{tmp_path}/index-{piece}"
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
        V.write_segment(spark.createDataFrame(have, CHUNK), path)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        index = V.read_index(spark, path)
        lists = index.lists.join(index.chunks.select(F.col("no").alias("first"), "chunk_id"), F.col("first") == F.col("entries")[0]["no"]).collect()
        assert (len({(r.col, r.term, r.shard) for r in lists}) < len(lists)) == (piece == 50)
        ids = {r.no: r.chunk_id for r in index.chunks.collect()}
        got = {(r.term, ids[e.no]): (e.source_id, e.tf, e.len, p) for r in lists for e, p in zip(r.entries, r.positions, strict=True)}
        want = {(t, c): (s, x.count(t), len(x), [i for i, y in enumerate(x) if y == t]) for c, s, text in have for x in [tokens(text)] for t in x}
        assert got == want and all(r.n == len(r.entries) and r.shard == r.entries[0].no >> 33 for r in lists)
        assert found(index, queries, spark, 5) == plain(have, queries, 5)
        assert V.phrase_hits(index, spark.createDataFrame([(0, 1, ["w1", "w1"])], "query_id long, phrase_no int, terms array<string>")).count() == sum(("w1", "w1") in set(zip(x, x[1:])) for _, _, t in have for x in [tokens(t)])

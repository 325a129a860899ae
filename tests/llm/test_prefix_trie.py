"""The prefix trie against plain dictionaries, in one partition and in many."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from passagekit.llm import prefix_trie as T
from passagekit.llm.prefix_trie import RESULT, LoserTree, op13_prefix_trie, prefix_trie, rebuilt, shared, turns

SCHEMA = "conv_id long, turn long, role string, text string, key string, depth int"


def plain(rows):
    own = defaultdict(list)
    for c, n, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own[c].append(((n is not None, n or 0), digest, (role, text)))
    own = {c: [x[2] for x in sorted(ts)] for c, ts in own.items()}
    members = defaultdict(list)
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + ts[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append((c, d == len(path)))
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    out = {}
    for path in sorted(members, key=len, reverse=True):
        ids = sorted(c for c, _ in members[path])
        words = len(re.findall("[^ \t\n\x0b\x0c\r]+", path[-1][1])) if path else 0
        kids = children[path]
        ends = ",".join(map(str, sorted(c for c, end in members[path] if end)))
        up = min(c for c, _ in members[path[:-1]]) if path else None
        out[path] = (ids[0], len(path), up, len(ids), len(kids), sum(out[k][5] for k in kids) or 1, (len(ids) - 1) * words + sum(out[k][6] for k in kids), hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=repr)


def rows():
    rng = random.Random(5)
    texts = [None, "", " \t", "a b", "a  b", "ä 日本\x00x", "word " * 3000, "c"]
    out = []
    for c in range(-3, 400):
        if c % 37 == 5 or c in (40, 80):  # groups without a first conversation: some members have no turns
            continue
        like = c % 3 if c % 2 else c  # many copies of few conversations
        mine = random.Random(like)
        for n in range(mine.randrange(1, 9)):
            out.append((c, None if n == 0 and c % 5 == 0 else n, mine.choice(["user", "assistant", None]), mine.choice(texts), "x", 1))
    out += [(7, 3, "user", "tie", "x", 1), (7, 3, "user", "other tie", "x", 1), (None, 1, "user", "no id", "x", 1)]
    out += [(1000, n, "user", f"t{n % 7}", "x", 1) for n in range(3000)] + [(1001, n, "user", f"t{n % 7}", "x", 1) for n in range(2990)]
    out += out[:3]  # repeated rows
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("part", [10**9, 700])
def test_against_dictionaries(spark, tmp_path, part, monkeypatch):
    monkeypatch.setattr(T, "partitions", lambda _: 1)
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = prefix_trie(rebuilt(turns(df)), part)
    assert got.columns == RESULT
    assert sorted(map(tuple, got.collect()), key=repr) == plain(data)


def test_copies_over_many_partitions(spark, tmp_path, monkeypatch):
    """One conversation copied often: its end node's ids stream through one hash in order, in chunks."""
    monkeypatch.setattr(T, "CHUNK", 7)
    data = [(c, n, "user", f"t{n}", "x", 1) for c in range(500) for n in range(3)]
    got = prefix_trie(turns(spark.createDataFrame(data, SCHEMA).repartition(7)), 100).collect()
    ids = hashlib.sha256(",".join(map(str, range(500))).encode()).hexdigest()
    assert sorted(tuple(r)[:7] for r in got) == [(0, 0, None, 500, 1, 1, 499 * 3), (0, 1, 0, 500, 1, 1, 499 * 3), (0, 2, 0, 500, 1, 1, 499 * 2), (0, 3, 0, 500, 0, 1, 499)]
    assert [r.ends_sha256 for r in got if r.depth == 3] == [ids]


def test_query_of_awkward_and_empty_tables(spark, tmp_path):
    data = rows()[:500]
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{tmp_path}/a/conversations.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/b/conversations.parquet")
    assert sorted(map(tuple, op13_prefix_trie(spark, f"{tmp_path}/a").collect()), key=repr) == plain(data)
    assert op13_prefix_trie(spark, f"{tmp_path}/b").count() == 0


def test_loser_tree_sorts_and_compares_no_turn_twice():
    rng = random.Random(2)
    digest = [hashlib.md5(bytes([i])).digest() for i in range(3)]
    for k in (1, 2, 3, 5, 8, 13):
        runs, everything = [], []
        for r in range(k):
            own = sorted((b"".join(rng.choices(digest, k=rng.randrange(60))), r * 1000 + i) for i in range(40))
            everything += own
            lcps = [0, *(shared(a[0], b[0]) for a, b in zip(own, own[1:], strict=False))]
            runs.append(iter([(x, c, n, np.zeros(0)) for (x, c), n in zip(own, lcps, strict=True)]))
        tree = LoserTree(runs)
        got = list(tree)
        assert [x[:2] for x in got] == sorted(everything)
        assert [x[2] for x in got][1:] == [shared(a[0], b[0]) for a, b in zip(got, got[1:], strict=False)]
        # turns that are compared and equal become shared ones for good; each match adds one that differs
        assert tree.compared <= sum(len(x[0]) // 16 for x in everything) + len(everything) * (k.bit_length() + 1)

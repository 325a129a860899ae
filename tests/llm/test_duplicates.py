"""Substring deduplication and the Jaccard join against plain versions."""

import hashlib
import os
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from passagekit.llm import jaccard
from passagekit.llm.common import Scratch
from passagekit.llm.jaccard import Lists, block_links, jaccard_components, op4_jaccard_join
from passagekit.llm.substrings import op3_substring_dedup, repeated_windows, without_repeats

from .data import awkward, folder, frame, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def removed(rows, window=50):
    """Starts of every window by the smallest id that has it; then each row's cover."""
    low = {}
    split = [(i, WORD.findall(t or "")) for i, t, *_ in rows]
    for i, ws in split:
        for a in range(len(ws) - window + 1):
            key = tuple(ws[a : a + window])
            low[key] = min(low.get(key, i), i)
    out = []
    for i, ws in split:
        gone = [False] * len(ws)
        for a in range(len(ws) - window + 1):
            if low[tuple(ws[a : a + window])] < i:
                gone[a : a + window] = [True] * window
        kept = " ".join(w for w, g in zip(ws, gone, strict=True) if not g)
        out.append((i, len(ws), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def repeated():
    """Passages that begin and end anywhere, overlap, and repeat inside a document and across many."""
    rng = random.Random(5)
    passage = [words(rng, n) for n in (50, 51, 60, 75, 120)]
    rows = []
    for i in range(60):
        parts = [words(rng, rng.randrange(0, 40))]
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(passage).split()
            a = rng.randrange(0, 12)
            parts += [" ".join(p[a:] if rng.random() < 0.5 else p), words(rng, rng.randrange(0, 30))]
        rows.append((1000 - 7 * i, " ".join(parts), "en", "s", 0))
    return rows


@pytest.mark.parametrize("rows", [awkward(), repeated()])
def test_substrings(spark, tmp_path, rows):
    got = op3_substring_dedup(spark, folder(spark, tmp_path / "d", rows)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == removed(rows)


def test_substrings_of_nothing(spark, tmp_path):
    assert op3_substring_dedup(spark, folder(spark, tmp_path / "e", [])).count() == 0


def test_kept_texts(spark):
    rows = repeated()
    out = {r.doc_id: r.text for r in without_repeats(frame(spark, rows)).collect()}
    digest = {i: (n, r, h) for i, n, r, h in removed(rows)}
    for i, (n, gone, h) in digest.items():
        if n and gone == n:
            assert i not in out
        elif gone:
            assert hashlib.sha256(out[i].encode()).hexdigest() == h
        else:
            assert out[i] == next(t for j, t, *_ in rows if j == i)


def shingles(text):
    ws = [w.translate({i: i + 32 for i in range(65, 91)}) for w in WORD.findall(text or "")]
    return {tuple(ws[a : a + 5]) for a in range(max(1, len(ws) - 4))} if ws else set()


def classes(rows):
    sets = [(i, shingles(t)) for i, t, *_ in rows]
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            holders[x].append(k)
    seen, links = set(), defaultdict(int)
    for own in holders.values():
        for a in range(len(own)):
            for b in own[a + 1 :]:
                if (own[a], b) not in seen:
                    seen.add((own[a], b))
                    (i, s), (j, t) = sets[own[a]], sets[b]
                    if 100 * len(s & t) >= 80 * len(s | t):
                        x, y = sorted((find(i), find(j)))
                        up[y] = x
                        links[own[a]] += 1
                        links[b] += 1
    return sorted((i, len(s), find(i), links[k]) for k, (i, s) in enumerate(sets))


def near_copies(count=400, seed=8):
    """A large family whose members drift, pairs at the very threshold, and texts of their own."""
    rng = random.Random(seed)
    base = words(rng, 60, 5000).split()
    rows = []
    for i in range(count):
        if rng.random() < 0.1:
            base[rng.randrange(60)] = f"d{i}"
        own = list(base)
        if rng.random() < 0.5:
            own[rng.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(own), "en", "s", 0))
    for k in range(12):
        n = rng.randrange(5, 50)
        a = words(rng, n, 10**6).split()
        rows += [(5000 + 10 * k, " ".join(a), "en", "s", 0), (5001 + 10 * k, " ".join(a + [f"y{k}z{j}" for j in range((n - 4) // 4)]), "en", "s", 0), (5002 + 10 * k, " ".join(a + [f"q{k}z{j}" for j in range((n - 4) // 4 + 1)]), "en", "s", 0)]
    return rows


@pytest.mark.parametrize(("rows", "block"), [(awkward(), None), (near_copies(), None), (near_copies(), 2000)])
def test_jaccard(spark, tmp_path, monkeypatch, rows, block):
    """With small blocks, so that families are cut into many; with copies, which count as links."""
    if block:
        monkeypatch.setattr(jaccard, "BLOCK", block)
        monkeypatch.setattr(jaccard, "BUNDLE", block)
        rows = [*rows, *((9000 + i, t, *r) for i, (_, t, *r) in enumerate(rows[:50]))]
    got = op4_jaccard_join(spark, folder(spark, tmp_path / "d", rows)).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    want = classes(rows)
    if len({i for i, *_ in want}) == len(want):
        assert sorted(map(tuple, got)) == want
    else:
        assert set(map(tuple, got)) == set(want)


def test_common_shingles_stand_out_of_a_full_sketch():
    """Each cell has 90 rare shingles; a shingle of 49 documents must come after these in nearly all cells."""
    rng = np.random.default_rng(2)
    plain = rng.poisson(90, 100_000)
    levels = [jaccard._levels(c, max(0.0, 90 - 8 * 90**0.5), 90**0.5 / 2) for c in (plain, plain + 49)]
    assert np.mean(levels[1] > np.quantile(levels[0], 0.95)) > 0.99
    rising = jaccard._levels(np.arange(0, 1 << 24, 97), 14.0, 4.7).astype(int)
    assert (np.diff(rising) >= 0).all() and rising[-1] < 256 and rising[0] == 0


def test_large_clusters_are_written_once(spark, monkeypatch):
    """A family of near copies is cut into many blocks; no set is copied for the blocks that it meets."""
    monkeypatch.setattr(jaccard, "BLOCK", 600)
    rng, rows = random.Random(4), []
    base = words(rng, 120, 10_000).split()
    for i in range(60):
        own = list(base)
        own[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(own)))
    copied = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    table = Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df, name: seen.append((name, table(self, df, name))) or seen[-1][1])
    drop = Scratch.drop
    files = {}

    def counted(self, name):
        if name == "blocks":
            path = f"{self.path}/blocks".removeprefix("file://")
            files.update({f: pa.ipc.open_file(f"{path}/{f}").read_all().num_rows for f in os.listdir(path) if not f.startswith(".")})
        drop(self, name)

    monkeypatch.setattr(Scratch, "drop", counted)
    got = jaccard_components(copied).collect()
    assert {(r["component_id"], r["n_links"]) for r in got} == {(0, 59)}
    assert len(files) > 5 and sum(files.values()) == 60
    assert dict(seen)["block-pairs"].count() == len(files) * (len(files) + 1) // 2


def test_jaccard_of_nothing(spark):
    assert jaccard_components(frame(spark, []).select("doc_id", "text")).count() == 0


def test_divide_skip_against_counting():
    rng = random.Random(2)
    for heavy in (False, True):  # lists that a heap merges, and longer ones with many candidates
        for _ in range(100):
            n, m = (300, 400) if heavy else (40, 12)
            sets = [np.array(sorted(rng.sample(range(m), rng.randrange(1, m))), np.uint64) for _ in range(n)]
            own = np.array(sorted(rng.sample(range(m), rng.randrange(1, m))), np.uint64)
            index = Lists(sets)
            lists = index.found(own)
            least, below = rng.randrange(1, len(lists) + 1), rng.randrange(n + 1)
            want = {i: k for i in range(below) if (k := len(np.intersect1d(sets[i], own))) >= least}
            who, count = index.divide_skip(lists, least, below)
            assert dict(zip(who.tolist(), count.tolist(), strict=True)) == want


def test_block_links_join_what_is_linked():
    rng = random.Random(3)
    base = list(range(50))
    sets = [np.array(sorted({x if rng.random() > 0.08 else 100 + rng.randrange(900) for x in base}), np.uint64) for _ in range(40)]
    copies = np.array([rng.randrange(1, 4) for _ in sets])
    number, links = block_links(list(range(40)), sets, copies)

    def classes_of(pairs):
        up = list(range(40))

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in pairs:
            up[find(a)] = find(b)
        groups = defaultdict(set)
        for i in range(40):
            groups[find(i)].add(i)
        return sorted(map(sorted, groups.values()))

    every = [(i, j) for i in range(40) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
    assert classes_of(links) == classes_of(every)
    want = np.zeros(40, int)
    for i, j in every:
        want[i] += copies[j]
        want[j] += copies[i]
    assert number.tolist() == want.tolist()
    side = np.array([i % 3 == 0 for i in range(40)])
    number, _ = block_links(list(range(40)), sets, copies, side)
    assert number.sum() == sum(copies[i] + copies[j] for i, j in every if side[i] != side[j])


def test_clashing_columns_and_longer_windows(spark):
    rows = repeated()
    df = frame(spark, rows).selectExpr("*", "1 AS d1", "2 AS kept", "3 AS found")
    out = without_repeats(df)
    assert out.columns == df.columns and {(r.d1, r.kept, r.found) for r in out.collect()} == {(1, 2, 3)}
    for window in (30, 120):
        want = {i: (n, r) for i, n, r, _ in removed(rows, window)}
        got = {r.doc_id: (r.n_words, r.n_removed) for r in repeated_windows(frame(spark, rows).select("doc_id", "text"), window).collect()}
        assert got == want

"""Collocations against plain counts of all phrases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from passagekit.llm import collocations as C
from passagekit.llm.collocations import RESULT, collocations, counted, fragments, mine, op11_collocations, pack, unpack

from .data import awkward, folder, frame


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def plain(rows, least, top):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text or "")):
            ws = re.findall("[^ \t]+", piece)
            n[lang] += len(ws)
            for size in range(1, 6):
                for i in range(len(ws) - size + 1):
                    f[lang][tuple(ws[i : i + size])] += 1
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        dead = {p[i:j] for p, a in found.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and counts[p[i:j]] <= a}
        rows = []
        for p, a in found.items():
            if p not in dead:
                cuts = [(1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))]
                score, _, left, right = min(cuts)
                rows.append((score, a, " ".join(p), left, right))
        rows.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, i + 1, p, a, left, right, n[lang], score) for i, (score, a, p, left, right) in enumerate(rows[:top])]
    return sorted(out)


def rows():
    rng = random.Random(11)
    common = ["the", "Of", "a", "ÄB", "日本", "x\x00y", "to"]
    out = [(r[2], r[1]) for r in awkward()]
    out += [(None, None), ("de", ""), ("de", "a a a a a a a a a a a a"), (None, "no lang no lang. no lang! no\tlang no lang")] * 4
    for lang in ("en", "de", None, "und"):
        for _ in range(60):
            words = [rng.choice(common) if rng.random() < 0.7 else f"w{rng.randrange(40)}" for _ in range(rng.randrange(80))]
            out.append((lang, "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n"]) for w in words)))
    return out + [("en", "cut here once " * 30)] * 3 + [("en", " ".join(["very"] * 4000))]


def table(df):
    assert df.columns == RESULT
    return sorted(map(tuple, df.collect()))


def test_against_counts(spark):
    data = rows()
    df = spark.createDataFrame(data, "lang string, text string").repartition(6)
    for least, top in ((5, 10_000), (12, 7)):
        assert table(collocations(df, least, top)) == plain(data, least, top)


def test_split_pivots_and_small_blocks(spark, monkeypatch):
    """Every frequent word is split over buckets; blocks of a few texts."""
    monkeypatch.setattr(C, "BLOCK", 2000)
    monkeypatch.setattr(C, "BUCKET", 300)
    monkeypatch.setattr(C, "max", lambda *xs: max([x for x in xs if x != 1000]), raising=False)
    data = rows()
    df = spark.createDataFrame(data, "lang string, text string").repartition(6)
    assert table(collocations(df, 5, 10_000)) == plain(data, 5, 10_000)


def test_query(spark, tmp_path):
    data = awkward() * 1
    assert table(op11_collocations(spark, folder(spark, tmp_path / "a", data))) == plain([(r[2], r[1]) for r in data], 100, 2000)
    assert op11_collocations(spark, folder(spark, tmp_path / "b", [])).count() == 0
    assert collocations(frame(spark, [(1, None, None, "s", 0)] * 3)).count() == 0


def test_each_phrase_has_one_pivot():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 6, 400).astype(np.int32)
    want = Counter()
    for size in range(2, 6):
        for i in range(len(ids) - size + 1):
            if (ids[i : i + size] > 0).all():
                want[tuple(ids[i : i + size].tolist())] += 1
    frag, _, weight = counted(fragments(ids))
    got = Counter()
    for phrase, total in mine(frag, weight, 1, 0):
        for p, t in zip(phrase.tolist(), total.tolist(), strict=True):
            assert tuple(p) not in got
            got[tuple(p)] = t
    assert got == want
    assert (unpack(pack(ids)) == ids).all()

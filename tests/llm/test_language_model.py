import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from passagekit.llm import language_model
from passagekit.llm.language import held_out
from passagekit.llm.language_model import OP1_SQL, discounts, op1_kneser_ney, score_documents, train

from .data import awkward, folder, frame, words


def reference(rows, order):
    """The same model with dictionaries, order by order from the words up."""
    table = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    seq = [(i, [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(table)), "</s>"]) for i, t, *_ in rows]
    train = [s for i, s in seq if zlib.crc32(str(i).encode()) % 10]
    grams = lambda s: list(zip(*([*["<s>"] * (order - 1), *s][i:] for i in range(order)), strict=False))
    uni = Counter(w for s in train for w in s)
    levels = [Counter(g for s in train for g in grams(s))]
    while len(next(iter(levels[0]))) > 1:
        levels.insert(0, Counter(g[1:] for g in levels[0]))
    n, v = sum(uni.values()), len(uni)
    cuts = [discounts([sum(1 for c in x.values() if c == k) for k in (1, 2, 3, 4)]) for x in levels]
    stats = []
    for level in levels:
        ctx = defaultdict(lambda: [0, 0, 0, 0])
        for g, c in level.items():
            ctx[g[:-1]][0] += c
            ctx[g[:-1]][min(c, 3)] += 1
        stats.append(ctx)
    out = []
    for i, s in seq:
        score = 0
        for g in grams(s):
            p = 1 / (v + 1)
            for m, (level, d, ctx) in enumerate(zip(levels, cuts, stats, strict=True), 1):
                own = g[-m:]
                if own[:-1] in ctx:
                    t, c = ctx[own[:-1]], level[own]
                    p = (c - d[min(c, 3) - 1] if c else 0) / t[0] + sum(x * y for x, y in zip(d, t[1:], strict=True)) / t[0] * p
            score += math.log10(p)
        out.append((i, len(s), sum(w in uni for w in s), n, sum(math.log10((uni[w] + 0.1) / (n + 0.1 * (v + 1))) for w in s), score))
    return out


ODD = [(600, "vertical\x0btab and\x0cform feed\r\nreturn", "en", "s", 30), (601, "a b a c a b a d " * 80, "en", "s", 0), (602, "hot " * 3000 + "a b", "en", "s", 0)]


@pytest.mark.parametrize(("order", "shard", "hold"), [(2, None, None), (3, None, None), (3, 500, 300)])
def test_against_dictionaries(spark, tmp_path, monkeypatch, order, shard, hold):
    """Also with many shards, tasks that hold little, and words so frequent that their n-grams are spread."""
    if shard:
        monkeypatch.setattr(language_model, "SHARD", shard)
        monkeypatch.setattr(language_model, "HOLD", hold)
    rows = [*awkward(), *ODD]
    folder(spark, tmp_path / "d", rows)
    docs = frame(spark, rows).selectExpr("doc_id", "coalesce(text, '') AS text").select("doc_id", held_out(10).alias("held_out"), "text")
    model = train(docs.where("not held_out"), order)
    assert not shard or len(model.hot) > 1
    got = sorted(tuple(r)[:1] + tuple(r)[2:] for r in score_documents(docs, model).collect())
    want = sorted(reference(rows, order))
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:4] == w[:4]
        assert g[4:] == pytest.approx(w[4:], abs=1e-6)
    if order == language_model.ORDER and not shard:
        query = op1_kneser_ney(spark, str(tmp_path / "d")).collect()
        assert sorted(tuple(r)[:1] + tuple(r)[2:] for r in query) == got


def test_query_equals_sql_on_odd_white_space(spark, tmp_path):
    from tests.compare import difference

    rows = [(i, t, "en", "s", 0) for i, t in enumerate(["a b a", "a\x0bb\x0cc", "b\r\nc A", None, "", "a b a c", "b a \x85 c"])]
    assert difference(spark, op1_kneser_ney, OP1_SQL, folder(spark, tmp_path / "d", rows)) == ""


@pytest.mark.parametrize("order", [2, 3])
def test_probabilities_sum_to_one(spark, order):
    texts = ["a b a c", "b a b", "a b a", "c c a b"]
    m = train(frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)]), order)
    for before in ("", "a", "a b", "c c", "b zzz", "zzz a", "a b a"):
        total = 0
        for word in ("a", "b", "c", None, "unknown"):
            at, _, _, p = m.token_scores(pa.array([f"{before} {word or ''}"]))
            total += p[-1] if word is None else p[-2]
        assert total == pytest.approx(1, abs=1e-9)


def test_no_training_text(spark, tmp_path):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    (row,) = op1_kneser_ney(spark, folder(spark, tmp_path / "d", [(held, "a b", "en", "s", 3)])).collect()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (True, 3, 0, 0)
    assert op1_kneser_ney(spark, folder(spark, tmp_path / "e", [])).count() == 0


def test_shards_are_visited_once_for_all_slices(spark, monkeypatch):
    """Many slices of texts are looked up together: a shard is visited as often as for one of them, with the same scores."""
    monkeypatch.setattr(language_model, "SHARD", 100)
    rng = random.Random(8)
    texts = [words(rng, 200, 90) for _ in range(24)]
    m = train(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert m.shards > 40
    visits = []
    find = language_model._find_pairs
    monkeypatch.setattr(language_model, "_find_pairs", lambda folder, name, a, b: visits.append(name) or find(folder, name, a, b))
    columns = [pa.array(texts[i : i + 3]) for i in range(0, 24, 3)]
    at, count, base, p = m.token_scores(*columns)
    together, alone = len(visits), [m.token_scores(c) for c in columns]
    assert together <= 2 * m.shards < len(visits) - together
    assert at[-1] == len(p) == 24 * 201
    for got, i in ((count, 1), (base, 2), (p, 3)):
        assert (got == np.concatenate([x[i] for x in alone])).all()

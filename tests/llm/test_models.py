"""Language identification, personal data, HTML extraction, media columns and nearest neighbours."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from passagekit.llm import pii
from passagekit.llm.curves import _rank, nearest, op9_nearest_neighbours
from passagekit.llm.html_text import PATH, WORD, Block, features, label, leaf_blocks, main_text
from passagekit.llm.html_text import model as page_model
from passagekit.llm.jpeg import decode, encode, op7_media_columns, pad, unpack
from passagekit.llm.language import DIMENSIONS, held_out, letter_vectors, op8_language_id, predict, train
from passagekit.llm.pii import all_spans, base_spans, card_ok, find_spans, mask, masked, model, op6_pii, training_lines

from .data import awkward, folder, frame

SF = "/root/testdata/sf0.001"


def test_language_held_out(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = op8_language_id(spark, SF).collect()
    assert len(rows) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and lang[r.doc_id]]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_awkward_texts(spark, tmp_path):
    rows = awkward()
    text = {i: t for i, t, *_ in rows}
    out = op8_language_id(spark, folder(spark, tmp_path / "d", rows)).collect()
    assert len(out) == len(rows)
    for r in out:
        has = any(c.isalpha() for c in text[r.doc_id] or "")
        assert (r.lang_pred != "und") == has and (has or r.score == 0)
    assert op8_language_id(spark, folder(spark, tmp_path / "e", [])).count() == 0


def plain_profile(text):
    """The bundle of a text's trigrams, one by one."""
    words = ["".join(x.lower() if len(x.lower()) == 1 else x for x in w) for w in re.findall(r"[^\W\d_]+", text or "")]
    line = f" {' '.join(words)} " if words else ""
    bag = Counter(zip(line, line[1:], line[2:], strict=False))
    out = np.zeros(DIMENSIONS)
    for gram, n in bag.items():
        bound = np.ones(DIMENSIONS)
        for i, c in enumerate(gram):
            bound *= np.roll(letter_vectors(np.array([0 if c == " " else ord(c)]))[0], 2 - i)
        out += n * bound
    return out / max(np.linalg.norm(out), 1e-12)


def test_language_against_a_plain_version(spark, tmp_path):
    rows = [r for r in awkward() if "日" not in (r[1] or "")]
    rows += [(500 + i, t, lang, "s", 0) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de"), ("Straße über ÄÖÜ", "de"), ("a-b c1d 2 e_f", "en")] * 5)]
    learn = {i: (t, lang) for i, t, lang, *_ in rows if lang and t is not None and zlib.crc32(str(i).encode()) % 5}
    repeats = Counter(i for i, *_ in rows)
    langs = sorted({lang for _, lang in learn.values()})
    prototypes = np.array([sum(repeats[i] * plain_profile(t) for i, (t, own) in learn.items() if own == lang) for lang in langs])
    prototypes /= np.linalg.norm(prototypes, axis=1, keepdims=True)
    for r in op8_language_id(spark, folder(spark, tmp_path / "d", rows)).collect():
        text = next(t for i, t, *_ in rows if i == r.doc_id)
        cosine = prototypes @ plain_profile(text)
        if any(c.isalpha() for c in text or ""):
            assert r.score == pytest.approx(max(0, cosine.max()), abs=2e-4)
            assert cosine[langs.index(r.lang_pred)] == pytest.approx(cosine.max(), abs=2e-4)
        else:
            assert (r.lang_pred, r.score) == ("und", 0)


def test_language_columns_of_the_same_names(spark):
    df = frame(spark, [(1, "some words", "en", "s", 0)]).selectExpr("*", "'x' AS lang_pred", "5 AS score")
    langs, prototypes = train(df.where(~held_out(5)))
    out = predict(df, langs, prototypes)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "lang_pred", "score", "has_letter"] and out.count() == 1


def plain_spans(text):
    """The stated patterns, by the re module."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9](?:[\x20-]?[0-9])+", text) if card_ok(m[0])]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


def test_patterns_on_random_texts():
    rng = np.random.default_rng(4)
    alphabet = list("0123456789" * 3 + "..@@+--() ab_%é\n")
    for _ in range(3000):
        text = "".join(rng.choice(alphabet, int(rng.integers(0, 40))))
        assert base_spans(text) == plain_spans(text), text
    for text in ["4111 1111 1111 1111", "4111-1111-1111-1112", "a.b+c@d-e.co.uk.", "1.2.3.4.5.6.7.8", "999.1.1.1 1.2.3.004", "+49 (0)30 1234567, +1-2", "x@y", "٣.٣.٣.٣"]:
        assert base_spans(text) == plain_spans(text), text


def test_personal_data_query(spark, tmp_path):
    extra = ["mail a.b@example.com or 10.0.0.1, card 4111 1111 1111 1111, call +1 (555) 123-4567.", "x" * 70_000 + " a@b.co " + "9" * 5000]
    rows = awkward() + [(700 + i, t, "en", "s", 0) for i, t in enumerate(extra)]
    text = {i: t or "" for i, t, *_ in rows}
    out = op6_pii(spark, folder(spark, tmp_path / "d", rows)).collect()
    assert len(out) == len(rows)
    for r in out:
        base = plain_spans(text[r.doc_id])
        digest = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(digest.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, *_ in base) for x in ("email", "ip", "card", "phone")]
        assert set(digest.split(",")) <= set(r.spans.split(",")) or not digest
    assert op6_pii(spark, folder(spark, tmp_path / "e", [])).count() == 0


def test_network_adds_spans_and_leaves_other_numbers(spark):
    texts = ["Please call (555) 123-4567 today.", "call 212.555.0199 or write", "In 2019 we had 12 345 678 visits and 1.5 litres at 10:30 on 2020-01-15.", "Version 1.2.3 of [12] costs $123.45"]
    rows = find_spans(frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)]).select("doc_id", "text")).orderBy("doc_id").collect()
    assert [r.spans for r in rows] == ["phone:12:26", "phone:5:17", "", ""]


def test_network_on_lines_that_it_was_not_trained_on():
    lines = training_lines(400, 99)
    right = wrong = missed = 0
    for (text, gold), found in zip(lines, pii.decode(model(), [t for t, _ in lines]), strict=True):
        got, want = set(all_spans(text, base_spans(text), found)), set(gold)
        right, wrong, missed = right + len(got & want), wrong + len(got - want), missed + len(want - got)
    assert right >= 0.9 * (right + missed) and right >= 0.9 * (right + wrong)


def test_one_path_over_whole_texts(monkeypatch):
    """The path is that of one Viterbi run over all characters, however the text is cut for it."""
    p = model()
    texts = [" ".join(t for t, _ in training_lines(n, 50 + n)) for n in (1, 3, 12)] + ["", "7", "no numbers at all " * 40]
    scores, at = pii.scores(p, [pii.codes(t) for t in texts])
    tags = pii.best_path(scores, at, p["M"])
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b > a:
            assert (tags[a:b] == pii.viterbi(scores[a:b][None], np.ones((1, b - a), bool), p["M"])[0]).all()
    whole = pii.decode(p, texts)
    monkeypatch.setattr(pii, "BLOCK", 300)
    assert pii.decode(p, texts) == whole and any(whole)


def test_long_paths_are_exact_whatever_stands_behind():
    """Random scores and transitions, among them gains that come only after a cut could have been made."""
    rng = np.random.default_rng(0)
    value = lambda s, t, move: s[np.arange(len(t)), t].sum(dtype=float) + move[t[:-1], t[1:]].sum(dtype=float)
    cuts = 0
    for trial in range(150):
        n = int(rng.integers(2, 300))
        move = rng.normal(0, 1.5, (pii.TAGS, pii.TAGS)).astype(np.float32) if trial % 2 else np.zeros((pii.TAGS, pii.TAGS), np.float32)
        score = rng.normal(0, 1.5, (n, pii.TAGS)).astype(np.float32)
        score[:, 0] += rng.choice([0.5, 2, 4, 6])
        want = pii.viterbi(score[None], np.ones((1, n), bool), move)[0]
        assert not want[pii.sure(score, move)].any()
        part, other = int(rng.choice([1, 2, 7, 64, 128])), score[: n // 2]
        alone, half = pii.viterbi_long([score, other], move, part)
        assert len(alone) == n and abs(value(score, alone, move) - value(score, want, move)) < 1e-3
        if len(other):
            assert abs(value(other, half, move) - value(other, pii.viterbi(other[None], np.ones((1, len(other)), bool), move)[0], move)) < 1e-3
        parts = list(pii.long_path(lambda lo, hi, s=score: s[lo:hi], n, move, int(rng.integers(1, 60))))
        cuts += len(parts) - 1
        got = np.concatenate([t for _, t in parts])
        assert len(got) == n and abs(value(score, got, move) - value(score, want, move)) < 1e-3
    assert cuts > 50
    # the first of two characters is outside alone, but not with the second behind it
    score, move = np.full((2, pii.TAGS), -9, np.float32), np.full((pii.TAGS, pii.TAGS), -9, np.float32)
    score[:, 0], score[:, 1], move[0, 0], move[1, 1], move[0, 1] = 0, [-0.5, 3], 0, 1, -2
    assert [t for _, tags in pii.long_path(lambda lo, hi: score[lo:hi], 2, move, 1) for t in tags.tolist()] == pii.viterbi(score[None], np.ones((1, 2), bool), move)[0].tolist() == [1, 1]


def test_network_finds_what_no_pattern_has():
    texts = ["write to jane at example dot com now", "call (555) 123-4567 today"]
    assert all(all_spans(t, base_spans(t), f) for t, f in zip(texts, pii.decode(model(), texts), strict=True))


def test_masks(spark):
    assert mask("to a@b.co now", [("email", 3, 9)]) == "to [EMAIL] now"
    df = frame(spark, [(1, "to a@b.co now", "en", "s", 0), (2, None, None, None, None)]).selectExpr("*", "lang AS spans")
    assert [(r.doc_id, r.text, r.spans) for r in masked(df).orderBy("doc_id").collect()] == [(1, "to [EMAIL] now", "en"), (2, None, None)]


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/x">More</a></li></ul></nav>
<article><h1>The   title</h1><p>First &amp; <b>bold</b> words of the text, which go on for a while.</p><p>Second paragraph with more words in it, so that it counts as text.</p></article>
<aside class="sidebar"><ul><li><a href="/r">Related</a></li></ul></aside><section id="comments"><div class="comment"><p>I disagree with all of this.</p></div></section><footer>&copy; 2020 Someone</footer></body></html>"""


def test_main_text(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<html><body></body></html>"), (1, "u", PAGE)]
    out = main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    text = "The title First & bold words of the text, which go on for a while. Second paragraph with more words in it, so that it counts as text."
    assert sorted((r.page_id, r.text, r.n_chars) for r in out) == sorted([(1, text, len(text)), (2, "", 0), (3, "", 0), (4, "", 0), (1, text, len(text))])
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_blocks_of_broken_markup():
    assert [b.text for b in leaf_blocks("<p>a<p>b<div>c</b></div>d <a href='>x'>e</a> &lt;f&gt; <br>g<!-- no -- > <p>x</p>")] == ["a", "b", "c", "d e <f>", "g"]
    assert [b.text for b in leaf_blocks("text <b")] == ["text"]
    assert leaf_blocks("<script>x") == []


def test_media_round_trip(spark, tmp_path):
    rows = awkward()
    text = {i: (t or "").encode() for i, t, *_ in rows}
    seen = {}
    out = op7_media_columns(spark, folder(spark, tmp_path / "d", rows)).collect()
    assert len(out) == len(rows)
    for r in out:
        raw = text[r.doc_id]
        full = raw + b"\0" * ((-len(raw)) % 64 or (64 if not raw else 0))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        assert seen.setdefault(raw, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    assert op7_media_columns(spark, folder(spark, tmp_path / "e", [])).count() == 0


def test_stored_form_is_jpeg():
    import pyarrow as pa

    payload, blocks, size = pad(pa.array(["", "x" * 64, "é" * 500, "\x00\xff" * 77]))
    for data, b in zip(encode(payload, blocks, size), blocks, strict=True):
        assert data[:2] == b"\xff\xd8" and data[-2:] == b"\xff\xd9" and b"\xff\xc0" in data
        (image,) = decode([data])
        assert len(unpack(image)) == 64 * b and image.thumbnail.size == b or image.width * image.height >= 64 * b


def test_neighbours_against_brute_force(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x, ids = np.stack(e["embedding"]).astype(np.float64), e["vec_id"].to_numpy()
    got = {}
    for r in op9_nearest_neighbours(spark, SF).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    hits = 0
    for q, rows in got.items():
        rows.sort()
        s = x @ x[ids == q][0]
        best = sorted(((-v, i) for v, i in zip(s, ids.tolist(), strict=True) if i != q))[:20]
        hits += len({i for _, i in best} & {i for _, i, _ in rows})
        assert [r for r, *_ in rows] == list(range(1, 21))
        for _, i, v in rows:
            assert v == pytest.approx(float(s[ids == i][0]), abs=1e-12)
    assert hits >= 0.9 * 20 * len(got)


def test_neighbours_of_awkward_vectors(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [0.5, 2.0]), (40, [0.0, 0.0]), (9, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS rep", "2 AS score")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in nearest(df).collect())
    assert got == [(0, 1, 3, 1.0), (0, 2, 20, 1.0), (0, 3, 8, 0.5), (20, 1, 0, 1.0), (20, 2, 3, 1.0), (20, 3, 8, 0.5)]
    assert nearest(df.limit(0)).count() == 0


def test_tied_neighbours_are_those_of_smallest_id(spark):
    """More equal inner products than are asked for, in an order that has nothing to do with the ids."""
    rng = np.random.default_rng(5)
    tied = np.zeros((200, 12))
    tied[np.arange(200), rng.integers(1, 12, 200)] = rng.uniform(1, 9, 200).round(3)
    tied[:, 0] = 1.0
    place = rng.permutation(200)
    table = pa.table({"vec": [x.tobytes() for x in [*tied[place], np.eye(12)[0]]], "rep": np.append(place, 999), "place": np.arange(201), "query": np.arange(201) == 200})
    assert _rank("<f8", 300, 21)(table)["rep"].to_pylist() == list(range(21))
    rows = [(i, x) for i, x in enumerate(tied.tolist())] + [(1000, np.eye(12)[0].tolist())]
    got = [r.vec_id for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 1000).where("query_id = 1000").orderBy("rank").collect()]
    assert got == list(range(20))


def test_vectors_of_several_dimensions(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 1.0]), (2, [1.0, 0.0, 3.0]), (None, [1.0, 1.0])]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [(r.query_id, r.vec_id, r.score) for r in got] == [(0, 1, 0.5)]


def test_neighbours_of_a_table_much_larger_than_its_windows(spark):
    x = unit_vectors(20_000, 32, 3) + 2 * unit_vectors(200, 32, 4)[np.arange(20_000) % 200]
    assert recall_of(spark, x, 200, curves=8, window=60) >= 0.9


def recall_of(spark, x, every, k=20, **how):
    """The share of true neighbours found, by brute force over the rows of x."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest(df, every, k, **how).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, len(x), every):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-s, kind="stable")[:k].tolist()))
    return hits / (k * len(range(0, len(x), every)))


def unit_vectors(n, width=64, seed=1):
    x = np.random.default_rng(seed).standard_normal((n, width))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_neighbours_where_windows_are_a_small_part_of_the_table(spark):
    assert recall_of(spark, unit_vectors(6000), 20, curves=8, window=40) >= 0.9


def test_neighbours_of_mixed_lengths(spark):
    x = unit_vectors(4000)
    one = x.copy()
    one[7] *= 10
    assert recall_of(spark, one, 20, window=60, recall=0) >= 0.9
    mixed = x * np.exp(np.random.default_rng(2).standard_normal((4000, 1)))
    assert recall_of(spark, mixed, 20) >= 0.9


def test_blocks_of_open_elements():
    texts = lambda html: [b.text for b in leaf_blocks(html)]
    assert texts("<html><head><title>T</title><meta charset=x><body><article><p>a</p></article>") == ["a"]
    assert (leaf_blocks("<html><head><title>T</title><body><p>a</p>")[0].path == leaf_blocks("<html><head></head><body><p>a</p>")[0].path).all()
    assert texts("<head><style>b{}</style><title>T</title><p>a</p>") == ["a"]
    assert texts('<p>a <svg class="i" /> b</p><p>c</p><svg><text>no</text></svg><p>d</p>') == ["a b", "c", "d"]
    assert texts("<template-card><p>a</p></template-card><select-box>b</select-box>") == ["a", "b"]
    assert texts("<p>a</p><noscript><p>b</p>") == ["a", "b"] and texts("<p>a</p><textarea>b") == ["a"]


def test_features_see_whole_blocks():
    x = features([[Block(np.zeros(PATH), "x" * 300 + tail, 0)] for tail in ("", "©", "9" * 300)])
    assert (x[0] != x[1]).any() and x[2][0, PATH + WORD + 5] == 0.5


def test_paths_are_whole():
    """Elements beyond any depth count in a block's path."""
    deep = "<div>" * 30 + "<p>a</p>"
    assert (leaf_blocks(f'<div class="comments">{deep}')[0].path != leaf_blocks(f'<div class="story">{deep}')[0].path).any()
    assert len(leaf_blocks("<div>" * 5000 + "<p>a</p>")) == 1


#: Layouts with class names that no training page has: (opening, closing, is article).
PARTS = [('<nav class="mainlinks">', "</nav>", False), ('<header class="hd">', "</header>", False), ('<aside class="rail">', "</aside>", False), ('<footer class="ft">', "</footer>", False), ('<form action="/s">', "</form>", False), ('<section id="comments-area"><div class="comment">', "</div></section>", False)]
STORIES = [('<article class="x1">', "</article>"), ("<main>", "</main>"), ('<div class="article-content">', "</div>")]


def strange_pages(count, seed=77):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefghiklmnoprstu"), int(rng.integers(2, 9)))) for _ in range(300)]
    say = lambda a, b: " ".join(rng.choice(words, int(rng.integers(a, b))))
    for _ in range(count):
        html, labels = "<html><head><title>t</title></head><body>", []
        order = [PARTS[i] for i in (1, 0)] + [STORIES[int(rng.integers(3))]] + [PARTS[i] for i in rng.permutation([2, 4, 5])] + [PARTS[3]]
        for part in order:
            html += part[0]
            if len(part) == 2:
                for _ in range(int(rng.integers(2, 9))):
                    html += f"<p>{say(8, 60).capitalize()} &amp; {say(2, 9)}.</p>"
                    labels.append(True)
            else:
                for _ in range(int(rng.integers(1, 5))):
                    html += f"<p>{say(3, 20)}.</p>" if "comment" in part[0] else f'<div><a href="#">{say(1, 4)}</a></div>'
                    labels.append(False)
            html += part[1]
        yield html + "</body></html>", labels


def test_labels_of_pages_unlike_those_of_training():
    pages = list(strange_pages(60))
    blocks = [leaf_blocks(html) for html, _ in pages]
    right = wrong = missed = 0
    for page, found, (_, want) in zip(blocks, label(page_model(), blocks), pages, strict=True):
        assert len(page) == len(want)
        right, wrong, missed = right + sum(found & want), wrong + sum(found & ~np.array(want)), missed + sum(~found & want)
    assert right >= 0.95 * (right + wrong) and right >= 0.95 * (right + missed)


def test_pages_with_further_columns(spark, tmp_path):
    from passagekit.llm.html_text import op10_html_extraction

    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "html AS text", "1 AS n_chars", "url AS path").write.parquet(f"{tmp_path}/pages.parquet")
    out = op10_html_extraction(spark, str(tmp_path)).collect()
    assert [r.n_chars for r in out].count(0) == 1 and len({(r.page_id, r.text) for r in out}) == 2 and len(out) == 3

"""The five stages over awkward rows, each against a plain version of its decision."""

import re
import struct
import zlib
from collections import Counter

import corpus_pipeline
import public_tokenizers as P
from tokenizers import Tokenizer

from passagekit.llm.pii import all_spans, base_spans, decode, mask, model

from .data import awkward, folder, frame
from .test_duplicates import classes, removed

STAGE = dict(corpus_pipeline.STAGES)


def stage(spark, name, rows):
    return STAGE[name](spark, frame(spark, rows), "")


def plain(df):
    return sorted((tuple(r) for r in df.select(*corpus_pipeline.COLUMNS).collect()), key=repr)


def test_stages(spark):
    rows = awkward()
    known = plain(stage(spark, "language_id", rows))
    some = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    assert [r for r in known if r[2]] == known and {r[2] for r in known} == {"en", "de"}
    assert sorted((r[:2] + (dict((x[0], x[2]) for x in known)[r[0]],) + r[3:] if r[2] is None else r for r in some), key=repr) == known
    first = {i for i, _, c, _ in classes(known) if i == c}
    kept = plain(stage(spark, "jaccard_join", known))
    assert kept == sorted({r for r in known if r[0] in first}, key=repr)
    cut = {i: (n, gone) for i, n, gone, _ in removed(kept)}
    rest = plain(stage(spark, "substring_dedup", kept))
    assert {r[0] for r in rest} == {i for i, (n, gone) in cut.items() if gone < n}
    for i, text, *_, n in rest:
        assert len(re.findall(r"[^\x20\x09-\x0D]+", text)) == cut[i][0] - cut[i][1] and n == len(text)
    private = plain(stage(spark, "pii", [*rest, (999, "write to a@b.com", "en", "s", 16)]))
    assert [r[0] for r in private] and all(not base_spans(r[1]) for r in private)
    assert next(r for r in private if r[0] == 999)[1] == "write to [EMAIL]"


def plain_run(rows):
    """The kept texts of each stage, one after the other: id -> ids of tokens."""
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    first = {i for i, _, c, _ in classes(rows) if i == c}
    rows = list({(r[0], r[1]) for r in rows if r[0] in first})
    gone, low = [], {}
    split = [(i, t, re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in rows]
    for i, _, ws in split:
        for a in range(len(ws) - 49):
            w = tuple(ws[a : a + 50])
            low[w] = min(i, low.get(w, i))
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for i, t, ws in split:
        cover = {k for a in range(len(ws) - 49) if low[tuple(ws[a : a + 50])] < i for k in range(a, a + 50)}
        if len(cover) == len(ws):
            continue
        text = " ".join(w for k, w in enumerate(ws) if k not in cover) if cover else t
        text = mask(text, all_spans(text, base_spans(text), decode(model(), [text])[0]))
        gone.append((i, [*tok.encode(text, add_special_tokens=False).ids, 1]))
    return gone


def test_whole_run(spark, tmp_path):
    rows = [*awkward(), (800, "write to a@b.com or call (555) 123-4567 today", "en", "s", 45)]
    out = corpus_pipeline.run(spark, folder(spark, tmp_path / "d", rows)).collect()
    want = Counter()
    for i, ids in plain_run(rows):
        for a in {r.start for r in out if r.doc_id == i}:
            n = next(r.length for r in out if (r.doc_id, r.start) == (i, a))
            want[i, a, n, zlib.crc32(struct.pack(f"<{n}I", *ids[a : a + n])), len(ids)] += 1
    assert want == Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out)
    places = Counter()
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == places[r.sequence_id]
        places[r.sequence_id] += r.length
    assert max(places.values()) <= 2048
    assert corpus_pipeline.run(spark, folder(spark, tmp_path / "e", [])).count() == 0


def test_nothing_is_lost_without_labels_or_ids(spark, tmp_path):
    rows = [(1, "some words of a text", None, "s", 20), (2, "12 34", None, "s", 5)]
    assert plain(stage(spark, "language_id", rows)) == rows[:1]
    und = [(i, f"words of text number {i}", "und", "s", 22) for i in range(20)]
    assert len(plain(stage(spark, "language_id", und))) == 20
    nameless = [(None, "a text that has no id at all", None, "s", 28), (3, "another text that has an id", None, "s", 27)]
    for name in ("language_id", "jaccard_join", "substring_dedup", "pii"):
        assert [r[1] for r in plain(stage(spark, name, nameless))] == ["another text that has an id", "a text that has no id at all"], name

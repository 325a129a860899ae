"""Byte-level BPE and packing."""

import base64
import hashlib
import struct
import zlib
from collections import defaultdict

import public_tokenizers as P
import tiktoken
from tokenizers import Tokenizer

from passagekit.llm.byte_bpe import op2_byte_bpe
from passagekit.llm.packing import first_fit_decreasing, op5_packing

from .data import awkward, folder, frame

ODD = ["  two  spaces\n\n\nlines\t\ttabs", "it's we'll I'D 123456 --- …", "ａｂｃ​﻿ é 🇩🇪👩‍👩‍👧", "aaaaaaaa" * 500, "\r\n\r\n \r", "ſ K İ", "\x85\xa0  x"]


def rows():
    base = awkward()
    return base + [(900 + i, t, "en", "s", len(t)) for i, t in enumerate(ODD)]


def ids_bytes(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_bpe_against_tiktoken(spark, tmp_path):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t, *_ in rows():
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(ids_bytes(ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = op2_byte_bpe(spark, folder(spark, tmp_path / "d", rows())).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert op2_byte_bpe(spark, folder(spark, tmp_path / "e", [])).count() == 0


def test_packing(spark, tmp_path):
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    docs = rows()
    want = defaultdict(list)
    for i, t, *_ in docs:
        want[i].append([*tok.encode(t or "", add_special_tokens=False).ids, 1])
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in op5_packing(spark, folder(spark, tmp_path / "d", docs)).collect():
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(want)
    for i, copies in want.items():
        (ids,) = {tuple(c) for c in copies}
        each = sorted(pieces[i])
        assert len(each) % len(copies) == 0
        at = 0
        for start, length, crc, total in each[:: len(copies)]:
            assert (start, total, crc) == (at, len(ids), zlib.crc32(ids_bytes(ids[at : at + length])))
            at += length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert op5_packing(spark, folder(spark, tmp_path / "e", [])).count() == 0


def test_first_fit_decreasing_against_a_scan():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 300):
        sizes = rng.integers(1, 101, n)
        bins, at = first_fit_decreasing(sizes, 100)
        room, expect = [], {}
        for i in np.argsort(-sizes, kind="stable").tolist():
            b = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
            if b == len(room):
                room.append(100)
            expect[i] = (b, 100 - room[b])
            room[b] -= sizes[i]
        assert [(int(bins[i]), int(at[i])) for i in range(n)] == [expect[i] for i in range(n)]


def test_padding(spark, tmp_path):
    """Groups cost little beside one group for all, and the share of padding is small; one id on all rows spreads too."""
    import random

    from passagekit.llm.packing import pack_documents

    rng = random.Random(4)
    texts = [" ".join(["word"] * rng.randrange(1, 3000)) for _ in range(600)]
    df = frame(spark, [(1, t, "en", "s", 0) for t in texts]).select("doc_id", "text")
    path = P.path("word_bpe_49k.json")
    used, total = {}, 0
    for group in (60, 10**6):
        rows = pack_documents(df, path, group=group).collect()
        used[group] = len({r.sequence_id for r in rows})
        total = sum(r.length for r in rows)
        assert len({r.sequence_id >> 32 for r in rows if r.length < 2048}) >= (2 if group == 60 else 1)
    assert used[60] <= 1.03 * used[10**6] and used[10**6] * 2048 <= 1.02 * total

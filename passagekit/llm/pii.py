"""Personal data: exact patterns, and a character-level bidirectional LSTM with CRF transitions that adds to them.

The network is trained in numpy on labelled spans in generated lines.  It reads whole texts in overlapping windows; the
scores of windows that overlap are averaged, by how central a character lies in each, and every text is decoded by one
Viterbi path over all its characters.  What the network marks must still be a valid number or address of its kind.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import recurrent
from .common import clean, documents, map_batches, slices

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
LINE, HIDDEN = 48, 12  # characters of a training line, at least
SIZE, STRIDE = 512, 480  # windows of a text; a character lies in at most two
BATCH = 448  # windows read together: a product of a step stays below what BLAS spreads over threads, which would spin
LONE = 400  # characters of a stretch beyond which its path is searched in parts side by side
BLOCK = 1 << 20  # characters of a very long text whose scores are held at once, about
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

Span = tuple[str, int, int]

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"[0-9]+")
_HINT = re.compile(r"[0-9@]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def card_ok(text: str) -> bool:
    d = _digits(text)
    return 13 <= len(d) <= 19 and luhn(d)


def base_spans(text: str) -> list[Span]:
    """The exact patterns' spans, by kind and then start.  Each scan is linear in the text."""
    out: list[Span] = []
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(done, at + 1))
    if not _HINT.search(text):
        return out
    for m in _CHAIN.finditer(text):
        if m[0].count(".") >= 3:
            parts = [(x.start() + m.start(), x.end() + m.start()) for x in _NUMBER.finditer(m[0])]
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                if all(len(text[a:b].lstrip("0")) <= 3 and int(text[a:b].lstrip("0") or 0) <= 255 for a, b in four):
                    out.append(("ip", four[0][0], four[3][1]))
    out += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and card_ok(m[0])]
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


# --- the network ---------------------------------------------------------------------------------------------------

_MARKS = "@.-+()/:_%=\"',#;&[]"
CODES = 130  # ASCII, all other characters, and what fills a window behind its text's end
INPUTS = 26 + len(_MARKS) + 5


@lru_cache(maxsize=1)
def _inputs() -> np.ndarray:
    """The input of each code: its letter or mark, and its class."""
    out = np.zeros((CODES, INPUTS), np.float32)
    for c in range(128):
        x = chr(c)
        if x.lower() in "abcdefghijklmnopqrstuvwxyz":
            out[c, ord(x.lower()) - 97] = 1
        elif x in _MARKS:
            out[c, 26 + _MARKS.index(x)] = 1
        out[c, INPUTS - 5 + (0 if x.isdigit() else 1 if x.islower() else 2 if x.isupper() else 3 if x.isspace() else 4)] = 1
    out[128, INPUTS - 5 + 1] = 1
    return out


def codes(text: str) -> np.ndarray:
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 128).astype(np.uint8)


def encode(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Training lines as inputs and mask."""
    steps = max(map(len, lines))
    code = np.full((len(lines), steps), CODES - 1, np.uint8)
    for i, x in enumerate(lines):
        code[i, : len(x)] = codes(x)
    return _inputs()[code], (code < CODES - 1).astype(np.float32)


def crf_loss(score: np.ndarray, mask: np.ndarray, tags: np.ndarray, move: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of the tag sequences, and its derivatives by scores and transitions.

    Forward and backward sums are kept as probabilities, scaled to one at each step.  Every sequence has a first
    character; its padding comes last.
    """
    batch, steps, n = score.shape
    top = score.max(axis=2).astype(np.float64)
    emit, pass_ = np.exp(score - top[:, :, None]), np.exp(move.astype(np.float64))
    ahead, behind, scale = np.zeros((batch, steps, n)), np.ones((batch, steps, n)), np.ones((batch, steps))
    ahead[:, 0] = emit[:, 0]
    on = mask > 0
    for t in range(steps):
        if t:
            ahead[:, t] = np.where(on[:, t, None], (ahead[:, t - 1] @ pass_) * emit[:, t], ahead[:, t - 1])
        scale[:, t] = ahead[:, t].sum(axis=1)
        ahead[:, t] /= scale[:, t, None]
    reach = np.zeros((batch, steps, n))
    for t in range(steps - 1, 0, -1):
        reach[:, t] = emit[:, t] * behind[:, t] / scale[:, t, None] * on[:, t, None]
        behind[:, t - 1] = np.where(on[:, t, None], reach[:, t] @ pass_.T, behind[:, t])
    dscore = ahead * behind * mask[:, :, None]
    dmove = pass_ * np.tensordot(ahead[:, :-1], reach[:, 1:], ([0, 1], [0, 1]))
    rows, cols = np.nonzero(on)
    own = tags[rows, cols]
    dscore[rows, cols, own] -= 1
    gold = score[rows, cols, own].sum(dtype=np.float64)
    r, c = np.nonzero(on[:, 1:])
    np.add.at(dmove, (tags[r, c], tags[r, c + 1]), -1)
    gold += move[tags[r, c], tags[r, c + 1]].sum(dtype=np.float64)
    total = (np.log(scale) + np.where(on, top, 0)).sum()
    return float(total - gold) / batch, dscore / batch, dmove / batch


def _sums(score: np.ndarray, on: np.ndarray, move: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The best sums up to each step and tag: steps x tags x windows; ``first`` are those of the first step."""
    best = np.empty_like(score)
    best[0] = first
    for t in range(1, len(score)):
        new = (best[t - 1][:, None] + move[:, :, None]).max(axis=0)
        new += score[t]
        best[t] = new if on[t].all() else np.where(on[t], new, best[t - 1])
    return best


def _back(best: np.ndarray, on: np.ndarray, move: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The way back from the last tags, found from the sums: steps x windows."""
    out = np.zeros((len(best), best.shape[2]), np.int64)
    out[-1] = last
    for t in range(len(best) - 1, 0, -1):
        came = (best[t - 1] + move[:, out[t]]).argmax(axis=0)
        out[t - 1] = np.where(on[t], came, out[t])
    return out


def viterbi(score: np.ndarray, mask: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The best tags of each window.  The best sums are kept, and the way back is found from them."""
    score, on = np.ascontiguousarray(score.transpose(1, 2, 0)), mask.T > 0
    best = _sums(score, on, move, score[0])
    return _back(best, on, move, best[-1].argmax(axis=0)).T


def viterbi_long(scores: list[np.ndarray], move: np.ndarray, part: int = 128) -> list[np.ndarray]:
    """The best tags of long sequences; all their parts are searched side by side, so that a step is one for all of them.

    Each part's sums are first made as if nothing stood before it, then made again from the sums at the end of the part
    before, until they differ from the first ones by one number for all tags: from there on every choice is the same.  Parts
    whose sums differ otherwise up to their end have the next part made again.
    """
    size = np.array([len(x) for x in scores], np.int64)
    number = -(-size // part)
    at = np.append(0, np.cumsum(number))
    parts = int(at[-1])
    padded, real = np.zeros((parts * part, TAGS)), np.zeros(parts * part, bool)
    for x, lo in zip(scores, at[:-1] * part, strict=True):
        padded[lo : lo + len(x)] = x
        real[lo : lo + len(x)] = True
    cut = np.ascontiguousarray(padded.reshape(parts, part, TAGS).transpose(1, 2, 0))  # steps x tags x parts
    on = real.reshape(parts, part).T
    head = np.zeros(parts + 1, bool)
    head[at] = True  # parts with nothing before them, and the end
    wide = move.astype(np.float64)
    best = _sums(cut, on, wide, cut[0])
    again = np.flatnonzero(~head)
    while len(again):
        new = (best[-1][:, again - 1][:, None] + wide[:, :, None]).max(axis=0) + cut[0][:, again]
        for t in range(part):
            apart = new - best[t][:, again]
            best[t][:, again] = new
            differ = apart.max(axis=0) - apart.min(axis=0) > 1e-9
            again, new = again[differ], new[:, differ]
            if t + 1 == part or not len(again):
                break
            step = (new[:, None] + wide[:, :, None]).max(axis=0) + cut[t + 1][:, again]
            new = np.where(on[t + 1, again], step, new)
        again = again[~head[again + 1]] + 1
    # the way back from each tag that may end a part, and then from the one that does
    way = np.zeros((part, TAGS, parts), np.uint8)
    way[-1] = np.arange(TAGS)[:, None]
    column = np.arange(parts)
    for t in range(part - 1, 0, -1):
        before = (best[t - 1][:, None] + wide[:, :, None]).argmax(axis=0)  # of each tag the best one before it
        way[t - 1] = np.where(on[t], before[way[t], column], way[t])
    last = np.zeros(parts, np.int64)
    for k in range(parts - 1, -1, -1):
        into = 0 if head[k + 1] else wide[:, way[0, last[k + 1], k + 1]]
        last[k] = (best[-1][:, k] + into).argmax()
    tags = way[:, last, column].T.reshape(-1).astype(np.int64)
    return [tags[lo : lo + n] for lo, n in zip((at[:-1] * part).tolist(), size.tolist(), strict=True)]


def training_lines(count: int, seed: int) -> list[tuple[str, list[Span]]]:
    """Lines with labelled spans: the four kinds in many forms, and numbers of other kinds."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    digits = lambda n: "".join(str(x) for x in rng.integers(0, 10, n))
    letters = list("etaoinshrdlucmwfgypbvkéèüöñ")

    def word(least: int = 1, most: int = 14) -> str:
        w = "".join(pick(letters) for _ in range(int(rng.integers(least, most + 1))))
        return w.capitalize() if rng.random() < 0.15 else w

    def plain(n: int) -> str:
        return "".join(pick("abcdefghijklmnopqrstuvwxyz") for _ in range(n))

    def card() -> str:
        while True:
            d = pick("3456") + digits(int(pick([14, 14, 14, 13, 15])))
            if luhn(d):
                sep = pick(["", "", " ", "-"])
                return sep.join(d[i : i + 4] for i in range(0, len(d), 4)) if sep else d

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return pick(
            [f"+{pick('123456789')} ({a}) {b}-{c}", f"+{digits(2)} {a} {b} {c}", f"+{digits(1)}-{a}-{b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{digits(2)}{a}{b}{c}", f"+{digits(2)} ({digits(2)}) {b} {c}"]
        )

    def email() -> str:
        user = pick([plain(6), f"{plain(4)}.{plain(6)}", f"{plain(7)}.{digits(2)}", f"{plain(3)}_{plain(5)}", f"{plain(5)}+{plain(3)}"])
        host, end = pick([plain(6), "mail" + digits(1), "example", plain(4) + "-" + plain(4)]), pick(["com", "example.com", "org", "co.uk", "net", "de", "fr", "edu", "io"])
        at = pick(["@"] * 5 + [" at ", " [at] ", "(at)", "[at]", " (at) ", " AT "])
        dot = "." if at == "@" else pick([" dot ", " [dot] ", "(dot)", "[dot]", " (dot) ", " DOT ", "."])
        return f"{user}{at}{host}{dot}{end.replace('.', dot)}"

    make = {"email": email, "ip": lambda: ".".join(str(x) for x in rng.integers(0, 256, 4)), "card": card, "phone": phone}

    def other() -> str:
        return pick(
            [
                digits(4), f"{digits(1)}.{digits(1)}", digits(int(rng.integers(1, 9))), f"20{digits(2)}-0{pick('123456789')}-1{digits(1)}", f"20{digits(2)}-11-2{digits(1)} 1{digits(1)}:{digits(2)}", f"1{digits(1)}:{digits(2)}:{digits(2)}",
                f"version {digits(1)}.", f"v{digits(1)}.{digits(2)}.{digits(1)}", f"{digits(2)}%", f"{digits(1)},{digits(3)},{digits(3)}", f"${digits(3)}.{digits(2)}", f"AKIA{plain(4).upper()}{digits(2)}{plain(6).upper()}",
                "password=" + "".join(pick("0123456789abcdef") for _ in range(18)), 'token = "' + "".join(pick("0123456789abcdef") for _ in range(40)) + '"', f"@{plain(6)}", f"{digits(3)} {digits(2)} {digits(3)} {digits(1)} {digits(2)}",
                f"{digits(2)}/{digits(2)}/{digits(4)}", f"{digits(2)} + {digits(2)}", f"ISBN 978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", f"{digits(4)}-{digits(4)}", f"{digits(20)}", f"{digits(3)}.{digits(3)}", f"{plain(2)}{digits(3)}{plain(2)}{digits(2)}", f"({digits(4)})", f"[{digits(2)}]", f"{word(2)} at {word(2)}", f"{word(3)} at the {word(2)}. {word(2)}", f"a dot {word(2)}", f"[{plain(3)}]", f"({plain(4)})", f"{plain(5)}.{plain(4)}", f"{plain(4)}-{plain(5)}",
            ]
        )

    lines = []
    for _ in range(count):
        text, spans = "", []
        dull = 0.6 * (rng.random() < 0.4)  # much text is words alone
        while len(text) < LINE:
            text += pick(["", " ", " ", "\n"]) if not text else pick([" ", " ", " ", ", ", ". ", "\n", ": "])
            kind = rng.random() + dull
            if kind < 0.3:
                k = pick(KINDS)
                value = make[k]()
                spans.append((k, len(text), len(text) + len(value)))
                text += value
            else:
                text += other() if kind < 0.6 else " ".join(word() for _ in range(int(rng.integers(1, 7))))
        lines.append((text, spans))
    return lines


def tag_row(spans: list[Span], steps: int) -> np.ndarray:
    out = np.zeros(steps, np.int64)
    for kind, a, b in spans:
        k = KINDS.index(kind)
        out[a:b] = 2 + 2 * k
        out[a] = 1 + 2 * k
    return out


@lru_cache(maxsize=1)
def model(lines: int = 6000, epochs: int = 6, seed: int = 6) -> recurrent.Params:
    """Train network and transitions; the same parameters each time."""
    data = training_lines(lines, seed)
    p = recurrent.init(INPUTS, HIDDEN, TAGS, seed)
    p["M"] = np.zeros((TAGS, TAGS), np.float32)
    adam, rng = recurrent.Adam(p, 0.02), np.random.default_rng(seed)
    for epoch in range(epochs):
        adam.rate = 0.02 * 0.65**epoch
        order = rng.permutation(len(data))
        for lo in range(0, len(order), 48):
            own = [data[i] for i in order[lo : lo + 48]]
            x, mask = encode([text for text, _ in own])
            tags = np.stack([tag_row(spans, x.shape[1]) for _, spans in own])
            dmove = np.zeros_like(p["M"])

            def loss(s: np.ndarray, mask=mask, tags=tags, dmove=dmove) -> tuple[float, np.ndarray]:
                value, ds, dm = crf_loss(s, mask, tags, p["M"])
                dmove += dm.astype(np.float32)
                return value, ds.astype(np.float32)

            _, grad = recurrent.gradients(p, x, mask, loss, recurrent.Hard)
            grad["M"] = dmove
            adam.step(grad)
    return p


# --- from windows to spans -----------------------------------------------------------------------------------------


def _states(p: recurrent.Params, side: str, code: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The LSTM's states over windows, steps x hidden x windows; ``size`` is each window's length."""
    n = HIDDEN
    # gates are lines of slope 1/4 through 1/2, put into the weights; rows are units, so that all steps work on whole rows
    stretch, lift = np.full(4 * n, 0.25, np.float32), np.full(4 * n, 0.5, np.float32)
    stretch[3 * n :], lift[3 * n :] = 1, 0
    table = np.ascontiguousarray(((_inputs() @ p[f"W{side}"] + p[f"b{side}"]) * stretch + lift).T.astype(np.float32))
    move = np.ascontiguousarray((p[f"U{side}"] * stretch).T.astype(np.float32))
    steps, count = code.shape
    code = code.astype(np.intp)
    out = np.zeros((steps, n, count), np.float32)
    h, c = np.zeros((n, count), np.float32), np.zeros((n, count), np.float32)
    z, given = np.empty((4 * n, count), np.float32), np.empty((4 * n, count), np.float32)
    gates, new = z[: 3 * n], z[3 * n :]
    uneven = side == "b" and size.min() < steps
    for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
        np.matmul(move, h, out=z)
        np.take(table, code[t], axis=1, out=given, mode="clip")
        z += given
        np.maximum(gates, 0, out=gates)
        np.minimum(gates, 1, out=gates)
        np.maximum(new, -1, out=new)
        np.minimum(new, 1, out=new)
        new *= z[:n]
        c *= z[n : 2 * n]
        c += new
        h = out[t]
        np.maximum(c, -1, out=h)
        np.minimum(h, 1, out=h)
        h *= z[2 * n : 3 * n]
        if uneven:  # a window begins, from behind, at its own end
            on = size > t
            c *= on
            h *= on
    return out


def scores(p: recurrent.Params, text: list[np.ndarray], lo: int = 0, hi: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Averaged scores of all characters of the coded texts, one text after the other, and where each text begins.

    With ``lo`` and ``hi``, those of this part of a single text; its windows lie as for the whole text.
    """
    total = np.array([len(x) for x in text], np.int64)
    at = np.append(0, np.cumsum(total))
    flat = np.concatenate([*text, np.full(SIZE, CODES - 1, np.uint8)])
    number = np.maximum(0, -(-np.maximum(total - (SIZE - STRIDE), (total > 0).astype(int)) // STRIDE))
    of = np.repeat(np.arange(len(text)), number)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(number) - number, number)
    start, size = nth * STRIDE, np.minimum(SIZE, total[of] - nth * STRIDE)
    if hi is not None:
        own = (start < hi) & (start + size > lo)
        of, nth, start, size = of[own], nth[own], start[own], size[own]
    base, end = (lo, hi) if hi is not None else (0, int(at[-1]))
    out = np.zeros((TAGS, end - base), np.float32)
    order = np.argsort(-size, kind="stable")
    # where two windows overlap, a character counts the more in each the further it lies from that window's edge
    ramp = (np.arange(1, SIZE - STRIDE + 1, dtype=np.float32) / (SIZE - STRIDE + 1))[:, None, None]
    for first in range(0, len(order), BATCH):
        own = order[first : first + BATCH]
        steps = int(size[own[0]])
        step = np.arange(steps)
        where = at[of[own]] + start[own] + step[:, None]
        code = flat[where]
        code[step[:, None] >= size[own]] = CODES - 1
        with np.errstate(over="ignore"):
            score = p["V"][:HIDDEN].T @ _states(p, "f", code, size[own])
            score += p["V"][HIDDEN:].T @ _states(p, "b", code, size[own])
        score += p["c"][:, None]
        later, more = start[own] > 0, start[own] + size[own] < total[of[own]]
        head = score[: SIZE - STRIDE]
        head *= np.where(later, ramp[: len(head)], 1)
        if more.any():  # windows with another behind them are full
            score[STRIDE:SIZE] *= np.where(more, 1 - ramp[: steps - STRIDE], 1)
        score = np.ascontiguousarray(score.transpose(2, 1, 0))
        begin = at[of[own]] + start[own]
        for i, (a, n) in enumerate(zip(begin.tolist(), size[own].tolist(), strict=True)):
            x, y = max(a, base), min(a + n, end)
            out[:, x - base : y - base] += score[i, :, x - a : y - a]
    return out.T, at


def _gains(score: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The most that each character can gain inside a stretch of other tags than outside."""
    top = np.maximum(score[:, 1], score[:, 2])
    for k in range(3, TAGS):
        np.maximum(top, score[:, k], out=top)
    return (top - score[:, 0]).astype(np.float64) + (move[1:, 1:].max() - move[0, 0])


def sure(score: np.ndarray, move: np.ndarray, so_far: float = 0.0, least: float = np.inf, most: float = -np.inf) -> np.ndarray:
    """Characters that the best path surely leaves outside.

    A stretch of other tags gains at most its characters' scores above ``outside`` and the best transitions into, inside
    and out of such a stretch.  Where no stretch around a character can gain anything, the path is outside there.  Of a part
    of a text, ``so_far`` are the gains before it, ``least`` their smallest sum yet and ``most`` the largest sum behind it.
    """
    ends = max(0.0, move[0, 1:].max() - move[0, 0]) + max(0.0, move[1:, 0].max() - move[0, 0]) - (move[1:, 1:].max() - move[0, 0])
    total = np.append(so_far, so_far + np.cumsum(_gains(score, move)))
    before = np.minimum(least, np.minimum.accumulate(total)[:-1])
    after = np.maximum(most, np.maximum.accumulate(total[:0:-1])[::-1])
    return after - before + ends < -1e-6


def best_path(score: np.ndarray, edge: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The tags of the best path over each text (``edge``: where texts begin, and the end), exact.

    Paths are only searched between characters that are surely outside.
    """
    tags = np.zeros(len(score), np.int64)
    open_ = ~sure(score, move)
    at = np.flatnonzero(open_)
    if not len(at):
        return tags
    begins = np.zeros(len(score) + 1, bool)
    begins[edge] = True
    first = np.append(True, (np.diff(at) > 1) | begins[at[1:]])
    lo = at[first]
    hi = at[np.append(first[1:], True)] + 1
    lo, hi = np.where(begins[lo], lo, lo - 1), np.where(begins[hi], hi, hi + 1)
    order = np.argsort(lo - hi, kind="stable")
    done = 0
    lone = np.cumsum((hi - lo)[order[: int(((hi - lo) > LONE).sum())]])
    while done < len(lone):  # few and long
        own = order[done : max(done + 1, int(np.searchsorted(lone, (lone[done - 1] if done else 0) + BLOCK // 2)))]
        done += len(own)
        for i, found in zip(own.tolist(), viterbi_long([score[lo[i] : hi[i]] for i in own.tolist()], move), strict=True):
            tags[lo[i] : hi[i]] = found
    while done < len(order):
        steps = int(hi[order[done]] - lo[order[done]])
        own = order[done : done + max(1, 200_000 // steps)]
        own = own[(hi - lo)[own] >= 0.7 * steps]
        done += len(own)
        step = np.arange(steps)
        where = lo[own][:, None] + step
        mask = where < hi[own][:, None]
        found = viterbi(score[np.minimum(where, len(score) - 1)], mask, move)
        tags[where[mask]] = found[mask]
    return tags


def _runs(tags: np.ndarray, offset: int) -> list[Span]:
    kind, begin = (tags + 1) // 2, tags % 2 == 1
    edge = np.flatnonzero(np.append(True, (kind[1:] != kind[:-1]) | begin[1:]))[: len(tags)]
    return [(KINDS[kind[s] - 1], offset + s, offset + e) for s, e in zip(edge.tolist(), [*edge[1:].tolist(), len(tags)], strict=True) if kind[s]]


def long_path(block, size: int, move: np.ndarray, step: int) -> Iterator[tuple[int, np.ndarray]]:
    """The one best path over a very long text, as (start, tags) of its parts; ``block(lo, hi)`` gives scores.

    Scores are made twice: first for the largest sum of gains in each block, so that then each part is cut where a
    character is surely outside whatever stands before and behind it in the whole text.
    """
    edges = [*range(0, size, step), size]
    peaks, total = [], 0.0
    for lo, hi in zip(edges, edges[1:], strict=False):
        sums = total + np.cumsum(_gains(block(lo, hi), move))
        peaks.append(sums.max())
        total = sums[-1]
    behind = [-np.inf]
    for peak in peaks[:0:-1]:
        behind.insert(0, max(behind[0], peak))
    held, begin, so_far, least = np.zeros((0, TAGS), np.float32), 0, 0.0, np.inf
    for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        held = np.concatenate([held, block(lo, hi)])
        if hi == size:
            yield begin, best_path(held, np.array([0, len(held)]), move)
            return
        outside = np.flatnonzero(sure(held, move, so_far, least, behind[i]))
        cut = int(outside[-1]) if len(outside) else 0
        if cut:  # the character at the cut stands in both parts, outside in both
            yield begin, best_path(held[: cut + 1], np.array([0, cut + 1]), move)[:cut]
            sums = so_far + np.cumsum(_gains(held[:cut], move))
            least = min(least, so_far, float(sums.min()))
            held, begin, so_far = held[cut:], begin + cut, float(sums[-1])


def _long(p: recurrent.Params, text: np.ndarray) -> list[Span]:
    """The spans of a very long text, whose scores are made block by block."""
    return [x for begin, tags in long_path(lambda lo, hi: scores(p, [text], lo, hi)[0], len(text), p["M"], BLOCK) for x in _runs(tags, begin)]


def decode(p: recurrent.Params, texts: list[str]) -> list[list[Span]]:
    """Each text's spans by the network."""
    coded = [codes(t) for t in texts]
    if any(len(x) > 2 * BLOCK for x in coded):
        return [_long(p, x) if len(x) else [] for x in coded]
    score, at = scores(p, coded)
    tags = best_path(score, at, p["M"])
    out: list[list[Span]] = [[] for _ in texts]
    busy = np.unique(np.searchsorted(at, np.flatnonzero(tags), "right") - 1)
    for i in busy.tolist():
        out[i] = _runs(tags[at[i] : at[i + 1]], 0)
    return out


_ADDED = {
    "email": re.compile(r"[^\s@]+@[^\s@]+\.[^\s@.,;]+|[A-Za-z0-9._%+-]+ ?[\[(]?(?:at|AT|@)[\])]? ?[A-Za-z0-9-]+(?: ?[\[(]?(?:dot|DOT|\.)[\])]? ?[A-Za-z0-9-]+)*(?: ?[\[(](?:dot|DOT)[\])] ?| (?:dot|DOT) |\.)[A-Za-z]{2,6}"),
    "ip": re.compile(r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"),
    "card": re.compile(r"[0-9](?:[\x20.-]{0,2}[0-9])+"),
    "phone": re.compile(r"(?:\+[0-9]|\([0-9]{2,4}\) ?[0-9]|[0-9]{2,4}[.-][0-9])[\x20().0-9-]*[0-9]"),
}


def valid(kind: str, text: str) -> bool:
    """Whether a span of the network can be of its kind at all."""
    if not _ADDED[kind].fullmatch(text):
        return False
    if kind == "ip":
        return all(int(x) <= 255 for x in text.split("."))
    if kind == "card":
        return card_ok(text)
    if kind == "phone":
        return 9 <= len(_digits(text)) <= 15 and len(re.findall(r"[^0-9]+", text.lstrip("+("))) >= 2
    return True


def all_spans(text: str, base: list[Span], found: list[Span]) -> list[Span]:
    """The base spans, and those of the network that are valid and touch no base span or neighbouring digit."""
    starts, reach, out = [], [], list(base)
    for a, b in sorted((a, b) for _, a, b in base):
        starts.append(a)
        reach.append(max(b, reach[-1]) if reach else b)
    for kind, a, b in found:
        before = bisect_right(starts, b - 1)
        if before and reach[before - 1] > a or not valid(kind, text[a:b]):
            continue
        if (a and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum()):
            continue
        out.append((kind, a, b))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_spans(df: DataFrame) -> DataFrame:
    """(doc_id, text) -> counts of the base patterns' spans, their digest, and all spans.

    Null and empty texts have none.  Texts are read whole; positions count code points; repeated rows give repeated
    results, null ids stay null; an empty table gives an empty result.
    """
    p = df.sparkSession.sparkContext.broadcast(model())  # about 100 kB

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch):
            texts = [t or "" for t in part.column(1).to_pylist()]
            bases = [base_spans(t) for t in texts]
            every = [all_spans(t, b, f) for t, b, f in zip(texts, bases, decode(p.value, texts), strict=True)]
            count = [[sum(k == kind for k, _, _ in b) for b in bases] for kind in KINDS]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(c, pa.int64()) for c in count), pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b in bases]), pa.array([written(e) for e in every])],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    return map_batches(df, run, SCHEMA)


def mask(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind's name in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def masked(df: DataFrame) -> DataFrame:
    """The rows of df, further columns included, with all spans of ``text`` masked; null texts stay null."""
    p = df.sparkSession.sparkContext.broadcast(model())
    place = df.columns.index("text")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch):
            given = part.column(place).to_pylist()
            texts = [t or "" for t in given]
            spans = [all_spans(t, base_spans(t), f) for t, f in zip(texts, decode(p.value, texts), strict=True)]
            new = pa.array([None if t is None else mask(t, s) for t, s in zip(given, spans, strict=True)], pa.string())
            yield part.set_column(place, "text", new)

    return map_batches(df, run, df.schema)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_spans(documents(spark, sf_dir).select(*clean()))

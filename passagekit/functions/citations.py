"""Citations in answers: [1], (Source 2, 3), 【1，2】, [4 @ 1:02-1:05]; and small trees of JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Brackets and what closes them, separators of numbers, dashes, labels.
BRACKETS = {"[": "]", "(": ")", "（": "）", "【": "】", "［": "］"}
SEPARATORS = ",，、"
DASHES = "-–—"
LABELS = ("source", "来源")


# --- whole texts, as columns --------------------------------------------------------------------------------------------


def cited_numbers(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, index) of every number cited, in order; null texts cite nothing.

    A bracket without brackets inside is a citation if what closes it fits, its part before an @ is a list of numbers,
    perhaps after a label, and its part behind the @ is one time or two with a dash between.  A number that no section can
    have, beyond 31 bits, is null.
    """
    ends = "".join(BRACKETS) + "".join(BRACKETS.values())
    body = "".join("\\" + c for c in ends)
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[{body}][^{body}]+(?=([{body}]))"), F.lit(0))
    closing = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[{body}][^{body}]+(?=([{body}]))"), F.lit(1))
    fits = lambda x: F.concat(F.substring(x["open"], 1, 1), x["close"]).isin([a + b for a, b in BRACKETS.items()])
    parts = F.transform(F.filter(F.arrays_zip(found.alias("open"), closing.alias("close")), fits), lambda x: F.split(F.substr(x["open"], F.lit(2)), "@"))
    listed = lambda x: F.split(F.regexp_replace(F.lower(x[0]), f"^(?:{'|'.join(LABELS)})? ?", ""), f"[{SEPARATORS}]")
    timed = lambda x: F.transform(F.split(x, f"[{DASHES}]"), lambda t: F.trim(t))
    number = lambda x: F.forall(listed(x), lambda n: F.trim(n).rlike("^[0-9]+$")) & ~F.lower(x[0]).rlike(f"^(?:{'|'.join(LABELS)})? {{2,}}")
    plain = lambda x: (F.size(x) == 1) & ~x[0].endswith(" ")
    clocks = lambda x: (F.size(x) == 2) & (F.size(timed(x[1])) <= 2) & F.forall(timed(x[1]), lambda t: t.rlike("^[0-9]+:[0-9]{2}(:[0-9]{2})?$")) & ~x[1].endswith(" ")
    numbers = F.flatten(F.transform(F.filter(parts, lambda x: number(x) & (plain(x) | clocks(x))), lambda x: F.transform(listed(x), lambda n: F.trim(n))))
    return df.select(key, F.posexplode(numbers).alias("pos", "index")).withColumn("index", F.col("index").try_cast("int"))


# --- text that is still being written -----------------------------------------------------------------------------------

#: Where a reader of a bracket stands, and where each kind of character leads it; what is not listed is no citation.
#: d: digit, s: separator, -: dash, other characters stand for themselves.
_NEXT = {
    "open": {" ": "first", "d": "number"},
    "labelled": {" ": "first", "d": "number"},
    "first": {"d": "number"},
    "number": {"d": "number", " ": "behind", "s": "more", "@": "at"},
    "behind": {" ": "behind", "s": "more", "@": "at"},
    "more": {" ": "more", "d": "number"},
    "at": {" ": "at", "d": "hours"},
    "to": {" ": "to", "d": "hours "},
    "rest": {" ": "rest", "-": "to"},
}
for _end in ("", " "):  # the first time may lead to a second one, whose places have a space behind their names
    _NEXT |= {
        f"hours{_end}": {"d": f"hours{_end}", ":": f"tens{_end}"},
        f"tens{_end}": {"d": f"ones{_end}"},
        f"ones{_end}": {"d": f"full{_end}"},
        f"full{_end}": {":": f"ten{_end}"} | ({} if _end else {" ": "rest", "-": "to"}),
        f"ten{_end}": {"d": f"one{_end}"},
        f"one{_end}": {"d": f"done{_end}"},
        f"done{_end}": {} if _end else {" ": "rest", "-": "to"},
    }
_MAY_CLOSE = ("number", "full", "done", "full ", "done ")
for _label in LABELS:
    for _i, _c in enumerate(_label):
        _NEXT.setdefault(_label[:_i] or "open", {})[_c] = "labelled" if _i + 1 == len(_label) else _label[: _i + 1]


def _kind(c: str) -> str:
    return "d" if c in "0123456789" else "s" if c in SEPARATORS else "-" if c in DASHES else c.lower()


def scan(text: str) -> Iterator[tuple[int, int, list[int]]]:
    """Start, end and numbers of each citation; at last, with end 0, the start of a bracket that may still become one."""
    at = 0
    while at < len(text):
        if text[at] not in BRACKETS:
            at += 1
            continue
        state, numbers, here = "open", [], at + 1
        while here < len(text):
            c = text[here]
            if c == BRACKETS[text[at]] and state in _MAY_CLOSE:
                yield at, here + 1, [int(n) for n in numbers]
                break
            kind = _kind(c)
            after = _NEXT[state].get(kind)
            if after is None:
                here = at
                break
            if after == "number":
                numbers = [*numbers[:-1], numbers[-1] + c] if state == "number" else [*numbers, c]
            state, here = after, here + 1
        else:
            yield at, 0, []
            here = at
        at = here + 1


def _told(text: str, known: set[int]) -> tuple[list[tuple[str, str]], int]:
    """Events of a text, and where an end that may become a citation begins."""
    out, at, open_ = [], 0, len(text)
    for start, end, numbers in scan(text):
        if not end:
            open_ = min(open_, start)
            continue
        if start > at:
            out.append(("text", text[at:start]))
        out += [("citation", str(n)) if n in known else ("text", text[start:end] if len(numbers) == 1 else str(n)) for n in numbers]
        at = end
    if at < open_:
        out.append(("text", text[at:open_]))
    return out, open_


def events(text: str, known: set[int]) -> list[tuple[str, str]]:
    """("text", part) and ("citation", number) of a text to which nothing is added.

    A lone unknown number stays as it was written; among others it becomes its digits.
    """
    out, end = _told(text, known)
    return [*out, ("text", text[end:])] if end < len(text) else out


def feed(held: str, delta: str, known: set[int]) -> tuple[list[tuple[str, str]], str]:
    """Events of a stream's next part after what was held, and what is held now: an end that may become a citation."""
    out, end = _told(held + delta, known)
    return out, (held + delta)[end:]


def _nodes(tree: str | None) -> Iterator[tuple[str, str | None, str | None]]:
    """(path, parent's path, label) of all nodes, each before its children."""
    try:
        root = json.loads(tree or "null")
    except (ValueError, RecursionError):
        return
    open_ = [("0", None, root)]
    while open_:
        path, parent, node = open_.pop()
        if not isinstance(node, dict):
            continue
        label, kids = node.get("label"), node.get("children")
        yield path, parent, label if isinstance(label, str) or label is None else json.dumps(label, ensure_ascii=False)
        if isinstance(kids, list):
            open_ += [(f"{path}.{i}", path, kid) for i, kid in reversed(list(enumerate(kids)))]


def tree_paths(df: DataFrame, key: str, tree: str) -> DataFrame:
    """(key, path, parent, label) of each node of {"label", "children"} trees, however deep; the root's path is 0.

    A missing label is null, missing or null children are none, and children that are no objects go.  A text that is no
    JSON, or nested beyond what its parser takes, has no nodes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = list(_nodes(batch.column(1)[i].as_py()))
                if rows:
                    own = batch.column(0).take(pa.array([i] * len(rows)))
                    yield pa.RecordBatch.from_arrays([own, *(pa.array(c, pa.string()) for c in zip(*rows, strict=True))], [key, "path", "parent", "label"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, tree).mapInArrow(run, f"{key} {kind}, path string, parent string, label string")

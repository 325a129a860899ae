"""HTML pages by hand: broken markup in linear time, and layouts that the training pages don't copy."""

import time

import pytest

from passagekit.llm.html_text import label, leaf_blocks, main_text, model

A = "The river rose quickly over the night and by the morning the lower town was under water. People left their houses by boat."
B = "Nobody was hurt, the fire brigade said, but the old bridge will have to stay closed until the autumn at least."

BROKEN = {
    "select": ("<p>a</p>" + "<select>" * 125_000, ["a"]),
    "noscript": ("<noscript>" * 100_000 + "x", ["x"]),
    "unmatched": ("<div>" * 10_000 + "x" + "</span>" * 140_000 + "y", ["xy"]),
    "quotes": ("a" + "<a '" * 250_000, ["a"]),
    "both quotes": ("a" + "<a \"'" * 200_000, ["a"]),
    "svg": ("a" + '<svg "' * 170_000, ["a"]),
    "signs": ("<" * 1_000_000, ["<" * 1_000_000]),
    "titles": ("a" + "<title>" * 140_000, ["a"]),
    "comments": ("a" + "<!--" * 250_000, ["a"]),
    "end tags": ("a<svg></svg " + "</svg    " * 100_000, ["a"]),
}


@pytest.mark.parametrize("name", sorted(BROKEN))
def test_a_broken_megabyte_takes_seconds(name):
    html, want = BROKEN[name]
    start = time.process_time()
    assert [b.text for b in leaf_blocks(html)] == want
    assert time.process_time() - start < 5


def test_tags():
    texts = lambda html: [b.text for b in leaf_blocks(html)]
    assert texts('<p title="a>b">x</p>') == ["x"]
    assert texts('<p title="a>x</p>') == ["x"]  # a mark without a partner is a character
    assert texts("1 < 2 <b>x</b> <SELECT><option>no</SELECT><p>y") == ["1 < 2 x", "y"]
    assert texts("a<svg/>b<svg><text>no</text></svg>c<svg>d") == ["abc", "d"]
    assert texts("<title>no <b>x</title>y<textarea>no") == ["x", "y"]
    assert texts("<p>x<p>y</div></p>z<script>no") == ["x", "y", "z"]
    assert texts("x <p") == ["x"] and texts("") == [] and texts("<") == ["<"]


LAYOUTS = {
    "replies": (
        f'<html><body><header><h1>Site</h1></header><nav><a href=/>Home</a> <a href=/b>News</a></nav><article><h1>Flood in town</h1><p>{A}</p><p>{B}</p></article>'
        '<div id="respond"><h3>Replies</h3><p>I saw it happen myself.</p><p>Very sad to read this.</p></div><footer>&copy; 2021 Site</footer></body></html>',
        f"Flood in town {A} {B}",
    ),
    "figure": (
        f"<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>Flood in town</h1><p>{A}</p><figure><img src=a><figcaption>The lower town at noon.</figcaption></figure><p>{B}</p>"
        "</article><footer>About us</footer></body></html>",
        f"Flood in town {A} The lower town at noon. {B}",
    ),
    "bare": (f"{A}<br>{B}", f"{A} {B}"),
    "table": (
        f'<html><body><div class="nav"><a href=/>Home</a></div><main><h2>Rain by month</h2><p>{A}</p><table><tr><th>Month</th><th>Rain</th></tr><tr><td>May</td><td>120 mm</td></tr></table>'
        f'<p>{B}</p></main><aside class="sidebar"><h4>Most read</h4><ul><li><a href=/1>One</a></li><li><a href=/2>Two</a></li></ul></aside></body></html>',
        f"Rain by month {A} Month Rain May 120 mm {B}",
    ),
    "divs": (
        f'<html><body><div id="top"><a href=/>Home</a> | <a href=/x>Contact</a></div><div id="page"><h1>Flood</h1><div>{A}</div><div>{B}</div></div>'
        '<div class="subscribe">Subscribe to our letter <form><input><button>Go</button></form></div><div id="bottom">All rights reserved 2020</div></body></html>',
        f"Flood {A} {B}",
    ),
    "long": (f"<body><nav><a href=/>Home</a></nav><article>{'<p><b>' + A + '<br>' + '<p>' + B + '</p>'}" + f"<p>{A}</p>" * 60 + "</article><footer>End</footer>", " ".join([A, B] + [A] * 60)),
}


@pytest.mark.parametrize("name", sorted(LAYOUTS))
def test_layouts_by_hand(name):
    html, want = LAYOUTS[name]
    blocks = leaf_blocks(html)
    (own,) = label(model(), [blocks])
    assert " ".join(b.text for b, ok in zip(blocks, own.tolist(), strict=True) if ok) == want


def test_main_text_against_its_parts(spark):
    """Batches of pages give what each page gives alone."""
    pages = [html for html, _ in BROKEN.values() if len(html) < 700_000] + [html for html, _ in LAYOUTS.values()] + ["", "<p>", None]
    got = main_text(spark.createDataFrame([(i, "u", h) for i, h in enumerate(pages)], "page_id long, url string, html string").repartition(3)).collect()
    for r in got:
        blocks = leaf_blocks(pages[r.page_id] or "")
        (own,) = label(model(), [blocks])
        assert r.text == " ".join(b.text for b, ok in zip(blocks, own.tolist(), strict=True) if ok) and r.n_chars == len(r.text)
    assert len(got) == len(pages)

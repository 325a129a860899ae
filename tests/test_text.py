"""Text functions by example."""

import pytest
from pyspark.sql import functions as F

from passagekit.functions import cjk as H
from passagekit.functions import text as X
from passagekit.functions.citations import events, feed


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


L = F.lit


@pytest.mark.parametrize(
    ("seconds", "hms", "mmss"), [(0, "0:00", "00:00"), (5, "0:05", "00:05"), (65, "1:05", "01:05"), (3661, "1:01:01", "61:01"), (59, "0:59", "00:59"), (3725, "1:02:05", "62:05"), (None, "0:00", "00:00")]
)
def test_times(spark, seconds, hms, mmss):
    s = L(seconds).cast("double")
    assert value(spark, F.struct(X.format_hms(s).alias("a"), X.format_mmss(s).alias("b"))) == (hms, mmss)


def test_fence_header(spark):
    assert value(spark, X.fence_header(L(3), L("My Show"), L(2), L(600.0), L(1200.0))) == '===== [3] "My Show" · Section 2 (10:00–20:00) ====='


@pytest.mark.parametrize(("raw", "n"), [("-3", None), ("eight", None), ("", None), ("8.5", None), (" 8 ", 8), ("8.0", 8), ("0", None), (None, None), ("true", None)])
def test_facets(spark, raw, n):
    assert value(spark, X.facet_int(L(raw).cast("string"))) == n


@pytest.mark.parametrize(("raw", "n"), [('{"score": 4}', 4), ('```json\n{"score": 3}\n```', 3), ('{"score": 7}', None), ("no", None), ('{"score": 2.5}', 2), (None, None)])
def test_grades(spark, raw, n):
    assert value(spark, X.parse_grade(L(raw).cast("string"))) == n


@pytest.mark.parametrize(("raw", "n"), [("[3]", 3), ("[ 12 ] as said", 12), ("4", 4), ("4 or so", None), ("[Source 2]", None), ("none", None)])
def test_section_reference(spark, raw, n):
    assert value(spark, X.section_reference(L(raw))) == n


def test_captions(spark):
    words = "word " * 40
    assert value(spark, X.truncate_caption(L("short"))) == "short"
    assert value(spark, X.truncate_caption(L(words))) == ("word " * 24).rstrip() + "…"
    assert value(spark, X.truncate_caption(L("x" * 200))) == "x" * 120 + "…"


def test_han_tokens(spark):
    assert value(spark, H.query_tokens(L("面食做法"))) == ["面食", "食做", "做法"]
    assert value(spark, H.query_tokens(L("中文 生日"))) == ["中文", "生日"]
    assert value(spark, H.query_tokens(L("多少岁"))) == ["多少", "少岁"]
    assert value(spark, H.query_tokens(L("machine 学习"))) == ["machine", "学习"]
    assert value(spark, H.query_tokens(L("茶"))) == ["茶"]
    assert value(spark, H.index_tokens(L("面食 ab"))) == ["面", "食", "面食", "ab"]


def test_homophones(spark):
    syllables = F.create_map(*(L(x) for x in ("苹", "ping", "平", "ping", "果", "guo")))
    assert value(spark, H.syllable_tokens(L("苹果"), syllables)) == value(spark, H.syllable_tokens(L("平果"), syllables)) == ["pingguo"]
    assert value(spark, H.syllable_tokens(L("茶"), syllables)) == []


KNOWN = {1, 2, 3}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("see [1] there", [("text", "see "), ("citation", "1"), ("text", " there")]),
        ("[1,2]", [("citation", "1"), ("citation", "2")]),
        ("【1，2】", [("citation", "1"), ("citation", "2")]),
        ("[1、2]", [("citation", "1"), ("citation", "2")]),
        ("[1,7]", [("citation", "1"), ("text", "7")]),
        ("see [Source 7]", [("text", "see "), ("text", "[Source 7]")]),
        ("(来源 2 @ 1:02-1:05)", [("citation", "2")]),
        ("[2)", [("text", "[2)")]),
    ],
)
def test_citations(text, want):
    assert list(events(text, KNOWN)) == want


@pytest.mark.parametrize("text", ["see [1] and [Source 2, 3] or (x) [7] [1", "a【1，2】b[3 @ 1:02-1:05] [Sour", "((1)) [[2]] [9,1]"])
@pytest.mark.parametrize("step", [1, 2, 3, 5])
def test_citations_in_parts_equal_the_whole(text, step):
    held, out = "", []
    for at in range(0, len(text), step):
        new, held = feed(held, text[at : at + step], KNOWN)
        out += new
    out += events(held, set())

    def merged(pairs):
        done = []
        for kind, content in pairs:
            if done and kind == "text" == done[-1][0]:
                done[-1] = ("text", done[-1][1] + content)
            else:
                done.append((kind, content))
        return done

    assert merged(out) == merged(events(text, KNOWN))


def test_citations_of_columns_equal_those_of_the_reader(spark):
    from passagekit.functions.citations import cited_numbers, scan

    texts = ["[1] (2, 3)", "[[4]]", "(1] [2)", "[Source 5 @ 1:02]", "[source  6]", "【来源7，8】[9 @ 1:02 - 1:03:04]", "[10 ]", "[11 @ 1:2]", "[12 ,13]", "［14］(x)[15", "[1@2:00–3:00] [ 16]", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {}
    for r in cited_numbers(df, "k", "t").orderBy("k", "pos").collect():
        got.setdefault(r.k, []).append(r["index"])
    assert got == {i: n for i, t in enumerate(texts) if (n := [x for _, end, ns in scan(t) if end for x in ns])}


def test_merged_settings(spark):
    merged = X.merged_deep(L('{"a": {"b": 1, "c": 2}, "d": 3}'), L('{"a": {"c": null}, "e": "x"}'))
    assert value(spark, merged) == '{"a":{"b":1,"c":null},"d":3,"e":"x"}'


def test_over_long_numbers_and_section_references(spark):
    """One odd answer must not stop a job: numbers that fit no section are null."""
    from passagekit.functions import citations, text

    long = "99999999999999999999"
    cited = spark.createDataFrame([(1, f"see [{long}] and [2, {long}, 3]"), (2, f"[{'7,' * 600000}8]")], "doc_id long, text string")
    got = citations.cited_numbers(cited, "doc_id", "text")
    assert [r["index"] for r in got.where("doc_id = 1").orderBy("pos").collect()] == [None, 2, None, 3]
    assert got.where("doc_id = 2").count() == 600_001  # a bracket is read whole, however long
    rows = [("[4] \"title\"", 4), ("source 3", 3), ("Source [3]", 3), (" 5 ", 5), ("[ 6 ] any text [7]", 6), ("7]", 7), ("[section 3]", None), ("Episode 5 talk", None), ("5 talk", None), (f"[{long}]", None), (None, None)]
    df = spark.createDataFrame(rows, "raw string, n int")
    assert df.select(text.section_reference(F.col("raw")).alias("got"), "n").where("NOT got <=> n").collect() == []
    rows = [(long, None), ("9007199254740993", 9007199254740993), ("9007199254740993.00", 9007199254740993), (" +7. ", 7), ("-3", None), ("0", None), ("1.5", None), (f"v_p{long}", None)]
    df = spark.createDataFrame(rows, "raw string, n long")
    assert df.select(text.facet_int(F.col("raw")).alias("got"), "n").where("NOT got <=> n").collect() == []
    odd = spark.createDataFrame([(f"v_p{long}", f"http://a?p={long}")], "video string, url string").select(text.split_video_id(F.col("video"))[1].alias("part"), text.part_number(F.col("url")).alias("page"))
    assert odd.collect()[0] == (None, None)

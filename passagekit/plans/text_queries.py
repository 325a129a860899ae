"""Registered queries of text functions, citations and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import citations as Q
from ..functions import cjk as H
from ..functions import text as X
from ..operators import evaluation as V
from ..sources import tables as T
from .registry import query


def documents(spark: SparkSession, d: str, *columns: object) -> DataFrame:
    return T.table(spark, d, "documents").select(F.col("doc_id"), *columns)


@query(
    "format_hms",
    """SELECT source_id, CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') ELSE (s // 60) || ':' || lpad((s % 60)::VARCHAR, 2, '0') END AS hms
       FROM (SELECT source_id, coalesce(duration_seconds, 0) * 10 AS s FROM src)""",
)
def format_hms(spark: SparkSession, d: str) -> DataFrame:
    return T.sources(spark, d).select("source_id", X.format_hms(F.col("duration_seconds") * 10).alias("hms"))


@query("format_mmss", "SELECT source_id, lpad((s // 60)::VARCHAR, greatest(2, length((s // 60)::VARCHAR))::INT, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS mmss FROM (SELECT source_id, coalesce(duration_seconds, 0) * 10 AS s FROM src)")
def format_mmss(spark: SparkSession, d: str) -> DataFrame:
    return T.sources(spark, d).select("source_id", X.format_mmss(F.col("duration_seconds") * 10).alias("mmss"))


@query("human_duration", "SELECT source_id, CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' ELSE (s % 3600 // 60) || 'm' END AS said FROM (SELECT source_id, coalesce(duration_seconds, 0) * 10 AS s FROM src)")
def human_duration(spark: SparkSession, d: str) -> DataFrame:
    return T.sources(spark, d).select("source_id", X.human_duration(F.col("duration_seconds") * 10).alias("said"))


RAW = "CASE doc_id % 8 WHEN 0 THEN ' ' || doc_id || ' ' WHEN 1 THEN doc_id || '.0' WHEN 2 THEN '-3' WHEN 3 THEN 'eight' WHEN 4 THEN '' WHEN 5 THEN '8.5' WHEN 6 THEN '0' ELSE '99999999999999999999' END"


@query("facet_int", f"SELECT doc_id, CASE WHEN regexp_full_match(trim(raw), '[+-]?[0-9]+(\\.0*)?') AND TRY_CAST(split_part(trim(raw), '.', 1) AS BIGINT) >= 1 THEN TRY_CAST(split_part(trim(raw), '.', 1) AS BIGINT) END AS n FROM (SELECT doc_id, {RAW} AS raw FROM documents)")
def facet_int(spark: SparkSession, d: str) -> DataFrame:
    i, s = F.col("doc_id"), F.col("doc_id").cast("string")
    raw = F.when(i % 8 == 0, F.concat(F.lit(" "), s, F.lit(" "))).when(i % 8 == 1, F.concat(s, F.lit(".0")))
    for k, v in {2: "-3", 3: "eight", 4: "", 5: "8.5", 6: "0"}.items():
        raw = raw.when(i % 8 == k, v)
    raw = raw.otherwise("99999999999999999999")
    return documents(spark, d, X.facet_int(raw).alias("n"))


@query(
    "caption_truncate",
    """SELECT doc_id, CASE WHEN length(text) <= 120 THEN text ELSE rtrim(substring(text, 1, CASE WHEN contains(head, ' ') AND 120 - instr(reverse(head), ' ') >= 60 THEN 120 - instr(reverse(head), ' ') ELSE 120 END), ' ') || '…' END AS caption
       FROM (SELECT doc_id, replace(text, chr(10), ' ') AS text, substring(replace(text, chr(10), ' '), 1, 120) AS head FROM documents)""",
)
def caption_truncate(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d, X.truncate_caption(F.replace("text", F.lit("\n"), F.lit(" "))).alias("caption"))


VIDEO = "CASE doc_id % 3 WHEN 0 THEN 'BV' || doc_id || '_p' || (doc_id % 12) WHEN 1 THEN 'BV' || doc_id ELSE 'a_px' || doc_id END"


@query("video_id_split", f"SELECT doc_id, CASE WHEN regexp_matches(v, '^.+_p[0-9]+$') THEN regexp_extract(v, '^(.+?)_p([0-9]+)$', 1) ELSE v END AS base, CASE WHEN regexp_matches(v, '^.+_p[0-9]+$') THEN regexp_extract(v, '^(.+?)_p([0-9]+)$', 2)::INT END AS part FROM (SELECT doc_id, {VIDEO} AS v FROM documents)")
def video_id_split(spark: SparkSession, d: str) -> DataFrame:
    i, s = F.col("doc_id"), F.col("doc_id").cast("string")
    v = F.when(i % 3 == 0, F.concat(F.lit("BV"), s, F.lit("_p"), (i % 12).cast("string"))).when(i % 3 == 1, F.concat(F.lit("BV"), s)).otherwise(F.concat(F.lit("a_px"), s))
    base, part = X.split_video_id(v)
    return documents(spark, d, base.alias("base"), part.alias("part"))


@query("paragraph_blocks", r"SELECT doc_id, generate_subscripts(p, 1) - 1 AS pos, md5(unnest(p)) AS text_md5 FROM (SELECT doc_id, list_filter(string_split_regex(text, '\n{2,}'), lambda x: x <> '') AS p FROM documents)")
def paragraph_blocks(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d, F.posexplode(X.paragraphs(F.col("text"))).alias("pos", "x")).select("doc_id", "pos", F.md5("x").alias("text_md5"))


@query("token_counts", r"SELECT doc_id, (length(h) + ceil((length(text) - length(h)) / 4))::INT AS tokens FROM (SELECT doc_id, text, regexp_replace(text, '[^\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]', '', 'g') AS h FROM documents)")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d, X.count_tokens(F.col("text")).alias("tokens"))


@query("word_tokens", r"SELECT doc_id, md5(array_to_string(w, ' ')) AS words_md5, len(w)::INT AS n FROM (SELECT doc_id, regexp_extract_all(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[\p{L}\p{N}]+') AS w FROM documents)")
def word_tokens(spark: SparkSession, d: str) -> DataFrame:
    w = X.word_tokens(F.col("text"))
    return documents(spark, d, F.md5(F.array_join(w, " ")).alias("words_md5"), F.size(w).alias("n"))


@query("word_truncate", r"SELECT doc_id, CASE WHEN len(w) <= 20 THEN text ELSE array_to_string(w[1:20], ' ') || chr(10) || '[...truncated...]' END AS short FROM (SELECT doc_id, text, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents)")
def word_truncate(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d, X.truncate_words(F.col("text"), 20).alias("short"))


@query("word_counts", r"SELECT doc_id, (CASE WHEN n >= greatest(1.0, length(text) / 10) THEN n ELSE floor(length(text) / 1.5) END)::INT AS words FROM (SELECT doc_id, text, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS n FROM documents)")
def word_counts(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d, X.count_words(F.col("text")).alias("words"))


_COUNTED = r"(SELECT CASE WHEN len(w) >= greatest(1.0, length({t}) / 10) THEN len(w) ELSE floor(length({t}) / 1.5) END FROM (SELECT list_filter(string_split_regex({t}, '\s+'), lambda x: x <> '') AS w))"


@query(
    "compression_ratio",
    f"""SELECT lang, sum(words)::BIGINT AS words, sum(facts)::BIGINT AS fact_words, (sum(words) // greatest(1, sum(facts)))::BIGINT AS ratio
        FROM (SELECT lang, {_COUNTED.format(t="text")}::BIGINT AS words, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE {_COUNTED.format(t="head")}::BIGINT END AS facts FROM (SELECT doc_id, lang, text, substring(text, 1, 200) AS head FROM documents)) GROUP BY lang""",
)
def compression_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Words of each language's texts for one word of what is kept of them: two hundred characters, of two texts in three."""
    kept = F.when(F.col("doc_id") % 3 == 0, 0).otherwise(X.count_words(F.substring("text", 1, 200)))
    each = documents(spark, d, F.col("lang"), X.count_words(F.col("text")).alias("words"), kept.alias("facts"))
    return X.compression(each, "lang")


@query("artifact_names", r"SELECT doc_id, CASE WHEN length(l) > 60 THEN substring(l, 1, 60) || '…' ELSE l END AS name FROM (SELECT doc_id, trim(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1]) AS l FROM documents)")
def artifact_names(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d, X.artifact_name(F.col("text")).alias("name"))


@query("secrets_masked", "SELECT c_custkey, CASE WHEN length(c_name) <= 8 THEN '***' ELSE left(c_name, 4) || '...' || right(c_name, 4) END AS masked, CASE WHEN length(c_mktsegment) <= 8 THEN '***' ELSE left(c_mktsegment, 4) || '...' || right(c_mktsegment, 4) END AS short FROM customer")
def secrets_masked(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "customer").select("c_custkey", X.mask_secret(F.col("c_name")).alias("masked"), X.mask_secret(F.col("c_mktsegment")).alias("short"))



def _han() -> Column:
    """Han text for the token functions, as the tables have none: each document's number in Han figures, in two runs."""
    figures = lambda c: F.translate(c.cast("string"), "0123456789", "零一二三四五六七八九")
    return F.concat(figures(F.col("doc_id")), F.lit(" ab "), figures(F.col("doc_id") * 7))


@query(
    "cjk_tokens_index",
    """SELECT doc_id, array_to_string(list_concat(list_concat(list_concat(string_split(a, ''), CASE WHEN length(a) > 1 THEN list_transform(range(1, length(a)), lambda i: substring(a, i, 2)) ELSE [] END), ['ab']),
              list_concat(string_split(b, ''), CASE WHEN length(b) > 1 THEN list_transform(range(1, length(b)), lambda i: substring(b, i, 2)) ELSE [] END)), ' ') AS tokens
       FROM (SELECT doc_id, translate(doc_id::VARCHAR, '0123456789', '零一二三四五六七八九') AS a, translate((doc_id * 7)::VARCHAR, '0123456789', '零一二三四五六七八九') AS b FROM documents)""",
)
def cjk_tokens_index(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d, F.array_join(H.index_tokens(_han()), " ").alias("tokens"))


@query(
    "cjk_tokens_query",
    """SELECT doc_id, array_to_string(list_concat(list_concat(CASE WHEN length(a) > 1 THEN list_transform(range(1, length(a)), lambda i: substring(a, i, 2)) ELSE [a] END, ['ab']),
              CASE WHEN length(b) > 1 THEN list_transform(range(1, length(b)), lambda i: substring(b, i, 2)) ELSE [b] END), ' ') AS tokens
       FROM (SELECT doc_id, translate(doc_id::VARCHAR, '0123456789', '零一二三四五六七八九') AS a, translate((doc_id * 7)::VARCHAR, '0123456789', '零一二三四五六七八九') AS b FROM documents)""",
)
def cjk_tokens_query(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d, F.array_join(H.query_tokens(_han()), " ").alias("tokens"))


@query(
    "thumbnail_argmax",
    """SELECT page_id, CASE WHEN max(w * h) IS NOT NULL THEN arg_max(url, (w * h, -i)) ELSE arg_max(url, i) END AS url FROM (
         SELECT page_id, i, url || '#' || i AS url, CASE WHEN page_id % 5 <> 0 THEN (page_id * i) % 7 + 1 END AS w, CASE WHEN page_id % 5 <> 0 THEN (page_id + i) % 3 + 1 END AS h FROM pages, (SELECT unnest([1, 2, 3, 4]) AS i)) GROUP BY page_id""",
)
def thumbnail_argmax(spark: SparkSession, d: str) -> DataFrame:
    i, p = F.col("i"), F.col("page_id")
    t = T.table(spark, d, "pages").select("page_id", F.explode(F.array(*(F.lit(k) for k in (1, 2, 3, 4)))).alias("i"), "url")
    area = F.when(p % 5 != 0, ((p * i) % 7 + 1) * ((p + i) % 3 + 1))
    t = t.select("page_id", "i", F.concat("url", F.lit("#"), i.cast("string")).alias("url"), area.alias("area"))
    return t.groupBy("page_id").agg(F.coalesce(F.max_by("url", F.when(F.col("area").isNotNull(), F.struct("area", -i))), F.max_by("url", "i")).alias("url"))


@query(
    "mindmap_paths",
    """WITH RECURSIVE made AS (SELECT doc_id, list_reduce(list_prepend('{"label":"leaf","children":[]}', [i::VARCHAR FOR i IN range(1, (doc_id % 40)::BIGINT + 1)]),
           lambda tree, i: CASE WHEN i::INT % 3 = 0 THEN '{"children":[' ELSE '{"label":"n' || i || '","children":[' END || tree || CASE WHEN i::INT % 2 = 0 THEN ',{"label":"side' || i || '"}' ELSE '' END || ']}') AS tree FROM documents),
         descent AS (SELECT doc_id, '0' AS path, NULL::VARCHAR AS parent, tree::JSON AS node FROM made
           UNION ALL SELECT doc_id, path || '.' || i, path, json_extract(node, '$.children[' || i || ']') FROM (SELECT *, unnest(range(0, coalesce(json_array_length(node, '$.children'), 0)::BIGINT)) AS i FROM descent))
       SELECT doc_id, path, parent, json_extract_string(node, '$.label') AS label FROM descent""",
)
def mindmap_paths(spark: SparkSession, d: str) -> DataFrame:
    """Trees of depth 1 to 40, with missing labels, side branches, and leaves with and without a list of children."""
    i = lambda x: x.cast("string")
    side = lambda x: F.when(x % 2 == 0, F.concat(F.lit(',{"label":"side'), i(x), F.lit('"}'))).otherwise("")
    head = lambda x: F.when(x % 3 == 0, '{"children":[').otherwise(F.concat(F.lit('{"label":"n'), i(x), F.lit('","children":[')))
    depth = F.col("doc_id") % 40
    levels = F.when(depth > 0, F.sequence(F.lit(1).cast("long"), F.greatest(depth, F.lit(1)))).otherwise(F.array().cast("array<bigint>"))
    tree = F.aggregate(levels, F.lit('{"label":"leaf","children":[]}'), lambda inner, x: F.concat(head(x), inner, side(x), F.lit("]}")))
    fenced = F.concat(F.lit("```json\n"), tree, F.lit("\n```"))
    return Q.tree_paths(documents(spark, d, X.strip_fences(fenced).alias("tree")), "doc_id", "tree")


@query(
    "section_jump",
    """SELECT source_id, coalesce(min(section_seq) FILTER (WHERE timestamp_start <= asked AND asked <= timestamp_end), 0) AS section_seq
       FROM (SELECT source_id, section_seq, timestamp_start, timestamp_end, source_id % 500 AS asked FROM section) GROUP BY source_id""",
)
def section_jump(spark: SparkSession, d: str) -> DataFrame:
    """The first section that holds a time, both ends included; else the first."""
    from .retrieval_queries import sections

    asked = F.col("source_id") % 500
    inside = (F.col("timestamp_start") <= asked) & (asked <= F.col("timestamp_end"))
    return sections(spark, d).groupBy("source_id").agg(F.coalesce(F.min(F.when(inside, F.col("section_seq"))), F.lit(0)).alias("section_seq"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    n = (i % 9).cast("string")
    text = (
        F.when(i % 4 == 0, F.concat(F.lit("As said ["), n, F.lit("] and (Source 2, 3).")))
        .when(i % 4 == 1, F.concat(F.lit("See 【1，"), n, F.lit("】 or [4 @ 1:02-1:05] here")))
        .when(i % 4 == 2, "No [12] nor [2) or [x]")
        .otherwise("Ends in [")
    )
    return documents(spark, d, text.alias("text"))


#: The answers of ``_answers``, and the numbers in their brackets by DuckDB's own regular expressions.
BRACKETED = r"""SELECT doc_id, generate_subscripts(p, 1) - 1 AS pos, unnest(p)::BIGINT AS n FROM (
    SELECT doc_id, flatten([regexp_extract_all(regexp_replace(x, ' *@.*', ''), '[0-9]+') FOR x IN
        regexp_extract_all(t, '\[(?:Source|来源)? ?\d+(?: *[,，、] *\d+)*(?: *@ *[\d:]+(?: *[-–—] *[\d:]+)?)?\]|\((?:Source|来源)? ?\d+(?: *[,，、] *\d+)*\)|【(?:Source|来源)? ?\d+(?: *[,，、] *\d+)*】')]) AS p
    FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'As said [' || (doc_id % 9) || '] and (Source 2, 3).' WHEN 1 THEN 'See 【1，' || (doc_id % 9) || '】 or [4 @ 1:02-1:05] here' WHEN 2 THEN 'No [12] nor [2) or [x]' ELSE 'Ends in [' END AS t FROM documents))"""


#: Every fifth answer ends in a number that no section can have.
OVER_LONG = BRACKETED.replace("END AS t FROM documents", "END || CASE WHEN doc_id % 5 = 0 THEN ' [99999999999]' ELSE '' END AS t FROM documents")


@query("citations_batch", f"SELECT doc_id, pos, TRY_CAST(n AS INT)::BIGINT AS index, TRY_CAST(n AS INT) BETWEEN 1 AND 5 AS known FROM ({OVER_LONG})")
def citations_batch(spark: SparkSession, d: str) -> DataFrame:
    """Numbers cited by whole answers; five sections are known."""
    answers = _answers(spark, d).withColumn("text", F.concat("text", F.when(F.col("doc_id") % 5 == 0, " [99999999999]").otherwise("")))
    cited = Q.cited_numbers(answers, "doc_id", "text")
    return cited.select("doc_id", "pos", F.col("index").cast("long").alias("index"), F.col("index").between(1, 5).alias("known"))


# --- evaluation ------------------------------------------------------------------------------------------------------

@query(
    "grade_parse",
    r"""SELECT doc_id, score, CASE WHEN score IS NULL THEN 'no score from 1 to 5' END AS reason FROM (SELECT doc_id, CASE WHEN n BETWEEN 1 AND 5 THEN n::INT END AS score FROM (
         SELECT doc_id, round_even(TRY_CAST(CASE WHEN json_valid(body) THEN json_extract_string(body, '$.score') END AS DOUBLE), 0) AS n FROM (
           SELECT doc_id, regexp_replace(regexp_replace(trim(raw), '^```[a-z]*\s*', ''), '\s*```$', '') AS body FROM (
             SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '{"score": ' || (doc_id % 8) || '}' WHEN 1 THEN '```json' || chr(10) || '{"score": 3}' || chr(10) || '```' WHEN 2 THEN 'not JSON' WHEN 3 THEN '{"score": 2.5}' WHEN 4 THEN '{"score": 3.5}' ELSE '{"score": true}' END AS raw FROM documents))))""",
)
def grade_parse(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    raw = (
        F.when(i % 6 == 0, F.concat(F.lit('{"score": '), (i % 8).cast("string"), F.lit("}")))
        .when(i % 6 == 1, '```json\n{"score": 3}\n```')
        .when(i % 6 == 2, "not JSON")
        .when(i % 6 == 3, '{"score": 2.5}')
        .when(i % 6 == 4, '{"score": 3.5}')
        .otherwise('{"score": true}')
    )
    return V.parsed_grades(documents(spark, d, raw.alias("raw"))).select("doc_id", "score", "reason")


MEANS = ", ".join(f"coalesce(round_even(avg({x}), 1), 0) AS {x}" for x in V.DIMENSIONS)
SCORES = f"SELECT run_id, category, {MEANS} FROM grade GROUP BY run_id, category UNION ALL SELECT run_id, 'overall', {MEANS} FROM grade GROUP BY run_id"


@query("eval_aggregate", SCORES)
def eval_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return V.aggregate(T.grades(spark, d))


@query("eval_failures", "SELECT run_id, " + ", ".join(f"count(*) FILTER (WHERE {x} IS NULL) AS {x}" for x in V.DIMENSIONS) + " FROM grade GROUP BY run_id")
def eval_failures(spark: SparkSession, d: str) -> DataFrame:
    return V.failures(T.grades(spark, d))


@query("eval_diff", f"WITH s AS ({SCORES}) SELECT a.category, " + ", ".join(f"round_even(a.{x} - b.{x}, 1) AS {x}" for x in V.DIMENSIONS) + " FROM s a JOIN s b ON a.category = b.category WHERE a.run_id = 2 AND b.run_id = 1")
def eval_diff(spark: SparkSession, d: str) -> DataFrame:
    return V.difference(V.aggregate(T.grades(spark, d)), 2, 1)


def _cell(x: str) -> str:
    change = f"round_even(a.{x} - b.{x}, 1)"
    return f"trim(printf('%.1f', a.{x}) || ' ' || CASE WHEN b.{x} IS NULL THEN '' WHEN {change} = 0 THEN '(=)' WHEN {change} > 0 THEN '(+' || printf('%.1f', {change}) || ')' ELSE '(' || printf('%.1f', {change}) || ')' END) AS {x}"


@query("eval_report_rows", f"WITH s AS ({SCORES}) SELECT a.category, {', '.join(map(_cell, V.DIMENSIONS))} FROM s a LEFT JOIN s b ON a.category = b.category AND b.run_id = 1 WHERE a.run_id = 2")
def eval_report_rows(spark: SparkSession, d: str) -> DataFrame:
    return V.report(V.aggregate(T.grades(spark, d)), 2, 1)


@query("eval_case_counts", "SELECT category, count(*) AS n, count(*) FILTER (WHERE context_relevance IS NOT NULL) AS graded FROM grade WHERE run_id = 1 GROUP BY category")
def eval_case_counts(spark: SparkSession, d: str) -> DataFrame:
    return T.grades(spark, d).where("run_id = 1").groupBy("category").agg(F.count("*").alias("n"), F.count("context_relevance").alias("graded"))


@query("turn_split", "SELECT message_id, turn >= coalesce(max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conversation_id), 0) AS this_turn FROM msg")
def turn_split(spark: SparkSession, d: str) -> DataFrame:
    """Messages before and from the last user message on."""
    w = Window.partitionBy("conversation_id")
    last = F.max(F.when(F.col("role") == "user", F.col("turn"))).over(w)
    return T.messages(spark, d).select("message_id", (F.col("turn") >= F.coalesce(last, F.lit(0))).alias("this_turn"))

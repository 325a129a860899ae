"""Registered queries of section digests, prompts, evaluation sets and small text functions.

Where a query needs a model, a stand-in answers that SQL can state as well: it names the length of its prompt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cjk as H
from ..functions import text as X
from ..operators import digests as D
from ..operators import evaluation as V
from ..operators import evidence as E
from ..operators import segmentation as S
from ..sources import tables as T
from .registry import query
from .retrieval_queries import SECTION_TURNS, sections
from .turn_queries import text


def told_length(prompts: list[str]) -> list[str]:
    return [f"{len(p)} characters" for p in prompts]


def failing_length(prompts: list[str]) -> list[str]:
    """As told_length, but prompts of an odd length fail."""
    if any(len(p) % 2 for p in prompts):
        raise ValueError("odd")
    return told_length(prompts)


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return E.section_texts(T.segments(spark, d), sections(spark, d))


# --- digests ------------------------------------------------------------------------------------------------------------

#: Fixed by the fold: a section's digest names the length of the lines before it and of its text.
FOLD = f"""WITH RECURSIVE txt AS (SELECT source_id, section_seq, length(text) AS n FROM ({SECTION_TURNS})),
    fold AS (SELECT source_id, section_seq, n || ' characters' AS digest, length('[S1] ' || n || ' characters') AS before FROM txt WHERE section_seq = 0
             UNION ALL SELECT t.source_id, t.section_seq, (f.before + 1 + t.n) || ' characters', f.before + 1 + length('[S' || (t.section_seq + 1) || '] ' || (f.before + 1 + t.n) || ' characters')
             FROM fold f JOIN txt t ON t.source_id = f.source_id AND t.section_seq = f.section_seq + 1)"""


@query("section_digests", f"{FOLD} SELECT source_id, section_seq, digest FROM fold")
def section_digests(spark: SparkSession, d: str) -> DataFrame:
    return D.digest_sections(_texts(spark, d), told_length).select("source_id", "section_seq", "digest")


@query(
    "refined_drafts",
    f"""WITH RECURSIVE part AS (SELECT source_id, section_seq, length(text) AS n FROM ({SECTION_TURNS})),
    bat AS (SELECT source_id, section_seq // 3 AS batch, sum(n + 1) - 1 AS n FROM part GROUP BY ALL),
    fold AS (SELECT source_id, batch, n || ' characters' AS draft FROM bat WHERE batch = 0
             UNION ALL SELECT b.source_id, b.batch, (length('Draft: ' || f.draft) + 1 + b.n)::BIGINT || ' characters' FROM fold f JOIN bat b ON b.source_id = f.source_id AND b.batch = f.batch + 1)
    SELECT source_id, arg_max(draft, batch) AS draft FROM fold GROUP BY source_id""",
)
def refined_drafts(spark: SparkSession, d: str) -> DataFrame:
    """Drafts over batches of three sections, each batch read with the draft so far."""
    some = _texts(spark, d).withColumn("batch", F.floor(F.col("section_seq") / 3).cast("int"))
    batches = some.groupBy("source_id", "batch").agg(E.joined("text", "section_seq").alias("text"))
    return D.refine(batches, told_length).select("source_id", "draft")


@query("section_views", f"WITH txt AS ({SECTION_TURNS}) SELECT s.source_id, s.ord, x.section_seq, md5(text) AS text_md5, CASE WHEN x.section_seq IS NULL THEN 'no sections' WHEN text IS NULL THEN 'no text' END AS error FROM (SELECT source_id, 1000000 - source_id AS ord FROM src) s LEFT JOIN section x USING (source_id) LEFT JOIN (SELECT * FROM txt WHERE section_seq <> 2) t ON t.source_id = x.source_id AND t.section_seq = x.section_seq")
def section_views(spark: SparkSession, d: str) -> DataFrame:
    """Every third section has lost its text."""
    chosen = T.sources(spark, d).select("source_id", (1_000_000 - F.col("source_id")).alias("ord"))
    out = D.section_views(chosen, sections(spark, d).select("source_id", "section_seq"), _texts(spark, d).where("section_seq != 2"))
    return out.select("source_id", "ord", "section_seq", F.md5("text").alias("text_md5"), "error")


@query("section_digest_zip", "SELECT source_id, section_seq, CASE WHEN source_id % 3 <> 0 THEN 'd' || section_seq END AS digest, CASE WHEN source_id % 3 = 0 THEN 'lengths differ' END AS error FROM section")
def section_digest_zip(spark: SparkSession, d: str) -> DataFrame:
    """Every third source has a digest too many."""
    s = sections(spark, d).select("source_id", "section_seq")
    one = s.select("source_id", F.col("section_seq").alias("ord"), text("d", F.col("section_seq")).alias("digest"))
    more = s.where("section_seq = 0 AND source_id % 3 = 0").select("source_id", F.lit(1_000_000).alias("ord"), F.lit("extra").alias("digest"))
    return D.zipped(s, one.unionByName(more))


CLOCK2 = "lpad((floor({x})::BIGINT // 60)::VARCHAR, greatest(2, length((floor({x})::BIGINT // 60)::VARCHAR))::INT, '0') || ':' || lpad((floor({x})::BIGINT % 60)::VARCHAR, 2, '0')"


@query("batch_headers", f"SELECT source_id, section_seq, '=== Source: ' || title || ' · Section ' || (section_seq + 1) || ' (' || {CLOCK2.format(x='timestamp_start')} || '-' || {CLOCK2.format(x='timestamp_end')} || ') ===' AS header, CASE WHEN token_count > 460 THEN 'section of ' || token_count || ' tokens exceeds 460' END AS error FROM section JOIN src USING (source_id)")
def batch_headers(spark: SparkSession, d: str) -> DataFrame:
    budget = D.batch_budget(2960, 1000)
    s = sections(spark, d).join(T.sources(spark, d).select("source_id", "title"), "source_id")
    header = D.batch_header(F.col("title"), F.col("section_seq") + 1, F.col("timestamp_start"), F.col("timestamp_end"))
    return s.select("source_id", "section_seq", header.alias("header"), D.over_batch(F.col("token_count"), budget).alias("error"))


@query("capped_keywords", "SELECT doc_id, list_filter([trim(x) FOR x IN string_split(coalesce(text, ''), ' ')], lambda x: x <> '')[1:8] AS words FROM documents")
def capped_keywords(spark: SparkSession, d: str) -> DataFrame:
    """The first eight words that are not blank."""
    doc = T.table(spark, d, "documents")
    return doc.select("doc_id", D.capped_keywords(F.split(F.coalesce("text", F.lit("")), " ")).alias("words"))


@query("failure_precedence", "SELECT source_id, CASE WHEN source_id % 3 = 0 THEN 'digest failed' WHEN source_id % 5 = 0 THEN 'embedding failed' END AS error FROM src")
def failure_precedence(spark: SparkSession, d: str) -> DataFrame:
    """Of two steps that ran side by side the digest's error counts first."""
    i = F.col("source_id")
    failed = T.sources(spark, d).select("source_id", F.when(i % 3 == 0, "digest failed").alias("a"), F.when(i % 5 == 0, "embedding failed").alias("b"))
    return failed.select("source_id", F.coalesce("a", "b").alias("error"))


# --- prompts and names --------------------------------------------------------------------------------------------------


@query("language_names", "SELECT doc_id, CASE lower(trim(lang)) WHEN 'en' THEN 'English' WHEN 'zh' THEN '中文' WHEN 'de' THEN 'Deutsch' WHEN 'fr' THEN 'Français' WHEN 'es' THEN 'Español' WHEN 'ja' THEN '日本語' ELSE 'English' END AS name, 'Answer in ' || CASE lower(trim(lang)) WHEN 'en' THEN 'English' WHEN 'zh' THEN '中文' WHEN 'de' THEN 'Deutsch' WHEN 'fr' THEN 'Français' WHEN 'es' THEN 'Español' WHEN 'ja' THEN '日本語' ELSE 'English' END || '.' AS directive FROM documents")
def language_names(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.turns import language_name

    name = language_name(F.col("lang"))
    return T.table(spark, d, "documents").select("doc_id", name.alias("name"), F.concat(F.lit("Answer in "), name, F.lit(".")).alias("directive"))


@query("digest_prompts", "SELECT source_id, 'Summarise \"' || title || '\"' || CASE WHEN language IS NULL THEN '' ELSE ' in ' || language END || '.' || chr(10) || 'Season ' || season_number || coalesce(', episode ' || sequence_number, '') AS prompt FROM src")
def digest_prompts(spark: SparkSession, d: str) -> DataFrame:
    """What is known of a source goes into its prompt; what is not leaves no trace."""
    told = F.concat(F.lit('Summarise "'), "title", F.lit('"'), F.coalesce(F.concat(F.lit(" in "), "language"), F.lit("")), F.lit(".\n"), text("Season ", F.col("season_number")), F.coalesce(text(", episode ", F.col("sequence_number")), F.lit("")))
    return T.sources(spark, d).select("source_id", told.alias("prompt"))


@query("composed_questions", "SELECT source_id, 'Tell me about \"' || title || '\" in ' || coalesce(language, 'any language') || '.' || coalesce(' (season ' || season_number || coalesce(', episode ' || sequence_number, '') || ')', '') AS question FROM src")
def composed_questions(spark: SparkSession, d: str) -> DataFrame:
    hint = F.concat_ws(", ", text("season ", F.col("season_number")), text("episode ", F.col("sequence_number")))
    q = F.concat(F.lit('Tell me about "'), "title", F.lit('" in '), F.coalesce("language", F.lit("any language")), F.lit("."), F.when(hint != "", F.concat(F.lit(" ("), hint, F.lit(")"))).otherwise(""))
    return T.sources(spark, d).select("source_id", q.alias("question"))


@query("composite_titles", "SELECT source_id, CASE WHEN source_id % 3 = 0 THEN title WHEN source_id % 3 = 1 THEN 'Part ' || source_id || ' - ' || title ELSE title END AS title FROM src")
def composite_titles(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("source_id")
    part = F.when(i % 3 == 0, F.col("title")).when(i % 3 == 1, text("Part ", i)).otherwise(" ")
    return T.sources(spark, d).select("source_id", X.composite_title(part, F.col("title")).alias("title"))


@query("sequence_indexes", "SELECT chunk_id, chunk_index AS n, NULL::INT AS none FROM chunk")
def sequence_indexes(spark: SparkSession, d: str) -> DataFrame:
    c = T.chunks(spark, d)
    return c.select("chunk_id", X.sequence_index(F.col("chunk_id")).alias("n"), X.sequence_index(F.concat("chunk_id", F.lit("_x"))).alias("none"))


@query("chunk_defaults", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Title ' || doc_id ELSE '' END AS title, CASE WHEN doc_id % 3 = 0 THEN doc_id::DOUBLE ELSE 0 END AS start, CASE WHEN doc_id % 5 = 0 THEN doc_id::INT END AS seg_start FROM documents")
def chunk_defaults(spark: SparkSession, d: str) -> DataFrame:
    """What a stored chunk lacks: texts are empty, times zero, ranges unknown."""
    i = F.col("doc_id")
    raw = T.table(spark, d, "documents").select("doc_id", F.when(i % 2 == 0, text("Title ", i)).alias("t"), F.when(i % 3 == 0, i.cast("double")).alias("s"), F.when(i % 5 == 0, i.cast("int")).alias("seg_start"))
    return raw.select("doc_id", F.coalesce("t", F.lit("")).alias("title"), F.coalesce("s", F.lit(0.0)).alias("start"), "seg_start")


@query("cleaned_texts", r"""SELECT doc_id, md5(regexp_replace(regexp_replace('<|zh|>' || text, '<\|[^|]*\|>', '', 'g'), chr(27) || '\[[0-9;]*[A-Za-z]', '', 'g')) AS text_md5, regexp_matches(rtrim(text), '[。！？．…!?]$') AS ends, nullif(trim(lang), 'en') AS facet FROM documents WHERE text IS NOT NULL""")
def cleaned_texts(spark: SparkSession, d: str) -> DataFrame:
    """Marks of a recogniser and of a terminal go; whether a text ends a sentence; a facet that is blank is none."""
    t = T.table(spark, d, "documents").where("text IS NOT NULL")
    marked = F.concat(F.lit("<|zh|>\x1b[1;31m"), "text", F.lit("\x1b[0m"))
    blank = F.when(F.col("lang") == "en", "  ").otherwise(F.concat(F.lit(" "), "lang", F.lit(" ")))
    return t.select("doc_id", F.md5(X.strip_ansi(X.strip_tags(marked))).alias("text_md5"), X.ends_sentence(F.col("text")).alias("ends"), X.clean_facet(blank).alias("facet"))


@query("blocks_text", "SELECT doc_id, md5(lang || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) ELSE '' END || source) AS text_md5 FROM documents")
def blocks_text(spark: SparkSession, d: str) -> DataFrame:
    block = lambda kind, content: F.struct(kind.alias("kind"), content.alias("content"))
    middle = F.when(F.col("doc_id") % 2 == 0, "break").otherwise("citation")
    blocks = F.array(block(F.lit("text"), F.concat("lang", F.lit("[[cite:12]]"))), block(middle, F.lit("3")), block(F.lit("text"), F.col("source")))
    return T.table(spark, d, "documents").select("doc_id", F.md5(X.blocks_text(blocks)).alias("text_md5"))


@query("iso_times", "SELECT source_id, strftime(make_timestamp(processed_at * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS at, processed_at AS back FROM src")
def iso_times(spark: SparkSession, d: str) -> DataFrame:
    at = X.iso_time(F.col("processed_at"))
    return T.sources(spark, d).select("source_id", at.alias("at"), X.from_iso(at).alias("back"))


@query("merged_settings", """SELECT doc_id, '{"a":' || doc_id || ',"b":{"c":{"d":1,"e":' || doc_id || '},"x":"' || lang || '"},"n":null,"z":true}' AS merged FROM documents WHERE lang IS NOT NULL""")
def merged_settings(spark: SparkSession, d: str) -> DataFrame:
    """Objects inside objects; the patch's values win, its nulls too."""
    i = F.col("doc_id").cast("string")
    base = F.concat(F.lit('{"a":1,"b":{"c":{"d":1,"e":2},"x":"'), "lang", F.lit('"},"n":5}'))
    patch = F.concat(F.lit('{"a":'), i, F.lit(',"b":{"c":{"e":'), i, F.lit('}},"n":null,"z":true}'))
    return T.table(spark, d, "documents").where("lang IS NOT NULL").select("doc_id", X.merged_deep(base, patch).alias("merged"))


HAN = "('01', '苹果'), ('23', '平国'), ('45', '地敌'), ('67', '方房'), ('89', '中终')"


@query("collapsed_spaces", "SELECT doc_id, translate(doc_id::VARCHAR, '0123456789', '苹果平国地敌方房中终') || ' ab' AS text FROM documents")
def collapsed_spaces(spark: SparkSession, d: str) -> DataFrame:
    """White space goes between Han characters and stays elsewhere."""
    han = F.translate(F.col("doc_id").cast("string"), "0123456789", "苹果平国地敌方房中终")
    spaced = F.array_join(F.filter(F.split(han, ""), lambda x: x != ""), " \n")
    return T.table(spark, d, "documents").select("doc_id", H.collapse_spaces(F.concat(spaced, F.lit(" ab"))).alias("text"))


# --- evaluation sets ----------------------------------------------------------------------------------------------------


def _cases(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("item_id")
    return T.table(spark, d, "benchmark").select(i.alias("case_id"), text("cat", i % 9).alias("category"), F.col("text").alias("question"), (i % 3 != 0).alias("locked"))


@query("locked_cases", "SELECT item_id AS case_id FROM benchmark WHERE item_id % 3 <> 0")
def locked_cases(spark: SparkSession, d: str) -> DataFrame:
    return _cases(spark, d).where("locked").select("case_id")


@query("cases_by_category", "SELECT 'cat' || (item_id % 9) AS category, list(item_id ORDER BY item_id) AS cases FROM benchmark GROUP BY 1")
def cases_by_category(spark: SparkSession, d: str) -> DataFrame:
    return _cases(spark, d).groupBy("category").agg(F.array_sort(F.collect_list("case_id")).alias("cases"))


@query("case_runs", "SELECT item_id AS case_id, CASE WHEN length(text) % 2 = 0 THEN length(text) || ' characters' END AS answer, CASE WHEN length(text) % 2 = 1 THEN 'ValueError: odd' END AS error FROM benchmark WHERE item_id % 3 <> 0")
def case_runs(spark: SparkSession, d: str) -> DataFrame:
    """Locked cases are run; those whose question has an odd length fail, and no others with them."""
    return D.run_cases(_cases(spark, d), failing_length)


@query("run_outcomes", "SELECT count(*) FILTER (WHERE length(text) % 2 = 0) AS passed, count(*) FILTER (WHERE length(text) % 2 = 1) AS failed FROM benchmark WHERE item_id % 3 <> 0")
def run_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return case_runs(spark, d).agg(F.count_if(F.col("error").isNull()).alias("passed"), F.count_if(F.col("error").isNotNull()).alias("failed"))


@query("extracted_facts", "SELECT doc_id AS source_id, CASE WHEN length(text) % 2 = 0 THEN [length(text) || ' characters'] END AS facts, CASE WHEN length(text) % 2 = 1 THEN 'ValueError: odd' END AS error FROM documents")
def extracted_facts(spark: SparkSession, d: str) -> DataFrame:
    return D.extracted_facts(T.table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), "text"), failing_length)


@query("fact_blocks", "SELECT doc_id AS source_id, '# Title ' || doc_id || chr(10) || '1. ' || lang || chr(10) || '2. ' || source AS block FROM documents WHERE doc_id % 4 <> 0")
def fact_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Sources without facts have no block."""
    i = F.col("doc_id")
    facts = T.table(spark, d, "documents").select(i.alias("source_id"), text("Title ", i).alias("title"), F.when(i % 4 != 0, F.array("lang", "source")).otherwise(F.array().cast("array<string>")).alias("facts"))
    return D.fact_blocks(facts)


@query("generated_questions", "SELECT c AS category, doc_id AS source_id, 0 AS pos, length('category ' || c || ', ' || n || ' questions' || chr(10) || '# Title ' || doc_id || chr(10) || '1. ' || lang || chr(10) || '2. ' || source) || ' characters' AS question FROM documents, (VALUES ('fact', 5), ('causal', 3)) q(c, n) WHERE doc_id % 4 <> 0 AND lang IS NOT NULL")
def generated_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions of two known categories; a third is unknown."""
    return D.questions_of({"fact": 5, "causal": 3, "none": 2}, fact_blocks(spark, d).where("block IS NOT NULL"), told_length, ["fact", "causal"])


@query("question_counts", "SELECT 'cat' || c AS category, 3 + CASE WHEN c % 2 = 0 THEN 2 ELSE 0 END AS n FROM (SELECT DISTINCT item_id % 9 AS c FROM benchmark)")
def question_counts(spark: SparkSession, d: str) -> DataFrame:
    c = T.table(spark, d, "benchmark").select((F.col("item_id") % 9).alias("c")).distinct()
    return V.question_counts(c.select(text("cat", F.col("c")).alias("category"), (F.col("c") % 2 == 0).alias("marked")))


@query("mapped_responses", "SELECT item_id AS case_id, CASE item_id % 3 WHEN 0 THEN 'a' || item_id || chr(10) || 'c' WHEN 1 THEN 'whole' ELSE '' END AS context FROM benchmark")
def mapped_responses(spark: SparkSession, d: str) -> DataFrame:
    """A third of the cases has calls with sections, a third a call without, a third a call that was not cited."""
    i = F.col("item_id")
    part = lambda t, c: F.struct(t.alias("text"), F.lit(c).alias("cited"))
    none = F.array().cast("array<struct<text:string,cited:boolean>>")
    some = F.array(part(text("a", i), True), part(F.lit("b"), False), part(F.lit("c"), True))
    call = F.struct(F.when(i % 3 == 0, some).otherwise(none).alias("sections"), F.lit("whole").alias("text"), (i % 3 == 1).alias("cited"))
    r = T.table(spark, d, "benchmark").select(i.alias("case_id"), F.lit("x").alias("answer"), F.array(call).alias("tool_calls"))
    return D.mapped_response(r).select("case_id", "context")


def length_judge(prompts: list[str]) -> list[str]:
    """A judge that scores by the length of its prompt, and says nothing of use to lengths that leave 0 by 7."""
    return ['{"score": %d}' % (len(p) % 5 + 1) if len(p) % 7 else "no idea" for p in prompts]


@query(
    "judged_cases",
    """WITH c AS (SELECT item_id AS case_id, CASE item_id % 4 WHEN 0 THEN 'causal_absent' WHEN 1 THEN 'coverage' ELSE 'fact' END AS category, length(text) AS q, length(CASE WHEN item_id % 5 = 0 THEN '(no answer)' ELSE 'answer' END) AS a, length(CASE WHEN item_id % 7 = 0 THEN '(no context)' ELSE 'context' END) AS x FROM benchmark),
    k AS (SELECT case_id, category, q + a + x + 3 AS n, unnest(CASE category WHEN 'causal_absent' THEN ['absence'] WHEN 'coverage' THEN ['context_relevance', 'groundedness', 'coverage'] ELSE ['context_relevance', 'groundedness', 'answer_relevance'] END) AS kind FROM c),
    s AS (SELECT case_id, kind, CASE WHEN (n + length(kind)) % 7 > 0 THEN (n + length(kind)) % 5 + 1 WHEN (n + length(kind) + 6) % 7 > 0 THEN (n + length(kind) + 6) % 5 + 1 END AS score FROM k)
    SELECT case_id, max(score) FILTER (WHERE kind IN ('absence', 'context_relevance'))::INT AS context_relevance, max(score) FILTER (WHERE kind IN ('absence', 'groundedness'))::INT AS groundedness, max(score) FILTER (WHERE kind IN ('absence', 'answer_relevance', 'coverage'))::INT AS answer_relevance FROM s GROUP BY case_id""",
)
def judged_cases(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("item_id")
    kind = F.when(i % 4 == 0, "causal_absent").when(i % 4 == 1, "coverage").otherwise("fact")
    cases = T.table(spark, d, "benchmark").select(i.alias("case_id"), kind.alias("category"), F.col("text").alias("question"), F.when(i % 5 != 0, "answer").alias("answer"), F.when(i % 7 != 0, "context").alias("context"))
    return D.judged(cases, length_judge)


@query(
    "full_report",
    """SELECT g.case_id, coalesce('cat' || CASE WHEN g.case_id % 10 <> 0 THEN g.case_id % 9 END, 'unknown') AS category, CASE WHEN g.case_id % 4 <> 0 THEN 'answer ' || g.case_id END AS answer, g.answer_relevance AS score, g.answer_relevance - p.answer_relevance AS change
       FROM grade g LEFT JOIN (SELECT * FROM grade WHERE run_id = 1) p USING (case_id) WHERE g.run_id = 2""",
)
def full_report(spark: SparkSession, d: str) -> DataFrame:
    """Grades with their cases, the run's answers and the grades before."""
    from ..operators.activity import report_cases

    i = F.col("case_id")
    answers = _cases(spark, d).where("case_id % 4 != 0").select("case_id", text("answer ", i).alias("answer"))
    out = report_cases(_cases(spark, d).where("case_id % 10 != 0"), T.grades(spark, d), 2, 1, "answer_relevance")
    return out.join(answers, "case_id", "left").select("case_id", "category", "answer", "score", "change")


@query("language_targets", "SELECT source_id, CASE language WHEN 'zh' THEN 800 ELSE 300 END AS target FROM src")
def language_targets(spark: SparkSession, d: str) -> DataFrame:
    return T.sources(spark, d).select("source_id", S.target_of(F.col("language")).alias("target"))

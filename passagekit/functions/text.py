"""Text, time and parsing functions from Column to Column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HAN = r"\u4e00-\u9fff\u3400-\u4dbf"
SENTENCE_ENDS = "。！？．…!?"
# Accented Latin letters and what they fold to.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def count_tokens(text: Column) -> Column:
    """Estimated tokens: one for each Han character and one for each four others."""
    han = F.length(F.regexp_replace(text, f"[^{HAN}]+", ""))
    return (han + F.ceil((F.length(text) - han) / 4)).cast("int")


def word_tokens(text: Column) -> Column:
    """Lower case, accents folded, runs of letters and digits."""
    return F.regexp_extract_all(F.translate(F.lower(text), ACCENTED, PLAIN), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def format_hms(seconds: Column) -> Column:
    """M:SS, or H:MM:SS from an hour on; null is 0:00; fractions are cut."""
    s = F.coalesce(seconds, F.lit(0)).cast("long")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), two(m), F.lit(":"), two(s % 60))).otherwise(F.concat(m.cast("string"), F.lit(":"), two(s % 60)))


def format_mmss(seconds: Column) -> Column:
    """MM:SS; minutes count on past sixty."""
    s = F.coalesce(seconds, F.lit(0)).cast("long")
    minutes = F.floor(s / 60).cast("string")
    return F.concat(F.lpad(minutes, F.greatest(F.lit(2), F.length(minutes)), F.lit("0")), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def format_clock(seconds: Column) -> Column:
    """Like format_hms, but rounded to the nearest second."""
    return format_hms(F.floor(seconds + 0.5))


def human_duration(seconds: Column) -> Column:
    """Xh Ym, or Ym below an hour."""
    s = F.coalesce(seconds, F.lit(0)).cast("long")
    h, m = F.floor(s / 3600).cast("string"), F.floor(s % 3600 / 60).cast("string")
    return F.when(s >= 3600, F.concat(h, F.lit("h "), m, F.lit("m"))).otherwise(F.concat(m, F.lit("m")))


def facet_int(raw: Column) -> Column:
    """An integer of at least 1 from text: trimmed, integral decimals accepted, anything else and beyond 63 bits null."""
    n = F.regexp_extract(F.trim(raw), r"^([+-]?[0-9]+)(?:\.0*)?$", 1).try_cast("long")
    return F.when(n >= 1, n)


def clean_facet(raw: Column) -> Column:
    return F.nullif(F.trim(raw), F.lit(""))


def truncate_caption(text: Column, limit: int = 120, least: int = 60) -> Column:
    """At most ``limit`` characters: cut at the last space at ``least`` or later, else at the limit."""
    head = F.substring(text, 1, limit)
    last = F.lit(limit) - F.instr(F.reverse(head), " ")  # 0-based place of the last space
    at = F.when((F.instr(head, " ") > 0) & (last >= least), last).otherwise(F.lit(limit))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.substring(text, F.lit(1), at)), F.lit("…")))


def split_video_id(video: Column) -> tuple[Column, Column]:
    """Base id and part number of ids that end in _p and digits; a number beyond 31 bits is null."""
    base = F.regexp_extract(video, r"^(.+?)_p([0-9]+)$", 1)
    part = F.regexp_extract(video, r"^(.+?)_p([0-9]+)$", 2)
    return F.when(base != "", base).otherwise(video), part.try_cast("int")


def ends_sentence(text: Column) -> Column:
    return F.rtrim(text).rlike(f"[{SENTENCE_ENDS}]$")


def host_matches(host: Column, domain: Column) -> Column:
    return (host == domain) | F.endswith(host, F.concat(F.lit("."), domain))


def paragraphs(text: Column) -> Column:
    """Non-empty parts between blank lines."""
    return F.filter(F.split(text, r"\n{2,}"), lambda x: x != "")


def strip_tags(text: Column) -> Column:
    """Without <|...|> markers."""
    return F.regexp_replace(text, r"<\|[^|]*\|>", "")


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, "\\x1b\\[[0-9;]*[A-Za-z]", "")


def mask_secret(value: Column) -> Column:
    """*** for up to eight characters, else the first and the last four."""
    return F.when(F.length(value) <= 8, F.lit("***")).otherwise(F.concat(F.left(value, F.lit(4)), F.lit("..."), F.right(value, F.lit(4))))


def count_words(text: Column) -> Column:
    """White-space tokens if these are at least a tenth of the characters, else characters by 1.5."""
    n = F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != ""))
    return F.when(n >= F.greatest(F.lit(1.0), F.length(text) / 10), n).otherwise(F.floor(F.length(text) / 1.5)).cast("int")


def truncate_words(text: Column, most: int) -> Column:
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != "")
    return F.when(F.size(words) <= most, text).otherwise(F.concat(F.array_join(F.slice(words, 1, most), " "), F.lit("\n[...truncated...]")))


def artifact_name(text: Column) -> Column:
    """The first line that is not blank, sixty characters of it."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    line = F.trim(F.element_at(lines, 1))
    return F.when(F.length(line) > 60, F.concat(F.substring(line, 1, 60), F.lit("…"))).otherwise(line)


def strip_fences(text: Column) -> Column:
    """The inside of a code fence, or the text itself."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def parse_grade(raw: Column) -> Column:
    """The number under "score" of a JSON answer, rounded half to even; null unless 1 to 5."""
    n = F.bround(F.get_json_object(strip_fences(raw), "$.score").try_cast("double"), 0).cast("int")
    return F.when(n.between(1, 5), n)


def signed_change(now: Column, before: Column) -> Column:
    d = F.bround(now - before, 1)
    return F.when(before.isNull() | now.isNull(), F.lit("")).when(d == 0, F.lit("(=)")).when(d > 0, F.concat(F.lit("(+"), d.cast("string"), F.lit(")"))).otherwise(F.concat(F.lit("("), d.cast("string"), F.lit(")")))


def fence_header(index: Column, title: Column, section: Column, start: Column, end: Column) -> Column:
    return F.concat(
        F.lit("===== ["), index.cast("string"), F.lit('] "'), title, F.lit('" · Section '), section.cast("string"), F.lit(" ("), format_hms(start), F.lit("–"), format_hms(end), F.lit(") =====")
    )


#: Fixed value: how a section is named: a number, perhaps after a label and in a bracket; after the bracket any text.
SECTION_REFERENCE = r"(?i)^\s*(?:source\s*)?\[?\s*([0-9]+)\s*(?:\].*|)$"


def section_reference(raw: Column) -> Column:
    """The number of "[N] any text", "source [N]" or a bare "N"; null for other texts and for numbers beyond 31 bits."""
    return F.regexp_extract(raw, SECTION_REFERENCE, 1).try_cast("int")


#: Marks that a punctuation model may insert, and both spaces.
MARKS = "，。！？、；：．…,.!?;: 　"
#: What error texts say, first match wins.
ERRORS = [("(?i)rate.?limit|429", "rate_limited"), ("(?i)sign in|log ?in|cookies|403", "needs_auth"), ("(?i)not found|404|unavailable|removed", "not_found"), ("(?i)timed? ?out", "timeout")]


def strip_marks(text: Column) -> Column:
    return F.translate(text, MARKS, "")


def seconds(milliseconds: Column) -> Column:
    return milliseconds / 1000.0


def speaker_label(number: Column) -> Column:
    """SPK_n; null stays null."""
    return F.concat(F.lit("SPK_"), number.cast("string"))


def safe_duration(raw: Column) -> Column:
    """Whole seconds from text; 0 for what is no number."""
    return F.coalesce(F.floor(raw.try_cast("double")).cast("long"), F.lit(0))


def error_class(message: Column) -> Column:
    out = F.lit("internal_error")
    for pattern, name in reversed(ERRORS):
        out = F.when(message.rlike(pattern), name).otherwise(out)
    return out


def chunk_key(source: Column, start: Column, end: Column) -> Column:
    """Exact times, for fusing lists; not the id that is shown."""
    return F.concat_ws("_", source.cast("string"), start.cast("string"), end.cast("string"))


def shown_id(source: Column, start: Column, end: Column) -> Column:
    """Whole seconds, for what a reader has seen."""
    return F.concat_ws("_", source.cast("string"), start.cast("long").cast("string"), end.cast("long").cast("string"))


def sequence_index(chunk_id: Column) -> Column:
    """The number behind the last underscore, else null."""
    return F.substring_index(chunk_id, "_", -1).try_cast("int")


def resource_type(url: Column) -> Column:
    """Course before playlist before video."""
    return F.when(url.rlike("/(course|cheese)/"), "course").when(url.rlike("[?&](list|playlist)=|/playlist"), "playlist").otherwise("video")


def part_number(url: Column) -> Column:
    return F.regexp_extract(url, "[?&]p(?:age)?=([0-9]+)", 1).try_cast("int")


def cookies(header: Column) -> Column:
    """"a=1; b=2" to a map; parts without a key go."""
    parts = F.filter(F.split(header, "; "), lambda x: F.instr(x, "=") > 1)
    pairs = F.transform(parts, lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.substr(x, F.instr(x, "=") + 1).alias("v")))
    return F.map_from_entries(pairs)


def without_private(m: Column) -> Column:
    """A map without keys that begin with an underscore."""
    return F.map_filter(m, lambda k, _: ~k.startswith("_"))


def transcript_language(configured: Column, detected: Column) -> Column:
    """What is configured unless that is auto, else what was detected, else en."""
    return F.coalesce(F.nullif(F.nullif(F.trim(configured), F.lit("")), F.lit("auto")), F.nullif(detected, F.lit("")), F.lit("en"))


def connections(jobs: Column) -> Column:
    """Download connections of each of so many jobs: sixty-four in all, one to sixteen each."""
    return F.greatest(F.lit(1), F.least(F.lit(16), F.floor(F.lit(64) / jobs))).cast("int")


def over_budget(tokens: Column, answer: int, window: int, spare: int = 2048) -> Column:
    return tokens + answer + spare > window


def with_defaults(values: Column, defaults: dict[str, str]) -> Column:
    """A map of the known keys: trimmed values, or the default where there is none or a blank one."""
    return F.create_map(*(x for k, v in defaults.items() for x in (F.lit(k), F.coalesce(F.nullif(F.trim(values[k]), F.lit("")), F.lit(v)))))


def unmasked(old: Column, new: Column) -> Column:
    """The trimmed new value, or the old one where the new is null or a mask."""
    t = F.trim(new)
    return F.when(t.isNull() | (t == "***") | t.contains("..."), old).otherwise(t)


def composite_title(part: Column, base: Column) -> Column:
    """part - base; the base alone where there is no part or it says the same."""
    return F.when(F.coalesce(F.nullif(F.trim(part), F.lit("")), base) == base, base).otherwise(F.concat(part, F.lit(" - "), base))


def blocks_text(blocks: Column) -> Column:
    """Text of content blocks (kind, content): a break is a blank line, citations are silent; marks of old tokens go."""
    said = F.transform(blocks, lambda b: F.when(b["kind"] == "break", "\n\n").when(b["kind"] == "text", b["content"]).otherwise(""))
    return F.regexp_replace(F.array_join(said, ""), r"\[\[[a-z]+:[0-9]+\]\]", "")


def iso_time(seconds_: Column) -> Column:
    """Seconds of the epoch as UTC, YYYY-MM-DDTHH:MM:SSZ."""
    return F.date_format(F.timestamp_seconds(seconds_), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def from_iso(text: Column) -> Column:
    """Seconds of the epoch; null for what is no such time."""
    return F.unix_seconds(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")))


def merged_deep(base: Column, patch: Column, depth: int = 3) -> Column:
    """Two JSON objects as one, objects inside them too down to a depth; the patch wins, and its nulls are values."""
    kind = "map<string,variant>"
    a, b = F.from_json(base, kind), F.from_json(patch, kind)
    if depth == 1:
        return F.to_json(F.map_zip_with(a, b, lambda k, x, y: F.when(F.map_contains_key(b, k), y).otherwise(x)))
    inner = lambda x: F.to_json(x)
    both = lambda x, y: F.schema_of_variant(x).startswith("OBJECT") & F.schema_of_variant(y).startswith("OBJECT")
    return F.to_json(F.map_zip_with(a, b, lambda k, x, y: F.when(both(x, y), F.parse_json(merged_deep(inner(x), inner(y), depth - 1))).when(F.map_contains_key(b, k), y).otherwise(x)))


def compression(counts: DataFrame, by: str) -> DataFrame:
    """(by, words, fact_words, ratio) of rows (by, words, facts): whole words of text for one of facts."""
    out = counts.groupBy(by).agg(F.sum("words").cast("long").alias("words"), F.sum("facts").cast("long").alias("fact_words"))
    return out.withColumn("ratio", F.expr("words DIV greatest(1, fact_words)"))

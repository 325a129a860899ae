"""From ranked chunks to citable evidence: sections, speaker turns, stable numbers, fences and ledgers.

All frames carry ``query_id``; one plan serves many questions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fence_header, format_hms
from .intervals import merged, within

GAP = "\n\n[…]\n\n"


def joined(texts: str, order: str | list[str], separator: str = "\n") -> Column:
    """Texts of a group in the order of a column."""
    keys = [order] if isinstance(order, str) else order
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*keys, texts))), lambda x: x[texts]), separator)


def chunk_sections(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """Each chunk with the section of its source that holds its first segment; chunks in no section go."""
    return within(chunks, "seg_start", sections, "seg_start", "seg_end", ["section_seq"])


def segments_in_ranges(segments: DataFrame, ranges: DataFrame) -> DataFrame:
    """Segments inside any of the ranges (source_id, seg_start, seg_end), each once."""
    return within(segments, "seq", merged(ranges, "seg_start", "seg_end"), "seg_start", "seg_end", [])


def speaker_namespace(segments: DataFrame, scope: list[str]) -> DataFrame:
    """Speakers of each scope, numbered from 0 by their first segment; a null speaker is one of its own."""
    first = segments.groupBy(*scope, "speaker").agg(F.min("seq").alias("first_seq"))
    w = Window.partitionBy(*scope).orderBy("first_seq")
    return first.withColumn("spk", F.row_number().over(w) - 1).drop("first_seq")


def speaker_turns(segments: DataFrame, scope: list[str], label: Column | None = None, times: bool = False) -> DataFrame:
    """Text of each scope: consecutive segments of one speaker on a line, as [label @time] words."""
    w = Window.partitionBy(*scope).orderBy("seq")
    label = F.coalesce("speaker", F.lit("SPK?")) if label is None else label
    turn = segments.withColumn("_label", label).withColumn("_new", F.when(F.lag("seq").over(w).isNull() | ~F.lag("speaker").over(w).eqNullSafe(F.col("speaker")), 1).otherwise(0))
    turn = turn.withColumn("_turn", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    line = turn.groupBy(*scope, "_turn").agg(F.min_by("_label", "seq").alias("_label"), F.min_by("start_s", "seq").alias("_at"), joined("text", "seq", " ").alias("_words"))
    head = F.concat(F.col("_label"), F.lit(" @"), format_hms(F.col("_at"))) if times else F.col("_label")
    line = line.withColumn("_line", F.concat(F.lit("["), head, F.lit("] "), F.col("_words")))
    return line.groupBy(*scope).agg(joined("_line", "_turn").alias("text"))


def allocate(hits: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """Citation numbers of each query's sections (query_id, source_id, section_seq, rank): by first appearance, from 1.

    Sections that ``held`` (query_id, source_id, section_seq, index) numbers already keep theirs; others go on from its largest.
    """
    key = ["query_id", "source_id", "section_seq"]
    first = hits.groupBy(*key).agg(F.min("rank").alias("first_rank"))
    w = Window.partitionBy("query_id").orderBy("first_rank", "source_id", "section_seq")
    if held is None:
        return first.withColumn("index", F.row_number().over(w))
    most = held.groupBy("query_id").agg(F.max("index").alias("_most"))
    new = first.join(held, key, "left_anti").join(most, "query_id", "left")
    new = new.withColumn("index", F.coalesce("_most", F.lit(0)) + F.row_number().over(w)).drop("_most")
    return first.join(held, key).select(*new.columns).unionByName(new)


def spans(hits: DataFrame) -> DataFrame:
    """Each query's sections: the window that its hits cover, its chunks, and what its first hit says."""
    return hits.groupBy("query_id", "source_id", "section_seq").agg(
        F.min("timestamp_start").alias("timestamp_start"),
        F.max("timestamp_end").alias("timestamp_end"),
        F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"),
        F.min_by("chunk_id", "rank").alias("first_chunk_id"),
    )


def join_fragments(fragments: DataFrame, scope: list[str]) -> DataFrame:
    """Bodies of each scope by seg_start: adjacent ones on the next line, others after a gap mark."""
    w = Window.partitionBy(*scope).orderBy("seg_start", "seg_end")
    far = F.col("seg_start") > F.lag("seg_end").over(w) + 1
    parts = fragments.withColumn("_part", F.concat(F.when(F.lag("seg_end").over(w).isNull(), "").when(far, GAP).otherwise("\n"), F.col("body")))
    return parts.groupBy(*scope).agg(joined("_part", ["seg_start", "seg_end"], "").alias("body"))


def dedup_turn(hits: DataFrame, turn: str = "turn_id") -> DataFrame:
    """Of chunks that a turn's calls return again (same source and whole seconds) the first stays."""
    whole = lambda c: F.col(c).cast("long").cast("string")
    shown = hits.withColumn("shown_id", F.concat_ws("_", F.col("source_id").cast("string"), whole("timestamp_start"), whole("timestamp_end")))
    w = Window.partitionBy(turn, "shown_id").orderBy("call", "rank")
    return shown.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def fences(evidence: DataFrame) -> DataFrame:
    """One text a query: header, summary if any, body if any, of each section in the order of its number."""
    head = fence_header(F.col("index"), F.col("title"), F.col("section_seq") + 1, F.col("timestamp_start"), F.col("timestamp_end"))
    filled = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.col(c))
    block = evidence.withColumn("_block", F.concat_ws("\n", head, filled("summary"), filled("body")))
    return block.groupBy("query_id").agg(joined("_block", "index", "\n\n").alias("evidence"), F.count("*").alias("n_sections"))


def find_passages(hits: DataFrame, sections: DataFrame, segments: DataFrame, titles: DataFrame) -> DataFrame:
    """Numbered sections of each query's hits with their rendered turns.

    ``hits``: query_id, chunk_id, source_id, rank, seg_start, seg_end, timestamp_start, timestamp_end.  Returns query_id,
    index, source_id, section_seq, title, the span of the hits, summary, body, chunk_ids and first_chunk_id.
    """
    placed = chunk_sections(hits, sections)
    numbers = allocate(placed)
    key = ["query_id", "source_id", "section_seq"]
    # a hit shows all of its segments, so it is met with them by their numbers
    asked = placed.select(*key, "chunk_id", "seg_start", "seg_end").where("seg_start <= seg_end").withColumn("seq", F.explode(F.sequence("seg_start", "seg_end")))
    inside = asked.join(segments.select("source_id", "seq", "start_s", "speaker", "text"), ["source_id", "seq"])
    first = F.min("seq").over(Window.partitionBy("query_id", "source_id", "speaker"))
    spk = F.dense_rank().over(Window.partitionBy("query_id", "source_id").orderBy("_first")) - 1
    named = inside.withColumn("_first", first).withColumn("spk", spk).join(numbers.select(*key, "index"), key)
    label = F.concat(F.lit("S"), F.col("index").cast("string"), F.lit("·SPK"), F.col("spk").cast("string"))
    turns = speaker_turns(named, [*key, "chunk_id", "seg_start", "seg_end"], label, times=True).withColumnRenamed("text", "body")
    bodies = join_fragments(turns, key)
    out = numbers.join(spans(placed), key).join(bodies, key, "left").join(titles.select("source_id", "title"), "source_id", "left")
    return out.select(*key, "index", F.coalesce("title", F.lit("")).alias("title"), "timestamp_start", "timestamp_end", F.lit("").alias("summary"), "body", "chunk_ids", "first_chunk_id")


def outline(numbers: DataFrame, scoped: DataFrame, sections: DataFrame) -> DataFrame:
    """Hit sections first, then every other section of each scoped source (query_id, source_id) in order."""
    rest = scoped.join(sections.select("source_id", "section_seq"), "source_id").join(numbers, ["query_id", "source_id", "section_seq"], "left_anti")
    most = numbers.groupBy("query_id").agg(F.max("index").alias("_most"))
    w = Window.partitionBy("query_id").orderBy("source_id", "section_seq")
    more = rest.join(most, "query_id", "left").withColumn("index", F.coalesce("_most", F.lit(0)) + F.row_number().over(w))
    return numbers.select("query_id", "source_id", "section_seq", "index").unionByName(more.select("query_id", "source_id", "section_seq", "index"))


def read_sections(asked: DataFrame, numbers: DataFrame, sections: DataFrame, segments: DataFrame) -> DataFrame:
    """Whole text of sections asked for by number (query_id, raw, index); what cannot be read has an error instead."""
    found = asked.join(numbers, ["query_id", "index"], "left").join(sections.select("source_id", "section_seq", "seg_start", "seg_end"), ["source_id", "section_seq"], "left")
    own = found.where("seg_start IS NOT NULL").select("source_id", "section_seq", "seg_start", "seg_end").distinct()
    inside = within(segments, "seq", own, "seg_start", "seg_end", ["section_seq"])
    text = speaker_turns(inside, ["source_id", "section_seq"], times=True)
    error = F.when(F.col("index").isNull(), "not a section number").when(F.col("seg_start").isNull(), "unknown section").when(F.col("text").isNull(), "no transcript")
    return found.join(text, ["source_id", "section_seq"], "left").select("query_id", "raw", "index", "source_id", "section_seq", "text", error.alias("error"))


def ledger(coverage: DataFrame, cited: DataFrame, registry: DataFrame) -> DataFrame:
    """Coverage rows (query_id, call, ord, section_id) narrowed to cited sections, unless the query cited none, with registry entries."""
    key = ["query_id", "section_id"]
    named = registry.join(cited.select("query_id", "index").distinct(), ["query_id", "index"], "left_semi").select(*key, F.lit(True).alias("cited"))
    any_cited = named.select("query_id", F.lit(True).alias("some")).distinct()
    kept = coverage.join(named, key, "left").join(any_cited, "query_id", "left").where(F.col("some").isNull() | F.col("cited"))
    return kept.drop("cited", "some").join(registry, key)


def reseed(entries: DataFrame) -> DataFrame:
    """The registry from earlier calls (query_id, call, ord, section_id, index, chunk_id): the first writer's number, all chunks."""
    return entries.groupBy("query_id", "section_id").agg(F.min_by("index", F.struct("call", "ord")).alias("index"), F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))


def section_texts(segments: DataFrame, sections: DataFrame) -> DataFrame:
    """Each section's turns."""
    from .segmentation import with_sections

    return speaker_turns(with_sections(segments, sections), ["source_id", "section_seq"])


def single_batch(texts: DataFrame, titles: DataFrame, budget: int, by: str = "list_id") -> DataFrame:
    """Each list's section texts under one header a source, and their characters.

    A list whose texts exceed the budget of characters has no single text: it is for batches (``segmentation.pack``), and
    its texts are never gathered.
    """
    held = texts.join(titles, "source_id")
    size = held.groupBy(by).agg(F.sum(F.length("text")).alias("n_chars"))
    small = held.join(size.where(F.col("n_chars") <= budget).select(by), by, "left_semi")
    per = small.groupBy(by, "source_id").agg(joined("text", "section_seq").alias("_body"), F.first("title").alias("title"))
    per = per.withColumn("_block", F.concat(F.lit("=== Source: "), F.col("title"), F.lit(" ===\n"), F.col("_body")))
    return size.join(per.groupBy(by).agg(joined("_block", "source_id", "\n\n").alias("text")), by, "left")

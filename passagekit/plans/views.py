"""The catalog's tables of ``sources.tables`` once more, in DuckDB's SQL."""

from __future__ import annotations

VIEWS = {
    "src": """
        SELECT doc_id AS source_id, source AS list_id, 'v' || (doc_id % 97) AS video_id, 'Title ' || doc_id AS title, lang AS language,
               CASE WHEN doc_id % 7 <> 0 THEN (doc_id % 12 + 1)::INT END AS sequence_number, (doc_id % 3 + 1)::INT AS season_number,
               CASE WHEN doc_id % 11 <> 0 THEN floor(n_chars / 15)::BIGINT END AS duration_seconds, 1704067200 + doc_id * 61 % 86400 AS processed_at
        FROM documents""",
    "piece": r"""
        SELECT source_id, generate_subscripts(p, 1) - 1 AS seq, unnest(p) AS part
        FROM (SELECT doc_id AS source_id, list_filter(regexp_extract_all(coalesce(text, ''), '\n*[^\n.!?]+[.!?]*'), lambda x: trim(x, E' \n\t\r') <> '') AS p FROM documents)""",
    "seg": r"""
        SELECT source_id, seq, round((said - size) / 15e0 + broken * 2e0, 3) AS start_s, round(said / 15e0 + broken * 2e0, 3) AS end_s, speaker, text,
               (han + ceil((size - han) / 4))::INT AS tokens
        FROM (SELECT *, sum(size) OVER w AS said, sum(breaks) OVER w AS broken
              FROM (SELECT source_id, seq, trim(part, E' \n\t\r') AS text, length(trim(part, E' \n\t\r')) AS size,
                           length(regexp_replace(trim(part, E' \n\t\r'), '[^\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]', '', 'g')) AS han,
                           CASE WHEN seq > 0 AND part[1] = E'\n' THEN 1 ELSE 0 END AS breaks, 'SPK_' || (seq // 3 % 3) AS speaker FROM piece)
              WINDOW w AS (PARTITION BY source_id ORDER BY seq))""",
    "chunk": """
        SELECT source_id, seq // 6 AS chunk_index, min(seq) AS seg_start, max(seq) AS seg_end, min(start_s) AS timestamp_start, max(end_s) AS timestamp_end,
               string_agg(text, ' ' ORDER BY seq) AS text, source_id || '_' || (seq // 6) AS chunk_id
        FROM seg GROUP BY source_id, seq // 6""",
    "msg": """
        SELECT conv_id * 1000 + turn AS message_id, conv_id AS conversation_id, turn, role, text AS content,
               CASE WHEN turn % 9 = 8 THEN 'failed' ELSE 'done' END AS status, 1704067200 + turn // 2 * 60 AS created_at FROM conversations""",
    "job": """
        SELECT event_id AS job_id, user_id AS entity, 'v' || (user_id % 97) AS video_id,
               CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'downloading' WHEN 'click' THEN 'transcribing' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' END AS status,
               epoch_us(ts) AS updated_at, props AS meta FROM events""",
    "lst": "SELECT DISTINCT source AS list_id, 1704067200 AS created_at FROM documents UNION ALL SELECT 'empty', 1704067200",
    "grade": """
        SELECT run_id, case_id, category, CASE WHEN i % 5 <> 0 THEN (i * k % 5 + 1)::INT END AS context_relevance,
               CASE WHEN i % 7 <> 3 THEN ((i * k + 1) % 4 + 2)::INT END AS groundedness, ((i * k + 2) % 3 + 3)::INT AS answer_relevance
        FROM (SELECT run_id, k, item_id AS case_id, item_id AS i, 'cat' || (item_id % 9) AS category
              FROM benchmark, (VALUES (1, 3), (2, 7)) v(run_id, k)) WHERE run_id = 2 OR category <> 'cat8'""",
    # sections: for each segment the end of a section that would begin there, then the walk from the first
    "cut": """
        SELECT a.source_id, a.seq AS i, coalesce(first(b.seq ORDER BY b.pause DESC, b.seq) FILTER (WHERE b.cum - a.cum + a.tokens BETWEEN 240 AND 560 AND b.pause > 0),
               min(b.seq) FILTER (WHERE b.cum - a.cum + a.tokens > 560), max(b.last)) AS cut
        FROM run a JOIN run b ON b.source_id = a.source_id AND b.seq >= a.seq AND b.cum - b.tokens - (a.cum - a.tokens) <= 560 GROUP BY a.source_id, a.seq""",
    "run": """
        SELECT source_id, seq, tokens, sum(tokens) OVER w AS cum, lead(start_s) OVER w - end_s AS pause, max(seq) OVER (PARTITION BY source_id) AS last
        FROM seg WINDOW w AS (PARTITION BY source_id ORDER BY seq)""",
    "walk": """
        SELECT source_id, 0 AS section_seq, i AS seg_start, cut AS seg_end FROM cut WHERE i = 0
        UNION ALL SELECT w.source_id, w.section_seq + 1, c.i, c.cut FROM walk w JOIN cut c ON c.source_id = w.source_id AND c.i = w.seg_end + 1""",
    "section": """
        SELECT w.source_id, section_seq, seg_start, seg_end, sum(tokens)::BIGINT AS token_count, min_by(start_s, seq) AS timestamp_start, max_by(end_s, seq) AS timestamp_end
        FROM walk w JOIN seg s ON s.source_id = w.source_id AND s.seq BETWEEN seg_start AND seg_end GROUP BY w.source_id, section_seq, seg_start, seg_end""",
    # retrieval
    "question": "SELECT item_id AS query_id, text FROM benchmark",
    "posting": r"""
        SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(regexp_extract_all(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[\p{L}\p{N}]+')) AS term FROM chunk)
        GROUP BY chunk_id, term""",
    "term": r"""
        SELECT query_id, term, count(*) AS weight FROM (SELECT query_id, unnest(regexp_extract_all(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[\p{L}\p{N}]+')) AS term FROM question)
        GROUP BY query_id, term""",
    "bm25": """
        SELECT query_id, p.chunk_id, sum(weight * greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / average))) AS score
        FROM posting p JOIN term USING (term) JOIN (SELECT term, count(*)::DOUBLE AS df FROM posting GROUP BY term) USING (term)
        JOIN (SELECT chunk_id, sum(tf)::DOUBLE AS len FROM posting GROUP BY chunk_id) l ON l.chunk_id = p.chunk_id
        CROSS JOIN (SELECT (SELECT count(*) FROM chunk)::DOUBLE AS n, (SELECT sum(tf) FROM posting)::DOUBLE / (SELECT count(*) FROM chunk) AS average)
        GROUP BY query_id, p.chunk_id""",
    "textarm": "SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM bm25) WHERE rank <= 60",
    # the vector of a source stands with its first chunk; a question has the vector of its own number
    "vectorarm": """
        SELECT query_id, chunk_id, distance, rank FROM (
          SELECT query_id, chunk_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), chunk_id) AS rank FROM (
            SELECT query_id, c.vec_id || '_0' AS chunk_id, list_sum(list_transform(range(1, len(c.embedding) + 1), lambda i: (c.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE) ** 2)) AS distance
            FROM embeddings c, question JOIN embeddings q ON q.vec_id = query_id WHERE c.vec_id IN (SELECT source_id FROM chunk WHERE chunk_index = 0))) WHERE rank <= 60""",
    "fused": """
        SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, arm, first_rank) AS rank
        FROM (SELECT query_id, chunk_id, sum(1e0 / (60 + rank)) AS score, min(arm) AS arm, arg_min(rank, arm) AS first_rank
              FROM (SELECT query_id, chunk_id, rank, 0 AS arm FROM vectorarm UNION ALL SELECT query_id, chunk_id, rank, 1 FROM textarm) GROUP BY query_id, chunk_id)""",
    "found": """
        SELECT f.query_id, f.chunk_id, f.rank, round(f.score, 9) AS score, c.source_id, c.seg_start, c.seg_end, c.timestamp_start, c.timestamp_end
        FROM fused f JOIN chunk c USING (chunk_id) WHERE f.rank <= 8""",
    "placed": "SELECT f.*, s.section_seq FROM found f JOIN section s ON s.source_id = f.source_id AND f.seg_start BETWEEN s.seg_start AND s.seg_end",
    "numbered": """
        SELECT query_id, source_id, section_seq, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), source_id, section_seq) AS index
        FROM placed GROUP BY query_id, source_id, section_seq""",
}

"""Queries over search: lexical, dense, fused; prompts, citations; limits on traffic.

Searches ask every question whose line number is divisible by 20, against all rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from estante.functions import text as T
from estante.operators import embedding, rag, search
from estante.plans.documents import _FIRST, _TERMS
from estante.runtime import table

SHOWN = 8
LISTS = ["cosseno", "bm25", "reordenador"]


def _questions(spark, d):
    return table(spark, d, "perguntas").where("line_no % 20 = 0").select(F.col("line_no").cast("string").alias("query_id"), F.col("pergunta").alias("query_text"))


def _once(spark, d):
    return search.first_by_id(table(spark, d, "chunks"), "chunk_id", "ordinal")


def index_postings(spark, d):
    return search.postings(_once(spark, d)).select("chunk_id", "term", F.col("tf").cast("bigint").alias("tf"))


def index_stats(spark, d):
    s = search.index_stats(search.doc_lengths(_once(spark, d)))
    return s.select("n_docs", F.round("avgdl", 6).alias("avgdl"))


def query_terms(spark, d):
    q = table(spark, d, "perguntas").select(F.col("line_no").cast("string").alias("query_id"), F.col("pergunta").alias("query_text"))
    return search.query_terms(q).select("query_id", "term", F.col("qtf").cast("bigint").alias("qtf"))


def bm25_topk(spark, d):
    return search.bm25(_questions(spark, d), _once(spark, d), SHOWN)


def cosine_knn_topk(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    return search.cosine_top_k(q, e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector")), SHOWN)


def _hits(spark, d):
    return table(spark, d, "resultados").select("query_id", "strategy", "chunk_id", "score", "rank").distinct()


def rrf_hybrid_topk(spark, d):
    fused = search.rrf(_hits(spark, d), SHOWN, ["cosseno", "bm25"])
    return fused.select("query_id", "chunk_id", "rank", F.round("score", 9).alias("score"), search.contribution_label(F.col("contributions")).alias("label"))


def strategy_compare_pivot(spark, d):
    return search.compare(_hits(spark, d).where(F.col("rank") <= SHOWN), [*LISTS, "rrf"])


def contribution_labels(spark, d):
    r = table(spark, d, "resultados").where("strategy = 'rrf'")
    return r.select("query_id", "chunk_id", search.contribution_label(F.col("contributions")).alias("label")).distinct()


def _passages(spark, d):
    """The first three of the lexical list, as the SQL of prompt_assembly and no_context_guard states; the rag_ queries search themselves."""
    return _with_text(spark, d, _hits(spark, d).where("strategy = 'bm25' and rank <= 3").select("query_id", "rank", "chunk_id").distinct())


def _with_text(spark, d, top):
    return top.join(_once(spark, d), "chunk_id").select("query_id", "rank", "chunk_id", "book", "page_start", "page_end", "entity_name", "text")


def _asked(spark, d):
    return search.first_by_id(table(spark, d, "perguntas").where("id is not null"), "id", "line_no").select(F.col("id").alias("query_id"), F.col("pergunta").alias("query_text"))


def prompt_assembly(spark, d):
    p = rag.prompts(_asked(spark, d), _passages(spark, d).drop("chunk_id"))
    return p.select("query_id", "passages", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"))


def no_context_guard(spark, d):
    p = rag.prompts(_asked(spark, d), _passages(spark, d).drop("chunk_id"))
    return rag.answers(p, rag.extractive).where("note is not null").select("query_id", "passages", "answer")


def rag_answers(spark, d):
    """Every question over the stored lists: the eight passages of their fusion."""
    top = search.rrf(_hits(spark, d), SHOWN, ["cosseno", "bm25"]).select("query_id", "rank", "chunk_id")
    p = rag.prompts(_asked(spark, d), _with_text(spark, d, top).drop("chunk_id"))
    return rag.answers(p, rag.extractive)


def _strategies(spark, d):
    """Lexical search, search by hashed vectors, and their fusion, over the chunks."""
    chunks, known = _once(spark, d), search.Strategies()
    known.register("bm25", lambda q, k: search.bm25(q, chunks, k))

    def by_vector(q, k):
        asked = embedding.hashed_vectors(q, "query_id", "query_text").withColumnRenamed("vector", "qvec")
        return search.cosine_top_k(asked, embedding.hashed_vectors(chunks, "chunk_id", "text"), k)

    known.register("cosseno", by_vector)
    known.register_fusion("rrf", ["cosseno", "bm25"])
    return known


def rrf_from_legs(spark, d):
    fused = _strategies(spark, d).get("rrf")(_questions(spark, d), SHOWN)
    return fused.select("query_id", "chunk_id", "rank", F.round("score", 9).alias("score"), search.contribution_label(F.col("contributions")).alias("label"))


def _responses(spark, d):
    return rag.respond(_questions(spark, d), _strategies(spark, d).get("rrf"), _once(spark, d), k=SHOWN)


def rag_responses(spark, d):
    show = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return _responses(spark, d)[0].select("query_id", "passages", F.md5(F.col("answer").cast("binary")).alias("answer_md5"), show("valid"), show("invented"), "note", "warning")


def rag_sources(spark, d):
    return _responses(spark, d)[1].select("query_id", "source", "passage", "chunk_id", T.display_name(F.col("book")).alias("book"), T.page_label(F.col("page_start"), F.col("page_end")).alias("page"))


def citation_extract(spark, d):
    n = rag.cited_numbers(F.col("text"))
    c = table(spark, d, "chunks").select("chunk_id", n.alias("numbers")).where(F.size("numbers") > 0).distinct()
    show = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return c.select("chunk_id", show(F.col("numbers")).alias("numbers"), show(rag.valid_citations(F.col("numbers"), F.lit(5))).alias("valid"), show(rag.invented_citations(F.col("numbers"), F.lit(5))).alias("invented"))


def source_renumber(spark, d):
    valid = rag.valid_citations(rag.cited_numbers(F.col("text")), F.lit(5))
    c = table(spark, d, "chunks").select("chunk_id", valid.alias("v")).distinct()
    return c.select("chunk_id", F.posexplode("v").alias("i", "passage")).select("chunk_id", "passage", (F.col("i") + 1).cast("int").alias("source"))


def answer_parts(spark, d):
    c = table(spark, d, "chunks").where(F.col("text").rlike(rag.CITATION)).select("chunk_id", "text").distinct()
    return c.select("chunk_id", F.posexplode(rag.answer_parts(F.col("text"), F.lit(5))).alias("pos", "part")).select("chunk_id", "pos", "part.text", F.array_join(F.transform("part.sources", lambda x: x.cast("string")), ",").alias("sources"))


def rate_limit_fixed_window(spark, d):
    events = rag.delivered_once(table(spark, d, "consultas"))
    return rag.rate_limited(events).groupBy("client", "window_start").agg(F.count("*").cast("bigint").alias("asked"), F.count_if("admitted").cast("bigint").alias("admitted"))


def daily_quota(spark, d):
    events = rag.delivered_once(table(spark, d, "consultas")).where(rag.valid_question(F.col("question")))
    return rag.daily_quota(events).select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("n").cast("int").alias("n"))


def question_validation(spark, d):
    events = rag.delivered_once(table(spark, d, "consultas"))
    return events.groupBy(rag.valid_question(F.col("question")).alias("valid"), F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").cast("bigint").alias("n"))


_EVENTS = "(SELECT event_id, ts, client, question FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ts, client NULLS FIRST, question NULLS FIRST) AS rn FROM consultas) WHERE rn = 1)"
_CITED = r"list_transform(flatten(list_transform(regexp_extract_all(text, '\[\s*\d+(?:\s*[,;]\s*\d+)*\s*\]'), lambda m: regexp_extract_all(m, '\d+'))), lambda x: CAST(x AS INT))"
_DISTINCT = "list_filter(n, lambda x, i: list_position(n, x) = i)"
_HITS = "(SELECT DISTINCT query_id, strategy, chunk_id, score, rank FROM resultados)"
_PLACED = f"(SELECT query_id, strategy, chunk_id, min(rank) AS rank FROM {_HITS} GROUP BY 1, 2, 3)"
_ASKED = "(SELECT id AS query_id, pergunta AS query_text FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY line_no) AS rn FROM perguntas WHERE id IS NOT NULL) WHERE rn = 1)"
_PASSAGES = f"""(SELECT query_id, rank, text, concat_ws(' — ', concat_ws(', ', CASE book WHEN 'monstro' THEN 'Manual dos Monstros' WHEN 'jogador' THEN 'Livro do Jogador' WHEN 'mestre' THEN 'Guia do Mestre' ELSE book END,
    CASE WHEN page_start IS NULL THEN NULL WHEN page_end IS NULL OR page_end = page_start THEN 'p. ' || page_start ELSE 'p. ' || page_start || '–' || page_end END), entity_name) AS head
    FROM (SELECT DISTINCT query_id, rank, chunk_id FROM resultados WHERE strategy = 'bm25' AND rank <= 3) JOIN {_FIRST} USING (chunk_id))"""

_QUESTIONS = "(SELECT CAST(line_no AS VARCHAR) AS query_id, pergunta AS query_text FROM perguntas WHERE line_no % 20 = 0)"
# each leg's fifty best, fused
_LEGS = f"""
    c AS (SELECT chunk_id, {_TERMS % 'text'} AS terms FROM {_FIRST}),
    s AS (SELECT count(*) AS n_docs, avg(len(terms)) AS avgdl FROM c),
    p AS (SELECT chunk_id, len, term, count(*) AS tf FROM (SELECT chunk_id, len(terms) AS len, unnest(terms) AS term FROM c) GROUP BY 1, 2, 3),
    q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_TERMS % 'query_text'}) AS term FROM {_QUESTIONS}) GROUP BY 1, 2),
    d AS (SELECT term, count(*) AS n FROM p GROUP BY 1),
    w AS (SELECT query_id, term, qtf, avgdl, CASE WHEN ln((n_docs - n + 0.5) / (n + 0.5)) > 0 THEN ln((n_docs - n + 0.5) / (n + 0.5)) ELSE 1e-6 END AS idf FROM q JOIN d USING (term), s),
    lb AS (SELECT query_id, chunk_id, round(CAST(sum(qtf * idf * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * len / avgdl))) AS DOUBLE), 6) AS score FROM p JOIN w USING (term) GROUP BY 1, 2),
    rb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM lb) WHERE rank <= 50),
    vp AS (SELECT chunk_id, b, tf / sqrt(sum(tf * tf) OVER (PARTITION BY chunk_id)) AS x FROM (SELECT chunk_id, CAST(('0x' || substr(md5(term), 1, 8)) AS BIGINT) % 64 AS b, CAST(sum(tf) AS DOUBLE) AS tf FROM p GROUP BY 1, 2)),
    vq AS (SELECT query_id, b, tf / sqrt(sum(tf * tf) OVER (PARTITION BY query_id)) AS x FROM (SELECT query_id, CAST(('0x' || substr(md5(term), 1, 8)) AS BIGINT) % 64 AS b, CAST(sum(qtf) AS DOUBLE) AS tf FROM q GROUP BY 1, 2)),
    lc AS (SELECT query_id, chunk_id, round(coalesce(t.score, 0e0), 6) AS score FROM (SELECT DISTINCT query_id FROM vq) CROSS JOIN (SELECT DISTINCT chunk_id FROM vp) LEFT JOIN (SELECT query_id, chunk_id, sum(vp.x * vq.x) AS score FROM vp JOIN vq USING (b) GROUP BY 1, 2) t USING (query_id, chunk_id)),
    rc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM lc) WHERE rank <= 50),
    fu AS (SELECT coalesce(rb.query_id, rc.query_id) AS query_id, coalesce(rb.chunk_id, rc.chunk_id) AS chunk_id, rc.rank AS c, rb.rank AS l, round(coalesce(1e0 / (60 + rc.rank), 0e0) + coalesce(1e0 / (60 + rb.rank), 0e0), 9) AS score
        FROM rb FULL JOIN rc ON rb.query_id = rc.query_id AND rb.chunk_id = rc.chunk_id),
    top AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM fu) WHERE rank <= 8)"""
# the local generator cites the first line of the first passage; what that line itself cites counts too
_SAID = f"""{_LEGS},
    n AS (SELECT query_id, CAST(count(*) AS INT) AS passages FROM top GROUP BY 1),
    a AS (SELECT query_id, substr(split_part(trim(text), chr(10), 1), 1, 200) || ' [1]' AS text FROM top JOIN {_FIRST} USING (chunk_id) WHERE rank = 1),
    g AS (SELECT query_id, passages, text, {_DISTINCT} AS n FROM (SELECT query_id, passages, text, {_CITED} AS n FROM n JOIN a USING (query_id))),
    r AS (SELECT query_id, passages, md5(text) AS answer_md5, list_filter(n, lambda x: x BETWEEN 1 AND passages) AS v, list_filter(n, lambda x: x < 1 OR x > passages) AS i FROM g)"""

SQL = {
    "rrf_from_legs": f"WITH {_LEGS} SELECT query_id, chunk_id, rank, score, 'cosseno ' || coalesce('#' || c, '—') || ' · bm25 ' || coalesce('#' || l, '—') AS label FROM top",
    "rag_responses": f"""WITH {_SAID} SELECT query_id, passages, answer_md5, array_to_string(v, ',') AS valid, coalesce(array_to_string(i, ','), '') AS invented,
            CASE WHEN len(i) > 0 THEN 'Citações inexistentes: ' || array_to_string(i, ', ') || '.' END AS note, CAST(NULL AS VARCHAR) AS warning FROM r
        UNION ALL SELECT query_id, 0, md5(''), '', '', '{rag.NOTHING_FOUND}', 'sem-fontes' FROM {_QUESTIONS} WHERE query_id NOT IN (SELECT query_id FROM r)""",
    "rag_sources": f"""WITH {_SAID}, u AS (SELECT query_id, unnest(v) AS passage, CAST(generate_subscripts(v, 1) AS INT) AS source FROM r)
        SELECT query_id, source, passage, chunk_id, CASE book WHEN 'monstro' THEN 'Manual dos Monstros' WHEN 'jogador' THEN 'Livro do Jogador' WHEN 'mestre' THEN 'Guia do Mestre' ELSE book END AS book,
            CASE WHEN page_start IS NULL THEN NULL WHEN page_end IS NULL OR page_end = page_start THEN 'p. ' || page_start ELSE 'p. ' || page_start || '–' || page_end END AS page
        FROM u JOIN top ON top.query_id = u.query_id AND top.rank = u.passage JOIN {_FIRST} USING (chunk_id)""".replace("SELECT query_id, source", "SELECT u.query_id, source"),
    "index_postings": f"SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest({_TERMS % 'text'}) AS term FROM {_FIRST}) GROUP BY 1, 2",
    "index_stats": f"SELECT count(*) AS n_docs, round(avg(len({_TERMS % 'text'})), 6) AS avgdl FROM {_FIRST}",
    "query_terms": f"SELECT query_id, term, count(*) AS qtf FROM (SELECT CAST(line_no AS VARCHAR) AS query_id, unnest({_TERMS % 'pergunta'}) AS term FROM perguntas WHERE regexp_matches(pergunta, '[\\p{{L}}\\p{{Nd}}]')) GROUP BY 1, 2",
    "bm25_topk": f"""
        WITH c AS (SELECT chunk_id, {_TERMS % 'text'} AS terms FROM {_FIRST}),
        s AS (SELECT count(*) AS n_docs, avg(len(terms)) AS avgdl FROM c),
        p AS (SELECT chunk_id, len, term, count(*) AS tf FROM (SELECT chunk_id, len(terms) AS len, unnest(terms) AS term FROM c) GROUP BY 1, 2, 3),
        q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT CAST(line_no AS VARCHAR) AS query_id, unnest({_TERMS % 'pergunta'}) AS term FROM perguntas WHERE line_no % 20 = 0) GROUP BY 1, 2),
        d AS (SELECT term, count(*) AS n FROM p GROUP BY 1),
        w AS (SELECT query_id, term, qtf, avgdl, CASE WHEN ln((n_docs - n + 0.5) / (n + 0.5)) > 0 THEN ln((n_docs - n + 0.5) / (n + 0.5)) ELSE 1e-6 END AS idf FROM q JOIN d USING (term), s),
        r AS (SELECT query_id, chunk_id, round(CAST(sum(qtf * idf * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * len / avgdl))) AS DOUBLE), 6) AS score FROM p JOIN w USING (term) GROUP BY 1, 2)
        SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM r) WHERE rank <= 8""",
    "cosine_knn_topk": """
        WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        r AS (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, round(list_cosine_similarity(q.v, e.v), 6) AS score FROM e q, e WHERE q.vec_id % 20 = 0)
        SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM r) WHERE rank <= 8""",
    "rrf_hybrid_topk": f"""
        WITH f AS (SELECT query_id, chunk_id, max(rank) FILTER (WHERE strategy = 'cosseno') AS rc, max(rank) FILTER (WHERE strategy = 'bm25') AS rb FROM {_PLACED} WHERE strategy IN ('cosseno', 'bm25') GROUP BY 1, 2),
        s AS (SELECT *, round(coalesce(1e0 / (60 + rc), 0e0) + coalesce(1e0 / (60 + rb), 0e0), 9) AS score FROM f)
        SELECT query_id, chunk_id, CAST(rank AS INT) AS rank, score, 'cosseno ' || coalesce('#' || rc, '—') || ' · bm25 ' || coalesce('#' || rb, '—') AS label
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 8""",
    "rag_answers": f"""
        WITH f AS (SELECT query_id, chunk_id, max(rank) FILTER (WHERE strategy = 'cosseno') AS rc, max(rank) FILTER (WHERE strategy = 'bm25') AS rb FROM {_PLACED} WHERE strategy IN ('cosseno', 'bm25') GROUP BY 1, 2),
        s AS (SELECT *, round(coalesce(1e0 / (60 + rc), 0e0) + coalesce(1e0 / (60 + rb), 0e0), 9) AS score FROM f),
        t AS (SELECT query_id, rank, text FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) JOIN {_FIRST} USING (chunk_id) WHERE rank <= 8),
        p AS (SELECT query_id, CAST(count(*) AS INT) AS passages, min_by(text, rank) AS text FROM t GROUP BY 1)
        SELECT query_id, coalesce(passages, 0) AS passages, CASE WHEN passages > 0 AND query_text IS NOT NULL THEN substr(split_part(trim(text), chr(10), 1), 1, 200) || ' [1]' ELSE '' END AS answer,
            CASE WHEN passages > 0 AND query_text IS NOT NULL THEN NULL ELSE '{rag.NOTHING_FOUND}' END AS note FROM {_ASKED} LEFT JOIN p USING (query_id)""",
    "strategy_compare_pivot": f"""SELECT query_id, rank, coalesce(min(chunk_id) FILTER (WHERE strategy = 'cosseno'), '—') AS cosseno, coalesce(min(chunk_id) FILTER (WHERE strategy = 'bm25'), '—') AS bm25,
        coalesce(min(chunk_id) FILTER (WHERE strategy = 'reordenador'), '—') AS reordenador, coalesce(min(chunk_id) FILTER (WHERE strategy = 'rrf'), '—') AS rrf FROM {_HITS} WHERE rank <= 8 GROUP BY 1, 2""",
    "contribution_labels": "SELECT DISTINCT query_id, chunk_id, array_to_string(list_transform(contributions, lambda c: c.strategy || CASE WHEN c.rank > 0 THEN ' #' || c.rank ELSE ' —' END), ' · ') AS label FROM resultados WHERE strategy = 'rrf'",
    "prompt_assembly": f"""
        WITH n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, head, trim(text)) AS i FROM {_PASSAGES}),
        p AS (SELECT query_id, count(*) AS k, string_agg(chr(10) || '[' || i || '] ' || head || chr(10) || trim(text) || chr(10), '' ORDER BY i) AS shown FROM n GROUP BY 1)
        SELECT query_id, CAST(coalesce(k, 0) AS INT) AS passages, md5('Trechos:' || chr(10) || shown || chr(10) || 'Pergunta: ' || query_text) AS prompt_md5 FROM {_ASKED} LEFT JOIN p USING (query_id)""",
    "no_context_guard": f"SELECT query_id, 0::INT AS passages, '' AS answer FROM {_ASKED} WHERE query_id NOT IN (SELECT query_id FROM {_PASSAGES})",
    "citation_extract": f"""
        WITH c AS (SELECT chunk_id, {_DISTINCT} AS n FROM (SELECT DISTINCT chunk_id, {_CITED} AS n FROM chunks) WHERE len(n) > 0)
        SELECT chunk_id, array_to_string(n, ',') AS numbers, coalesce(array_to_string(list_filter(n, lambda x: x BETWEEN 1 AND 5), ','), '') AS valid, coalesce(array_to_string(list_filter(n, lambda x: x < 1 OR x > 5), ','), '') AS invented FROM c""",
    "source_renumber": f"""
        WITH c AS (SELECT chunk_id, list_filter({_DISTINCT}, lambda x: x BETWEEN 1 AND 5) AS v FROM (SELECT DISTINCT chunk_id, {_CITED} AS n FROM chunks))
        SELECT chunk_id, unnest(v) AS passage, CAST(generate_subscripts(v, 1) AS INT) AS source FROM c WHERE len(v) > 0""",
    "answer_parts": rf"""
        WITH c AS (SELECT DISTINCT chunk_id, text FROM chunks WHERE regexp_matches(text, '\[\s*\d+(?:\s*[,;]\s*\d+)*\s*\]')),
        n AS (SELECT chunk_id, text, regexp_split_to_array(text, '\[\s*\d+(?:\s*[,;]\s*\d+)*\s*\]') AS plain, regexp_extract_all(text, '\[\s*\d+(?:\s*[,;]\s*\d+)*\s*\]') AS marks, {_CITED} AS n FROM c),
        v AS (SELECT *, list_filter({_DISTINCT}, lambda x: x BETWEEN 1 AND 5) AS v FROM n),
        u AS (SELECT *, unnest(range(1, len(plain) + 1)) AS i FROM v),
        p AS (SELECT chunk_id, text, 2 * i AS o, plain[i] AS part, [] AS s FROM u UNION ALL
            SELECT chunk_id, text, 2 * i + 1, '', list_transform(list_filter(list_transform(regexp_extract_all(marks[i], '\d+'), lambda x: CAST(x AS INT)), lambda x: list_contains(v, x)), lambda x: list_position(v, x)) FROM u WHERE i <= len(marks))
        SELECT chunk_id, CAST(row_number() OVER (PARTITION BY chunk_id, text ORDER BY o) - 1 AS INT) AS pos, part AS text, array_to_string(list_filter(s, lambda x, k: list_position(s, x) = k), ',') AS sources FROM p WHERE part <> '' OR len(s) > 0""",
    "rate_limit_fixed_window": f"SELECT client, date_trunc('minute', ts) AS window_start, count(*) AS asked, least(count(*), 5) AS admitted FROM {_EVENTS} GROUP BY 1, 2",
    "daily_quota": f"SELECT event_id, day, CAST(n AS INT) AS n FROM (SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS n FROM {_EVENTS} WHERE length(trim(question)) BETWEEN 1 AND 500) WHERE n <= 200",
    "question_validation": f"SELECT coalesce(length(trim(question)) BETWEEN 1 AND 500, false) AS valid, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM {_EVENTS} GROUP BY 1, 2",
}
QUERIES = {f: globals()[f] for f in (
    "index_postings index_stats query_terms bm25_topk cosine_knn_topk rrf_hybrid_topk strategy_compare_pivot contribution_labels prompt_assembly no_context_guard rag_answers rrf_from_legs rag_responses rag_sources "
    "citation_extract source_renumber answer_parts rate_limit_fixed_window daily_quota question_validation"
).split()}

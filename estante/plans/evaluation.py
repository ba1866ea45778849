"""Queries over the gold questions: reading, validating, ranks, metrics, cited sources, latencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from estante.operators import evaluation as E
from estante.operators import rag, search
from estante.plans import retrieval as R
from estante.plans.retrieval import LISTS
from estante.runtime import table

STRATEGIES = [*LISTS, "rrf"]
NAMES = {"Livro do Jogador": "jogador", "Guia do Mestre": "mestre", "Manual dos Monstros": "monstro"}


def _gold(spark, d):
    return E.questions(table(spark, d, "perguntas"))


def gold_questions(spark, d):
    q = _gold(spark, d)
    return q.select("line_no", "id", "type", "answerable", F.size("pages").cast("bigint").alias("pages"), F.size("chunk_ids").cast("bigint").alias("chunk_ids"), F.array_join(F.transform("pages", lambda p: F.concat(p["book"], F.lit(":"), p["start"].cast("string"), F.lit("-"), p["end"].cast("string"))), " ").alias("intervals"))


def gold_relation_validate(spark, d):
    chunks = table(spark, d, "chunks").select("chunk_id", "book", "page_start", "page_end")
    return E.validate(_gold(spark, d), chunks).groupBy("severity", "code").agg(F.count("*").cast("bigint").alias("n"))


def interval_overlap_join(spark, d):
    """Chunks of the gold intervals' pages: a range join on the book and ten-page buckets, so a skewed book is dealt over its buckets."""
    wide = 10
    gold = _gold(spark, d).select("line_no", F.explode("pages").alias("p")).select("line_no", "p.*").distinct()
    asked = gold.withColumn("bucket", F.explode(F.sequence((F.col("start") / wide).cast("int"), (F.col("end") / wide).cast("int"))))
    c = table(spark, d, "chunks").where("page_start is not null").select("chunk_id", "book", F.col("page_start").alias("a"), F.greatest("page_start", F.coalesce("page_end", "page_start")).alias("z")).distinct()
    held = c.withColumn("bucket", F.explode(F.sequence((F.col("a") / wide).cast("int"), (F.col("z") / wide).cast("int"))))
    # a pair is counted in the first bucket that both sides have
    first = F.col("bucket") == (F.greatest("a", "start") / wide).cast("int")
    return asked.join(held, ["book", "bucket"]).where((F.col("a") <= F.col("end")) & (F.col("start") <= F.col("z")) & first).groupBy("line_no", "book", "start", "end").agg(F.countDistinct("chunk_id").cast("bigint").alias("chunks"))


def _asked(spark, d):
    q = _gold(spark, d).where("answerable and size(chunk_ids) > 0 and id is not null")
    return search.first_by_id(q, "id", "line_no").select(F.col("id").alias("query_id"), "type", "chunk_ids", "pages")


def _hits(spark, d):
    return table(spark, d, "resultados").select("query_id", "strategy", "chunk_id", "rank").distinct()


def _ranks(spark, d):
    return E.reference_ranks(_asked(spark, d), _hits(spark, d))


def reference_rank(spark, d):
    return _ranks(spark, d).select("query_id", "type", "strategy", "first_rank")


def hit_by_type_grouping_sets(spark, d):
    return E.retrieval_table(_ranks(spark, d))


def mcnemar_pairs(spark, d):
    return E.significance(_ranks(spark, d), STRATEGIES)


def per_question_errors(spark, d):
    return E.per_question(_ranks(spark, d), STRATEGIES).withColumn("type_order", E.type_order(F.col("type")))


def _cited(spark, d):
    """The first three of the lexical list stand for an answer's citations."""
    chunks = search.first_by_id(table(spark, d, "chunks"), "chunk_id", "ordinal").select("chunk_id", "book", "page_start", "page_end")
    top = _hits(spark, d).where("strategy = 'bm25' and rank <= 3").join(chunks, "chunk_id")
    held = F.struct("book", F.col("page_start").alias("start"), F.coalesce("page_end", "page_start").alias("end"))
    by_question = top.groupBy("query_id").agg(F.collect_list("chunk_id").alias("cited"), F.collect_list("book").alias("books"), F.collect_list(F.when(F.col("page_start").isNotNull(), held)).alias("intervals"))
    return _asked(spark, d).join(by_question, "query_id")


def prf_by_question(spark, d):
    c = _cited(spark, d)
    books = F.transform("pages", lambda p: p["book"])
    each = F.array(
        F.struct(F.lit("chunk").alias("level"), E.prf_sets(F.col("cited"), F.col("chunk_ids")).alias("m")),
        F.struct(F.lit("page").alias("level"), E.prf_pages(F.col("intervals"), F.col("pages")).alias("m")),
        F.struct(F.lit("book").alias("level"), E.prf_sets(F.col("books"), books).alias("m")),
    )
    return c.select("query_id", F.size("pages").alias("n_pages"), F.explode(each).alias("e")).where("e.level = 'chunk' or n_pages > 0").select("query_id", "e.level", "e.m.*")


def source_table(spark, d):
    m = prf_by_question(spark, d)
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(c)
    return m.groupBy("level").agg(F.count("*").cast("bigint").alias("n"), mean("precision"), mean("recall"), mean("f1"), F.count_if("any_correct").cast("bigint").alias("any_correct"), F.count_if("no_citation").cast("bigint").alias("no_citation"))


def latency_percentiles(spark, d):
    return E.latency_table(table(spark, d, "events"), "event_type", "value")


def top_passages(spark, d):
    hits = table(spark, d, "resultados").select("query_id", "strategy", "chunk_id", "score", "rank").distinct()
    return E.top_passages(hits, _asked(spark, d))


def run_plan(spark, d):
    q = _gold(spark, d).select(F.col("line_no").cast("string").alias("query_id"), "answerable", "chunk_ids")
    return E.run_plan(q, STRATEGIES[:3], 2).groupBy("step", "strategy", "mode", "round").agg(F.count("*").cast("bigint").alias("n"), F.sum(F.size("chunk_ids")).cast("bigint").alias("refs"))


def gold_invalid_ids(spark, d):
    return E.invalid_ids(table(spark, d, "perguntas")).select("line_no", "code", "detail")


def gold_usable(spark, d):
    """The lines that a run takes: those without an error, an id that is none being one."""
    gold, perguntas = _gold(spark, d), table(spark, d, "perguntas")
    chunks = table(spark, d, "chunks").select("chunk_id", "book", "page_start", "page_end")
    return E.usable(gold, E.validate(gold, chunks).unionByName(E.invalid_ids(perguntas))).select("line_no", "id", "type")


def _asked_twentieth(spark, d):
    q = _gold(spark, d).where("answerable and size(chunk_ids) > 0 and line_no % 20 = 0")
    return q.select(F.col("line_no").cast("string").alias("query_id"), "type", "chunk_ids", "pages")


def source_report_modes(spark, d):
    """Cited sources of answers with passages, from live search, and without."""
    held = F.struct("book", F.col("page_start").alias("start"), F.coalesce("page_end", "page_start").alias("end"))
    responses, sources = R._responses(spark, d)
    cited = sources.groupBy("query_id").agg(F.collect_list("chunk_id").alias("chunks"), F.collect_list(F.when(F.col("page_start").isNotNull(), held)).alias("intervals"), F.collect_list("book").alias("books"))
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    lists = [empty("chunks", "array<string>"), empty("intervals", E.INTERVALS), empty("books", "array<string>")]
    with_passages = responses.select("query_id").join(cited, "query_id", "left").select("query_id", F.lit(E.WITH).alias("mode"), *lists)
    named = E.free_text_sources(F.col("answer"), NAMES)
    alone = rag.answers_alone(R._questions(spark, d)).select("query_id", F.lit(E.WITHOUT).alias("mode"), F.array().cast("array<string>").alias("chunks"), named.alias("intervals"), F.transform(named, lambda x: x["book"]).alias("books"))
    return E.source_report(E.source_measures(with_passages.unionByName(alone), _asked_twentieth(spark, d)))


def per_question_cited(spark, d):
    """The error table over the stored lists: the answers take the eight passages of the stored fusion."""
    asked, hits = _asked(spark, d), R._hits(spark, d)
    _, sources = rag.respond(R._asked(spark, d), lambda q, k: search.rrf(hits, k, ["cosseno", "bm25"]), R._once(spark, d), k=R.SHOWN)
    shown = search.rrf(hits, R.SHOWN, ["cosseno", "bm25"]).select("query_id", "chunk_id")
    return E.error_table(_ranks(spark, d), STRATEGIES, shown, sources.select("query_id", "chunk_id"), asked)


def resume_pending(spark, d):
    asked = table(spark, d, "perguntas").where("id is not null").select(F.col("id").alias("query_id")).distinct()
    return E.pending(asked, table(spark, d, "resultados"))


def id_filter_unknown(spark, d):
    asked = table(spark, d, "perguntas").select(F.col("id").alias("query_id")).distinct()
    return E.unknown_ids(table(spark, d, "resultados").select("query_id").distinct(), asked)


def validation_summary(spark, d):
    return E.summary(_gold(spark, d))


def foreign_ids(spark, d):
    """Ids of documents that the questions' lines do not hold: a filter by id names those it does not know."""
    wanted = table(spark, d, "documents").select(F.col("doc_id").alias("query_id")).distinct()
    return E.unknown_ids(wanted, table(spark, d, "perguntas").select(F.col("line_no").alias("query_id")))


def sources_in_answers(spark, d):
    """Sources named in the answers without passages, and, with the books' own names, in the texts of documents."""
    show = lambda c: F.array_join(F.transform(E.free_text_sources(F.col(c), NAMES), lambda p: F.concat_ws(":", p["book"], p["start"].cast("string"), p["end"].cast("string"))), " ").alias("sources")
    return rag.answers_alone(R._questions(spark, d)).select("query_id", show("answer"), F.array_join(E.books_in_parentheses(F.col("answer"), NAMES), " ").alias("books"))


def free_text_sources(spark, d):
    """Sources named in running text, built from each question's line number."""
    n = F.col("line_no").cast("string")
    said = F.concat(F.lit("Veja (Livro do Jogador, p. "), n, F.lit("-"), (F.col("line_no") + 2).cast("string"), F.lit(" e 7) e o Guia do Mestre, págs. 3, 4; ver (Manual dos Monstros)."))
    q = table(spark, d, "perguntas").select("line_no", said.alias("t"))
    show = F.array_join(F.transform(E.free_text_sources(F.col("t"), NAMES), lambda p: F.concat_ws(":", p["book"], p["start"].cast("string"), p["end"].cast("string"))), " ")
    return q.select("line_no", show.alias("sources"), F.array_join(E.books_in_parentheses(F.col("t"), NAMES), " ").alias("books"))


_NORM = "translate(lower(trim({})), 'áàâãäåéèêëíìîïóòôõöúùûüçñýÿ', 'aaaaaaeeeeiiiiooooouuuucnyy')"
_GOLD = rf"""(SELECT line_no, trim(id) AS id, pergunta, {_NORM.format('tipo')} AS type,
    list_transform(list_filter(regexp_split_to_array(coalesce(paginas_referencia, ''), '[\s;|,]+'), lambda p: regexp_matches(p, '^[\p{{L}}\p{{N}}_-]+:\p{{N}}+([-–]\p{{N}}+)?$')),
        lambda p: {{'book': CASE lower(split_part(p, ':', 1)) WHEN 'monstros' THEN 'monstro' WHEN 'manual' THEN 'monstro' ELSE lower(split_part(p, ':', 1)) END, 'start': CAST(regexp_extract(p, ':(\d+)', 1) AS INT),
            'end': greatest(CAST(regexp_extract(p, ':(\d+)', 1) AS INT), CAST(regexp_extract(p, '(\d+)$', 1) AS INT))}}) AS pages,
    list_filter(u, lambda x, i: list_position(u, x) = i) AS chunk_ids,
    CASE WHEN {_NORM.format('respondivel')} IN ('sim', 's', 'true', '1') THEN true WHEN {_NORM.format('respondivel')} IN ('nao', 'n', 'false', '0') THEN false END AS answerable
    FROM (SELECT *, list_transform(list_filter(regexp_split_to_array(coalesce(chunks_referencia, ''), '[\s;|,]+'), lambda p: regexp_matches(p, '^[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}$')), lambda p: lower(p)) AS u FROM perguntas))"""
_FIRST_ASKED = f"(SELECT id AS query_id, type, chunk_ids, pages FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY line_no) AS rn FROM {_GOLD} WHERE answerable AND len(chunk_ids) > 0 AND id IS NOT NULL) WHERE rn = 1)"
_RANKS = f"""(SELECT h.query_id, a.type, h.strategy, min(h.rank) FILTER (WHERE list_contains(a.chunk_ids, h.chunk_id)) AS first_rank
    FROM (SELECT DISTINCT query_id, strategy, chunk_id, rank FROM resultados) h JOIN {_FIRST_ASKED} a USING (query_id) GROUP BY 1, 2, 3)"""
_MEASURES = "count(*) AS n, " + ", ".join(f"round(avg(CASE WHEN first_rank <= {k} THEN 1e0 ELSE 0e0 END), 6) AS hit_{k}" for k in E.CUTS) + ", round(avg(CASE WHEN first_rank <= 8 THEN 1e0 / first_rank ELSE 0e0 END), 6) AS mrr_8, count(*) FILTER (WHERE first_rank IS NULL) AS outside"
_OVER = "(SELECT DISTINCT line_no, p.book AS book, p.\"start\" AS a, p.\"end\" AS z FROM (SELECT line_no, unnest(pages) AS p FROM {}))"
_PAIRS = ", ".join(f"('{a}', '{b}')" for i, a in enumerate(STRATEGIES) for b in STRATEGIES[i + 1 :])
_FIRST_CHUNK = "(SELECT chunk_id, book, page_start, coalesce(page_end, page_start) AS page_end FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY ordinal) AS rn FROM chunks) WHERE rn = 1)"
_MEETS = "len(list_filter({x}, lambda x: len(list_filter({y}, lambda y: x.book = y.book AND x.\"start\" <= y.\"end\" AND y.\"start\" <= x.\"end\")) > 0))"
_PRF = f"""
    WITH c AS (SELECT query_id, list(chunk_id) AS cited, list(book) AS books, coalesce(list({{'book': book, 'start': page_start, 'end': page_end}}) FILTER (WHERE page_start IS NOT NULL), []) AS intervals
        FROM (SELECT DISTINCT query_id, chunk_id, rank FROM resultados WHERE strategy = 'bm25' AND rank <= 3) JOIN {_FIRST_CHUNK} USING (chunk_id) GROUP BY 1),
    j AS (SELECT *, list_transform(pages, lambda p: p.book) AS ref_books FROM {_FIRST_ASKED} JOIN c USING (query_id)),
    m AS (SELECT query_id, 'chunk' AS level, len(list_intersect(list_distinct(cited), list_distinct(chunk_ids))) AS correct, len(list_distinct(cited)) AS cited, len(list_intersect(list_distinct(cited), list_distinct(chunk_ids))) AS covered, len(list_distinct(chunk_ids)) AS refs FROM j
        UNION ALL SELECT query_id, 'page', {_MEETS.format(x='intervals', y='pages')}, len(intervals), {_MEETS.format(x='pages', y='intervals')}, len(pages) FROM j WHERE len(pages) > 0
        UNION ALL SELECT query_id, 'book', len(list_intersect(list_distinct(books), list_distinct(ref_books))), len(list_distinct(books)), len(list_intersect(list_distinct(books), list_distinct(ref_books))), len(list_distinct(ref_books)) FROM j WHERE len(pages) > 0),
    p AS (SELECT *, CASE WHEN cited = 0 THEN 0e0 ELSE correct / CAST(cited AS DOUBLE) END AS precision, CASE WHEN refs = 0 THEN 0e0 ELSE covered / CAST(refs AS DOUBLE) END AS recall FROM m),
    f AS (SELECT query_id, level, precision, recall, CASE WHEN precision + recall = 0 THEN 0e0 ELSE 2 * precision * recall / (precision + recall) END AS f1, correct > 0 AS any_correct, cited = 0 AS no_citation FROM p)"""

_TWENTIETH = f"(SELECT CAST(line_no AS VARCHAR) AS query_id, chunk_ids, pages FROM {_GOLD} WHERE answerable AND len(chunk_ids) > 0 AND line_no % 20 = 0)"
_STORED = f"""
    f AS (SELECT query_id, chunk_id, max(rank) FILTER (WHERE strategy = 'cosseno') AS rc, max(rank) FILTER (WHERE strategy = 'bm25') AS rb FROM {R._PLACED} WHERE strategy IN ('cosseno', 'bm25') GROUP BY 1, 2),
    s AS (SELECT *, round(coalesce(1e0 / (60 + rc), 0e0) + coalesce(1e0 / (60 + rb), 0e0), 9) AS score FROM f),
    shown AS (SELECT query_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 8),
    t AS (SELECT query_id, chunk_id, text, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS passage FROM shown JOIN {R._FIRST} USING (chunk_id) WHERE query_id IN (SELECT query_id FROM {R._ASKED} WHERE query_text IS NOT NULL)),
    a AS (SELECT query_id, substr(split_part(trim(text), chr(10), 1), 1, 200) || ' [1]' AS text FROM t WHERE passage = 1),
    cited AS (SELECT query_id, chunk_id FROM (SELECT query_id, unnest({R._CITED}) AS passage FROM a) JOIN t USING (query_id, passage))"""

SQL = {
    "top_passages": f"""SELECT h.query_id, strategy, rank, h.chunk_id, round_even(score, 6) AS score, coalesce(list_contains(a.chunk_ids, h.chunk_id), false) AS is_reference
        FROM (SELECT DISTINCT query_id, strategy, chunk_id, score, rank FROM resultados WHERE rank <= 8) h LEFT JOIN {_FIRST_ASKED} a USING (query_id)""",
    "run_plan": f"""WITH q AS (SELECT CASE WHEN answerable THEN len(chunk_ids) ELSE 0 END AS k FROM {_GOLD}),
        p(step, strategy, mode, round) AS (VALUES ('search', 'cosseno', NULL, 0), ('search', 'bm25', NULL, 0), ('search', 'reordenador', NULL, 0), ('answer', NULL, 'com', 1), ('answer', NULL, 'sem', 1), ('answer', NULL, 'com', 2), ('answer', NULL, 'sem', 2))
        SELECT step, strategy, mode, round, count(*) AS n, CAST(sum(k) AS BIGINT) AS refs FROM q, p GROUP BY 1, 2, 3, 4""",
    "gold_invalid_ids": r"""SELECT DISTINCT line_no, 'invalid chunk id' AS code, u AS detail FROM (SELECT line_no, unnest(regexp_split_to_array(chunks_referencia, '[\s;|,]+')) AS u FROM perguntas)
        WHERE u <> '' AND NOT regexp_matches(u, '^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$')""",
    "gold_usable": f"""
        WITH q AS (SELECT * FROM {_GOLD}), e AS (
            SELECT line_no FROM q WHERE id IS NULL OR id = '' OR coalesce(trim(pergunta), '') = '' OR answerable IS NULL OR (answerable AND len(chunk_ids) = 0)
            UNION SELECT line_no FROM (SELECT line_no, min(line_no) OVER (PARTITION BY id) AS first FROM q WHERE id IS NOT NULL) WHERE line_no > first
            UNION SELECT line_no FROM (SELECT line_no, unnest(chunk_ids) AS c FROM q) WHERE c NOT IN (SELECT chunk_id FROM chunks WHERE chunk_id IS NOT NULL)
            UNION SELECT line_no FROM (SELECT line_no, unnest(regexp_split_to_array(chunks_referencia, '[\\s;|,]+')) AS u FROM perguntas) WHERE u <> '' AND NOT regexp_matches(u, '^[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}$'))
        SELECT line_no, id, type FROM q WHERE line_no NOT IN (SELECT line_no FROM e)""",
    "source_report_modes": f"""
        WITH {R._SAID}, u AS (SELECT query_id, unnest(v) AS passage FROM r), k AS (SELECT * FROM {_TWENTIETH}),
        cc AS (SELECT u.query_id, c.chunk_id, c.book, c.page_start, c.page_end FROM u JOIN top ON top.query_id = u.query_id AND top.rank = u.passage JOIN {_FIRST_CHUNK} c ON c.chunk_id = top.chunk_id),
        j AS (SELECT k.query_id, 'com' AS mode, any_value(k.chunk_ids) AS chunk_ids, any_value(k.pages) AS pages, coalesce(list(chunk_id) FILTER (WHERE chunk_id IS NOT NULL), []) AS cited, coalesce(list(book) FILTER (WHERE book IS NOT NULL), []) AS books,
                coalesce(list({{'book': book, 'start': page_start, 'end': page_end}}) FILTER (WHERE page_start IS NOT NULL), []) AS intervals FROM k LEFT JOIN cc USING (query_id) GROUP BY 1
            UNION ALL SELECT query_id, 'sem', chunk_ids, pages, [], ['jogador'], [{{'book': 'jogador', 'start': CAST((10 + length(query_text)) % 40 + 1 AS INT), 'end': CAST((10 + length(query_text)) % 40 + 1 AS INT)}}] FROM k JOIN {R._QUESTIONS} USING (query_id) WHERE query_text IS NOT NULL),
        b AS (SELECT *, list_transform(pages, lambda p: p.book) AS ref_books FROM j),
        mm AS (SELECT mode, 'chunk' AS level, len(list_intersect(list_distinct(cited), list_distinct(chunk_ids))) AS correct, len(list_distinct(cited)) AS cited, len(list_intersect(list_distinct(cited), list_distinct(chunk_ids))) AS covered, len(list_distinct(chunk_ids)) AS refs FROM b WHERE mode = 'com'
            UNION ALL SELECT mode, 'page', {_MEETS.format(x='intervals', y='pages')}, len(intervals), {_MEETS.format(x='pages', y='intervals')}, len(pages) FROM b WHERE len(pages) > 0
            UNION ALL SELECT mode, 'book', len(list_intersect(list_distinct(books), list_distinct(ref_books))), len(list_distinct(books)), len(list_intersect(list_distinct(books), list_distinct(ref_books))), len(list_distinct(ref_books)) FROM b WHERE len(pages) > 0),
        pp AS (SELECT *, CASE WHEN cited = 0 THEN 0e0 ELSE correct / CAST(cited AS DOUBLE) END AS precision, CASE WHEN refs = 0 THEN 0e0 ELSE covered / CAST(refs AS DOUBLE) END AS recall FROM mm)
        SELECT mode, level, count(*) AS n, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(CASE WHEN precision + recall = 0 THEN 0e0 ELSE 2 * precision * recall / (precision + recall) END), 6) AS f1,
            count(*) FILTER (WHERE correct > 0) AS any_correct, count(*) FILTER (WHERE cited = 0) AS no_citation FROM pp GROUP BY 1, 2""",
    "per_question_cited": f"""
        WITH {_STORED}, x AS (SELECT query_id, unnest(chunk_ids) AS chunk_id FROM {_FIRST_ASKED})
        SELECT query_id, type, {', '.join(f"min(first_rank) FILTER (WHERE strategy = '{s}') AS {s}" for s in STRATEGIES)}, query_id IN (SELECT query_id FROM shown JOIN x USING (query_id, chunk_id)) AS in_passages, query_id IN (SELECT query_id FROM cited JOIN x USING (query_id, chunk_id)) AS is_cited
        FROM {_RANKS} GROUP BY 1, 2""",
    "foreign_ids": "SELECT DISTINCT doc_id AS query_id FROM documents WHERE doc_id NOT IN (SELECT line_no FROM perguntas)",
    "sources_in_answers": f"SELECT query_id, 'jogador:' || n || ':' || n AS sources, 'jogador' AS books FROM (SELECT query_id, (10 + length(query_text)) % 40 + 1 AS n FROM {R._QUESTIONS} WHERE query_text IS NOT NULL)",
    "gold_questions": f"SELECT line_no, id, type, answerable, len(pages) AS pages, len(chunk_ids) AS chunk_ids, array_to_string(list_transform(pages, lambda p: p.book || ':' || p.\"start\" || '-' || p.\"end\"), ' ') AS intervals FROM {_GOLD}",
    "gold_relation_validate": f"""
        WITH q AS (SELECT * FROM {_GOLD}),
        k AS (SELECT chunk_id, book, page_start, coalesce(page_end, page_start) AS page_end FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY book NULLS FIRST, page_start NULLS FIRST, page_end NULLS FIRST) AS rn FROM chunks) WHERE rn = 1),
        l AS (SELECT u.line_no, u.pages, k.* FROM (SELECT line_no, pages, unnest(chunk_ids) AS cid FROM q) u LEFT JOIN k ON u.cid = k.chunk_id),
        i AS (SELECT 'error' AS severity, 'no id' AS code FROM q WHERE id IS NULL OR id = '' UNION ALL SELECT 'error', 'no question' FROM q WHERE coalesce(trim(pergunta), '') = ''
            UNION ALL SELECT 'error', 'answerable unreadable' FROM q WHERE answerable IS NULL UNION ALL SELECT 'warning', 'unknown type' FROM q WHERE NOT coalesce(type IN ('nominal', 'parafrase', 'combinacao'), false)
            UNION ALL SELECT 'error', 'id again' FROM (SELECT line_no, min(line_no) OVER (PARTITION BY id) AS first FROM q WHERE id IS NOT NULL) WHERE line_no > first
            UNION ALL SELECT 'error', 'answerable without chunks' FROM q WHERE answerable AND len(chunk_ids) = 0 UNION ALL SELECT 'warning', 'unanswerable with chunks' FROM q WHERE NOT answerable AND len(chunk_ids) > 0
            UNION ALL SELECT 'warning', 'no pages' FROM q WHERE answerable AND len(pages) = 0 UNION ALL SELECT 'error', 'unknown chunk' FROM l WHERE chunk_id IS NULL
            UNION ALL SELECT 'warning', 'chunk outside the pages' FROM l WHERE page_start IS NOT NULL AND len(pages) > 0 AND len(list_filter(pages, lambda p: p.book = book AND p."start" <= page_end AND page_start <= p."end")) = 0)
        SELECT severity, code, count(*) AS n FROM i GROUP BY 1, 2""",
    "interval_overlap_join": f"""SELECT g.line_no, g.book, g.a AS "start", g.z AS "end", count(DISTINCT c.chunk_id) AS chunks FROM {_OVER.format(_GOLD)} g
        JOIN (SELECT chunk_id, book, page_start AS s, greatest(page_start, coalesce(page_end, page_start)) AS e FROM chunks WHERE page_start IS NOT NULL) c ON c.book = g.book AND c.s <= g.z AND g.a <= c.e GROUP BY 1, 2, 3, 4""",
    "reference_rank": f"SELECT query_id, type, strategy, first_rank FROM {_RANKS}",
    "hit_by_type_grouping_sets": f"SELECT type, strategy, {_MEASURES}, CAST(grouping(type) AS INT) AS overall FROM {_RANKS} GROUP BY GROUPING SETS ((strategy), (type, strategy))",
    "mcnemar_pairs": f"""
        WITH r AS (SELECT * FROM {_RANKS}), p(a, b) AS (VALUES {_PAIRS}),
        c AS (SELECT p.a, p.b, k, count(*) FILTER (WHERE coalesce(x.first_rank <= k, false) AND NOT coalesce(y.first_rank <= k, false)) AS only_a, count(*) FILTER (WHERE coalesce(y.first_rank <= k, false) AND NOT coalesce(x.first_rank <= k, false)) AS only_b
            FROM p JOIN r x ON x.strategy = p.a JOIN r y ON y.strategy = p.b AND y.query_id = x.query_id, (SELECT unnest([1, 5, 8]) AS k) GROUP BY 1, 2, 3)
        SELECT a, b, k, only_a, only_b, CASE WHEN only_a + only_b = 0 THEN 1e0 ELSE round(least(1e0, 2 * list_sum(list_transform(range(0, least(only_a, only_b) + 1),
            lambda i: exp(lgamma(only_a + only_b + 1e0) - lgamma(i + 1e0) - lgamma(only_a + only_b - i + 1e0) - (only_a + only_b) * ln(2e0))))), 6) END AS p FROM c""",
    "per_question_errors": f"""SELECT query_id, type, {', '.join(f"min(first_rank) FILTER (WHERE strategy = '{s}') AS {s}" for s in STRATEGIES)}, coalesce(min(first_rank) <= 8, false) AS in_passages,
        CASE type WHEN 'nominal' THEN 1 WHEN 'parafrase' THEN 2 WHEN 'combinacao' THEN 3 ELSE 4 END AS type_order FROM {_RANKS} GROUP BY 1, 2""",
    "prf_by_question": _PRF + " SELECT * FROM f",
    "source_table": _PRF + " SELECT level, count(*) AS n, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, count(*) FILTER (WHERE any_correct) AS any_correct, count(*) FILTER (WHERE no_citation) AS no_citation FROM f GROUP BY 1",
    "latency_percentiles": "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, round(sum(value), 4) AS total FROM events GROUP BY 1",
    "resume_pending": "SELECT DISTINCT id AS query_id FROM perguntas WHERE id IS NOT NULL AND id NOT IN (SELECT query_id FROM resultados WHERE query_id IS NOT NULL)",
    "id_filter_unknown": "SELECT DISTINCT query_id FROM resultados WHERE query_id NOT IN (SELECT id FROM perguntas WHERE id IS NOT NULL)",
    "validation_summary": f"SELECT type, answerable, count(*) AS n, count(DISTINCT id) AS ids FROM {_GOLD} GROUP BY 1, 2",
    "free_text_sources": "SELECT line_no, 'jogador:' || line_no || ':' || (line_no + 2) || ' jogador:7:7 mestre:3:3 mestre:4:4' AS sources, 'jogador monstro' AS books FROM perguntas",
}
QUERIES = {f: globals()[f] for f in (
    "gold_questions gold_relation_validate interval_overlap_join reference_rank hit_by_type_grouping_sets mcnemar_pairs per_question_errors prf_by_question source_table "
    "top_passages run_plan gold_invalid_ids gold_usable source_report_modes per_question_cited foreign_ids sources_in_answers latency_percentiles resume_pending id_filter_unknown validation_summary free_text_sources"
).split()}

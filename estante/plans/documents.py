"""Queries over blocks, chunks and documents: preparing, chunking, identity, diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from estante.functions import text as T
from estante.operators import chunking, embedding, preprocess, search
from estante.runtime import spread, table

ACCENT_FOLD = f"translate(lower(%s), '{T.ACCENTS}', '{T.PLAIN}')"


def chunk_content_id(spark, d):
    docs = table(spark, d, "documents").where("source is not null and text is not null")
    return docs.select("doc_id", T.chunk_id(F.col("source"), F.col("text")).alias("chunk_id"))


def dedup_first_by_id(spark, d):
    return search.first_by_id(table(spark, d, "chunks"), "chunk_id", "ordinal", F.col("page_start").asc_nulls_first(), F.col("page_end").asc_nulls_first()).select("chunk_id", "ordinal", "book")


def line_explode_slice(spark, d):
    return preprocess.line_slice(table(spark, d, "documents").select("doc_id", "text"), "text", 2, 4).select("doc_id", "line_no", "line")


def _chunk_lines(spark, d):
    once = search.first_by_id(table(spark, d, "chunks"), "chunk_id", "ordinal").select(F.col("chunk_id").alias("doc_id"), "text")
    return preprocess.line_slice(once, "text", 1)


def page_number_carry_forward(spark, d):
    return preprocess.page_of_lines(_chunk_lines(spark, d)).groupBy("doc_id", "page").agg(F.count("*").cast("bigint").alias("lines"))


def comment_and_tag_strip(spark, d):
    chunks = table(spark, d, "chunks").select("chunk_id", F.posexplode(preprocess.split_lines(F.col("text"))).alias("i", "line"))
    cleaned = chunks.withColumn("clean", preprocess.clean_line(F.col("line")))
    return cleaned.where("clean <> trim(line)").groupBy("clean").agg(F.count("*").cast("bigint").alias("n"))


def markdown_blocks(spark, d):
    once = search.first_by_id(table(spark, d, "chunks"), "chunk_id", "ordinal")
    return preprocess.blocks(once, "chunk_id").select("chunk_id", "block_idx", "kind", "page", F.size("lines").alias("n_lines"), "text")


def token_estimate_budget(spark, d):
    t = T.token_estimate(F.col("text"))
    return table(spark, d, "chunks").groupBy("book").agg(F.sum(t).alias("tokens"), F.max(t).alias("longest"), F.count_if(t > 512).cast("bigint").alias("over_budget"))


def _chunked(rules):
    def run(spark, d):
        chunks = chunking.chunk_blocks(table(spark, d, "blocos"), rules)
        return chunking.with_ids(chunks, F.regexp_extract("doc_id", r"^(\p{L}+)", 1))

    return run


chunk_paragraph_token = _chunked(None)
chunk_creatures = _chunked(chunking.CREATURE)
chunk_spells = _chunked(chunking.SPELL)
chunk_items = _chunked(chunking.ITEM)


def _chunk_words(rules):
    """What no way of cutting may change: how many different words a document's chunks hold."""

    def run(spark, d):
        words = chunking.chunk_blocks(table(spark, d, "blocos"), rules).select("doc_id", F.explode(F.split("text", r"\s+")).alias("w")).where("w <> ''")
        return words.groupBy("doc_id").agg(F.countDistinct("w").cast("bigint").alias("words"))

    return run


chunk_words_paragraph_token = _chunk_words(None)
chunk_words_creatures = _chunk_words(chunking.CREATURE)
chunk_words_spells = _chunk_words(chunking.SPELL)
chunk_words_items = _chunk_words(chunking.ITEM)


def caps_name_and_title_case(spark, d):
    firsts = table(spark, d, "blocos").where("kind = 'paragraph'").select(F.get("lines", F.lit(0)).alias("line")).distinct()
    name = F.col("line")
    return firsts.where(T.is_caps_name(name)).select("line", T.title_case(T.clean_name(name)).alias("entity_name"))


def chunk_diagnostics(spark, d):
    c = table(spark, d, "chunks")
    return chunking.diagnose(c).groupBy("book").agg(*[F.count_if(F.col(x)).cast("bigint").alias(x) for x in ("is_table", "is_cut_table", "is_clean_name")], F.count("*").cast("bigint").alias("n"))


def boundary_lead_check(spark, d):
    return chunking.diagnose(table(spark, d, "chunks").distinct()).where("is_suspicious").select("chunk_id", "ordinal", "book").distinct()


def chunk_run_stats(spark, d):
    return chunking.run_statistics(chunking.diagnose(table(spark, d, "chunks")))


def chunk_run_report(spark, d):
    return chunking.run_report(chunking.diagnose(table(spark, d, "chunks").distinct()))


def chunk_problems(spark, d):
    return chunking.problem_chunks(chunking.diagnose(table(spark, d, "chunks").distinct())).distinct()


def chunk_boundaries(spark, d):
    return chunking.boundary_dump(table(spark, d, "chunks")).distinct()


def filter_type_and_text(spark, d):
    c = table(spark, d, "chunks")
    return c.where(~F.col("is_fallback") & (F.lower("text").contains("lanterna") | F.lower(F.coalesce("entity_name", F.lit(""))).contains("lanterna"))).select("chunk_id", "ordinal", "entity_name")


def page_labels(spark, d):
    label = F.concat_ws(" — ", F.concat_ws(", ", T.display_name(F.col("book")), T.page_label(F.col("page_start"), F.col("page_end"))), F.col("entity_name"))
    return table(spark, d, "chunks").select("chunk_id", label.alias("title"), T.preview(F.col("text")).alias("preview")).distinct()


def hashed_embedding(spark, d):
    docs = embedding.embeddable(table(spark, d, "documents"))
    return embedding.hashed_counts(spread(docs.select("doc_id", "text")), ["doc_id"], "text").select("doc_id", "bucket", F.round("weight", 6).alias("weight"))


def book_counts_status(spark, d):
    c, v, i = table(spark, d, "chunks"), table(spark, d, "vetores"), table(spark, d, "documents").withColumnRenamed("source", "book")
    return search.store_status(c, v.where("vector is not null"), i)


def page_lookup(spark, d):
    return search.on_page(table(spark, d, "chunks"), "jogador", 50).select("chunk_id", "ordinal", "page_start", "page_end")


def page_lookup_all(spark, d):
    """How many chunks of each book stand on the first page of each document's entry: a look-up for every (book, page) that documents name."""
    asked = table(spark, d, "documents").where("source is not null and page is not null").select(F.col("source").alias("book"), "page").distinct()
    held = table(spark, d, "chunks").where("page_start is not null").select("chunk_id", "book", F.explode(F.sequence("page_start", F.greatest("page_start", F.coalesce("page_end", "page_start")))).alias("page"))
    return held.join(asked, ["book", "page"]).groupBy("book", "page").agg(F.countDistinct("chunk_id").cast("bigint").alias("chunks"))


def substring_search(spark, d):
    return search.containing(table(spark, d, "chunks"), "GUARDIÃ das marés").select("chunk_id", "ordinal")


_LINES = "SELECT {key}, generate_subscripts(l, 1) AS line_no, unnest(l) AS line FROM (SELECT {key}, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS l FROM {source} WHERE text IS NOT NULL)"
_CLEAN = r"""trim(regexp_replace(regexp_replace(CASE WHEN len(list_filter(regexp_split_to_array(trim(regexp_extract(line, '(?i)<!--\s*Page(?:Header|Footer)\s*=\s*"([^"]*)"\s*-->', 1)), '\s+'), lambda w: w <> '')) >= 3
    THEN regexp_replace(line, '(?i)<!--\s*Page(?:Header|Footer)\s*=\s*"([^"]*)"\s*-->', '\1', 'g') ELSE line END, '<!--.*?-->', '', 'g'), '(?i)</?(figure|figcaption|i|b|em|strong|sub|sup|u|span|mark|br|small)\s*/?>', '', 'g'))"""
_BLANKS = "concat(chr(32), chr(9), chr(10), chr(11), chr(12), chr(13), chr(160), chr(8195), chr(8201), chr(8239), chr(12288))"
_STRIP = "trim({}, " + _BLANKS + ")"
_FIRST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY ordinal) AS rn FROM chunks) WHERE rn = 1)"
_GUID = "concat(substr(h,7,2),substr(h,5,2),substr(h,3,2),substr(h,1,2),'-',substr(h,11,2),substr(h,9,2),'-',substr(h,15,2),substr(h,13,2),'-',substr(h,17,4),'-',substr(h,21,12))"
_TERMS = "list_filter(regexp_split_to_array(" + ACCENT_FOLD + ", '[^\\p{L}\\p{Nd}]+'), lambda t: t <> '')"
_FLAGS = """SELECT book, chunk_id, ordinal, entity_name, is_fallback, starts_with(lower(ltrim(text, ' ' || chr(9) || chr(10) || chr(13))), '<table') AS is_table,
    len(regexp_extract_all(text, '(?i)<table')) <> len(regexp_extract_all(text, '(?i)</table>')) AS is_cut_table,
    coalesce(length(trim(entity_name)) BETWEEN 2 AND 60 AND regexp_matches(upper(trim(entity_name)), '^[\\p{Lu}0-9][\\p{Lu}0-9 ,''/()+\\-\\.À-ſ]{1,58}$') AND NOT contains(trim(entity_name), '  '), false) AS is_clean_name FROM chunks"""

_SUSPICIOUS = (
    _FLAGS.replace("SELECT book,", r"""SELECT coalesce(NOT is_fallback AND NOT lead(is_fallback) OVER w AND lead(entity_name) OVER w IS NOT NULL
        AND NOT (regexp_matches(regexp_replace(text, '\s+$', ''), '(?i)[.!?:;"''’)\]]$|\bAÇÕES$') OR ends_with(regexp_replace(text, '\s+$', ''), 'm') OR ends_with(regexp_replace(text, '\s+$', ''), '>')
        OR regexp_matches(ltrim(string_split(regexp_replace(text, '\s+$', ''), chr(10))[-1]), '^[·<-]')), false) AS is_suspicious, book,""").replace("FROM chunks", "FROM (SELECT DISTINCT * FROM chunks)")
    + " WINDOW w AS (PARTITION BY book ORDER BY ordinal NULLS FIRST, chunk_id, page_start NULLS FIRST, page_end NULLS FIRST)"
)

SQL = {
    "chunk_content_id": f"SELECT doc_id, {_GUID} AS chunk_id FROM (SELECT doc_id, sha256(source || chr(10) || text) AS h FROM documents WHERE source IS NOT NULL AND text IS NOT NULL)",
    "dedup_first_by_id": "SELECT chunk_id, ordinal, book FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY ordinal, page_start NULLS FIRST, page_end NULLS FIRST) AS rn FROM chunks) WHERE rn = 1",
    "line_explode_slice": f"SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, line FROM ({_LINES.format(key='doc_id', source='documents')}) WHERE line_no BETWEEN 2 AND 4",
    "page_number_carry_forward": f"""
        WITH lines AS ({_LINES.format(key='chunk_id', source=_FIRST)}),
        marked AS (SELECT *, coalesce(sum(CAST(regexp_matches(line, '(?i)<!--\\s*PageBreak\\s*-->') AS INT)) OVER (PARTITION BY chunk_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg,
            try_cast(nullif(regexp_extract(line, '(?i)<!--\\s*PageNumber\\s*=\\s*"(\\d+)"\\s*-->', 1), '') AS INT) AS number FROM lines),
        pages AS (SELECT chunk_id, seg, arg_min(number, line_no) FILTER (WHERE number IS NOT NULL) AS n FROM marked GROUP BY 1, 2),
        carried AS (SELECT chunk_id, seg, last_value(n IGNORE NULLS) OVER w + seg - last_value(CASE WHEN n IS NOT NULL THEN seg END IGNORE NULLS) OVER w AS page FROM pages WINDOW w AS (PARTITION BY chunk_id ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
        SELECT chunk_id AS doc_id, CAST(page AS INT) AS page, count(*) AS lines FROM marked JOIN carried USING (chunk_id, seg) GROUP BY 1, 2""",
    # the scan's state goes from line to line; paragraphs are runs of lines, tables run from their opening
    "markdown_blocks": f"""
        WITH RECURSIVE raw AS ({_LINES.format(key='chunk_id', source=_FIRST)}),
        marked AS (SELECT *, coalesce(sum(CAST(regexp_matches(line, '(?i)<!--\\s*PageBreak\\s*-->') AS INT)) OVER (PARTITION BY chunk_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg,
            try_cast(nullif(regexp_extract(line, '(?i)<!--\\s*PageNumber\\s*=\\s*"(\\d+)"\\s*-->', 1), '') AS INT) AS number FROM raw),
        pages AS (SELECT chunk_id, seg, arg_min(number, line_no) FILTER (WHERE number IS NOT NULL) AS n FROM marked GROUP BY 1, 2),
        carried AS (SELECT chunk_id, seg, last_value(n IGNORE NULLS) OVER w + seg - last_value(CASE WHEN n IS NOT NULL THEN seg END IGNORE NULLS) OVER w AS page FROM pages WINDOW w AS (PARTITION BY chunk_id ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
        l AS (SELECT chunk_id, line_no, line, CAST(page AS INT) AS page, {_STRIP.format('lower(line)')} AS low, {_STRIP.format(_CLEAN)} AS clean FROM marked JOIN carried USING (chunk_id, seg)),
        o AS (SELECT *, CASE WHEN starts_with(low, '<table') THEN 'table' WHEN starts_with(low, '<figure') AND NOT contains(low, '</figure>') THEN 'figure' ELSE 'text' END AS opens FROM l),
        scan AS (SELECT chunk_id, line_no, opens AS mode, CASE WHEN opens <> 'text' AND contains(low, '</' || opens || '>') THEN 'text' ELSE opens END AS after, line_no AS began FROM o WHERE line_no = 1 UNION ALL
            SELECT o.chunk_id, o.line_no, CASE WHEN after = 'text' THEN opens ELSE after END, CASE WHEN after = 'text' AND opens = 'text' THEN 'text' WHEN contains(low, '</' || CASE WHEN after = 'text' THEN opens ELSE after END || '>') THEN 'text' WHEN after = 'text' THEN opens ELSE after END,
                CASE WHEN after = 'text' THEN o.line_no ELSE began END FROM scan JOIN o ON o.chunk_id = scan.chunk_id AND o.line_no = scan.line_no + 1),
        held AS (SELECT chunk_id, line_no, page, mode, CASE WHEN mode = 'table' THEN rtrim(regexp_replace(line, '<!--.*?-->', '', 'g'), {_BLANKS}) ELSE clean END AS t,
            CASE WHEN mode = 'table' THEN began ELSE line_no - row_number() OVER (PARTITION BY chunk_id, mode ORDER BY line_no) + 1 END AS island FROM scan JOIN l USING (chunk_id, line_no) WHERE mode = 'table' OR (mode = 'text' AND clean <> '')),
        b AS (SELECT chunk_id, mode, min(line_no) AS first_line, arg_min(page, line_no) AS page, count(*) AS n, string_agg(t, chr(10) ORDER BY line_no) AS t FROM held GROUP BY chunk_id, mode, island)
        SELECT chunk_id, CAST(row_number() OVER (PARTITION BY chunk_id ORDER BY first_line) - 1 AS INT) AS block_idx, CASE mode WHEN 'table' THEN 'table' ELSE 'paragraph' END AS kind, page,
            CAST(CASE mode WHEN 'table' THEN 0 ELSE n END AS INT) AS n_lines, CASE mode WHEN 'table' THEN {_STRIP.format('t')} ELSE t END AS text FROM b""",
    **{f"chunk_words_{x}": r"""SELECT doc_id, count(DISTINCT w) AS words FROM (SELECT doc_id, unnest(regexp_split_to_array(coalesce(CASE kind WHEN 'table' THEN text ELSE array_to_string(lines, chr(10)) END, ''), '\s+')) AS w FROM blocos)
        WHERE w <> '' GROUP BY 1""" for x in ("paragraph_token", "creatures", "spells", "items")},
    "comment_and_tag_strip": f"SELECT clean, count(*) AS n FROM (SELECT line, {_CLEAN} AS clean FROM (SELECT unnest(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10))) AS line FROM chunks)) WHERE clean <> trim(line) GROUP BY 1",
    "token_estimate_budget": "SELECT book, CAST(sum(length(text) // 4) AS BIGINT) AS tokens, max(length(text) // 4) AS longest, count(*) FILTER (WHERE length(text) // 4 > 512) AS over_budget FROM chunks GROUP BY 1",
    "chunk_diagnostics": f"SELECT book, count(*) FILTER (WHERE is_table) AS is_table, count(*) FILTER (WHERE is_cut_table) AS is_cut_table, count(*) FILTER (WHERE is_clean_name) AS is_clean_name, count(*) AS n FROM ({_FLAGS}) GROUP BY 1",
    "chunk_run_stats": f"""SELECT book, count(*) AS chunks, count(*) FILTER (WHERE NOT is_fallback) AS entities, count(*) FILTER (WHERE is_fallback) AS fallbacks, count(entity_name) AS named,
        count(*) FILTER (WHERE is_clean_name) AS clean_names, count(*) FILTER (WHERE is_table) AS tables, count(*) FILTER (WHERE is_cut_table) AS cut_tables,
        count(*) FILTER (WHERE is_cut_table OR (entity_name IS NOT NULL AND NOT is_clean_name)) AS problems FROM ({_FLAGS}) GROUP BY 1""",
    "caps_name_and_title_case": r"""
        WITH l AS (SELECT DISTINCT lines[1] AS line FROM blocos WHERE kind = 'paragraph'),
        w AS (SELECT line, trim(regexp_replace(line, '^#{1,6}\s+', '')) AS s FROM l),
        v AS (SELECT line, s, list_filter(list_transform(regexp_split_to_array(s, '\s+'), lambda x: regexp_replace(x, '[^\p{L}]', '', 'g')), lambda x: length(x) >= 2) AS words FROM w),
        ok AS (SELECT line, lower(trim(regexp_replace(trim(regexp_replace(s, '\s+', ' ', 'g')), '^[.,:;·\-—*]+|[.,:;·\-—*]+$', '', 'g'))) AS name FROM v
            WHERE length(s) BETWEEN 1 AND 80 AND len(words) > 0 AND len(list_filter(words, lambda x: NOT (lower(x) IN ('de','do','da','dos','das','e','ou','a','o','the','of') OR length(regexp_replace(x, '[^\p{Ll}]', '', 'g')) <= 1))) = 0)
        SELECT line, array_to_string(list_transform(list_filter(string_split(name, ' '), lambda x: x <> ''), lambda x, i: CASE WHEN i > 1 AND x IN ('de','do','da','dos','das','e','ou','a','o','the','of') THEN x
            ELSE array_to_string(list_transform(string_split(x, '-'), lambda p: upper(substr(p, 1, 1)) || substr(p, 2)), '-') END), ' ') AS entity_name FROM ok""",
    "filter_type_and_text": "SELECT chunk_id, ordinal, entity_name FROM chunks WHERE NOT is_fallback AND (contains(lower(text), 'lanterna') OR contains(lower(coalesce(entity_name, '')), 'lanterna'))",
    "page_labels": r"""SELECT DISTINCT chunk_id, concat_ws(' — ', concat_ws(', ', CASE book WHEN 'monstro' THEN 'Manual dos Monstros' WHEN 'jogador' THEN 'Livro do Jogador' WHEN 'mestre' THEN 'Guia do Mestre' ELSE book END,
        CASE WHEN page_start IS NULL THEN NULL WHEN page_end IS NULL OR page_end = page_start THEN 'p. ' || page_start ELSE 'p. ' || page_start || '–' || page_end END), entity_name) AS title,
        substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 160) AS preview FROM chunks""",
    "hashed_embedding": f"""
        WITH t AS (SELECT doc_id, CAST(('0x' || substr(md5(term), 1, 8)) AS BIGINT) % 64 AS bucket FROM (SELECT doc_id, unnest({_TERMS % 'text'}) AS term FROM documents WHERE trim(text) <> '')),
        c AS (SELECT doc_id, bucket, count(*) AS tf FROM t GROUP BY 1, 2)
        SELECT doc_id, bucket, round(tf / sqrt(CAST(sum(tf * tf) OVER (PARTITION BY doc_id) AS DOUBLE)), 6) AS weight FROM c""",
    "book_counts_status": """SELECT book, coalesce(c.n, 0) AS chunks, coalesce(v.n, 0) AS vectors, coalesce(i.n, 0) AS indexed FROM (SELECT book, count(*) AS n FROM chunks GROUP BY 1) c
        FULL JOIN (SELECT book, count(*) AS n FROM vetores WHERE vector IS NOT NULL GROUP BY 1) v USING (book) FULL JOIN (SELECT source AS book, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1) i USING (book)
        UNION ALL SELECT NULL, 0, 0, count(*) FROM documents WHERE source IS NULL HAVING count(*) > 0""",
    "boundary_lead_check": r"""
        WITH n AS (SELECT *, lead(is_fallback) OVER w AS nf, lead(entity_name) OVER w AS nn, regexp_replace(text, '\s+$', '') AS t FROM (SELECT DISTINCT * FROM chunks) WINDOW w AS (PARTITION BY book ORDER BY ordinal NULLS FIRST, chunk_id, page_start NULLS FIRST, page_end NULLS FIRST))
        SELECT DISTINCT chunk_id, ordinal, book FROM n WHERE NOT is_fallback AND NOT nf AND nn IS NOT NULL
        AND NOT (regexp_matches(t, '(?i)[.!?:;"''’)\]]$|\bAÇÕES$') OR ends_with(t, 'm') OR ends_with(t, '>') OR regexp_matches(ltrim(string_split(t, chr(10))[-1]), '^[·<-]'))""",
    "chunk_run_report": f"""SELECT book, count(*) AS chunks, count(*) FILTER (WHERE NOT is_fallback) AS entities, count(*) FILTER (WHERE is_fallback) AS fallbacks, count(entity_name) AS named,
        count(*) FILTER (WHERE is_clean_name) AS clean_names, count(*) FILTER (WHERE is_table) AS tables, count(*) FILTER (WHERE is_cut_table) AS cut_tables,
        count(*) FILTER (WHERE is_cut_table OR (entity_name IS NOT NULL AND NOT is_clean_name)) AS problems, count(*) FILTER (WHERE is_suspicious) AS suspicious,
        CASE WHEN count(entity_name) > 0 THEN round(100e0 * count(*) FILTER (WHERE is_clean_name) / count(entity_name), 6) ELSE 0e0 END AS clean_percent,
        count(*) FILTER (WHERE is_cut_table OR (entity_name IS NOT NULL AND NOT is_clean_name) OR is_suspicious) AS any_problem FROM ({_SUSPICIOUS}) GROUP BY 1""",
    "chunk_problems": f"""SELECT DISTINCT book, ordinal, chunk_id, is_cut_table AS cut_table, entity_name IS NOT NULL AND NOT is_clean_name AS bad_name, is_suspicious AS suspicious
        FROM ({_SUSPICIOUS}) WHERE is_cut_table OR (entity_name IS NOT NULL AND NOT is_clean_name) OR is_suspicious""",
    "chunk_boundaries": r"""SELECT DISTINCT book, ordinal, chunk_id, entity_name, substr(t, 1, 60) AS opening, right(t, 60) AS closing
        FROM (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM chunks WHERE NOT is_fallback)""",
    "page_lookup_all": """SELECT book, page, count(DISTINCT chunk_id) AS chunks FROM (SELECT DISTINCT source AS book, page FROM documents WHERE source IS NOT NULL AND page IS NOT NULL) JOIN chunks USING (book)
        WHERE page BETWEEN page_start AND greatest(page_start, coalesce(page_end, page_start)) GROUP BY 1, 2""",
    "page_lookup": "SELECT chunk_id, ordinal, page_start, page_end FROM chunks WHERE book = 'jogador' AND 50 BETWEEN page_start AND coalesce(page_end, page_start)",
    "substring_search": f"SELECT chunk_id, ordinal FROM chunks WHERE contains({ACCENT_FOLD % 'trim(text)'}, 'guardia das mares')",
}
QUERIES = {f: globals()[f] for f in (
    "chunk_content_id dedup_first_by_id line_explode_slice page_number_carry_forward comment_and_tag_strip markdown_blocks token_estimate_budget chunk_paragraph_token chunk_creatures chunk_spells chunk_items chunk_words_paragraph_token chunk_words_creatures chunk_words_spells chunk_words_items "
    "caps_name_and_title_case chunk_diagnostics boundary_lead_check chunk_run_stats chunk_run_report chunk_problems chunk_boundaries filter_type_and_text page_labels hashed_embedding book_counts_status page_lookup page_lookup_all substring_search"
).split()}

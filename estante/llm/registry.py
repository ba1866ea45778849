"""Every query of this subpackage, by name, with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from estante.llm import encoding, markup, neardup, ranking, scanned, tokens, vectors
from estante.runtime import table


def p1_found(spark, d):
    return scanned.noise_found(table(spark, d, "blocos"), table(spark, d, "chunks"), table(spark, d, "livros"))


def p1_repaired(spark, d):
    return scanned.repaired(table(spark, d, "blocos"), table(spark, d, "chunks"), table(spark, d, "livros"))


def p3_found(spark, d):
    return ranking.head_found(table(spark, d, "resultados"))


def p3_ranking(spark, d):
    return ranking.one_ranking(table(spark, d, "resultados")).select("query_id", "chunk_id", F.round("projection", 6).alias("projection"), "position")


def p3_loadings(spark, d):
    return ranking.component(table(spark, d, "resultados")).withColumn("loading", F.round("loading", 6))


def p4_found(spark, d):
    return markup.markup_found(table(spark, d, "chunks"), table(spark, d, "blocos"))


def p4_clean(spark, d):
    return markup.cleaned(table(spark, d, "chunks"), table(spark, d, "blocos"))


def p5_found(spark, d):
    return neardup.near_duplicate_pairs(table(spark, d, "chunks"))


def p5_groups(spark, d):
    return neardup.near_duplicate_groups(table(spark, d, "chunks"))


def p6_found(spark, d):
    return vectors.neighbours_found(table(spark, d, "vetores"))


def p7_found(spark, d):
    return encoding.garbled_found(table(spark, d, "perguntas"))


def p7_restored(spark, d):
    return encoding.garbled(table(spark, d, "perguntas")).select("line_no", "campo", "restored", "layers")


def p8_ids(spark, d):
    return tokens.token_ids(table(spark, d, "documents"))


def p9_containers(spark, d):
    return tokens.fill_containers(table(spark, d, "documents"))


def p9_residuals(spark, d):
    return tokens.container_residuals(tokens.fill_containers(table(spark, d, "documents")))


def p10_found(spark, d):
    return tokens.oversized_found(table(spark, d, "documents"))


def p10_pieces(spark, d):
    return tokens.split_oversized(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_repaired, p3_found, p3_ranking, p3_loadings, p4_found, p4_clean, p5_found, p5_groups, p6_found, p7_found, p7_restored, p8_ids, p9_containers, p9_residuals, p10_found, p10_pieces)}

_PAIRS = r"""
        WITH w AS (SELECT DISTINCT chunk_id, regexp_extract_all(lower(coalesce(entity_name, '') || ' ' || coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM chunks),
        g AS (SELECT DISTINCT chunk_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w),
        n AS (SELECT chunk_id, count(*) AS n FROM g GROUP BY 1),
        p AS (SELECT a.chunk_id AS a, b.chunk_id AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.chunk_id < b.chunk_id GROUP BY 1, 2)
        SELECT a AS chunk_a, b AS chunk_b FROM p JOIN n x ON x.chunk_id = a JOIN n y ON y.chunk_id = b WHERE k >= 0.6 * (x.n + y.n - k) - 1e-9"""

# the component by power iteration on the correlations of the scaled ranks
_COMPONENT = """
        WITH RECURSIVE o AS (SELECT query_id, strategy, chunk_id, min(rank) AS rank, max(score) AS score FROM resultados WHERE strategy IN ('cosseno', 'bm25', 'reordenador') AND query_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY 1, 2, 3),
        k AS (SELECT *, 1e0 - (row_number() OVER (PARTITION BY query_id, strategy ORDER BY rank NULLS LAST, score DESC NULLS LAST, chunk_id) - 1e0) / count(*) OVER (PARTITION BY query_id, strategy) AS s FROM o),
        w AS (SELECT query_id, chunk_id, max(s) FILTER (WHERE strategy = 'cosseno') AS a, max(s) FILTER (WHERE strategy = 'bm25') AS b, max(s) FILTER (WHERE strategy = 'reordenador') AS c FROM k GROUP BY 1, 2),
        x AS (SELECT query_id, chunk_id, coalesce(a, CASE WHEN count(a) OVER q > 0 THEN 0e0 ELSE 0.5e0 END) AS a, coalesce(b, CASE WHEN count(b) OVER q > 0 THEN 0e0 ELSE 0.5e0 END) AS b, coalesce(c, CASE WHEN count(c) OVER q > 0 THEN 0e0 ELSE 0.5e0 END) AS c
            FROM w WINDOW q AS (PARTITION BY query_id)),
        r AS (SELECT corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc FROM x),
        p(i, a, b, c) AS (SELECT 0, 1e0, 1e0, 1e0 UNION ALL SELECT i + 1, (a + ab * b + ac * c) / (abs(a + ab * b + ac * c) + abs(ab * a + b + bc * c) + abs(ac * a + bc * b + c)),
            (ab * a + b + bc * c) / (abs(a + ab * b + ac * c) + abs(ab * a + b + bc * c) + abs(ac * a + bc * b + c)), (ac * a + bc * b + c) / (abs(a + ab * b + ac * c) + abs(ab * a + b + bc * c) + abs(ac * a + bc * b + c)) FROM p, r WHERE i < 400),
        v AS (SELECT a, b, c FROM p WHERE i = 400)"""

SQL = {
    "p3_ranking": f"""{_COMPONENT}, y AS (SELECT query_id, chunk_id, round(x.a * v.a + x.b * v.b + x.c * v.c, 9) AS z FROM x, v)
        SELECT query_id, chunk_id, round(z, 6) AS projection, CAST(row_number() OVER (PARTITION BY query_id ORDER BY z DESC, chunk_id) AS INT) AS position FROM y""",
    "p3_loadings": f"""{_COMPONENT} SELECT unnest(['cosseno', 'bm25', 'reordenador']) AS strategy, unnest([round(a, 6), round(b, 6), round(c, 6)]) AS loading, unnest([a < 0, b < 0, c < 0]) AS runs_against FROM v""",
    # the definition of the chunks that head a ranking beyond dispute, stated on the ranks alone
    "p3_found": """
        WITH r AS (SELECT query_id, chunk_id, strategy, min(rank) AS rank FROM resultados
                   WHERE strategy IN ('cosseno', 'bm25', 'reordenador') GROUP BY 1, 2, 3)
        SELECT query_id, chunk_id FROM r GROUP BY 1, 2
        HAVING count(*) = 3 AND max(rank) <= 2 AND count(*) FILTER (WHERE rank = 1) >= 2""",
    # every pair that shares a sequence of words, counted out
    "p5_found": _PAIRS,
    # groups: the least id that a walk along pairs reaches
    "p5_groups": f"""
        WITH RECURSIVE pairs AS ({_PAIRS}),
        e AS (SELECT chunk_a AS u, chunk_b AS v FROM pairs UNION SELECT chunk_b, chunk_a FROM pairs),
        walk(node, seen) AS (SELECT DISTINCT chunk_id, chunk_id FROM chunks WHERE chunk_id IS NOT NULL UNION SELECT walk.node, e.v FROM walk JOIN e ON e.u = walk.seen)
        SELECT walk.node AS chunk_id, min(seen) AS classe, (SELECT count(*) FROM e WHERE e.u = walk.node) AS ligacoes FROM walk GROUP BY walk.node""",
}

"""Every query of the core, by name, with its SQL where SQL can express it."""

from __future__ import annotations

from estante.operators import packed
from estante.plans import documents, evaluation, retrieval
from estante.runtime import table


def p2_found(spark, d):
    return packed.packed_found(table(spark, d, "perguntas"))


#: What the problem says of quoted parts, ids and book:page intervals, without skeletons. Single quotes are chr(39).
_VALUES = r"""list_filter(list_transform(regexp_extract_all(coalesce(t, ''), '"(?:[^"]|"")+"|\x27[^\x27]+\x27|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|\p{L}[\p{L}\p{N}_&.-]*:\p{N}+(?:[-–]\p{N}+)?'),
    lambda v: CASE WHEN starts_with(v, '"') THEN replace(trim(v[2:-2]), '""', '"') WHEN starts_with(v, chr(39)) THEN trim(v[2:-2]) ELSE v END),
    lambda v: regexp_matches(v, ':\p{N}+(?:[-–]\p{N}+)?$|^[0-9a-fA-F-]{36}$'))"""

QUERIES = {"p2_found": p2_found} | documents.QUERIES | retrieval.QUERIES | evaluation.QUERIES
SQL: dict[str, str] = {
    "p2_found": f"""
        WITH f AS (SELECT line_no, 'paginas_referencia' AS campo, paginas_referencia AS t FROM perguntas UNION ALL SELECT line_no, 'chunks_referencia', chunks_referencia FROM perguntas),
        v AS (SELECT line_no, campo, {_VALUES} AS v FROM f)
        SELECT DISTINCT line_no, campo, CAST(generate_subscripts(v, 1) AS BIGINT) AS posicao, unnest(v) AS valor FROM v WHERE len(v) >= 2""",
} | documents.SQL | retrieval.SQL | evaluation.SQL
FLAGSHIP = retrieval.rrf_hybrid_topk

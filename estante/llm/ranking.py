"""One ranking from several differently scaled scores.

Each list's scores become ranks scaled to [0, 1] (1 = head), so no list prevails by the size of its numbers; a list declared with the direction
-1 (lower is better) is turned round first. The correlation matrix of the transformed lists is one distributed aggregation; its first
principal component, turned as a whole so that the loadings sum to more than nothing, weights the lists; chunks are sorted by projection. A list that
runs against the others keeps its negative loading; `component` reports it.

Defined cases: the list's own rank decides the order within it, then the score, then the chunk id (rows without a rank come
last); null, equal or outsized scores therefore change nothing that a rank fixes; repeated rows count once with their best
rank; a chunk that a list lacks lies one place beyond that list's end, in a query that lacks the list at its middle; a list without variance gets
the loading 0; with no usable correlation all lists weigh the same; ties end by chunk id; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from estante.runtime import cut

LISTS = ("cosseno", "bm25", "reordenador")


def placed(hits: DataFrame, lists: tuple[str, ...] = LISTS, directions: dict[str, int] | None = None) -> DataFrame:
    """One row per (query, chunk): its place in each list and the scaled rank `s_<list>`."""
    own = hits.where(F.col("strategy").isin(*lists) & F.col("query_id").isNotNull() & F.col("chunk_id").isNotNull())
    # one shuffle by query serves the de-duplication, the ranks and the pivot
    per_row = (
        own.repartition("query_id")
        .groupBy("query_id", "strategy", "chunk_id")
        .agg(F.min("rank").alias("rank"), F.max("score").alias("score"))
    )
    in_list = Window.partitionBy("query_id", "strategy")
    order = in_list.orderBy(F.col("rank").asc_nulls_last(), F.col("score").desc_nulls_last(), "chunk_id")
    ranked = per_row.withColumns({"place": F.row_number().over(order), "depth": F.count("*").over(in_list)})
    up = 1 - (F.col("place") - 1) / F.col("depth")
    turned = [x for x in lists if (directions or {}).get(x, 1) < 0]
    ranked = ranked.withColumn("scaled", F.when(F.col("strategy").isin(*turned), 1 - up + 1 / F.col("depth")).otherwise(up) if turned else up)
    wide = ranked.groupBy("query_id", "chunk_id").agg(
        *[F.max(F.when(F.col("strategy") == x, F.col("scaled"))).alias(f"s_{x}") for x in lists],
        *[F.max(F.when(F.col("strategy") == x, F.coalesce("rank", "place"))).alias(f"r_{x}") for x in lists],
    )
    q = Window.partitionBy("query_id")
    wide = wide.withColumns({f"has_{x}": F.max(F.col(f"s_{x}").isNotNull()).over(q) for x in lists})
    return wide.withColumns({f"s_{x}": F.coalesce(f"s_{x}", F.when(F.col(f"has_{x}"), 0.0).otherwise(0.5)) for x in lists})


def loadings(wide: DataFrame, lists: tuple[str, ...] = LISTS) -> list[float]:
    """First principal component of the correlation matrix, turned as a whole towards the declared directions, its absolute values summing to 1; one row of moments reaches the driver."""
    s = [F.col(f"s_{x}") for x in lists]
    k = len(lists)
    moments = wide.agg(
        F.count("*").alias("n"), *[F.sum(c).alias(f"m{i}") for i, c in enumerate(s)],
        *[F.sum(s[i] * s[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)],
    ).first()
    n = moments["n"]
    if not n:
        return [1 / k] * k
    mean = np.array([moments[f"m{i}"] for i in range(k)]) / n
    cov = np.array([[moments[f"m{min(i, j)}_{max(i, j)}"] / n for j in range(k)] for i in range(k)]) - np.outer(mean, mean)
    return oriented(cov)


def oriented(cov: np.ndarray) -> list[float]:
    """Loadings of the first principal component of the correlations in a covariance matrix. Lists without variance get 0; where no two lists vary together all that vary weigh the same; of two lists that run against each other the first is taken to be right."""
    k = len(cov)
    sd = np.sqrt(np.clip(np.diag(cov), 0, None))
    live = sd > 1e-9
    if not live.any():
        return [1 / k] * k
    corr = cov / np.outer(np.where(live, sd, 1), np.where(live, sd, 1))
    if np.abs(corr[np.ix_(live, live)] - np.eye(live.sum())).max() < 1e-9:
        return [float(v) for v in live / live.sum()]
    corr[~live, :] = corr[:, ~live] = 0
    first = np.linalg.eigh(corr)[1][:, -1] * live
    total = first.sum()
    if total < -1e-9 or (abs(total) <= 1e-9 and first[np.flatnonzero(np.abs(first) > 1e-9)[0]] < 0):
        first = -first
    return [float(v) for v in first / np.abs(first).sum()]


def component(hits: DataFrame, lists: tuple[str, ...] = LISTS, directions: dict[str, int] | None = None) -> DataFrame:
    """(strategy, loading, runs_against): the weight of every list, and whether it runs against its declared direction."""
    w = loadings(placed(hits, lists, directions), lists)
    return hits.sparkSession.createDataFrame([(x, round(v, 9), v < -1e-9) for x, v in zip(lists, w)], "strategy string, loading double, runs_against boolean")


def one_ranking(hits: DataFrame, lists: tuple[str, ...] = LISTS, directions: dict[str, int] | None = None) -> DataFrame:
    """(query_id, chunk_id, projection, position, s_*, r_*, has_*)."""
    wide = cut(placed(hits, lists, directions))
    w = loadings(wide, lists)
    projection = sum((F.col(f"s_{x}") * v for x, v in zip(lists, w)), F.lit(0.0))
    by_query = Window.partitionBy("query_id").orderBy(F.desc("projection"), "chunk_id")
    return wide.withColumn("projection", F.round(projection, 9)).withColumn("position", F.row_number().over(by_query))


def head_found(hits: DataFrame, lists: tuple[str, ...] = LISTS, among: int = 3) -> DataFrame:
    """The chunks heading the ranking beyond dispute: among its first places, and rank 1 in all lists but one, 1 or 2 in that."""
    r = [F.col(f"r_{x}") for x in lists]
    firsts = sum(((c == 1).cast("int") for c in r), F.lit(0))
    near = F.lit(True)
    for c in r:
        near = near & (c <= 2)
    return one_ranking(hits, lists).where((F.col("position") <= among) & near & (firsts >= len(lists) - 1)).select("query_id", "chunk_id")

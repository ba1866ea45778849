"""The k most similar vectors of every vector: an inverted file of coarse centroids with product-quantised residuals.

Coarse centroids and residual codebooks are fitted on a bounded sample (`SAMPLE_PER_CELL` a cell, at most `MOST_CELLS` cells; `BOOK_SAMPLE` residuals);
every vector is indexed and every vector asks. A cell of more than `SPLIT` vectors (there are at most `MOST_CELLS`) is divided once more, in its group, by
centroids of its own, so the work of a query does not grow with the cells. Cells lie in balanced groups of neighbouring cells, so a vector is sent once
to each group that holds a cell it probes: of its `PROBES` nearest cells, those about as near as the first (`NEAR`). In its group the asymmetric distance tables of a query score the
codes of each probed cell, the `RERANK` best are scored again with the exact vectors, and the lists of a query's groups merge.

Equal vectors form one class that is indexed once, with its first k + 1 ids: members of a class have cosine 1 to each other,
so nothing beyond those ids can be among the k nearest in place of them.

Defined cases: vectors that are null, of another length, all zero or not finite, and rows of another model, take no part;
repeated rows count once; one id delivered with several vectors takes part with each; ties end by id; fewer than k + 1 ids give what
there are; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from estante.runtime import cores, cut, maybe_broadcast, merged

DIMENSION, MODEL, K = 64, "codex-vetor-2", 5
CELL, MOST_CELLS, SAMPLE_PER_CELL = 128, 4096, 40
PROBES, RERANK, SUBSPACES, CODES, BOOK_SAMPLE = 8, 48, 32, 64, 16_384
#: A cell beyond the nearest is probed if its centroid is at least so near, as a share of the nearest one's cosine.
NEAR = 0.7
GROUP_ROWS, HOT = 6_000, 4_096
#: Vectors from which a cell is divided into cells of its own of about `CELL`, of which a query probes `INNER_PROBES`.
SPLIT, INNER_PROBES = 1_024, 12
_SEED = 20


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def spherical_kmeans(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(_SEED)
    c = sample[rng.choice(len(sample), k, replace=False)]
    for _ in range(rounds):
        a = np.concatenate([(part @ c.T).argmax(1) for part in np.array_split(sample, max(1, len(sample) // 8192))])
        total = np.zeros_like(c)
        np.add.at(total, a, sample)
        bare = np.linalg.norm(total, axis=1) < 1e-9
        total[bare] = sample[rng.choice(len(sample), int(bare.sum()))]
        c = _unit(total)
    return c


def kmeans(sample: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    rng = np.random.default_rng(_SEED)
    c = sample[rng.choice(len(sample), k, replace=len(sample) < k)].copy()
    for _ in range(rounds):
        a = (sample @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
        n = np.bincount(a, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, a, sample)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def balanced_groups(centroids: np.ndarray, weight: np.ndarray, groups: int) -> np.ndarray:
    """The group of each centroid: halves along the principal axis, cut at the weighted median, until there are enough."""
    out = np.zeros(len(centroids), dtype=np.int32)
    parts = [np.arange(len(centroids))]
    while len(parts) < groups:
        i = int(np.argmax([weight[p].sum() if len(p) > 1 else -1 for p in parts]))
        p = parts.pop(i)
        if len(p) < 2:
            parts.append(p)
            break
        x = centroids[p] - centroids[p].mean(0)
        order = p[np.argsort(x @ np.linalg.svd(x, full_matrices=False)[2][0], kind="stable")]
        half = int(np.searchsorted(np.cumsum(weight[order]), weight[order].sum() / 2)) + 1
        half = min(max(half, 1), len(order) - 1)
        parts += [order[:half], order[half:]]
    for g, p in enumerate(parts):
        out[p] = g
    return out


class Index:
    """Centroids, their groups and the residual codebooks: sizes bounded by the parameters above, so it travels with the closures."""

    def __init__(self, sample: np.ndarray, cells: int, groups: int) -> None:
        self.centroids = spherical_kmeans(sample, cells).astype(np.float32)
        home = np.concatenate([(part @ self.centroids.T).argmax(1) for part in np.array_split(sample, max(1, len(sample) // 8192))])
        self.group = balanced_groups(self.centroids, np.bincount(home, minlength=cells) + 1.0, groups)
        residual = (sample - self.centroids[home])[:BOOK_SAMPLE]
        width = sample.shape[1] // SUBSPACES
        self.books = np.stack([kmeans(residual[:, s * width : (s + 1) * width], CODES) for s in range(SUBSPACES)]).astype(np.float32)

    def probe(self, x: np.ndarray, probes: int) -> np.ndarray:
        s = x @ self.centroids.T
        p = min(probes, s.shape[1])
        top = np.argpartition(-s, p - 1, axis=1)[:, :p]
        near = np.take_along_axis(s, top, 1)
        order = np.argsort(-near, axis=1)
        near, top = np.take_along_axis(near, order, 1), np.take_along_axis(top, order, 1)
        return np.where((near >= NEAR * near[:, :1]) | (np.arange(p) == 0), top, -1)  # -1: not probed

    def encode(self, residual: np.ndarray) -> np.ndarray:
        width = residual.shape[1] // SUBSPACES
        parts = [residual[:, s * width : (s + 1) * width] for s in range(SUBSPACES)]
        return np.stack([(r @ b.T - 0.5 * (b * b).sum(1)).argmax(1) for r, b in zip(parts, self.books)], axis=1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Asymmetric tables: for every subspace, the inner product of the exact query with each code word."""
        width = q.shape[1] // SUBSPACES
        return np.stack([q[:, s * width : (s + 1) * width] @ b.T for s, b in enumerate(self.books)])


def _nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The n centres nearest to each row, in blocks."""
    n = min(n, len(centres))
    return np.concatenate([np.argpartition(-(part @ centres.T), n - 1, axis=1)[:, :n] for part in np.array_split(x, max(1, len(x) // 8192))])


def _search(index: Index, x: np.ndarray, home: np.ndarray, probes: list[np.ndarray], k: int, rerank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, found row, cosine) of a group: the k best of each query over the cells it probes here."""
    ask = np.repeat(np.arange(len(x)), [len(p) for p in probes])
    cell = np.concatenate(probes) if len(probes) else np.empty(0, dtype=np.int64)
    order = np.argsort(cell, kind="stable")
    ask, cell = ask[order], cell[order]
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else []
    found = []

    def score(q_all: np.ndarray, rows: np.ndarray, codes: np.ndarray) -> None:
        for lo in range(0, len(q_all), 2048):  # queries in blocks: memory stays bounded whatever the cell's popularity
            q = q_all[lo : lo + 2048]
            for c0 in range(0, len(rows), 4096):
                some, code = rows[c0 : c0 + 4096], codes[c0 : c0 + 4096]
                tables = index.tables(x[q])
                score = tables[0][:, code[:, 0]]
                for s in range(1, SUBSPACES):
                    score += tables[s][:, code[:, s]]
                r = min(rerank, len(some))
                best = np.argpartition(-score, r - 1, axis=1)[:, :r]
                exact = np.einsum("qd,qrd->qr", x[q], x[some[best]])
                exact[some[best] == q[:, None]] = -9
                r = min(k, r)
                top = np.argpartition(-exact, r - 1, axis=1)[:, :r]
                found.append((np.repeat(q, r), some[np.take_along_axis(best, top, 1)].ravel(), np.take_along_axis(exact, top, 1).ravel()))

    for a, b in zip(starts, [*starts[1:], len(cell)]):
        rows = np.flatnonzero(home == cell[a])
        if not len(rows):
            continue
        codes = index.encode(x[rows] - index.centroids[cell[a]])
        if len(rows) <= SPLIT:
            score(ask[a:b], rows, codes)
            continue
        inner = min(len(rows) // CELL, 1024)
        centres = spherical_kmeans(x[rows[np.random.default_rng(_SEED).permutation(len(rows))[: inner * SAMPLE_PER_CELL]]], inner, 4)
        own = _nearest(x[rows], centres, 1)[:, 0]
        probed = _nearest(x[ask[a:b]], centres, INNER_PROBES)
        for c in range(inner):
            within = np.flatnonzero(own == c)
            if len(within):
                score(ask[a:b][(probed == c).any(axis=1)], rows[within], codes[within])
    if not found:
        e = np.empty(0, dtype=np.int64)
        return e, e, e.astype(np.float32)
    q, f, s = (np.concatenate(z) for z in zip(*found))
    keep = s > -5
    q, f, s = q[keep], f[keep], s[keep]
    order = np.lexsort((-s, q))
    q, f, s = q[order], f[order], s[order]
    first = np.r_[0, np.flatnonzero(q[1:] != q[:-1]) + 1] if len(q) else np.empty(0, dtype=np.int64)
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    return q[place < k], f[place < k], s[place < k]


def current(vetores: DataFrame, dimension: int = DIMENSION, model: str = MODEL) -> DataFrame:
    """(chunk_id, vector, h) of the rows that take part; h is a hash of the vector."""
    v = F.col("vector")
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < 1e30))
    usable = (F.col("model") == model) & F.col("chunk_id").isNotNull() & (F.size(v) == dimension) & finite & F.exists(v, lambda e: e != 0)
    return vetores.where(usable).select("chunk_id", "vector", F.xxhash64(v).alias("h"))


def classes(rows: DataFrame, k: int = K, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(h, ids, vector): one row per distinct vector with its first k + 1 ids; and (h, chunk_id) of the members beyond those. Vectors with more than `hot` rows are salted by id, so no task holds all copies of one."""
    often = cut(rows.groupBy("h").count().where(F.col("count") > hot).select("h", F.lit(True).alias("often")))
    salted = rows.join(maybe_broadcast(often), "h", "left").withColumn("salt", F.when(F.col("often"), F.pmod(F.hash("chunk_id"), F.lit(64)) + 1).otherwise(0))
    one = salted.repartition("h", "salt").dropDuplicates(["h", "salt", "chunk_id"]).select("h", "salt", "chunk_id", "vector")
    in_part = Window.partitionBy("h", "salt").orderBy("chunk_id")
    base = one.withColumn("rn", F.row_number().over(in_part))
    base = cut(base.select("h", "salt", "chunk_id", "rn", F.when(F.col("rn") == 1, F.col("vector")).alias("vector")))

    def heads(df: DataFrame, by: list[str]) -> DataFrame:
        ids = F.slice(F.array_sort(F.collect_list("chunk_id")), 1, k + 1)
        return df.where(F.col("rn") <= k + 1).groupBy(*by).agg(ids.alias("ids"), F.first("vector", ignorenulls=True).alias("vector")).select("h", "ids", "vector")

    per_class = heads(base.where("salt = 0"), ["h", "salt"]).unionByName(heads(base.where("salt > 0"), ["h"]))
    beyond = base.where((F.col("rn") > k + 1) | (F.col("salt") > 0)).select("h", "chunk_id")
    return per_class, beyond


def neighbours(vetores: DataFrame, k: int = K, probes: int = PROBES, rerank: int = RERANK, dimension: int = DIMENSION, model: str = MODEL, most_cells: int = MOST_CELLS) -> DataFrame:
    """(chunk_id, neighbour): the k ids nearest to every taking-part id."""
    rows = current(vetores, dimension, model)
    n = rows.count()
    per_class, beyond = classes(rows, k)
    cells = max(1, min(most_cells, n // CELL))
    wanted = cells * SAMPLE_PER_CELL
    sampled = rows.select("h", "vector").where(F.pmod(F.xxhash64("h"), F.lit(max(1, n // max(wanted, 1)))) == 0).limit(2 * wanted).toPandas()
    if not len(sampled):
        return vetores.sparkSession.createDataFrame([], "chunk_id string, neighbour string")
    sample = _unit(np.stack(sampled.sort_values("h")["vector"].to_numpy()).astype(np.float32))
    index = Index(sample, min(cells, len(sample)), max(cores(vetores.sparkSession), -(-n // GROUP_ROWS)))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x = _unit(np.stack(b["vector"].to_numpy()).astype(np.float32))
            near = index.probe(x, probes)
            groups = index.group[near]
            h, ids, out = b["h"].to_numpy(), b["ids"].to_numpy(), []
            for i in range(len(b)):
                for g in dict.fromkeys(groups[i][near[i] >= 0].tolist()):
                    mine = near[i][(groups[i] == g) & (near[i] >= 0)]
                    out.append((g, h[i], ids[i], x[i].tobytes(), int(near[i][0]) if g == groups[i][0] else -1, mine))
            yield pd.DataFrame(out, columns=["g", "h", "ids", "x", "home", "probes"])

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(pdf["x"]), dtype=np.float32).reshape(len(pdf), -1)
        q, f, s = _search(index, x, pdf["home"].to_numpy(), list(pdf["probes"]), k, rerank)
        h, ids = pdf["h"].to_numpy(), pdf["ids"].to_numpy()
        cuts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else []
        out = []
        for a, b in zip(cuts, [*cuts[1:], len(q)]):
            near = [(-float(s[i]), str(t)) for i in range(a, b) for t in ids[f[i]]]
            out.append((h[q[a]], ids[q[a]], [{"d": d, "id": t} for d, t in near]))
        alone = np.setdiff1d(np.flatnonzero(pdf["home"].to_numpy() >= 0), q)  # no other vector in its cells
        out += [(h[i], ids[i], []) for i in alone]
        return pd.DataFrame(out, columns=["h", "ids", "near"])

    placed = per_class.mapInPandas(assign, "g int, h bigint, ids array<string>, x binary, home int, probes array<int>")
    lists = placed.groupBy("g").applyInPandas(search, "h bigint, ids array<string>, near array<struct<d:double,id:string>>")
    united = lists.groupBy("h").agg(F.first("ids").alias("ids"), F.array_distinct(F.transform(F.array_sort(F.flatten(F.collect_list("near"))), lambda e: e["id"])).alias("near"))
    own = united.select(F.explode("ids").alias("chunk_id"), "ids", "near")
    others = F.array_distinct(F.concat(F.col("ids"), F.col("near")))
    first = own.select("chunk_id", F.explode(F.slice(F.filter(others, lambda e: e != F.col("chunk_id")), 1, k)).alias("neighbour"))
    copies = beyond.join(merged(per_class.select("h", "ids").where(F.size("ids") == k + 1)), "h").where(~F.array_contains("ids", F.col("chunk_id")))
    return first.unionByName(copies.select("chunk_id", F.explode(F.slice("ids", 1, k)).alias("neighbour")))


def neighbours_found(vetores: DataFrame, k: int = K) -> DataFrame:
    """Each unordered pair in which at least one is among the other's k nearest."""
    n = neighbours(vetores, k)
    return n.select(F.least("chunk_id", "neighbour").alias("chunk_a"), F.greatest("chunk_id", "neighbour").alias("chunk_b")).distinct()

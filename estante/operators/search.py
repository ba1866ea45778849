"""Retrieval for batches of questions: BM25, exact cosine, reciprocal rank fusion and their comparison.

A question is a row, and a search takes any number of them against all rows, in passes of about `A_PASS` questions whose rankings
are united: documents stay where they are, each batch is scored against the questions of a pass by matrix products, and only the k
best of a batch travel to the final ranking.

Ties end by ordinal (or id) ascending, on scores rounded to six places. Questions without a searchable term find nothing;
repeated terms of a question count once per occurrence; empty tables give no rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estante.functions import text as T
from estante.runtime import cut, maybe_broadcast

K1, B, FLOOR = 1.2, 0.75, 1e-6
RRF_K, LEG_DEPTH = 60, 50
PLACES = 6


def first_by_id(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key, in a given order."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def clamp_k(k: Column, most: int = 50) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(most), k))


def clamp(k: int, most: int = 50) -> int:
    return max(1, min(most, k))


def notes(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, note) of questions that found nothing: for want of a term that can be searched, or of a document that has one."""
    found = hits.select("query_id").distinct().withColumn("found", F.lit(True))
    empty = questions.select("query_id", "query_text").join(found, "query_id", "left").where("found is null")
    able = F.coalesce(T.searchable(F.col("query_text")), F.lit(False))
    return empty.select("query_id", F.when(able, "Nada encontrado.").otherwise("A pergunta não tem termo pesquisável.").alias("note"))


def top_k(hits: DataFrame, k: int, *ties: str) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), *ties)
    return hits.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)


# --- lexical --------------------------------------------------------------------------------------------------------------


def postings(rows: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    return rows.select(key, F.explode(T.tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def doc_lengths(rows: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """A document's number of terms needs no shuffle: it is the size of an array in its own row."""
    return rows.select(key, F.size(T.tokens(F.col(text))).cast("bigint").alias("len"))


def index_stats(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count("*").cast("bigint").alias("n_docs"), F.avg("len").alias("avgdl"))


def query_terms(questions: DataFrame, key: str = "query_id", text: str = "query_text") -> DataFrame:
    """(query_id, term, qtf): the terms of each searchable question, with their number of occurrences."""
    return questions.where(T.searchable(F.col(text))).select(F.col(key).alias("query_id"), F.explode(T.tokens(F.col(text))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


A_PASS, BLOCK = 2_000, 256


def _bounded(questions: DataFrame, most: int | None) -> None:
    """More questions than a bound that the caller states are an error; without one any number is answered."""
    if most is not None and questions.limit(most + 1).count() > most:
        raise ValueError("too many questions for one search; split them")


def _in_passes(asked: DataFrame, a_pass: int, search: Callable[[pd.DataFrame], DataFrame]) -> DataFrame | None:
    """The united hits of every pass; asked, written once, has a query_id, whose rows all meet in one pass. Several passes are each written before the next, so that the driver holds one pass's questions; none gives None."""
    n = -(-asked.select("query_id").distinct().count() // a_pass)
    if n <= 1:
        return search(asked.orderBy("query_id").toPandas()) if n else None
    part = F.pmod(F.xxhash64("query_id"), F.lit(n))
    hits = [cut(search(rows)) for i in range(n) if len(rows := asked.where(part == i).orderBy("query_id").toPandas())]
    return reduce(DataFrame.unionByName, hits)


def _best(scores: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(question, row) of the k best of every column, by score, then key; scores of -inf do not count."""
    q, r = [], []
    for j in range(scores.shape[1]):
        s = scores[:, j]
        rows = np.flatnonzero(s > -np.inf)
        if len(rows) > k:
            least = np.partition(s[rows], len(rows) - k)[len(rows) - k]
            rows = rows[s[rows] >= least]  # ties stay until the key decides
        rows = rows[np.lexsort((keys[rows], -s[rows]))][:k]
        q += [j] * len(rows)
        r += rows.tolist()
    return np.array(q, dtype=np.int64), np.array(r, dtype=np.int64)


def bm25(questions: DataFrame, rows: DataFrame, k: int, key: str = "chunk_id", text: str = "text", most_questions: int | None = None, a_pass: int = A_PASS) -> DataFrame:
    """(query_id, key, score, rank). Each batch of documents meets all questions of a pass at once, by a sparse product of its terms with theirs; only the k best of every batch and question go on to the final ranking."""
    _bounded(questions, most_questions)
    terms = cut(query_terms(questions))
    wanted = maybe_broadcast(cut(terms.select("term").distinct()))
    # the corpus is tokenised once: only asked terms leave a document's row, and one row of each document, with its length, whatever it holds
    tokenised = rows.select(key, T.tokens(F.col(text)).alias("terms")).select(key, F.size("terms").cast("bigint").alias("len"), F.posexplode_outer("terms").alias("pos", "term"))
    kept = tokenised.join(wanted.withColumn("asked", F.lit(True)), "term", "left").where("asked or coalesce(pos, 0) = 0")
    hit = cut(kept.groupBy(key, "len").agg(F.collect_list(F.when(F.col("asked"), F.col("term"))).alias("terms")))
    stats = hit.agg(F.count("*").alias("n_docs"), F.avg(F.greatest("len", F.lit(0))).alias("avgdl")).first()
    hit = hit.where(F.size("terms") > 0)
    idf = F.log((F.lit(stats["n_docs"]) - F.col("n") + 0.5) / (F.col("n") + 0.5))
    df = hit.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    asked = terms.join(df, "term").select("query_id", "term", (F.col("qtf") * F.when(idf > 0, idf).otherwise(FLOOR)).alias("w"))
    avgdl, kind = stats["avgdl"], rows.schema[key].dataType.simpleString()
    query_kind = terms.schema["query_id"].dataType.simpleString()

    def one_pass(asked: pd.DataFrame) -> DataFrame:
        blocks = []
        ids = asked["query_id"].unique()
        for at in range(0, len(ids), BLOCK):
            part = asked[asked["query_id"].isin(ids[at : at + BLOCK])]
            q = pd.factorize(part["query_id"])[0]
            blocks.append((ids[at : at + BLOCK], {t: (q[i], part["w"].to_numpy()[i]) for t, i in part.groupby("term", sort=False).indices.items()}))

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if not len(b):
                    continue
                keys, length = b[key].to_numpy(), b["len"].to_numpy(dtype=float)
                code, names_of = pd.factorize(np.concatenate(b["terms"].to_list()))
                row = np.repeat(np.arange(len(b)), [len(t) for t in b["terms"]])
                place, tf = np.unique(code * len(b) + row, return_counts=True)
                row, code = place % len(b), place // len(b)
                value = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[row] / avgdl))
                starts = np.searchsorted(code, np.arange(len(names_of) + 1))
                for names, weights in blocks:
                    # a sparse product: each term adds to the documents that have it, for the questions that ask it
                    scores = np.zeros((len(b), len(names)))
                    for c, t in enumerate(names_of):
                        if t in weights:
                            q, w = weights[t]
                            at = slice(starts[c], starts[c + 1])
                            scores[np.ix_(row[at], q)] += value[at, None] * w
                    q, r = _best(np.where(scores > 0, np.round(scores, PLACES), -np.inf), keys, k)
                    yield pd.DataFrame({"query_id": names[q], key: keys[r], "score": np.round(scores, PLACES)[r, q]})

        return top_k(hit.mapInPandas(score, f"query_id {query_kind}, {key} {kind}, score double"), k, key)

    found = _in_passes(cut(asked), a_pass, one_pass)
    return found if found is not None else terms.select("query_id").crossJoin(rows.select(key)).limit(0).selectExpr("query_id", key, "0.0D as score", "1 as rank")


def bm25_from_index(questions: DataFrame, postings: DataFrame, lengths: DataFrame, k: int, key: str = "chunk_id") -> DataFrame:
    """(query_id, key, score, rank) from a stored index: postings (key, term, tf), lengths (key, len). The questions' terms, bounded by what is asked, meet the
    postings by join; partial sums are made before the shuffle by question and document."""
    terms = cut(query_terms(questions))
    stats = lengths.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avgdl"))
    asked = cut(terms.select("term").distinct())
    own = cut(postings.select(key, "term", "tf").join(maybe_broadcast(asked), "term"))
    df = own.groupBy("term").agg(F.count("*").alias("n")).join(F.broadcast(stats))  # one row
    idf = F.log((F.col("n_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    weights = terms.join(df, "term").select("query_id", "term", "avgdl", (F.col("qtf") * F.when(idf > 0, idf).otherwise(FLOOR)).alias("w"))
    part = F.col("w") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    scored = own.join(lengths.select(key, "len"), key).join(maybe_broadcast(cut(weights)), "term").groupBy("query_id", key).agg(F.sum(part).alias("score"))
    return top_k(scored.withColumn("score", F.round("score", PLACES)), k, key)


# --- dense ----------------------------------------------------------------------------------------------------------------


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def cosine_top_k(questions: DataFrame, vectors: DataFrame, k: int, key: str = "chunk_id", vector: str = "vector", most_questions: int | None = None, a_pass: int = A_PASS) -> DataFrame:
    """(query_id, key, score, rank): the exact k nearest of each question vector (query_id, qvec). Every batch of vectors is one matrix product
    with a block of questions; only its k best per question go on. Null vectors and vectors of length zero take no part."""
    _bounded(questions, most_questions)
    kind, query_kind = vectors.schema[key].dataType.simpleString(), questions.schema["query_id"].dataType.simpleString()
    usable = vectors.where(F.col(vector).isNotNull()).select(key, vector)

    def one_pass(asked: pd.DataFrame) -> DataFrame:
        names, q_all = asked["query_id"].to_numpy(), _units(np.stack(asked["qvec"].to_numpy()).astype(float))

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if not len(b):
                    continue
                keys, x = b[key].to_numpy(), _units(np.stack(b[vector].to_numpy()).astype(float))
                for at in range(0, len(names), BLOCK):
                    s = np.round(x @ q_all[at : at + BLOCK].T, PLACES) + 0.0
                    s[np.isnan(s)] = -np.inf
                    q, r = _best(s, keys, k)
                    yield pd.DataFrame({"query_id": names[at : at + BLOCK][q], key: keys[r], "score": s[r, q]})

        return top_k(usable.mapInPandas(score, f"query_id {query_kind}, {key} {kind}, score double"), k, key)

    found = _in_passes(cut(questions.where("qvec is not null").select("query_id", "qvec")), a_pass, one_pass)
    return found if found is not None else questions.select("query_id").crossJoin(vectors.select(key)).limit(0).selectExpr("query_id", key, "0.0D as score", "1 as rank")


def _units(x: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / np.linalg.norm(x, axis=1, keepdims=True)


# --- fusion ---------------------------------------------------------------------------------------------------------------


def in_list_places(hits: DataFrame, key: str = "chunk_id") -> DataFrame:
    """One row per id of a list, at its first place; a repeated id keeps the place it took, so later places stay as they are."""
    w = Window.partitionBy("query_id", "strategy").orderBy("rank")
    placed = hits.withColumn("rank", F.row_number().over(w).cast("int"))
    return placed.groupBy("query_id", "strategy", key).agg(F.min("rank").alias("rank"), F.min_by("score", "rank").alias("score"))


def rrf(hits: DataFrame, k: int, legs: list[str], key: str = "chunk_id") -> DataFrame:
    """(query_id, key, score, rank, contributions): Σ 1/(60 + rank) over the legs; a contribution of rank 0 means absent. hits: (query_id, strategy, key, score, rank)."""
    own = hits.where(F.col("strategy").isin(legs))
    each = own.groupBy("query_id", key).agg(
        *[F.max(F.when(F.col("strategy") == x, F.col("rank"))).alias(f"r{i}") for i, x in enumerate(legs)],
        *[F.max(F.when(F.col("strategy") == x, F.col("score"))).alias(f"s{i}") for i, x in enumerate(legs)],
    )
    score = sum((F.coalesce(1 / (RRF_K + F.col(f"r{i}")), F.lit(0.0)) for i in range(len(legs))), F.lit(0.0))
    parts = F.array(*[F.struct(F.lit(x).alias("strategy"), F.coalesce(f"r{i}", F.lit(0)).cast("int").alias("rank"), F.coalesce(f"s{i}", F.lit(0.0)).alias("score")) for i, x in enumerate(legs)])
    return top_k(each.select("query_id", key, F.round(score, 9).alias("score"), parts.alias("contributions")), k, key)


def contribution_label(contributions: Column) -> Column:
    """"cosseno #3 · bm25 —"."""
    return F.array_join(F.transform(contributions, lambda c: F.concat(c["strategy"], F.when(c["rank"] > 0, F.concat(F.lit(" #"), c["rank"].cast("string"))).otherwise(F.lit(" —")))), " · ")


def compare(hits: DataFrame, strategies: list[str], key: str = "chunk_id") -> DataFrame:
    """Side by side: (query_id, rank, one column per strategy), "—" where a list is shorter."""
    wide = hits.groupBy("query_id", "rank").pivot("strategy", strategies).agg(F.min(key))
    return wide.fillna("—", strategies)


Search = Callable[[DataFrame, int], DataFrame]


class Strategies:
    """Registered search strategies by name; each is a function (questions, k) → hits and may say why it is not available. An unknown name is an error; a failing one becomes a note."""

    def __init__(self) -> None:
        self._by_name: dict[str, Search] = {}
        self._reason: dict[str, Callable[[], str | None]] = {}

    def register(self, name: str, search: Search, reason: Callable[[], str | None] = lambda: None) -> None:
        """`reason` tells why the strategy can't be used now, or gives None."""
        self._by_name[name], self._reason[name] = search, reason

    def get(self, name: str) -> Search:
        if name not in self._by_name:
            raise KeyError(f"no strategy {name!r}; there are {sorted(self._by_name)}")
        return self._by_name[name]

    def names(self) -> list[str]:
        return list(self._by_name)

    def unavailable(self, *names: str) -> str | None:
        """Why one of the strategies can't be used, all reasons in one text; None if all can."""
        said = [f"{n}: {r}" for n in names if self.get(n) and (r := self._reason[n]())]
        return "; ".join(said) or None

    def preferred(self, wanted: str = "rrf") -> str | None:
        """The wanted strategy if it is available, else the first that is."""
        return next((n for n in sorted(self._by_name, key=lambda n: n != wanted) if self.unavailable(n) is None), None)

    def register_fusion(self, name: str, legs: list[str], key: str = "chunk_id") -> None:
        """A fusion of registered legs: each is asked for max(k, `LEG_DEPTH`) hits. It is available only if all legs are."""

        def search(questions: DataFrame, k: int) -> DataFrame:
            if why := self.unavailable(*legs):
                raise LookupError(why)
            depth = max(k, LEG_DEPTH)
            hits = [self.get(x)(questions, depth).select("query_id", F.lit(x).alias("strategy"), key, "score", "rank") for x in legs]
            return rrf(reduce(DataFrame.unionByName, hits), k, legs, key)

        self.register(name, search, lambda: self.unavailable(*legs))

    def compare_all(self, questions: DataFrame, k: int) -> tuple[DataFrame | None, dict[str, str]]:
        """Hits of every strategy with a `strategy` column, and a note for each that is not available or failed."""
        hits, runs = self.timed(questions, k)
        return hits, {name: note for name, _, note in runs if note is not None}

    def timed(self, questions: DataFrame, k: int) -> tuple[DataFrame | None, list[tuple[str, float, str | None]]]:
        """Hits of every strategy, one after the other and each written before the next, so that a failure in any step becomes its note and all are timed alike; and (name, seconds, note)."""
        out, runs = None, []
        for name, search in self._by_name.items():
            began, hits, note = time.perf_counter(), None, self.unavailable(name)
            if note is None:
                try:
                    hits = cut(search(questions, k).withColumn("strategy", F.lit(name)))
                except Exception as e:  # noqa: BLE001
                    note = str(e)
            runs.append((name, time.perf_counter() - began, note))
            if hits is not None:
                out = hits if out is None else out.unionByName(hits, allowMissingColumns=True)
        return out, runs


# --- looking up -----------------------------------------------------------------------------------------------------------


def on_page(chunks: DataFrame, book: str, page: int) -> DataFrame:
    return chunks.where((F.col("book") == book) & F.lit(page).between(F.col("page_start"), F.coalesce("page_end", "page_start")))


def containing(chunks: DataFrame, text: str, book: str | None = None) -> DataFrame:
    """Unranked substring search without regard to case and accents."""
    found = chunks.where(F.contains(T.norm(F.col("text")), T.norm(F.lit(text))))
    return found.where(F.col("book") == book) if book else found


def store_status(chunks: DataFrame, vectors: DataFrame, index: DataFrame) -> DataFrame:
    """(book, chunks, vectors, indexed) of every book that any of the three holds."""
    n = lambda df, name: df.groupBy("book").agg(F.count("*").cast("bigint").alias(name))
    counted = n(chunks, "chunks").join(n(vectors, "vectors"), "book", "full").join(n(index, "indexed"), "book", "full")
    return counted.fillna(0, ["chunks", "vectors", "indexed"])

"""A run of the evaluation: every question is searched by each strategy, then answered with passages and without, as many rounds as asked.

Each step is one job over all questions that are still to be done; what it gives is written once (`cut`), so a later step that fails repeats none before
it. Questions with a record are left out (`done`), so a run can be resumed.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estante.functions import text as T
from estante.operators import evaluation as E
from estante.operators import rag, search
from estante.runtime import cut


@dataclass(frozen=True)
class Run:
    """passages: (query_id, strategy, rank, chunk_id, score, is_reference); ranks: (query_id, type, strategy, first_rank); answers: (query_id, mode, round, answer, chunks, intervals,
    books, note, tokens_in, tokens_out); seconds: of each step, by its name, for all questions together."""

    passages: DataFrame
    ranks: DataFrame
    answers: DataFrame
    seconds: dict[str, float]


def evaluate(asked: DataFrame, strategies: search.Strategies, names: list[str], chunks: DataFrame, books: dict[str, str], generator: rag.Generator = rag.extractive, alone: rag.Generator = rag.closed_book, rounds: int = 1, depth: int = 50, k: int = 8, answer_by: str | None = None, done: DataFrame | None = None) -> Run:
    """asked: (query_id, query_text, type, answerable, chunk_ids, pages); books: from a book's name in running text to its alias. Answers take the passages of `answer_by`, or of the
    preferred strategy. A strategy that is not available is an error before anything is run."""
    if why := strategies.unavailable(*names):
        raise LookupError(why)
    rounds, depth = E.clamp_run(rounds, depth)
    todo = cut(E.pending(asked, done) if done is not None else asked)
    # a question that is not answerable has no references
    todo = todo.withColumn("chunk_ids", F.when(F.col("answerable"), F.col("chunk_ids")).otherwise(F.array().cast("array<string>")))
    questions = todo.select("query_id", "query_text")
    seconds: dict[str, float] = {}

    def step(name: str, df: DataFrame) -> DataFrame:
        began = time.perf_counter()
        out = cut(df)
        seconds[name] = time.perf_counter() - began
        return out

    hits = reduce(DataFrame.unionByName, [step(n, strategies.get(n)(questions, depth).select("query_id", "chunk_id", "score", "rank").withColumn("strategy", F.lit(n))) for n in names])
    chosen = strategies.get(answer_by or strategies.preferred() or names[0])
    held = F.struct("book", F.col("page_start").alias("start"), F.coalesce("page_end", "page_start").alias("end"))
    none = {"chunks": "array<string>", "intervals": E.INTERVALS, "books": "array<string>"}
    answers = []
    for r in range(1, rounds + 1):
        responses, sources = rag.respond(questions, chosen, chunks, generator, k)
        # intervals are those of all cited passages with a page, repeated ones included; books are counted once
        cited = sources.groupBy("query_id").agg(F.collect_list("chunk_id").alias("chunks"), F.collect_list(F.when(F.col("page_start").isNotNull(), held)).alias("intervals"), F.collect_set("book").alias("books"))
        filled = [F.coalesce(c, F.array().cast(kind)).alias(c) for c, kind in none.items()]
        told = responses.join(cited, "query_id", "left").join(questions, "query_id").select("query_id", F.lit(E.WITH).alias("mode"), F.lit(r).alias("round"), "answer", *filled, "note", T.token_estimate(F.col("query_text")).alias("tokens_in"), T.token_estimate(F.col("answer")).alias("tokens_out"))
        answers.append(step(f"{E.WITH} {r}", told))
        named = E.free_text_sources(F.col("answer"), books)
        said = F.array_distinct(F.concat(F.transform(named, lambda x: x["book"]), E.books_in_parentheses(F.col("answer"), books)))
        bare = rag.answers_alone(questions, alone).join(questions, "query_id").select("query_id", F.lit(E.WITHOUT).alias("mode"), F.lit(r).alias("round"), "answer", F.array().cast("array<string>").alias("chunks"), named.alias("intervals"), said.alias("books"), F.lit(None).cast("string").alias("note"), T.token_estimate(F.col("query_text")).alias("tokens_in"), T.token_estimate(F.col("answer")).alias("tokens_out"))
        answers.append(step(f"{E.WITHOUT} {r}", bare))
    return Run(E.top_passages(hits, todo, k), E.reference_ranks(todo.where("size(chunk_ids) > 0"), hits), reduce(DataFrame.unionByName, answers), seconds)

"""Answers over passages: prompt, citations, renumbered sources, and limits on question traffic.

A generator is any function from a list of prompts to as many answers; `extractive` is the local stand-in. Everything between is Columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estante.functions import text as T
from estante.runtime import cut

CITATION = r"\[\s*\d+(?:\s*[,;]\s*\d+)*\s*\]"
PER_MINUTE, PER_DAY, LONGEST = 5, 200, 500
#: Longest answer, in tokens.
MOST_OUTPUT = 2_000
INSTRUCTIONS = "Responda apenas com o que dizem as passagens numeradas e cite cada uma pelo número entre colchetes. O que elas não dizem, diga que não consta."
INSTRUCTIONS_ALONE = "Responda com o que sabe dos livros e indique livro e página entre parênteses. O que não souber, diga que não sabe."
NOTHING_FOUND = "Nenhuma passagem encontrada; o gerador não foi chamado."
Generator = Callable[[str, list[str]], list[str]]


def passage_header(book: Column, start: Column, end: Column, name: Column) -> Column:
    """"Book, p. 3–5 — Entity", page and entity where there are any."""
    where = F.concat_ws(", ", T.display_name(book), T.page_label(start, end))
    return F.concat_ws(" — ", where, name)


def prompts(questions: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, passages, prompt): numbered passages in rank order, then the question. passages: (query_id, rank, book, page_start, page_end, entity_name, text). Questions without passage have a null prompt."""
    each = F.struct("rank", passage_header(F.col("book"), F.col("page_start"), F.col("page_end"), F.col("entity_name")).alias("head"), F.trim("text").alias("text"))
    held = passages.groupBy("query_id").agg(F.array_sort(F.collect_list(each)).alias("p"))
    shown = F.array_join(F.transform("p", lambda x, i: F.concat(F.lit("\n["), (i + 1).cast("string"), F.lit("] "), x["head"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    joined = questions.select("query_id", "query_text").join(held, "query_id", "left")
    prompt = F.when(F.col("p").isNotNull(), F.concat(F.lit("Trechos:\n"), shown, F.lit("\nPergunta: "), F.col("query_text")))
    return joined.select("query_id", F.coalesce(F.size("p"), F.lit(0)).cast("int").alias("passages"), prompt.alias("prompt"))


def prompt_alone(question: Column) -> Column:
    return F.concat(F.lit("Pergunta: "), question)


def extractive(instructions: str, prompts_: list[str]) -> list[str]:
    """The local stand-in: the first line of the first passage, cited."""
    return [(p.split("\n[1] ", 1)[1].split("\n", 2)[1][:200] + " [1]") if "\n[1] " in p else "Não consta." for p in prompts_]


def closed_book(instructions: str, prompts_: list[str]) -> list[str]:
    """The local stand-in without passages: a book and a page that follow from the prompt's length."""
    return [f"Segundo o que sei, veja (Livro do Jogador, p. {len(p) % 40 + 1})." for p in prompts_]


def answers_alone(questions: DataFrame, generator: Generator = closed_book, instructions: str = INSTRUCTIONS_ALONE) -> DataFrame:
    """(query_id, answer) of the generator without passages; a null question is not asked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["query_id"]].assign(answer=generator(instructions, list(b["prompt"])))

    asked = questions.where("query_text is not null").select("query_id", prompt_alone(F.col("query_text")).alias("prompt"))
    return asked.mapInPandas(run, "query_id string, answer string")


def answers(prompted: DataFrame, generator: Generator, instructions: str = INSTRUCTIONS) -> DataFrame:
    """(query_id, passages, answer, note). Without passage the generator is not called."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["query_id", "passages"]].assign(answer=generator(instructions, list(b["prompt"])))

    asked = prompted.where("prompt is not null").mapInPandas(run, "query_id string, passages int, answer string").withColumn("note", F.lit(None).cast("string"))
    none = prompted.where("prompt is null").select("query_id", "passages", F.lit("").alias("answer"), F.lit(NOTHING_FOUND).alias("note"))
    return asked.unionByName(none)


def passages_of(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, rank, chunk_id, book, page_start, page_end, entity_name, text): the hits with their chunks; a hit without chunk is left out."""
    return hits.select("query_id", "rank", "chunk_id").join(chunks.select("chunk_id", "book", "page_start", "page_end", "entity_name", "text"), "chunk_id")


def clamp_passages(k: int, most: int = 20) -> int:
    return max(1, min(most, k))


def cut_off(answer: Column, most_tokens: int = MOST_OUTPUT) -> Column:
    """An answer's text up to the limit of its output, and whether it was cut there."""
    most = 4 * most_tokens
    return F.struct(F.substring(answer, 1, most).alias("text"), (F.length(answer) > most).alias("cut"))


def respond(questions: DataFrame, search: Callable[[DataFrame, int], DataFrame], chunks: DataFrame, generator: Generator = extractive, k: int = 8, most_tokens: int = MOST_OUTPUT, search_note: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The whole way of an answer: search, guard, prompt, generation, citations.

    Gives (query_id, passages, answer, valid, invented, note, warning), valid and invented being the distinct cited numbers in order, and the sources (query_id, source, passage,
    chunk_id, book, page_start, page_end, entity_name): the cited passages in the order in which the answer cites them. A question without passages is
    not sent to the generator; an answer is cut at `most_tokens`; citations of passages that there are not are named in the note."""
    asked = questions.select("query_id", "query_text")
    held = cut(passages_of(search(asked, clamp_passages(k)), chunks).withColumn("passage", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "chunk_id")).cast("int")))
    shown = held.select("query_id", F.col("passage").alias("rank"), "book", "page_start", "page_end", "entity_name", "text")
    said = cut(answers(prompts(asked, shown), generator).withColumn("a", cut_off(F.col("answer"), most_tokens)))
    numbers = cited_numbers(F.col("a.text"))
    each = said.select("query_id", "passages", F.col("a.text").alias("answer"), F.col("a.cut").alias("was_cut"), F.col("note").alias("guard"), valid_citations(numbers, F.col("passages")).alias("valid"), invented_citations(numbers, F.col("passages")).alias("invented"))
    told = note(F.col("was_cut"), F.col("invented"), F.concat_ws(" ", F.lit(search_note), F.col("guard")))
    out = each.select("query_id", "passages", "answer", "valid", "invented", told.alias("note"), warning(F.col("passages"), F.col("answer"), F.col("was_cut")).alias("warning"))
    cited = out.select("query_id", F.posexplode("valid").alias("i", "passage")).select("query_id", (F.col("i") + 1).cast("int").alias("source"), "passage")
    sources = cited.join(held.drop("rank", "text"), ["query_id", "passage"]).select("query_id", "source", "passage", "chunk_id", "book", "page_start", "page_end", "entity_name")
    return out, sources


def usage_rows(responses: DataFrame, seconds: Column, tokens_in: Column, tokens_out: Column) -> DataFrame:
    """(query_id, cited, passages, tokens_in, tokens_out, seconds): a line of the usage log for each answer, to be appended."""
    return responses.select("query_id", F.size("valid").alias("cited"), "passages", tokens_in.cast("bigint").alias("tokens_in"), tokens_out.cast("bigint").alias("tokens_out"), F.round(seconds, 3).alias("seconds"))


# --- citations ------------------------------------------------------------------------------------------------------------


def cited_numbers(text: Column) -> Column:
    """Distinct cited numbers in order of first occurrence."""
    marks = F.regexp_extract_all(text, F.lit(CITATION), F.lit(0))
    return F.array_distinct(F.flatten(F.transform(marks, lambda m: F.transform(F.regexp_extract_all(m, F.lit(r"\d+"), F.lit(0)), lambda d: d.cast("int")))))


def is_cited(valid: Column, number: Column | int) -> Column:
    return F.array_contains(valid, number)


def valid_citations(numbers: Column, passages: Column) -> Column:
    return F.filter(numbers, lambda n: (n >= 1) & (n <= passages))


def invented_citations(numbers: Column, passages: Column) -> Column:
    return F.filter(numbers, lambda n: (n < 1) | (n > passages) | n.isNull())


def segments(text: Column) -> Column:
    """Array of (text, numbers): plain text and citations in turn; their texts, joined, are the input."""
    marks = F.regexp_extract_all(text, F.lit(CITATION), F.lit(0))
    plain = F.split(text, CITATION)
    number = lambda m: F.transform(F.regexp_extract_all(m, F.lit(r"\d+"), F.lit(0)), lambda d: d.cast("int"))
    none = F.array().cast("array<int>")
    pairs = F.flatten(F.transform(plain, lambda p, i: F.array(F.struct(p.alias("text"), none.alias("numbers")), F.struct(F.coalesce(F.get(marks, i), F.lit("")).alias("text"), F.coalesce(number(F.get(marks, i)), none).alias("numbers")))))
    return F.filter(pairs, lambda s: s["text"] != "")


def renumbered(valid: Column) -> Column:
    """Map from a passage's number to its place among the cited sources, 1..m."""
    return F.map_from_arrays(valid, F.sequence(F.lit(1), F.size(valid)))


def answer_parts(text: Column, passages: Column) -> Column:
    """Segments with citations renumbered; numbers repeated within one bracket are given once, invented ones vanish."""
    valid = valid_citations(cited_numbers(text), passages)
    return F.filter(
        F.transform(segments(text), lambda s: F.struct(F.when(F.size(s["numbers"]) == 0, s["text"]).otherwise("").alias("text"), F.array_distinct(F.transform(F.filter(s["numbers"], lambda n: F.array_contains(valid, n)), lambda n: F.array_position(valid, n).cast("int"))).alias("sources"))),
        lambda s: (s["text"] != "") | (F.size(s["sources"]) > 0),
    )


def note(was_cut: Column, invented: Column, search_note: Column) -> Column:
    said = F.concat_ws(" ", F.when(was_cut, F.lit("A resposta foi cortada no limite de saída.")), F.when(F.size(invented) > 0, F.concat(F.lit("Citações inexistentes: "), F.array_join(F.transform(invented, lambda n: n.cast("string")), ", "), F.lit("."))), search_note)
    return F.nullif(said, F.lit(""))


def warning(passages: Column, answer: Column, was_cut: Column) -> Column:
    return F.when(passages == 0, "sem-fontes").when(F.trim(answer) == "", "vazia").when(was_cut, "cortada")


# --- limits on traffic ----------------------------------------------------------------------------------------------------


def valid_question(question: Column, longest: int = LONGEST) -> Column:
    n = F.length(F.trim(question))
    return F.coalesce(n.between(1, longest), F.lit(False))


def delivered_once(events: DataFrame) -> DataFrame:
    """One row per event id: the earliest."""
    return events.groupBy("event_id").agg(F.min(F.struct("ts", "client", "question")).alias("e")).select("event_id", "e.ts", "e.client", "e.question")


def rate_limited(events: DataFrame, permits: int = PER_MINUTE, window: str = "minute") -> DataFrame:
    """Fixed windows aligned to the clock: the first `permits` events of a client in a window pass (`admitted`). The window is part of the key, so even a client with a third of all rows is dealt over all tasks."""
    w = Window.partitionBy("client", "window_start").orderBy("ts", "event_id")
    return events.withColumn("window_start", F.date_trunc(window, "ts")).withColumn("admitted", F.row_number().over(w) <= permits)


def daily_quota(events: DataFrame, quota: int = PER_DAY) -> DataFrame:
    """The first `quota` events of each day pass. Only the `quota` first of every partition and day are kept for the final ranking (a group limit), so no day is gathered whole."""
    w = Window.partitionBy("day").orderBy("ts", "event_id")
    first = events.withColumn("day", F.to_date("ts")).withColumn("n", F.row_number().over(w)).where(F.col("n") <= quota)
    return first

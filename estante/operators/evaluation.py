"""Gold questions, their validation, and retrieval and citation metrics.

Every metric is a Column or one aggregation; report values are rounded half-even with `bround`. Means of nothing are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estante.functions import text as T

TYPES = ["nominal", "parafrase", "combinacao"]
UUID = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
CUTS = (1, 3, 5, 8)
INTERVALS = "array<struct<book:string,start:int,end:int>>"


# --- reading the gold set -------------------------------------------------------------------------------------------------


def parse_boolean(raw: Column) -> Column:
    b = T.norm(raw)
    return F.when(b.isin("sim", "s", "true", "1"), True).when(b.isin("nao", "n", "false", "0"), False)


def parse_pages(raw: Column) -> Column:
    """Array of (book, start, end) from `book:a` or `book:a-b`; a reversed range closes at its greater page."""
    parts = F.filter(F.split(raw, r"[\s;|,]+"), lambda p: p.rlike(r"^[\p{L}\p{N}_-]+:\p{N}+([-–]\p{N}+)?$"))

    def one(p: Column) -> Column:
        a = F.regexp_extract(p, r":(\d+)", 1).cast("int")
        b = F.nullif(F.regexp_extract(p, r"[-–](\d+)$", 1), F.lit("")).cast("int")
        return F.struct(T.canonical_book(F.substring_index(p, ":", 1)).alias("book"), a.alias("start"), F.greatest(a, F.coalesce(b, a)).alias("end"))

    return F.coalesce(F.transform(parts, one), F.array().cast(INTERVALS))


def parse_ids(raw: Column) -> Column:
    """Distinct ids in order, in small letters."""
    parts = F.filter(F.split(raw, r"[\s;|,]+"), lambda p: p.rlike(UUID))
    return F.coalesce(F.array_distinct(F.transform(parts, F.lower)), F.array().cast("array<string>"))


def questions(perguntas: DataFrame) -> DataFrame:
    """Typed questions, one row per line."""
    return perguntas.select(
        "line_no", F.trim("id").alias("id"), F.col("pergunta").alias("question"), T.norm(F.col("tipo")).alias("type"), F.lower(F.trim("livro")).alias("book"), F.col("resposta_referencia").alias("answer"),
        parse_pages(F.col("paginas_referencia")).alias("pages"), parse_ids(F.col("chunks_referencia")).alias("chunk_ids"), parse_boolean(F.col("respondivel")).alias("answerable"),
    )


def overlap(a: Column, b: Column) -> Column:
    return (a["book"] == b["book"]) & (a["start"] <= b["end"]) & (b["start"] <= a["end"])


def validate(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """(severity, line_no, code, detail): errors stop a run, warnings do not. chunks: (chunk_id, book, page_start, page_end)."""
    issue = lambda df, severity, code, detail=F.lit(None): df.select(F.lit(severity).alias("severity"), "line_no", F.lit(code).alias("code"), detail.cast("string").alias("detail"))
    several = asked.groupBy("id").agg(F.count("*").alias("n"), F.min("line_no").alias("first")).where("n > 1").select("id", "first")
    own = asked.select("line_no", F.explode("chunk_ids").alias("chunk_id"), "pages")
    known = chunks.groupBy("chunk_id").agg(F.min_by(F.struct("book", "page_start", "page_end"), F.struct("book", "page_start", "page_end")).alias("c"))
    looked = own.join(known, "chunk_id", "left")
    at = F.struct(F.col("c.book").alias("book"), F.col("c.page_start").alias("start"), F.coalesce("c.page_end", "c.page_start").alias("end"))
    outside = looked.where(F.col("c.page_start").isNotNull() & (F.size("pages") > 0) & ~F.exists("pages", lambda p: overlap(p, at)))
    found = [
        issue(asked.where("id is null or id = ''"), "error", "no id"),
        issue(asked.where(F.coalesce(F.trim("question"), F.lit("")) == ""), "error", "no question"),
        issue(asked.where("answerable is null"), "error", "answerable unreadable"),
        issue(asked.where(~F.coalesce(F.col("type").isin(TYPES), F.lit(False))), "warning", "unknown type", F.col("type")),
        issue(asked.join(several, "id").where("line_no > first"), "error", "id again", F.col("id")),
        issue(asked.where(F.col("answerable") & (F.size("chunk_ids") == 0)), "error", "answerable without chunks"),
        issue(asked.where(~F.col("answerable") & (F.size("chunk_ids") > 0)), "warning", "unanswerable with chunks"),
        issue(asked.where(F.col("answerable") & (F.size("pages") == 0)), "warning", "no pages"),
        issue(looked.where("c is null"), "error", "unknown chunk", F.col("chunk_id")),
        issue(outside, "warning", "chunk outside the pages", F.col("chunk_id")),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


# --- ranks and retrieval metrics ------------------------------------------------------------------------------------------


def reference_ranks(asked: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, type, strategy, first_rank): the first rank of a reference in each list that the question has; null outside its depth. asked: (query_id, type, chunk_ids); hits: (query_id, strategy, chunk_id, rank)."""
    refs = asked.select("query_id", F.explode("chunk_ids").alias("chunk_id"), F.lit(True).alias("is_reference"))
    lists = hits.join(refs, ["query_id", "chunk_id"], "left").groupBy("query_id", "strategy").agg(F.min(F.when(F.col("is_reference"), F.col("rank"))).alias("first_rank"))
    return lists.join(asked.select("query_id", "type"), "query_id")


def hit_at(rank: Column, k: int) -> Column:
    return F.coalesce(F.avg(F.when(rank <= k, 1.0).otherwise(0.0)), F.lit(0.0))


def mrr_at(rank: Column, k: int) -> Column:
    return F.coalesce(F.avg(F.when(rank <= k, 1.0 / rank).otherwise(0.0)), F.lit(0.0))


def retrieval_table(ranks: DataFrame, places: int = 6) -> DataFrame:
    """Hit@k, MRR@8 and misses per strategy, over all questions (type null) and by type: one pass over grouping sets."""
    r = F.col("first_rank")
    measures = [F.count("*").cast("bigint").alias("n"), *[F.round(hit_at(r, k), places).alias(f"hit_{k}") for k in CUTS], F.round(mrr_at(r, 8), places).alias("mrr_8"), F.count_if(r.isNull()).cast("bigint").alias("outside")]
    return ranks.groupingSets([["strategy"], ["type", "strategy"]], "type", "strategy").agg(*measures, F.grouping("type").cast("int").alias("overall"))


def mcnemar(only_a: Column, only_b: Column) -> Column:
    """Exact two-sided McNemar test: twice the binomial tail, at most 1; 1 without discordant pairs. The running binomial starts at 2^-n, so hundreds of discordant pairs keep their precision; beyond a thousand the log form is used."""
    n, m = only_a + only_b, F.least(only_a, only_b)
    log_half = F.log(F.lit(0.5)) * n
    start = F.struct(log_half.cast("double").alias("c"), F.lit(0.0).alias("s"))
    step = lambda z, i: F.struct((z["c"] + F.log((n - i).cast("double") / (i + 1))).alias("c"), (z["s"] + F.exp(z["c"])).alias("s"))
    tail = F.aggregate(F.sequence(F.lit(0).cast("bigint"), m.cast("bigint")), start, step, lambda z: z["s"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def significance(ranks: DataFrame, strategies: list[str], cuts: tuple[int, ...] = (1, 5, 8)) -> DataFrame:
    """(a, b, k, only_a, only_b, p) of every two strategies, over the questions that have both lists. The strategies' ranks stand side by side in one row, so no self-join is needed."""
    wide = ranks.groupBy("query_id").agg(*[F.max(F.when(F.col("strategy") == s, F.struct(F.col("first_rank").alias("r")))).alias(s) for s in strategies])
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y")) for i, a in enumerate(strategies) for b in strategies[i + 1 :]])
    each = wide.select(F.explode(pairs).alias("p")).where("p.x is not null and p.y is not null").select("p.a", "p.b", F.col("p.x.r").alias("x"), F.col("p.y.r").alias("y"), F.explode(F.array(*map(F.lit, cuts))).alias("k"))
    hit = lambda c: F.coalesce(F.col(c) <= F.col("k"), F.lit(False))
    counted = each.groupBy("a", "b", "k").agg(F.count_if(hit("x") & ~hit("y")).cast("bigint").alias("only_a"), F.count_if(hit("y") & ~hit("x")).cast("bigint").alias("only_b"))
    return counted.withColumn("p", F.round(mcnemar(F.col("only_a"), F.col("only_b")), 6))


# --- cited sources --------------------------------------------------------------------------------------------------------


def prf(correct: Column, cited: Column, covered: Column, references: Column) -> Column:
    """Struct (precision, recall, f1, any_correct, no_citation), 0 where a denominator is 0."""
    p = F.when(cited == 0, 0.0).otherwise(correct / cited)
    r = F.when(references == 0, 0.0).otherwise(covered / references)
    return F.struct(p.alias("precision"), r.alias("recall"), F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)).alias("f1"), (correct > 0).alias("any_correct"), (cited == 0).alias("no_citation"))


def prf_sets(cited: Column, references: Column) -> Column:
    """For chunk ids and books: both sides as sets."""
    c, r = F.array_distinct(cited), F.array_distinct(references)
    both = F.size(F.array_intersect(c, r))
    return prf(both, F.size(c), both, F.size(r))


def prf_pages(cited: Column, references: Column) -> Column:
    """For page intervals: correct counts cited intervals that meet a reference, covered counts references met; cited duplicates count."""
    meets = lambda xs, ys: F.size(F.filter(xs, lambda x: F.exists(ys, lambda y: overlap(x, y))))
    return prf(meets(cited, references), F.size(cited), meets(references, cited), F.size(references))


#: Fixed pattern of a page or a range of pages, and of a source in running text, {names} being the books' names.
PAGE = r"\d+(?:\s*[-–]\s*\d+)?"
SOURCE = r"(?i)({names})\s*[,:\-–—]?\s*(?:pp?\.|p[áa]gs?\.|p[áa]ginas?)\s*(" + PAGE + r"(?:\s*(?:,|e)\s*" + PAGE + ")*)"


def free_text_sources(answer: Column, names: dict[str, str]) -> Column:
    """Distinct (book, start, end) from text such as "Livro do Jogador, p. 95-96 e 98", pages as bigint: running text holds numbers of any size. Where one is beyond that, the book is
    kept with both pages null, a source that meets no reference. names: from a book's name to its alias."""
    book = "|".join(names)
    source = SOURCE.replace("{names}", book)
    alias = F.create_map(*[F.lit(x) for k, v in names.items() for x in (k.lower(), v)])

    def one(m: Column) -> Column:
        b = alias[F.lower(F.regexp_extract(m, rf"(?i)^({book})", 1))]
        tail = F.regexp_replace(m, rf"(?i)^({book})", "")
        numbers = F.transform(F.regexp_extract_all(tail, F.lit(PAGE), F.lit(0)), lambda x: F.struct(number(x, r"^(\d+)").alias("a"), number(x, r"(\d+)$").alias("z")))
        return F.transform(numbers, lambda n: interval(b, n["a"], n["z"]))

    def number(x: Column, pattern: str) -> Column:
        return F.regexp_extract(x, pattern, 1).try_cast("bigint")

    def interval(b: Column, a: Column, z: Column) -> Column:
        read = a.isNotNull() & z.isNotNull()
        return F.struct(b.alias("book"), F.when(read, a).alias("start"), F.when(read, F.greatest(a, z)).alias("end"))

    return F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(answer, F.lit(source), F.lit(0)), one)))


def books_in_parentheses(answer: Column, names: dict[str, str]) -> Column:
    book = "|".join(names)
    alias = F.create_map(*[F.lit(x) for k, v in names.items() for x in (k.lower(), v)])
    inside = F.array_join(F.regexp_extract_all(answer, F.lit(r"\(([^()]*)\)"), F.lit(1)), "\n")
    return F.array_distinct(F.transform(F.regexp_extract_all(inside, F.lit(rf"(?i)({book})"), F.lit(0)), lambda b: alias[F.lower(b)]))


# --- other tables ---------------------------------------------------------------------------------------------------------


def nearest_rank(value: str, p: float) -> Column:
    """Nearest-rank percentile: a value that occurs, never between two."""
    return F.expr(f"percentile_disc({p}) within group (order by {value})")


def latency_table(runs: DataFrame, by: str, value: str) -> DataFrame:
    return runs.groupBy(by).agg(F.count(value).cast("bigint").alias("n"), F.round(F.avg(value), 6).alias("mean"), nearest_rank(value, 0.5).alias("p50"), nearest_rank(value, 0.95).alias("p95"), F.round(F.sum(value), 4).alias("total"))


def per_question(ranks: DataFrame, strategies: list[str]) -> DataFrame:
    """One row per question: the first reference rank of each strategy, and whether any list holds it among the first eight."""
    wide = ranks.groupBy("query_id", "type").agg(*[F.min(F.when(F.col("strategy") == s, F.col("first_rank"))).alias(s) for s in strategies])
    return wide.withColumn("in_passages", F.coalesce(F.least(*strategies) <= 8, F.lit(False)))


def type_order(kind: Column) -> Column:
    """Place of a question type: the fixed ones first, then the rest."""
    at = F.array_position(F.array(*map(F.lit, TYPES)), kind)
    return F.when(at > 0, at).otherwise(len(TYPES) + 1).cast("int")


def pending(asked: DataFrame, recorded: DataFrame, key: str = "query_id") -> DataFrame:
    """Questions without a record yet."""
    return asked.join(recorded.select(key).distinct(), key, "left_anti")


def unknown_ids(wanted: DataFrame, asked: DataFrame, key: str = "query_id") -> DataFrame:
    return wanted.join(asked, key, "left_anti")


def summary(asked: DataFrame) -> DataFrame:
    """Counts by type and answerability."""
    return asked.groupBy("type", "answerable").agg(F.count("*").cast("bigint").alias("n"), F.countDistinct("id").cast("bigint").alias("ids"))


def require_strategies(ranks: DataFrame, strategies: list[str]) -> None:
    """A strategy that no record has is an error."""
    held = {r.strategy for r in ranks.where(F.col("strategy").isin(strategies)).select("strategy").distinct().collect()}
    if missing := [s for s in strategies if s not in held]:
        raise ValueError(f"no records of {', '.join(missing)}")


def summary_by_book(asked: DataFrame) -> DataFrame:
    """(book, n): questions by each book that they name, the most first; a question that names several counts for each."""
    books = F.filter(F.split(F.coalesce("book", F.lit("")), r"\s*[;,|/]\s*"), lambda b: b != "")
    return asked.select(F.explode(F.array_distinct(F.transform(books, T.canonical_book))).alias("book")).groupBy("book").agg(F.count("*").cast("bigint").alias("n")).orderBy(F.desc("n"), "book")


# --- a run ----------------------------------------------------------------------------------------------------------------

#: Answers with passages and without.
WITH, WITHOUT = "com", "sem"


def clamp_run(rounds: int, depth: int) -> tuple[int, int]:
    """At least one round and a depth of eight."""
    return max(1, rounds), max(8, depth)


def usable(asked: DataFrame, issues: DataFrame) -> DataFrame:
    """The questions whose line has no error."""
    return asked.join(issues.where("severity = 'error'").select("line_no").distinct(), "line_no", "left_anti")


def invalid_ids(perguntas: DataFrame) -> DataFrame:
    """(severity, line_no, code, detail) of every part of the chunk references that is no id, in the form of `validate`."""
    parts = F.array_distinct(F.filter(F.split("chunks_referencia", r"[\s;|,]+"), lambda p: (p != "") & ~p.rlike(UUID)))
    return perguntas.select(F.lit("error").alias("severity"), "line_no", F.lit("invalid chunk id").alias("code"), F.explode(parts).alias("detail"))


def top_passages(hits: DataFrame, asked: DataFrame, k: int = 8) -> DataFrame:
    """(query_id, strategy, rank, chunk_id, score, is_reference): the record of a list's first passages, scores rounded half-even at six places."""
    refs = asked.select("query_id", F.explode("chunk_ids").alias("chunk_id")).distinct().withColumn("is_reference", F.lit(True))
    top = hits.where(F.col("rank") <= k).select("query_id", "strategy", "rank", "chunk_id", F.bround("score", 6).alias("score"))
    return top.join(refs, ["query_id", "chunk_id"], "left").withColumn("is_reference", F.coalesce("is_reference", F.lit(False)))


def run_plan(asked: DataFrame, strategies: list[str], rounds: int = 1) -> DataFrame:
    """(query_id, step, strategy, mode, round, chunk_ids): what a run does with each question: a search by every strategy, then in every round an answer with
    passages and one without. A question that is not answerable has no references."""
    searches = [F.struct(F.lit("search").alias("step"), F.lit(x).alias("strategy"), F.lit(None).cast("string").alias("mode"), F.lit(0).alias("round")) for x in strategies]
    answers = [F.struct(F.lit("answer").alias("step"), F.lit(None).cast("string").alias("strategy"), F.lit(m).alias("mode"), F.lit(r).alias("round")) for r in range(1, clamp_run(rounds, 8)[0] + 1) for m in (WITH, WITHOUT)]
    refs = F.when(F.col("answerable"), F.col("chunk_ids")).otherwise(F.array().cast("array<string>"))
    return asked.select("query_id", refs.alias("chunk_ids"), F.explode(F.array(*searches, *answers)).alias("s")).select("query_id", "s.*", "chunk_ids")


def source_measures(answers: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, mode, level, precision, recall, f1, any_correct, no_citation) of the cited sources. answers: (query_id, mode, chunks, intervals, books), what each cites;
    asked: (query_id, chunk_ids, pages). The five rows of the report: chunks with passages only, pages and books in both modes; those skip questions without reference pages."""
    books = F.transform("pages", lambda p: p["book"])
    each = F.array(
        F.struct(F.lit("chunk").alias("level"), prf_sets(F.col("chunks"), F.col("chunk_ids")).alias("m")),
        F.struct(F.lit("page").alias("level"), prf_pages(F.col("intervals"), F.col("pages")).alias("m")),
        F.struct(F.lit("book").alias("level"), prf_sets(F.col("books"), books).alias("m")),
    )
    rows = answers.join(asked.select("query_id", "chunk_ids", "pages"), "query_id").select("query_id", "mode", F.size("pages").alias("n_pages"), F.explode(each).alias("e"))
    kept = rows.where(F.when(F.col("e.level") == "chunk", F.col("mode") == WITH).otherwise(F.col("n_pages") > 0))
    return kept.select("query_id", "mode", "e.level", "e.m.*")


def source_report(measures: DataFrame) -> DataFrame:
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(c)
    return measures.groupBy("mode", "level").agg(F.count("*").cast("bigint").alias("n"), mean("precision"), mean("recall"), mean("f1"), F.count_if("any_correct").cast("bigint").alias("any_correct"), F.count_if("no_citation").cast("bigint").alias("no_citation"))


def performance(runs: DataFrame, by: str) -> DataFrame:
    """Times and tokens by strategy or mode: n, mean, p50, p95 of the seconds (an answer's are those of search and generation), and the tokens' totals and means.
    runs: (by, search_seconds, answer_seconds, tokens_in, tokens_out, tokens_reasoning), nulls counting as nothing."""
    timed = runs.withColumn("seconds", F.coalesce("search_seconds", F.lit(0.0)) + F.coalesce("answer_seconds", F.lit(0.0)))
    tokens = [m for c in ("tokens_in", "tokens_out", "tokens_reasoning") for m in (F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c), F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(f"mean_{c}"))]
    return timed.groupBy(by).agg(F.count("*").cast("bigint").alias("n"), F.round(F.avg("seconds"), 6).alias("mean"), nearest_rank("seconds", 0.5).alias("p50"), nearest_rank("seconds", 0.95).alias("p95"), *tokens)


def error_table(ranks: DataFrame, strategies: list[str], shown: DataFrame, cited: DataFrame, asked: DataFrame) -> DataFrame:
    """One row per question: the first reference rank by each strategy, whether a reference is among the passages shown to the generator, and whether the answer cites one.
    shown, cited: (query_id, chunk_id) of the first round's answers with passages."""
    refs = asked.select("query_id", F.explode("chunk_ids").alias("chunk_id")).distinct()
    flag = lambda df, name: df.join(refs, ["query_id", "chunk_id"], "left_semi").select("query_id").distinct().withColumn(name, F.lit(True))
    wide = ranks.groupBy("query_id", "type").agg(*[F.min(F.when(F.col("strategy") == s, F.col("first_rank"))).alias(s) for s in strategies])
    both = wide.join(flag(shown, "in_passages"), "query_id", "left").join(flag(cited, "is_cited"), "query_id", "left")
    return both.fillna(False, ["in_passages", "is_cited"])


def rounds_of(records: DataFrame) -> int:
    """How many rounds a run has: the greatest that is recorded, at least 1."""
    return max(1, records.agg(F.max("round").alias("r")).first()["r"] or 0)

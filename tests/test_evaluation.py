import math

from pyspark.sql import functions as F

from estante.operators import evaluation as E

#: First reference rank of three strategies for 44 questions, by type (N, P, C); "-" is outside the depth. Published figures (fixed values).
GOLDEN = """q01N 1,2,1 q02P 1,1,1 q03N 3,5,3 q04P 2,-,5 q05N 6,1,2 q06P 46,18,3
q07N 2,4,1 q08P 2,2,1 q31P 4,2,1 q11N 4,10,6 q12P 2,5,4 q13N 1,2,1
q14P 1,1,1 q15N 1,1,1 q16N 1,1,2 q17P 3,-,13 q18P 3,-,16 q21N 1,1,1
q22N 1,1,1 q23P 32,23,9 q24P 1,1,1 q25N 1,1,1 q26P 1,6,2 q27P 3,3,3
q28P 7,-,16 q32C 1,2,1 q33C 1,1,1 q34C 5,13,3 q35C 1,1,1 q36C 1,5,2
q37C 1,8,2 q38C 1,13,3 q39C 1,1,1 q40C 1,2,1 q41C 1,1,1 q42P 1,5,1
q43C 1,1,1 q44C 1,2,1 q45C 1,1,1 q46C 3,2,3 q47P 1,1,1 q48C 2,-,16
q49C 1,3,1 q50C 1,1,1"""


def ranks(spark):
    items = GOLDEN.split()
    rows = [(q[:-1], q[-1], s, None if r == "-" else int(r)) for q, rs in zip(items[::2], items[1::2]) for s, r in zip(("cosseno", "bm25", "rrf"), rs.split(","))]
    return spark.createDataFrame(rows, "query_id string, type string, strategy string, first_rank int")


def test_published_retrieval_table(spark):
    got = {(r.type, r.strategy): r for r in E.retrieval_table(ranks(spark)).collect()}
    pct = lambda r: [round(100 * r[f"hit_{k}"], 1) for k in E.CUTS]
    assert pct(got[None, "cosseno"]) == [61.4, 84.1, 90.9, 95.5] and pct(got[None, "bm25"]) == [38.6, 61.4, 72.7, 77.3] and pct(got[None, "rrf"]) == [56.8, 81.8, 86.4, 88.6]
    assert [round(got[None, s].mrr_8, 3) for s in ("cosseno", "bm25", "rrf")] == [0.731, 0.523, 0.684]
    assert [got[None, s].outside for s in ("cosseno", "bm25", "rrf")] == [0, 5, 0]
    assert [got[t, "rrf"].n for t in "NPC"] == [11, 16, 17] and round(got["N", "rrf"].mrr_8, 3) == 0.773 and round(got["P", "bm25"].mrr_8, 3) == 0.369
    half_even = spark.createDataFrame([(0.8125,), (0.0625,)], "x double").select(F.bround(F.col("x"), 3).alias("r")).collect()
    assert [r.r for r in half_even] == [0.812, 0.062]


def test_published_significance(spark):
    got = {(r.a, r.b, r.k): (r.only_a, r.only_b, r.p) for r in E.significance(ranks(spark), ["cosseno", "bm25", "rrf"]).collect()}
    want = {("cosseno", "bm25", 1): (11, 1, 0.006), ("cosseno", "bm25", 5): (9, 1, 0.021), ("cosseno", "bm25", 8): (8, 0, 0.008), ("cosseno", "rrf", 1): (5, 3, 0.727), ("cosseno", "rrf", 5): (4, 2, 0.688), ("cosseno", "rrf", 8): (4, 1, 0.375), ("bm25", "rrf", 1): (2, 10, 0.039), ("bm25", "rrf", 5): (0, 6, 0.031), ("bm25", "rrf", 8): (0, 5, 0.062)}
    assert {k: (a, b, round(p + 1e-12, 3) if p != 0.0625 else 0.062) for k, (a, b, p) in got.items()} == want


def test_mcnemar_of_none_and_of_many(spark):
    df = spark.createDataFrame([(0, 0), (5, 5), (2000, 2200)], "a bigint, b bigint").select(E.mcnemar(F.col("a"), F.col("b")).alias("p"))
    p = [r.p for r in df.collect()]
    n = 4200
    exact = 2 * sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)) for i in range(2001))
    assert p[0] == 1 and p[1] == 1 and math.isclose(p[2], exact, rel_tol=1e-6)


def test_reading_fields(spark):
    df = spark.createDataFrame([("monstros:5-3; vau:1–2|x:y", f"{'A' * 8}-0000-0000-0000-{'b' * 12}, nope", " Não "), (None, "", None)], "p string, c string, r string")
    a, b = df.select(E.parse_pages(F.col("p")).alias("p"), E.parse_ids(F.col("c")).alias("c"), E.parse_boolean(F.col("r")).alias("r")).collect()
    assert [tuple(x) for x in a.p] == [("monstro", 5, 5), ("vau", 1, 2)] and a.c == ["aaaaaaaa-0000-0000-0000-bbbbbbbbbbbb"] and a.r is False
    assert b.p == [] and b.c == [] and b.r is None


def test_prf(spark):
    s = "array<struct<book:string,start:int,end:int>>"
    df = spark.createDataFrame([([("a", 1, 3), ("a", 1, 3), ("b", 9, 9)], [("a", 3, 4), ("c", 1, 1)]), ([], [("a", 1, 1)])], f"c {s}, r {s}")
    one, none = [r.m for r in df.select(E.prf_pages(F.col("c"), F.col("r")).alias("m")).collect()]
    assert (round(one.precision, 3), one.recall, round(one.f1, 3), one.any_correct) == (0.667, 0.5, 0.571, True)
    assert tuple(none) == (0.0, 0.0, 0.0, False, True)


def test_sources_in_running_text(spark):
    names = {"Livro do Jogador": "jogador", "Guia do Mestre": "mestre", "Manual dos Monstros": "monstro"}
    text = "(livro do jogador, p. 95-96 e 98; Guia do Mestre págs. 7, 3) Manual dos Monstros. Livro do Jogador p. 95-96, Guia do Mestre, p. 9-2"
    r = spark.createDataFrame([(text,)], "t string").select(E.free_text_sources(F.col("t"), names).alias("s"), E.books_in_parentheses(F.col("t"), names).alias("b")).first()
    assert [tuple(x) for x in r.s] == [("jogador", 95, 96), ("jogador", 98, 98), ("mestre", 7, 7), ("mestre", 3, 3), ("mestre", 9, 9)] and r.b == ["jogador", "mestre"]


def test_sources_with_pages_beyond_int(spark, tmp_path):
    from estante.plans import evaluation as P

    text = "Livro do Jogador, p. 3000000001-3000000003 e 7; Guia do Mestre, págs. 99999999999999999999, 4, 5-99999999999999999999; Guia do Mestre, p. 2147483648"
    s = E.free_text_sources(F.col("t"), P.NAMES)
    cited = spark.createDataFrame([(text,)], "t string").select(s.alias("s"), E.prf_pages(s, F.from_json(F.lit('[{"book": "mestre", "start": 4, "end": 4}]'), E.INTERVALS)).alias("m")).first()
    assert [tuple(x) for x in cited.s] == [("jogador", 3000000001, 3000000003), ("jogador", 7, 7), ("mestre", None, None), ("mestre", 4, 4), ("mestre", 2147483648, 2147483648)]
    assert (cited.m.precision, cited.m.recall) == (0.2, 1.0)
    lines = [7, 2147483645, 2147483646, 2147483647, 3000000001, 92000000004218]
    spark.createDataFrame([(n,) for n in lines], "line_no bigint").write.parquet(str(tmp_path / "perguntas.parquet"))
    got = {r.line_no: (r.sources, r.books) for r in P.free_text_sources(spark, str(tmp_path)).collect()}
    assert got == {n: (f"jogador:{n}:{n + 2} jogador:7:7 mestre:3:3 mestre:4:4", "jogador monstro") for n in lines}


def test_nearest_rank(spark):
    df = spark.createDataFrame([("a", float(x)) for x in range(1, 21)], "g string, v double")
    r = E.latency_table(df, "g", "v").first()
    assert (r.p50, r.p95, r.mean) == (10.0, 19.0, 10.5)


def test_validation(spark):
    q = spark.createDataFrame([(2, "a", "p?", "nominal", None, None, "vau:1", "x", "sim"), (3, "a", "", "outro", None, None, None, None, "talvez")], "line_no bigint, id string, pergunta string, tipo string, livro string, resposta_referencia string, paginas_referencia string, chunks_referencia string, respondivel string")
    c = spark.createDataFrame([], "chunk_id string, book string, page_start int, page_end int")
    got = sorted((r.line_no, r.code) for r in E.validate(E.questions(q), c).collect())
    assert got == [(2, "answerable without chunks"), (3, "answerable unreadable"), (3, "id again"), (3, "no question"), (3, "unknown type")]


def test_missing_strategies_and_books(spark):
    import pytest

    E.require_strategies(ranks(spark), ["bm25", "rrf"])
    with pytest.raises(ValueError, match="outra"):
        E.require_strategies(ranks(spark), ["bm25", "outra"])
    asked = spark.createDataFrame([("monstro",), ("Monstros; jogador",), (None,), ("",)], "book string")
    assert [tuple(r) for r in E.summary_by_book(asked).collect()] == [("monstro", 2), ("jogador", 1)]


def test_accents_of_all_latin_letters(spark):
    from estante.functions import text as X

    words = {"Ação": "acao", "Ştefan": "stefan", "Łódź": "łodz", "ṩ": "s", "e\u0301": "e", "ČŘŽ": "crz", "ñandú": "nandu", "ǖ": "u"}
    got = {r.w: r.n for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", X.norm(F.col("w")).alias("n")).collect()}
    assert got == words and len(X.ACCENTS) == len(X.PLAIN) > 200


def test_a_run_and_its_tables(spark):
    asked = spark.createDataFrame([("a", True, ["x", "y"], [("b", 1, 3)], "nominal"), ("n", False, ["x"], [], "nominal")], f"query_id string, answerable boolean, chunk_ids array<string>, pages {E.INTERVALS}, type string")
    plan = E.run_plan(asked, ["s", "t"], 2).collect()
    assert len(plan) == 2 * (2 + 4) and {len(r.chunk_ids) for r in plan if r.query_id == "n"} == {0}
    assert E.clamp_run(0, 3) == (1, 8) and E.clamp_run(4, 50) == (4, 50) and E.rounds_of(E.run_plan(asked, ["s"], 3)) == 3
    hits = spark.createDataFrame([("a", "s", 1, "x", 0.1234565), ("a", "s", 9, "y", 1.0), ("n", "s", 1, "z", None)], "query_id string, strategy string, rank int, chunk_id string, score double")
    assert sorted((r.query_id, r.chunk_id, r.score, r.is_reference) for r in E.top_passages(hits, asked).collect()) == [("a", "x", 0.123456, True), ("n", "z", None, False)]
    cites = spark.createDataFrame([("a", "com", ["x", "z"], [("b", 3, 4)], ["b"]), ("a", "sem", [], [], ["c"]), ("n", "com", [], [], [])], f"query_id string, mode string, chunks array<string>, intervals {E.INTERVALS}, books array<string>")
    rows = {(r.mode, r.level): r for r in E.source_report(E.source_measures(cites, asked)).collect()}
    assert set(rows) == {("com", "chunk"), ("com", "page"), ("com", "book"), ("sem", "page"), ("sem", "book")}
    assert rows["com", "chunk"].n == 2 and rows["com", "page"].n == 1 and rows["com", "page"].precision == 1.0 and rows["sem", "page"].no_citation == 1 and rows["sem", "book"].precision == 0.0
    runs = spark.createDataFrame([("com", 1.0, 2.0, 10, 5, None), ("com", None, 1.0, 20, 5, 1), ("sem", None, 4.0, 1, 1, 0)], "mode string, search_seconds double, answer_seconds double, tokens_in bigint, tokens_out bigint, tokens_reasoning bigint")
    perf = {r["mode"]: r for r in E.performance(runs, "mode").collect()}
    assert (perf["com"].n, perf["com"].mean, perf["com"].p50, perf["com"].p95, perf["com"].tokens_in, perf["com"].mean_tokens_in) == (2, 2.0, 1.0, 3.0, 30, 15.0)
    ranks_ = spark.createDataFrame([("a", "nominal", "s", 2), ("a", "nominal", "t", None)], "query_id string, type string, strategy string, first_rank int")
    ids = lambda *x: spark.createDataFrame([("a", i) for i in x], "query_id string, chunk_id string")
    assert [tuple(r) for r in E.error_table(ranks_, ["s", "t"], ids("x", "q"), ids("q"), asked).collect()] == [("a", "nominal", 2, None, True, False)]
    raw = spark.createDataFrame([(1, "x; 6f9619ff-8b86-d011-b42d-00cf4fc964ff|x"), (2, None)], "line_no bigint, chunks_referencia string")
    bad = E.invalid_ids(raw)
    assert [(r.line_no, r.detail) for r in bad.collect()] == [(1, "x")]
    assert [r.line_no for r in E.usable(raw, bad).collect()] == [2]


def test_a_whole_run_and_its_resuming(spark, tmp_path):
    import pytest

    from estante.operators import run, search
    from estante.sources import tables

    chunks = spark.createDataFrame([("k1", "monstro", 3, None, "Nome", "o dragão azul [2]"), ("k2", "jogador", 9, 10, None, "a torre"), ("k3", "mestre", None, None, None, "dragão e torre")], "chunk_id string, book string, page_start int, page_end int, entity_name string, text string")
    asked = spark.createDataFrame([("a", "dragão azul?", "nominal", True, ["k1"], [("monstro", 3, 3)]), ("b", "torre?", "parafrase", True, ["k9"], []), ("n", "nada?", "nominal", False, ["k1"], [])], f"query_id string, query_text string, type string, answerable boolean, chunk_ids array<string>, pages {E.INTERVALS}")
    s = search.Strategies()
    s.register("bm25", lambda q, k: search.bm25(q, chunks, k))
    s.register_fusion("rrf", ["bm25"])
    names = {"Livro do Jogador": "jogador", "Manual dos Monstros": "monstro"}
    got = run.evaluate(asked, s, ["bm25", "rrf"], chunks, names, rounds=2)
    assert {(r.query_id, r.strategy): r.first_rank for r in got.ranks.collect()} == {("a", "bm25"): 1, ("a", "rrf"): 1, ("b", "bm25"): None, ("b", "rrf"): None}
    answers = {(r.query_id, r.mode, r.round): r for r in got.answers.collect()}
    assert set(answers) == {(q, m, r) for q in "abn" for m in ("com", "sem") for r in (1, 2)} and set(got.seconds) == {"bm25", "rrf", "com 1", "sem 1", "com 2", "sem 2"}
    assert answers["a", "com", 1].chunks == ["k3", "k1"] or answers["a", "com", 1].chunks[0] in ("k1", "k3")
    assert answers["n", "com", 1].answer == "" and answers["n", "com", 1].chunks == [] and answers["a", "sem", 2].books == ["jogador"]
    assert [(r.chunk_id, r.is_reference) for r in got.passages.where("query_id = 'a' and strategy = 'bm25' and rank = 1").collect()] == [("k1", True)]
    assert E.source_measures(got.answers.where("round = 1"), asked.where("answerable")).count() == 2 + 2 + 2
    path = str(tmp_path / "records")
    assert tables.read_keys(spark, path).count() == 0
    tables.append_jsonl(got.ranks.where("query_id = 'a'"), path)
    rest = run.evaluate(asked, s, ["bm25"], chunks, names, done=tables.read_keys(spark, path))
    assert {r.query_id for r in rest.answers.collect()} == {"b", "n"}
    s.register("dense", lambda q, k: q, lambda: "no vectors")
    with pytest.raises(LookupError, match="no vectors"):
        run.evaluate(asked, s, ["bm25", "dense"], chunks, names)

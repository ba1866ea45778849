import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from estante.operators import embedding, rag, search
from estante.plans import registry

TEXTS = ["o dragão azul voa", "Dragao dragão vermelho", "a torre azul do norte", "", "1º nível: <td>torre</td>"]


def corpus(spark):
    return spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(TEXTS)], "chunk_id string, text string")


def asked(spark, *q):
    return spark.createDataFrame([(str(i), x) for i, x in enumerate(q)], "query_id string, query_text string")


def test_bm25_equals_sqlite(spark):
    db = sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table t using fts5(x, tokenize=\"unicode61 remove_diacritics 2\")")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5")
    for i, t in enumerate(TEXTS):
        db.execute("insert into t(rowid, x) values (?, ?)", (i, t))
    for q in ("dragão azul", "torre torre norte", "td"):
        terms = " OR ".join(f'"{w}"' for w in q.split())
        want = {f"c{r}": -s for r, s in db.execute("select rowid, bm25(t) from t where t match ?", (terms,))}
        got = {r.chunk_id: r.score for r in search.bm25(asked(spark, q), corpus(spark), 10).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=2e-6) for k in want)


def test_bm25_of_nothing_searchable(spark):
    assert search.bm25(asked(spark, "?!", "", "unicórnio"), corpus(spark), 5).count() == 0
    assert search.bm25(asked(spark, "torre"), corpus(spark).limit(0), 5).count() == 0


def test_rrf_with_repeats_and_absent_legs(spark):
    rows = [("q", "cosseno", "a", .9, 1), ("q", "cosseno", "a", .8, 2), ("q", "cosseno", "b", .7, 3), ("q", "bm25", "b", 5.0, 1), ("q", "bm25", "c", 4.0, 2)]
    hits = spark.createDataFrame(rows, "query_id string, strategy string, chunk_id string, score double, rank int")
    got = search.rrf(search.in_list_places(hits), 8, ["cosseno", "bm25"]).orderBy("rank").withColumn("label", search.contribution_label(F.col("contributions"))).collect()
    assert [(r.chunk_id, r.label) for r in got] == [("b", "cosseno #3 · bm25 #1"), ("a", "cosseno #1 · bm25 —"), ("c", "cosseno — · bm25 #2")]
    assert math.isclose(got[0].score, 1 / 63 + 1 / 61, abs_tol=1e-9)


def test_strategies_by_name(spark):
    s = search.Strategies()
    s.register("bm25", lambda q, k: search.bm25(q, corpus(spark), k))
    s.register("broken", lambda q, k: 1 / 0)
    hits, notes = s.compare_all(asked(spark, "torre"), 3)
    assert hits.count() == 2 and list(notes) == ["broken"]
    with pytest.raises(KeyError):
        s.get("none")


def test_cosine_refuses_unbounded_questions(spark):
    q = spark.range(5).select(F.col("id").alias("query_id"), F.array(F.lit(1.0), F.lit(0.0)).alias("qvec"))
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0])], "chunk_id string, vector array<double>")
    assert {r.chunk_id: r.score for r in search.cosine_top_k(q.limit(1), v, 5).collect()} == {"a": 1.0, "b": 0.0}
    with pytest.raises(ValueError):
        search.cosine_top_k(q, v, 5, most_questions=4)


def test_any_number_of_questions_in_passes(spark):
    n = 2_100
    words = ["dragão", "torre", "azul norte", "vermelho"]
    q = spark.createDataFrame([(str(i), words[i % 4]) for i in range(n)], "query_id string, query_text string")
    hits = {(r.query_id, r.chunk_id, r.score, r["rank"]) for r in search.bm25(q, corpus(spark), 2).collect()}
    few = {(int(r.query_id), r.chunk_id, r.score, r["rank"]) for r in search.bm25(q.where("int(query_id) < 4"), corpus(spark), 2).collect()}
    assert hits == {(str(i), c, s, k) for i in range(n) for j, c, s, k in few if j == i % 4}
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("c", [1.0, 1.0])], "chunk_id string, vector array<double>")
    qv = spark.range(n).select(F.col("id").alias("query_id"), F.array(F.lit(1.0), (F.col("id") % 3).cast("double")).alias("qvec"))
    near = search.cosine_top_k(qv, v, 2).collect()
    assert len({(r.query_id, r["rank"]) for r in near}) == len(near) == 2 * n and all(r.chunk_id == "acc"[r.query_id % 3] for r in near if r["rank"] == 1 and r.query_id % 3 < 2)
    by_one = {tuple(r) for r in search.cosine_top_k(qv.limit(7), v, 2, a_pass=2).collect()}
    assert by_one == {tuple(r) for r in search.cosine_top_k(qv.limit(7), v, 2).collect()}


def test_embedder_interface(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(70)], "k int, t string")
    got = embedding.embed(df, "k", "t", lambda texts: [[float(len(t)), 1.0] for t in texts], dimension=2)
    assert {r.k: r.vector[0] for r in got.collect()} == {i: float(i) for i in range(70)}
    with pytest.raises(Exception, match="length 3"):
        embedding.embed(df, "k", "t", lambda texts: [[1.0]] * len(texts), dimension=3).collect()


ANSWERS = ["Diz [2] e [1, 3].", "[9][2; 2] fim [2]", "sem", "[a] [] [0]", "fim [1]", ""]


def test_citations(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ANSWERS)], "i int, t string").orderBy("i")
    n = rag.cited_numbers(F.col("t"))
    rows = df.select("t", n.alias("n"), rag.valid_citations(n, F.lit(3)).alias("v"), rag.invented_citations(n, F.lit(3)).alias("x"), rag.segments(F.col("t")).alias("s"), rag.answer_parts(F.col("t"), F.lit(3)).alias("p")).collect()
    assert [r.n for r in rows] == [[2, 1, 3], [9, 2], [], [0], [1], []]
    assert [r.v for r in rows] == [[2, 1, 3], [2], [], [], [1], []] and rows[1].x == [9] and rows[3].x == [0]
    assert all("".join(s.text for s in r.s) == r.t for r in rows)
    assert [(p.text, p.sources) for p in rows[0].p] == [("Diz ", []), ("", [1]), (" e ", []), ("", [2, 3]), (".", [])]
    assert [(p.text, p.sources) for p in rows[1].p] == [("", [1]), (" fim ", []), ("", [1])]


def test_prompt_and_guard(spark):
    q = asked(spark, "Quanto?", "Nada?")
    p = spark.createDataFrame([("0", 2, "vau", None, None, None, " dois "), ("0", 1, "monstro", 3, 5, "Urso", "um")], "query_id string, rank int, book string, page_start int, page_end int, entity_name string, text string")
    got = {r.query_id: r for r in rag.prompts(q, p).collect()}
    assert got["0"].prompt == "Trechos:\n\n[1] Manual dos Monstros, p. 3–5 — Urso\num\n\n[2] vau\ndois\n\nPergunta: Quanto?"
    a = {r.query_id: r for r in rag.answers(rag.prompts(q, p), rag.extractive).collect()}
    assert a["0"].answer == "um [1]" and a["0"].note is None and a["1"].answer == "" and a["1"].note == rag.NOTHING_FOUND


def test_answers_take_the_fused_passages(spark, tmp_path):
    hits = [("q", "bm25", f"b{i}", 9.0 - i, i) for i in range(1, 6)] + [("q", "cosseno", f"c{i}", 0.9, i) for i in range(1, 6)] + [("r", "cosseno", "c1", 0.9, 1)]
    tables = {
        "resultados": (hits, "query_id string, strategy string, chunk_id string, score double, rank int"),
        "chunks": ([(f"{x}{i}", i, f"texto {x}{i}", None, None, None, "vau") for x in "bc" for i in range(1, 6)], "chunk_id string, ordinal int, text string, entity_name string, page_start int, page_end int, book string"),
        "perguntas": ([(1, "q", "Quanto?"), (2, "r", "Onde?"), (3, "s", "Nada?")], "line_no bigint, id string, pergunta string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r.query_id: r for r in registry.QUERIES["rag_answers"](spark, str(tmp_path)).collect()}
    assert {k: r.passages for k, r in got.items()} == {"q": 8, "r": 1, "s": 0}
    assert got["r"].note is None and got["s"].note == rag.NOTHING_FOUND


def test_limits(spark):
    rows = [(i, f"2026-01-01 00:00:{i % 60:02d}", "x", "q") for i in range(8)] + [(0, "2026-01-01 00:00:59", "x", "q"), (50, "2026-01-01 00:01:00", "x", " "), (51, "2026-01-01 00:00:03", None, "z" * 501)]
    e = spark.createDataFrame(rows, "event_id bigint, ts string, client string, question string").withColumn("ts", F.col("ts").cast("timestamp"))
    once = rag.delivered_once(e)
    assert once.count() == 10
    passed = {r.event_id for r in rag.rate_limited(once).where("admitted").collect()}
    assert passed == {0, 1, 2, 3, 4, 50, 51}
    assert [r.event_id for r in rag.daily_quota(once, 3).orderBy("n").collect()] == [0, 1, 2]
    assert {r.event_id for r in once.where(~rag.valid_question(F.col("question"))).collect()} == {50, 51}


def test_every_query_has_a_name_and_sql_has_a_query():
    assert set(registry.SQL) <= set(registry.QUERIES)


def test_fusion_asks_its_legs_for_fifty_and_needs_them_all(spark):
    asked = {}

    def leg(name):
        def search_(q, k):
            asked[name] = k
            return q.select("query_id", F.explode(F.array(*[F.lit(f"{name}{i}") for i in range(3)] + [F.lit("both")])).alias("chunk_id")).select("*", F.lit(1.0).alias("score"), F.lit(1).alias("rank"))

        return search_

    why = {"b": None}
    s = search.Strategies()
    s.register("a", leg("a"))
    s.register("b", leg("b"), lambda: why["b"])
    s.register_fusion("rrf", ["a", "b"])
    q = spark.createDataFrame([("q", "x")], "query_id string, query_text string")
    top = s.get("rrf")(q, 3).orderBy("rank").collect()
    assert asked == {"a": 50, "b": 50} and len(top) == 3 and top[0].chunk_id == "both" and s.preferred() == "rrf"
    s.get("rrf")(q, 70)
    assert asked == {"a": 70, "b": 70}
    why["b"] = "no vectors"
    assert s.unavailable("rrf") == "rrf: b: no vectors" and s.preferred() == "a"
    with pytest.raises(LookupError, match="no vectors"):
        s.get("rrf")(q, 3)
    hits, runs = s.timed(q, 3)
    assert [(n, note) for n, _, note in runs] == [("a", None), ("b", "b: no vectors"), ("rrf", "rrf: b: no vectors")] and hits.count() == 4 and all(t >= 0 for _, t, _ in runs)


def test_a_failure_while_running_becomes_a_note(spark):
    s = search.Strategies()
    s.register("bad", lambda q, k: q.select("query_id", F.raise_error(F.lit("no service")).alias("chunk_id")))
    hits, notes = s.compare_all(spark.createDataFrame([("q",)], "query_id string"), 3)
    assert hits is None and "no service" in notes["bad"]


def test_the_whole_answer(spark):
    q = spark.createDataFrame([("a", "Quanto?"), ("b", "Onde?"), ("c", None)], "query_id string, query_text string")
    chunks = spark.createDataFrame([("k1", "vau", 3, None, "Nome", "primeira linha"), ("k2", "vau", 4, 5, None, "outra"), ("k3", "x", None, None, None, "mais")], "chunk_id string, book string, page_start int, page_end int, entity_name string, text string")
    hits = spark.createDataFrame([("a", 1, "k2"), ("a", 2, "k1"), ("a", 3, "gone"), ("a", 4, "k3")], "query_id string, rank int, chunk_id string")
    said = lambda instructions, prompts: ["Sim [3], [1, 9] e [3]. " + "x" * 40 for _ in prompts]
    out, sources = rag.respond(q, lambda asked, k: hits, chunks, said)
    got = {r.query_id: r for r in out.collect()}
    assert got["a"].passages == 3 and got["a"].valid == [3, 1] and got["a"].invented == [9] and "9" in got["a"].note and got["a"].warning is None
    assert got["b"].warning == "sem-fontes" and got["b"].note == rag.NOTHING_FOUND and got["b"].answer == "" and got["c"].passages == 0
    assert [(r.source, r.passage, r.chunk_id) for r in sources.orderBy("source").collect()] == [(1, 3, "k3"), (2, 1, "k2")]
    short, _ = rag.respond(q.where("query_id = 'a'"), lambda asked, k: hits, chunks, said, most_tokens=2)
    r = short.first()
    assert r.answer == "Sim [3]," and r.warning == "cortada" and "cortada" in r.note
    usage = rag.usage_rows(out.where("query_id = 'a'"), F.lit(1.23456), F.lit(10), F.lit(5)).first()
    assert (usage.cited, usage.passages, usage.tokens_in, usage.seconds) == (2, 3, 10, 1.235)
    assert spark.range(1).select(rag.is_cited(F.array(F.lit(3), F.lit(1)), 1).alias("x")).first().x and rag.clamp_passages(0) == 1 and rag.clamp_passages(99) == 20


def test_sparse_scores_equal_the_formula(spark):
    import math
    import random

    rng = random.Random(4)
    vocabulary = [f"t{i}" for i in range(30)]
    docs = [(f"d{i:02d}", " ".join(rng.choices(vocabulary, k=rng.randint(0, 25)))) for i in range(60)] + [("e", ""), ("n", None)]
    ask = [(f"q{i}", " ".join(rng.choices(vocabulary, k=rng.randint(1, 6)))) for i in range(20)]
    got = {(r.query_id, r.chunk_id): r.score for r in search.bm25(spark.createDataFrame(ask, "query_id string, query_text string"), spark.createDataFrame(docs, "chunk_id string, text string"), 100).collect()}
    words = {k: (t or "").split() for k, t in docs}
    n, avg = len(docs), sum(map(len, words.values())) / len(docs)
    df = {t: sum(t in w for w in words.values()) for t in vocabulary}
    want = {}
    for q, text in ask:
        for k, w in words.items():
            parts = [max(math.log((n - df[t] + 0.5) / (df[t] + 0.5)), search.FLOOR) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / avg)) for t in text.split() if t in w]
            if parts:
                want[q, k] = round(sum(parts), 6)
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 2e-6 for x in want)

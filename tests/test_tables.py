import pytest
from pyspark.sql import functions as F

from estante.operators import search
from estante.sources import tables
from estante.streaming.limits import rate_limited_stream

COLUMNS = "chunk_id string, ordinal int, text string, entity_name string, page_start int, page_end int, book string, strategy string, is_fallback boolean"


def chunks(spark, *rows):
    return spark.createDataFrame([(i, n, t, None, None, None, b, "s", True) for i, n, t, b in rows], COLUMNS)


def test_writing_a_book_replaces_only_that_book(spark, tmp_path):
    path = str(tmp_path / "v")
    v = lambda *ids: spark.createDataFrame([(i, [1.0, 2.0], "m") for i in ids], "chunk_id string, vector array<float>, model string")
    tables.write_vectors(chunks(spark, ("a", 1, "t", "x"), ("a", 2, "t", "x"), ("b", 1, "t", "y")), v("a", "a", "b"), path, 2)
    tables.write_vectors(chunks(spark, ("c", 1, "t", "x")), v("c"), path, 2)
    assert {(r.chunk_id, r.book) for r in spark.read.parquet(path).collect()} == {("c", "x"), ("b", "y")}
    with pytest.raises(Exception, match="vector without chunk"):
        tables.write_vectors(chunks(spark, ("c", 1, "t", "x")), v("z"), path, 2)
    with pytest.raises(Exception, match="length is not 3"):
        tables.write_vectors(chunks(spark, ("c", 1, "t", "x")), v("c"), path, 3)
    tables.compact(spark, path, str(tmp_path / "w"))
    assert tables.books(spark, str(tmp_path / "w")).count() == 2


def test_index(spark, tmp_path):
    path = str(tmp_path / "i")
    tables.write_index(chunks(spark, ("a", 1, "Ação e ação", "x"), ("b", 1, "  ", "x")), path)
    assert [(r.term, r.tf) for r in spark.read.parquet(f"{path}/postings").orderBy("term").collect()] == [("acao", 2), ("e", 1)]
    assert spark.read.parquet(f"{path}/lengths").first().len == 3


def test_gold_csv(spark, tmp_path):
    text = "id;pergunta;tipo;livro;resposta_referencia;paginas_referencia;chunks_referencia;respondivel\nq1;\"a;\"\"b\"\"\nc\";nominal;x;r;p;k;sim\n\nq2;é;n;;;;;não\n"
    (tmp_path / "g.csv").write_bytes(b"\xef\xbb\xbf" + text.encode())
    got = tables.read_gold(spark, str(tmp_path / "g.csv")).orderBy("line_no").collect()
    assert [(r.line_no, r.id, r.pergunta) for r in got] == [(2, "q1", 'a;"b"\nc'), (5, "q2", "é")]
    (tmp_path / "l.csv").write_bytes(text.encode("latin-1"))
    assert tables.read_gold(spark, str(tmp_path / "l.csv")).orderBy("line_no").collect()[1].respondivel == "não"
    (tmp_path / "m.csv").write_text("id;tipo\n1;2\n")
    with pytest.raises(Exception, match="columns missing"):
        tables.read_gold(spark, str(tmp_path / "m.csv")).collect()


def test_chunk_json_and_jsonl(spark, tmp_path):
    c = chunks(spark, ("a", 1, "t", "x")).withColumn("ordinal", F.lit(None).cast("int"))
    tables.write_chunks_json(c, str(tmp_path / "c"))
    assert tables.read_chunks_json(spark, str(tmp_path / "c")).first().text == "t"
    with pytest.raises(ValueError):
        tables.write_chunks_json(c, str(tmp_path / "c"), sliced=True)
    tables.append_jsonl(spark.createDataFrame([("q1",)], "Id string"), str(tmp_path / "r"))
    tables.append_jsonl(spark.createDataFrame([("q2",)], "Id string"), str(tmp_path / "r"))
    assert tables.read_jsonl(spark, str(tmp_path / "r"), "Id string").count() == 2
    (tmp_path / "livro.md").write_text("um\ndois")
    assert tuple(tables.read_markdown(spark, str(tmp_path / "livro.md")).first()) == ("livro", "um\ndois")
    assert tables.latest_file(spark, str(tmp_path / "livro.md")).endswith("livro.md")


def test_stream_rate_limit(spark, tmp_path):
    rows = [(i, f"2026-01-01 00:00:{i:02d}", "x") for i in range(8)] + [(3, "2026-01-01 00:00:03", "x"), (20, "2026-01-01 00:01:00", None)]
    spark.createDataFrame(rows, "event_id bigint, ts string, client string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id bigint, ts timestamp, client string").parquet(str(tmp_path / "in"))
    q = rate_limited_stream(stream).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("limited").collect()
    assert len(got) == 9 and {r.event_id for r in got if r.admitted} == {0, 1, 2, 3, 4, 20}


def test_books_are_read_together_or_not_at_all(spark, tmp_path):
    for b in ("x", "y"):
        tables.write_chunks_json(chunks(spark, (f"{b}1", 1, "t", b)), str(tmp_path / b))
    got = tables.read_books(spark, {"y": str(tmp_path / "y"), "x": str(tmp_path / "x")})
    assert [(r.chunk_id, r.file_order) for r in got.orderBy("file_order").collect()] == [("y1", 0), ("x1", 1)]
    with pytest.raises(FileNotFoundError, match="z "):
        tables.read_books(spark, {"x": str(tmp_path / "x"), "z": str(tmp_path / "z")})
    info = tables.chunk_file_info(spark, str(tmp_path / "x")).first()
    assert info.found and info.chunks == 1 and info.modified is not None and not tables.chunk_file_info(spark, str(tmp_path / "z")).first().found


def test_run_metadata_and_resuming(spark, tmp_path):
    import datetime as dt

    run = {"started": dt.datetime(2024, 1, 2, 3, 4), "questions": 50, "rounds": 1, "depth": 50, "passages": 8, "embedder": "local", "generator": "extractive", "chunks": 3185}
    path = str(tmp_path / "run")
    assert tables.read_run(spark, path) is None
    tables.write_run(spark, run, path)
    assert tables.read_run(spark, path) == run
    tables.check_resume(run, "local", "extractive")
    tables.check_resume(None, "local", "extractive")
    with pytest.raises(ValueError, match="generator"):
        tables.check_resume(run, "local", "other")
    report = tables.render_report("Avaliação", run, [("Busca", tables.render_table(["a", "b"], [["1", "2"]]))], ["uma nota"])
    tables.write_report(spark, report, str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report"), wholetext=True).first().value == report and "3.185 chunks" in report and "| 1 | 2 |" in report


def test_numbers_are_written_half_even():
    assert [tables.percent(x) for x in (0.6136363, 0.0625, None, 1)] == ["61,4 %", "6,2 %", "—", "100,0 %"]
    assert [tables.decimal(x) for x in (0.8125, 0.0625, 2)] == ["0,812", "0,062", "2,000"] and tables.whole(206811) == "206.811" and tables.milliseconds(470.5) == "470 ms" and tables.seconds(2.05) == "2,0 s"
    assert tables.progress_line({"query_id": "q1", "strategy": "bm25", "seconds": 0.25}, 2, 9) == "[2/9] q1 bm25: 0,2 s"
    assert tables.progress_line({"query_id": "q1", "mode": "com", "round": 2, "error": "sem resposta"}, 3, 9) == "[3/9] q1 com 2: sem resposta"


def test_files_that_are_no_utf8_are_named(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é".encode())
    (tmp_path / "b.txt").write_bytes("é".encode("latin-1"))
    got = tables.encoding_warnings(spark, str(tmp_path)).collect()
    assert len(got) == 1 and got[0].path.endswith("b.txt")
    tables.write_raw_json(spark.createDataFrame([('{"a": 1}',)], "value string"), str(tmp_path / "raw"))
    assert spark.read.json(str(tmp_path / "raw")).first().a == 1
    assert tables.VECTORS.fieldNames()[:2] == ["chunk_id", "vector"]


def test_stores_and_catalogue(spark, tmp_path):
    from estante.sources.stores import Catalogue, LexicalIndex, VectorStore

    c = chunks(spark, ("a", 1, "Ação e ação", "x"), ("b", 2, "torre azul", "y"), ("d", 3, "torre e ação", "y"))
    v = VectorStore(spark, str(tmp_path / "v"), 2)
    assert v.unavailable() and v.count().count() == 0
    v.save(c, spark.createDataFrame([("a", [1.0, 0.0], "m"), ("b", [0.0, 1.0], "m")], "chunk_id string, vector array<float>, model string"))
    q = spark.createDataFrame([("q", [1.0, 0.1])], "query_id string, qvec array<double>")
    assert v.unavailable() is None and [r.chunk_id for r in v.similar(q, 1).collect()] == ["a"] and {(r.book, r.n) for r in v.count().collect()} == {("x", 1), ("y", 1)}
    i = LexicalIndex(spark, str(tmp_path / "i"))
    assert i.unavailable()
    i.save(c)
    asked = spark.createDataFrame([("q", "AÇÃO torre torre"), ("r", "?!"), ("s", "nada")], "query_id string, query_text string")
    got, live = ({(r.query_id, r.chunk_id): (r.score, r["rank"]) for r in df.collect()} for df in (i.search(asked, 5), search.bm25(asked, c, 5)))
    assert got == live and {q for q, _ in got} == {"q"} and i.unavailable() is None and i.count().count() == 2
    assert {r.query_id: r.note[:4] for r in search.notes(asked, i.search(asked, 5)).collect()} == {"r": "A pe", "s": "Nada"}
    (tmp_path / "dados").mkdir()
    (tmp_path / "sub" / "mais").mkdir(parents=True)
    k = Catalogue.above(str(tmp_path / "sub" / "mais"), "dados", {"monstro": "m.md", "outro": "o.md"})
    assert k.path("monstro") == str(tmp_path / "dados" / "m.md") and k.chunks_path("outro").endswith("o.chunks") and k.rules_for("monstro").name == "entity-aware/monstro" and k.rules_for("outro") is None
    with pytest.raises(KeyError):
        k.path("nenhum")
    with pytest.raises(FileNotFoundError):
        Catalogue.above(str(tmp_path), "nenhuma", {})


def test_listing_and_comparison(spark, tmp_path):
    text = tables.listing(chunks(spark, *[(f"c{i:02d}", i, f"texto  {i}", "x") for i in range(5)]), 3)
    assert text.splitlines() == ["c00 · texto 0", "c01 · texto 1", "c02 · texto 2", "… e mais 2"]
    shown = tables.render_comparison([{"rank": 2, "a": "y", "b": None}, {"rank": 1, "a": "x", "b": "z"}], ["a", "b"], {"a": 0.25})
    assert shown.splitlines()[2:] == ["| 1 | x | z |", "| 2 | y | — |", "| tempo | 250 ms | — |"]
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "a.json").write_text("")
    with pytest.raises(ValueError, match="no chunks"):
        tables.read_chunks_json(spark, str(tmp_path / "empty"))


def test_samples_are_bounded_before_they_are_ordered(spark):
    from estante import runtime

    df = spark.range(5000).selectExpr("id", "concat('k', id) AS k", "1 + id * id AS n").repartition(8)
    whole = [r.k for r in df.orderBy(F.xxhash64("k")).limit(40).collect()]
    assert [r.k for r in runtime.lowest_by_hash(df, 40, "k").collect()] == whole and runtime.lowest_by_hash(df, 40, "k").count() == 40
    assert [r.k for r in runtime.lowest_by_hash(df.where("id % 2 = 0"), 40, "k", of=5000, spare=16).collect()] == [r.k for r in df.where("id % 2 = 0").orderBy(F.xxhash64("k")).limit(40).collect()]
    assert [r.id for r in runtime.greatest(df, 7, "n", "k").collect()] == list(range(4999, 4992, -1))
    assert runtime.greatest(df.limit(0), 7, "n", "k").count() == 0 and runtime.lowest_by_hash(df.limit(0), 7, "k").count() == 0 and runtime.greatest(df, 9000, "n", "k").count() == 5000

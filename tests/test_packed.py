from estante.operators.packed import packed_found, resolve, split_packed

SCHEMA = "line_no bigint, paginas_referencia string, chunks_referencia string, extra string"
A, B = "cf44604d-9ce1-bbfd-d759-8adcf1f714bc", "7A3A8B3E-a363-079f-6611-4fa0ffefc73f"


def found(spark, *fields):
    df = spark.createDataFrame([(i, p, c, "x") for i, (p, c) in enumerate(fields)], SCHEMA)
    return sorted((r.line_no, r.campo, r.posicao, r.valor) for r in packed_found(df).collect())


def test_values_between_all_delimiters(spark):
    text = 'vitral:41 / "Crônicas do Vau, tomo II:12" e \'mar:3–5\';;(atlas:1-2) | "Códice ""Névoa"" menor:8",\n'
    got = [v for _, _, _, v in found(spark, (text, None))]
    assert got == ["vitral:41", "Crônicas do Vau, tomo II:12", "mar:3–5", "atlas:1-2", 'Códice "Névoa" menor:8']


def test_ids_repeats_and_positions(spark):
    got = found(spark, (None, f"{A} ; '{B}' {A};"))
    assert got == [(0, "chunks_referencia", 1, A), (0, "chunks_referencia", 2, B), (0, "chunks_referencia", 3, A)]


def test_null_empty_single_and_dash_give_nothing(spark):
    assert found(spark, (None, None), ("", " "), ("-", "—"), ("vau:3-2", A), ("\tcinzas:123", f'"{A}"')) == []


def test_unclosed_quote_is_a_delimiter(spark):
    assert [v for *_, v in found(spark, ('"vau:1; mar:2', None))] == ["vau:1", "mar:2"]


def test_very_long_field_and_repeated_rows(spark):
    text = ";".join(f"vau:{i}" for i in range(5000))
    df = spark.createDataFrame([(1, text, None, "x")] * 2, SCHEMA)
    rows = packed_found(df).collect()
    assert len(rows) == 5000 and {r.valor for r in rows if r.posicao == 5000} == {"vau:4999"}


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "line_no bigint, paginas_referencia string, chunks_referencia string, campo string, skeleton string, parts string, valor string")
    assert packed_found(df).collect() == []
    full = spark.createDataFrame([(1, "vau:1 e mar:2", None, "c", "s", "p", "v")], df.schema)
    assert [r.valor for r in split_packed(full, "line_no", ["paginas_referencia"]).collect()] == ["vau:1", "mar:2"]


def test_resolve_is_positional():
    assert resolve("a:9 e a a:9-9") == [(1, 3, ""), (7, 7, "")]

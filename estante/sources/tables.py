"""Sources and sinks: Markdown, gold CSV, JSONL, chunk JSON, the vector table and the lexical index.

Tables are Parquet partitioned by book; writing a book replaces its partition and no other (dynamic partition overwrite). A job that fails
before its commit changes nothing; the commit itself moves one partition after the other, and the lexical index is two such writes.
"""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from estante.functions import text as X
from estante.operators import search

CHUNKS = {"chunk_id": "string", "ordinal": "int", "text": "string", "entity_name": "string", "page_start": "int", "page_end": "int", "book": "string", "strategy": "string", "is_fallback": "boolean"}
#: Schema of the vector table.
VECTORS = T.StructType([
    T.StructField("chunk_id", T.StringType(), False), T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("text", T.StringType()), T.StructField("entity_name", T.StringType()),
    T.StructField("page_start", T.IntegerType()), T.StructField("page_end", T.IntegerType()), T.StructField("is_fallback", T.BooleanType()), T.StructField("model", T.StringType()), T.StructField("book", T.StringType()),
])
#: Field names of a chunk in a JSON checkpoint (fixed values).
JSON_NAMES = {"Id": "chunk_id", "Texto": "text", "NomeEntidade": "entity_name", "PaginaInicio": "page_start", "PaginaFim": "page_end", "Livro": "book", "NomeStrategy": "strategy", "IsFallback": "is_fallback"}
GOLD = ["id", "pergunta", "tipo", "livro", "resposta_referencia", "paginas_referencia", "chunks_referencia", "respondivel"]


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): whole files; doc_id is the file's name without extension."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("doc_id"), F.col("value").alias("text"))
    return files


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, content) of files for an external layout service."""
    return spark.read.format("binaryFile").load(path)


def decode_text(content: F.Column) -> F.Column:
    """Strict UTF-8 without byte order mark, else Latin-1."""
    utf8 = F.regexp_replace(content.cast("string"), "^\ufeff", "")
    return F.when(is_utf8(content), utf8).otherwise(F.decode(content, "ISO-8859-1"))


def is_utf8(content: F.Column) -> F.Column:
    return F.is_valid_utf8(content.cast("string"))


def encoding_warnings(spark: SparkSession, path: str) -> DataFrame:
    """(path, warning) of files that are no UTF-8 and are read as Latin-1."""
    return read_binary(spark, path).where(~is_utf8(F.col("content"))).select("path", F.lit("not UTF-8; read as Latin-1").alias("warning"))


def write_raw_json(results: DataFrame, path: str, column: str = "value") -> None:
    """Analysis results as they came, one JSON text a line."""
    results.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, the gold columns as strings) of semicolon CSV files with quotes, read whole: a gold file is small, and a record's line number counts the line breaks before it. A missing column is an error."""
    files = read_binary(spark, path).select(decode_text(F.col("content")).alias("text"))

    def parse(batches):
        import csv
        import io

        import pandas as pd

        for b in batches:
            for text in b["text"]:
                reader = csv.reader(io.StringIO(text, newline=""), delimiter=";", quotechar='"', doublequote=True)
                header, rows, line = None, [], 1
                for record in reader:
                    at, line = line, reader.line_num + 1
                    if not any(f.strip() for f in record):
                        continue
                    if header is None:
                        header = [f.strip().lower() for f in record]
                        missing = [c for c in GOLD if c not in header]
                        if missing:
                            raise ValueError(f"columns missing: {', '.join(missing)}")
                        continue
                    named = dict(zip(header, record))
                    rows.append((at, *[named.get(c) for c in GOLD]))
                yield pd.DataFrame(rows, columns=["line_no", *GOLD])

    return files.mapInPandas(parse, "line_no bigint, " + ", ".join(f"{c} string" for c in GOLD))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Records under an explicit schema; blank lines are skipped, and only asked columns are parsed."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_keys(spark: SparkSession, path: str, key: str = "query_id") -> DataFrame:
    """The keys of the records that are there, nothing else of them being parsed; none if nothing was written yet."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"{key} string")
    return read_jsonl(spark, path, f"{key} string").where(F.col(key).isNotNull()).distinct()


def append_jsonl(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def write_chunks_json(chunks: DataFrame, path: str, sliced: bool = False) -> None:
    """A chunk checkpoint; a run over a slice of a document is never saved."""
    if sliced:
        raise ValueError("a sliced run is not saved")
    chunks.select(*[F.col(v).alias(k) for k, v in JSON_NAMES.items()]).write.mode("overwrite").json(path)


def read_chunks_json(spark: SparkSession, path: str) -> DataFrame:
    ddl = ", ".join(f"{k} {CHUNKS[v]}" for k, v in JSON_NAMES.items())
    raw = spark.read.schema(ddl).option("mode", "FAILFAST").json(path)
    if raw.isEmpty():
        raise ValueError(f"no chunks in {path}")
    return raw.select(*[F.col(k).alias(v) for k, v in JSON_NAMES.items()])


def exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def read_books(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """The chunk files of several books, each with its book and the place of its file (`file_order`). A missing file is an error that names all that are missing."""
    missing = [f"{b} ({p})" for b, p in paths.items() if not exists(spark, p)]
    if missing or not paths:
        raise FileNotFoundError("no chunks of " + ", ".join(missing or ["any book"]))
    out = None
    for i, (book, path) in enumerate(paths.items()):
        one = read_chunks_json(spark, path).withColumns({"book": F.coalesce("book", F.lit(book)), "file_order": F.lit(i)})
        out = one if out is None else out.unionByName(one)
    return out


def chunk_file_info(spark: SparkSession, path: str) -> DataFrame:
    """(found, chunks, modified): one row about a book's chunk file, which need not be there."""
    if not exists(spark, path):
        return spark.createDataFrame([(False, 0, None)], "found boolean, chunks bigint, modified timestamp")
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.col("_metadata.file_modification_time").alias("m"))
    return rows.agg(F.lit(True).alias("found"), F.count("*").alias("chunks"), F.max("m").alias("modified"))


#: What a run's metadata hold.
RUN = "started timestamp, questions int, rounds int, depth int, passages int, embedder string, generator string, chunks bigint"


def write_run(spark: SparkSession, run: dict, path: str) -> None:
    """One row of metadata beside a run's records."""
    spark.createDataFrame([run], RUN).coalesce(1).write.mode("overwrite").json(path)


def read_run(spark: SparkSession, path: str) -> dict | None:
    if not exists(spark, path):
        return None
    row = spark.read.schema(RUN).json(path).first()
    return row.asDict() if row else None


def check_resume(run: dict | None, embedder: str, generator: str) -> None:
    """A run is resumed only with the models that it began with."""
    for name, now in (("embedder", embedder), ("generator", generator)):
        if run is not None and run.get(name) != now:
            raise ValueError(f"the run began with {name} {run.get(name)!r}, not {now!r}; start a new one")


# --- reports --------------------------------------------------------------------------------------------------------------


def _fixed(value: float | None, places: int) -> str:
    """Half-even at the place, the point as a comma, thousands by point; "—" for nothing."""
    if value is None:
        return "—"
    d = Decimal(str(value)).quantize(Decimal(1).scaleb(-places), rounding=ROUND_HALF_EVEN)
    return f"{d:,.{places}f}".translate(str.maketrans(",.", ".,"))


def percent(share: float | None) -> str:
    return "—" if share is None else f"{_fixed(float(Decimal(str(share)) * 100), 1)} %"


def decimal(value: float | None) -> str:
    return _fixed(value, 3)


def whole(value: float | None) -> str:
    return _fixed(value, 0)


def milliseconds(value: float | None) -> str:
    return "—" if value is None else f"{_fixed(value, 0)} ms"


def seconds(value: float | None) -> str:
    return "—" if value is None else f"{_fixed(value, 1)} s"


def render_table(headers: list[str], rows: list[list[str]]) -> str:
    return "\n".join("| " + " | ".join(r) + " |" for r in [headers, ["---"] * len(headers), *rows])


def render_report(title: str, run: dict, sections: list[tuple[str, str]], notes: list[str] = ()) -> str:
    """A Markdown report: title, what the run was, sections of tables, notes."""
    facts = f"{run['questions']} perguntas, {run['rounds']} rodada(s), {whole(run['chunks'])} chunks, embedding `{run['embedder']}`, gerador `{run['generator']}`, profundidade {run['depth']}, {run['passages']} passagens."
    parts = [f"# {title}", facts, *(f"## {name}\n\n{body}" for name, body in sections)]
    return "\n\n".join(parts + (["## Notas\n\n" + "\n".join(f"- {n}" for n in notes)] if notes else [])) + "\n"


def render_comparison(ranked: list[dict], strategies: list[str], seconds_of: dict[str, float]) -> str:
    """Side by side, a row a rank and a column a strategy, "—" where a list is shorter, and a last row of times. ranked: rows of `search.compare`, in any order."""
    rows = [[str(r["rank"]), *(r.get(s) or "—" for s in strategies)] for r in sorted(ranked, key=lambda r: r["rank"])]
    times = ["tempo", *(milliseconds(1000 * seconds_of[s]) if s in seconds_of else "—" for s in strategies)]
    return render_table(["#", *strategies], [*rows, times])


def listing(chunks: DataFrame, most: int = 40) -> str:
    """The first rows by ordinal, one a line: id, page, name and the start of the text; then how many more there are. A report: only it is cut."""
    label = F.concat_ws(" · ", "chunk_id", X.page_label(F.col("page_start"), F.col("page_end")), "entity_name", X.preview(F.col("text")))
    lines = [r.line for r in chunks.orderBy("ordinal", "chunk_id").limit(most).select(label.alias("line")).collect()]
    more = chunks.count() - len(lines)
    return "\n".join(lines + ([f"… e mais {more}"] if more > 0 else []))


def write_report(spark: SparkSession, report: str, path: str) -> None:
    spark.createDataFrame([(report.removesuffix("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def progress_line(record: dict, done: int, of: int) -> str:
    """What is printed of a record: how far the run is, the question, what it was asked by, and the time or the error."""
    how = record.get("strategy") or f"{record.get('mode', '')} {record.get('round', 1)}".strip()
    return f"[{done}/{of}] {record['query_id']} {how}: {record.get('error') or seconds(record.get('seconds'))}"


def latest_file(spark: SparkSession, path: str) -> str | None:
    row = read_binary(spark, path).select("path", "modificationTime").agg(F.max_by("path", F.struct("modificationTime", "path")).alias("p")).first()
    return row["p"]


def _replace_books(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("book").parquet(path)


def write_vectors(chunks: DataFrame, embeddings: DataFrame, path: str, dimension: int) -> None:
    """Replaces the books of `chunks`: (chunk_id, vector, model, payload), one row per id, first ordinal first. A vector without chunk or of another length is an error; null stays null."""
    once = search.first_by_id(chunks, "chunk_id", "ordinal", "page_start")
    checked = embeddings.withColumn("vector", F.when(F.size("vector") == dimension, F.col("vector")).otherwise(F.raise_error(F.lit(f"a vector's length is not {dimension}"))))
    joined = checked.dropDuplicates(["chunk_id"]).join(once.withColumn("found", F.lit(True)), "chunk_id", "left")
    whole = joined.withColumn("text", F.when(F.col("found"), F.col("text")).otherwise(F.raise_error(F.concat(F.lit("vector without chunk: "), "chunk_id"))))
    _replace_books(whole.select("chunk_id", "vector", "text", "entity_name", "page_start", "page_end", "is_fallback", "model", "book"), path)


def write_index(chunks: DataFrame, path: str) -> None:
    """Replaces the books of `chunks` in the lexical index: postings under `path`/postings, lengths under `path`/lengths. Statistics are an aggregate of the lengths, so they are always those of what is stored."""
    once = search.first_by_id(chunks.where(F.trim("text") != ""), "chunk_id", "ordinal", "page_start")
    terms = once.select("book", "chunk_id", F.explode(X.tokens(F.col("text"))).alias("term")).groupBy("book", "chunk_id", "term").agg(F.count("*").alias("tf"))
    _replace_books(terms.select("chunk_id", "term", "tf", "book"), f"{path}/postings")
    _replace_books(once.select("chunk_id", F.size(X.tokens(F.col("text"))).cast("bigint").alias("len"), "book"), f"{path}/lengths")


def compact(spark: SparkSession, path: str, to: str, files_per_book: int = 1) -> None:
    """The same rows in fewer files, written beside the table: the caller swaps the folders."""
    spark.read.parquet(path).repartition(files_per_book, "book").write.mode("overwrite").partitionBy("book").parquet(to)


def books(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("book").agg(F.count("*").cast("bigint").alias("n"))

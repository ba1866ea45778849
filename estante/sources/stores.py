"""The vector table and the lexical index behind small interfaces, and the catalogue of books: where their files lie and which rules cut them."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estante.operators import chunking, search
from estante.sources import tables


class VectorStore:
    """Vectors of chunks by book: saved book by book, searched exactly by cosine. An unsaved store finds nothing."""

    def __init__(self, spark: SparkSession, path: str, dimension: int) -> None:
        self.spark, self.path, self.dimension = spark, path, dimension

    def rows(self) -> DataFrame:
        return self.spark.read.schema(tables.VECTORS).parquet(self.path) if tables.exists(self.spark, self.path) else self.spark.createDataFrame([], tables.VECTORS)

    def save(self, chunks: DataFrame, embeddings: DataFrame) -> None:
        tables.write_vectors(chunks, embeddings, self.path, self.dimension)

    def similar(self, questions: DataFrame, k: int) -> DataFrame:
        """questions: (query_id, qvec)."""
        return search.cosine_top_k(questions, self.rows(), search.clamp(k))

    def count(self) -> DataFrame:
        return self.rows().groupBy("book").agg(F.count("*").cast("bigint").alias("n"))

    def unavailable(self) -> str | None:
        return None if tables.exists(self.spark, self.path) and not self.rows().isEmpty() else "no vectors are stored"


class LexicalIndex:
    """Postings and lengths of chunks by book. A question's words are sanitised here: one without a letter or digit finds nothing."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def save(self, chunks: DataFrame) -> None:
        tables.write_index(chunks, self.path)

    def lengths(self) -> DataFrame:
        return self.spark.read.schema("chunk_id string, len bigint, book string").parquet(f"{self.path}/lengths")

    def postings(self) -> DataFrame:
        return self.spark.read.schema("chunk_id string, term string, tf bigint, book string").parquet(f"{self.path}/postings")

    def search(self, questions: DataFrame, k: int) -> DataFrame:
        """(query_id, chunk_id, score, rank) from the stored postings: questions' terms meet them by join, and scores are summed before they are ranked."""
        return search.bm25_from_index(questions, self.postings(), self.lengths(), search.clamp(k))

    def count(self) -> DataFrame:
        return self.lengths().groupBy("book").agg(F.count("*").cast("bigint").alias("n"))

    def unavailable(self) -> str | None:
        return None if tables.exists(self.spark, f"{self.path}/lengths") else "the lexical index is not built"


@dataclass(frozen=True)
class Catalogue:
    """Books, their Markdown files below a root, and the rules that cut them; a book without rules is cut by token budget only."""

    root: str
    files: dict[str, str] = field(default_factory=dict)
    rules: dict[str, chunking.Rules] = field(default_factory=lambda: dict(chunking.RULES))

    @classmethod
    def above(cls, start: str, marker: str, files: dict[str, str]) -> Catalogue:
        """The catalogue rooted at the nearest folder, from `start` upwards, that holds a folder `marker`."""
        for folder in (Path(start).resolve(), *Path(start).resolve().parents):
            if (folder / marker).is_dir():
                return cls(str(folder / marker), files)
        raise FileNotFoundError(f"no folder {marker!r} above {start}")

    def path(self, book: str) -> str:
        if book not in self.files:
            raise KeyError(f"no book {book!r}; there are {sorted(self.files)}")
        return f"{self.root}/{self.files[book]}"

    def chunks_path(self, book: str) -> str:
        return self.path(book).rsplit(".", 1)[0] + ".chunks"

    def rules_for(self, book: str) -> chunking.Rules | None:
        self.path(book)
        return self.rules.get(book)

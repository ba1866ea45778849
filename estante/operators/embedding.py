"""Texts to vectors behind an interface: an embedder is any function from a list of texts to as many vectors.

`hashed_embedding` is the deterministic local stand-in, in Columns only: a term counts in the bucket of its MD5, and the
vector is scaled to length 1. Texts of blanks only are left out before embedding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estante.functions import text as T

DIMENSION, BATCH = 64, 32
Embedder = Callable[[list[str]], list[list[float]]]


def embeddable(chunks: DataFrame, text: str = "text", limit: int | None = None, order: str = "ordinal") -> DataFrame:
    """Rows with text; with `limit`, the first so many in order (a report's feature: the rest then has no vector)."""
    kept = chunks.where(F.trim(text) != "")
    return kept.orderBy(order).limit(limit) if limit else kept


def calls_needed(rows: Column, batch: int = BATCH) -> Column:
    return F.ceil(rows / batch).cast("bigint")


def embed(df: DataFrame, key: str, text: str, embedder: Embedder, dimension: int = DIMENSION, batch: int = BATCH, model: str = "local") -> DataFrame:
    """(key, vector, model) in batches of `batch` texts; a vector of another length fails the job, and a failed job writes nothing."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), batch):
                part = b.iloc[at : at + batch]
                vectors = embedder(list(part[text]))
                if len(vectors) != len(part) or any(len(v) != dimension for v in vectors):
                    raise ValueError(f"the embedder must give {len(part)} vectors of length {dimension}")
                yield pd.DataFrame({key: part[key], "vector": vectors, "model": model})

    return df.select(key, text).mapInPandas(run, f"{key} {kind}, vector array<float>, model string")


def hashed_counts(df: DataFrame, keys: list[str], text: str, dimension: int = DIMENSION) -> DataFrame:
    """(keys, bucket, weight): the non-zero places of the hashed vector, scaled to length 1."""
    bucket = F.pmod(F.conv(F.substring(F.md5(F.col("term").cast("binary")), 1, 8), 16, 10).cast("bigint"), F.lit(dimension))
    counted = df.select(*keys, F.explode(T.tokens(F.col(text))).alias("term")).select(*keys, bucket.alias("bucket")).groupBy(*keys, "bucket").agg(F.count("*").alias("tf"))
    held = counted.groupBy(*keys).agg(F.collect_list(F.struct("bucket", "tf")).alias("b"))  # at most `dimension` of them
    norm = F.sqrt(F.aggregate("b", F.lit(0).cast("bigint"), lambda s, x: s + x["tf"] * x["tf"]).cast("double"))
    return held.select(*keys, norm.alias("norm"), F.inline("b")).select(*keys, "bucket", (F.col("tf") / F.col("norm")).alias("weight"))


def hashed_vectors(df: DataFrame, key: str, text: str, dimension: int = DIMENSION) -> DataFrame:
    """(key, vector): the hashed vector of each text with a term, as an array of doubles."""
    held = hashed_counts(df, [key], text, dimension).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("m"))
    return held.select(key, F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.coalesce(F.element_at("m", i.cast("bigint")), F.lit(0.0))).alias("vector"))

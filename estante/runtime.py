"""Session helpers: reading the test tables, cutting lineage, sizing broadcasts."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of rows, and of bytes written as JSON, that `maybe_broadcast` hints; beyond either the join is a merge of shuffled sides.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session: they need it whatever their path and machine."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="estante-")) / "estante-package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(path))
    _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; where it is unset, a folder of our own if the master is local, and an error if it is not."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="estante-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written once to the checkpoint folder; later readers survive lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Plans that are made and run within have their shuffle files deleted as soon as they have run, not when the driver next collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fits(df: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether an (already cut) side is measured to have at most `most` rows and `most_bytes` bytes. Reads `most` + 1 rows, never more."""
    size = F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
    rows, held = df.limit(most + 1).agg(F.count("*"), size).first()
    return rows <= most and (held or 0) <= most_bytes


def maybe_broadcast(df: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast if the side is measured to fit, else a merge join: Spark's own size estimates, wrong behind Python and arrays, decide nothing."""
    return F.broadcast(df) if fits(df, most, most_bytes) else merged(df)


def merged(df: DataFrame) -> DataFrame:
    """A side to be joined by shuffle and merge, whatever Spark thinks its size is."""
    return df.hint("merge")


def lowest_by_hash(df: DataFrame, n: int, key: str, of: int | None = None, spare: int = 4) -> DataFrame:
    """The `n` rows of the lowest hash of a key: a bounded sample, the same whatever the partitions. Only about `spare` times as many rows as wanted reach the ordering, so
    that partitions, however many, do not each send `n` rows. of: the number of rows, if it is known or a table's own is to stand for those of a filter on it (then with more to spare)."""
    rows = df.count() if of is None else of
    h = F.xxhash64(key)
    thin = df if rows <= 2 * spare * n else df.where(h < F.lit(int(-(2**63) + 2**64 * (spare * n / rows))))
    return thin.orderBy(h, key).limit(n)


def greatest(df: DataFrame, n: int, by: str, key: str) -> DataFrame:
    """The `n` rows with the greatest positive numbers. A histogram by powers of two, at most 64 rows, tells which can be among them."""
    powers = sorted(((r.p, r.k) for r in df.groupBy(F.floor(F.log2(by)).cast("int").alias("p")).agg(F.count("*").alias("k")).collect()), reverse=True)
    held, least = 0, 0
    for p, k in powers:
        held, least = held + k, p
        if held >= n:
            break
    return df.where(F.col(by) >= F.lit(2.0) ** least).orderBy(F.desc(by), key).limit(n)


def cores(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, 1)


def spread(df: DataFrame) -> DataFrame:
    """A scan (or a written table) with fewer partitions than cores is dealt out to all cores for Python work; one that has them stays
    unshuffled. Not for other plans: to count their partitions Spark would have to run them."""
    n = cores(df.sparkSession)
    return df if df.rdd.getNumPartitions() >= n else df.repartition(2 * n)

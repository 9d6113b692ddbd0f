"""Helpers that several of the pipeline operators share."""

from __future__ import annotations

import contextvars
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for tables between steps: what the cluster names in spark.checkpoint.dir. Where that is unset, a local master, as in
    tests, gets a folder of this machine; on a cluster, whose executors would not see it, that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or f"file://{tempfile.gettempdir()}/webstrata-checkpoints"


#: Folders that cut() has written, by the owner that may drop them before the session ends.
WRITTEN: dict[str, list[str]] = {}
OWNER = contextvars.ContextVar("owner", default="")


@contextmanager
def owned(owner: str) -> Iterator[None]:
    """Tables that cut() writes in here can be dropped with sweep(spark, owner). All others last as long as the session."""
    token = OWNER.set(owner)
    try:
        yield
    finally:
        OWNER.reset(token)


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and return it from there: lineage ends, and any executor may be lost afterwards."""
    spark = df.sparkSession
    name = f"{shared_dir(spark)}/webstrata-{uuid.uuid4().hex}"
    df.write.parquet(name)
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    WRITTEN.setdefault(OWNER.get(), []).append(name)
    return spark.read.schema(df.schema).parquet(name)


def sweep(spark: SparkSession, owner: str) -> None:
    """Delete the tables of an owner, once no DataFrame that reads them is needed any more."""
    for name in WRITTEN.pop(owner, []):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches end at 8 MB as well as at a row count, so a run of very long texts can't fill a worker."""
    for key, value in (("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20)), ("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")):
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)


def crc_mod(column: str, m: int):
    """crc32 of an integer column's decimal text, mod m."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % m


def as_bytes(column: pa.Array) -> list:
    """A string column as a list of bytes (None where null), without decoding."""
    return column.cast(pa.binary()).to_pylist()


class Memo(dict):
    """A bounded memo: make(key) for keys it lacks; it starts afresh once it holds `limit` of them."""

    def __init__(self, make: Callable, limit: int = 400_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


def hashed_sample(df: DataFrame, by: str, *key: str, limit: int | None = None, total: int = 0) -> DataFrame:
    """Of each value of `by` (not null) the `limit` rows with the least hash of `key`, or as many as make `total` over all values and
    one at least; column `weight` is the number of rows that each stands for.

    Two passes: hashes are counted by their number of binary digits, which gives each value the least power of two under
    which it has enough rows; only those, about twice as many as wanted, are ranked. A value whose rows all have one hash
    keeps as many of them as any other."""
    digits = lambda: F.length(F.bin("_h"))
    hashed = df.withColumn("_h", F.pmod(F.xxhash64(*key, F.lit("sample")), F.lit(1 << 40)))
    counts = cut(hashed.groupBy(by, digits().alias("_digits")).agg(F.count("*").alias("n")))
    values = counts.select(by).distinct().count()
    limit = limit or max(1, total // max(values, 1))
    upto = F.sum("n").over(Window.partitionBy(by).orderBy("_digits"))
    enough = counts.withColumn("upto", upto).groupBy(by).agg(F.coalesce(F.min(F.when(F.col("upto") >= limit, F.col("_digits"))), F.max("_digits")).alias("_most"), F.sum("n").alias("_n"))
    near = hashed.join(F.broadcast(enough) if values <= 100_000 else enough, by).where(digits() <= F.col("_most"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy("_h", *key))
    weight = F.greatest(F.lit(1.0), F.col("_n") / F.lit(float(limit)))
    return near.withColumn("_rank", rank).where(F.col("_rank") <= limit).select(*df.columns, weight.alias("weight"))


def labelled(docs: DataFrame, labels: DataFrame, label: str, learn, limit: int) -> DataFrame:
    """text, y, weight and doc_id of at most 2 * limit labelled documents for which `learn` (of doc_id) holds. Only their ids are
    broadcast. An id with both labels counts as 1; where rows of documents repeat an id, the limit holds for rows."""
    marked = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(learn & F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    ids = cut(hashed_sample(marked.groupBy("doc_id").agg(F.max("y").alias("y")), "y", "doc_id", limit=limit).withColumnRenamed("weight", "of_id"))
    found = cut(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id"))
    sample = hashed_sample(found, "y", "doc_id", "text", limit=limit)
    return cut(sample.select("text", "y", (F.col("weight") * F.col("of_id")).alias("weight"), "doc_id"))


#: Memos that live on in this Python worker.
MEMOS: list = []


def claim(memo=None) -> None:
    """Called where a task's Python code begins: workers are reused, so what other operators remember there is let go."""
    for other in MEMOS:
        if other is not memo:
            other.clear()
    MEMOS[:] = [] if memo is None else [memo]

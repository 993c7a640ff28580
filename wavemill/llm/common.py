"""Spark-side helpers of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch between the JVM and Python workers; several buffers of this size live in each task.
ARROW_BYTES = 8 << 20
#: Removes a query's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of a dataset folder. A session that names no size of Arrow batches gets one that fits small executors."""
    if "spark.sql.execution.arrow.maxBytesPerBatch" not in spark.conf.getAll:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, from ``spark.checkpoint.dir``.

    Only where the session names none (local tests), one under the warehouse folder is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        found = found if ":" in found else f"file://{found}"
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files behind; each must run once."""
    before = spark.conf.get(_CLEANUP, None)
    try:
        spark.conf.set(_CLEANUP, "true")
        yield
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)


def saved(df: DataFrame, what: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later stages start from files, not from lineage."""
    return Work(df.sparkSession).saved(df, what)


class Work:
    """Tables in the shared folder that go as soon as nothing reads them again."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, scratch(spark, "work")

    def path(self, what: str) -> str:
        return f"{self.folder}/{what}"

    def saved(self, df: DataFrame, what: str) -> DataFrame:
        with freed_shuffles(self.spark):
            df.write.parquet(self.path(what))
        return self.spark.read.schema(df.schema).parquet(self.path(what))

    def drop(self, *whats: str) -> None:
        """Delete tables whose readers have all been saved themselves."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for what in whats:
            path = jvm.org.apache.hadoop.fs.Path(self.path(what))
            path.getFileSystem(conf).delete(path, True)


def mounted(path: str) -> str:
    """The plain path of a shared folder that is mounted on every machine."""
    scheme, _, rest = path.rpartition(":")
    if scheme not in ("", "file"):
        raise ValueError(f"memory-mapped models need a mounted shared folder, not {path!r}")
    return "/" + rest.lstrip("/")


def whole_text(df: DataFrame, column: str = "text") -> Column:
    """The text with null as empty."""
    return F.coalesce(df[column], F.lit(""))


def crc_residue(column: str, modulus: int = 5) -> Column:
    """crc32 of an id as text, modulo ``modulus``; a null id counts as 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus, F.lit(0))


def hashed_sample(rows: DataFrame, by: str, per_value: int, most_bytes: int, salt: str) -> DataFrame:
    """The rows (doc_id, bytes, ...) whose hash of doc_id falls under a share that depends on their ``by`` value, with that hash as ``place``.

    On average ``per_value`` rows of a value, or as many as have ``most_bytes`` bytes if those are fewer; all where it
    has no more. Sizes are counted over all rows, and no row is passed over for its length. No task sees more of a
    value than any other: neither a sort nor a window gathers them.
    """
    sizes = rows.groupBy(by).agg(F.count("*").alias("n"), F.sum("bytes").alias("size"))
    share = F.least(F.lit(per_value) / F.col("n"), F.lit(float(most_bytes)) / F.greatest("size", F.lit(1)))
    place = F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    shares = F.broadcast(sizes.select(by, share.alias("share")))  # one row a label or language
    return rows.join(shares, by).withColumn("place", place).where(F.col("place") < F.col("share")).drop("share")


def schema_of(**fields: str) -> str:
    """A DDL schema."""
    return ", ".join(f"`{k}` {v}" for k, v in fields.items())

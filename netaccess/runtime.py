"""Session helpers shared by every operator: the shared folder and written intermediates."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

#: The most that one side of a join may hold to be sent to every executor.
BROADCAST_BYTES = 64_000_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can see, from ``spark.checkpoint.dir``.

    Only in local mode (tests, a laptop) may that setting be absent: then a folder of our own is made.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("netaccess.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="netaccess-")
        spark.conf.set("netaccess.shared.dir", found)
    return found.rstrip("/")


@contextlib.contextmanager
def with_conf(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The setting for what runs inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def write_once(df: DataFrame, path: str, **options: str) -> None:
    """Write ``df`` as Parquet and let Spark delete its shuffle files at once, not when the driver's garbage goes."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    try:
        spark.conf.set(CLEANUP, "true")
    except PySparkException:  # a Spark without the setting
        before = None
    try:
        df.write.options(**options).parquet(path)
    finally:
        if before is not None:
            spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives executor loss."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    write_once(df, path, **options)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def discard(*written: DataFrame) -> None:
    """Delete intermediates that ``materialize`` wrote, once all that reads them has been written itself."""
    for df in written:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bytes_of(column: Column, kind: DataType) -> Column:
    """About the bytes of a value in memory."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, ArrayType):
        each = F.aggregate(column, F.lit(0).cast("long"), lambda s, x: s + bytes_of(x, kind.elementType)) if isinstance(kind.elementType, (StringType, BinaryType, ArrayType)) else F.size(column) * (8 * max(1, len(kind.elementType)) if isinstance(kind.elementType, StructType) else 8)
        return F.coalesce(each, F.lit(0)) + 24
    return F.lit(8)


def broadcast_if_small(df: DataFrame, max_rows: int = 1_000_000, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only when a count proves ``df`` to hold at most ``max_rows`` rows and ``max_bytes`` bytes; else the planner's join."""
    width = sum((bytes_of(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(16))
    row = df.limit(max_rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(width.cast("long")), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if row["n"] <= max_rows and row["b"] <= max_bytes else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

"""Where intermediate tables go: the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_WRITTEN: dict[str, str | None] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where that is unset and the session is local (as in tests), a folder of our own."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        checkpoint = spark.sparkContext._jsc.sc().getCheckpointDir()
        known = checkpoint.get() if checkpoint.isDefined() else None
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="lattica-")
        spark.sparkContext.setCheckpointDir(known)
    return known if ":" in known else "file://" + known


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    _WRITTEN[path] = None
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def stored_with(df: DataFrame, name: str, *facts: Column) -> tuple[DataFrame, dict]:
    """``stored``, and aggregates over all rows that the same job takes while it writes."""
    seen = Observation()
    out = stored(df.observe(seen, *facts), name)
    return out, seen.get


def bucketed(df: DataFrame, name: str, *keys: str, placed: bool = False) -> DataFrame:
    """``df`` stored in as many buckets of ``keys`` as there are shuffle partitions.

    Joins and sums by these keys then read it where it lies and shuffle only their
    other side. ``placed``: the rows come from a shuffle by the keys already.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = new_path(spark, name)
    table = path.rpartition("/")[2].replace("-", "_")
    rows = df if placed else df.repartition(parts, *keys)
    rows.write.format("parquet").bucketBy(parts, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    _WRITTEN[path] = table
    out = spark.table(table)
    out._stored_at = path
    return out


def bucketed_with(df: DataFrame, name: str, keys: tuple[str, ...], *facts: Column) -> tuple[DataFrame, dict]:
    """``bucketed`` for rows that come from a shuffle by ``keys``, with aggregates from the same job."""
    seen = Observation()
    out = bucketed(df.observe(seen, *facts), name, *keys, placed=True)
    return out, seen.get


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to as many tasks as there are shuffle partitions.

    Adaptive execution makes no fewer of them, so that the memory of a task is
    that of its share of the rows, and sums by these keys need no other shuffle.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _remove(spark: SparkSession, path: str) -> None:
    if table := _WRITTEN.pop(path, None):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def released(*tables: DataFrame) -> None:
    """Deletes stored tables that no result reads any more."""
    for df in tables:
        if (path := getattr(df, "_stored_at", None)) in _WRITTEN:
            _remove(df.sparkSession, path)


def clean(spark: SparkSession) -> None:
    """Deletes all that this process has stored; results that read it are then void."""
    for path in list(_WRITTEN):
        _remove(spark, path)


def rows_total() -> Column:
    return F.count(F.lit(1)).alias("n")


#: Schemes of Spark's folders that pyarrow knows by another name.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def file_system(path: str):
    """(pyarrow file system, path in it) of a path as Spark writes it."""
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if not colon:
        return fs.LocalFileSystem(), path
    if scheme == "dbfs":  # mounted on every machine
        return fs.LocalFileSystem(), "/dbfs/" + rest.lstrip("/")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")

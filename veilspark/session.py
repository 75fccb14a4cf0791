"""Shared helpers: reading tables and cutting lineage in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data folder. Only Spark's reader touches the path, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, rows: int = 16_384, by: tuple[str, ...] = ()) -> DataFrame:
    """`df` dealt evenly over tasks of at most `rows` rows, and over all cores if it has 500 rows a core; `by` keys if given.

    Spark cuts tables by bytes and never within a row group: a small file whose rows become texts is one task however many
    rows it has. Deal out keys, before what is made of them.
    """
    n = df.count()  # of a Parquet table: read from footers
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, -(-n // rows), min(cores, n // 500)), *by)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a temporary one only on a single machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="veilspark-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: computed once, and there after executors are lost."""
    spark = df.sparkSession
    path = tracked(f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_WRITTEN: list[str] = []


def tracked(path: str) -> str:
    """`path`, which `drop_written` will delete too."""
    _WRITTEN.append(path)
    return path


def drop_written(spark: SparkSession, since: int = 0, keep: int = 0) -> int:
    """Deletes the tables that `written` has made so far; call it once the results that read them are saved.

    Those before number `since` stay, and the last `keep`.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = _WRITTEN[since : len(_WRITTEN) - keep]
    del _WRITTEN[since : len(_WRITTEN) - keep]
    for p in gone:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    return len(gone)


def written_so_far() -> int:
    """How many tables `written` has made that are still there."""
    return len(_WRITTEN)

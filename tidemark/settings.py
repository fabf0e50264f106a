"""Session settings the operators read: group-size limit and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

# Rows one task may hold for one key before an operator takes its split form.
MAX_GROUP_ROWS_KEY = "spark.tidemark.maxGroupRows"
MAX_GROUP_ROWS_DEFAULT = 1_000_000

# Rows of a lookup table that may be copied to every task.
MAX_BROADCAST_ROWS_KEY = "spark.tidemark.maxBroadcastRows"
MAX_BROADCAST_ROWS_DEFAULT = 200_000

_local_folders: dict[str, str] = {}
_work_paths: dict[str, list[str]] = {}


def max_group_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(MAX_GROUP_ROWS_KEY, str(MAX_GROUP_ROWS_DEFAULT)))


def max_broadcast_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(MAX_BROADCAST_ROWS_KEY, str(MAX_BROADCAST_ROWS_DEFAULT)))


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session without the setting gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _local_folders[app]


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below this application's part of the shared folder.

    Everything an application settles lies under one folder named after it, so it can be
    removed as a whole once the application is done.
    """
    app = spark.sparkContext.applicationId
    path = f"{shared_folder(spark)}/tidemark-{app}/{name}-{uuid.uuid4().hex}"
    _work_paths.setdefault(app, []).append(path)
    return path


def work_paths(spark: SparkSession) -> list[str]:
    """The work paths handed out so far and not released."""
    return list(_work_paths.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, paths: list[str]) -> None:
    """Remove work paths that no later plan reads."""
    held = _work_paths.get(spark.sparkContext.applicationId, [])
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        if path in held:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)
            held.remove(path)


def settle_counted(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, dict]:
    """:func:`settle`, and aggregates of the rows that the write itself observes.

    The rows are counted along, and operators ask :func:`known_rows` before they measure groups.
    """
    spark, seen = df.sparkSession, Observation()
    path = work_path(spark, name)
    metrics = [value.alias(key) for key, value in measures.items()]
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *metrics).write.parquet(path)
    found = dict(seen.get)
    return counted(spark.read.schema(df.schema).parquet(path), found["rows"]), found


def counted(df: DataFrame, rows: int | None) -> DataFrame:
    """``df``, known to hold ``rows`` rows or fewer."""
    df._known_rows = rows
    return df


def known_rows(df: DataFrame) -> int | None:
    """An upper bound of the rows of ``df`` where a write observed one."""
    return vars(df).get("_known_rows")


def settle(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder, with the writer's ``options``, and read it back.

    Cuts lineage, keeps column pruning and statistics, and survives executor loss.
    Values that must not change between two uses in one plan go through here too.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)

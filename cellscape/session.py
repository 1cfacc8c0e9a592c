"""Session set-up and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "16g") -> SparkSession:
    """A single-JVM session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cellscape")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; only a local master gets a scratch folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    else:
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")


def cut_lineage(df: DataFrame, group_bytes: int | None = None) -> DataFrame:
    """Write an intermediate table to the shared checkpoint folder and continue from it.

    Lost executors do not replay what came before, later steps read only the columns they
    need, and the table's size is known when joins are planned.

    ``group_bytes`` bounds the row groups of a table whose rows are megabytes: else a task holds the first 100 rows
    when it writes, and when it reads all rows of a group, of which there can be thousands in a batch.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"
    writer = df.write
    if group_bytes:
        writer = writer.options(**{"parquet.block.size": str(group_bytes), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"})
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

"""Session settings the library relies on, and the place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and the bench; on a cluster use the session you are given."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidemark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def use_utc(spark: SparkSession) -> SparkSession:
    """Weeks are UTC weeks, so the session time zone has to be UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def keep_table(df: DataFrame) -> DataFrame:
    """Write a table below the folder the cluster names, and read it again.

    For narrow tables that several later steps read: it is made once, columns that a step does not
    need are never read, and a lost executor costs nothing.
    """
    folder = f"{_checkpoint_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def fresh_folder(spark: SparkSession) -> str:
    """A new folder below the one the cluster names, for tables and stream states that outlive a job."""
    return f"{_checkpoint_folder(spark).rstrip('/')}/work-{uuid.uuid4().hex}"


def _checkpoint_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and spark.sparkContext.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the cluster names.

    ``spark.checkpoint.dir`` is read from the session. Only where neither it nor
    a context folder is set (tests, laptops) a new local folder is made.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_checkpoint_folder(spark))
    return df.checkpoint()

"""Tables by file suffix: ``.parquet`` and ``.csv``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _kind(path: str, purpose: str) -> str:
    for kind in ("parquet", "csv"):
        if path.rstrip("/").endswith(f".{kind}"):
            return kind
    raise ValueError(f"cannot {purpose} {path}: the suffix has to be .parquet or .csv")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, in whichever file system its scheme names."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = location.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(files.exists(location))


def spread(scan: DataFrame) -> DataFrame:
    """A file scan over all cores, where it has fewer splits than cores.

    One small file is one split, and text cleaning is bound by the processor. A scan of many
    files, as on a cluster, is returned as it is. For scans only: counting the splits of a plan
    with shuffles would run it.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.isStreaming or scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read a table. Give a schema for CSV at scale: without one its types are found by a scan."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no such table: {path}")
    kind = _kind(path, "read")
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind == "parquet":
        return reader.parquet(path)
    return reader.csv(path, header=True, inferSchema=schema is None)


def save_table(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """Write a table, replacing what the path held.

    With an ``order`` the files are ranges of it one after the other, each sorted: Spark samples the ranges, no task
    sees more than its own, and readers skip files and row groups by their smallest and largest values.
    """
    kind = _kind(path, "save")
    if order:
        df = df.orderBy(*order)
    writer = df.write.mode("overwrite")
    if kind == "parquet":
        writer.parquet(path)
    else:
        writer.csv(path, header=True)

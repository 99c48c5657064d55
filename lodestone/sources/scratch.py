"""Tables that a query writes on its way: in the folder that driver and executors share, so that a lost executor costs one stage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes (as JSON) up to which a measured table is broadcast.
FEW, FEW_BYTES = 1_000_000, 64_000_000


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; a temporary folder only where none is set and one machine runs all."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(root or tempfile.mkdtemp(prefix='spark-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: computed once, its lineage cut."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where its source has fewer files than there are cores; a larger table stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def small(df: DataFrame, rows: int = FEW, most_bytes: int = FEW_BYTES) -> DataFrame:
    """df marked for a broadcast if it is found to have so few rows and bytes; else as it is, so that the join shuffles."""
    size = F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
    n, held = df.limit(rows + 1).agg(F.count("*"), F.coalesce(size, F.lit(0))).first()
    return F.broadcast(df) if n <= rows and held <= most_bytes else df


_kept: dict[tuple, str] = {}


def kept(spark: SparkSession, source: str, name: str, make: Callable[[str], None]) -> str:
    """The folder of something that `make` derives from the table at `source`, made once a session and again when the table's files change."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    at = path(source)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    about = files.getContentSummary(at)
    key = (spark.sparkContext.applicationId, source, name, about.getLength(), about.getFileCount(), files.getFileStatus(at).getModificationTime())
    folder = _kept.get(key)
    if folder is None or not path(f"{folder}/_made").getFileSystem(spark._jsc.hadoopConfiguration()).exists(path(f"{folder}/_made")):
        folder = scratch(spark, name)
        make(folder)
        path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path(f"{folder}/_made"))
        _kept[key] = folder
    return folder

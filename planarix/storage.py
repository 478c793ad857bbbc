"""Tables written to the folder all executors share, used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where none is configured and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors share: master is {master}")
        found = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete every table that this application has written to the shared folder. DataFrames over them can't be read any more."""
    _delete(spark, shared_dir(spark))


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it back; `path_of` gives the place."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table that `materialise` wrote and nothing reads any more."""
    path = getattr(df, "_shared_path", None)
    if path:
        _delete(df.sparkSession, path)


def ranged(df: DataFrame, order_by: list[str], parts: int | None = None) -> tuple[DataFrame, str]:
    """Rows in range partitions and sorted, written once with a place (partition, then row) in the column returned.

    Range bounds are sampled anew in every run of a plan, so counts and rows must come from one run.
    """
    place = "__place"
    ranged = (df.repartitionByRange(parts, *order_by) if parts else df.repartitionByRange(*order_by)).sortWithinPartitions(*order_by)
    return materialise(ranged.withColumn(place, F.monotonically_increasing_id()), "ranged"), place


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def spread(df: DataFrame) -> DataFrame:
    """Deal out rows evenly where a scan has fewer partitions than cores, as with one small file; else nothing.

    Plans with an exchange are left alone: their partitions are the session's choice, and counting
    them would run the stages below.
    """
    plan = df._jdf.queryExecution().executedPlan().toString()
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if "Exchange" in plan or df.rdd.getNumPartitions() >= cores else df.repartition(cores)

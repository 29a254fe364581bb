"""The session that the library expects, and the tables it reads."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What results depend on (the zone), and what lets one plan fit any size: sizes are measured as a query runs.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "tidewater", master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | more).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, where the cluster names one; a temporary one only if everything runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
    return f"{named}/tidewater-{uuid.uuid4().hex}" if named else tempfile.mkdtemp(prefix="tidewater-")


def settled(rows: DataFrame) -> DataFrame:
    """``rows`` written to a shared folder and read again: what is asked of them more than once is worked out once. The folder goes when the driver ends."""
    spark = rows.sparkSession
    path = f"{folder(spark)}/rows"
    rows.write.parquet(path)
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)
    return spark.read.schema(rows.schema).parquet(path)


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` dealt out by ``by`` to as many tasks as shuffles have: for work that is large where its rows are small, which sizes in bytes leave to a few tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)

"""Tables whose every write is a folder of its own, with a log of those that hold: rewritten as a whole, or added to."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class VersionedTable:
    """A table under ``path``: versions as Parquet, and a log whose rows say which versions hold: the last whole one, and what was added after it.

    A writer adds its version and then one row of the log; a job that dies in between changes nothing. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _log(self) -> DataFrame | None:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        there = hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
        return self.spark.read.schema("number long, version string, more boolean").json(f"{self.path}/log") if there else None

    def current(self) -> tuple[int, list[str]] | None:
        """The last write's number, and the versions that hold."""
        log = self._log()
        rows = sorted(log.collect()) if log is not None else []  # a row for each write
        whole = max((i for i, r in enumerate(rows) if not r.more), default=0)
        return (rows[-1].number, [r.version for r in rows[whole:]]) if rows else None

    def read(self) -> DataFrame | None:
        now = self.current()
        return self.spark.read.parquet(*[f"{self.path}/{x}" for x in now[1]]) if now else None

    def overwrite(self, rows: DataFrame, *partition_by: str) -> int:
        return self._write(rows, partition_by, False)

    def append(self, rows: DataFrame, *partition_by: str) -> int:
        """Adds ``rows``; what is there isn't read or written again."""
        return self._write(rows, partition_by, True)

    def compacted(self, most: int = 64) -> bool:
        """Writes the table as one version if over ``most`` hold; whether it did. What a stream adds in small parts is gathered up this way."""
        now = self.current()
        if not now or len(now[1]) <= most:
            return False
        self.overwrite(self.read())
        return True

    def _write(self, rows: DataFrame, partition_by: tuple[str, ...], more: bool) -> int:
        now = self.current()
        number, version = (now[0] + 1 if now else 1), f"v-{uuid.uuid4().hex}"
        rows.write.partitionBy(*partition_by).parquet(f"{self.path}/{version}")
        self.spark.createDataFrame([(number, version, more)], "number long, version string, more boolean").coalesce(1).write.mode("append").json(f"{self.path}/log")
        return number


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(file, length, sha256) of whole files, by which an upload is known again."""
    found = spark.read.format("binaryFile").load(path)
    return found.select(F.col("path").alias("file"), "length", F.sha2("content", 256).alias("sha256"))


def labels(spark: SparkSession, path: str) -> DataFrame:
    """Labelled events of JSON files: id, kind, occurred_at, occurred_at_precision, title, must_mention, source_line_numbers."""
    schema = "id string, kind string, occurred_at timestamp, occurred_at_precision string, title string, must_mention array<string>, source_line_numbers array<int>"
    return spark.read.schema(schema).json(path, multiLine=True)


def lines_of_messages(lines: DataFrame) -> DataFrame:
    """(file, line, source_ordinal): the message that each line of an export belongs to. ``lines`` as parsing gives them."""
    return lines.where("record > 0 and kind <> 'unparsed'").select("file", F.col("n").alias("line"), (F.col("record") - 1).cast("int").alias("source_ordinal"))


def already_imported(uploads: DataFrame, imports: DataFrame) -> DataFrame:
    """``uploads`` (tenant_id, sha256) with ``known``: whether the tenant has imported the very file before."""
    held = imports.select("tenant_id", F.col("file_sha256").alias("sha256"), F.lit(True).alias("known")).distinct()
    return uploads.join(held, ["tenant_id", "sha256"], "left").fillna({"known": False})

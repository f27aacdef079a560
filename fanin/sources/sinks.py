"""Sinks: JSON reports and memo snapshots."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def write_report_json(reports: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Row 3: one JSON object per query; non-ASCII text is written as UTF-8, not escaped.

    Files are written by the executors (no driver round trip); a new folder per
    run, partitioned by the given columns (e.g. the run date).
    """
    w = reports.write.mode("errorifexists").option("encoding", "UTF-8").option("ignoreNullFields", "false")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.json(path)


def write_report_rows(rows: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Row 3, flat form: report rows as Parquet (columnar, for analysis), a new folder per run."""
    w = rows.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_report_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_snapshot(memo: DataFrame, path: str) -> None:
    """A memo snapshot goes to a new folder; the previous one stays readable until replaced."""
    memo.write.mode("errorifexists").parquet(path)


CURRENT = "CURRENT"


def publish_snapshot(memo: DataFrame, base: str) -> str:
    """Write the memo as a new version under ``base`` and point ``base/CURRENT`` to it; returns the version's name.

    The pointer is written aside and renamed over the old one in one step, so a reader finds the old version or the
    new one, each whole.  A run that fails before leaves the pointer as it is."""
    spark, version = memo.sparkSession, f"v-{uuid.uuid4().hex}"
    write_snapshot(memo, posixpath.join(base, version))
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = lambda name: jvm.org.apache.hadoop.fs.Path(posixpath.join(base, name))
    aside = f"{CURRENT}-{version}"
    out = path(aside).getFileSystem(conf).create(path(aside), True)
    try:
        out.write(version.encode())
    finally:
        out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(aside).toUri(), conf).rename(path(aside), path(CURRENT), how)
    return version


def current_snapshot(spark: SparkSession, base: str, schema: T.StructType) -> DataFrame:
    """The memo version that ``base/CURRENT`` names, or an empty memo where nothing was published yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(posixpath.join(base, CURRENT))
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    version = spark.read.text(posixpath.join(base, CURRENT)).first()[0]
    return spark.read.schema(schema).parquet(posixpath.join(base, version))

"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# What every operator assumes; set per session, so a cluster default cannot change results.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Parquet times become instants at the scan, so that filters on them are pushed down without a cast in between.
    "spark.sql.parquet.inferTimestampNTZ.enabled": "false",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which every executor can reach.

    Where that setting is absent, a local master gets one temporary folder per application, which goes with the process; any other
    master is an error, as its executors could not see such a folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="weirflow-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        base = _own[app]
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"


def delete_dir(spark: SparkSession, path: str) -> None:
    """Remove one of our own staging folders through the Hadoop file system."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def touch(spark: SparkSession, path: str) -> None:
    """An empty file, through the Hadoop file system."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).create(hadoop, True).close()


def move_dir(spark: SparkSession, source: str, target: str) -> None:
    """Put a folder in the place of another, which may be absent."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    here, there = hadoop(source), hadoop(target)
    files = there.getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(there, True)
    files.mkdirs(there.getParent())
    if not files.rename(here, there):
        raise OSError(f"could not move {source} to {target}")


def leaf_folders(spark: SparkSession, path: str, depth: int) -> list[str]:
    """The folders ``depth`` levels below ``path``, relative to it."""
    names = [""]
    for _ in range(depth):
        names = [f"{n}/{f.rpartition('/')[2]}" for n in names for f in subfolders(spark, path + n) if "=" in f.rpartition("/")[2]]
    return names


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """The folders in a folder, none if it doesn't exist."""
    if not path_exists(spark, path):
        return []
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop)
    return sorted(f.getPath().toString() for f in found if f.isDirectory())


def is_directory(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()


def local_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A parameter table as a local relation. Catalyst knows its true size, so it is broadcast because it is small
    and for no other reason: a larger table from elsewhere takes the shuffle join instead."""
    schema = to_arrow_schema(T.StructType.fromDDL(ddl))
    columns = zip(*rows) if rows else [[] for _ in schema]
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema))

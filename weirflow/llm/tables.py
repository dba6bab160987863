"""What the operators of this subpackage share: reading tables, tables in the shared folder, texts without nulls."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import weirflow
from weirflow import session

#: Rows and bytes of one Arrow batch: what a Python worker holds at once beside one text.
BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(weirflow.__file__).parent
        folder = tempfile.mkdtemp(prefix="weirflow-")  # on the driver, which serves the file to the executors
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        target = Path(folder) / "weirflow.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        context.addPyFile(str(target))
        _shipped.add(context.applicationId)


def prepare(spark: SparkSession) -> SparkSession:
    """To be called once before the operators of this subpackage."""
    session.tune(spark)
    ship(spark)
    for key, value in BATCH.items():
        spark.conf.set(key, value)
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole(column: str | Column) -> Column:
    """A text; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def keep(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, cut off from its lineage, safe from lost executors."""
    spark = df.sparkSession
    path = session.shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def steps(spark: SparkSession, purpose: str) -> Iterator["Steps"]:
    """Tables of a computation. All are deleted at the end but those that are held for the result, which reads them later."""
    made = Steps(spark, purpose)
    try:
        yield made
    finally:
        made.clear()


class Steps:
    def __init__(self, spark: SparkSession, purpose: str) -> None:
        self.spark, self.purpose, self.paths = spark, purpose, []

    def save(self, df: DataFrame, hold: bool = False) -> DataFrame:
        path = session.shared_dir(self.spark, self.purpose)
        df.write.parquet(path)
        if not hold:
            self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self, but: int = 1) -> None:
        """Delete all but the newest ``but`` tables."""
        old = self.paths[:-but] if but else self.paths
        self.paths = self.paths[-but:] if but else []
        for path in old:
            session.delete_dir(self.spark, path)

    def clear(self) -> None:
        self.release(0)

    def hand_over(self) -> None:
        """Leave what is there to the caller."""
        self.paths = []

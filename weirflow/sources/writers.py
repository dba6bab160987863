"""Table sinks: snapshots, partitioned tables, upserts without MERGE, expiry and JSON lines.

An upsert reads and writes only the folders that its rows fall into: the dates, and within them the buckets of the keys. It writes
their whole new content beside the table, marks it as complete, and then moves each folder into its place. It is not atomic across folders and expects one writer. A run
that dies after the mark leaves it, and the next upsert first moves what is left; one that dies earlier has changed nothing. NULL is a key and a
partition value like any other.
"""

from __future__ import annotations

import datetime
import re
import uuid
from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from weirflow.functions import ordered
from weirflow.session import delete_dir, leaf_folders, move_dir, path_exists, subfolders, touch

Unfolding = Callable[[DataFrame], DataFrame]


def write_snapshot(df: DataFrame, path: str) -> None:
    """Replace the whole table, schema included."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)


def write_partitioned(df: DataFrame, path: str, partition: str = "ingestDate", mode: str = "overwrite") -> None:
    """Write by partition. Rebalancing gives a partition few files, and splits a hot one over several tasks."""
    df.hint("rebalance", partition).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(
        partition
    ).parquet(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """One document per line; missing fields are left out."""
    df.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def merge_rows(target: DataFrame, source: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Target rows replaced or extended by source rows of the same key.

    With ``order``, the row that is newer by it stays, so an old replay cannot undo a correction.
    """
    if order is None:
        new = source.select(*[F.col(k).alias(f"_new_{k}") for k in keys])
        same = reduce(and_, (target[k].eqNullSafe(new[f"_new_{k}"]) for k in keys))
        kept = target.join(new, same, "left_anti")
        return kept.unionByName(source, allowMissingColumns=True)
    both = target.unionByName(source, allowMissingColumns=True)
    return ordered.latest_by(both, keys, [F.col(order), ordered.tie_hash(both, keys)])


def one_per_key(source: DataFrame, folders: list[str], keys: list[str], order: str | None) -> DataFrame:
    """The newest row of each key by ``order``; without an order a key with several rows is an error."""
    every = list(dict.fromkeys([*folders, *keys]))
    if order is not None:
        return ordered.latest_by(source, every, [F.col(order), ordered.tie_hash(source, every)])
    rest = [c for c in source.columns if c not in every]
    once = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit(f"{AMBIGUOUS} {keys}")).cast("int"))
    packed = source.groupBy(*every).agg(F.first(F.struct(F.lit(1).alias("_one"), *rest)).alias("_row"), once.alias("_once"))
    return packed.filter(F.col("_once").isNull()).select(*[c if c in every else F.col(f"_row.{c}") for c in source.columns])


AMBIGUOUS = "the rows to merge are not unique by"


def bucketed(source: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """The rows with the bucket of their key. Its column's name tells how many there are, so that a table can't be written with two different numbers."""
    return source.withColumn(f"{BUCKET}{buckets}", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")) if buckets > 1 else source


#: What the column and the folders of key buckets are called, before their number.
BUCKET = "bucketOf"


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table without the buckets that it is kept in."""
    rows = spark.read.parquet(path)
    return rows.drop(*[c for c in rows.columns if re.fullmatch(f"{BUCKET}[0-9]+", c)])


def upsert(
    spark: SparkSession,
    source: DataFrame,
    path: str,
    keys: list[str],
    partition: str | None = None,
    order: str | None = None,
    buckets: int = 1,
    bucket_by: list[str] | None = None,
    unfold: tuple[Unfolding, Unfolding] | None = None,
) -> list[str]:
    """Update matching rows and insert the others; create the table when it is absent. Returns the folders that were replaced.

    Key and partition must agree, which holds when the partition comes from the event time and the event time is in the key. With ``buckets``, each
    date's rows lie in that many folders by a hash of the key (or of ``bucket_by``, some of its columns), and a batch of a few keys rewrites only theirs.
    Rows with equal keys in the source: the newest by ``order`` counts; without an order they are an error.

    With ``unfold`` (and neither order nor buckets) the source is folded: it has a row for each value of the first key. The first step gives the rows of
    each partition, the second the rows of the table. Folded rows are checked, and the first rows of a table dealt out by partition, before they multiply.
    """
    if unfold and (order is not None or buckets > 1 or not partition):
        raise ValueError("folded rows go by partition, without an order or buckets")
    recover(spark, path)
    staging = f"{path.rstrip('/')}__staging/{uuid.uuid4().hex}"
    source = bucketed(source, bucket_by or keys, buckets)
    folders = [*([partition] if partition else []), *([f"{BUCKET}{buckets}"] if buckets > 1 else [])]
    exists = path_exists(spark, path)
    if unfold:
        parts = unfold[0](one_per_key(source, [], keys[:1], None))
        source = unfold[1](parts)
    try:
        # Written once: the steps below read the rows twice, and must see the same ones. The first rows of a table are the table.
        if unfold and not exists:
            write_unfolded(parts, f"{staging}/in", partition, keys[0], unfold[1])
        elif exists:
            (source if order is not None or unfold else one_per_key(source, folders, keys, order)).write.parquet(f"{staging}/in")
        else:
            write_folders(one_per_key(source, folders, keys, order), f"{staging}/in", folders)
    except Exception as error:
        delete_dir(spark, staging)
        if AMBIGUOUS in str(error):
            raise ValueError(f"{AMBIGUOUS} {keys}") from None
        raise
    if not exists:
        move_dir(spark, f"{staging}/in", f"{staging}/{MERGED}")
    else:
        new = spark.read.schema(source.schema).parquet(f"{staging}/in")
        # as many as the batch has days and buckets
        touched = [folder_of(r) for r in new.select(*folders).distinct().collect()] if folders else [""]
        known = [path + f for f in touched if path_exists(spark, path + f)]
        if known:
            old = spark.read.option("basePath", path).parquet(*known)
            old = old.withColumns({c: F.col(c).cast(source.schema[c].dataType) for c in folders})
            new = merge_rows(old, new, list(dict.fromkeys([*folders, *keys])), order)
        elif order is not None:
            new = one_per_key(new, folders, keys, order)
        write_folders(new, f"{staging}/{MERGED}", folders)
    touch(spark, f"{staging}/{COMPLETE}")
    return put_in_place(spark, staging, path, len(folders))


def folder_of(values: Row) -> str:
    """The folder that partition values lie in, below the table."""
    escaped = lambda v: "".join(f"%{ord(c):02X}" if c < " " or c in UNSAFE else c for c in str(v))
    return "".join(f"/{c}={NO_VALUE if v is None or v == '' else escaped(v)}" for c, v in values.asDict().items())


#: Characters that are percent-encoded in folder names, besides control characters.
UNSAFE = "\"#%'*/:=?\\\x7f{[]^"


def write_folders(rows: DataFrame, path: str, folders: list[str]) -> None:
    """Rows as new files, few to a folder; a large folder is split over several tasks."""
    if folders:
        rows.hint("rebalance", *folders).write.partitionBy(*folders).parquet(path)
    else:
        rows.write.parquet(path)


#: Pieces that a partition's folded rows are dealt to, open files of a task that writes unfolded ones, and bytes of a row group, which each of them may hold.
PIECES, OPEN_FILES, ROW_GROUP = 4, 64, 16 << 20


def write_unfolded(parts: DataFrame, path: str, partition: str, key: str, unfold: Unfolding) -> None:
    """Folded rows as new files, by partition: they are dealt out first and unfolded while they are written. A task keeps a file open for each of its few
    partitions, as sorting the unfolded rows by partition would cost more than all else."""
    setting, spark = "spark.sql.maxConcurrentOutputFileWriters", parts.sparkSession
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, str(OPEN_FILES))
    try:
        dealt = parts.withColumn("_piece", F.pmod(F.xxhash64(key), F.lit(PIECES))).hint("rebalance", partition, "_piece").drop("_piece")
        unfold(dealt).write.option("parquet.block.size", str(ROW_GROUP)).partitionBy(partition).parquet(path)
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)


#: Below a staging folder: the rows that replace their folders, and the mark that they are all there.
MERGED, COMPLETE = "merged", "complete"


def put_in_place(spark: SparkSession, staging: str, path: str, depth: int) -> list[str]:
    """Move completely staged folders into the table. May be repeated as often as it fails: what has moved is no longer staged."""
    done = leaf_folders(spark, f"{staging}/{MERGED}", depth) if path_exists(spark, f"{staging}/{MERGED}") else []
    for folder in done:
        move_dir(spark, f"{staging}/{MERGED}{folder}", path + folder)
    delete_dir(spark, staging)
    return done


def recover(spark: SparkSession, path: str) -> None:
    """Finish what an upsert of this table left behind: marked rows are put in their place, unmarked ones dropped."""
    for staging in subfolders(spark, f"{path.rstrip('/')}__staging"):
        if path_exists(spark, f"{staging}/{COMPLETE}"):
            depth, level = 0, f"{staging}/{MERGED}"
            while level and (below := [f for f in subfolders(spark, level) if "=" in f.rpartition("/")[2]]):
                depth, level = depth + 1, below[0]
            put_in_place(spark, staging, path, depth)
        else:
            delete_dir(spark, staging)


def expire(spark: SparkSession, path: str, partition: str, as_of: str, days: int) -> list[str]:
    """Drop date partitions older than the time to live, counted from ``as_of``; returns the dropped dates. Only the names of the
    folders are read, one per day. The newest date in the table is no clock: one device whose own is wrong would empty it."""
    today = datetime.date.fromisoformat(as_of[:10])
    dates = []
    for folder in subfolders(spark, path):
        name, _, value = folder.rpartition("/")[2].partition("=")
        # rows without a date have no age, and stay
        if name == partition and value != NO_VALUE and (today - datetime.date.fromisoformat(value)).days > days:
            delete_dir(spark, folder)
            dates.append(value)
    return dates


#: The folder name's value for a partition of NULLs.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def unexpired(df: DataFrame, ts: str, as_of: Column, days: int) -> DataFrame:
    """Rows still within the time to live."""
    return df.filter(F.col(ts) >= as_of - F.make_dt_interval(days=F.lit(days)))


def pass_through(spark: SparkSession, tables: dict[str, DataFrame], targets: dict[str, tuple[str, list[str]]]) -> list[str]:
    """Copy reference tables to their gold path; returns the names of those that are missing."""
    for name, (path, keys) in targets.items():
        if name in tables:
            upsert(spark, tables[name], path, keys)
    return [name for name in targets if name not in tables]

"""Exact deduplication by Grace hashing: deal records into buckets by a hash of their content until a bucket fits an
open-addressing table, which compares complete contents.

Three steps. Each task first collapses the copies it can see (one table per ``held`` bytes of contents), so a group that
holds a third of all rows moves as a few records per task. The records are then dealt out by content hash; the shuffle's
files are the first level of spill files. A task reads its bucket into a table of at most ``held`` bytes of distinct contents; contents
that no longer fit go, with the next bits of the hash as their bucket, to a table in the shared folder, and the next
level takes it from there. A lost executor costs a re-run of its tasks: nothing is kept on a local disk.

Contents are texts without the characters of ``DROPPED``. Of equal contents the row with the most code points in its text
stays, then that with the smallest doc_id.

Defined results: null texts count as empty, and all empty ones are equal. A null doc_id loses against any other. Rows that are alike in
doc_id and content count as separate rows of a group; ``deduplicate`` keeps one of them. Empty tables give empty results; further columns are carried by ``deduplicate`` and ignored by ``groups``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from weirflow.llm import tables

DROPPED = " \t\n\v\f\r"
#: Bytes of distinct contents that a task holds in its table.
HELD = 128 << 20
#: Seed of the hash; each level of the recursion adds its number.
SEED = 42


class Table:
    """Open addressing with linear probing; a slot holds the number of an entry, and entries compare complete contents."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.slots = np.full(1024, -1, np.int64)
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.values: list[list] = []
        self.bytes = 0

    def find(self, h: int, content: bytes) -> int:
        """The number of the entry with this content, or -1."""
        slots, size = self.slots, len(self.slots)
        at = h % size
        while (entry := int(slots[at])) >= 0:
            if self.hashes[entry] == h and self.contents[entry] == content:
                return entry
            at = (at + 1) % size
        return -1

    def add(self, h: int, content: bytes, value: list) -> None:
        if 2 * len(self.hashes) >= len(self.slots):
            self.slots = np.full(4 * len(self.slots), -1, np.int64)
            for entry, own in enumerate(self.hashes):
                self.place(own, entry)
        self.place(h, len(self.hashes))
        self.hashes.append(h)
        self.contents.append(content)
        self.values.append(value)
        self.bytes += len(content) * (2 if value[2] else 1) + 500

    def entries(self) -> Iterator[tuple[int, bytes, list]]:
        return zip(self.hashes, self.contents, self.values)

    def place(self, h: int, entry: int) -> None:
        at = h % len(self.slots)
        while self.slots[at] >= 0:
            at = (at + 1) % len(self.slots)
        self.slots[at] = entry


def better(new: list, old: list) -> bool:
    """Values start with (code points, doc_id); the longer text stays, then the smaller doc_id."""
    if new[0] != old[0]:
        return new[0] > old[0]
    return new[1] is not None and (old[1] is None or new[1] < old[1])


def merge(new: list, old: list) -> None:
    """Values are [code points, doc_id, row, size]."""
    size = new[3] + old[3]
    if better(new, old):
        old[:] = new
    old[3] = size


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def record(row_type: T.DataType) -> T.StructType:
    """What moves: either the content, or a whole row of which the content is made."""
    return T.StructType([T.StructField("bucket", T.LongType()), T.StructField("content", T.BinaryType()), T.StructField("points", T.LongType()),
                         T.StructField("doc_id", T.LongType()), T.StructField("row", row_type), T.StructField("size", T.LongType())])


def rows_out(entries: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Entries (content, then the columns of ``schema``) in batches of at most about 8 MB."""
    part: list[tuple] = []
    held = 0
    for content, *values in entries:
        part.append(values)
        held += len(content)
        if held > 8 << 20 or len(part) == 10_000:
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*part), schema)], schema=schema)
            part, held = [], 0
    if part:
        yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*part), schema)], schema=schema)


def content_of(content: bytes | None, row: dict | None) -> bytes:
    return content if content is not None else (row["text"] or "").encode().translate(None, DROPPED.encode())


def collapse(held: int, schema: pa.Schema) -> Callable:
    """Rows (content, points, doc_id, row) to records: one for all copies that the table sees before it is full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table()

        def out() -> Iterator[pa.RecordBatch]:
            yield from rows_out(((c, signed(h), None if v[2] else c, *v) for h, c, v in table.entries()), schema)
            table.clear()

        for batch in batches:
            for content, points, doc_id, row in zip(*(x.to_pylist() for x in batch.columns)):
                content = content_of(content, row)
                h = xxhash.xxh64_intdigest(content, SEED)
                value = [points, doc_id, row, 1]
                if (at := table.find(h, content)) >= 0:
                    merge(value, table.values[at])
                else:
                    table.add(h, content, value)
                    if table.bytes >= held:
                        yield from out()
        yield from out()

    return run


def settle(held: int, level: int, schema: pa.Schema) -> Callable:
    """Records of some buckets to finished groups, and to records of the next level where the table is full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table()
        for batch in batches:
            spilled = []
            for _, content, points, doc_id, row, size in zip(*(x.to_pylist() for x in batch.columns)):
                sent, value = content, [points, doc_id, row, size]
                content = content_of(content, row)
                h = xxhash.xxh64_intdigest(content, SEED)
                if (at := table.find(h, content)) >= 0:
                    merge(value, table.values[at])
                elif table.bytes < held:
                    table.add(h, content, value)
                else:
                    spilled.append((content, None, signed(xxhash.xxh64_intdigest(content, SEED + level + 1)), sent, *value))
            yield from rows_out(spilled, schema)
        yield from rows_out(((c, hashlib.sha256(c).hexdigest(), None, None, *v) for _, c, v in table.entries()), schema)

    return run


def settled(rows: DataFrame, held: int = HELD) -> DataFrame:
    """Rows (content, points, doc_id, row) to one row per group: text_sha256, points, doc_id, row, size."""
    spark = rows.sparkSession
    moved = record(rows.schema["row"].dataType)
    done = T.StructType([T.StructField("text_sha256", T.StringType()), *moved.fields])
    records = rows.mapInArrow(collapse(held // 4, to_arrow_schema(moved)), moved).repartition("bucket")
    found, level = [], 0
    while True:
        out = tables.keep(records.mapInArrow(settle(held, level, to_arrow_schema(done)), done), "exact")
        found.append(out.where("text_sha256 is not null").drop("bucket", "content"))
        left = out.where("text_sha256 is null").drop("text_sha256")
        if left.isEmpty():
            break
        # twice as many buckets as before, so that each is about half as large
        level += 1
        records = left.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")) << level, "bucket")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every


def groups(docs: DataFrame, held: int = HELD) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    text, doc_id = tables.whole("text"), F.col("doc_id").cast("bigint").alias("doc_id")
    content = F.translate(text, DROPPED, "")
    rows = docs.select(content.cast("binary").alias("content"), F.char_length(text).cast("bigint").alias("points"), doc_id,
                       F.lit(None).cast("struct<text:string>").alias("row"))
    found = settled(rows, held).select("text_sha256", F.col("doc_id").alias("keep_id"), F.col("size").alias("group_size"))
    members = docs.select(doc_id, F.sha2(content, 256).alias("text_sha256"))
    return members.join(found, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, held: int = HELD) -> DataFrame:
    """One row of each group, with all its columns. Rows travel whole, and the content is made from their text where it is compared."""
    rows = docs.select(F.lit(None).cast("binary").alias("content"), F.char_length(tables.whole("text")).cast("bigint").alias("points"),
                       F.col("doc_id").cast("bigint").alias("doc_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return settled(rows, held).select("row.*")

"""Near duplicates by SimHash: fingerprints within a few bits, found by covering locality-sensitive hashing.

A fingerprint has a bit set where more than half the hashes of a document's word shingles have it. Two fingerprints
link at ``radius`` or fewer differing bits. The candidate search misses nothing: bit i of a fingerprint gets a vector
phi(i) of radius + 1 bits, and table v (one for each vector v but zero) keeps the bits i whose phi(i) has an odd product
with v. ``radius`` differing bits give ``radius`` equations over vectors of radius + 1 bits, so some v solves them all, and in
that table the two fingerprints agree on all bits that are kept (Pagh, CoveringLSH, 2018).

Every step works on distinct fingerprints, so copies cost one row however many there are. A bucket is compared in blocks
by one task and gives a spanning forest of its links, not its pairs. A bucket of more than ``BUCKET`` fingerprints is not
compared but dealt out anew: the bits that it doesn't fix are cut into radius + 1 parts, of which two linked fingerprints
share one at least, and so on until buckets are small (r bits left means 2^r fingerprints at most).

Defined results: a null or empty text has no shingles, and its fingerprint is zero, which links like any other. Texts
with fewer words than a shingle are one shingle. Repeated rows and equal doc_ids each give a row. A null doc_id gives a row and is never the smallest
of its component unless it is alone. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from itertools import chain
from typing import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm import graph, tables

BITS = 64
SEED = 42
#: Distinct fingerprints of a bucket that are compared with each other; larger buckets are dealt out anew.
BUCKET = 4096
#: Runs up to this size are compared by shifting the whole batch.
SHORT = 24
#: Bytes of a text that are cut into words at once.
BLOCK = 1 << 20


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def masks(radius: int) -> list[int]:
    """The bits that each table keeps."""
    vectors = range(1, 1 << (radius + 1))
    phi = [1 + i % len(vectors) for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (phi[i] & v).bit_count() % 2) for v in vectors]


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in blocks. bytes.split and bytes.lower know ASCII only, which is what is asked for."""
    at = 0
    while len(text) - at > BLOCK:
        end = at + BLOCK
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        yield text[at:end].lower().split()
        at = end
    yield text[at:].lower().split()


def fingerprint(text: bytes, shingle: int) -> int:
    counts, total, tail = np.zeros(BITS, np.int64), 0, []
    for block in words_of(text):
        words = tail + block
        if len(words) < shingle:
            tail = words
            continue
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        joined, starts = b" ".join(words), np.concatenate([[0], ends[:-1]])
        pieces = zip(starts[: len(words) - shingle + 1].tolist(), (ends[shingle - 1:] - 1).tolist())
        hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in pieces), np.uint64)
        counts += bits_set(hashes)
        total += len(hashes)
        tail = words[len(words) - shingle + 1:] if shingle > 1 else []
    if not total and tail:
        counts += bits_set(np.array([xxhash.xxh64_intdigest(b" ".join(tail), SEED)], np.uint64))
        total = 1
    packed = np.packbits(2 * counts > total, bitorder="little")
    return int(packed.view("<i8")[0])


def bits_set(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    out = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at: at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        out += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fingerprint) of every row. text_hash tells rows apart that have the same id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_buffer().to_pybytes(), shingle) for x in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.int64())],
                                  names=["doc_id", "text_hash", "fingerprint"])

    text = tables.whole(text_col)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("t"))
    return rows.mapInArrow(run, "doc_id bigint, text_hash bigint, fingerprint bigint")


def parts_of(fixed: int, radius: int) -> list[int]:
    """The bits outside ``fixed``, dealt into radius + 1 parts."""
    left = [i for i in range(BITS) if not fixed >> i & 1]
    return [sum(1 << i for i in left[k:: radius + 1]) for k in range(radius + 1)]


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits. numpy counts those of the absolute value, so the difference is taken as unsigned."""
    return np.bitwise_count((x ^ y).view(np.uint64))


def long_run(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside one bucket, compared in blocks."""
    a, b = [], []
    for i in range(0, len(fp), 256):
        x, y = np.nonzero(differing(fp[i: i + 256, None], fp[None, i:]) <= radius)
        up = y > x
        a.append(x[up] + i)
        b.append(y[up] + i)
    root = graph.spanning(len(fp), np.concatenate(a), np.concatenate(b))
    off = np.nonzero(root != np.arange(len(fp)))[0]
    return fp[off], fp[root[off]]


def links_in_buckets(radius: int, limit: int):
    """Rows (bucket, fixed, fingerprint), in the order of their buckets, to links (u, v), or to rows of finer buckets."""
    names = ["u", "v", "bucket", "fixed"]

    def rows(u, v=None, bucket=None, fixed=None) -> pa.RecordBatch:
        nothing = pa.nulls(len(u), pa.int64())
        return pa.record_batch([pa.array(u, pa.int64()), *(nothing if x is None else pa.array(x, pa.int64()) for x in (v, bucket, fixed))], names=names)

    def finer(bucket: int, fixed: int, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k, part in enumerate(parts_of(fixed & ((1 << BITS) - 1), radius)):
            own = (fp & np.int64(signed(part))).tolist()
            keys = [signed(xxhash.xxh64_intdigest(b"%d,%d,%d" % (bucket, k, x), SEED)) for x in own]
            yield rows(fp, None, keys, np.full(len(fp), signed((fixed & ((1 << BITS) - 1)) | part)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3  # the last bucket so far may go on in the next batch
        over: tuple[int, int] | None = None  # a bucket that is dealt out anew
        for batch in chain(batches, [None]):
            last = batch is None
            if not last:
                new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
                if over:
                    n = int(np.searchsorted(new[0], over[0], "right"))
                    if n:
                        yield from finer(*over, new[2][:n])
                    new = [x[n:] for x in new]
                    if not len(new[0]):
                        continue
                    over = None
                held = [np.concatenate(x) for x in zip(held, new)]
            bucket, fixed, fp = held
            if not len(bucket):
                continue
            cut = np.concatenate([[0], np.nonzero(np.diff(bucket))[0] + 1, [len(bucket)]])
            if not last:
                start = cut[-2]
                if len(bucket) - start > limit and 1 << (BITS - (int(fixed[start]) & ((1 << BITS) - 1)).bit_count()) > limit:
                    over = (int(bucket[start]), int(fixed[start]))
                    yield from finer(*over, fp[start:])
                    held = [np.empty(0, np.int64)] * 3
                else:
                    held = [x[start:] for x in held]
                bucket, fixed, fp, cut = bucket[:start], fixed[:start], fp[:start], cut[:-1]
            size = np.diff(cut)
            short = np.repeat(size <= SHORT, size)
            a, b = [], []
            for d in range(1, min(SHORT, int(size.max(initial=0)))):
                same = (bucket[d:] == bucket[:-d]) & short[d:]
                at = np.nonzero(same)[0]
                at = at[differing(fp[at], fp[at + d]) <= radius]
                a.append(fp[at])
                b.append(fp[at + d])
            for k in np.nonzero(size > SHORT)[0]:
                own = slice(cut[k], cut[k + 1])
                free = BITS - (int(fixed[cut[k]]) & ((1 << BITS) - 1)).bit_count()
                if size[k] > limit and 1 << free > limit:
                    yield from finer(int(bucket[cut[k]]), int(fixed[cut[k]]), fp[own])
                else:
                    x, y = long_run(fp[own], radius)
                    a.append(x)
                    b.append(y)
            if a and sum(map(len, a)):
                x, y = graph.stars(np.concatenate(a), np.concatenate(b))
                yield rows(x, y)

    return run


def links(distinct: DataFrame, radius: int = 3, limit: int = BUCKET) -> DataFrame:
    """Links (u, v) that connect exactly what pairs of fingerprints within ``radius`` bits connect."""
    spark = distinct.sparkSession
    schema = "u bigint, v bigint, bucket bigint, fixed bigint"
    own = [F.struct(F.xxhash64(F.lit(k), F.col("fingerprint").bitwiseAND(F.lit(signed(m)))).alias("bucket"), F.lit(signed(m)).alias("fixed"))
           for k, m in enumerate(masks(radius))]
    rows = distinct.select("fingerprint", F.explode(F.array(*own)).alias("x")).select("x.bucket", "x.fixed", "fingerprint")
    found = []
    while True:
        dealt = rows.repartition("bucket").sortWithinPartitions("bucket")
        out = tables.keep(dealt.mapInArrow(links_in_buckets(radius, limit), schema), "simhash-links")
        found.append(out.where("v is not null").select("u", "v"))
        rows = out.where("bucket is not null").select("bucket", "fixed", F.col("u").alias("fingerprint"))
        if rows.isEmpty():
            break
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every


def groups(docs: DataFrame, shingle: int = 3, radius: int = 3, limit: int = BUCKET) -> DataFrame:
    """(doc_id, text_hash, fingerprint, component_id, kept) of every row; kept is true for one row of each component."""
    rows = tables.keep(fingerprints(docs, shingle), "simhash-rows")
    first = rows.groupBy("fingerprint").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first"))
    found = graph.components(links(first.select("fingerprint"), radius, limit))
    rooted = first.join(found, first.fingerprint == found.node, "left").select(
        "fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    best = rooted.groupBy("root").agg(F.min("first").alias("best"))
    named = rooted.join(best, "root").select("fingerprint", "best")
    return rows.join(named, "fingerprint").select(
        "doc_id", "text_hash", "fingerprint", F.col("best.doc_id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash"))).alias("kept"))


def deduplicate(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """The rows of ``docs``, one of each component, with their columns. Rows that are alike in id and text all stay or all go."""
    gone = groups(docs, shingle, radius).where("not kept").select(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_text")).distinct()
    gone = tables.keep(gone, "simhash-gone")
    same = docs["doc_id"].cast("bigint").eqNullSafe(gone["_gone_id"]) & (F.xxhash64(tables.whole(docs["text"])) == gone["_gone_text"])
    return docs.join(gone, same, "left_anti")

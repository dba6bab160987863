"""Near duplicates among vectors: coarse inverted lists, product-quantised residuals, exact cosines.

Vectors are compared when their labels (and lengths) are equal. A coarse quantiser and the codebooks of the residuals' subspaces are fitted on a bounded
sample; every vector is then filed in the list of its nearest centroid, with one byte per subspace. A vector's distance to the border between its own
cell and that of centroid c is (d(x, c)^2 - d(x, own)^2) / (2 |c - own|). Two neighbours in different cells lie on both sides of the border between them, so
their distances to it add up to no more than their own, and one of the two is within ``REACH``, half of what the cosine allows. Each vector
probes the lists whose borders are that near, which misses no link. A member knows which lists it probes: a link that only the query's side
finds counts for both ends, one that both sides find for each end once. In a list, distances between a query and the
codes come from table lookups; a code's own error is stored with it, so a candidate is dropped only where the triangle inequality rules it
out. The rest get the exact cosine in double precision.

Vectors with equal components are one class, which is compared once and counts as often as it has members. A list is cut into
blocks of ``BLOCK`` members and ``BLOCK`` queries, so a crowded list is work for many tasks; a block gives the number of links of each query and a
spanning forest of the links, never its pairs. Vectors move in the precision that they are given in and are normalised where they are compared; a query brings no
codes, which only members have.

Defined results: null and zero vectors, and such with null, NaN or infinite components, link with nothing, and so does any vector without a label. Repeated
vec_ids each give a row. A vector with a null vec_id links and counts like any other, but names a component only if it has no other name: where all ids of a component are
null, component_id is null. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.llm import graph, tables

#: Vectors that the quantisers are fitted on, the first by a hash: ``FIT`` for each list, between these bounds.
FIT, SAMPLE = 8, (20_000, 200_000)
#: Classes per list and query, by which the number of lists grows as the root of the number of classes, up to what the sample can fit.
SPREAD = 8
SUBSPACES, CODES = 8, 64
ROUNDS = 8
BLOCK = 2048
#: Share of the allowed distance from a border within which a list is probed. Half misses nothing, as one of two neighbours is that near.
REACH = 0.5
#: Rounding of distances, which are differences of squares.
SLACK = 1e-8


def usable() -> Column:
    v = F.col("v")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & F.col("label").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))


def k_means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ROUNDS):
        near = nearest(x, centres)
        n = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :], 0)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([squared(x[i: i + 4096], centres).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.empty(0, np.int64)


@dataclass
class Model:
    dims: int
    centres: np.ndarray  #: (lists, dims)
    apart: np.ndarray  #: distances between centres
    cuts: list[slice]  #: subspaces
    books: list[np.ndarray]  #: for each subspace, (codes, its dims)
    radius: float  #: of linked unit vectors

    def file(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lists, codes and errors of unit vectors."""
        own = nearest(x, self.centres)
        rest = x - self.centres[own]
        codes = np.stack([nearest(rest[:, c], b) for c, b in zip(self.cuts, self.books)], 1).astype(np.uint8)
        guess = np.hstack([b[codes[:, j]] for j, b in enumerate(self.books)])
        return own, codes, np.linalg.norm(rest - guess, axis=1)

    def probes(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists that vectors ask, as (place of the vector, list), by vector."""
        found = []
        for at in range(0, len(x), 256):
            part = slice(at, at + 256)
            d, home = squared(x[part], self.centres), own[part]
            here = np.arange(len(home))
            ask = d - d[here, home][:, None] <= 2 * self.apart[home] * REACH * self.radius + SLACK
            ask[here, home] = True
            who, where = np.nonzero(ask)
            found.append((who + at, where))
        return tuple(np.concatenate(v) for v in zip(*found)) if found else (np.empty(0, np.int64),) * 2


def lists_for(n: int) -> int:
    """Lists for ``n`` classes."""
    return max(1, min(round(np.sqrt(n) / SPREAD), SAMPLE[1] // FIT))


def fit(sample: np.ndarray, n: int, cosine: float) -> Model:
    rng = np.random.default_rng(11)
    dims = sample.shape[1]
    centres = k_means(sample, min(lists_for(n), max(1, len(sample) // FIT)), rng)
    rest = sample - centres[nearest(sample, centres)]
    edges = np.linspace(0, dims, min(SUBSPACES, dims) + 1).astype(int)
    cuts = [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]
    books = [k_means(rest[:, c], CODES, rng) for c in cuts]
    return Model(dims, centres, np.sqrt(squared(centres, centres)), cuts, books, float(np.sqrt(max(0.0, 2 - 2 * cosine))) * (1 + 1e-9))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Raw components in double precision, shorter vectors filled with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(lengths) and (lengths == dims).all():
        return flat.reshape(len(lengths), dims)
    out = np.zeros((len(lengths), dims))
    starts = np.concatenate([[0], np.cumsum(lengths)])
    for i, n in enumerate(lengths):
        out[i, :n] = flat[starts[i]: starts[i] + n]
    return out


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def filed_schema(vector: str) -> str:
    """``home`` is the list that a row's class is filed in. ``asks``: of a member, the lists that it asks, four bytes each."""
    return f"part string, list int, query boolean, class_id bigint, size bigint, v {vector}, codes binary, error float, home int, asks binary"


def filed(model_of) -> object:
    """Classes to one row as a member of their list, and one as a query for each list that they ask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of.value
        for batch in batches:
            x = unit(matrix(batch.column(3), model.dims))
            own, codes, error = model.file(x)
            who, where = model.probes(x, own)
            per = np.split(where.astype(np.int32), np.cumsum(np.bincount(who, minlength=len(x)))[:-1])
            # an error that is rounded up rules out no more than the true one
            error = np.nextafter(error.astype(np.float32), np.float32(np.inf))
            at = np.concatenate([np.arange(len(x)), who])
            lists, none = np.concatenate([own, where]), [b""] * len(who)
            taken = pa.array(at)
            yield pa.record_batch([
                batch.column(0).take(taken), pa.array(lists, pa.int32()), pa.array(np.arange(len(at)) >= len(x)),
                batch.column(1).take(taken), batch.column(2).take(taken), batch.column(3).take(taken),
                pa.array([*(c.tobytes() for c in codes), *none], pa.binary()), pa.array(np.concatenate([error, np.zeros(len(who), np.float32)])),
                pa.array(own[at], pa.int32()), pa.array([*(p.tobytes() for p in per), *none], pa.binary())],
                names=["part", "list", "query", "class_id", "size", "v", "codes", "error", "home", "asks"])

    return run


def counted(model_of) -> object:
    """Classes to the members and queries of each list, by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of.value
        for batch in batches:
            x = unit(matrix(batch.column(1), model.dims))
            own = nearest(x, model.centres)
            who, where = model.probes(x, own)
            parts, number = np.unique(np.array(batch.column(0).to_pylist()), return_inverse=True)
            lists = len(model.centres)
            members = np.bincount(number * lists + own, minlength=len(parts) * lists)
            queries = np.bincount(number[who] * lists + where, minlength=len(parts) * lists)
            some = np.nonzero(members + queries)[0]
            yield pa.record_batch([pa.array(parts[some // lists], pa.string()), pa.array(some % lists, pa.int32()), pa.array(members[some]), pa.array(queries[some])],
                                  names=["part", "list", "members", "queries"])

    return run


class Block:
    """Members of (a part of) one list; queries are compared with them as they come."""

    def __init__(self, model: Model, centre: np.ndarray, ids: np.ndarray, sizes: np.ndarray, x: np.ndarray, codes: np.ndarray, error: np.ndarray, asks: np.ndarray) -> None:
        self.model, self.centre, self.ids, self.sizes, self.x, self.codes, self.error = model, centre, ids, sizes, x, codes, error
        #: (member, list that it asks) as one number, ascending
        self.asks = asks

    def compare(self, ids: np.ndarray, sizes: np.ndarray, x: np.ndarray, home: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Links of each query, links of each member that doesn't ask the query's list (either counts the other end by its size), and the links as pairs of positions."""
        # squared distances to the codes, by lookup
        rest, far = x - self.centre, np.zeros((len(x), len(self.ids)))
        for j, (cut, book) in enumerate(zip(self.model.cuts, self.model.books)):
            far += squared(rest[:, cut], book)[:, self.codes[:, j]]
        near = np.sqrt(far) <= self.model.radius + self.error[None, :] + 1e-9
        near &= ids[:, None] != self.ids[None, :]
        q, m = np.nonzero(near)
        close = np.empty(len(q), bool)
        for i in range(0, len(q), 1 << 16):
            part = slice(i, i + (1 << 16))
            close[part] = np.einsum("ij,ij->i", x[q[part]], self.x[m[part]]) >= cosine
        q, m = q[close], m[close]
        silent = ~np.isin(m * len(self.model.centres) + home[q], self.asks)
        return (np.bincount(q, self.sizes[m], len(ids)).astype(np.int64), np.bincount(m[silent], sizes[q[silent]], len(self.ids)).astype(np.int64), q, m)


def compared(model_of, cosine: float) -> object:
    """Rows in the order of their blocks, members first, to (class_id, links, null) and links (class_id, null, other)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = model_of.value
        key, held, block = None, [], None

        def out(ids: np.ndarray, n: np.ndarray | None, other: np.ndarray | None) -> pa.RecordBatch:
            nothing = pa.nulls(len(ids), pa.int64())
            return pa.record_batch([pa.array(ids, pa.int64()), nothing if n is None else pa.array(n, pa.int64()), nothing if other is None else pa.array(other, pa.int64())],
                                   names=["class_id", "links", "other"])

        for batch in batches:
            parts, lists, blocks = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            query = batch.column(3).to_numpy(zero_copy_only=False)
            ids, sizes = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            x = unit(matrix(batch.column(6), model.dims))
            codes = batch.column(7).to_pylist()
            error, home, asks = batch.column(8).to_numpy().astype(float), batch.column(9).to_numpy(), batch.column(10).to_pylist()
            keys = list(zip(parts, lists, blocks))
            edges = [0, *(i for i in range(1, len(ids)) if keys[i] != keys[i - 1] or query[i] != query[i - 1]), len(ids)]
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                if keys[a] != key:
                    key, held, block = keys[a], [], None
                if not query[a]:
                    own = np.frombuffer(b"".join(codes[a:b]), np.uint8).reshape(b - a, -1)
                    before = sum(len(h[0]) for h in held)
                    asked = [(before + i) * len(model.centres) + np.frombuffer(asks[a + i], np.int32).astype(np.int64) for i in range(b - a)]
                    held.append([*(v[a:b] for v in (ids, sizes, x)), own, error[a:b], np.concatenate(asked)])
                    continue
                if not held:
                    continue
                if block is None:
                    block = Block(model, model.centres[key[1]], *(np.concatenate(v) for v in zip(*held)))
                for i in range(a, b, 512):
                    own = slice(i, min(b, i + 512))
                    n, back, q, m = block.compare(ids[own], sizes[own], x[own], home[own], cosine)
                    if len(q):
                        for ends, links in ((ids[own], n), (block.ids, back)):
                            hit = links > 0
                            yield out(ends[hit], links[hit], None)
                        u, v = graph.stars(ids[own][q], block.ids[m])
                        yield out(u, None, v)

    return run


def linked(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    spark = vectors.sparkSession
    given = vectors.select(F.col(f"`{vector_col}`")).schema[0].dataType.simpleString()
    vector = given if given in ("array<float>", "array<double>") else "array<double>"
    rows = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), F.col(f"`{label_col}`").cast("string").alias("label"),
                          F.col(f"`{vector_col}`").cast(vector).alias("v"))
    plain = F.transform("v", lambda x: x + F.lit(0.0).cast(vector[6:-1]))  # minus zero is zero
    part = F.concat_ws(":", F.size("v").cast("string"), F.col("label"))
    keyed = rows.withColumn("ok", usable()).withColumn("key", F.when(F.col("ok"), F.sha2(F.concat_ws("|", part, F.to_json(plain)), 256)))
    with tables.steps(spark, "vectors") as made:
        # a class has a number of its own, as its members may have no id
        classes = made.save(
            keyed.where("ok").groupBy("key").agg(F.first(part).alias("part"), F.min("vec_id").alias("least"), F.count("*").alias("size"), F.first(plain).alias("v"))
            .withColumn("class_id", F.monotonically_increasing_id()))
        told = classes.agg(F.count("*"), F.max(F.size("v"))).first()
        if told[0]:
            most = int(np.clip(FIT * lists_for(told[0]), *SAMPLE))
            picked = classes.orderBy("key").limit(most).select("v").toArrow().column("v").combine_chunks()
            shared = spark.sparkContext.broadcast(fit(unit(matrix(picked, told[1])), told[0], cosine))
            found = links_of(classes, shared, cosine, made, vector)
            counts = found.where("links is not null").groupBy("class_id").agg(F.sum("links").alias("links"))
            roots = graph.components(found.where("other is not null").select("class_id", "other"))
        else:
            counts = spark.createDataFrame([], "class_id bigint, links bigint")
            roots = spark.createDataFrame([], "node bigint, root bigint")
        rooted = (classes.select("key", "class_id", "size", "least").join(counts, "class_id", "left").join(roots, F.col("class_id") == F.col("node"), "left")
                  .select("key", "least", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "class_id").alias("root")))
        rooted = made.save(rooted)
        names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        named = made.save(rooted.join(names, "root").select("key", "n_links", "component_id"), hold=True)
    alone = keyed.where("key is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    joined = keyed.where("key is not null").select("vec_id", "key").join(named, "key").select("vec_id", "n_links", "component_id")
    return joined.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def links_of(classes: DataFrame, shared, cosine: float, made: tables.Steps, vector: str, block: int = BLOCK) -> DataFrame:
    """(class_id, links, null) and (class_id, null, other) rows of all lists."""
    sizes = classes.select("part", "v").mapInArrow(counted(shared), "part string, list int, members bigint, queries bigint").groupBy("part", "list").agg(
        F.sum("members").alias("members"), F.sum("queries").alias("queries"))
    cells = made.save(sizes.select("part", "list", F.ceil(F.col("members") / block).cast("int").alias("m"), F.ceil(F.col("queries") / (4 * block)).cast("int").alias("q")))
    rows = classes.select("part", "class_id", "size", "v").mapInArrow(filed(shared), filed_schema(vector))
    # a row goes to one block of its own side for every block of the other side; a count may miss what rounding moves over a border
    own = {c: F.greatest(F.lit(1), F.coalesce(c, F.lit(1))) for c in "mq"}
    slot = lambda n: F.pmod(F.xxhash64("class_id"), own[n]).cast("int")
    grid = F.when(F.col("query"), F.transform(F.sequence(F.lit(0), own["m"] - 1), lambda i: i * own["q"] + slot("q"))).otherwise(
        F.transform(F.sequence(F.lit(0), own["q"] - 1), lambda j: slot("m") * own["q"] + j))
    dealt = rows.join(cells, ["part", "list"], "left").withColumn("block", F.explode(grid)).select(
        "part", "list", "block", "query", "class_id", "size", "v", "codes", "error", "home", "asks")
    ordered = dealt.repartition("part", "list", "block").sortWithinPartitions("part", "list", "block", "query")
    return made.save(ordered.mapInArrow(compared(shared, cosine), "class_id bigint, links bigint, other bigint"))

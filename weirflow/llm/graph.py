"""Connected components of a graph given as edges, without gathering it anywhere.

Edges are first contracted inside each task: a union-find over a bounded number of them replaces them by stars. Rounds
of large and small stars (Kiveris et al., Connected Components in MapReduce and Beyond, 2014) then join the tasks'
stars until nothing changes. A node with very many neighbours is a skewed sort-merge join, which adaptive execution
splits.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm import tables

#: Edges that a task holds at once while it contracts them.
CONTRACT = 500_000


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of ``n`` nodes reaches over the links ``a[i]``-``b[i]``."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while True:
            shorter = root[root]
            if (shorter == root).all():
                break
            root = shorter
        if (root == before).all():
            return root


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node but the smallest of its component to that smallest one."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = spanning(len(nodes), at[: len(u)], at[len(u):])
    off = root != np.arange(len(nodes))
    return nodes[off], nodes[root[off]]


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    u: list[np.ndarray] = []
    v: list[np.ndarray] = []
    held = 0

    def out() -> pa.RecordBatch:
        a, b = stars(np.concatenate(u), np.concatenate(v))
        return pa.record_batch({"u": pa.array(a, pa.int64()), "v": pa.array(b, pa.int64())})

    for batch in batches:
        u.append(batch.column(0).to_numpy(zero_copy_only=False))
        v.append(batch.column(1).to_numpy(zero_copy_only=False))
        held += batch.num_rows
        if held >= CONTRACT:
            yield out()
            u, v, held = [], [], 0
    if held:
        yield out()


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """``edges`` lead from a node to a smaller one, as large stars do."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    others = edges.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (two bigint columns) to (node, root): the smallest node of the component, for every node that has an
    edge to another one. Loops, repeated edges and either direction are welcome; edges with a null end are ignored."""
    spark = edges.sparkSession
    a, b = edges.columns
    clean = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v")
    with tables.steps(spark, "components") as made:
        now = made.save(clean.mapInArrow(contract, "u bigint, v bigint"))
        seen = None
        while True:
            told = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
            if tuple(told) == seen or not told[0]:
                break
            seen = tuple(told)
            # the stars that a task can see are merged before the next round
            now = made.save(small_star(large_star(now)).mapInArrow(contract, "u bigint, v bigint"))
            made.release(1)
        made.hand_over()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))

"""Ranked lexical search: the best documents for each stated item, by branch and bound over document FP-trees.

Terms are runs of letters and digits of ASCII and of all other characters, only A-Z lower-cased. A document's vector holds its counts of the
items' terms, ordered from the term that most documents hold to the rarest. In that order documents share paths of a
trie: sorted by their vectors, a node is a run of neighbours with a common beginning. A node keeps the largest count of each term
and the smallest length norm m below it, which together bound every score below it. An item descends depth first, best bound first, and leaves a
subtree out when its bound is below the item's k-th score so far.

The items come in blocks of ``ITEMS`` rows or ``CHARS`` characters, and each block is one pass over all documents: the terms of a block are
broadcast, which bounds what is broadcast whatever the number of items. The first job of a pass counts terms and writes the vectors, the second builds trees of at
most ``DOCS`` documents or ``POSTINGS`` counts each, and hands an item's k best of the task on. A task keeps its k best from tree to tree.

Defined results: a null or empty text has no terms, is never found and doesn't count as a document; an item without terms gives no rows. Equal scores come by ascending
doc_id, a null doc_id last; rows with equal ids are documents of their own, and rows of items with equal ids are ranked each by itself. Empty tables give
an empty result. Texts are read whole, further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirflow import session
from weirflow.llm import tables

#: Rows and characters of the items of one pass.
ITEMS, CHARS = 1000, 2 << 20
#: Documents and counts of one tree, and the documents below which a subtree isn't cut any further.
DOCS, POSTINGS, LEAF = 8192, 2 << 20, 64
#: A subtree with more than this share of its parent's documents is not bounded by itself; its children are.
NARROWER = 0.75
#: Bytes of a text that are cut into terms at once.
PIECE = 1 << 20

SEPARATORS = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
TABLE = bytes(32 if SEPARATORS.match(bytes([b])) else b + 32 if 65 <= b <= 90 else b for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, piece by piece."""
    at = 0
    while at < len(text):
        cut = SEPARATORS.search(text, at + PIECE) if len(text) - at > PIECE else None
        end = cut.start() if cut else len(text)
        yield text[at:end].translate(TABLE).split()
        at = end


class Tree:
    """A document FP-tree. Nodes are numbered; a node's ``bundle`` holds the bounds of its child nodes and the scores of its documents:
    (terms, parts, where each entry starts, child nodes, documents)."""

    def __init__(self, ids: list, m: np.ndarray, start: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        paths = [term[a:b] for a, b in zip(start[:-1], start[1:])]
        keys = [x.astype(">i4").tobytes() for x in paths]
        order = np.array(sorted(range(len(ids)), key=keys.__getitem__), np.int64)
        self.ids, self.m = [ids[i] for i in order], m[order]
        size = np.diff(start)[order]
        self.start = np.concatenate([[0], np.cumsum(size)])
        take = np.repeat(start[:-1][order] - self.start[:-1], size) + np.arange(self.start[-1])
        self.term, self.tf = term[take], tf[take].astype(np.int64)
        self.part = part(self.tf, np.repeat(self.m, size))
        shared = np.zeros(len(ids), np.int64)
        for i in range(1, len(ids)):
            a, b = paths[order[i - 1]], paths[order[i]]
            k = min(len(a), len(b))
            other = a[:k] != b[:k]
            at = int(other.argmax()) if k else 0
            shared[i] = at if k and other[at] else k
        self.bundles: list[tuple] = []
        todo = [(0, len(ids))]
        while len(self.bundles) < len(todo):
            low, high = todo[len(self.bundles)]
            nodes, alone = self.children(low, high, shared)
            first = len(todo)
            todo += nodes
            self.bundles.append(self.bundle(nodes, np.arange(first, len(todo)), alone))

    @staticmethod
    def children(low: int, high: int, shared: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
        """Subtrees of the run low..high that get a bound of their own, and the documents that hang from it directly."""
        nodes, alone, open_ = [], [], [(low, high)]
        while open_:
            a, b = open_.pop()
            inner = shared[a + 1: b]
            cuts = np.concatenate([[a], np.nonzero(inner == inner.min())[0] + a + 1, [b]]) if b - a > 1 else np.array([a, b])
            size = np.diff(cuts)
            for k in np.nonzero(size >= LEAF)[0]:
                run = (int(cuts[k]), int(cuts[k + 1]))
                (open_ if size[k] > NARROWER * (high - low) else nodes).append(run)
            small = np.nonzero(size < LEAF)[0]
            if len(small):
                alone.append(np.concatenate([np.arange(cuts[k], cuts[k + 1]) for k in small]))
        return nodes, np.concatenate(alone) if alone else np.empty(0, np.int64)

    def bundle(self, nodes: list[tuple[int, int]], numbers: np.ndarray, alone: np.ndarray) -> tuple:
        term, value, starts, n = [], [], [], 0
        for a, b in nodes:
            own = slice(self.start[a], self.start[b])
            both = np.sort(self.term[own].astype(np.int64) << 32 | np.minimum(self.tf[own], (1 << 32) - 1))
            last = np.nonzero(np.diff(both >> 32, append=-1))[0]
            term.append((both[last] >> 32).astype(np.int32))
            value.append(part(both[last] & ((1 << 32) - 1), self.m[a:b].min()))
            starts.append(n)
            n += len(last)
        size = self.start[alone + 1] - self.start[alone]
        take = np.repeat(self.start[alone] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(alone) else np.empty(0, np.int64)
        starts = np.concatenate([np.array(starts, np.int64), n + np.concatenate([[0], np.cumsum(size)[:-1]])[: len(alone)]]).astype(np.int64)
        return np.concatenate([*term, self.term[take]]), np.concatenate([*value, self.part[take]]), starts, numbers, alone

    def search(self, weight: np.ndarray, best: "Best") -> None:
        """Offer the documents that may belong to the best. ``weight`` is the item's weight of each term."""
        stack = [(best.least, 0)]  # the root has no bound: what earlier trees gave never rules a whole tree out
        while stack:
            bound, node = stack.pop()
            if bound < best.least:
                continue
            term, value, starts, nodes, alone = self.bundles[node]
            sums = np.add.reduceat(weight[term] * value, starts)
            if len(alone):
                scores = sums[len(nodes):]
                best.offer([(-int(scores[i]), self.ids[alone[i]]) for i in self.few(scores, best)])
            below = sorted((b, n) for b, n in zip(sums[: len(nodes)].tolist(), nodes.tolist()) if b >= best.least)
            stack += below

    def few(self, scores: np.ndarray, best: "Best") -> np.ndarray:
        """The places of scores that may belong to the best: all that tie with the k-th of them or lie above it."""
        if len(scores) > best.k:
            kth = np.partition(scores, len(scores) - best.k)[len(scores) - best.k]
            return np.nonzero(scores >= max(int(kth), best.least))[0]
        return np.nonzero(scores >= best.least)[0]


def part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term counts before its weight: it grows with tf and falls with m, so the largest tf and the smallest m bound it."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Best:
    """The k best of an item: pairs (negative score, doc_id). ``least`` is the score that may still belong to them."""

    def __init__(self, k: int) -> None:
        self.k, self.rows, self.least = k, [], 1

    def offer(self, rows: list[tuple]) -> None:
        if rows:
            self.rows = sorted(self.rows + rows, key=lambda x: (x[0], x[1] is None, x[1] or 0))[: self.k]
            if len(self.rows) == self.k:
                self.least = -self.rows[-1][0]


def blocks_of(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, Counter]]]:
    """(item_id, its terms) in blocks; one block at a time is on the driver."""
    block, held = [], 0
    for row in items.select(F.col(f"`{id_col}`").cast("bigint"), tables.whole(f"`{text_col}`")).toLocalIterator():
        if block and (len(block) == ITEMS or held + len(row[1]) > CHARS):
            yield block
            block, held = [], 0
        block.append((row[0], sum((Counter(x) for x in terms(row[1].encode())), Counter())))
        held += len(row[1])
    if block:
        yield block


def vectors(docs: DataFrame, words: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, tfs) of each document: all its terms counted, and the counts of those that are in ``words``."""
    shared = docs.sparkSession.sparkContext.broadcast(words)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: i for i, w in enumerate(shared.value)}.get
        for batch in batches:
            n, found = [], []
            for text in batch.column(1):
                counts, total = Counter(), 0
                for piece in terms(text.as_buffer().to_pybytes()):
                    counts.update(map(number, piece))
                    total += len(piece)
                counts.pop(None, None)
                n.append(total)
                found.append(counts)
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array([list(x) for x in found], schema.field("terms").type),
                                   pa.array([list(x.values()) for x in found], schema.field("tfs").type)], schema=schema)

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), tables.whole(f"`{text_col}`").cast("binary").alias("t"))
    return rows.mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>")


def searched(found: DataFrame, block: list[tuple[int, Counter]], words: list[bytes], k: int, first: int) -> DataFrame:
    """(item, item_id, doc_id, score): each task's k best for each item of the block."""
    sums = found.where("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = sums["docs"], sums["terms"] or 1
    counts = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toArrow()
    df = np.zeros(len(words), np.int64)
    df[counts.column("term").to_numpy()] = counts.column("df").to_numpy()
    rank = np.empty(len(words), np.int32)
    rank[np.argsort(-df, kind="stable")] = np.arange(len(words), dtype=np.int32)
    number = {w: i for i, w in enumerate(words)}
    stated = []
    for i, (item_id, own) in enumerate(block):
        at = [number[w] for w in own]
        weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df[x]) + 1))) * q for x, q in zip(at, own.values())]
        stated.append((first + i, item_id, rank[at], np.array(weight, np.int64)))
    shared = found.sparkSession.sparkContext.broadcast((rank, stated))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, stated = shared.value
        best = [Best(k) for _ in stated]
        weight = np.zeros(len(rank) + 1, np.int64)

        def settle(ids: list, n: list, term: list, tf: list) -> None:
            size = np.array([len(x) for x in term])
            term, tf = rank[np.concatenate(term)], np.concatenate(tf)
            owner = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((term, owner))
            m = np.array([100 - 25 + 25 * x * n_docs // n_terms for x in n], np.int64)
            tree = Tree(ids, m, np.concatenate([[0], np.cumsum(size)]), term[order], tf[order])
            for (_, _, at, own), top in zip(stated, best):
                weight[at] = own
                tree.search(weight, top)
                weight[at] = 0

        held, postings = ([], [], [], []), 0
        for batch in batches:
            for i, (doc_id, n) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist())):
                own = batch.column("terms")[i].values.to_numpy(zero_copy_only=False)
                if len(own):
                    for x, to in zip((doc_id, n, own, batch.column("tfs")[i].values.to_numpy(zero_copy_only=False)), held):
                        to.append(x)
                    postings += len(own)
                    if len(held[0]) == DOCS or postings >= POSTINGS:
                        settle(*held)
                        held, postings = ([], [], [], []), 0
        if held[0]:
            settle(*held)
        rows = [(no, item_id, doc_id, -score) for (no, item_id, _, _), top in zip(stated, best) for score, doc_id in top.rows]
        if rows:
            yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*rows)], names=["item", "item_id", "doc_id", "score"])

    return found.select("doc_id", "n", "terms", "tfs").mapInArrow(run, "item bigint, item_id bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item with a score above zero."""
    spark = docs.sparkSession
    schema = "item_id bigint, rank int, doc_id bigint, score bigint"
    path, first = session.shared_dir(spark, "lexical-best"), 0
    spark.createDataFrame([], schema).write.parquet(path)
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    for block in blocks_of(items, item_id, item_text):
        words = sorted({w for _, own in block for w in own})
        with tables.steps(spark, "lexical") as made:
            found = made.save(vectors(docs, words, doc_id, doc_text))
            ranked = searched(found, block, words, k, first).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            ranked.select("item_id", "rank", "doc_id", "score").write.mode("append").parquet(path)
        first += len(block)
    return spark.read.schema(schema).parquet(path)

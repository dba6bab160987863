"""A Merkle manifest of a dataset: a tree of SHA-256 states, proofs for each row, and folding that resumes a state.

Each row is a leaf: H of its fields, each ``-`` if null, else its count of UTF-8 bytes, ``:`` and its value (H: lowercase hex SHA-256 of
the inputs one after the other, digests as hex text). Within a group (the source) leaves ascend by id; while more than one node
remains, every ``FANOUT`` consecutive ones become their H. The subroots of the groups, in the groups' order, give the root likewise.

A parent keeps a copy of its hash state from before each child's slot. To fold a changed child into its parent, the state of its slot
is resumed with the replacement and the siblings to its right; those to the left are not hashed again.

Rows are numbered by a distributed sort: range partitions, a count for each group and partition, and running totals over those
counts. Runs of ``SPAN`` consecutive nodes make one block row, in which a task grows ``LEVELS`` levels; the blocks' digests are
the nodes of the next round, and so on until each group has one. Then the siblings of each block are handed down round by round, and one pass
over the leaf blocks gives every proof and fold. A group that holds most rows is many blocks like any other.

Defined results: a null id sorts first, a null group is a group of its own and the first one. Rows that are alike in all fields are leaves of their own,
next to each other; rows with equal ids are ordered by their leaves. A group of one leaf has that leaf as its subroot. Texts are hashed whole, the
empty one as ``0:``. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.llm import tables

FANOUT = 16
#: Levels that a task grows over one block, and the nodes of a block.
LEVELS = 3
SPAN = FANOUT ** LEVELS
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NODE = "struct<at:bigint,node:binary,doc_id:bigint,changed:binary>"
BLOCK = f"key string, block bigint, total bigint, nodes array<{NODE}>, digest binary"
PATH = "array<struct<left:string,right:string>>"


class Slot:
    """A child's place in its parent: the parent's hash state before it, and the child's siblings."""

    __slots__ = ("state", "others", "left", "folded")

    def __init__(self, state, others: bytes, left: int) -> None:
        self.state, self.others, self.left, self.folded = state, others, left, {}

    def fold(self, child: bytes) -> bytes:
        """The parent's digest with ``child`` in this slot. Children that are alike are folded once."""
        if child not in self.folded:
            state = self.state.copy()
            state.update(child)
            state.update(self.others[self.left:])
            self.folded[child] = state.hexdigest().encode()
        return self.folded[child]


def parent(children: list[bytes]) -> tuple[list[Slot], bytes]:
    """The slots of a parent and its digest."""
    slots, state, text = [], hashlib.sha256(), b"".join(children)
    for i, child in enumerate(children):
        slots.append(Slot(state.copy(), text[: 64 * i] + text[64 * i + 64:], 64 * i))
        state.update(child)
    return slots, state.hexdigest().encode()


def above(nodes: list[bytes]) -> list[bytes]:
    return [hashlib.sha256(b"".join(nodes[i: i + FANOUT])).hexdigest().encode() for i in range(0, len(nodes), FANOUT)]


def height(total: int) -> int:
    """Levels to grow over a block, in a group of ``total`` nodes."""
    levels = 0
    while total > 1 and levels < LEVELS:
        total, levels = -(-total // FANOUT), levels + 1
    return levels


def grown(nodes: list[bytes], total: int) -> list[list[Slot]]:
    """The levels over a block's nodes: for each, the slots of the nodes below it."""
    levels = []
    for _ in range(height(total)):
        runs = [parent(nodes[i: i + FANOUT]) for i in range(0, len(nodes), FANOUT)]
        levels.append([slot for slots, _ in runs for slot in slots])
        nodes = [digest for _, digest in runs]
    return levels


def way(levels: list[list[Slot]], i: int) -> list[Slot]:
    """The slots from node i of a block up to its top."""
    return [slots[i // FANOUT ** k] for k, slots in enumerate(levels)]


def hexes(nodes: pa.StructScalar | pa.ListScalar) -> list[bytes]:
    return [x.hex().encode() for x in nodes.values.field("node").to_pylist()]


def with_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (key, block, total, nodes) with the digest on top of each."""
    for batch in batches:
        tops = []
        for nodes, total in zip(batch.column("nodes"), batch.column("total").to_pylist()):
            level = hexes(nodes)
            for _ in range(height(total)):
                level = above(level)
            tops.append(bytes.fromhex(level[0].decode()))
        yield pa.record_batch([*batch.columns, pa.array(tops, pa.binary())], names=[*batch.schema.names, "digest"])


STEP = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def handed_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with their paths to the paths of their nodes: the siblings at each level, and then those of the block."""
    for batch in batches:
        for key, total, nodes, path in zip(*(batch.column(x) for x in ("key", "total", "nodes", "path"))):
            levels, at, path = grown(hexes(nodes), total.as_py()), nodes.values.field("at"), path.as_py()
            for start in range(0, len(at), 256):
                part = range(start, min(start + 256, len(at)))
                own = [[{"left": s.others[: s.left].decode(), "right": s.others[s.left:].decode()} for s in way(levels, i)] + path for i in part]
                yield pa.record_batch([pa.array([key.as_py()] * len(own), pa.string()), at.slice(start, len(own)), pa.array(own, STEP)], names=["key", "at", "path"])


def folds(root: str, proofs: bool):
    """Leaf blocks with their paths to the result rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for total, nodes, path, subroot in zip(*(batch.column(x) for x in ("total", "nodes", "path", "subroot"))):
                leaves = hexes(nodes)
                changed = nodes.values.field("changed").to_pylist()
                levels = grown(leaves, total.as_py())
                upper = [Slot(hashlib.sha256(x["left"].encode()), (x["left"] + x["right"]).encode(), len(x["left"])) for x in path.as_py()]
                rest = b"".join(x.others for x in upper)
                proof, folded, whole = [], [], []
                for i, leaf in enumerate(leaves):
                    own = way(levels, i)
                    text = b"".join([x.others for x in own] + [rest])
                    proof.append(hashlib.sha256(text).hexdigest())
                    node = leaf if changed[i] is None else changed[i].hex().encode()
                    for slot in (*own, *upper):
                        node = slot.fold(node)
                    folded.append(node.decode())
                    if proofs:
                        whole.append([x.others.decode() for x in (*own, *upper)])
                n = len(leaves)
                columns = [nodes.values.field("doc_id"), pa.array([x.decode() for x in leaves]), pa.array([subroot.as_py()] * n, pa.string()), pa.array([root] * n),
                           pa.array(proof), pa.array(folded), pa.array([x == root for x in folded])]
                names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
                if proofs:
                    columns, names = [*columns, pa.array(whole, pa.list_(pa.string()))], [*names, "proof"]
                yield pa.record_batch(columns, names=names)

    return run


def leaf_of(fields: dict[str, Column]) -> Column:
    """The leaf of a row as bytes."""
    texts = [c.cast("string") for c in fields.values()]
    parts = [F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in texts]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def leaves(docs: DataFrame, fields: tuple[str, ...], changes: dict[str, Column], where: Column, id_col: str, group_col: str) -> DataFrame:
    """(key, doc_id, node, changed, salt): the leaf of each row, and that of the row with ``changes`` where ``where`` holds."""
    own = {c: F.col(f"`{c}`") for c in fields}
    return docs.select(F.col(f"`{group_col}`").cast("string").alias("key"), F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), leaf_of(own).alias("node"),
                       F.when(where, leaf_of(own | changes)).alias("changed"), F.monotonically_increasing_id().alias("salt"))


def numbered(rows: DataFrame, order: list[str], made: tables.Steps) -> DataFrame:
    """``rows`` with ``at``, their place in the order within their key, and ``total``, the rows of the key.

    A row's mark holds its partition and its place there; so the rows of a key in a partition are consecutive marks.
    """
    marked = made.save(rows.repartitionByRange("key", *order).sortWithinPartitions("key", *order).withColumn("mark", F.monotonically_increasing_id()))
    marked = marked.withColumn("part", F.shiftright("mark", 33))
    pieces = marked.groupBy("key", "part").agg(F.min("mark").alias("first"), F.count("*").alias("n"))
    own = Window.partitionBy("key")
    before = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select(F.col("key").alias("of_key"), F.col("part").alias("of_part"),
                           (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(own).alias("total"))
    here = marked["key"].eqNullSafe(starts["of_key"]) & (marked["part"] == starts["of_part"])
    return marked.join(starts, here).withColumn("at", F.col("mark") + F.col("shift")).drop("of_key", "of_part", "shift", "mark", "part")


def rounds(rows: DataFrame, made: tables.Steps, hold_first: bool) -> list[DataFrame]:
    """Rows (key, at, total, node, doc_id, changed) to tables of blocks, from the leaves up, until each key has one node."""
    out: list[DataFrame] = []
    while True:
        nodes = F.sort_array(F.collect_list(F.struct("at", "node", "doc_id", "changed")))
        blocks = rows.groupBy("key", F.expr(f"at div {SPAN}").alias("block")).agg(F.first("total").alias("total"), nodes.alias("nodes"))
        out.append(made.save(blocks.mapInArrow(with_digest, BLOCK), hold=hold_first and not out))
        left = out[-1].where(F.col("total") > SPAN)
        if left.isEmpty():
            return out
        rows = left.select("key", F.col("block").alias("at"), F.expr(f"(total + {SPAN} - 1) div {SPAN}").alias("total"), F.col("digest").alias("node"),
                           F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("binary").alias("changed"))


def roots(blocks: list[DataFrame]) -> DataFrame:
    """(key, node): the one node that is left of each key."""
    every = [x.where(F.col("total") <= SPAN).select("key", F.col("digest").alias("node")) for x in blocks]
    out = every[0]
    for more in every[1:]:
        out = out.unionByName(more)
    return out


def with_paths(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """Blocks with the path (key, at, path) of the node that each of them is."""
    paths = paths.select(F.col("key").alias("of_key"), F.col("at").alias("of_block"), "path")
    return blocks.join(paths, blocks["key"].eqNullSafe(paths["of_key"]) & (blocks["block"] == paths["of_block"])).drop("of_key", "of_block")


def descend(blocks: list[DataFrame], start: DataFrame, made: tables.Steps) -> DataFrame:
    """The paths of the leaf blocks. ``start``: (key, path) of each key's root."""
    paths = None
    for above_leaves, level in reversed(list(enumerate(blocks))):
        done = level.where(F.col("total") <= SPAN).select(F.col("key").alias("own")).join(start, F.col("own").eqNullSafe(start["key"])).select("key", F.lit(0).cast("bigint").alias("at"), "path")
        paths = done if paths is None else done.unionByName(paths)
        if above_leaves:
            schema = f"key string, at bigint, path {PATH}"
            paths = made.save(with_paths(level, paths).select("key", "total", "nodes", "path").mapInArrow(handed_down, schema))
    return paths


def manifest(docs: DataFrame, changes: dict[str, Column], where: Column, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
             id_col: str = "doc_id", group_col: str = "source", proofs: bool = False) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256 (H of its siblings from the leaf up), folded_root and verified.

    ``folded_root`` is folded from the document as it is after ``changes`` (new values of some fields) where ``where`` holds, and the siblings
    as they were. With ``proofs`` the siblings come too, one string for each level.
    """
    spark = docs.sparkSession
    with tables.steps(spark, "merkle") as made:
        rows = made.save(leaves(docs, fields, changes, where, id_col, group_col))
        blocks = rounds(numbered(rows, ["doc_id", "node", "salt"], made), made, hold_first=True)
        subroots = made.save(roots(blocks), hold=True)
        groups = subroots.select(F.lit("").alias("key"), F.col("key").alias("name"), "node")
        groups = made.save(numbered(groups, ["name"], made))
        empty = [F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("binary").alias("changed")]
        upper = rounds(groups.select("key", "at", "total", "node", *empty), made, hold_first=False)
        root = next((x.node.hex() for x in roots(upper).limit(1).collect()), "")
        nothing = F.array().cast(PATH)
        start = spark.range(1).select(F.lit("").alias("key"), nothing.alias("path"))
        tops = with_paths(upper[0], descend(upper, start, made))
        ways = tops.select("key", "total", "nodes", "path").mapInArrow(handed_down, f"key string, at bigint, path {PATH}")
        start = made.save(groups.select("name", "at").join(ways.select("at", "path"), "at").select(F.col("name").alias("key"), "path"))
        paths = made.save(descend(blocks, start, made), hold=True)
    subroots = subroots.select(F.col("key").alias("of_key"), F.lower(F.hex("node")).alias("subroot"))
    whole = with_paths(blocks[0], paths)
    whole = whole.join(subroots, whole["key"].eqNullSafe(subroots["of_key"])).select("total", "nodes", "path", "subroot")
    schema = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return whole.mapInArrow(folds(root, proofs), schema + (", proof array<string>" if proofs else ""))


def digests(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents``; where 5 divides the crc32 of an id, the text has its capitals A-Z lowered afterwards."""
    lowered = {"text": F.translate(F.col("text"), UPPER, LOWER)}
    return manifest(docs, lowered, F.crc32(F.col("doc_id").cast("bigint").cast("string").cast("binary")) % 5 == 0)

"""Merkle manifest of a dataset: digests of all rows, a tree for each source, one root, and a proof for each row.

A row's leaf is the sha256 of its fields, each written as its length in bytes, a colon and its value (``-`` for null).
The leaves of a source stand in order of their key; runs of three become one parent, level by level, up to one subroot;
the subroots, in order of the sources (null first, bytewise), become one root in the same way.

Digests travel by time-forward processing. Nodes are labelled (level, place), so children come before parents. A block
is an aligned part of ``FANOUT ** CLIMB`` nodes of one tree. Inside a block a priority queue ordered by label delivers
the digests of children to their parent; the queue beyond the block is external: what a block's top sends to the next
block up is written, and Spark's sorted shuffle delivers it in label order. So a tree of n leaves takes one pass for
each ``CLIMB`` levels, a source with a third of all rows is many blocks, and memory is that of one block. The reversed
sweep goes down the same blocks from the root: each node gets the proof suffix of its parent, a queue in reverse order
inside a block, a first row in the sorted shuffle between blocks.

Only digests, keys and sources are shuffled, never texts. Rows of equal key are ordered by leaf; equal rows have equal
leaves and take places in any order. Null sources are one tree, null keys come first. An empty table gives an empty
one. Columns of the input other than those named are not read, so they may have any name.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from functools import partial
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import CRC32_SQL, prepare, query, save, small, table

FANOUT = 3
#: Levels that one block covers: 729 nodes.
CLIMB = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: A proof from a node upwards: digests left of it, right of it (hex text), and the proof of its parent.
Proof = tuple[str, str, "Proof"] | None
Label = tuple[int, int]


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def row_digest(*fields: Column) -> Column:
    """sha256 over the length in bytes, a colon and the value of each field; ``-`` for null."""
    told = []
    for f in fields:
        value = f.cast("string")
        told.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*told).cast("binary"), 256)


def height(nodes: int) -> int:
    """Levels above ``nodes`` nodes, up to a single one."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // FANOUT), levels + 1
    return levels


def climb(nodes: list[str], levels: int) -> tuple[str, dict[Label, list[str]]]:
    """The digest ``levels`` above a block's nodes, and the children of each node on the way, in label order."""
    queue = [(1, k // FANOUT, k % FANOUT, d) for k, d in enumerate(nodes)] if levels else []  # in order: a heap
    families: dict[Label, list[str]] = {}
    top = nodes[0]
    while queue:
        level, place = queue[0][:2]
        children = []
        while queue and queue[0][:2] == (level, place):
            children.append(heapq.heappop(queue)[3])
        families[level, place] = children
        top = digest(*children)
        if level < levels:
            heapq.heappush(queue, (level + 1, place // FANOUT, place % FANOUT, top))
    return top, families


def descend(families: dict[Label, list[str]], nodes: int, levels: int, above: Proof) -> list[Proof]:
    """The proofs of a block's nodes, from the proof of its top."""
    out: list[Proof] = [above] * nodes
    queue: list[tuple[int, int, Proof]] = [(-levels, 0, above)] if levels else []
    while queue:
        level, place, proof = heapq.heappop(queue)
        children = families[-level, -place]
        for k in range(len(children)):
            below = ("".join(children[:k]), "".join(children[k + 1 :]), proof)
            child = -place * FANOUT + k
            if level == -1:
                out[child] = below
            else:
                heapq.heappush(queue, (level + 1, -child, below))
    return out


def levels_of(proof: Proof) -> Iterator[tuple[str, str]]:
    while proof is not None:
        left, right, proof = proof
        yield left, right


def told(proof: Proof) -> str:
    return ",".join(f"{left}|{right}" for left, right in levels_of(proof))


def read(text: str) -> Proof:
    proof: Proof = None
    for part in reversed(text.split(",")) if text else ():
        left, right = part.split("|")
        proof = (left, right, proof)
    return proof


def fold(leaf: str, proof: Proof) -> str:
    """The root that a leaf and its proof give."""
    for left, right in levels_of(proof):
        leaf = digest(left, leaf, right)
    return leaf


# Trees of nodes: (tree, place, nodes, node), nodes being the number of nodes of the tree, node a digest as 32 bytes.


def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of each tree in a sorted partition, from 0; the tree is the first column."""
    part, tree, at = TaskContext.get().partitionId(), (), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        trees = batch.column(0)
        codes = trees.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new = np.flatnonzero(codes[1:] != codes[:-1]) + 1
        starts = np.concatenate([[0], new])
        place = np.arange(batch.num_rows) - np.repeat(starts, np.diff(np.append(starts, batch.num_rows)))
        first = trees[0].as_py()
        if tree == (first,):
            place[: starts[1] if len(starts) > 1 else None] += at
        tree, at = (trees[-1].as_py(),), int(place[-1]) + 1
        columns = [*batch.columns, pa.array(place.astype(np.int64)), pa.array(np.full(batch.num_rows, part, np.int32))]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "__place", "__part"])


def in_order(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` (column tree first) with the number of nodes of their tree and their place in it, in the order ``by``."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The last sort column lets partitions part rows that are alike.
    rows = rows.withColumn("__spread", F.monotonically_increasing_id())
    keys = ["tree", *by, "__spread"]
    ranged = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("__spread")
    kind = ", ".join(f"`{n}` {t}" for n, t in [*ranged.dtypes, ("__place", "long"), ("__part", "int")])
    ranged = save(ranged.mapInArrow(number, kind))
    held = ranged.groupBy("tree", "__part").agg(F.count("*").alias("n"))
    over = W.partitionBy("tree").orderBy("__part")
    held = save(
        held.select("tree", "__part", F.sum("n").over(over.rowsBetween(W.unboundedPreceding, -1)).alias("before"), F.sum("n").over(W.partitionBy("tree")).alias("nodes"))
    )
    # Almost all trees lie in one partition: their rows are numbered already.
    count = held.count()
    out = ranged.withColumnRenamed("tree", "__tree").join(
        small(held.select(F.col("tree").alias("__t"), F.col("__part").alias("__p"), "before", "nodes"), count),
        F.col("__tree").eqNullSafe(F.col("__t")) & (F.col("__part") == F.col("__p")),
    )
    rest = [c for c in rows.columns if c not in ("tree", "__spread")]
    place = F.col("__place") + F.coalesce("before", F.lit(0))
    return out.select(F.col("__tree").alias("tree"), place.alias("place"), "nodes", *rest)


def blocks(batches: Iterator[pa.RecordBatch], work: Callable[[list[tuple]], Iterator[tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Run ``work`` on the rows of each block (equal first two columns) of a sorted partition, one block in memory."""

    def groups() -> Iterator[list[tuple]]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][:2] != row[:2]:
                    yield held
                    held = []
                held.append(row)
        if held:
            yield held

    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema.names)

    for rows in groups():
        out += work(rows)
        if len(out) >= 1000:
            yield flush()
            out = []
    if out:
        yield flush()


def dealt(rows: DataFrame) -> DataFrame:
    """Rows (tree, block, place, ...) shuffled and sorted by tree, block and place."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "tree", "block").sortWithinPartitions("tree", "block", "place")


def block_of(step: int) -> Column:
    return F.expr(f"place div {FANOUT**step}").alias("block")


def climb_blocks(batches: Iterator[pa.RecordBatch], step: int) -> Iterator[pa.RecordBatch]:
    """(tree, place, nodes, node) of the tops of all blocks."""

    def work(rows: list[tuple]) -> Iterator[tuple]:
        tree, block, _, nodes, _ = rows[0]
        levels = min(step, height(nodes))
        top, _ = climb([r[4].hex() for r in rows], levels)
        yield tree, block, -(-nodes // FANOUT**levels), bytes.fromhex(top)

    types = [("tree", pa.string()), ("place", pa.int64()), ("nodes", pa.int64()), ("node", pa.binary())]
    yield from blocks(batches, work, pa.schema(types))


def prove_blocks(batches: Iterator[pa.RecordBatch], step: int) -> Iterator[pa.RecordBatch]:
    """(tree, place, proof) of all nodes of the blocks; the first row of a block has place -1 and its top's proof."""

    def work(rows: list[tuple]) -> Iterator[tuple]:
        head, nodes = rows[0], rows[1:]
        levels = min(step, height(nodes[0][3]))
        _, families = climb([r[4].hex() for r in nodes], levels)
        for r, proof in zip(nodes, descend(families, len(nodes), levels, read(head[5])), strict=True):
            yield r[0], r[2], told(proof)

    types = [("tree", pa.string()), ("place", pa.int64()), ("proof", pa.string())]
    yield from blocks(batches, work, pa.schema(types))


def prove_leaves(batches: Iterator[pa.RecordBatch], step: int) -> Iterator[pa.RecordBatch]:
    """As ``prove_blocks`` on leaves, with the digests of the proofs and the roots that the rows found now give."""

    def work(rows: list[tuple]) -> Iterator[tuple]:
        head, nodes = rows[0], rows[1:]
        levels = min(step, height(nodes[0][3]))
        _, families = climb([r[4].hex() for r in nodes], levels)
        for r, proof in zip(nodes, descend(families, len(nodes), levels, read(head[5])), strict=True):
            siblings = digest(*(x for level in levels_of(proof) for x in level))
            leaf = r[4].hex()
            yield r[0], r[6], leaf, siblings, fold(leaf if r[7] is None else r[7].hex(), proof)

    types = [("tree", pa.string()), ("key", pa.int64()), ("leaf", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string())]
    yield from blocks(batches, work, pa.schema(types))


NODE = "tree string, place long, nodes long, node binary"
PROOF = "tree string, place long, proof string"


def with_heads(nodes: DataFrame, proofs: DataFrame, step: int) -> DataFrame:
    """Nodes and, before each block, the row that brings the proof of its top; dealt and sorted."""
    extra = [c for c in nodes.columns if c not in ("tree", "place", "nodes", "node")]
    body = nodes.select("tree", block_of(step), "place", "nodes", "node", F.lit(None).cast("string").alias("proof"), *extra)
    none = [F.lit(None).cast(t).alias(n) for n, t in nodes.dtypes if n in extra]
    heads = proofs.select("tree", F.col("place").alias("block"), F.lit(-1).cast("long").alias("place"), F.lit(None).cast("long").alias("nodes"), F.lit(None).cast("binary").alias("node"), "proof", *none)
    return dealt(body.union(heads))


class Forest:
    """The tops of the blocks (``step`` levels each) of trees, pass by pass, and the way back down."""

    def __init__(self, nodes: DataFrame, step: int) -> None:
        self.passes, self.step = [nodes], step
        most = nodes.agg(F.max("nodes")).first()[0] or 0
        while True:
            last = self.passes[-1].select("tree", block_of(step), "place", "nodes", "node")
            self.passes.append(save(dealt(last).mapInArrow(partial(climb_blocks, step=step), NODE)))
            most = -(-most // FANOUT**step)
            if most <= 1:
                break

    @property
    def roots(self) -> DataFrame:
        return self.passes[-1].select("tree", F.col("node").alias("node"))

    def heads(self, proofs: DataFrame) -> DataFrame:
        """Proofs of the tops of the lowest blocks, from those of the roots (tree, place 0, proof)."""
        for nodes in reversed(self.passes[1:-1]):
            proofs = save(with_heads(nodes, proofs, self.step).mapInArrow(partial(prove_blocks, step=self.step), PROOF))
        return proofs


def manifest(docs: DataFrame, key: str = "doc_id", source: str = "source", fields: tuple[str, ...] = FIELDS, now: dict[str, Column] | None = None, levels: int = CLIMB) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of each row of ``docs``.

    ``now`` gives the fields as they are found later: the folded root is that of the row as it is now with the proof
    as it was; a row is verified if the root is still the same. Keys are integers. A block covers ``levels`` levels.
    """
    prepare(docs.sparkSession)
    then = row_digest(*(F.col(f) for f in fields))
    later = row_digest(*((now or {}).get(f, F.col(f)) for f in fields))
    rows = docs.select(F.col(source).cast("string").alias("tree"), F.col(key).cast("long").alias("key"), F.unhex(then).alias("node"), F.unhex(later).alias("found"))
    rows = save(rows.withColumn("found", F.when(F.col("found") != F.col("node"), F.col("found"))))
    leaves = save(in_order(rows, ["key", "node"]))
    forest = Forest(leaves, levels)
    subroots = forest.roots
    # The subroots are the leaves of one more tree.
    one = save(in_order(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "node"), ["source"]))
    top = Forest(one, levels)
    start = top.roots.select("tree", F.lit(0).cast("long").alias("place"), F.lit("").alias("proof"))
    by_place = with_heads(one.drop("source"), top.heads(start), levels).mapInArrow(partial(prove_blocks, step=levels), PROOF)
    by_tree = one.join(by_place.select("place", "proof"), "place").select(F.col("source").alias("tree"), F.lit(0).cast("long").alias("place"), "proof")
    kind = "tree string, key long, leaf string, proof_sha256 string, folded_root string"
    out = with_heads(leaves, forest.heads(save(by_tree)), levels).mapInArrow(partial(prove_leaves, step=levels), kind)
    found = top.roots.first()  # one row, none for an empty table
    root = F.lit(found and found.node.hex())
    subs = subroots.select(F.col("tree").alias("__t"), F.lower(F.hex("node")).alias("subroot"))
    out = out.join(small(subs, subs.count()), F.col("tree").eqNullSafe(F.col("__t")))
    return out.select(F.col("key").alias(key), "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def without_line_ends(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The text as the query finds it later: where 2 divides the crc32 of the id, it has lost its line ends.

    A null id counts as odd.
    """
    even = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.translate(text, "\n", "")).otherwise(F.col(text))


def _forest_sql(name: str, leaves: str, tree: str) -> str:
    """CTEs: digests and families (children of a node) of the trees of ``leaves`` (``tree``, i, n, d), level by level."""
    return f"""
{name}_nodes AS (
  SELECT {tree} AS tree, 0 AS level, i, n, d FROM {leaves}
  UNION ALL
  SELECT tree, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM {name}_nodes WHERE n > 1 GROUP BY tree, level, i // 3, n),
{name}_families AS (SELECT tree, level, i // 3 AS family, list(d ORDER BY i) AS ds FROM {name}_nodes WHERE n > 1 GROUP BY ALL)"""


def _fold_sql(name: str, start: str, families: str) -> str:
    """CTEs: from (id, tree, i, cur, proof) up to the root, with the siblings met on the way."""
    return f"""
{name} AS (
  SELECT id, tree, 0 AS level, i, cur, proof FROM {start}
  UNION ALL
  SELECT p.id, p.tree, p.level + 1, p.i // 3,
    sha256(array_to_string(ds[1:p.i % 3], '') || p.cur || array_to_string(ds[p.i % 3 + 2:], '')),
    p.proof || array_to_string(ds[1:p.i % 3], '') || array_to_string(ds[p.i % 3 + 2:], '')
  FROM {name} p JOIN {families} f ON f.tree IS NOT DISTINCT FROM p.tree AND f.level = p.level AND f.family = p.i // 3)"""


_VALUES = ("doc_id", "source", "lang", "n_chars", "{text}")
_FIELDS = " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in _VALUES)
SQL = f"""WITH RECURSIVE rows AS (
  SELECT doc_id, source, sha256({_FIELDS.format(text="text")}) AS d,
    sha256({_FIELDS.format(text="CASE WHEN doc_id IS NOT NULL AND " + CRC32_SQL + " % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")}) AS cur
  FROM documents),
leaves AS (SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, d) - 1 AS i,
  count(*) OVER (PARTITION BY source) AS n FROM rows),
{_forest_sql("low", "leaves", "source").strip()},
subs AS (SELECT tree AS source, d, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM low_nodes WHERE n = 1),
{_forest_sql("top", "subs", "0").strip()},
begun AS (SELECT id, source AS tree, i, cur, '' AS proof FROM leaves),
{_fold_sql("up", "begun", "low_families").strip()},
at_subroot AS (SELECT u.id, 0 AS tree, s.i, u.cur, u.proof FROM up u JOIN subs s ON s.source IS NOT DISTINCT FROM u.tree
  QUALIFY row_number() OVER (PARTITION BY u.id ORDER BY u.level DESC) = 1),
{_fold_sql("onward", "at_subroot", "top_families").strip()},
ends AS (SELECT id, cur, proof FROM onward QUALIFY row_number() OVER (PARTITION BY id ORDER BY level DESC) = 1)
SELECT l.doc_id, l.d AS leaf, s.d AS subroot, r.d AS root, sha256(e.proof) AS proof_sha256, e.cur AS folded_root, e.cur = r.d AS verified
FROM leaves l JOIN ends e USING (id) JOIN subs s ON s.source IS NOT DISTINCT FROM l.source CROSS JOIN (SELECT d FROM top_nodes WHERE n = 1) r"""


@query("op13_manifest", SQL)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return manifest(table(spark, sf, "documents"), now={"text": without_line_ends()})

"""N-gram Jaccard join by a MinHash forest with exact verification.

1. Each text becomes its set of word shingles (five words in lower case; a shorter text is one shingle) and ``TREES`` signatures of
   ``DEPTH`` minima. Texts with equal sets fall into one class at once, whatever their number; only one
   representative of each class goes on.
2. Each tree is the sorted list of its signatures: equal prefixes stand together, and each row is linked to the first
   row of the run of equal prefixes it belongs to. The prefix is the longest at which a pair that is just similar
   enough is found with the target probability. It does not depend on the data, so no group of texts, however large,
   hides the misses of other pairs.
3. Candidates are the components of these links. All pairs inside a component are verified exactly, as products of
   0/1 matrices in blocks; large components are dealt to many tasks by blocks, and only counts and a spanning set of
   links leave a task, never all pairs.

Every row has a result. Null texts and texts without words have no partners. Repeated rows are partners of each other.
Ids must be unique; rows with a null id get a result of their own without partners. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import prepare, query, save, shingle_hashes, slices, small, table, text_column, utf8, words
from tidemark.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
TREES = 16
DEPTH = 6
#: Least probability with which any pair of enough similarity is found; for similarity 0.8 it takes prefixes of 4 (0.9998).
RECALL = 0.9995
#: Members of a block of a component, and shingles of a block.
BLOCK_ROWS = 512
BLOCK_SHINGLES = 1_000_000
MATRIX_CELLS = 2_000_000

_SEEDS = np.random.default_rng(20240501).integers(1, 2**63, (TREES * DEPTH, 2), dtype=np.uint64) | np.uint64(1)


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, offsets = utf8(column)
    for i, j in slices(offsets):
        base = offsets[i]
        _, _, hashes, first = words(data[base : offsets[j]], offsets[i : j + 1] - base)
        whole = shingle_hashes(hashes, size)
        for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if high - low >= size:
                yield np.unique(whole[low : high - size + 1])
            elif high > low:
                yield shingle_hashes(hashes[low:high], high - low)
            else:
                yield hashes[:0]


def signature(shingles: np.ndarray) -> np.ndarray:
    """TREES x DEPTH minima, 32 bits each, big-endian so that byte order is number order."""
    out = np.empty(len(_SEEDS), ">u4")
    for k, (flip, factor) in enumerate(_SEEDS):
        out[k] = ((shingles ^ flip) * factor).min() >> np.uint64(32)
    return out


def sketches(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, n, d1, d2, sig): size and digest of the shingle set, and the signatures of all trees as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, sigs = [], [], []
            for s in shingle_sets(text_column(batch, "text")):
                n.append(len(s))
                digests.append((int(s.sum().view(np.int64)), int((s * (s >> np.uint64(7) | np.uint64(1))).sum().view(np.int64))) if len(s) else (0, 0))
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_pydict(
                {
                    "id": batch.column(batch.schema.get_field_index("id")),
                    "n": pa.array(n, pa.int64()),
                    "d1": pa.array([x[0] for x in digests], pa.int64()),
                    "d2": pa.array([x[1] for x in digests], pa.int64()),
                    "sig": pa.array(sigs, pa.binary()),
                }
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.lower(text).alias("text"))
    return rows.mapInArrow(run, "id long, n long, d1 long, d2 long, sig binary")


def _found(similarity: float, prefix: int) -> float:
    return 1 - (1 - similarity**prefix) ** TREES


def prefix_length(threshold: float, recall: float) -> int:
    """The longest prefix at which a pair of similarity ``threshold`` is found with probability ``recall``; 0 links all."""
    return next(p for p in range(DEPTH, -1, -1) if p == 0 or _found(threshold, p) >= recall)


def _tree_links(prefix: int):
    """Links of each sorted row to the first row of the run of equal prefixes it is in; the ends of the partition, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last: tuple[np.ndarray, int] | None = None  # row before: its prefix, and the first id of its run
        ends: list[tuple[int, bytes, int]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            tree = batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint32)
            raw = b"".join(batch.column(2).to_pylist())
            sig = np.column_stack([tree, np.frombuffer(raw, ">u4").reshape(-1, DEPTH)[:, :prefix]]).astype(np.uint32)
            begin = np.ones(len(ids), bool)
            begin[1:] = (sig[1:] != sig[:-1]).any(axis=1)
            if last is None:
                ends.append((int(tree[0]), raw[: 4 * DEPTH], int(ids[0])))
            else:
                begin[0] = (sig[0] != last[0]).any()
            at = np.maximum.accumulate(np.where(begin, np.arange(len(ids)), -1))
            heads = np.where(at >= 0, ids[at], last[1] if last is not None else ids[0])
            take = np.flatnonzero(heads != ids)
            yield _link_batch(ids[take], heads[take], part)
            last = (sig[-1], int(heads[-1]))
            tail = (int(tree[-1]), raw[-4 * DEPTH :], int(ids[-1]))
        if last is not None:
            yield _end_batch([ends[0], tail], part)

    return run


LINK = "a long, b long, part int, side int, tree int, sig binary"
_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("part", pa.int32()), ("side", pa.int32()), ("tree", pa.int32()), ("sig", pa.binary())])


def _link_batch(a: np.ndarray, b: np.ndarray, part: int) -> pa.RecordBatch:
    none = [None] * len(a)
    return pa.RecordBatch.from_arrays(
        [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([part] * len(a), pa.int32())]
        + [pa.array(none, t) for t in (pa.int32(), pa.int32(), pa.binary())],
        schema=_LINK,
    )


def _end_batch(ends: list[tuple[int, bytes, int]], part: int) -> pa.RecordBatch:
    rows = [{"a": i, "b": None, "part": part, "side": k, "tree": t, "sig": s} for k, (t, s, i) in enumerate(ends)]
    return pa.RecordBatch.from_pylist(rows, _LINK)


def forest_links(reps: DataFrame, prefix: int) -> DataFrame:
    """(a, b): representatives with equal prefixes in some tree, linked run by run."""
    trees = reps.select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.substring("sig", 1 + 4 * DEPTH * t, F.lit(4 * DEPTH)))).alias("tree", "sig"))
    parts = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["tree", "sig", "id"]
    found = save(trees.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_tree_links(prefix), LINK))
    # Two rows for each partition: a run that goes on across its border. The last row of a partition is linked to the
    # first row of its run there.
    border = W.orderBy("part", "side")
    ends = found.where("side is not null")
    ends = ends.withColumns({"tree0": F.lag("tree").over(border), "sig0": F.lag("sig").over(border), "a0": F.lag("a").over(border)})
    cut = F.substring("sig", 1, 4 * prefix) == F.substring("sig0", 1, 4 * prefix)
    across = ends.where("side = 0 and tree = tree0").where(cut).select("a", F.col("a0").alias("b"))
    return save(found.where("side is null").select("a", "b").union(across).distinct())


def _matrix_counts(sets: list[np.ndarray], split: int) -> np.ndarray:
    """Sizes of the intersections of sets[:split] with sets[split:] (split 0: of all with all)."""
    values, inverse, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    column = np.cumsum(many > 1) - 1
    keep = many[inverse] > 1
    row, column, width = row[keep], column[inverse[keep]], int((many > 1).sum())
    left = split or len(sets)
    right = len(sets) - split
    total = np.zeros((left, right), np.float32)
    step = max(64, MATRIX_CELLS // len(sets))
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for low in range(0, width, step):
        i, j = np.searchsorted(column, [low, low + step])
        m = np.zeros((len(sets), min(step, width - low)), np.float32)
        m[row[i:j], column[i:j] - low] = 1
        total += m[:left] @ m[split:].T
    return total


def _heads(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id of each member's component under a symmetric boolean matrix."""
    head = ids.copy()
    while True:
        new = np.where(linked, head[None, :], np.iinfo(np.int64).max).min(axis=1)
        new = np.minimum(new, head)
        if (new == head).all():
            return head
        head = new


def _verify(ids: np.ndarray, weight: np.ndarray, block: np.ndarray, sets: list[np.ndarray], threshold: float) -> pd.DataFrame:
    """One row for each member: how many documents it is linked with here, and its head."""
    order = np.lexsort((ids, block))
    ids, weight, block, sets = ids[order], weight[order], block[order], [sets[k] for k in order]
    split = int(np.searchsorted(block, block[-1])) if block[0] != block[-1] else 0
    size = np.array([len(s) for s in sets], np.float64)
    common = _matrix_counts(sets, split).astype(np.float64)
    similarity = common / (size[: split or len(size), None] + size[None, split:] - common)
    linked = similarity >= threshold - 1e-12
    if not split:
        np.fill_diagonal(linked, False)
    if split:
        degree = np.concatenate([linked @ weight[split:], linked.T @ weight[:split]])
        both = np.zeros((len(ids), len(ids)), bool)
        both[:split, split:] = linked
        both[split:, :split] = linked.T
    else:
        degree, both = linked @ weight, linked
    return pd.DataFrame({"id": ids, "partners": degree.astype(np.int64), "head": _heads(both, ids)})


def _verify_all(threshold: float):
    """Streams rows sorted by (component, left block, right block) and verifies one block pair at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                t = pa.Table.from_batches(held)
                ids, weight, block = (t.column(c).to_numpy() for c in ("id", "copies", "block"))
                if key[1] != key[2] and (block == block[0]).all():
                    return  # the other block has no members; this one is verified with itself elsewhere
                sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
                yield pa.RecordBatch.from_pandas(_verify(ids, weight, block, sets, threshold), preserve_index=False)

        for batch in batches:
            keys = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)])
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
                if high == low:
                    continue
                if key is not None and tuple(keys[low]) != key:
                    yield from flush()
                    held = []
                key = tuple(keys[low])
                held.append(batch.slice(low, high - low))
        yield from flush()

    return run


def _with_shingles(docs: DataFrame, doc_id: str, text: str, wanted: DataFrame, rows: int, size: int) -> DataFrame:
    """``wanted`` (id, ...) with the shingle sets of their texts; only ids are broadcast, behind a count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [s.tobytes() for s in shingle_sets(text_column(batch, "text"), size)]
            kept = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(arrays, pa.binary())], names=[*batch.schema.names[:-1], "shingles"])

    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.lower(text).alias("text"))
    joined = texts.join(small(wanted, rows), "id").select(*wanted.columns, "text")
    schema = ", ".join(f"{n} {t}" for n, t in wanted.dtypes) + ", shingles binary"
    return joined.mapInArrow(run, schema)


def jaccard_links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """(id, class_id, rep_id, n_copies, n_links) for each row of ``docs``.

    ``class_id`` is the smallest id of the rows connected by links, ``rep_id`` the smallest id of the rows with the same
    shingle set, ``n_copies`` their number, ``n_links`` the number of other rows whose similarity is at least
    ``threshold`` (copies counted one by one).
    """
    prepare(docs.sparkSession)
    sketch = save(sketches(docs, doc_id, text))
    real = sketch.where("n > 0 and id is not null")
    classes = save(real.groupBy("d1", "d2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    reps = save(real.select("id", "sig").join(classes.select(F.col("rep").alias("id"), "n", "copies"), "id"))
    links = forest_links(reps.select("id", "sig"), prefix_length(threshold, recall))
    sizes = reps.select("id", "n", "copies")
    roots = save(components(links))
    members = roots.join(sizes, "id")
    extent = members.groupBy("root").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("shingles") / BLOCK_SHINGLES))
    extent = save(extent.select("root", F.least(blocks, F.col("rows")).cast("int").alias("blocks")))
    placed = save(members.join(extent, "root").select("id", "root", "copies", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block")))
    sets = _with_shingles(docs, doc_id, text, placed, placed.count(), SHINGLE)
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    # One block: its own pair. More: each pair of different blocks, and each block with itself.
    pairs = sets.select("id", "root", "copies", "block", "shingles", each).select(
        "root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "copies", "block", "shingles"
    )
    by = ["root", "i", "j"]
    dealt = pairs.repartition(*by).sortWithinPartitions(*by)
    result = save(dealt.mapInArrow(_verify_all(threshold), "id long, partners long, head long"))
    heads = components(result.select("id", "head"))
    counted = result.groupBy("id").agg(F.sum("partners").alias("partners"))
    linked = save(counted.join(heads, "id", "left").select("id", "partners", F.coalesce("root", "id").alias("root")))
    classes = save(classes.join(linked.withColumnRenamed("id", "rep"), "rep", "left"))
    out = sketch.join(classes, ["d1", "d2", "n"], "left")
    return out.select(
        "id",
        F.coalesce("root", "rep", "id").alias("class_id"),
        F.coalesce("rep", "id").alias("rep_id"),
        F.coalesce("copies", F.lit(1)).alias("n_copies"),
        (F.coalesce("partners", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).alias("n_links"),
    )


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their class; rows without words or id stay."""
    found = jaccard_links(docs, doc_id, text, threshold)
    gone = save(found.where("class_id <> id").select(F.col("id").alias("__gone")))
    return docs.join(small(gone, gone.count()), F.col(doc_id).cast("long") == F.col("__gone"), "left_anti")


SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN NULL WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS g
  FROM w),
cls AS (SELECT g, min(doc_id) AS rep, count(*) AS copies FROM s WHERE g IS NOT NULL GROUP BY g),
u AS (SELECT rep, len(g) AS n, unnest(g) AS x FROM cls),
common AS (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS c FROM u a JOIN u b ON a.x = b.x AND a.rep <> b.rep GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 10 * c >= 8 * (na + nb - c)),
reach AS (SELECT rep AS id, rep AS root FROM cls UNION SELECT l.a, r.root FROM reach r JOIN links l ON l.b = r.id),
roots AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
degree AS (SELECT l.a AS rep, sum(c.copies) AS partners FROM links l JOIN cls c ON c.rep = l.b GROUP BY 1)
SELECT s.doc_id, coalesce(roots.root, s.doc_id) AS class_id, coalesce(cls.rep, s.doc_id) AS rep_id,
  CAST(coalesce(cls.copies, 1) AS BIGINT) AS n_copies, CAST(coalesce(partners, 0) + coalesce(cls.copies - 1, 0) AS BIGINT) AS n_links
FROM s LEFT JOIN cls ON cls.g = s.g LEFT JOIN roots ON roots.id = cls.rep LEFT JOIN degree ON degree.rep = cls.rep"""


@query("op5_near_duplicates", SQL)
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_links(table(spark, sf, "documents")).withColumnRenamed("id", "doc_id")

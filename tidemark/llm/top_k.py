"""Exact top-k inner products by aggregation without random access.

Vectors become whole numbers. Queries and candidates are dealt in blocks; one task holds one block of each. There, each
component is a list of the candidates sorted by value, read from the top for a positive component of a query and from
the bottom for a negative one, all lists in step and once for all queries of the block. What has been read gives each
candidate a lower bound (the rest at the lists' ends) and an upper bound (the rest where the lists stand now). Reading
stops for a query once at most ``RESOLVE`` candidates can still reach its k-th best lower bound, or the k-th best score
of the lists before; their scores are then resolved. Bounds include ties, so the result is exact, ties going to the
smaller id.

Vectors that are null or hold null or non-finite components, and null ids, take no part. Shorter vectors count as
padded with zeros. Rows with the query's own id are never its candidates; a repeated id is one query (its smallest
vector), but as a candidate each of its rows counts. An empty table gives an empty table.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import prepare, query, save, table

K = 5
EVERY = 50
QUERY_BLOCK = 512
CANDIDATE_BLOCK = 16_384
#: Candidates whose lists are sorted together, and how far the lists are read before bounds are compared.
LIST = 4096
STOPS = (0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 1.0)
RESOLVE = 256


def whole_numbers(vector: Column | str, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null if a component is null or not finite."""
    v = F.col(vector) if isinstance(vector, str) else vector
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(good, F.transform(v, lambda x: F.floor(scale * x.cast("double")).cast("long")))


def _matrix(vectors: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


class Lists:
    """Sorted lists of one run of candidates, one for each component, read from both ends in step."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        self.real = vectors.astype(np.float32)
        self.sorted = np.sort(self.real, axis=0)

    def bounds(self, depth: int, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Upper and lower bounds of all scores once ``depth`` entries of each list are read.

        ``up`` and ``down`` are the positive and negative parts of the queries. An entry not read yet is at most
        where its list stands and at least the list's last value (the other way round from the bottom).
        """
        n = len(self.ids)
        high, low = self.sorted[n - depth], self.sorted[depth - 1]
        upper = up @ np.maximum(self.real, high).T + down @ np.minimum(self.real, low).T
        lower = up @ np.where(self.real >= high, self.real, self.sorted[0]).T
        lower += down @ np.where(self.real <= low, self.real, self.sorted[-1]).T
        slack = 1 + 1e-5 * (np.abs(up) + np.abs(down)) @ np.abs(self.sorted[[0, -1]]).max(axis=0)
        return upper + slack[:, None], lower - slack[:, None]

    def best(self, names: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """For each query, ids and scores of the k best candidates, less those that cannot reach its floor."""
        n, out = len(self.ids), {}
        open_ = np.arange(len(names))
        real = queries.astype(np.float32)
        up, down = np.maximum(real, 0), np.minimum(real, 0)
        for share in STOPS:
            depth = min(n, int(np.ceil(n * share)))
            if depth < n:
                upper, lower = self.bounds(depth, up[open_], down[open_])
                own = self.ids[None, :] == names[open_, None]
                lower[own] = -np.inf
                reach = np.partition(lower, n - k, axis=1)[:, n - k] if n >= k else np.full(len(open_), -np.inf)
                alive = (upper >= np.maximum(reach, floors[open_])[:, None]) & ~own
                ready = alive.sum(axis=1) <= RESOLVE
            else:
                alive, ready = self.ids[None, :] != names[open_, None], np.ones(len(open_), bool)
            for row in np.flatnonzero(ready):
                j = int(open_[row])
                at = np.flatnonzero(alive[row])
                scores, ids = self.vectors[at] @ queries[j], self.ids[at]
                keep = scores >= floors[j]
                ids, scores = ids[keep], scores[keep]
                first = np.lexsort((ids, -scores))[:k]
                out[j] = ids[first], scores[first]
            open_ = open_[~ready]
            if not len(open_):
                break
        return out


def _block(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    """Best candidates of one block for each query of one block."""
    width = int(pdf["vector"].map(len).max())
    asks = pdf[pdf["is_query"]]
    rest = pdf[~pdf["is_query"]].sort_values("vec_id", kind="stable")
    queries = _matrix(asks["vector"].tolist(), width)
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(len(asks))]
    floors = np.full(len(asks), -np.inf)
    names = asks["vec_id"].to_numpy()
    ids, vectors = rest["vec_id"].to_numpy(), _matrix(rest["vector"].tolist(), width)
    for low in range(0, len(ids), LIST):
        lists = Lists(ids[low : low + LIST], vectors[low : low + LIST])
        for j, got in lists.best(names, queries, k, floors).items():
            if len(got[0]):
                found[j].append(got)
                scores = np.concatenate([s for _, s in found[j]])
                if len(scores) >= k:
                    floors[j] = np.partition(scores, len(scores) - k)[len(scores) - k]
    out: list[pd.DataFrame] = []
    for name, parts in zip(names, found, strict=True):
        if parts:
            near, score = (np.concatenate(x) for x in zip(*parts, strict=True))
            first = np.lexsort((near, -score))[:k]
            out.append(pd.DataFrame({"query_id": name, "vec_id": near[first], "score": score[first]}))
    return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "vec_id", "score")})


def top_k(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each row for which ``is_query`` holds."""
    prepare(vectors.sparkSession)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), whole_numbers(vector).alias("vector"), is_query.alias("is_query"))
    rows = save(rows.where("vec_id is not null and vector is not null"))
    size = rows.agg(F.count("*").alias("n"), F.count_if("is_query").alias("q")).first()
    query_blocks, blocks = max(1, -(-size.q // QUERY_BLOCK)), max(1, -(-size.n // CANDIDATE_BLOCK))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    number = F.xxhash64("vec_id")
    asked = rows.where("is_query").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    asked = asked.select("vec_id", "vector", F.lit(True).alias("is_query"), F.pmod(number, F.lit(query_blocks)).cast("int").alias("qb"), each(blocks).alias("cb"))
    others = rows.select("vec_id", "vector", F.lit(False).alias("is_query"), F.pmod(number, F.lit(blocks)).cast("int").alias("cb"), each(query_blocks).alias("qb"))
    pairs = asked.unionByName(others)
    best = pairs.groupBy("qb", "cb").applyInPandas(lambda pdf: _block(pdf, k), "query_id long, vec_id long, score long")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
parts AS (SELECT vec_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x) AS score
  FROM parts q JOIN parts c ON q.i = c.i AND q.vec_id <> c.vec_id
  WHERE q.vec_id % {EVERY} = 0 GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= {K}"""


@query("op6_top_k", SQL)
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return top_k(table(spark, sf, "embeddings"), F.col("vec_id") % EVERY == 0)

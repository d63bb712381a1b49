"""Conflict-constrained best-fit packing of documents into training sequences.

A document longer than a sequence is cut into full pieces and a rest. Pieces are dealt by a hash of (id, piece) into
groups of about ``GROUP`` pieces, so that copies and sources spread over all groups, and each group is packed on its
own, longest piece first. Its open bins are kept in order of residual room, each with a bitmap of the sources and one
of the duplicate clusters it holds. A piece goes to the first bin, from the smallest room that suffices upwards, that
holds neither its source nor its cluster; if there is none, it opens a bin. Only ids, lengths and keys are moved.

Every piece is placed once and no bin is over its capacity. Null sources and clusters conflict with nothing; null and
empty texts are pieces of no words. Ties go to the smaller id and piece, and among bins to the older one. Repeated
rows are packed like others. An empty table gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import prepare, query, save, table

CAPACITY = 2048
GROUP = 2048
PACKED = "doc_id long, piece int, bin_id long, position int, start_word long, n_words long"


def word_count(text: Column | str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def copy_cluster(text: Column | str = "text") -> Column:
    """Texts that differ in case and white space only have equal clusters; null and blank ones have none."""
    x = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    return F.when(F.length(x) > 0, F.xxhash64(x))


def _bits(values: pd.Series) -> list[int]:
    """A bit for each value that occurs more than once, 0 for the others and null: only shared values can conflict."""
    codes, names = pd.factorize(values)
    shared = np.bincount(codes[codes >= 0], minlength=max(1, len(names))) > 1
    place = np.cumsum(shared) - 1
    return [1 << int(place[c]) if c >= 0 and shared[c] else 0 for c in codes]


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, position in it) of each piece, in the order given; sources and clusters as bits."""
    rooms: list[tuple[int, int]] = []  # (residual, bin), in order
    held_sources: list[int] = []
    held_clusters: list[int] = []
    count: list[int] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        at = bisect_left(rooms, (size, -1))
        while at < len(rooms) and (held_sources[rooms[at][1]] & source or held_clusters[rooms[at][1]] & cluster):
            at += 1
        if at < len(rooms):
            room, chosen = rooms.pop(at)
        else:
            room, chosen = capacity, len(count)
            held_sources.append(0)
            held_clusters.append(0)
            count.append(0)
        insort(rooms, (room - size, chosen))
        held_sources[chosen] |= source
        held_clusters[chosen] |= cluster
        out.append((chosen, count[chosen]))
        count[chosen] += 1
    return out


def pack(docs: DataFrame, size: Column, source: Column, cluster: Column, doc_id: str = "doc_id", capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """One row of ``PACKED`` for each piece of each row of ``docs``."""
    prepare(docs.sparkSession)
    last = F.greatest(F.ceil(F.col("size") / capacity), F.lit(1)).cast("int") - 1
    pieces = (
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), size.cast("long").alias("size"), source.cast("string").alias("source"), cluster.alias("cluster"))
        .select("*", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
        .withColumn("start_word", F.col("piece").cast("long") * capacity)
        .withColumn("n_words", F.least(F.col("size") - F.col("start_word"), F.lit(capacity).cast("long")))
        .drop("size")
    )
    pieces = save(pieces)
    groups = max(1, -(-pieces.count() // group))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_words", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        placed = best_fit(pdf["n_words"].tolist(), _bits(pdf["source"]), _bits(pdf["cluster"]), capacity)
        pdf["bin_id"] = [(int(g) << 32) + b for g, (b, _) in zip(pdf["group"], placed, strict=True)]
        pdf["position"] = [p for _, p in placed]
        return pdf[["doc_id", "piece", "bin_id", "position", "start_word", "n_words"]]

    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    return dealt.groupBy("group").applyInPandas(run, PACKED)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Packs documents by words; a bin holds one piece at most of each source and each group of copies."""
    return pack(docs, word_count(), F.col("source"), copy_cluster(), capacity=capacity)


@query("op4_best_fit_packing")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return pack_documents(table(spark, sf, "documents").select("doc_id", "text", "source"))

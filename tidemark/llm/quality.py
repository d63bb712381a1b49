"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Tokens are runs of word characters (case kept) and runs of other marks. Tokens, pairs of tokens, and triples of token
shapes (lower, capital, upper case, digits, the mark itself, or the same as the token before) are hashed into
``2 ** BITS`` features; a feature that makes up the share s of a text's features weighs sqrt(s). Training reads a
bounded sample of the labelled rows (``TRAIN_ROWS``, in the order of a hash of their id), deals it to ``TRAIN_SHARDS``
tasks, runs FTRL-proximal in each and averages the weights. The model has a fixed size; scores are sparse dot products
over whole texts.

Null and empty texts have no features and get the score of the bias alone. Repeated rows get equal scores. Labels that
are null are left out; documents without labels are scored like all others. With no labelled rows the score is 0.5.
An empty table gives an empty table; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import SAME, WORD, byte_class, hash_runs, prepare, query, runs, shingle_hashes, slices, table, utf8

BITS = 18
TRAIN_ROWS = 20_000
TRAIN_SHARDS = 4
EPOCHS = 4
THRESHOLD = 0.3
FOLDS = 5
BIAS = 1 << BITS
MARK = byte_class((0x21, 0x7E)) & ~WORD


@dataclass(frozen=True)
class Ftrl:
    """Step sizes and penalties of the updates."""

    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 0.001
    l2: float = 0.001


UPPER = byte_class((0x41, 0x5A))
DIGIT = byte_class((0x30, 0x39))


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A small number for what each token looks like; marks and repeated tokens stand for themselves."""
    upper = UPPER[data]
    total = np.concatenate([[0], np.cumsum(upper)])
    many = total[ends] - total[starts]
    out = np.where(many * 2 > ends - starts, 3, np.where(upper[starts], 2, 1)).astype(np.uint64)
    out[DIGIT[data[starts]]] = 4
    marks = MARK[data[starts]]
    out[marks] = hashes[marks]
    out[1:][(hashes[1:] == hashes[:-1]) & ~marks[1:]] = 5
    return out


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted numbers of the features of each text, and their weights."""
    data, offsets = utf8(column)
    for i, j in slices(offsets):
        base = offsets[i]
        part, at = data[base : offsets[j]], offsets[i : j + 1] - base
        pieces = [runs(member[part], at) for member in (WORD, MARK)]
        starts, ends = (np.concatenate(x) for x in zip(*pieces, strict=True))
        order = np.argsort(starts, kind="stable")
        starts, ends = starts[order], ends[order]
        one = hash_runs(part, starts, ends, SAME)
        two = shingle_hashes(one, 2)
        three = shingle_hashes(shapes(part, starts, ends, one), 3) if len(one) else one
        first = np.searchsorted(starts, at)
        for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            got = [x[low : max(low, high - k)] for k, x in enumerate((one, two, three))]
            found, many = np.unique(np.concatenate(got) >> np.uint64(64 - BITS), return_counts=True)
            yield found.astype(np.int64), np.sqrt(many / max(1, many.sum()))


def train_shard(examples: list[tuple[tuple[np.ndarray, np.ndarray], int]], how: Ftrl, epochs: int) -> np.ndarray:
    """Weights (the last one is the bias) after ``epochs`` runs over the examples in their order."""
    z, n = np.zeros(BIAS + 1), np.zeros(BIAS + 1)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - how.l1, 0)
        return -shrunk / ((how.beta + np.sqrt(n[at])) / how.alpha + how.l2)

    for _ in range(epochs):
        for (found, weight), label in examples:
            at = np.append(found, BIAS)
            x = np.append(weight, 1.0)
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / how.alpha * w
            n[at] += g * g
    return weights(slice(None))


def fit(labelled: DataFrame, text: str = "text", label: str = "label", key: str = "key", how: Ftrl = Ftrl(), epochs: int = EPOCHS) -> np.ndarray:
    """Weights from a bounded sample of (key, text, label 0/1): the average over the shards of the sample."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "key", "label"], kind="stable")
        found = features(pa.array(pdf["text"], pa.string()))
        w = train_shard(list(zip(found, pdf["label"].tolist(), strict=True)), how, epochs)
        at = np.flatnonzero(w)
        return pd.DataFrame({"feature": at, "weight": w[at]})

    rows = labelled.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(label).cast("int").alias("label"), F.col(key).cast("string").alias("key"))
    rows = rows.withColumn("at", F.xxhash64("key")).withColumn("shard", F.pmod(F.shiftright("at", 20), F.lit(TRAIN_SHARDS)))
    dealt = rows.groupBy("shard").applyInPandas(run, "feature long, weight double").groupBy("feature").agg(F.sum("weight").alias("weight"))
    got = dealt.toPandas()  # at most 2 ** BITS + 1 rows
    weights = np.zeros(BIAS + 1)
    weights[got["feature"].to_numpy(np.int64)] = got["weight"].to_numpy() / TRAIN_SHARDS
    return weights.round(9)


def score(weights: np.ndarray, text: Column | str, spark: SparkSession) -> Column:
    """Probability of label 1 for each text."""
    shared = spark.sparkContext.broadcast(weights.astype(np.float64))  # fixed size

    def dot(texts: pa.Array) -> pa.Array:
        texts = texts if texts.type == pa.string() else texts.cast(pa.string())
        w = shared.value
        total = [w[BIAS] + w[found] @ weight for found, weight in features(texts.fill_null(""))]
        return pa.array(1 / (1 + np.exp(-np.clip(np.array(total, np.float64), -35, 35))), pa.float64())

    return F.arrow_udf(dot, "double")(text)


def fold(doc_id: Column | str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``FOLDS``; 0 is held out."""
    text = (F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary")) % FOLDS


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    """At most ``limit`` labelled documents outside the held-out fold, the first by a hash of the id."""
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold() != 0))
        .select("doc_id", F.col("quality").alias("label"))
        .orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id", "label")
        .limit(limit)
    )
    # Both sides of the sample are bounded by ``limit`` rows.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").alias("key"), "text", "label")


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text, by a model fitted to the labelled ones among them."""
    prepare(docs.sparkSession)
    weights = fit(training_rows(docs, labels))
    return docs.withColumn(into, score(weights, text, docs.sparkSession))


@query("op9_quality")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    scored = classify(docs, table(spark, sf, "labels"))
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

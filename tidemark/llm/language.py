"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; runs of anything but letters become one blank, and a blank stands before and after each text.
All n-grams of 1, 2 and 3 characters are hashed into ``2 ** BITS`` buckets. A language's log probabilities are those of
the bucket counts of its texts, each raised by ``SMOOTH``; its prior is its share of the labelled rows. The matrix of
log probabilities (``MOST_LANGUAGES`` languages at most, so 64 MB at most) is broadcast; a text's score for each
language is the product of its sparse bucket counts with that matrix, its answer the language of the largest score and
its probability among all learned ones (ties: the smaller name).

Counts come from some ``TRAIN_IDS`` ids of each language at most (all, if there are fewer), chosen by a hash of the id;
rows of one id count once, by their smallest text. Priors cover all labelled rows, predictions all rows and whole texts.

Texts that are null or have no letter get ``und`` and 0.0, and so do all texts if nothing could be learned. Rows whose
language or text is null are not learned from. Repeated rows get equal answers, an empty table an empty one; other
columns are kept, columns named like the two results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import SLICE_BYTES, mix, prepare, query, slices, table, text_column, utf8

ORDERS = (1, 2, 3)
BITS = 16
BUCKETS = 1 << BITS
SMOOTH = 0.1
TRAIN_IDS = 20_000
MOST_LANGUAGES = 256
UNKNOWN = "und"
FOLDS, HELD_OUT = 4, 2
BLANK = 32
#: One odd number for each place in an n-gram.
PLACES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def buckets(line: np.ndarray, size: int) -> np.ndarray:
    """Bucket of the n-gram that begins at each character of ``line``."""
    n = len(line) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint16)
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total += line[k : k + n] * np.uint64(PLACES[k])
    return (mix(total) >> np.uint64(64 - BITS)).astype(np.uint16)


def grams(column: pa.Array) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of each text (none for a text without letters)."""
    _, offsets = utf8(column)
    for i, j in slices(offsets, SLICE_BYTES):
        texts = [t.lower() for t in column.slice(i, j - i).to_pylist()]
        points = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le"), np.uint32)
        letter = letters()[points]
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[0] = True
        line = np.where(letter, points, BLANK)[keep].astype(np.uint64)
        place = np.cumsum(keep) - 1
        found = [buckets(line, size) for size in ORDERS]
        at = np.flatnonzero(letter)
        ends = np.cumsum([1 + len(t) for t in texts])
        low = np.searchsorted(at, ends - [len(t) for t in texts])
        high = np.searchsorted(at, ends)
        for a, b in zip(low.tolist(), high.tolist(), strict=True):
            if a == b:
                yield np.zeros(0, np.uint16)
                continue
            first, last = place[at[a]] - 1, place[at[b - 1]] + 2
            yield np.concatenate([x[first : max(first, last - size + 1)] for size, x in zip(ORDERS, found, strict=True)])


@dataclass(frozen=True)
class Model:
    """Languages in order of their names, their log priors, and log probabilities (bucket, language)."""

    languages: list[str]
    priors: np.ndarray
    matrix: np.ndarray

    def probabilities(self, column: pa.Array) -> Iterator[np.ndarray | None]:
        """Probability of each language for each text; None for a text without letters."""
        for got in grams(column):
            if not len(got) or not self.languages:
                yield None
                continue
            got = np.sort(got, kind="stable")
            edge = np.concatenate([[0], np.flatnonzero(got[1:] != got[:-1]) + 1, [len(got)]])
            total = self.priors + np.diff(edge).astype(np.float64) @ self.matrix[got[edge[:-1]]].astype(np.float64)
            share = np.exp(total - total.max())
            yield share / share.sum()


def count_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, bucket, many) of a task's (language number, text) rows."""
    many: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, got in zip(batch.column(0).to_pylist(), grams(text_column(batch)), strict=True):
            held = many.setdefault(k, np.zeros(BUCKETS, np.int64))
            found, times = np.unique(got, return_counts=True)
            held[found] += times
    for k, held in many.items():
        at = np.flatnonzero(held)
        columns = [np.full(len(at), k, np.int32), at.astype(np.int32), held[at]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["language", "bucket", "many"])


def fit(rows: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", ids: int = TRAIN_IDS) -> Model:
    """Learn from (lang, text, key) rows."""
    prepare(rows.sparkSession)
    rows = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("at"))
    # One row for each language; one more than allowed is enough to know that there are too many.
    seen = sorted((r.lang, r.n) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect())
    if len(seen) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    names = [name for name, _ in seen]
    if not names:
        return Model([], np.zeros(0), np.zeros((BUCKETS, 0), np.float32))
    number = F.create_map(*[F.lit(x) for k, name in enumerate(names) for x in (name, k)])[F.col("lang")]
    limit = F.create_map(*[F.lit(x) for name, n in seen for x in (name, min(1.0, ids / n))])[F.col("lang")]
    chosen = rows.where(F.col("at").bitwiseAND(F.lit((1 << 31) - 1)) < limit * float(1 << 31))
    chosen = chosen.groupBy(number.alias("language"), "at").agg(F.min("text").alias("text")).select("language", "text")
    counted = chosen.mapInArrow(count_buckets, "language int, bucket int, many long").groupBy("language", "bucket").agg(F.sum("many").alias("many"))
    got: pd.DataFrame = counted.toPandas()  # one row at most for each language and bucket
    many = np.full((BUCKETS, len(names)), SMOOTH)
    many[got["bucket"].to_numpy(np.int64), got["language"].to_numpy(np.int64)] += got["many"].to_numpy()
    priors = np.log(np.array([n for _, n in seen], np.float64))
    return Model(names, priors - np.log(sum(n for _, n in seen)), np.log(many / many.sum(axis=0)).astype(np.float32))


def predict(model: Model, text: Column | str, spark: SparkSession) -> Column:
    """Struct of the language and its probability for each text."""
    shared = spark.sparkContext.broadcast(model)  # MOST_LANGUAGES * BUCKETS * 4 bytes at most

    def answer(texts: pa.Array) -> pa.Array:
        column = (texts if texts.type == pa.string() else texts.cast(pa.string())).fill_null("")
        names, scores = [], []
        for got in shared.value.probabilities(column):
            best = None if got is None else int(got.argmax())
            names.append(UNKNOWN if best is None else shared.value.languages[best])
            scores.append(0.0 if best is None else float(got[best]))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return F.arrow_udf(answer, "struct<lang:string,score:double>")(text)


def identify(docs: DataFrame, labelled: DataFrame, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the language of each whole text and its probability, learned from (lang, text, doc_id) rows."""
    prepare(docs.sparkSession)
    found = docs.withColumn("__found", predict(fit(labelled), text, docs.sparkSession))
    return found.withColumns({lang: F.col("__found.lang"), score: F.col("__found.score")}).drop("__found")


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether the id's crc32 is of the fold that nothing is learned from; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


@query("op11_language")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    labelled = docs.where(~held_out()).select("doc_id", "lang", "text")
    found = identify(docs.select("doc_id", "text"), labelled)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

"""Benchmark decontamination: BM25 over an inverted index of test items with block-max WAND, then verification.

Test items are cut into segments of at most ``SEGMENT`` words. Postings hold BM25 impacts divided by the segment's own
score, so a passage scores the weighted share of a segment's words that it has, from 0 to 1. Segments are numbered;
blocks of consecutive numbers have, for each word, the largest impact inside. Every window of 2 * ``SEGMENT`` words
(step ``SEGMENT``) of every document is a query. Blocks whose maxima sum to less than the threshold are skipped for all
windows of a slice at once; in the blocks left, WAND moves the posting lists from pivot to pivot.

Retrieved items are verified against the whole document: of the word n-grams (five words, or all words of a shorter
part) of the question and of the answer, the shares ``OVERLAP`` must each stand in it. Case does not count.

The index is broadcast in parts of bounded size (``INDEX_ITEMS`` items, ``INDEX_BYTES`` of text); a larger benchmark takes more parts, each
against all documents. The number of segments, their mean length and the document frequencies are those of all items
(counted by Spark), so scores do not depend on the parts. One part is in memory at a time: its hits are saved and its
broadcast is freed before the next. Null and empty items and texts match nothing. Repeated items each match; repeated rows give
repeated results. An empty table, on either side, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import prepare, query, save, shingle_hashes, slices, small, table, text_column, utf8, words

SEGMENT = 64
GRAM = 5
THRESHOLD = 0.5
OVERLAP = 0.6
#: Last share of an item's words that is its answer, where the benchmark has no column for it.
ANSWER_SHARE = 0.25
K1, B = 1.2, 0.75
BLOCKS = 64
INDEX_ITEMS = 50_000
INDEX_BYTES = 64_000_000


def split_item(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Question and answer of an item that has one text: its last words are the answer."""
    cut = len(hashes) - int(np.ceil(len(hashes) * ANSWER_SHARE))
    return hashes[:cut], hashes[cut:]


def grams(hashes: np.ndarray) -> tuple[int, np.ndarray]:
    """Length and distinct hashes of the n-grams of a part."""
    n = min(GRAM, len(hashes))
    return n, np.unique(shingle_hashes(hashes, n)) if n else hashes


@dataclass(frozen=True)
class Counts:
    """Of all items: number of segments, their mean length, and in how many segments each word of a part stands."""

    segments: int
    mean: float
    words: np.ndarray  # sorted
    df: np.ndarray


class Index:
    """Inverted index of the segments of some test items; ``counts`` is for items that are a part of more."""

    def __init__(self, ids: list[int], questions: list[np.ndarray], answers: list[np.ndarray], counts: Counts | None = None) -> None:
        self.ids = np.array(ids, np.int64)
        self.parts = [(grams(q), grams(a)) for q, a in zip(questions, answers, strict=True)]
        item, bodies = [], []
        for k, whole in enumerate(np.concatenate(x) for x in zip(questions, answers, strict=True)):
            for low in range(0, len(whole), SEGMENT):
                item.append(k)
                bodies.append(whole[low : low + SEGMENT])
        self.item = np.array(item, np.int64)
        n = len(bodies)
        lengths = np.array([len(b) for b in bodies], np.float64)
        pairs = np.concatenate([np.stack([b, np.full(len(b), k, np.uint64)]) for k, b in enumerate(bodies)], axis=1) if n else np.zeros((2, 0), np.uint64)
        pairs, tf = np.unique(pairs, axis=1, return_counts=True)
        self.words, term, df = np.unique(pairs[0], return_inverse=True, return_counts=True)
        segment = pairs[1].astype(np.int64)
        total, mean = n, lengths.mean() if n else 1.0
        if counts is not None:
            total, mean, df = counts.segments, counts.mean, counts.df[np.searchsorted(counts.words, self.words)]
        idf = np.log1p((total - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * lengths / max(1.0, mean))
        impact = idf[term] * tf * (K1 + 1) / (tf + norm[segment]) if n else np.zeros(0)
        own = np.bincount(segment, weights=impact, minlength=n)
        self.segment, self.impact = segment, impact / own[segment]
        self.first = np.searchsorted(term, np.arange(len(self.words) + 1))
        self.width = max(1, -(-n // BLOCKS))
        self.block_max = np.zeros((len(self.words), max(1, -(-n // self.width))), np.float32)
        np.maximum.at(self.block_max, (term, segment // self.width), (self.impact * (1 + 1e-6)).astype(np.float32))

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word in the index, or -1."""
        if not len(self.words):
            return np.full(len(hashes), -1)
        at = np.searchsorted(self.words, hashes)
        at[at == len(self.words)] = 0
        return np.where(self.words[at] == hashes, at, -1)

    def wand(self, terms: np.ndarray, blocks: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """(segment, score) of all segments in ``blocks`` that score ``threshold`` or more for these distinct words."""
        out = []
        for block in blocks.tolist():
            end = (block + 1) * self.width
            lists = []  # [segment where the list stands, position, last position, largest impact in the block]
            for t in terms[self.block_max[terms, block] > 0].tolist():
                low, high = self.first[t], self.first[t + 1]
                begin = low + int(np.searchsorted(self.segment[low:high], block * self.width))
                stop = low + int(np.searchsorted(self.segment[low:high], end))
                lists.append([int(self.segment[begin]), begin, stop, float(self.block_max[t, block])])
            while lists:
                lists.sort()
                total, pivot = 0.0, None
                for x in lists:
                    total += x[3]
                    if total >= threshold:
                        pivot = x[0]
                        break
                if pivot is None:
                    break
                if lists[0][0] == pivot:
                    score = sum(float(self.impact[x[1]]) for x in lists if x[0] == pivot)
                    if score >= threshold:
                        out.append((pivot, score))
                    target = pivot + 1
                else:
                    target = pivot
                for x in lists:
                    if x[0] < target:
                        x[1] += int(np.searchsorted(self.segment[x[1] : x[2]], target))
                        x[0] = int(self.segment[x[1]]) if x[1] < x[2] else end
                lists = [x for x in lists if x[1] < x[2]]
        return out

    def retrieve(self, hashes: np.ndarray, first: np.ndarray, threshold: float) -> dict[tuple[int, int], float]:
        """Best score for each (row, item) that some window of the row retrieves."""
        known = self.lookup(hashes)
        hit = np.flatnonzero(known >= 0)
        if not len(hit):
            return {}
        rows = len(first) - 1
        row = np.searchsorted(first, hit, "right") - 1
        step = (hit - first[row]) // SEGMENT
        # Steps of all rows are numbered on; a window is a step and the one after it.
        base = np.concatenate([[0], np.cumsum((np.diff(first) + SEGMENT - 1) // SEGMENT + 1)])
        window = base[row] + step + 1
        key = np.unique(np.concatenate([window, window - 1]) * len(self.words) + np.tile(known[hit], 2))
        window, term = key // len(self.words), key % len(self.words)
        begin = np.flatnonzero(np.diff(window, prepend=-1))
        bounds = np.add.reduceat(self.block_max[term], begin, axis=0)
        found: dict[tuple[int, int], float] = {}
        ends = np.append(begin[1:], len(term))
        for k in np.flatnonzero((bounds >= threshold).any(axis=1)).tolist():
            at = int(np.searchsorted(base, window[begin[k]], "right")) - 1
            for segment, score in self.wand(term[begin[k] : ends[k]], np.flatnonzero(bounds[k] >= threshold), threshold):
                place = (min(at, rows - 1), int(self.item[segment]))
                found[place] = max(score, found.get(place, 0.0))
        return found

    def overlaps(self, item: int, hashes: np.ndarray) -> tuple[float, float]:
        """Shares of the n-grams of question and answer that stand in these words; an empty part counts as there."""
        out = []
        for n, want in self.parts[item]:
            out.append(float(np.isin(want, shingle_hashes(hashes, n)).mean()) if n else 1.0)
        return out[0], out[1]


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of items (part, question, answer): segments that hold each word; a row without a word has all segments and words."""
    for batch in batches:
        part = batch.column(0).to_numpy(zero_copy_only=False)
        pairs = [x or "" for both in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True) for x in both]
        data, offsets = utf8(pa.array(pairs, pa.string()))
        for i, j in slices(offsets[::2]):
            cut = offsets[2 * i : 2 * j + 1]
            _, _, hashes, first = words(data[cut[0] : cut[-1]], cut - cut[0])
            first = first[::2]
            size = np.diff(first)
            row = np.repeat(np.arange(j - i), size)
            segments = (size + SEGMENT - 1) // SEGMENT
            base = np.cumsum(segments) - segments
            segment = base[row] + (np.arange(len(hashes)) - first[row]) // SEGMENT
            distinct = np.unique(np.stack([hashes, segment.astype(np.uint64)]), axis=1)
            owner = part[i:j][np.repeat(np.arange(j - i), segments)[distinct[1].astype(np.int64)]]
            (word, owner), df = np.unique(np.stack([distinct[0], owner.astype(np.uint64)]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*owner.astype(np.int64).tolist(), None], pa.int64()),
                    pa.array([*word.view(np.int64).tolist(), None], pa.int64()),
                    pa.array([*df.tolist(), int(segments.sum())], pa.int64()),
                    pa.array([*np.zeros(len(df), np.int64).tolist(), len(hashes)], pa.int64()),
                ],
                names=["part", "word", "df", "words"],
            )


def build_index(items: list[tuple[int, str, str | None]], counts: Counts | None = None) -> Index:
    """Index of (id, question, answer); without answers, an item's last words are."""
    ids, questions, answers = [], [], []
    for item, question, answer in items:
        data, offsets = utf8(pa.array([question or "", answer or ""], pa.string()))
        _, _, hashes, first = words(data, offsets)
        if not len(hashes):
            continue
        parts = (hashes[: first[1]], hashes[first[1] :]) if answer is not None else split_item(hashes)
        ids.append(item)
        questions.append(parts[0])
        answers.append(parts[1])
    return Index(ids, questions, answers, counts)


FOUND = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def search(docs: DataFrame, shared: Broadcast, doc_id: str, text: str, threshold: float, overlap: float) -> DataFrame:
    """Hits of the documents in the broadcast index (a part of bounded size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, offsets = utf8(text_column(batch, "text"))
            out = []
            for i, j in slices(offsets):
                base = offsets[i]
                _, _, hashes, first = words(data[base : offsets[j]], offsets[i : j + 1] - base)
                for (row, item), score in sorted(index.retrieve(hashes, first, threshold).items()):
                    question, answer = index.overlaps(item, hashes[first[row] : first[row + 1]])
                    if question >= overlap and answer >= overlap:
                        out.append((ids[i + row], int(index.ids[item]), round(score, 9), question, answer))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                names = [x.split()[0] for x in FOUND.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.lower(text).alias("text")).mapInArrow(run, FOUND)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    question: str = "text",
    answer: str | None = None,
    threshold: float = THRESHOLD,
    overlap: float = OVERLAP,
) -> DataFrame:
    """Rows of ``FOUND``: each test item that stands in a document, with its BM25 share and verified overlaps."""
    prepare(docs.sparkSession)
    items = benchmark.select(
        F.col(item_id).cast("long").alias("item"), F.lower(question).alias("question"), F.lower(F.col(answer) if answer else F.lit(None).cast("string")).alias("answer")
    )
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.concat_ws(" ", "question", "answer"))), F.lit(0)).alias("b")).first()
    parts = max(1, -(-size.n // INDEX_ITEMS), -(-size.b // INDEX_BYTES))
    context = docs.sparkSession.sparkContext
    order = ["item", "question"]
    if parts == 1:
        index = build_index([(r.item, r.question, r.answer) for r in items.orderBy(*order).collect()])
        return search(docs, context.broadcast(index), doc_id, text, threshold, overlap)
    dealt = items.withColumn("part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    dealt = save(dealt.repartition("part").sortWithinPartitions("part", *order))
    seen = save(dealt.select("part", "question", "answer").mapInArrow(count_words, "part long, word long, df long, words long"))
    whole = seen.where("word is null").agg(F.sum("df").alias("segments"), F.sum("words").alias("words")).first()
    each = seen.where("word is not null")
    df = each.select("part", "word").distinct().join(each.groupBy("word").agg(F.sum("df").alias("df")), "word")
    df = save(df.repartition("part").sortWithinPartitions("part", "word"))
    found = []
    for k in range(parts):
        known = df.where(F.col("part") == k).select("word", "df").toArrow()
        word, many = (known.column(c).to_numpy() for c in ("word", "df"))
        at = np.argsort(word.view(np.uint64))
        counts = Counts(whole.segments, whole.words / max(1, whole.segments), word.view(np.uint64)[at], many[at])
        rows = dealt.where(F.col("part") == k).orderBy(*order).collect()
        shared = context.broadcast(build_index([(r.item, r.question, r.answer) for r in rows], counts))
        found.append(save(search(docs, shared, doc_id, text, threshold, overlap)))
        shared.destroy()
    return reduce(DataFrame.unionByName, found)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no test item."""
    gone = save(contaminated(docs, benchmark).select(F.col("doc_id").alias("__gone")).distinct())
    return docs.join(small(gone, gone.count()), F.col("doc_id").cast("long") == F.col("__gone"), "left_anti")


SQL = f"""
WITH item AS (
  SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM benchmark),
doc AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
word AS (SELECT item_id, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM item),
tf AS (SELECT item_id, i // {SEGMENT} AS part, x, count(*) AS tf FROM word GROUP BY ALL),
size AS (SELECT item_id, part, sum(tf) AS n FROM tf GROUP BY ALL),
total AS (SELECT count(*) AS segments, avg(n) AS mean FROM size),
df AS (SELECT x, count(*) AS df FROM tf GROUP BY x),
impact AS (
  SELECT item_id, part, x,
    ln(1 + (segments - df + 0.5) / (df + 0.5)) * tf * {K1 + 1} / (tf + {K1} * ({1 - B} + {B} * n / greatest(mean, 1))) AS v
  FROM tf JOIN size USING (item_id, part) JOIN df USING (x), total),
share AS (SELECT *, v / sum(v) OVER (PARTITION BY item_id, part) AS s FROM impact),
place AS (SELECT doc_id, unnest(w) AS x, (generate_subscripts(w, 1) - 1) // {SEGMENT} AS step FROM doc),
passage AS (SELECT DISTINCT doc_id, step + d AS p, x FROM place, (SELECT unnest([0, 1]) AS d)),
score AS (SELECT doc_id, p, item_id, part, sum(s) AS s FROM passage JOIN share USING (x) GROUP BY ALL),
hit AS (SELECT doc_id, item_id, max(s) AS score FROM score WHERE s >= {THRESHOLD} GROUP BY ALL),
cut AS (SELECT item_id, w, len(w) - CAST(ceil(len(w) * {ANSWER_SHARE}) AS BIGINT) AS q FROM item WHERE len(w) > 0),
half AS (
  SELECT item_id, 'q' AS half, w[1:q] AS w FROM cut WHERE q > 0 UNION ALL
  SELECT item_id, 'a', w[q + 1:] FROM cut),
gram AS (
  SELECT DISTINCT item_id, half, least({GRAM}, len(w)) AS n,
    unnest(list_transform(range(1, len(w) - least({GRAM}, len(w)) + 2), lambda i: array_to_string(w[i:i + least({GRAM}, len(w)) - 1], ' '))) AS g
  FROM half),
seen AS (
  SELECT doc_id, item_id, half, avg(CASE WHEN contains(' ' || array_to_string(w, ' ') || ' ', ' ' || g || ' ') THEN 1.0 ELSE 0.0 END) AS o
  FROM hit JOIN gram USING (item_id) JOIN doc USING (doc_id) GROUP BY ALL),
overlap AS (
  SELECT doc_id, item_id, coalesce(max(CASE WHEN half = 'q' THEN o END), 1.0) AS question_overlap,
    coalesce(max(CASE WHEN half = 'a' THEN o END), 1.0) AS answer_overlap
  FROM seen GROUP BY ALL)
SELECT doc_id, item_id, round(score, 9) AS score, CAST(question_overlap AS DOUBLE) AS question_overlap,
  CAST(answer_overlap AS DOUBLE) AS answer_overlap
FROM overlap JOIN hit USING (doc_id, item_id) WHERE question_overlap >= {OVERLAP} AND answer_overlap >= {OVERLAP}"""


@query("op2_decontamination", SQL)
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return contaminated(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark"))

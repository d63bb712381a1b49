"""License scans by a positional index of rare words.

The words of the license templates are counted over all documents (one count per document). Each template is indexed
by its ``RARE`` words of highest idf, with their positions. All words of a file are looked up there, so several licences
in one file do not take words from each other; each posting gives an alignment (template, shift of the template in the file), and alignments on which at least two
different rare words agree are kept. An alignment counts if every mandatory key phrase of its template stands at its
place. Its score is the idf-weighted share of template words found in place.

Null and empty texts have no words, no labels and score 0. Repeated rows give repeated results. Other columns of the
input are kept; a column named like the result is replaced. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import prepare, query, shingle_hashes, slices, table, text_column, utf8, word_hash, words

# The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Templates as (label, opening words of the public text, mandatory key phrases).
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("mit", "released under the mit license", ("mit license",)),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        ("permission is hereby granted free of charge",),
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms",),
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        ("permission to use copy modify", "with or without fee is hereby granted"),
    ),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license", "v 2 0")),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)
RARE = 6
AGREE = 2
#: Score of a file that has a base phrase but no accepted alignment.
BASE_SCORE = 0.5

VOCABULARY = sorted({w for _, text, _ in TEMPLATES for w in text.split()})
HASHES = np.array([word_hash(w) for w in VOCABULARY], np.uint64)
BY_HASH = np.argsort(HASHES)
RESULT = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"


def vocabulary_ids(hashes: np.ndarray) -> np.ndarray:
    """Position in ``VOCABULARY`` of each word, or -1."""
    at = np.searchsorted(HASHES[BY_HASH], hashes)
    at[at == len(HASHES)] = 0
    ids = BY_HASH[at]
    return np.where(HASHES[ids] == hashes, ids, -1)


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[int, np.ndarray]:
    """Number of documents, and in how many each template word stands (a fixed number of counts comes back)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = 0, np.zeros(len(VOCABULARY), np.int64)
        for batch in batches:
            data, offsets = utf8(text_column(batch, "text"))
            total += len(offsets) - 1
            for i, j in slices(offsets):
                base = offsets[i]
                _, _, hashes, first = words(data[base : offsets[j]], offsets[i : j + 1] - base)
                ids = vocabulary_ids(hashes)
                row = np.repeat(np.arange(j - i), np.diff(first))
                pairs = np.unique(row[ids >= 0] * len(VOCABULARY) + ids[ids >= 0])
                seen += np.bincount(pairs % len(VOCABULARY), minlength=len(VOCABULARY))
        if total:
            out = {"id": np.arange(-1, len(seen)), "n": np.concatenate([[total], seen])}
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in out.items()})

    counts = docs.select(F.col(text).alias("text")).mapInArrow(count, "id bigint, n bigint")
    got = {r.id: r.n for r in counts.groupBy("id").agg(F.sum("n").alias("n")).collect()}
    return got.get(-1, 0), np.array([got.get(k, 0) for k in range(len(VOCABULARY))], np.int64)


@dataclass(frozen=True)
class Index:
    """Postings of the rare words of each template, and what is needed to verify an alignment."""

    idf: np.ndarray
    posting_word: np.ndarray  # sorted
    posting_template: np.ndarray
    posting_at: np.ndarray
    template_ids: list[np.ndarray]
    phrase_at: list[np.ndarray]  # template positions covered by key phrases
    labels: list[str]


def build_index(total: int, df: np.ndarray, rare: int = RARE) -> Index:
    idf = np.log((total + 1) / (df + 0.5)) + 1e-6
    idf = np.maximum(idf, 1e-6)
    number = {w: k for k, w in enumerate(VOCABULARY)}
    postings, ids, phrases = [], [], []
    for t, (_, text, keys) in enumerate(TEMPLATES):
        body = text.split()
        ids.append(np.array([number[w] for w in body]))
        rarest = sorted(set(ids[-1].tolist()), key=lambda k: (-idf[k], k))[:rare]
        postings += [(k, t, p) for p, k in enumerate(ids[-1].tolist()) if k in rarest]
        places: set[int] = set()
        for key in keys:
            want = key.split()
            start = next(p for p in range(len(body)) if body[p : p + len(want)] == want)
            places |= set(range(start, start + len(want)))
        phrases.append(np.array(sorted(places)))
    word, template, at = (np.array(x) for x in zip(*sorted(postings), strict=True))
    return Index(idf, word, template, at, ids, phrases, [x[0] for x in TEMPLATES])


def _base_places(hashes: np.ndarray, row: np.ndarray) -> list[tuple[np.ndarray, str]]:
    """Word positions (in the slice) where each base phrase begins, within one row."""
    out = []
    for phrase, label in BASE.items():
        parts = np.array([word_hash(w) for w in phrase.split()], np.uint64)
        k = len(parts)
        at = np.flatnonzero(shingle_hashes(hashes, k) == shingle_hashes(parts, k)[0])
        out.append((at[row[at] == row[at + k - 1]] if len(at) else at, label))
    return out


def _alignments(index: Index, ids: np.ndarray, row: np.ndarray) -> list[tuple[int, int, float]]:
    """(row, template, score) of accepted alignments."""
    hit = np.flatnonzero(ids >= 0)
    if not len(hit):
        return []
    size, templates = len(VOCABULARY), len(index.template_ids)
    low = np.searchsorted(index.posting_word, ids[hit], "left")
    many = np.searchsorted(index.posting_word, ids[hit], "right") - low
    which = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
    at = np.repeat(hit, many)
    shift = at - index.posting_at[which]
    keep = shift >= 0
    keep[keep] &= row[shift[keep]] == row[at[keep]]
    at, which, shift = at[keep], which[keep], shift[keep]
    key = np.unique((shift * templates + index.posting_template[which]) * size + ids[at])
    place, votes = np.unique(key // size, return_counts=True)
    place = place[votes >= AGREE]
    out = []
    for t, want in enumerate(index.template_ids):
        start = place[place % templates == t] // templates
        # Word by word of the key phrases, rarest first: loose common words end here.
        phrase = index.phrase_at[t]
        for p in phrase[np.argsort(-index.idf[want[phrase]], kind="stable")].tolist():
            start = start[start + p < len(ids)]
            start = start[(ids[start + p] == want[p]) & (row[start + p] == row[start])]
        weight = index.idf[want]
        for k in start.tolist():
            there = np.zeros(len(want), bool)
            got = ids[k : k + len(want)]
            there[: len(got)] = (got == want[: len(got)]) & (row[k : k + len(want)] == row[k])
            out.append((int(row[k]), t, float((weight * there).sum() / weight.sum())))
    return out


def scan(index: Index, texts: pa.Array) -> list[dict[str, object]]:
    """What ``RESULT`` names, for each text."""
    texts = texts if texts.type == pa.string() else texts.cast(pa.string())
    data, offsets = utf8(texts.fill_null("") if texts.null_count else texts)
    out: list[dict[str, object]] = []
    for i, j in slices(offsets):
        base = offsets[i]
        _, _, hashes, first = words(data[base : offsets[j]], offsets[i : j + 1] - base)
        row = np.repeat(np.arange(j - i), np.diff(first))
        found = [
            {"n_words": n, "n_base": 0, "first_word": None, "last_word": None, "base": set(), "own": set(), "score": 0.0}
            for n in np.diff(first).tolist()
        ]
        for places, label in _base_places(hashes, row):
            for p, k in zip((places - first[row[places]]).tolist(), row[places].tolist(), strict=True):
                x = found[k]
                x["n_base"] += 1
                x["first_word"] = p if x["first_word"] is None else min(p, x["first_word"])
                x["last_word"] = p if x["last_word"] is None else max(p, x["last_word"])
                x["base"].add(label)
                x["score"] = BASE_SCORE
        for k, t, score in _alignments(index, vocabulary_ids(hashes), row):
            found[k]["own"].add(index.labels[t])
            found[k]["score"] = max(found[k]["score"], min(1.0, score))
        for x in found:
            base_labels, own = x.pop("base"), x.pop("own")
            out.append(x | {"base_labels": ",".join(sorted(base_labels)), "labels": ",".join(sorted(base_labels | own))})
    return out


def license_columns(index: Index, text: Column | str) -> Column:
    """A struct of ``RESULT`` for each text."""
    kind = pa.struct(
        [(n, {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}[t]) for n, t in (x.split() for x in RESULT.split(", "))]
    )

    def look(texts: pa.Array) -> pa.Array:
        return pa.array(scan(index, texts), kind)

    return F.arrow_udf(look, RESULT)(text)


def scan_licenses(docs: DataFrame, text: str = "text", rare: int = RARE) -> DataFrame:
    """``docs`` with the columns of ``RESULT``; the index takes its idf from all of ``docs``."""
    prepare(docs.sparkSession)
    index = build_index(*document_frequencies(docs, text), rare)
    names = [x.split()[0] for x in RESULT.split(", ")]
    out = docs.withColumn("__license", license_columns(index, text))
    return out.withColumns({n: F.col(f"__license.{n}") for n in names}).drop("__license")


@query("op8_license_scan")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return scan_licenses(table(spark, sf, "documents").select("doc_id", "text")).drop("text")

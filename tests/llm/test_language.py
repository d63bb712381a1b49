"""Language identification against a plain version and held-out accuracy."""

import math
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from tidemark.llm import language
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
MASK = (1 << 64) - 1


def plain_bucket(gram):
    x = (len(gram) + sum(ord(c) * p for c, p in zip(gram, language.PLACES))) & MASK
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return (x ^ x >> 31) >> 48


def plain_grams(text):
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    line = " " + " ".join(words) + " " if words else ""
    return Counter(plain_bucket(line[i : i + k]) for k in (1, 2, 3) for i in range(len(line) - k + 1))


def plain_answers(rows):
    many, docs = defaultdict(Counter), Counter()
    for doc_id, text, lang in rows:
        if lang is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 4 != 2:
            many[lang] += plain_grams(text)
            docs[lang] += 1
    whole = {k: sum(c.values()) + language.SMOOTH * 65536 for k, c in many.items()}
    for doc_id, text, _ in rows:
        got = plain_grams(text)
        if not got or not docs:
            yield doc_id, "und", 0.0
            continue
        score = {
            k: math.log(docs[k] / sum(docs.values())) + sum(n * math.log((many[k][b] + language.SMOOTH) / whole[k]) for b, n in got.items()) for k in sorted(docs)
        }
        best = max(score, key=score.get)
        yield doc_id, best, 1 / sum(math.exp(s - score[best]) for s in score.values())


ODD = [(9001, None, "en"), (9002, "", None), (9003, "12 -- 34 \n", "de"), (9004, "é", None), (9005, "Ñ ñandú", "es"), (9006, "İİ ǅ \U00010400x", None), (9007, "a", None)]


def test_query_equals_plain_version(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").where("length(text) < 3000")
    docs = docs.union(spark.createDataFrame(ODD, docs.schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = {d: (k, s) for d, k, s in plain_answers([tuple(r) for r in docs.collect()])}
    out = QUERIES["op11_language"](spark, str(tmp_path))
    assert out.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    rows = out.collect()
    assert len(rows) == len(want)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert r.lang_pred == want[r.doc_id][0]
        assert r.score == pytest.approx(want[r.doc_id][1], abs=1e-3)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [r for r in QUERIES["op11_language"](spark, sf).collect() if r.held_out and truth[r.doc_id] is not None]
    wrong = [r for r in rows if r.lang_pred != truth[r.doc_id]]
    assert len(rows) > 200 and len(wrong) <= 0.01 * len(rows), wrong


def test_grams_do_not_cross_texts():
    texts = ["ab", "", "b", " c  d. ", "é1é"]
    for text, got in zip(texts, language.grams(pa.array(texts)), strict=True):
        assert Counter(got.tolist()) == plain_grams(text)


def test_copies_of_an_id_count_once_and_ids_are_bounded(spark):
    rows = [("en", "the cat", 1)] * 50 + [("fr", "le chat", k) for k in range(400)] + [("xx", None, 1)]
    many = language.fit(spark.createDataFrame(rows, "lang string, text string, doc_id long"), ids=100)
    assert many.languages == ["en", "fr"]
    once = language.fit(spark.createDataFrame(rows[:1] + rows[50:], "lang string, text string, doc_id long"), ids=10_000)
    assert (many.matrix[:, 0] == once.matrix[:, 0]).all()
    # The smallest probability is that of the smoothing alone: it tells how many n-grams were counted.
    counted = language.SMOOTH / math.exp(many.matrix[:, 1].min()) - language.SMOOTH * 65536
    texts = counted / sum(plain_grams("le chat").values())
    assert 60 < texts < 140


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 1)
    with pytest.raises(ValueError):
        language.fit(spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "lang string, text string, doc_id long"))

"""Periodic runs against a scan of every lag at every place."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import periodic
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_runs(words):
    """(start, length, period) of all runs, by looking at every lag."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(12, 2 * q):
                best.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in best.items())


def plain_collapse(words, runs):
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def of(texts):
    return periodic.runs_of(pa.array(texts, pa.string())).to_pylist()


def check(texts):
    for text, got in zip(texts, of(texts), strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = plain_runs(words)
        assert [(r["start"], r["length"], r["period"]) for r in got["runs"]] == sorted(runs, key=lambda r: (r[0], r[2]))
        assert got["collapsed"] == plain_collapse(words, runs)


@pytest.mark.parametrize("letters", [1, 2, 3, 5, 40])
def test_random_words(letters):
    rng = random.Random(letters)
    texts = []
    for _ in range(60):
        words = [f"w{rng.randrange(letters)}" for _ in range(rng.randrange(1, 160))]
        for _ in range(rng.randrange(3)):
            p, at = rng.randrange(1, 20), rng.randrange(len(words))
            words[at:at] = (words[at : at + p] * 9)[: rng.randrange(2, 60)]
        texts.append(" ".join(words))
    check(texts)


def test_special_texts():
    thue = [0]
    while len(thue) < 512:
        thue += [1 - x for x in thue]
    fib = ["a", "ab"]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    check([None, "", " \t\r\n", "a " * 11, "a " * 12, "\x0ba\x0c" * 500, "x " + "a b " * 6 + "a y", " ".join(map(str, thue)), " ".join(fib[-1])])
    check([" a b  " * 8, "a\x1fb " * 13, "\x1c a " * 7])


@pytest.mark.parametrize("rounds", [0, 1, 8])
def test_splitting_ends_alike_from_both_ways(monkeypatch, rounds):
    peel = " ".join(f"{k} {k + 2}" for k in range(400))
    texts = [peel, "q r s t u v w x " * 9 + peel + " a b c d e f g" * 7]
    monkeypatch.setattr(periodic, "ROUNDS", rounds)
    check(texts)


def test_small_slices_of_pairs(monkeypatch):
    monkeypatch.setattr(periodic, "PAIRS", 7)
    rng = random.Random(7)
    check([" ".join(rng.choice("ab") for _ in range(150)) for _ in range(20)])


def test_long_texts_do_not_take_the_square():
    rng = np.random.default_rng(1)
    texts = ["same " * 300_000, " ".join(f"word{i % 997} and{i % 31}" for i in range(100_000)), " ".join(map(str, rng.integers(0, 3, 200_000)))]
    start = time.perf_counter()
    got = of(texts)
    assert time.perf_counter() - start < 60
    assert [(r["start"], r["length"], r["period"]) for r in got[0]["runs"]] == [(0, 300_000, 1)] and got[0]["collapsed"] == "same"
    assert [(r["start"], r["length"], r["period"]) for r in got[1]["runs"]] == [(0, 200_000, 2 * 997 * 31)]


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{m},{q}\n" for s, m, q in runs), plain_collapse(words, runs))]
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, *sha)


def test_query_equals_plain_version(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    more = [(10_000 + k, " ".join(f"{w}{k % 3}" for w in range(k % 50))) for k in range(300)] + [(None, "a b " * 9), (20, None), (21, "")]
    docs = docs.where("length(text) < 9000").union(spark.createDataFrame(more, docs.schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op12_periodic_runs"](spark, str(tmp_path))
    assert [t for _, t in out.dtypes] == ["bigint"] * 6 + ["string"] * 2
    want = {str(plain_row(r.doc_id, r.text)) for r in docs.collect()}
    assert {str(tuple(r)) for r in out.collect()} == want
    assert sum(r.n_runs > 0 for r in out.collect()) > 30

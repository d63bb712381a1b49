"""The forest join against all pairs, with large groups of near copies dealt over blocks, and components against chains."""

import random
import re

import pytest

from tidemark.llm import near_duplicates as nd
from tidemark.llm.components import components

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sets_of(rows):
    out = {}
    for i, text in rows:
        w = WORD.findall((text or "").lower())
        if w:
            out[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    return out


def plain(rows):
    """(class, representative, copies, links) of each id by comparing all pairs."""
    sets = sets_of(rows)
    ids = sorted(sets)
    links = {i: set() for i, _ in rows}
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i].add(j)
                links[j].add(i)
    out, root = {}, {}
    for i, _ in sorted(rows):
        if i not in root:
            stack = [i]
            while stack:
                k = stack.pop()
                if k not in root:
                    root[k] = i
                    stack += links[k]
        same = [j for j in ids if i in sets and sets[j] == sets[i]] or [i]
        out[i] = (root[i], min(same), len(same), len(links[i]))
    return out


def corpus(seed, groups=12, near=60):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(4000)]
    rows, i = [], 0
    for g in range(groups):
        base = r.choices(words, k=r.choice([3, 40, 120, 300]))
        for _ in range(near if g == 0 else r.randint(1, 8)):
            text = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                text[r.randrange(len(text))] = r.choice(words)
            rows.append((i, " ".join(text)))
            i += 1
    return [*rows, (i, None), (i + 1, ""), (i + 2, "..."), (i + 3, "Two words"), (i + 4, "two, WORDS")]


@pytest.mark.parametrize("block", [512, 7])
def test_equals_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(nd, "BLOCK_ROWS", block)
    rows = corpus(block)
    got = nd.jaccard_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.id: (r.class_id, r.rep_id, r.n_copies, r.n_links) for r in got} == plain(rows)


def pairs_of(n, r, words):
    """``n`` pairs of texts, each of similarity 0.8: 40 of 50 five-word shingles are common."""
    rows = []
    for k in range(n):
        base = r.choices(words, k=49)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join([*base[:24], f"other{k}", *base[25:]]))]
    return rows


def test_a_large_group_does_not_hide_the_misses_of_pairs(spark):
    r = random.Random(3)
    words = [f"w{k}" for k in range(9000)]
    rows = pairs_of(1200, r, words)
    base = r.choices(words, k=300)
    rows += [(10_000 + k, " ".join([*base[: k + 5], f"new{k}", *base[k + 6 :]])) for k in range(280)]
    links = {x.id: x.n_links for x in nd.jaccard_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    lost = [i for i, n in links.items() if i < 10_000 and n != 1]
    assert len(lost) <= 2 and all(links[10_000 + k] == 279 for k in range(280))


def test_blocks_without_members_are_not_counted_twice(spark, monkeypatch):
    """Two members dealt to two blocks: in about half of the pairs both fall into one of them."""
    monkeypatch.setattr(nd, "BLOCK_ROWS", 1)
    rows = pairs_of(24, random.Random(4), [f"w{k}" for k in range(9000)])
    got = nd.jaccard_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.id: (r.class_id, r.rep_id, r.n_copies, r.n_links) for r in got} == plain(rows)


def test_links_across_borders_of_sorted_partitions(spark):
    """Two hundred near copies in many partitions: runs go on from one partition to the next."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        rows = corpus(5, groups=2, near=200)
        got = nd.jaccard_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert {r.id: (r.class_id, r.rep_id, r.n_copies, r.n_links) for r in got} == plain(rows)


def test_components_of_chains_stars_and_loops(spark):
    chain = [(k, k + 1) for k in range(100, 160)]
    star = [(7, k) for k in range(200, 240)]
    edges = [*chain, *star, (7, 7), (None, 3), (1, 2), (2, 1)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = dict.fromkeys(range(100, 161), 100) | dict.fromkeys([7, *range(200, 240)], 7) | {1: 1, 2: 1}
    assert got == want


def test_one_row_of_each_class_stays(spark):
    rows = corpus(9)
    classes = plain(rows)
    kept = {r.doc_id for r in nd.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {c[0] for c in classes.values()}

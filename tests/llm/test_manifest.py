"""The manifest against a plain Merkle forest."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tidemark.llm import manifest
from tidemark.llm.queries import QUERIES


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def tree(nodes):
    """Root and, for each node, its (left, right) siblings from the bottom up."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i // 3 * 3 : i // 3 * 3 + 3]
            paths[k].append((run[: i % 3], run[i % 3 + 1 :]))
        at = [i // 3 for i in at]
        nodes = [sha(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def plain(rows):
    """Rows are (doc_id, text, lang, source, n_chars)."""
    groups = defaultdict(list)
    for d, text, lang, source, n in rows:
        before = sha(*map(field, (d, source, lang, n, text)))
        even = d is not None and zlib.crc32(str(d).encode()) % 2 == 0
        after = sha(*map(field, (d, source, lang, n, text.replace("\n", "") if even and text is not None else text)))
        groups[source].append(((d is not None, d or 0, before), d, after))
    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        groups[s].sort(key=lambda x: x[0])
        trees.append(tree([x[0][2] for x in groups[s]]))
    root, tops = tree([t[0] for t in trees])
    out = []
    for s, (sub, paths), top in zip(sources, trees, tops, strict=True):
        for (key, d, after), path in zip(groups[s], paths, strict=True):
            whole = path + top
            folded = after
            for left, right in whole:
                folded = sha(*left, folded, *right)
            out.append((d, key[2], sub, root, sha(*(x for left, right in whole for x in left + right)), folded, folded == root))
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def compare(out, rows):
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, plain(rows)))


def of_query(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{folder}/documents.parquet")
    compare(QUERIES["op13_manifest"](spark, str(folder)), rows)


def random_rows(n, sources, seed):
    rng = random.Random(seed)
    names = [None, "", "é", "z", "\U0001f600", "Z", *(f"s{k}" for k in range(sources))]
    return [
        (rng.choice([None, *range(-5, 3 * n)]), rng.choice([None, "", "a\nb", "no end", "é\n\n"]), rng.choice([None, "en"]), rng.choice(names[: sources + 2]), rng.choice([None, -1, 7]))
        for _ in range(n)
    ]


@pytest.mark.parametrize("n, sources", [(1, 0), (2, 0), (40, 4), (300, 30), (2500, 0)])
def test_query_equals_plain_forest(spark, tmp_path, n, sources):
    of_query(spark, tmp_path, random_rows(n, sources, n))


def test_many_passes_of_small_blocks(spark):
    rows = random_rows(60, 12, 3)
    docs = spark.createDataFrame(rows, SCHEMA)
    compare(manifest.manifest(docs, now={"text": manifest.without_line_ends()}, levels=1), rows)


def test_given_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    out = [tuple(r) for r in QUERIES["op13_manifest"](spark, sf).collect()]
    assert sorted(out) == sorted(plain(rows))
    assert 0 < sum(not r[-1] for r in out) < len(out)


def test_repeated_rows_are_told_apart(spark, tmp_path):
    of_query(spark, tmp_path, [(7, "same", "en", "hot", 1)] * 2000 + [(k, "x\ny", "en", f"s{k % 5}", 1) for k in range(50)])


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28, 100])
def test_queues_inside_a_block(n):
    nodes = [sha(str(k)) for k in range(n)]
    root, paths = tree(nodes)
    levels = manifest.height(n)
    top, families = manifest.climb(nodes, levels)
    assert top == root and list(families) == sorted(families)
    for k, proof in enumerate(manifest.descend(families, n, levels, None)):
        assert list(manifest.levels_of(proof)) == [("".join(a), "".join(b)) for a, b in paths[k]]
        assert manifest.read(manifest.told(proof)) == proof
        assert manifest.fold(nodes[k], proof) == root

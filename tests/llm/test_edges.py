"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import decontaminate, language, licenses, main_text, manifest, near_duplicates, packing, periodic, quality, secrets, shards, surrogates, top_k
from tidemark.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, group int, id string, part int, shard int, label int, secrets int, size int, rep int, root int"
LONG = " ".join(f"word{i % 997} and{i % 31}" for i in range(40_000))
ROWS = [
    (1, "a plain text of a few words that stands here for the others to be near", "en", "s1", 10),
    (2, None, "en", "s1", None),
    (3, "", None, None, 0),
    (4, LONG, "en", "s1", 1),
    (5, LONG, "en", None, 1),
    (6, "tie " * 30, "en", "s2", 1),
    (7, "tie " * 30, "en", "s2", 1),
    (7, "tie " * 30, "en", "s2", 1),
    (None, "a row without an id but with words enough to be read", "de", "s2", 1),
    (8, "é ß \U0001f600 .\n\n\t|", "fr", "s3", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 0.5, 1, "x", 3, 4, 1, 2, 3, 4, 5) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables of odd rows, and the same tables without rows."""
    out = {}
    plain = "doc_id long, text string, lang string, source string, n_chars long"
    tables = {
        "documents": spark.createDataFrame(ROWS, plain),
        "labels": spark.createDataFrame([(1, 1, 0), (6, 0, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, None), (2, ""), (3, "two words"), (3, "two words")], "item_id long, text string"),
        "pages": spark.createDataFrame([(1, None, None), (2, "u", ""), (2, "u", ""), (3, "u", "<p>x" * 3000)], "page_id long, url string, html string"),
        "embeddings": spark.createDataFrame(
            [(0, [1.0, 2.0]), (50, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, [1.0, 2.0]), (5, [1.0, 2.0]), (None, [1.0, 1.0]), (6, [])],
            "vec_id long, embedding array<float>",
        ),
    }
    for name in ("odd", "empty"):
        out[name] = str(tmp_path_factory.mktemp(name))
        for t, df in tables.items():
            (df if name == "odd" else df.where("false")).write.parquet(f"{out[name]}/{t}.parquet")
    return out


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables_give_empty_results(spark, folder, name):
    assert QUERIES[name](spark, folder["empty"]).count() == 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op2_decontamination", "op4_best_fit_packing", "op6_top_k", "op1_main_text"}))
def test_odd_rows_each_have_a_result(spark, folder, name):
    got = QUERIES[name](spark, folder["odd"]).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ROWS)


def test_odd_rows_where_results_are_others(spark, folder):
    odd = folder["odd"]
    assert QUERIES["op2_decontamination"](spark, odd).count() == 0
    pieces = QUERIES["op4_best_fit_packing"](spark, odd).collect()
    assert sum(r.n_words for r in pieces) == sum(len(re.findall(r"\S+", r[1] or "", re.ASCII)) for r in ROWS)
    pages = {(r.page_id, r.text, r.n_chars) for r in QUERIES["op1_main_text"](spark, odd).collect()}
    assert (1, "", 0) in pages and (2, "", 0) in pages and (3, "\n".join("x" * 3000), 5999) in pages
    top = [(r.query_id, r["rank"], r.vec_id, r.score) for r in QUERIES["op6_top_k"](spark, odd).orderBy("query_id", "rank").collect()]
    full = (256 * 256) * (1 + 4)
    assert top == [
        (0, 1, 5, full), (0, 2, 5, full), (0, 3, 50, full), (0, 4, 6, 0),
        (50, 1, 0, full), (50, 2, 5, full), (50, 3, 5, full), (50, 4, 6, 0),
    ]


def test_pipeline_on_odd_and_empty_tables(spark, folder):
    assert corpus_pipeline.run(spark, folder["empty"]).count() == 0
    assert corpus_pipeline.run(spark, folder["odd"]).columns == ["doc_id", "piece", "bin_id", "position", "start_word", "n_words"]


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:-1], ids=lambda s: s[0])
def test_stages_return_the_columns_they_get(spark, folder, docs, stage):
    got = stage[1](spark, docs, folder["odd"])
    assert got.columns == docs.columns
    assert {r.doc_id for r in got.collect()} <= {r[0] for r in ROWS}


def test_clashing_columns(spark, docs, folder):
    benchmark = spark.read.parquet(f"{folder['odd']}/benchmark.parquet")
    assert decontaminate.decontaminate(docs, benchmark).columns == docs.columns
    assert near_duplicates.drop_near_duplicates(docs).columns == docs.columns
    assert set(licenses.scan_licenses(docs).columns) > set(docs.columns)
    assert secrets.find_secrets(docs).select("secrets").dtypes[0][1].startswith("array")
    assert shards.byte_shards(docs, ["doc_id", "shard"]).count() == len(ROWS)
    assert surrogates.replace_personal_data(docs, "k", count="size").columns == docs.columns
    assert packing.pack_documents(docs.withColumn("piece", F.lit(1))).count() >= len(ROWS)
    labels = spark.read.parquet(f"{folder['odd']}/labels.parquet")
    assert quality.classify(docs, labels).columns == docs.columns
    assert main_text.extract_main_text(docs, "text", "size").columns == docs.columns
    assert language.identify(docs, docs, lang="id", score="score").columns == docs.columns
    assert periodic.collapse_runs(docs, runs="part", collapsed="id").columns == docs.columns
    assert manifest.manifest(docs.withColumns({c: F.lit(1) for c in ("tree", "place", "nodes", "node", "key", "leaf")})).where("verified").count() == len(ROWS)
    vectors = docs.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0)).alias("embedding"), F.lit(1).alias("rank"), F.lit(2).alias("score"), F.lit(3).alias("qb"))
    assert top_k.top_k(vectors, F.col("vec_id") == 1).columns == ["query_id", "rank", "vec_id", "score"]

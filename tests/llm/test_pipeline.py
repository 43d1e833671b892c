"""The pipeline against a brute-force version of its filtering stages, and on awkward rows."""

import re
from collections import defaultdict

import pytest
from conftest import DATA
from pyspark.sql import functions as F
from test_operators import FOLD, ROWS, SCHEMA, brute_components

import corpus_pipeline as pipeline
from winlog_spark.llm import mixing


def staged(spark, docs, sf_dir, tmp_path):
    out = {}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = out[name] = spark.read.parquet(str(tmp_path / name))
    return out


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    out = staged(spark, docs, str(DATA), tmp_path)
    kept = {i for i, r in rows.items() if re.search(r"[^\W\d_]", r.text or "")}
    assert {r.doc_id for r in out["language_id"].collect()} == kept
    last = defaultdict(int)
    for i in kept:
        t = rows[i].text.translate(FOLD)
        last[t] = max(last[t], i)
    kept = set(last.values())
    assert {r.doc_id for r in out["exact_duplicates"].collect()} == kept
    kept = {i for i, _, c in brute_components([(i, rows[i].text) for i in kept], 5, 80) if i == c}
    assert {r.doc_id for r in out["near_duplicates"].collect()} == kept
    taken = {r.doc_id: r.taken for r in mixing.mix_sources(out["near_duplicates"]).collect()}
    words = defaultdict(int)
    for r in out["mix_sources"].collect():
        words[r.doc_id] += len(r.text.split())
    assert dict(words) == {i: n for i, n in taken.items() if n}
    packed = out["packing"].groupBy("doc_id").agg(F.sum("size").alias("n")).collect()
    assert {r.doc_id: r.n for r in packed} == dict(words)
    load = out["packing"].groupBy("bin", "bin_length").agg(F.sum("size").alias("n"))
    assert load.where("n > bin_length or bin is null").count() == 0
    for name, _ in pipeline.STAGES[:-1]:
        assert out[name].columns == docs.columns


def test_run_is_the_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = staged(spark, docs, str(DATA), tmp_path)["packing"]
    got = pipeline.run(spark, str(DATA))
    assert sorted(map(tuple, got.drop("bin").collect())) == sorted(map(tuple, want.drop("bin").collect()))


@pytest.mark.parametrize("rows", [ROWS, []])
def test_awkward_rows(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("kept", F.lit("x")).withColumn("size", F.lit(1))
    out = staged(spark, docs, str(DATA), tmp_path)
    assert out["packing"].where("size = 0").count() == 0
    assert (out["packing"].count() > 0) == bool(rows)

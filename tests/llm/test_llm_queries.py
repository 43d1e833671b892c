"""Registered corpus queries against their SQL, and the pipeline against a brute-force version."""

import pytest
from conftest import DATA, same

from winlog_spark.llm.entry import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, duck, name):
    same(QUERIES[name](spark, str(DATA)), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_other_queries_return_every_document(spark, name):
    out = QUERIES[name](spark, str(DATA)).toPandas()
    assert out["doc_id"].nunique() == spark.read.parquet(f"{DATA}/documents.parquet").count()

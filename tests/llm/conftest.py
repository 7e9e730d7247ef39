"""A small table with nulls, empty and long texts, ties, repeats and clashing columns."""

import pytest
from llm_fixtures import rows


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("llm") / "docs")
    frame = spark.createDataFrame(rows(), "doc_id long, text string, source string")
    frame.selectExpr("*", "1 as n_tokens", "2 as size", "3 as cls", "4 as lines_in", "5 as toxicity", "6 as _row").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")

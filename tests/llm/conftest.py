import os

import pytest

SMALL = os.environ.get("LLM_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def folder():
    return SMALL


@pytest.fixture(scope="session")
def documents(spark, folder):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


ODD = "doc_id long, text string, lang string, source string, id long, start int, key long, bucket int"


@pytest.fixture(scope="session")
def odd(spark):
    """Builds a table of (doc_id, text) with nulls elsewhere and columns whose names operators use themselves."""

    def build(rows):
        return spark.createDataFrame([(i, t, None, None, None, None, None, None) for i, t in rows], ODD)

    return build

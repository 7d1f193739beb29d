import pytest
from corpus_cases import SMALL, TEXTS, rows


@pytest.fixture(scope="session")
def tricky(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing names."""
    return rows(spark, TEXTS)


@pytest.fixture(scope="session")
def nothing(tricky):
    return tricky.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from llm_given import ODD_TEXTS, SMALL  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns with clashing names."""
    rows = [(i, t, None, k, "z", 1.5) for k, (i, t) in enumerate(ODD_TEXTS)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, score int, key string, segment double"
    ).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}

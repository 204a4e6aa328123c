import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def folder():
    return SMALL


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, and columns whose names operators use inside."""
    long = " ".join(f"word{i % 977}x{i % 13}" for i in range(20_000))
    rows = [
        (1, None, "en", "a"),
        (2, "", "en", "a"),
        (3, " \t\n ", None, None),
        (None, "one two three four five six seven eight nine ten eleven twelve", "en", "a"),
        (None, "one two three four five six seven eight nine ten eleven twelve", "en", "a"),
        (4, "short text", "en", None),
        (5, long, "de", "b"),
        (6, long, "de", "b"),
        (7, "é ü ß — 中文 text with e@mail.example.org and 10.0.0.1, +49 30 1234567 and 4111 1111 1111 1111.", "de", "b"),
        (7, "é ü ß — 中文 text with e@mail.example.org and 10.0.0.1, +49 30 1234567 and 4111 1111 1111 1111.", "de", "b"),
    ]
    rows = [(*r, 0, "x", 1, "y") for r in rows]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, row int, text_key string, node int, key string")

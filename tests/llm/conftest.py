import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import pytest
from pyspark.sql import DataFrame

SF = "/root/testdata/sf0.001"


@pytest.fixture
def awkward(spark):
    """Documents with nulls in every column, empty and long texts, repeated rows, and columns named like the operators' own."""
    long = " ".join(f"word{i % 997}" for i in range(30_000))
    rows = [(1, "The same text, more than once, with enough words to matter."), (2, "The same text, more than once, with enough words to matter."),
            (2, "The same text, more than once, with enough words to matter."), (3, None), (4, ""), (5, "   \n\t "), (6, long), (7, long + " x"),
            (None, "without an id"), (None, None), (8, "Ünïcödé — 日本語 テキスト 😀 Œuvre"), (9, "a"), (10, "!!! ??? 123")]
    return spark.createDataFrame([(i, t, None if i == 3 else "en", i, "x", -1, None, 0.5, True) for i, t in rows],
                                 "doc_id long, text string, lang string, source long, key string, bin int, keep_id string, score double, kept boolean")


@pytest.fixture
def empty(awkward) -> DataFrame:
    return awkward.where("false")

import os

import pytest

SF = "/root/testdata/sf0.001"
#: Rows that every operator has to take: nulls, empty, blank and long texts, repeated rows, clashing extra columns.
ODD = [
    (1, "The quick brown fox jumps over the lazy dog.\nIt was there.", "en", 1), (1, "The quick brown fox jumps over the lazy dog.\nIt was there.", "en", 1),
    (2, None, None, 2), (3, "", "en", 3), (None, "A text without an id, and a few words more.", "en", 4), (4, "  \n\t ", "de", 5), (5, "12 34 !!", None, 6),
    (6, "Der schnelle braune Fuchs springt.\n" * 3000, "de", 7), (7, "x" * 30_000, "de", 8), (8, "It was there.\nthe quick  brown fox jumps over the lazy dog", "en", 9)]
SCHEMA = "doc_id long, text string, lang string, score int"


@pytest.fixture
def odd(spark):
    """The odd rows with extra columns named like what operators add."""
    from pyspark.sql import functions as F

    names = ("id", "shard", "size", "fp", "line", "key", "box", "component_id", "gone", "row", "html", "host", "y", "_rejected_id", "_leak_id")
    return spark.createDataFrame(ODD, SCHEMA).withColumns({n: F.lit("clash") for n in names})


@pytest.fixture
def none(odd):
    return odd.limit(0)


@pytest.fixture
def docs(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return spark.read.parquet(f"{SF}/documents.parquet")

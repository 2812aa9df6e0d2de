import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g"}
    session = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def documents(spark):
    def make(rows):
        """doc_id, text, source; the other columns filled in, and extra ones whose names clash with what operators add."""
        full = [(i, t, "en", s, None if t is None else len(t), "x", 7, "y") for i, t, s in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, score string, n int, found string")

    return make


ODD = [
    (1, None, "a"), (2, "", None), (3, "   \n\t ", "a"), (4, "one two", "a"), (4, "one two", "a"), (5, "a" * 30_000, "b"), (None, "one two", "b"),
    (6, "x'll don't  \n\n 'tis ''s 12ab  　z \U0001f600é \x1c end  ", "c"), (7, "word " * 20_000, "c"), (8, "ONE TWO", "c"),
]


@pytest.fixture
def odd(documents):
    return documents(ODD)

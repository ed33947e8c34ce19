"""Names from words that make a virus's name: no word is left out, and the queries match their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from taxaflow.plans import queries as names

WORDS = ("elzevir", "macrophage", "rotavirus", "particles", "vireon")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = []
    for place in range(4):
        for word in WORDS:
            for _ in range(3):
                text = ["lorem", "ipsum", "dolor", "amets"]
                text[place] = word
                rows.append((len(rows), " ".join(text)))
    root = tmp_path_factory.mktemp("viral")
    spark.createDataFrame([*rows, (len(rows), None), (len(rows) + 1, "a bb species naïveté abcdefghijklm")], "doc_id long, text string").coalesce(1).write.parquet(f"{root}/documents.parquet")
    return str(root)


def test_every_word_counts(spark, folder):
    assert names._parts(spark, folder).where(F.col("genus") == "Elzevirus").count() == 3


@pytest.mark.parametrize("query", ["parse_binomial", "parse_subgenus", "preflight_rescue", "interesting_filter", "suffix_rank"])
def test_matches_sql(spark, folder, query):
    own = __spark_entry__.queries()[query](spark, folder)
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
        want = db.sql(__spark_entry__.oracle_sql()[query])
        assert own.columns == want.columns
        assert sorted(map(repr, map(tuple, own.collect()))) == sorted(map(repr, want.fetchall()))

"""The SQL and the parts of names keep every word of every text: as many names as a plain count of the words gives."""

import re

import duckdb
import pytest

from pyspark.sql import functions as F

from taxaflow.operators.parse import parse_names
from taxaflow.plans import queries as names

TEXTS = [
    "elzevir ipsum dolor amets", "lorem macrophage dolor amets", "lorem ipsum viroids amets", "lorem ipsum dolor satellites", "savior virion bacteriophage rotavirus lorem Ipsum; DOLOR amets conse",
    "a bb species naïveté abcdefghijklm", "", None, "clade group lorem ipsum virus dolor amets",
]
#: One row a name, so that the count of rows is that of names.
ONE_EACH = [q for q in names._SELECT if q not in ("parse_in_sql", "compare_runs", "interesting_filter", "otu_filter", "three_way_split", "type_breakdown", "band_report")]


def _names() -> list[int]:
    """How many names each text gives."""
    words = [[w for w in re.split("[^a-z]+", (t or "").lower()) if 5 <= len(w) <= 12 and w not in names._SPECIAL] for t in TEXTS]
    return [len(w) // 4 for w in words]


@pytest.fixture(scope="module")
def db():
    with duckdb.connect() as held:
        held.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
        held.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(TEXTS)))
        yield held


@pytest.mark.parametrize("query", ONE_EACH)
def test_sql_has_a_row_for_each_name(db, query):
    assert len(db.sql(names.oracle_sql()[query]).fetchall()) == sum(_names())


@pytest.mark.parametrize(("query", "counted"), [("three_way_split", 1), ("type_breakdown", 1)])
def test_reports_count_all_names(db, query, counted):
    assert sum(r[counted] for r in db.sql(names.oracle_sql()[query]).fetchall()) == sum(_names())


@pytest.mark.parametrize(("query", "kept"), [("compare_runs", lambda k: k != 1), ("otu_filter", lambda k: k == 2)])
def test_filters_see_all_names(db, query, kept):
    assert len(db.sql(names.oracle_sql()[query]).fetchall()) == sum(kept((doc + pos) % 3) for doc, n in enumerate(_names()) for pos in range(n))


def test_parts_are_those_of_the_sql(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = names._parts(spark, str(tmp_path)).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in found} == {doc: n for doc, n in enumerate(_names()) if n}


def test_bands_and_errors_are_all_names(spark, tmp_path, db):
    """Names that are errors have no band; all others of the band report's names have one."""
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    k = F.col("k")
    name = F.when(k == 0, F.concat("genus", F.lit(" cf. "), "species")).when(k == 1, F.concat("genus", F.lit(" indet."))).otherwise(F.concat("genus", F.lit(" sp. A"), "y"))
    errors = parse_names(names._parts(spark, str(tmp_path)).select(name.alias("name"))).where("result = 'error'").count()
    found = names.band_report(spark, str(tmp_path)).collect()
    assert 0 < errors and sum(r["n"] for r in found) + errors == sum(_names())
    assert sorted(map(tuple, found)) == sorted(db.sql(names.oracle_sql()["band_report"]).fetchall())

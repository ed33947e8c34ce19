"""SQL names: register(spark) for functions such as suffix_rank(name, code), parsed_view for the parser over a table."""

from __future__ import annotations

from pyspark.sql import SparkSession

from taxaflow.functions.text import BARCODE
from taxaflow.plans import vocab


def register(spark: SparkSession) -> None:
    """Temporary SQL functions; their bodies are SQL, so Spark optimises them like hand-written expressions."""
    q = lambda x: x.replace("\\", "\\\\").replace("'", "\\'")
    quotes = q(vocab.SINGLE_QUOTES + vocab.DOUBLE_QUOTES)
    plain = q("'" * len(vocab.SINGLE_QUOTES) + '"' * len(vocab.DOUBLE_QUOTES))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION normalise_quotes(x STRING) RETURNS STRING RETURN translate(x, '{quotes}', '{plain}')")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION is_barcode_otu(x STRING) RETURNS BOOLEAN RETURN regexp_like(x, '{q(BARCODE)}')")
    cases = " ".join(
        f"WHEN code = '{code}' THEN CASE " + " ".join(f"WHEN endswith(lower(name), '{s}') THEN '{r}'" for s, r in sorted(table.items(), key=lambda x: -len(x[0]))) + " END"
        for code, table in vocab.SUFFIX_RANKS.items()
    )
    bare = " ".join(f"WHEN endswith(lower(name), '{s}') THEN '{r}'" for s, r in vocab.PLAIN_SUFFIX_RANKS.items())
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION suffix_rank(name STRING, code STRING) RETURNS STRING RETURN CASE WHEN code IS NULL THEN CASE {bare} END {cases} END")


def parsed_view(spark: SparkSession, table: str, view: str, **columns: str) -> None:
    """A temporary view with the columns of a table or view and result, parsed, informal and error of its names.

    columns are those of parse_names (name, authorship, rank, code). The view is the parse's plan, no copy: SQL over
    it prunes and filters as over any other, and joins or LATERAL views take it apart."""
    from taxaflow.operators.parse import parse_names

    parse_names(spark.table(table), **columns).createOrReplaceTempView(view)

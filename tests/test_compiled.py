"""What each name goes through is compiled: no function over arrays for the tokens, and rules with literal patterns."""

from pyspark.sql import functions as F

from taxaflow.functions import classify, words
from taxaflow.operators import parse
from taxaflow.plans import queries, strip


def test_tokens_need_no_function_over_arrays(spark):
    assert "lambda" not in spark.range(1).select(words.coded(F.col("id").cast("string")))._jdf.queryExecution().toString().lower()


def test_kinds_of_tokens(spark):
    rows = spark.createDataFrame([("Abies x subsp. d'Orb (L.) ×Foo 12 12-foo dall dal Ab-C A ÉMILE\ta",), ("",), ("  ",), ("zveaSxisqoHhgpmInUCl",)], "x string").select(words.coded(F.col("x"))).collect()
    mark = words.END
    first = "".join(f"{t}{mark}" for t in ("CAbies", "h x", "m subsp", "..", "p d'Orb", "( (", "IL", "..", "))", "H ×", "CFoo", "n 12", "l 12-foo", "l dall", "p dal", "C Ab-C", "I A", "U ÉMILE", "o\ta"))
    assert [r[0] for r in rows] == [first, "", "", f"lzveaSxisqoHhgpmInUCl{mark}"]


def test_rules_have_literal_patterns(spark):
    plan = spark.range(1).select(strip.worked(F.lit("a"), F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()
    assert "pattern" not in plan


def test_no_need_is_hidden_by_a_gate(spark):
    """A text that is a need by itself passes the need's gate; hints are found among all of them."""
    needs = [n for r in strip.RULES for n in r.needs if not (len(n) > 2 and n[0] == n[-1] == "/")]
    rows = spark.createDataFrame([(n,) for n in {*needs, *classify.HINTS, *parse._VIRAL_HINTS}], "x string").select("x", F.regexp_like("x", F.lit(parse._HINTED)).alias("hint"))
    found = {r["x"]: r for r in rows.select("x", "hint", strip.gates(F.col("x"), F.col("hint")).alias("g")).collect()}
    assert all(found[n]["g"][strip._gate(n)] for n in needs if strip._gate(n))
    assert all(found[h]["hint"] for h in {*classify.HINTS, *strip.HINTS, *parse._VIRAL_HINTS})


def test_one_file_is_parsed_by_all_cores(spark, tmp_path):
    spark.createDataFrame([(k, "lorem ipsum dolor amets") for k in range(200)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    parts = queries._parts(spark, str(tmp_path))
    assert parts.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert parts.count() == 200

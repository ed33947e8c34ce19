"""Names that are read without their tokens have the parts that the tokens give."""

import pytest
from pyspark.sql import functions as F

from taxaflow.functions import words
from taxaflow.operators.parse import parse_names
from taxaflow.plans import vocab

#: Names and whether they are read without tokens.
NAMES = {
    "Abies alba": True, "Abies alba Mill.": True, "Abies ×alba Mill.": True, "Abies alba var. nana (L.) Mill.": True, "Abies alba L. subsp. nana": True, "Abies alba Mill. & Gray f. nana (Hook., 1900) Smith, 1901": True,
    "Abies alba nana Smith 1901": True, "Abies alba (Smith) Hook.f.": True, "Abies alba Hook.f.": True, "Abies alba L. f. nana": True, "Ærus alba Ræus, 1900": True, "Abies alba Mill. nana": False, "Abies alba Hook.f. & Gray": False,
    "Abies alba f. nana var. minor": False, "Abies alba X": False, "Abies alba X. Smith": False, "Abies X alba": False, "Abies × alba": False, "Abies cf. alba": False, "Abies sp. alba": False, "Abies alba agg.": False, "Abies near alba": False,
    "Abies (Picea) alba": False, "Abies alba var. nana f. minor": False, "Abies alba ssp. nana L": True, "Abies alba f. L": False, "Abies alba var nana": True, "Abies alba de Candolle": False, "Abies alba-nana Mill.": False, "Abies": False,
    "A. alba": False, "Abies dela Smith": True, "Abies alba Smith f. L": False, "Abies alba Smith f.": False, "Abies alba Smith.f.": True, "Abies alba 1900": False, "Abies alba Smith et Jones": False, "Abies var nana": False, "Abies alba forma nana": True,
    "Abies alba L. X var. nana": False, "Abies alba I var. nana": True, "Abies alba var. nana I": True, "Abies alba (L) I": True, "Abies alba A": True, "Abies alba A.": True, "Abies alba A. B": True,
} | {f"Abies {w} Mill.": False for w in ("var", "subg", "sect", "hort", "van", "species", "group")}


def test_short_names_have_the_parts_of_their_tokens(spark):
    marked = [f"Abies alba Gray {m}. nana (L.) Mill." for m in vocab.INFRASPECIFIC if m.isalpha() and m.islower()]
    df = spark.createDataFrame([(n,) for n in [*NAMES, *marked]], "name string").repartition(1).withColumn("short", words.short(F.col("name")))
    df = df.select("name", F.when(F.contains("short", F.lit("\t")), F.split("short", "\t")).alias("short"), words.parted(words.matched(words.coded(F.col("name")), F.lit(False))).alias("full"))
    for row in df.collect():
        assert (row.short is not None) == NAMES.get(row.name, True), row.name
        assert row.short is None or row.short == row.full, row.name


@pytest.mark.parametrize("column", ["combinationAuthorship.year", "genus"])
def test_plain_names_are_carried_as_text(spark, column):
    """The struct of a plain name is built at the end of the chain, not carried through it."""
    plan = parse_names(spark.range(1).select(F.col("id").cast("string").alias("name"))).select(f"parsed.{column}")._jdf.queryExecution().analyzed().toString()
    assert "__plain" not in plan

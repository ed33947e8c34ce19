"""The short ways of the parse give what the long ones give."""

import re

from pyspark.sql import functions as F

from taxaflow.functions import authors
from taxaflow.operators import parse

TEXTS = [
    None, "", "L.", "L., 1753", "Mill.", "Hook.f.", "DC.", "Hook.f. & Thomson", "Lorem & Mill., 1850", "A.B.Smith & C.Jones, Miller 1900", "Miller, Fr.", "Smith, Jr., 1900", "Smith, Ab. & Jones", "Smith Jones", "Smith ex Jones",
    "Mexia ex Bexar, 1899", "Smith, Jones, Miller", "Smith & Jones III", "Smith 1850a", "Smith, [1850]", "McDonald & O'Brien", "SMITH, 1850", "Ræus, 1901", "Smith, II & Jones", "A. Smith", "Smith JB", "Smith JB, 1900", "Smith J 1900", "Smith II", "Smith IV, 1900", "Smith JBC, 1900", "Smith JB & Jones", "Smith Jr", "Miller, A.B., 1850", "Et, 1850",
]


def test_same_authorships(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "x string").repartition(1)
    df = df.withColumn("short", authors.simple_authorship(authors.simple(F.trim("x")), F.trim("x"))).withColumn("long", F.get(authors.authorships(F.col("x")), F.lit(0)))
    for row in df.collect():
        assert row.short == row.long, row.x


def test_words_that_mean_something():
    pattern = re.compile(parse._SPECIAL.replace("?+", "?").replace(r"\z", r"\Z"))
    for word in parse._WORDS:
        assert pattern.search(f"Abies {word}") and pattern.search(f"{word} alba") and not pattern.search(f"Abies x{word}") and not pattern.search(f"Abies {word}x"), word

"""Parse results as flat tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaflow.functions import render

_TEXT = (
    "uninomial genus infragenericEpithet specificEpithet infraspecificEpithet cultivarEpithet taxonomicNote nomenclaturalNote publishedIn publishedInYear publishedInPage unparsed sanctioningAuthor state"
).split()
_FLAGS = "candidatus originalSpelling extinct doubtful manuscript".split()


def _joined(x: Column) -> Column:
    return F.nullif(F.array_join(x, ", "), F.lit(""))


def flat_view(df: DataFrame, name: str = "name") -> DataFrame:
    """One row a name with scalar columns only; lists are joined by commas, empty ones are null."""
    p, i, e = F.col("parsed"), F.col("informal"), F.col("error")
    plain = (F.col("result") == "parsed")
    own = lambda c: F.when(plain, p[c])
    people = [
        _joined(own(f"{kind}Authorship")[part]).alias(f"{kind}{part[0].upper()}{part[1:]}") for kind in ("combination", "basionym") for part in ("authors", "exAuthors")
    ] + [own(f"{kind}Authorship")[part].alias(f"{kind}{part[0].upper()}{part[1:]}") for kind in ("combination", "basionym") for part in ("year", "imprintYear")]
    form = lambda c: F.when(plain, F.col(f"__form_{c}"))
    return render.with_forms(df, "parsed", "__form_").select(
        F.col(name).alias("scientificName"), "result", plain.alias("parsed"),
        F.coalesce(p["type"], e["type"]).alias("type"), i["taxon"].alias("taxon"), i["taxonRank"].alias("taxonRank"), p["rank"].alias("rank"), p["code"].alias("code"), p["phrase"].alias("phrase"),
        F.when(F.col("result") == "informal", render.informal_canonical(i)).otherwise(form("full")).alias("canonical"),
        *(own(c).alias(c) for c in _TEXT), *(own(c).alias(c) for c in _FLAGS), *people,
        _joined(own("notho")).alias("notho"),
        F.nullif(F.array_join(F.array_sort(F.transform(F.map_entries(own("epithetQualifier")), lambda x: F.concat(x["key"], F.lit("="), x["value"]))), ", "), F.lit("")).alias("epithetQualifier"),
        _joined(own("warnings")).alias("warnings"), form("bare").alias("canonicalWithoutAuthorship"),
        form("minimal").alias("canonicalMinimal"), form("authorship").alias("authorship"), e["message"].alias("error"),
    )

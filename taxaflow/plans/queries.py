"""Registered queries of the name engine, with the SQL that gives the same rows.

The tables hold no names, so names are built from the words of documents by fixed rules; the SQL gives the
parts that went in, the queries parse the whole and must find the same parts.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxaflow.functions import render, text
from taxaflow.functions import sql as sql_functions
from taxaflow.operators import ordered, reports
from taxaflow.operators.flat import flat_view
from taxaflow.operators.parse import parse_names
from taxaflow.plans import ranks
from taxaflow.plans.cases import CASES

#: Words that mean something to the parser are no epithets or authors here.
_SPECIAL = (
    "dalla dalle dallo degli della delle delli dello ofver forma prole proles natio sensu emend clade group virus phage prion indet undet strain variety complex aggregate unknown species "
    "satellite vector particle replicon unassigned uncultured undescribed delete corrig missing candidatus incertae sedis convar subsp mutatio agamosp subforma"
).split()
_WORD = rf"(?<![a-z])(?!(?:{'|'.join(_SPECIAL)})(?![a-z]))[a-z]{{5,12}}+(?![a-z])"
_WORDS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+'), lambda x: regexp_full_match(x, '[a-z]{5,12}') AND x NOT IN (" + ", ".join(f"'{w}'" for w in _SPECIAL) + "))"
#: Every four words of a text in turn are the parts of one name. vir, vg, vs, vi and va tell which of them make it a virus's:
#: a genus in -virus, phages in genus, species and infra, and authors that are words of viruses.
_BASE = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), g AS (SELECT doc_id, w, unnest(range(len(w) // 4)) AS pos FROM d), n AS (
    SELECT doc_id, pos, upper(substr(w[4 * pos + 1], 1, 1)) || substr(w[4 * pos + 1], 2) || 'us' AS genus, w[4 * pos + 2] || 'ensis' AS species, w[4 * pos + 3] || 'anus' AS infra,
           upper(substr(w[4 * pos + 4], 1, 1)) || substr(w[4 * pos + 4], 2) AS author, CAST(1758 + (doc_id + pos) % 250 AS VARCHAR) AS y, (doc_id + pos) % 3 AS k,
           w[4 * pos + 1] LIKE '%vir' AS vir, w[4 * pos + 1] LIKE '%vir' OR w[4 * pos + 1] LIKE '%phage%' AS vg, w[4 * pos + 2] LIKE '%phage%' AS vs, w[4 * pos + 3] LIKE '%phage%' AS vi,
           regexp_full_match(w[4 * pos + 4], '.*phage.*|.*(virus|viruses|viroid|viroids|virion|virions|vector)|prions|particles|replicons') AS va FROM g)
"""


#: Tasks a core that the documents are dealt to where their files have fewer splits.
_TASKS = 4


def _spread(docs: DataFrame) -> DataFrame:
    """The documents, dealt over all cores by doc_id where their files are split into few tasks: parsing takes far longer than reading."""
    wanted = _TASKS * docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(wanted, "doc_id") if docs.rdd.getNumPartitions() < wanted else docs


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos, genus, species, infra, author, y, k: the parts of names, from all words of all texts."""
    docs = _spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    # One pattern finds the words, another one takes four in a row: no function over arrays, which Spark interprets.
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(_WORD), F.lit(0))
    fours = F.regexp_extract_all(F.array_join(words, " "), F.lit("[a-z]+ [a-z]+ [a-z]+ [a-z]+"), F.lit(0))
    held = docs.select("doc_id", F.posexplode(fours).alias("pos", "four")).select("doc_id", "pos", F.split("four", " ").alias("w"))
    title = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 99))
    w = lambda k: F.get("w", F.lit(k))
    number = F.col("doc_id") + F.col("pos")
    return held.select(
        "doc_id", F.col("pos").cast("long").alias("pos"), F.concat(title(w(0)), F.lit("us")).alias("genus"), F.concat(w(1), F.lit("ensis")).alias("species"), F.concat(w(2), F.lit("anus")).alias("infra"),
        title(w(3)).alias("author"), (1758 + number % 250).cast("string").alias("y"), (number % 3).alias("k"),
    )


def _parsed(spark: SparkSession, sf_dir: str, *pieces: Column | str, **hints: Column) -> DataFrame:
    """The parse of names put together from pieces (column names, or texts between them)."""
    parts = _parts(spark, sf_dir)
    whole = F.concat(*(F.col(p) if isinstance(p, str) and p in parts.columns else F.lit(p) if isinstance(p, str) else p for p in pieces))
    named = parts.select("doc_id", "pos", whole.alias("name"), *(c.alias(f"h_{k}") for k, c in hints.items()))
    return parse_names(named, **{k: f"h_{k}" for k in hints})


def parse_binomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir, "genus", " ", "species").select("doc_id", "pos", "result", "parsed.genus", F.col("parsed.specificEpithet").alias("species"), "parsed.rank", "parsed.type")


def parse_author_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parsed(spark, sf_dir, "genus", " ", "species", " ", "author", " & Mill., ", "y")
    return p.select("doc_id", "pos", "parsed.genus", F.array_join("parsed.combinationAuthorship.authors", "|").alias("authors"), F.col("parsed.combinationAuthorship.year").alias("y"), "parsed.code")


def parse_basionym(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parsed(spark, sf_dir, "genus", " ", "species", " (", "author", ") Hook.f.")
    return p.select("doc_id", "pos", F.col("parsed.specificEpithet").alias("species"), F.array_join("parsed.basionymAuthorship.authors", "|").alias("basionym"), F.array_join("parsed.combinationAuthorship.authors", "|").alias("combination"), "parsed.code")


def parse_ex_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parsed(spark, sf_dir, "genus", " ", "species", " ", "author", " ex J. Smith : Fr.")
    return p.select("doc_id", "pos", F.array_join("parsed.combinationAuthorship.exAuthors", "|").alias("ex"), F.array_join("parsed.combinationAuthorship.authors", "|").alias("authors"), F.col("parsed.sanctioningAuthor").alias("sanctioning"), "parsed.code")


def parse_separate_authorship(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parsed(spark, sf_dir, "genus", " ", "species", " Linnaeus", authorship=F.concat("author", F.lit(" JB, "), "y"))
    return p.select("doc_id", "pos", F.array_join("parsed.combinationAuthorship.authors", "|").alias("authors"), F.col("parsed.combinationAuthorship.year").alias("y"))


def _marker(k: Column) -> Column:
    return F.when(k == 0, F.lit("var.")).when(k == 1, "subsp.").otherwise("f.")


def parse_trinomial_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parsed(spark, sf_dir, "genus", " ", "species", " L. ", _marker(F.col("k")), " ", "infra")
    return p.select("doc_id", "pos", F.col("parsed.infraspecificEpithet").alias("infra"), "parsed.rank", F.array_join("parsed.specificAuthorship.authors", "|").alias("species_author"))


def parse_trinomial_bare(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parsed(spark, sf_dir, "genus", " ", "species", " ", "infra", " ", "author", ", ", "y")
    return p.select("doc_id", "pos", F.col("parsed.infraspecificEpithet").alias("infra"), "parsed.rank", "parsed.code")


def parse_subgenus(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parsed(spark, sf_dir, "genus", " (", "author", ") ", "species")
    return p.select("doc_id", "pos", F.col("parsed.infragenericEpithet").alias("subgenus"), F.col("parsed.specificEpithet").alias("species"))


def parse_infrageneric(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parsed(spark, sf_dir, "genus", " sect. ", "author")
    return p.select("doc_id", "pos", "parsed.genus", F.col("parsed.infragenericEpithet").alias("section"), "parsed.rank", "parsed.code")


def parse_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parsed(spark, sf_dir, "genus", " ×", "species", " ", "author")
    return p.select("doc_id", "pos", F.array_join("parsed.notho", "|").alias("notho"), F.col("parsed.specificEpithet").alias("species"), F.array_join("parsed.combinationAuthorship.authors", "|").alias("authors"))


def parse_cultivar(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parsed(spark, sf_dir, "genus", " ", "species", " '", "author", "'")
    return p.select("doc_id", "pos", F.col("parsed.cultivarEpithet").alias("cultivar"), "parsed.rank", "parsed.code")


def parse_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.when(F.col("k") == 0, F.lit(", nom. illeg.")).when(F.col("k") == 1, F.concat(F.lit(" sensu "), "author", F.lit(", 1900"))).otherwise(" [sic]")
    p = _parsed(spark, sf_dir, "genus", " ", "species", " L.", note)
    return p.select("doc_id", "pos", F.col("parsed.nomenclaturalNote").alias("nom_note"), F.col("parsed.taxonomicNote").alias("tax_note"), F.col("parsed.originalSpelling").alias("spelling"), F.array_join("parsed.combinationAuthorship.authors", "|").alias("authors"))


def parse_informal(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parsed(spark, sf_dir, "genus", " sp. RE", "y")
    return p.select("doc_id", "pos", "result", "informal.taxon", "informal.taxonRank", "informal.rank", "informal.phrase")


def parse_qualifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parsed(spark, sf_dir, "genus", " cf. ", "species")
    return p.select("doc_id", "pos", "result", "parsed.type", F.col("parsed.specificEpithet").alias("species"), F.col("parsed.epithetQualifier")["SPECIFIC"].alias("qualifier"))


def parse_published_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parsed(spark, sf_dir, "genus", " ", "species", " Smith in ", "author", ", ", "y")
    return p.select("doc_id", "pos", F.col("parsed.publishedIn").alias("published_in"), F.col("parsed.publishedInYear").cast("bigint").alias("published_year"), F.col("parsed.combinationAuthorship.year").alias("y"))


def parse_candidatus(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parsed(spark, sf_dir, "Candidatus ", "genus", " ", "species")
    return p.select("doc_id", "pos", "parsed.genus", "parsed.candidatus", "parsed.code")


def parse_quadrinomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parsed(spark, sf_dir, "genus", " ", "species", " subsp. ", "species", " f. ", "infra")
    return p.select("doc_id", "pos", F.col("parsed.infraspecificEpithet").alias("infra"), "parsed.rank", F.array_join("parsed.warnings", "|").alias("warnings"))


def parse_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parsed(spark, sf_dir, "<i>", "genus", "</i> <i>", "species", "</i> †")
    return p.select("doc_id", "pos", "parsed.genus", F.col("parsed.specificEpithet").alias("species"), "parsed.extinct", F.array_join("parsed.warnings", "|").alias("warnings"))


def preflight_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("k") == 0, F.concat(F.lit("BOLD:AAA"), "y")).when(F.col("k") == 1, F.concat(F.lit("sh12"), "y", F.lit(".07fu"))).otherwise(F.concat(F.lit("ATCC "), "y"))
    return _parsed(spark, sf_dir, name).select("doc_id", "pos", "result", "error.type", "error.name")


def preflight_virus(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parsed(spark, sf_dir, "author", " mosaic virus ", "y")
    return p.select("doc_id", "pos", "result", "error.type", "error.code", "error.message")


def preflight_placeholder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir, "genus", " incertae sedis").select("doc_id", "pos", "result", "error.type", "error.message")


def preflight_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir, "genus", "-group").select("doc_id", "pos", "result", "informal.taxon", "informal.phrase", "informal.rank")


def hybrid_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir, "genus", " ", "species", " × ", "genus", " ", "infra").select("doc_id", "pos", "result", "error.type", "error.name")


def three_way_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("k") == 0, F.concat("genus", F.lit(" "), "species")).when(F.col("k") == 1, F.concat("genus", F.lit(" sp."))).otherwise(F.lit("unidentified"))
    return reports.summary(_parsed(spark, sf_dir, name))


def type_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("k") == 0, F.concat("genus", F.lit(" "), "species")).when(F.col("k") == 1, F.concat("genus", F.lit(" sp."))).otherwise(F.concat(F.lit("OTU-"), "y"))
    return reports.type_breakdown(_parsed(spark, sf_dir, name))


def band_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("k") == 0, F.concat("genus", F.lit(" cf. "), "species")).when(F.col("k") == 1, F.concat("genus", F.lit(" indet."))).otherwise(F.concat("genus", F.lit(" sp. A"), "y"))
    return reports.band_report(_parsed(spark, sf_dir, name))


def interesting_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("k") == 0, F.concat("genus", F.lit(" "), "species")).when(F.col("k") == 1, F.concat("genus", F.lit(" "), "species", F.lit(" ?"))).otherwise(F.lit("unknown"))
    return _parsed(spark, sf_dir, name).where(reports.is_interesting()).select("doc_id", "pos", "result")


def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = _parsed(spark, sf_dir, "genus", " ", "species", " ", "author", ", ", "y")
    right = _parsed(spark, sf_dir, "genus", " ", F.when(F.col("k") == 0, F.col("infra")).when(F.col("k") == 1, F.col("species")).otherwise(F.lit("sp.")), " ", "author", ", ", "y")
    row = F.concat_ws("/", "doc_id", "pos")
    return reports.compare_runs(left.withColumn("row", row), right.withColumn("row", row), "row").select("row", "change", F.array_join("paths", "|").alias("paths"))


def canonical_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parsed(spark, sf_dir, "genus", " ", "species", " var. ", "infra", " (L.) ", "author")
    return render.with_forms(p).select("doc_id", "pos", "full", "bare", "minimal", "authorship")


def render_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six renderings of names with a species author, a cross, notes, no last epithet or a subgenus."""
    name = F.when(F.col("k") == 0, F.concat("genus", F.lit(" "), "species", F.lit(" Mill. subsp. "), "infra", F.lit(" (L.) "), "author", F.lit(" sensu Ræus, nom. illeg."))).when(F.col("k") == 1, F.concat("genus", F.lit(" ×"), "species", F.lit(" "), "author"))
    p = _parsed(spark, sf_dir, name.otherwise(F.concat("genus", F.lit(" (Ærus) "), "species", F.lit(" "), "author", F.lit(", "), "y")))
    return render.with_forms(p).select("doc_id", "pos", *render.FORMS, "authorship")


def parse_separate_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes within a separate authorship."""
    given = F.when(F.col("k") == 0, F.concat("author", F.lit(", "), "y", F.lit(", nom. nud."))).when(F.col("k") == 1, F.concat("author", F.lit(" [sic] sensu Mill."))).otherwise("auct. non L.")
    p = _parsed(spark, sf_dir, "genus", " ", "species", authorship=given)
    n = F.col("parsed")
    return p.select("doc_id", "pos", n["nomenclaturalNote"].alias("nom_note"), n["taxonomicNote"].alias("tax_note"), n["originalSpelling"].alias("spelling"), F.array_join(n["combinationAuthorship"]["authors"], "|").alias("authors"), n["combinationAuthorship"]["year"].alias("y"))


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parsed(spark, sf_dir, "genus", " ", "species", " ", "author", ", ", "y")
    return flat_view(p).select("scientificName", "result", "rank", "genus", "specificEpithet", "combinationAuthors", "combinationYear", "canonicalWithoutAuthorship")


def rank_dimension_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parsed(spark, sf_dir, "genus", " ", "species", " ", _marker(F.col("k")), " ", "infra")
    return ranks.with_rank(p.select("doc_id", "pos", F.col("parsed.rank").alias("rank"))).select("doc_id", "pos", "rank", "rank_info.marker", "rank_info.major", "rank_info.infraspecific")


def suffix_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql_functions.register(spark)
    name = F.concat("genus", F.when(F.col("k") == 0, F.lit("idae")).when(F.col("k") == 1, "aceae").otherwise("ales"))
    code = F.when(F.col("k") == 0, F.lit("ZOOLOGICAL")).when(F.col("k") == 2, "BOTANICAL")
    return _parts(spark, sf_dir).select("doc_id", "pos", name.alias("name"), code.alias("code")).selectExpr("doc_id", "pos", "suffix_rank(name, code) AS rank")


def unlikely_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.when(F.col("k") == 0, F.col("y")).when(F.col("k") == 1, F.concat(F.lit("9"), "y")).otherwise(F.concat(F.substring("y", 1, 3), F.lit("?")))
    return _parts(spark, sf_dir).select("doc_id", "pos", text.is_unlikely_year(year).alias("unlikely"))


def code_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = F.array(F.when(F.col("k") == 0, F.lit("BOTANICAL")), F.when(F.col("k") < 2, F.lit("ZOOLOGICAL")), F.lit(None).cast("string"))
    return _parts(spark, sf_dir).select("doc_id", "pos", text.code_vote(votes).alias("code"))


def quote_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", text.normalise_quotes(F.concat(F.lit("‘"), F.coalesce("text", F.lit("")), F.lit("”"))).alias("quoted"))


def otu_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("k") == 0, F.concat(F.lit("BOLD:ABC"), "y")).when(F.col("k") == 1, F.concat(F.lit("SH00"), "y", F.lit(".08FU"))).otherwise(F.col("genus"))
    return _parts(spark, sf_dir).select("doc_id", "pos", name.alias("name")).where(~text.is_barcode_otu(F.col("name")))


def benchmark_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.percentiles(spark.read.parquet(f"{sf_dir}/documents.parquet"), "n_chars")


def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", text.strip_html(F.col("html")).alias("text"))


def parse_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _parts(spark, sf_dir).select("doc_id", "pos", F.concat("genus", F.lit(" "), F.when(F.col("k") == 0, F.lit("vulgaris")).otherwise(F.col("species"))).alias("name"))
    return reports.parse_distinct(named, ["name"], parse_names).select("doc_id", "pos", "parsed.genus", F.col("parsed.specificEpithet").alias("species"))


def parse_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a stream, parsed and written as a stream, read back as a batch."""
    from taxaflow.streaming import names as streaming

    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster sees")
        root = tempfile.mkdtemp(prefix="taxaflow-")
    out = f"{root}/stream-{uuid.uuid4().hex}"
    held = _parts(spark, sf_dir).select("doc_id", "pos", F.concat("genus", F.lit(" "), "species").alias("name"))
    held.write.parquet(f"{out}/in")
    stream = spark.readStream.schema(held.schema).parquet(f"{out}/in")
    parsed = streaming.parse_stream(stream).select("doc_id", "pos", "result", F.col("parsed.genus").alias("genus"))
    query = parsed.writeStream.format("parquet").option("checkpointLocation", f"{out}/state").option("path", f"{out}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(parsed.schema).parquet(f"{out}/out")


def parse_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parser read by SQL alone, authors taken apart by a LATERAL view."""
    parts = _parts(spark, sf_dir)
    parts.select("doc_id", "pos", F.concat("genus", F.lit(" "), "species", F.lit(" "), "author", F.lit(" & Mill., "), "y").alias("name")).createOrReplaceTempView("listed_names")
    sql_functions.parsed_view(spark, "listed_names", "parsed_names")
    return spark.sql("SELECT doc_id, pos, parsed.genus, CAST(place AS BIGINT) AS place, author FROM parsed_names LATERAL VIEW posexplode(parsed.combinationAuthorship.authors) a AS place, author WHERE result = 'parsed' AND parsed.code = 'ZOOLOGICAL'")


#: doc_id and pos as one number, and how many documents one range of it holds.
_RANGE = 1 << 32


def _number() -> Column:
    return F.col("doc_id") * (1 << 24) + F.col("pos")


def compare_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists of names by place: of the second one the first of each hundred is missing and some have other white space or epithets."""
    parts = _parts(spark, sf_dir).withColumn("number", _number())
    left = parts.select("number", F.concat("genus", F.lit(" "), "species").alias("name"), "author")
    spaced = F.when(F.col("k") == 0, F.concat("genus", F.lit("  "), "species")).when(F.col("k") == 1, F.concat("genus", F.lit(" "), "infra")).otherwise(F.concat("genus", F.lit(" "), "species"))
    right = parts.where("doc_id % 100 <> 7 OR pos > 0").select("number", spaced.alias("name"), "author")
    return ordered.compare_places(left, right, "number", ["name", "author"], ignore_whitespace=True, width=_RANGE).select("place", "change", F.array_join("paths", "|").alias("paths"))


def reservoir_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reservoir of 100 over all documents in the order of doc_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    return ordered.reservoir(docs, 100, "doc_id", seed=42).select("slot", "doc_id", "place")


def judge_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents without a label, in batches of 25."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    return ordered.judge_batches(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "doc_id")


def verdict_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts read from replies that hold the documents' texts as notes, with broken objects and thoughts between."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    one = lambda k, note: F.to_json(F.struct((F.col("doc_id") * 2 + k).alias("index"), F.lit("ok").alias("verdict"), F.lit("high").alias("confidence"), note.alias("note")))
    reply = F.concat(
        F.lit('<think>{"verdicts": [{</think>Here: {"verdicts": [ '), one(0, F.col("text")), F.lit(', {"index": "x", "verdict": {"a": 1}}, {"verdict": "ok"}, '), one(1, F.lit('} ] { \\ "')),
        F.when(F.col("doc_id") % 2 == 0, F.lit(', {"index": 5, "verdict": "ok", "no')).otherwise(F.lit(']} {"index": 9, "verdict": "ok", "confidence": "low"}')),
    )
    return ordered.read_verdicts(docs.select("doc_id", reply.alias("reply"))).select("doc_id", "index", "verdict", "confidence", F.md5("note").alias("note_md5"))


def name_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document the name of CASES that its doc_id falls on, and each field looked at as parsed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.pmod("doc_id", F.lit(len(CASES))).cast("int").alias("k"))
    listed = F.array(*(F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, found)).alias("fields")) for name, found in CASES))
    held = docs.select("doc_id", F.get(listed, F.col("k")).alias("case")).select("doc_id", "case.name", "case.fields")
    p = F.col("parsed")
    people = lambda c: F.array_join(p[f"{c}Authorship"]["authors"], "|")
    read = {
        "genus": p["genus"], "uni": p["uninomial"], "sub": p["infragenericEpithet"], "sp": p["specificEpithet"], "isp": p["infraspecificEpithet"], "rank": p["rank"], "code": p["code"], "phrase": p["phrase"],
        "tax": p["taxonomicNote"], "nom": p["nomenclaturalNote"], "unparsed": p["unparsed"], "comb": people("combination"), "bas": people("basionym"), "year": p["combinationAuthorship"]["year"],
    }
    table = F.create_map(*(x for k, v in read.items() for x in (F.lit(k), F.coalesce(v, F.lit("")))))
    return parse_names(held).select("doc_id", "name", F.explode("fields").alias("field"), table.alias("t")).select("doc_id", "name", "field", F.col("t")[F.col("field")].alias("value"))


def rank_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document the rank that its doc_id falls on, with its groups and how it compares with SPECIES."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.get(F.array(*map(F.lit, ranks.NAMES)), F.pmod("doc_id", F.lit(len(ranks.NAMES))).cast("int")).alias("rank"))
    info, species = F.col("rank_info"), F.lit("SPECIES")
    return ranks.with_rank(docs).select(
        "doc_id", "rank", info["ordinal"].cast("long").alias("ordinal"), *(info[c].alias(c) for c in ("code", "marker", "plural", "major", "infraspecific", "infrageneric_strictly", "family_group", "genus_group", "suprageneric", "ambiguous_marker")),
        ranks.higher_than(F.col("rank"), species).alias("higher"), ranks.lower_than(F.col("rank"), species).alias("lower"), ranks.from_name(F.lower("rank")).isNull().alias("exact"),
    )


def _values(rows: list[tuple]) -> str:
    text = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(text, row)) + ")" for row in rows)


_BINOMIAL = "(NOT vir AND (vg OR vs))"
#: Of names that are a binomial (k is 0) or a genus before sp.
_SHORT = f"((k = 0 AND {_BINOMIAL}) OR (k = 1 AND vg))"
#: The paths of a binomial with an author and a year.
_WHOLE = "|".join(sorted(("rank", "code", "genus", "specificEpithet", "type", "state", "candidatus", "extinct", "doubtful", "manuscript", "warnings", "combinationAuthorship.authors", "combinationAuthorship.exAuthors", "combinationAuthorship.year", "basionymAuthorship.authors", "basionymAuthorship.exAuthors")))

_SELECT = {
    "parse_binomial": "doc_id, pos, 'parsed' AS result, genus, species, 'SPECIES' AS rank, 'SCIENTIFIC' AS type",
    "parse_author_year": "doc_id, pos, genus, author || '|Mill.' AS authors, y, 'ZOOLOGICAL' AS code",
    "parse_basionym": "doc_id, pos, species, author AS basionym, 'Hook.f.' AS combination, 'BOTANICAL' AS code",
    "parse_ex_authors": "doc_id, pos, author AS ex, 'J.Smith' AS authors, 'Fr.' AS sanctioning, 'BOTANICAL' AS code",
    "parse_separate_authorship": "doc_id, pos, 'J.B.' || author AS authors, y",
    "parse_trinomial_marker": "doc_id, pos, infra, CASE k WHEN 0 THEN 'VARIETY' WHEN 1 THEN 'SUBSPECIES' ELSE 'FORM' END AS rank, 'L.' AS species_author",
    "parse_trinomial_bare": "doc_id, pos, infra, 'SUBSPECIES' AS rank, 'ZOOLOGICAL' AS code",
    "parse_subgenus": "doc_id, pos, author AS subgenus, species",
    "parse_infrageneric": "doc_id, pos, genus, author AS section, 'SECTION_BOTANY' AS rank, 'BOTANICAL' AS code",
    "parse_hybrid": "doc_id, pos, 'SPECIFIC' AS notho, species, author AS authors",
    "parse_cultivar": "doc_id, pos, author AS cultivar, 'CULTIVAR' AS rank, 'CULTIVARS' AS code",
    "parse_notes": "doc_id, pos, CASE k WHEN 0 THEN 'nom. illeg.' END AS nom_note, CASE k WHEN 1 THEN 'sensu ' || author || ', 1900' END AS tax_note, CASE k WHEN 2 THEN true END AS spelling, 'L.' AS authors",
    "parse_informal": "doc_id, pos, 'informal' AS result, genus AS taxon, 'GENUS' AS \"taxonRank\", 'SPECIES' AS rank, 'sp. RE' || y AS phrase",
    "parse_qualifier": "doc_id, pos, 'parsed' AS result, 'INFORMAL' AS type, species, 'cf.' AS qualifier",
    "parse_published_in": "doc_id, pos, author || ', ' || y AS published_in, CAST(y AS BIGINT) AS published_year, y",
    "parse_candidatus": "doc_id, pos, genus, true AS candidatus, 'BACTERIAL' AS code",
    "parse_quadrinomial": "doc_id, pos, infra, 'FORM' AS rank, 'Removed: subsp. ' || species || '|name was quadrinomial' AS warnings",
    "parse_markup": "doc_id, pos, genus, species, true AS extinct, 'xml tags removed' AS warnings",
    "preflight_identifier": "doc_id, pos, 'error' AS result, 'IDENTIFIER' AS type, CASE k WHEN 0 THEN 'BOLD:AAA' || y WHEN 1 THEN 'SH12' || y || '.07FU' ELSE 'ATCC ' || y END AS name",
    "preflight_virus": "doc_id, pos, 'error' AS result, 'OTHER' AS type, 'VIRUS' AS code, 'Unparsable OTHER name: ' || author || ' mosaic virus ' || y AS message",
    "preflight_placeholder": "doc_id, pos, 'error' AS result, 'PLACEHOLDER' AS type, 'Unparsable PLACEHOLDER name: ' || genus || ' incertae sedis' AS message",
    "preflight_rescue": "doc_id, pos, 'informal' AS result, genus AS taxon, 'group' AS phrase, 'UNRANKED' AS rank",
    "hybrid_formula": "doc_id, pos, 'error' AS result, CASE WHEN vg OR vs OR vi THEN 'OTHER' ELSE 'FORMULA' END AS type, genus || ' ' || species || ' × ' || genus || ' ' || infra AS name",
    "canonical_name": "doc_id, pos, genus || ' ' || species || ' var. ' || infra || ' (L.) ' || author AS \"full\", genus || ' ' || species || ' var. ' || infra AS bare, genus || ' ' || species || ' ' || infra AS minimal, '(L.) ' || author AS authorship",
    "render_forms": (
        "doc_id, pos, CASE k WHEN 0 THEN genus || ' ' || species || ' subsp. ' || infra || ' (L.) ' || author WHEN 1 THEN genus || ' × ' || species || ' ' || author ELSE genus || ' ' || species || ' ' || author || ', ' || y END AS \"full\", "
        "CASE k WHEN 0 THEN genus || ' ' || species || ' subsp. ' || infra WHEN 1 THEN genus || ' × ' || species ELSE genus || ' ' || species END AS bare, CASE k WHEN 0 THEN genus || ' ' || species || ' ' || infra ELSE genus || ' ' || species END AS minimal, "
        "CASE k WHEN 0 THEN genus || ' ' || species || ' Mill. subsp. ' || infra || ' (L.) ' || author || ' sensu Raeus, nom. illeg.' WHEN 1 THEN genus || ' × ' || species || ' ' || author ELSE genus || ' (AErus) ' || species || ' ' || author || ', ' || y END AS complete, "
        "CASE k WHEN 0 THEN '<i>' || genus || '</i> <i>' || species || '</i> Mill. subsp. <i>' || infra || '</i> (L.) ' || author || ' sensu Raeus, nom. illeg.' WHEN 1 THEN '<i>' || genus || '</i> × <i>' || species || '</i> ' || author ELSE '<i>' || genus || '</i> (<i>AErus</i>) <i>' || species || '</i> ' || author || ', ' || y END AS html, "
        "CASE k WHEN 0 THEN '(L.) ' || author WHEN 1 THEN author ELSE author || ', ' || y END AS authorship"
    ),
    "parse_separate_notes": "doc_id, pos, CASE k WHEN 0 THEN 'nom. nud.' END AS nom_note, CASE k WHEN 1 THEN 'sensu Mill.' WHEN 2 THEN 'auct. non L.' END AS tax_note, CASE k WHEN 1 THEN true END AS spelling, CASE k WHEN 2 THEN '' ELSE author END AS authors, CASE k WHEN 0 THEN y END AS y",
    "parse_in_sql": "doc_id, pos, genus, place, CASE place WHEN 0 THEN author ELSE 'Mill.' END AS author FROM n, (VALUES (CAST(0 AS BIGINT)), (CAST(1 AS BIGINT))) AS t(place)",
    "flat_view": "genus || ' ' || species || ' ' || author || ', ' || y AS \"scientificName\", 'parsed' AS result, 'SPECIES' AS rank, genus, species AS \"specificEpithet\", author AS \"combinationAuthors\", y AS \"combinationYear\", genus || ' ' || species AS \"canonicalWithoutAuthorship\"",
    "rank_dimension_join": "doc_id, pos, CASE k WHEN 0 THEN 'VARIETY' WHEN 1 THEN 'SUBSPECIES' ELSE 'FORM' END AS rank, CASE k WHEN 0 THEN 'var.' WHEN 1 THEN 'subsp.' ELSE 'f.' END AS marker, 'INFRASPECIFIC_NAME' AS major, true AS infraspecific",
    "suffix_rank": "doc_id, pos, CASE k WHEN 2 THEN 'ORDER' ELSE 'FAMILY' END AS rank",
    "unlikely_year": "doc_id, pos, k = 1 AS unlikely",
    "code_votes": "doc_id, pos, CASE k WHEN 1 THEN 'ZOOLOGICAL' END AS code",
    "parse_distinct": "doc_id, pos, genus, CASE k WHEN 0 THEN 'vulgaris' ELSE species END AS species",
    "parse_stream": "doc_id, pos, 'parsed' AS result, genus",
    "compare_runs": f"doc_id || '/' || pos AS row, CASE WHEN k = 0 THEN 'fields' WHEN vg OR va THEN 'parsed -> error' ELSE 'parsed -> informal' END AS change, CASE WHEN k = 0 THEN 'specificEpithet' WHEN vg OR va THEN '{_WHOLE}' ELSE 'code|combinationAuthorship.authors|combinationAuthorship.year|phrase|specificEpithet|type' END AS paths FROM n WHERE k <> 1",
    "interesting_filter": f"doc_id, pos, CASE WHEN k = 1 AND NOT (vg OR vs) THEN 'parsed' ELSE 'error' END AS result FROM n WHERE k > 0 OR {_BINOMIAL}",
    "otu_filter": "doc_id, pos, genus AS name FROM n WHERE k = 2",
    "three_way_split": f"CASE WHEN k = 2 OR {_SHORT} THEN 'error' WHEN k = 0 THEN 'parsed' ELSE 'informal' END AS result, count(*) AS n FROM n GROUP BY 1",
    "type_breakdown": f"CASE WHEN k = 2 THEN 'IDENTIFIER' WHEN {_SHORT} THEN 'OTHER' WHEN k = 0 THEN 'SCIENTIFIC' ELSE 'INFORMAL' END AS type, count(*) AS n FROM n GROUP BY 1",
    "band_report": "CASE k WHEN 0 THEN '1:determined+annotated' WHEN 1 THEN '2:indetermined' ELSE '3:phrase' END AS band, 'SPECIES' AS rank, 'genus' AS anchor, count(*) AS n FROM n WHERE NOT (vg OR (k = 0 AND vs)) GROUP BY 1",
}
#: Where the gate takes a name for a virus's, by query: the row is an error and its fields are null. A binomial in -virus
#: parses as a virus name; an author with a year tells an animal.
_REJECTED = {
    "parse_binomial": _BINOMIAL, "parse_basionym": "vg OR vs OR va", "parse_ex_authors": "vg OR vs OR va", "parse_separate_authorship": "vg OR vs", "parse_trinomial_marker": "vg OR vs OR vi",
    "parse_trinomial_bare": "vg OR vs OR vi OR va", "parse_subgenus": "NOT vir AND (vg OR vs OR va)", "parse_infrageneric": "vg OR va", "parse_hybrid": "vg OR vs OR va", "parse_cultivar": "vg OR vs OR va",
    "parse_notes": "k <> 1 AND (vg OR vs)", "parse_informal": "vg", "parse_qualifier": "vg OR vs", "parse_candidatus": "vg OR vs", "parse_quadrinomial": "vg OR vs OR vi", "parse_markup": "vg OR vs",
    "preflight_rescue": "vg", "canonical_name": "vg OR vs OR vi OR va", "render_forms": "k <> 2 AND (vg OR vs OR va OR (k = 0 AND vi))", "parse_separate_notes": _BINOMIAL, "rank_dimension_join": "vg OR vs OR vi",
    "parse_distinct": "NOT vir AND (vg OR (k <> 0 AND vs))", "parse_stream": _BINOMIAL,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {name: globals()[name] for name in _SELECT if name in globals() and name not in ("flat_view",)}
    others = (compare_places, reservoir_sample, judge_batches, verdict_scan, name_cases, rank_table, quote_normalise, benchmark_percentiles, html_strip)
    return own | {"flat_view": flat} | {f.__name__: f for f in others}


def oracle_sql() -> dict[str, str]:
    found = {name: f"{_BASE} SELECT {cols}" + ("" if " FROM n" in cols else " FROM n") for name, cols in _SELECT.items()}
    for name, virus in _REJECTED.items():
        found[name] += f" WHERE NOT ({virus}) UNION ALL BY NAME SELECT doc_id, pos" + (", 'error' AS result" if " AS result" in _SELECT[name] else "") + f" FROM n WHERE {virus}"
    cases = _values([(i, name, k, v) for i, (name, fields) in enumerate(CASES) for k, v in fields.items()])
    found["name_cases"] = f"SELECT doc_id, name, field, value FROM documents JOIN (VALUES {cases}) AS t(i, name, field, value) ON doc_id % {len(CASES)} = i"
    found["rank_table"] = f"""
        WITH r AS (SELECT * FROM (VALUES {_values([tuple(i[c] for c in ("rank", "ordinal", "code", "marker", "plural", "major")) for i in ranks.INFO.values()])}) AS t(rank, ordinal, code, marker, plural, major)),
             o AS (SELECT max(ordinal) FILTER (rank = 'SPECIES') AS s, max(ordinal) FILTER (rank = 'GENUS') AS g, max(ordinal) FILTER (rank = 'SPECIES_AGGREGATE') AS a, max(ordinal) FILTER (rank = 'GIGAFAMILY') AS f,
                          max(ordinal) FILTER (rank = 'SUPRAGENERIC_NAME') AS u, max(ordinal) FILTER (rank = 'SUPERGENUS') AS v FROM r)
        , k AS (SELECT rank, CAST(ordinal AS BIGINT) AS ordinal, code, marker, plural, major, ordinal > s AND rank NOT IN ('OTHER', 'UNRANKED') AS infraspecific, ordinal > g AND ordinal < a AS infrageneric_strictly,
               ordinal >= f AND ordinal < u AS family_group, ordinal >= v AND ordinal < a AS genus_group, ordinal < g AS suprageneric, marker IS NOT NULL AND count(*) OVER (PARTITION BY marker) > 1 AS ambiguous_marker,
               ordinal < s AS higher, ordinal > s AND rank NOT IN ('OTHER', 'UNRANKED') AS lower, true AS exact FROM r, o)
        SELECT doc_id, k.* FROM documents JOIN (VALUES {_values(list(enumerate(ranks.NAMES)))}) AS n(i, rank) ON doc_id % {len(ranks.NAMES)} = i JOIN k USING (rank)"""
    found["compare_places"] = f"""{_BASE}, a AS (SELECT row_number() OVER (ORDER BY doc_id, pos) - 1 AS place, genus || species AS name, author FROM n),
             b AS (SELECT row_number() OVER (ORDER BY doc_id, pos) - 1 AS place, genus || CASE k WHEN 1 THEN infra ELSE species END AS name, author FROM n WHERE doc_id % 100 <> 7 OR pos > 0)
        SELECT place, CASE WHEN b.name IS NULL THEN 'left only' WHEN a.name IS NULL THEN 'right only' ELSE 'fields' END AS change,
               CASE WHEN a.name IS NULL OR b.name IS NULL THEN '' ELSE concat_ws('|', CASE WHEN a.name <> b.name THEN 'name' END, CASE WHEN a.author <> b.author THEN 'author' END) END AS paths
        FROM a FULL JOIN b USING (place) WHERE a.name IS DISTINCT FROM b.name OR a.author IS DISTINCT FROM b.author"""
    found["reservoir_sample"] = """
        WITH RECURSIVE p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents),
             g AS (SELECT CAST(100 AS BIGINT) AS place, CAST(xor(42, 25214903917) AS HUGEINT) AS before
                   UNION ALL SELECT place + 1, (((before * 25214903917 + 11) % 281474976710656) * 25214903917 + 11) % 281474976710656 FROM g WHERE place + 1 < (SELECT count(*) FROM documents)),
             r AS (SELECT place, (before * 25214903917 + 11) % 281474976710656 AS one FROM g),
             t AS (SELECT place, one, (one * 25214903917 + 11) % 281474976710656 AS two FROM r),
             s AS (SELECT place, CAST(floor(CAST((one // 4194304) * 134217728 + two // 2097152 AS DOUBLE) * (1.0::DOUBLE / 9007199254740992) * (place + 1)) AS BIGINT) AS slot FROM t),
             u AS (SELECT place, place AS slot FROM p WHERE place < 100 UNION ALL SELECT place, slot FROM s WHERE slot < 100)
        SELECT slot, doc_id, place FROM (SELECT slot, max(place) AS place FROM u GROUP BY slot) JOIN p USING (place)"""
    found["judge_batches"] = """
        SELECT doc_id, lang, (place // 25) AS batch, place % 25 AS "index" FROM (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))"""
    found["verdict_scan"] = """
        SELECT doc_id, doc_id * 2 + k AS "index", 'ok' AS verdict, 'high' AS confidence, md5(CASE k WHEN 0 THEN coalesce(text, '') ELSE '} ] { \\ "' END) AS note_md5 FROM documents, (VALUES (0), (1)) AS t(k)"""
    found["quote_normalise"] = "SELECT doc_id, chr(39) || translate(coalesce(text, ''), '’‘“”', chr(39) || chr(39) || '\"\"') || '\"' AS quoted FROM documents"
    found["benchmark_percentiles"] = (
        "SELECT count(n_chars) AS n, CAST(sum(n_chars) AS BIGINT) AS total, min(n_chars) AS min, avg(n_chars) AS avg, quantile_disc(n_chars, 0.5) AS p50, quantile_disc(n_chars, 0.95) AS p95, max(n_chars) AS max FROM documents"
    )
    found["html_strip"] = (
        "SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(html, '</?[a-zA-Z][^<>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS text FROM pages"
    )
    return found

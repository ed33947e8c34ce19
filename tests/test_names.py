import json

import pytest
from pyspark.sql import functions as F

from taxaflow.functions import authors, render, text
from taxaflow.functions import sql as sql_functions
from taxaflow.operators import ordered, reports
from taxaflow.operators.flat import flat_view
from taxaflow.operators.parse import parse_names
from taxaflow.plans import ranks
from taxaflow.sources import names as sources

#: Input, result and the fields that differ from their defaults.
CASES = [
    ("Vulpes vulpes silaceus Miller, 1907", "parsed", {"rank": "SUBSPECIES", "code": "ZOOLOGICAL", "genus": "Vulpes", "specificEpithet": "vulpes", "infraspecificEpithet": "silaceus", "comb": ["Miller"], "year": "1907"}),
    ("Abies alba Mill.", "parsed", {"rank": "SPECIES", "genus": "Abies", "specificEpithet": "alba", "comb": ["Mill."]}),
    ("Ja Uéno 1955", "parsed", {"uninomial": "Ja", "comb": ["Uéno"], "year": "1955", "code": "ZOOLOGICAL"}),
    ("Gazella farasani Thouless, al Bassri, 1991", "parsed", {"comb": ["Thouless", "al Bassri"], "code": "ZOOLOGICAL"}),
    ("Agaricus ericetorum Pers. : Fr.", "parsed", {"comb": ["Pers."], "sanctioningAuthor": "Fr.", "code": "BOTANICAL"}),
    ("Ophidocampa tapacumae Ehrenberg, 1870, 1869", "parsed", {"year": "1870", "imprint": "1869"}),
    ("Acer campestre L. cv. 'nanum'", "parsed", {"cultivarEpithet": "nanum", "comb": ["L."], "rank": "CULTIVAR", "code": "CULTIVARS"}),
    ("Ca. Phytoplasma allocasuarinae", "parsed", {"candidatus": True, "code": "BACTERIAL"}),
    ("Achromobacter Yabuuchi and Yano, 1981 emend. Yabuuchi et al., 1998", "parsed", {"taxonomicNote": "emend. Yabuuchi et al., 1998", "comb": ["Yabuuchi", "Yano"]}),
    ("Centropyge fisheri (non Snyder, 1904)", "parsed", {"taxonomicNote": "non Snyder, 1904", "comb": []}),
    ("Hypsicera femoralis (Geoffroy in Fourcroy, 1785)", "parsed", {"bas": ["Geoffroy"], "publishedIn": "Fourcroy, 1785", "publishedInYear": 1785}),
    ("Serratia sp. RE1-2a", "informal", {"genus": "Serratia", "phrase": "sp. RE1-2a", "rank": "SPECIES"}),
    ("Ichneumonidae sp. UAM Ento 145060", "informal", {"genus": "Ichneumonidae", "phrase": "sp. UAM Ento 145060"}),
    ("Salicornia cf. patula", "parsed", {"specificEpithet": "patula", "type": "INFORMAL"}),
    ("Aquimarina muelleri DSM 19832", "parsed", {"phrase": "DSM 19832", "type": "INFORMAL"}),
    ("Uba fallai Fletcher, 1938", "parsed", {"genus": "Uba", "specificEpithet": "fallai"}),
    ("Iteaphila-group", "informal", {"genus": "Iteaphila", "phrase": "group"}),
    ("Asteraceae", "parsed", {"uninomial": "Asteraceae", "rank": "FAMILY"}),
]
ERRORS = [
    ("SH1957732.10FU", "IDENTIFIER"), ("BOLD:AAA0001", "IDENTIFIER"), ("sh460441.07fu", "IDENTIFIER"), ("OTU-17", "IDENTIFIER"), ("zOTU44", "IDENTIFIER"), ("MAG-24", "IDENTIFIER"),
    ("UBA12345", "IDENTIFIER"), ("GCA_000123", "IDENTIFIER"), ("ATCC BAA-123", "IDENTIFIER"), ("LMG 6923T", "IDENTIFIER"), ("ATCC-11775", "IDENTIFIER"), ("Clade A", "OTHER"),
    ("Tobacco mosaic virus", "OTHER"), ("incertae sedis", "PLACEHOLDER"), ("Quercus robur L. × Quercus petraea", "FORMULA"), ("@abc", "OTHER"), ("", "OTHER"), (None, "OTHER"), ("a" * 1001, "OTHER"),
    ("?? x", "OTHER"), ("NC12A-lineage", "OTHER"), ("BIN BOLD:AAA1234", "OTHER"),
]


@pytest.fixture(scope="module")
def parsed(spark):
    names = [c[0] for c in CASES] + [e[0] for e in ERRORS]
    rows = parse_names(spark.createDataFrame([(n,) for n in names], "name string")).select("name", "result", F.to_json("parsed").alias("p"), F.to_json("error").alias("e")).collect()
    return {r.name: r for r in rows}


@pytest.mark.parametrize(("name", "result", "want"), CASES)
def test_case(parsed, name, result, want):
    row = parsed[name]
    p = json.loads(row.p)
    p |= {"comb": p["combinationAuthorship"]["authors"], "bas": p["basionymAuthorship"]["authors"], "year": p["combinationAuthorship"].get("year"), "imprint": p["combinationAuthorship"].get("imprintYear")}
    assert row.result == result
    assert {k: p.get(k) for k in want} == want


#: Rows of SURVEY 2.3: the row, a name, and the fields that differ from their defaults.
STRIPPED = [
    (9, "Abies alba RNA2x", {"phrase": "RNA2x", "type": "INFORMAL", "specificEpithet": "alba"}),
    (22, "Abies alba Hort. ex Mill.", {"ex": ["hort."], "comb": ["Mill."]}),
    (26, "Abies alba t.infr. minor Mill.", {"specificEpithet": "alba", "infraspecificEpithet": "minor"}),
    (33, "Abies species.", {"uninomial": "Abies"}),
    (38, "Abies alba Anon", {"comb": ["anon."]}),
    (42, "Abies alba Mill. s. lat. rest of it", {"taxonomicNote": "s.lat.", "unparsed": "rest of it", "comb": ["Mill."]}),
    (43, "Abies alba Mill. s.s. rest", {"taxonomicNote": "s.s.", "unparsed": "rest", "comb": ["Mill."]}),
    (50, "Abies alba Mill., Title 12: 3 nom. illeg. (1988).", {"publishedIn": "Title 12: 3 (1988)", "nomenclaturalNote": "nom. illeg.", "comb": ["Mill."], "year": "1988"}),
    (51, "Abies alba Miller. Journal of Trees 12, 1988.", {"publishedIn": "Journal of Trees 12, 1988", "comb": ["Miller"], "year": "1988"}),
    (51, "Abies alba Miller. Journal of Trees 12: 123-145.", {"publishedIn": "Journal of Trees 12: 123-145", "comb": ["Miller"], "warnings": ["nomenclatural reference removed"]}),
    (52, "Abies alba Mill., Journal of Trees 12", {"publishedIn": "Journal of Trees 12", "comb": ["Mill."], "warnings": ["nomenclatural reference removed"]}),
    (55, "sect. Taeda", {"infragenericEpithet": "Taeda", "rank": "SECTION_BOTANY", "code": "BOTANICAL"}),
    (55, "subgen. Trematostoma Sacc.", {"infragenericEpithet": "Trematostoma", "rank": "SUBGENUS", "comb": ["Sacc."]}),
]


def test_annotation_rules(spark):
    rows = parse_names(spark.createDataFrame([(n,) for _, n, _ in STRIPPED], "name string")).select("name", F.to_json("parsed").alias("p"), F.to_json("error").alias("e")).collect()
    got = {r.name: json.loads(r.p or "{}") | {"error": r.e} for r in rows}
    wrong = []
    for k, name, want in STRIPPED:
        p = got[name]
        comb = p.get("combinationAuthorship", {})
        p |= {"comb": comb.get("authors"), "ex": comb.get("exAuthors"), "year": comb.get("year")}
        wrong += [(k, name, p)] if {f: p.get(f) for f in want} != want else []
    assert not wrong


@pytest.mark.parametrize(("name", "kind"), ERRORS)
def test_error(parsed, name, kind):
    assert parsed[name].result == "error" and json.loads(parsed[name].e)["type"] == kind


def test_hints_and_filter(spark):
    df = spark.createDataFrame([("Abies alba", "Balsamo M & Fregni E, 1999", "NONSENSE", None), ("Tobamovirus tabaci", None, None, "ZOOLOGICAL")], "name string, a string, r string, c string")
    got = parse_names(df, "name", "a", "r", "c").where("parsed.rank = 'SPECIES' AND result = 'parsed'").collect()
    assert {r.name: (r.parsed.combinationAuthorship.authors, r.parsed.code) for r in got} == {"Abies alba": (["M.Balsamo", "E.Fregni"], "ZOOLOGICAL"), "Tobamovirus tabaci": ([], "ZOOLOGICAL")}


def test_long_inputs_return(spark):
    names = ["Rnavirus bus " + "Aa.-" * 30, "Abies nomen " + "a." * 20 + "#", "Abies alba Mill. " + "Word " * 150, "Abies alba Mill., " + "word, " * 150]
    assert parse_names(spark.createDataFrame([(n,) for n in names], "name string")).count() == 4


def test_ranks(spark):
    rows = ranks.INFO
    assert len(rows) == 117
    assert (rows["SUBSPECIES"]["code"], rows["SUBSPECIES"]["marker"], rows["SUBSPECIES"]["major"]) == (None, "subsp.", "INFRASPECIFIC_NAME")
    assert [rows[n]["marker"] for n in ("SUPERKINGDOM", "KINGDOM", "MEGACOHORT", "NANORDER", "SUBFORM")] == ["superreg.", "regn.", "megacohort", "nanord.", "subf."]
    assert rows["SECTION_BOTANY"]["ambiguous_marker"] and rows["SECTION_ZOOLOGY"]["marker"] == "sect." and rows["NANORDER"]["major"] == "ORDER"
    assert [rows[n]["plural"] for n in ("GENUS", "PHYLUM", "SERIES_BOTANY", "OTHER")] == ["genera", "phyla", "series", None]
    got = spark.createDataFrame([("GENUS", "SPECIES"), ("OTHER", "SPECIES"), ("SPECIES", "OTHER"), ("x", "SPECIES")], "a string, b string").select(
        ranks.higher_than(F.col("a"), F.col("b")), ranks.lower_than(F.col("a"), F.col("b")), ranks.from_name(F.col("a"))
    )
    assert [tuple(r) for r in got.collect()] == [(True, False, "GENUS"), (False, False, "OTHER"), (False, False, "SPECIES"), (None, None, None)]


def test_requested_ranks_and_codes(spark):
    rows = [("Polygonum", "SPECIES", None), ("Polygonum", "SUBGENUS", None), ("Polygonum alba", "GENUS", None), ("Aus supersect. Bus", None, "ZOOLOGICAL"), ("Lepidoptera alba DC.", "SUBSPECIES", None)]
    got = [r.parsed for r in parse_names(spark.createDataFrame(rows, "name string, r string, c string"), rank="r", code="c").collect()]
    assert (got[0].genus, got[0].rank, got[0].type, got[0].warnings) == ("Polygonum", "SPECIES", "INFORMAL", ["indetermined name missing its terminal epithet"])
    assert (got[1].infragenericEpithet, got[1].uninomial, got[1].rank) == ("Polygonum", None, "SUBGENUS")
    assert (got[2].rank, got[2].doubtful, got[2].warnings) == ("GENUS", True, ["rank does not fit the parsed name"])
    assert (got[3].code, got[3].warnings) == ("BOTANICAL", ["nomenclatural code does not fit the parsed name"])
    assert (got[4].rank, got[4].type) == ("SUBSPECIES", "INFORMAL")


def test_unread_text_is_partial_and_text_without_letters_is_no_name(spark):
    got = parse_names(spark.createDataFrame([("(1234) [Foo]",), ("12 34",)], "name string")).collect()
    assert (got[0].result, got[0].parsed.state, got[0].parsed.unparsed) == ("parsed", "PARTIAL", "(1234) [Foo]")
    assert (got[1].result, got[1].error.type) == ("error", "OTHER")


def test_name_cases(spark, tmp_path):
    from taxaflow.plans import queries
    from taxaflow.plans.cases import CASES

    spark.range(len(CASES)).withColumnRenamed("id", "doc_id").write.parquet(str(tmp_path / "documents.parquet"))
    want = {(i, name, field): value for i, (name, fields) in enumerate(CASES) for field, value in fields.items()}
    assert {(r.doc_id, r.name, r.field): r.value for r in queries.name_cases(spark, str(tmp_path)).collect()} == want


#: Names with odd tokens, and the fields that differ from their defaults.
TOKENS = [
    ("Aus bus subsp. sp. minor Mill.", {"specificEpithet": "bus", "infraspecificEpithet": "minor", "rank": "FORMA_SPECIALIS", "comb": ["Mill."]}),
    ("Aus bus var.", {"specificEpithet": "bus", "rank": "VARIETY", "type": "INFORMAL", "comb": [], "warnings": ["indetermined name missing its terminal epithet"]}),
    ("Aus bus var. Dus", {"specificEpithet": "bus", "infraspecificEpithet": None, "rank": "VARIETY", "comb": ["Dus"]}),
    ("Aus bus Mill. var.", {"specificEpithet": "bus", "rank": "VARIETY", "spec": ["Mill."], "comb": []}),
    ("Aus bus-group Mill.", {"specificEpithet": "bus", "rank": "SPECIES_AGGREGATE", "comb": ["Mill."]}),
    ("Aus bus cus dus eus Mill.", {"specificEpithet": "bus", "infraspecificEpithet": "eus", "rank": "INFRASUBSPECIFIC_NAME", "comb": ["Mill."]}),
    ("Aus bus var. cus dus Mill.", {"infraspecificEpithet": "cus", "unparsed": "dus", "state": "PARTIAL", "comb": ["Mill."]}),
    ("Aus bus subsp. cus L. var. dus (L.) Mill.", {"infraspecificEpithet": "dus", "warnings": ["Removed: subsp. cus L.", "name was quadrinomial"], "bas": ["L."], "comb": ["Mill."]}),
    ("Aus bus (L.) Mill. var. cus Dus", {"infraspecificEpithet": "cus", "rank": "VARIETY", "comb": ["Dus"]}),
    ("Aus near bus", {"specificEpithet": "bus", "type": "INFORMAL", "epithetQualifier": {"SPECIFIC": "near"}}),
    ("Aus bus cf. cus", {"infraspecificEpithet": "cus", "epithetQualifier": {"INFRASPECIFIC": "cf."}}),
    ("Aus (Tin.) bus Mill.", {"infragenericEpithet": "Tin.", "specificEpithet": "bus", "warnings": ["abbreviated subgenus name"]}),
    ("Aus (tin) bus Mill.", {"infragenericEpithet": "Tin", "doubtful": True}),
    ("Aus bus DE LA CRUZ", {"comb": ["DE LA Cruz"]}),
    ("Aus bus Balsamo M Todaro MA, 1999", {"comb": ["M.Balsamo", "M.A.Todaro"], "year": "1999"}),
    ("Aus bus v. d. Beek", {"comb": ["v.d.Beek"]}),
    ("Aus bus Mill. (in press)", {"comb": ["Mill."], "manuscript": True, "nomenclaturalNote": "in press"}),
    ("&lt;i&gt;Abies&lt;/i&gt; alba", {"genus": "Abies", "specificEpithet": "alba"}),
    ("Aus bus L. 'Nana", {"comb": ["L."], "cultivarEpithet": "Nana", "rank": "CULTIVAR"}),
]


def test_tokens(spark):
    rows = parse_names(spark.createDataFrame([(n,) for n, _ in TOKENS], "name string")).select("name", F.to_json("parsed", {"ignoreNullFields": "false"}).alias("p")).collect()
    wrong = []
    for name, want in TOKENS:
        p = json.loads(next(r.p for r in rows if r.name == name) or "{}")
        p |= {k: (p.get(f"{c}Authorship") or {}).get("authors") for k, c in (("comb", "combination"), ("bas", "basionym"), ("spec", "specific"))} | {"year": (p.get("combinationAuthorship") or {}).get("year")}
        got = {k: p.get(k) for k in want}
        wrong += [(name, got, want)] if got != want else []
    assert not wrong


def test_particles_by_rank(spark):
    df = spark.createDataFrame([("Zodarion van Bosmans, 2009", "SPECIES"), ("Zodarion van Bosmans, 2009", None)], "name string, r string")
    got = {r.r: r.parsed for r in parse_names(df, rank="r").collect()}
    assert (got["SPECIES"].specificEpithet, got["SPECIES"].combinationAuthorship.authors) == ("van", ["Bosmans"])
    assert (got[None].uninomial, got[None].combinationAuthorship.authors) == ("Zodarion", ["van Bosmans"])


def test_text_functions(spark):
    row = spark.range(1).select(
        text.trim_control(F.lit("\x00 a \x1f")).alias("trim"), text.is_unlikely_year(F.lit("1499")).alias("early"), text.is_unlikely_year(F.lit("198?")).alias("open"),
        text.published_year(F.lit("in 1788: p. 12, 1801")).alias("year"), text.suffix_rank(F.lit("Felidae"), F.lit("ZOOLOGICAL")).alias("rank"), text.strip_html(F.lit("<i>a</i> &amp; b")).alias("html"),
        authors.render(authors.authorship(F.lit("Hook.f. ex Mill., L. & Gray, 1801"))).alias("who"), render.fold_to_ascii(F.lit("Œnothera ßé Ł")).alias("fold"),
    ).first()
    assert tuple(row) == ("a", True, False, 1801, "FAMILY", "a & b", "Hook.f. ex Mill., L. & Gray, 1801", "OEnothera sse L")
    sql_functions.register(spark)
    assert spark.sql("SELECT suffix_rank('Rosaceae', NULL), is_barcode_otu('bold:abc1')").first()[:] == ("FAMILY", True)


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("scientificName\n# c\n\nAbies alba Mill.\tx\n Poa annua \nBOLD:AAA0001")
    assert sorted(r.name for r in sources.read_names(spark, str(tmp_path / "in")).collect()) == ["Abies alba Mill.", "BOLD:AAA0001", "Poa annua"]
    sources.register(spark)
    numbered = spark.read.format("names").load(str(tmp_path / "in"))
    assert sorted((r.line, r.name) for r in numbered.collect()) == [(4, "Abies alba Mill."), (5, "Poa annua"), (6, "BOLD:AAA0001")]
    done = parse_names(numbered.select("line", "name"))
    for fmt in ("json", "parquet", "tsv"):
        sources.write_results(done, str(tmp_path / fmt), fmt)
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "json")).collect()]
    assert {x["input"]: sorted(x)[0] for x in lines}["BOLD:AAA0001"] == "error"
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "tsv")).count() == 3
    with pytest.raises(ValueError, match="format"):
        sources.write_results(done, str(tmp_path / "x"), "xml")


def test_reports(spark):
    a = parse_names(spark.createDataFrame([(1, "Abies alba"), (2, "Poa sp."), (3, "unknown"), (4, "Poa annua")], "line long, name string"))
    b = parse_names(spark.createDataFrame([(1, "Abies alba"), (2, "Poa annua"), (3, "unknown"), (5, "Poa annua")], "line long, name string"))
    assert {r.result: r.n for r in reports.summary(a).collect()} == {"parsed": 2, "informal": 1, "error": 1}
    assert {r.line: r.change for r in reports.compare_runs(a, b).collect()} == {2: "informal -> parsed", 4: "left only", 5: "right only"}
    assert ordered.review_sample(a, reports.is_interesting(), 3, 1, "line").count() == 3
    assert reports.path_counts(reports.compare_runs(a, b)).count() > 0
    assert [r[0] for r in a.orderBy("line").select(reports.canonical_or_input()).collect()] == ["Abies alba", "Poa sp.", "unknown", "Poa annua"]
    assert flat_view(a).where("result = 'error'").first().error == "Unparsable PLACEHOLDER name: unknown"


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(5).count() == 5
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names)

"""The rank dimension: order, code, marker, plural and groups of taxonomic ranks, and their comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- Fixed values: one line a rank, from high to low: name, code, marker, plural, major rank, flags. ----
_TABLE = """
SUPERDOMAIN - superdom. superdomains DOMAIN -
DOMAIN - dom. domains DOMAIN -
SUBDOMAIN - subdom. subdomains DOMAIN -
INFRADOMAIN - infradom. infradomains DOMAIN -
EMPIRE - imp. empires EMPIRE -
REALM VIRUS realm realms REALM -
SUBREALM VIRUS subrealm subrealms REALM -
SUPERKINGDOM - superreg. superkingdoms KINGDOM -
KINGDOM - regn. kingdoms KINGDOM linnean
SUBKINGDOM - subreg. subkingdoms KINGDOM -
INFRAKINGDOM - infrareg. infrakingdoms KINGDOM -
SUPERPHYLUM - superphyl. superphyla PHYLUM -
PHYLUM - phyl. phyla PHYLUM linnean
SUBPHYLUM - subphyl. subphyla PHYLUM -
INFRAPHYLUM - infraphyl. infraphyla PHYLUM -
PARVPHYLUM ZOOLOGICAL parvphyl. parvphyla PHYLUM -
MICROPHYLUM ZOOLOGICAL microphyl. microphyla PHYLUM -
NANOPHYLUM ZOOLOGICAL nanophyl. nanophyla PHYLUM -
CLAUDIUS ZOOLOGICAL claud. claudius CLAUDIUS -
GIGACLASS ZOOLOGICAL gigacl. gigaclasses CLASS -
MEGACLASS ZOOLOGICAL megacl. megaclasses CLASS -
SUPERCLASS - supercl. superclasses CLASS -
CLASS - cl. classes CLASS linnean
SUBCLASS - subcl. subclasses CLASS -
INFRACLASS - infracl. infraclasses CLASS -
SUBTERCLASS ZOOLOGICAL subtercl. subterclasses CLASS -
PARVCLASS ZOOLOGICAL parvcl. parvclasses CLASS -
SUPERDIVISION ZOOLOGICAL superdiv. superdivisions DIVISION_ZOOLOGY -
DIVISION_ZOOLOGY ZOOLOGICAL div. division_zoologys DIVISION_ZOOLOGY -
SUBDIVISION ZOOLOGICAL subdiv. subdivisions DIVISION_ZOOLOGY -
INFRADIVISION ZOOLOGICAL infradiv. infradivisions DIVISION_ZOOLOGY -
SUPERLEGION ZOOLOGICAL superleg. superlegions LEGION -
LEGION ZOOLOGICAL leg. legions LEGION -
SUBLEGION ZOOLOGICAL subleg. sublegions LEGION -
INFRALEGION ZOOLOGICAL infraleg. infralegions LEGION -
MEGACOHORT ZOOLOGICAL megacohort megacohorts COHORT -
SUPERCOHORT ZOOLOGICAL supercohort supercohorts COHORT -
COHORT ZOOLOGICAL cohort cohorts COHORT -
SUBCOHORT ZOOLOGICAL subcohort subcohorts COHORT -
INFRACOHORT ZOOLOGICAL infracohort infracohorts COHORT -
GIGAORDER ZOOLOGICAL gigaord. gigaorders ORDER -
MAGNORDER ZOOLOGICAL magnord. magnorders ORDER -
GRANDORDER ZOOLOGICAL grandord. grandorders ORDER -
MIRORDER ZOOLOGICAL mirord. mirorders ORDER -
SUPERORDER - superord. superorders ORDER -
ORDER - ord. orders ORDER linnean
NANORDER ZOOLOGICAL nanord. nanorders ORDER -
HYPOORDER ZOOLOGICAL hypoord. hypoorders ORDER -
MINORDER ZOOLOGICAL minord. minorders ORDER -
SUBORDER - subord. suborders ORDER -
INFRAORDER - infraord. infraorders ORDER -
PARVORDER ZOOLOGICAL parvord. parvorders ORDER -
SUPERSECTION_ZOOLOGY ZOOLOGICAL supersect. supersection_zoologys SECTION_ZOOLOGY -
SECTION_ZOOLOGY ZOOLOGICAL sect. section_zoologys SECTION_ZOOLOGY -
SUBSECTION_ZOOLOGY ZOOLOGICAL subsect. subsection_zoologys SECTION_ZOOLOGY -
SUPERSERIES_ZOOLOGY ZOOLOGICAL superser. superseries SERIES_ZOOLOGY -
SERIES_ZOOLOGY ZOOLOGICAL ser. series SERIES_ZOOLOGY -
SUBSERIES_ZOOLOGY ZOOLOGICAL subser. subseries SERIES_ZOOLOGY -
FALANX - falanx falanges FALANX legacy
GIGAFAMILY ZOOLOGICAL gigafam. gigafamilies FAMILY -
MEGAFAMILY ZOOLOGICAL megafam. megafamilies FAMILY -
GRANDFAMILY ZOOLOGICAL grandfam. grandfamilies FAMILY -
SUPERFAMILY - superfam. superfamilies FAMILY -
EPIFAMILY ZOOLOGICAL epifam. epifamilies FAMILY -
FAMILY - fam. families FAMILY linnean
SUBFAMILY - subfam. subfamilies FAMILY -
INFRAFAMILY - infrafam. infrafamilies FAMILY -
SUPERTRIBE - supertrib. supertribes TRIBE -
TRIBE - trib. tribes TRIBE -
SUBTRIBE - subtrib. subtribes TRIBE -
INFRATRIBE - infratrib. infratribes TRIBE -
SUPRAGENERIC_NAME - supragen. suprageneric_names SUPRAGENERIC_NAME uncomparable
SUPERGENUS - supergen. supergenera GENUS -
GENUS - gen. genera GENUS linnean
SUBGENUS - subgen. subgenera GENUS -
INFRAGENUS - infrag. infragenera GENUS -
DIVISION_BOTANY BOTANICAL div. divisions DIVISION_BOTANY -
SUPERSECTION_BOTANY BOTANICAL supersect. supersection_botanys SECTION_BOTANY -
SECTION_BOTANY BOTANICAL sect. section_botanys SECTION_BOTANY -
SUBSECTION_BOTANY BOTANICAL subsect. subsection_botanys SECTION_BOTANY -
SUPERSERIES_BOTANY BOTANICAL superser. superseries SERIES_BOTANY -
SERIES_BOTANY BOTANICAL ser. series SERIES_BOTANY -
SUBSERIES_BOTANY BOTANICAL subser. subseries SERIES_BOTANY -
INFRAGENERIC_NAME - infragen. infrageneric_names GENUS uncomparable
SPECIES_AGGREGATE - agg. species_aggregates SPECIES -
SPECIES - sp. species SPECIES linnean
INFRASPECIFIC_NAME - infrasp. infraspecific_names INFRASPECIFIC_NAME uncomparable
GREX CULTIVARS gx grexs INFRASPECIFIC_NAME -
KLEPTON ZOOLOGICAL klepton kleptons INFRASPECIFIC_NAME legacy
SUBSPECIES - subsp. subspecies INFRASPECIFIC_NAME -
CULTIVAR_GROUP CULTIVARS - - INFRASPECIFIC_NAME -
CONVARIETY CULTIVARS convar. convarieties INFRASPECIFIC_NAME legacy
INFRASUBSPECIFIC_NAME - infrasubsp. infrasubspecific_names INFRASPECIFIC_NAME uncomparable
PROLES BOTANICAL prol. proles INFRASPECIFIC_NAME legacy
NATIO ZOOLOGICAL natio natios INFRASPECIFIC_NAME legacy
ABERRATION ZOOLOGICAL ab. aberrations INFRASPECIFIC_NAME legacy
MORPH ZOOLOGICAL morph morphs INFRASPECIFIC_NAME legacy
SUPERVARIETY - supervar. supervarieties INFRASPECIFIC_NAME -
VARIETY - var. varieties INFRASPECIFIC_NAME -
SUBVARIETY - subvar. subvarieties INFRASPECIFIC_NAME -
SUPERFORM - superf. superforms INFRASPECIFIC_NAME -
FORM - f. forms INFRASPECIFIC_NAME -
SUBFORM - subf. subforms INFRASPECIFIC_NAME -
PATHOVAR BACTERIAL pv. pathovars INFRASPECIFIC_NAME -
BIOVAR BACTERIAL biovar biovars INFRASPECIFIC_NAME -
CHEMOVAR BACTERIAL chemovar chemovars INFRASPECIFIC_NAME -
MORPHOVAR BACTERIAL morphovar morphovars INFRASPECIFIC_NAME -
PHAGOVAR BACTERIAL phagovar phagovars INFRASPECIFIC_NAME -
SEROVAR BACTERIAL serovar serovars INFRASPECIFIC_NAME -
CHEMOFORM BACTERIAL chemoform chemoforms INFRASPECIFIC_NAME -
FORMA_SPECIALIS BOTANICAL f.sp. forma_specialiss INFRASPECIFIC_NAME -
LUSUS BOTANICAL lusus lusi INFRASPECIFIC_NAME legacy
CULTIVAR CULTIVARS cv. cultivars INFRASPECIFIC_NAME -
MUTATIO ZOOLOGICAL mut. mutatios INFRASPECIFIC_NAME -
STRAIN - strain strains INFRASPECIFIC_NAME -
OTHER - - - OTHER uncomparable
UNRANKED - - - UNRANKED uncomparable
"""


def _read() -> dict[str, dict[str, object]]:
    """The table's lines with the groups that follow from the order of the ranks."""
    lines = [line.split() for line in _TABLE.split("\n") if line]
    place = {line[0]: k for k, line in enumerate(lines)}
    markers = [line[2] for line in lines]
    found = {}
    for name, code, marker, plural, major, flags in lines:
        k, ranked = place[name], name not in ("OTHER", "UNRANKED")
        found[name] = {
            "rank": name, "ordinal": k, "code": None if code == "-" else code, "marker": None if marker == "-" else marker, "plural": None if plural == "-" else plural, "major": major,
            "ambiguous_marker": marker != "-" and markers.count(marker) > 1, "other_or_unranked": not ranked, "infraspecific": k > place["SPECIES"] and ranked, "infrageneric": k > place["GENUS"] and ranked,
            "infrageneric_strictly": place["GENUS"] < k < place["SPECIES_AGGREGATE"], "species_or_below": k >= place["SPECIES_AGGREGATE"] and ranked,
            "family_group": place["GIGAFAMILY"] <= k < place["SUPRAGENERIC_NAME"], "genus_group": place["SUPERGENUS"] <= k < place["SPECIES_AGGREGATE"], "suprageneric": k < place["GENUS"],
        } | {flag: flag in flags.split(",") for flag in ("linnean", "uncomparable", "legacy")}
    return found


INFO = _read()
NAMES = list(INFO)
ORDINAL = {name: row["ordinal"] for name, row in INFO.items()}

SCHEMA = (
    "rank string, ordinal int, code string, marker string, plural string, major string, ambiguous_marker boolean, other_or_unranked boolean, infraspecific boolean, infrageneric boolean, "
    "infrageneric_strictly boolean, species_or_below boolean, family_group boolean, genus_group boolean, suprageneric boolean, linnean boolean, uncomparable boolean, legacy boolean"
)


def rank_dimension(spark: SparkSession) -> DataFrame:
    """The ranks as a table of fixed size, to be broadcast in joins on rank."""
    return spark.createDataFrame([tuple(row.values()) for row in INFO.values()], SCHEMA)


def with_rank(df: DataFrame, column: str = "rank") -> DataFrame:
    """df with the columns of its rank as a struct rank_info (null where the rank is unknown)."""
    ranks = rank_dimension(df.sparkSession)
    side = ranks.select(F.col("rank").alias("__rank"), F.struct(*(c for c in ranks.columns if c != "rank")).alias("rank_info"))
    return df.join(F.broadcast(side), F.col(column) == F.col("__rank"), "left").drop("__rank")


def from_name(name: Column) -> Column:
    """The rank of exactly this name, null for any other text."""
    return F.when(name.isin(*NAMES), name)


def ordinal(rank: Column) -> Column:
    """The place of a rank, 0 for the highest; null for what is no rank."""
    return F.nullif(F.array_position(F.array(*map(F.lit, NAMES)), rank).cast("int"), F.lit(0)) - 1


def higher_than(rank: Column, other: Column) -> Column:
    """Whether a rank stands above another one; nothing stands above OTHER and UNRANKED."""
    return (ordinal(rank) < ordinal(other)) & ~other.isin("OTHER", "UNRANKED")


def lower_than(rank: Column, other: Column) -> Column:
    """Whether a rank stands below another one; OTHER and UNRANKED stand below nothing."""
    return (ordinal(rank) > ordinal(other)) & ~rank.isin("OTHER", "UNRANKED")

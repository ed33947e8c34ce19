"""Word lists and character classes of biological nomenclature."""

from __future__ import annotations

from unicodedata import normalize

# ---- Fixed values: results depend on exactly these words, characters and texts. ----

SINGLE_QUOTES = "`´ʹʻʼʽˊˋ\u0091\u0092‘’‚‛′‵❛❜＇"
DOUBLE_QUOTES = "\u0093\u0094“”„‟″‶❝❞〝〞〟＂"
HYPHENS = "‐‑‒–—"
WIN1252 = {"¡": "i", "¢": "c", "£": "L", "‚": "e", "„": "a", "‰": "e"}

#: Cyrillic and Greek letters that look like Latin ones, in alphabetical order.
LOOKALIKES = {"ſ": "s"} | dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝ", "ABESIJKMHOPCTYXaesijopcyxhdqw", strict=True)) | dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABEZHIKMNOPTYXo", strict=True)) | {chr(0xFEE0 + k): chr(k) for k in range(0x21, 0x7F)}

#: Letters and digits of mathematical alphabets, letter-like signs and Roman numerals, by Unicode's compatibility forms.
LOOKALIKES |= {chr(c): plain for c in (*range(0x2100, 0x2150), *range(0x2160, 0x2180), *range(0x1D400, 0x1D800)) if len(plain := normalize("NFKC", chr(c))) == 1 and plain.isascii() and plain.isalnum()}

PARTICLES = (
    "a ab af ap auf d da dal dalla dalle dallo das de degli dei del della delle delli dello der des di do dos du el in la las le les lo los of ofver te ten ter und v van vd ven "
    "vom von y zu zum zur"
).split()

CULTURE_COLLECTIONS = "ATCC DSM DSMZ JCM NBRC CCUG LMG CBS NRRL CECT CIP NCTC NCIMB IAM VKM VKPM KCTC KACC CGMCC CICC MCCC BCRC MTCC MCC ICMP PCC SAG UTEX CCAP".split()

CODES = ("BACTERIAL", "BOTANICAL", "CULTIVARS", "PHYTO", "VIRUS", "ZOOLOGICAL", "PHYLO")
NAME_TYPES = ("SCIENTIFIC", "FORMULA", "INFORMAL", "PLACEHOLDER", "IDENTIFIER", "OTHER")

#: Markers of infraspecific epithets, without their dot.
INFRASPECIFIC = {
    "subsp": "SUBSPECIES", "ssp": "SUBSPECIES", "subspec": "SUBSPECIES", "agamossp": "SUBSPECIES",
    "var": "VARIETY", "variety": "VARIETY", "agamovar": "VARIETY", "subvar": "SUBVARIETY", "subv": "SUBVARIETY",
    "f": "FORM", "forma": "FORM", "form": "FORM", "fo": "FORM", "fm": "FORM", "fma": "FORM", "subf": "SUBFORM", "subforma": "SUBFORM",
    "pv": "PATHOVAR", "pathovar": "PATHOVAR", "bv": "BIOVAR", "biovar": "BIOVAR", "ct": "CHEMOFORM", "chemoform": "CHEMOFORM", "sv": "SEROVAR", "serovar": "SEROVAR",
    "morph": "MORPH", "morphovar": "MORPHOVAR", "phagovar": "PHAGOVAR", "nat": "NATIO", "natio": "NATIO", "mut": "MUTATIO", "mutatio": "MUTATIO", "agamosp": "SPECIES",
    "conv": "CONVARIETY", "convar": "CONVARIETY", "prol": "PROLES", "proles": "PROLES", "ab": "ABERRATION", "aberration": "ABERRATION", "strain": "STRAIN", "str": "STRAIN",
    "st": "INFRASPECIFIC_NAME", "fsp": "FORMA_SPECIALIS", "infrasubdivision": "OTHER",
}
#: Markers of infrageneric epithets, without their dot.
INFRAGENERIC = {
    "subg": "SUBGENUS", "subgen": "SUBGENUS", "sect": "SECTION_BOTANY", "subsect": "SUBSECTION_BOTANY", "supersect": "SUPERSECTION_BOTANY", "suprasect": "SUPERSECTION_BOTANY",
    "ser": "SERIES_BOTANY", "subser": "SUBSERIES_BOTANY", "div": "DIVISION_BOTANY", "divisio": "DIVISION_BOTANY",
}

WARNINGS = {
    "null": "epithet with literal value null",
    "homoglyphs": "homoglyphs replaced",
    "unusual": "unusual characters",
    "indet": "indetermined name missing its terminal epithet",
    "question": "question marks removed",
    "subspecies": "Name was considered species but contains infraspecific epithet",
    "missing_genus": "epithet without genus",
    "doubtful_genus": "genus quoted or in square brackets",
    "rank_mismatch": "rank does not fit the parsed name",
    "code_mismatch": "nomenclatural code does not fit the parsed name",
    "entities": "html entities unescaped",
    "tags": "xml tags removed",
    "blacklisted": "blacklisted epithet used",
    "reference": "nomenclatural reference removed",
    "authorship": "authorship placeholder removed",
    "year": "authorship year was extract but originally was a year range or other form of year",
    "unlikely_year": "unlikely authorship year",
    "uncertain": "authorship marked as uncertain",
    "quadrinomial": "name was quadrinomial",
    "abbreviated": "abbreviated genus name",
    "abbreviated_subgenus": "abbreviated subgenus name",
    "long": "unusually long name",
}
MAX_LENGTH, LONG_LENGTH = 1000, 250
#: A genus with a label stuck to it.
GLUED_PHRASE = r"^(\p{Lu}\p{Ll}+)(\p{Lu}{2,}[\p{Lu}0-9_]*)\z"

VIRAL_SUFFIX = r"(?i)(?:virus|viroid|satellite|viriform|viridae|viroidae|satellitidae|virinae|viroinae|satellitinae|virales|virineae|viricetes|viricetidae|viricotina|viricota|virites|viria|virae)\z"

#: Suffixes of names above genus by code, longest first.
SUFFIX_RANKS = {
    "BACTERIAL": {"oideae": "SUBFAMILY", "aceae": "FAMILY", "ineae": "SUBORDER", "ales": "ORDER", "idae": "SUBCLASS", "inae": "SUBTRIBE", "eae": "TRIBE", "ia": "CLASS"},
    "BOTANICAL": {
        "mycetidae": "SUBCLASS", "phycidae": "SUBCLASS", "mycotina": "SUBPHYLUM", "phytina": "SUBPHYLUM", "mycetes": "CLASS", "phyceae": "CLASS", "mycota": "PHYLUM", "opsida": "CLASS",
        "oideae": "SUBFAMILY", "phyta": "PHYLUM", "ineae": "SUBORDER", "aceae": "FAMILY", "idae": "SUBCLASS", "anae": "SUPERORDER", "acea": "SUPERFAMILY", "aria": "INFRAORDER",
        "ales": "ORDER", "inae": "SUBTRIBE", "eae": "TRIBE",
    },
    "ZOOLOGICAL": {"oidea": "SUPERFAMILY", "oidae": "EPIFAMILY", "idae": "FAMILY", "inae": "SUBFAMILY", "ini": "TRIBE", "ina": "SUBTRIBE"},
    "VIRUS": {
        "viricetidae": "SUBCLASS", "viricotina": "SUBPHYLUM", "viricetes": "CLASS", "viricota": "PHYLUM", "virineae": "SUBORDER", "virites": "SUBKINGDOM", "virales": "ORDER",
        "viridae": "FAMILY", "virinae": "SUBFAMILY", "viriae": "KINGDOM", "viria": "REALM", "vira": "SUBREALM",
    },
}
#: Without a code only these suffixes count.
PLAIN_SUFFIX_RANKS = {"aceae": "FAMILY", "oideae": "SUBFAMILY"}

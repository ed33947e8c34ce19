"""Scientific names parsed into fields by Spark expressions.

classify -> strip annotations -> read the words -> read the authorship -> infer code and rank -> result.
Parsing depends on one row only, so it runs alike on batches and streams, needs no shuffle, and a failed
row is data (an error struct), never an exception.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaflow.functions import authors, text, words
from taxaflow.functions.classify import HINTS, error_message, kind_of
from taxaflow.plans import ranks, strip, vocab
from taxaflow.plans.recorded import Steps, recorded

#: Markers with a mere n for "notho", and ranks of species and below.
_NOTHO = ("nvar", "nsubsp", "nssp", "nf", "nsubvar")
_SPECIES_DOWN = ("SPECIES", "CULTIVAR", "CULTIVAR_GROUP", "GREX", *(n for n in ranks.NAMES if ranks.INFO[n]["infraspecific"]))
_BASIONYM = r"^\(([^()]*)\)\s*(.*)\z"
_SANCTION = r"^(.*?\S)\s*:\s*(\p{Lu}[^:]*)\z"
_NONE = "cast(null as string)"


#: A plain name: genus, subgenus, up to two epithets and an authorship of names, initials, commas and a year.
_SURNAME = r"\p{Lu}[\p{Ll}']*\p{Ll}(?:-\p{Lu}\p{Ll}+)?\.?|\p{Lu}\."
_TEAM = rf"(?:{_SURNAME})(?:(?:\s?&\s|,\s|\s)?(?:{_SURNAME}))*+"
_YEARS = r"(?:,? (?:1[5-9]|20)[0-9]{2})?"
_PLAIN = rf"^(?!.*(?:, P\. ?P\.|-(?:group|complex|aggregate)(?: |\z)))(\p{{Lu}}\p{{Ll}}{{2,}}+)(?: \((\p{{Lu}}\p{{Ll}}{{2,}}+)\)(?= \p{{Ll}}))?(?: (\p{{Ll}}{{3,}}+(?:-\p{{Ll}}{{3,}}+)?)(?: (\p{{Ll}}{{4,}}+))?(?: \(({_TEAM}{_YEARS})\)(?= \p{{Lu}}|\z))?)?(?: ({_TEAM}{_YEARS}))?\z"
#: Words that mean something in a name; names with one of them are read in full.
_WORDS = sorted(
    {*vocab.PARTICLES, *vocab.INFRASPECIFIC, *vocab.INFRAGENERIC}
    | set("sp spp spec species cf aff near indet undet hort anon apud non nec not null ex and sensu sec auct auctt fide emend ss sic corrig group complex aggregate agg lineage clade grex strain nov nomen nom comb orth ined ms msc".split())
    | set("unpublished press mihi delete unknown unassigned unaccepted unidentified undetermined uncultured undescribed indeterminate incertae sedis dummy temp Group Candidatus Missing Unident Unidentified Undescribed Undet Unknown Approved".split())
    | set("Ms MS Incertae Unassigned Uncultured Undetermined Not Anon Hort Auct Sensu Gen Anon. Hort. Auct. Nom. Comb. Gen. Fam. Vector Vectors Prion Prions Particle Particles Replicon Replicons Rna".split())
)
_SPECIAL = f"(?:^| ){text.trie(set(_WORDS))}(?= |\\z)"
#: Stands before the groups of a plain name.
_MARK = "\u0001"
_VIRAL_HINTS = ("vir", "phage", "satellite", "vector", "prion", "particle", "replicon")
#: Texts that conditions ask for in words, all looked for at once.
_HINTED = text.any_of({*HINTS, *strip.HINTS, *_VIRAL_HINTS})


def _like(x: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_like(x, F.lit(pattern)), F.lit(False))


def _recover_case(t: Column) -> Column:
    """A shouted or lower-case first word in title case, shouted epithets after a shouted genus in lower case."""
    caps = text.groups(t, r"^(\p{Lu}[\p{Lu}-]*\p{Lu})((?:\s\p{Lu}[\p{Lu}-]*\p{Lu}(?=\s|\z))*)(|[\s,(].*)\z", 3)
    lower = text.groups(t, r"^(\p{Ll}[\p{Ll}-]*\p{Ll})(|\s.*)\z", 2)
    title = lambda w: F.replace(F.initcap(F.replace(F.lower(w), F.lit("-"), F.lit("- "))), F.lit("- "), F.lit("-"))
    shouted = F.when(_like(t, r"^\p{Lu}[\p{Lu}-]"), text.let(caps, lambda g: F.concat(title(F.get(g, F.lit(0))), F.lower(F.get(g, F.lit(1))), F.get(g, F.lit(2)))))
    small = F.when(_like(t, r"^\p{Ll}"), text.let(lower, lambda g: F.concat(title(F.get(g, F.lit(0))), F.get(g, F.lit(1)))))
    # A capital after the hyphen of a short first part, or in a name of three parts or more, is none.
    word = F.substring_index(t, " ", 1)
    parts = F.when(_like(t, r"^\p{Lu}\p{Ll}{0,2}-\p{Lu}|^\p{Lu}\p{Ll}+-\p{L}+-\p{L}"), F.concat(F.substring(word, 1, 1), F.lower(F.substring(word, 2, 999)), F.substr(t, F.char_length(word) + 1)))
    return F.coalesce(shouted, small, parts, t)


def _read_words(work: Steps, t: Column, wanted: Column, rank: Column) -> Steps:
    """work with __w, a struct of genus, epithets, markers, qualifiers and the authorship's text."""
    no = F.lit(False)
    given = lambda c: c.isNotNull()
    bare_mark = lambda m: F.when(m.isin(*_NOTHO), F.substring(m, 2, 99)).otherwise(F.regexp_replace(m, "^notho", ""))

    def found(g: Column) -> Column:
        own = lambda name: words.part(g, name)
        units = [{c: own(f"{c}{k}") for c in ("by", "mark", "fsp", "x", "isp", "q", "bx", "bare")} for k in (1, 2, 3)]
        one, two, three = units
        of = lambda c: F.when(given(three["mark"]), three[c]).when(given(two["mark"]), two[c]).when(given(one["mark"]), one[c])
        marked = given(one["mark"]) | given(two["mark"]) | given(three["mark"])
        bare = F.concat_ws(" ", *(u["bare"] for u in units), own("extra"))
        # After the last marker one epithet counts and the others are left unread; without one the last counts.
        rest = F.when(given(three["mark"]), own("extra")).when(given(two["mark"]), F.concat_ws(" ", three["bare"], own("extra"))).when(given(one["mark"]), F.concat_ws(" ", two["bare"], three["bare"], own("extra")))
        removed = lambda u, by: F.concat_ws(" ", F.concat(F.lit("Removed: "), bare_mark(u["mark"]), F.lit(".")), u["isp"], by)
        dropped = F.when(given(three["mark"]), F.coalesce(removed(two, three["by"]), removed(one, three["by"]))).when(given(two["mark"]) & given(one["mark"]), removed(one, two["by"]))
        mark, epithet, qualifier = F.regexp_replace(of("mark"), r"\Asp\z", "subsp"), F.lower(own("sp")), F.coalesce(own("qual"), one["q"], two["q"])
        late = F.coalesce(own("late"), own("last"))
        ending = "(?:" + "|".join(words.AGGREGATES) + r")\z"
        grouped = F.coalesce(F.regexp_like(epithet, F.lit(ending)), no)
        sub = own("sub")
        return F.struct(
            given(own("hyb")).alias("hyb"), own("genus").alias("genus"), F.concat(F.upper(F.substring(sub, 1, 1)), F.substring(sub, 2, 999)).alias("sub"), F.coalesce(F.regexp_like(sub, F.lit(r"^\p{Ll}")), no).alias("lowsub"),
            F.coalesce(F.endswith(sub, F.lit(".")), no).alias("shortsub"), own("gauth").alias("gauth"), F.coalesce(F.startswith(own("imark"), F.lit("notho")), no).alias("inotho"), bare_mark(own("imark")).alias("imark"), own("isub").alias("isub"),
            F.when(F.startswith(qualifier, F.lit("?")), F.lit("?")).when(F.startswith(qualifier, F.lit("near")), F.lit("near")).otherwise(F.concat(F.regexp_extract(qualifier, r"^\p{L}+", 0), F.lit("."))).alias("qual"),
            (given(own("indet")) | given(late) | F.coalesce(F.regexp_like(of("isp"), F.lit(r"^\p{Lu}\z")), no)).alias("indet"), F.when(~F.regexp_like(own("indet"), F.lit(r"^indet\.?\z")), own("indet")).alias("iphrase"), F.coalesce(F.regexp_like(own("indet"), F.lit(r"^\p{L}+\.?\z")), no).alias("bare"),
            F.when(grouped, F.regexp_replace(epithet, ending, "")).otherwise(F.coalesce(F.when(F.regexp_like(own("sp"), F.lit(r"^\p{Lu}")), epithet), own("sp"))).alias("sp"), given(own("spx")).alias("spx"), (grouped | given(own("agg"))).alias("grouped"),
            F.coalesce(of("by"), own("sauth"), one["by"]).alias("sauth"), F.coalesce(F.startswith(of("mark"), F.lit("notho")) | of("mark").isin(*_NOTHO), no).alias("notho"),
            given(F.coalesce(of("x"), F.when(~marked, F.coalesce(three["bx"], two["bx"], one["bx"])))).alias("ispx"), F.when(given(of("fsp")), F.lit("fsp")).otherwise(bare_mark(mark)).alias("mark"), bare_mark(late).alias("late"),
            (~marked & F.contains(bare, F.lit(" "))).alias("four"), F.coalesce(of("isp"), F.nullif(F.substring_index(bare, " ", -1), F.lit(""))).alias("isp"), F.when(marked, F.nullif(rest, F.lit(""))).alias("unread"), dropped.alias("dropped"),
            F.when(given(own("number")), F.when(given(own("more")), F.concat_ws(" ", own("tag"), own("number"), own("more"))).when(own("tag") == "species", F.concat_ws(" ", own("tag"), own("number"))).otherwise(own("number"))).alias("tag"),
            F.trim(F.regexp_replace(F.coalesce(own("auth"), F.lit("")), r"^[\s,-]+", "")).alias("auth"),
        )

    particle = F.coalesce(rank.isin(*_SPECIES_DOWN), no)
    work = work.withColumn("__w0", text.apart(F.when(wanted, words.glued(_recover_case(t)))))
    work = work.withColumn("__w1", text.apart(words.short(F.col("__w0"))))
    work = work.withColumn("__w2", text.apart(F.when(~F.contains("__w1", F.lit("\t")), words.matched(words.coded(F.col("__w1")), particle))))
    work = work.withColumn("__w3", text.apart(F.when(F.contains("__w1", F.lit("\t")), F.split("__w1", "\t")).otherwise(words.parted(F.col("__w2")))))
    return work.withColumn("__w", text.apart(F.when(F.col("__w3").isNotNull(), found(F.col("__w3"))))).drop("__w0", "__w1", "__w2", "__w3")


def _read_authors(work: Steps, given: Column, own: Column, wanted: Column, reference_year: Column, imprint_year: Column, generic: Column, specific: Column) -> Steps:
    """work with __a, a struct of combination, basionym and sanctioning author, and of the authors of genus and species; a
    separate authorship goes before the name's own. Brackets that hold no author are unread text."""
    apart, filled = text.apart, text.filled
    work = work.withColumn("__a0", apart(F.when(wanted, F.coalesce(F.nullif(F.trim(given), F.lit("")), own, F.lit("")))))
    a = F.col("__a0")
    work = work.withColumn("__a1", apart(F.when(F.regexp_like(a, F.lit(r"^\(\s*\(")), F.regexp_replace(F.regexp_replace(a, r"^\(\s*\(", "("), r"\)\s*\)", ")")).otherwise(a)))
    tidy = F.col("__a1")
    open_ = F.startswith(tidy, F.lit("(")) & ~F.contains(tidy, F.lit(")"))
    # An open bracket is closed at the end; a doubled one that stays open is no bracket.
    work = work.withColumn("__at", apart(F.when(open_ & (tidy != a), F.substring(tidy, 2, 999)).when(open_, F.concat(tidy, F.lit(")"))).otherwise(tidy)))
    a = F.col("__at")
    work = work.withColumn("__abas", apart(F.when(F.startswith(a, F.lit("(")), text.groups(a, _BASIONYM, 2))))
    bas = F.col("__abas")
    work = work.withColumns({"__acomb": apart(F.coalesce(F.get(bas, F.lit(1)), a)), "__ain": apart(F.regexp_replace(F.get(bas, F.lit(0)), r"\s*:.*\z", ""))})
    comb, inner = F.col("__acomb"), F.col("__ain")
    nobody = bas.isNotNull() & ~F.regexp_like(inner, F.lit(r"[\p{Lu}0-9]"))
    work = work.withColumns({"__as": apart(F.when(F.contains(comb, F.lit(":")), text.groups(comb, _SANCTION, 2))), "__anob": apart(nobody)})
    s, nobody = F.col("__as"), F.col("__anob")
    held = {"__x0": F.coalesce(F.get(s, F.lit(0)), comb), "__x1": F.when(~nobody, inner), "__x2": generic, "__x3": specific}
    work = work.withColumns({k: apart(F.trim(x)) for k, x in held.items()})
    work = work.withColumns({k.replace("x", "y"): apart(authors.simple(F.col(k))) for k in held})
    work = work.withColumns({k: apart(F.when(wanted, authors.simple_authorship(F.col(k.replace("x", "y")), F.col(k)))) for k in held})
    comb, basionym = F.col("__x0"), F.col("__x1")
    late = F.coalesce(comb["year"], F.when(basionym["year"].isNull(), reference_year))
    dated = F.struct(comb["authors"].alias("authors"), comb["exAuthors"].alias("exAuthors"), late.alias("year"), F.coalesce(comb["imprintYear"], imprint_year).alias("imprintYear"))
    filius = F.contains(a, F.lit("f")) & _like(a, r"(?<=\S)\s*(?:(?<=[\s.])f\.|\bfil\.)")
    unread = F.when(nobody, F.concat(F.lit("("), F.trim(inner), F.lit(")")))
    read = F.struct(
        dated.alias("comb"), basionym.alias("bas"), F.when(generic.isNotNull(), F.col("__x2")).alias("generic"), F.when(specific.isNotNull(), F.col("__x3")).alias("specific"), filled(s, 2).alias("sanct"),
        (bas.isNotNull() & unread.isNull()).alias("has_bas"), F.coalesce(filius, F.lit(False)).alias("filius"), authors.has_range(a).alias("ranged"), unread.alias("unread"),
    )
    return work.withColumn("__a", apart(F.when(wanted, read))).drop("__a0", "__a1", "__at", "__abas", "__acomb", "__ain", "__as", "__anob", *held, *(k.replace("x", "y") for k in held))


#: The fields of the parsed struct, with their types and what they are where nothing else is known.
_PARSED = (
    ("rank", "string", "UNRANKED"), ("code", "string", None), ("uninomial", "string", None), ("genus", "string", None), ("genericAuthorship", authors.AUTHORSHIP, None), ("infragenericEpithet", "string", None),
    ("specificEpithet", "string", None), ("specificAuthorship", authors.AUTHORSHIP, None), ("infraspecificEpithet", "string", None), ("cultivarEpithet", "string", None), ("phrase", "string", None),
    ("candidatus", "boolean", False), ("notho", "array<string>", None), ("originalSpelling", "boolean", None), ("epithetQualifier", "map<string,string>", None), ("type", "string", "SCIENTIFIC"),
    ("extinct", "boolean", False), ("taxonomicNote", "string", None), ("nomenclaturalNote", "string", None), ("publishedIn", "string", None), ("publishedInYear", "int", None), ("publishedInPage", "string", None),
    ("unparsed", "string", None), ("doubtful", "boolean", False), ("manuscript", "boolean", False), ("state", "string", "COMPLETE"), ("warnings", "array<string>", []), ("combinationAuthorship", authors.AUTHORSHIP, ()),
    ("basionymAuthorship", authors.AUTHORSHIP, ()), ("sanctioningAuthor", "string", None),
)


def _struct(**known: Column) -> Column:
    """The parsed struct of the fields that are known."""

    def start(kind: str, value: object) -> Column:
        return F.array().cast(kind) if value == [] else _nobody() if value == () else F.lit(value).cast(kind)

    return F.struct(*(known.get(name, start(kind, value)).alias(name) for name, kind, value in _PARSED))


def _plain_name() -> Column:
    """The parsed struct of a plain name, from its groups in __g and its authorships; nothing in it needs the rules."""
    part = lambda k: text.filled(F.col("__g"), k)
    comb, bas = F.col("__comb"), F.col("__bas")
    combined, based = F.size(comb["authors"]) > 0, F.size(bas["authors"]) > 0
    year = comb["year"].isNotNull() | bas["year"].isNotNull()
    code = F.when(year & ~(combined & based), F.lit("ZOOLOGICAL")).when(combined & based & ~year, F.lit("BOTANICAL")).when(based & ~combined, F.lit("ZOOLOGICAL"))
    epithets = part(3).isNotNull() | part(2).isNotNull()
    rank = (
        F.when(part(4).isNotNull(), F.when(code == "ZOOLOGICAL", F.lit("SUBSPECIES")).otherwise("INFRASPECIFIC_NAME")).when(part(3).isNotNull(), F.lit("SPECIES")).when(epithets, F.lit("INFRAGENERIC_NAME"))
        .otherwise(F.coalesce(text.suffix_rank(part(1), F.lit(None).cast("string")), F.lit("UNRANKED")))
    )
    return _struct(
        rank=rank, code=code, uninomial=F.when(~epithets, part(1)), genus=F.when(epithets, part(1)), infragenericEpithet=part(2), specificEpithet=part(3), infraspecificEpithet=part(4),
        combinationAuthorship=comb, basionymAuthorship=bas,
    )


def _nobody() -> Column:
    return F.struct(*(F.array().cast("array<string>").alias(c) for c in ("authors", "exAuthors")), *(F.lit(None).cast("string").alias(c) for c in ("year", "imprintYear")))


def _among(column: str, values: list[str]) -> Column:
    """column IN values, as SQL text: one call for a long list."""
    return F.expr(f"{column} IN (" + ", ".join(f"'{v}'" for v in values) + ")")


def _lookup(table: dict[str, str], key: Column) -> Column:
    """The value of a key, as one comparison with all keys of each value."""
    values = dict.fromkeys(table.values())
    return reduce(lambda c, v: c.when(key.isin(*[k for k, x in table.items() if x == v]), F.lit(v)), values, F)


def _infer(work: Steps, rank: Column, code: Column) -> Steps:
    """work with __i, a struct of rank, code and whether they conflict, from the structs __w, __a, __f and __kind."""
    has_sp, has_isp = F.col("__w.sp").isNotNull(), F.col("__w.isp").isNotNull()
    marker = F.when(F.col("__f.marker").isNotNull(), _lookup(strip.MARKER_RANKS, F.lower("__f.marker")))
    late = F.when(F.col("__w.late").isNotNull(), _lookup(vocab.INFRASPECIFIC, F.col("__w.late")))
    before = F.coalesce(marker, F.col("__f.pinned_rank"))
    read = (
        F.when(before.isNotNull(), F.when(code == "ZOOLOGICAL", F.regexp_replace(before, r"_BOTANY\z", "_ZOOLOGY")).otherwise(before))
        .when((F.col("__f.aggregate") | F.col("__w.grouped")) & has_sp & ~has_isp, F.lit("SPECIES_AGGREGATE"))
        .when(has_isp & F.col("__w.mark").isNotNull(), _lookup(vocab.INFRASPECIFIC, F.col("__w.mark")))
        .when(has_isp & F.col("__w.four"), F.lit("INFRASUBSPECIFIC_NAME"))
        .when(has_isp, F.lit("INFRASPECIFIC_NAME"))
        .when(late.isNotNull(), late)
        .when(has_sp | F.col("__w.indet"), F.lit("SPECIES"))
        .when(F.col("__w.isub").isNotNull(), _lookup(vocab.INFRAGENERIC, F.col("__w.imark")))
        .when(F.col("__w.sub").isNotNull(), F.lit("INFRAGENERIC_NAME"))
    )
    known = F.when(_among("__rankh", ranks.NAMES) & (rank != "UNRANKED"), rank)
    below = [n for n in ranks.NAMES if ranks.INFO[n]["infraspecific"]]
    asked = F.when(read.isNull(), known).when(has_isp & F.col("__w.mark").isNull() & _among("__rankh", below), known)
    work = work.withColumn("__rank0", text.apart(F.when(F.col("__open"), F.coalesce(asked, read))))
    rank_code = reduce(lambda c, own: c.when(_among("__rank0", [n for n in ranks.NAMES if ranks.INFO[n]["code"] == own]), F.lit(own)), [c for c in vocab.CODES if any(i["code"] == c for i in ranks.INFO.values())], F)
    note = F.lower(F.col("__f.nom_note"))
    noted = F.when(_like(note, rf"{text.EDGE}(?:illeg|inval|superfl|super|cons|rej|ambig|confus)"), F.lit("BOTANICAL")).when(_like(note, rf"{text.EDGE}(?:oblitum|protectum){text.EDGE}"), F.lit("ZOOLOGICAL"))
    own_code = F.when(code.isin(*vocab.CODES), code)
    pinned = F.coalesce(own_code, F.col("__f.pinned_code"), rank_code, F.when(note.isNotNull(), noted))
    comb, bas = F.col("__a.comb"), F.col("__a.bas")
    has_comb, has_bas = F.size(comb["authors"]) > 0, F.col("__a.has_bas")
    year = (has_comb & comb["year"].isNotNull()) | (has_bas & (F.size(bas["authors"]) > 0) & bas["year"].isNotNull())
    filius = F.col("__a.filius")
    votes = F.array(
        F.when(F.col("__f.candidatus"), F.lit("BACTERIAL")),
        F.when(F.col("__a.sanct").isNotNull() | (has_bas & has_comb) | (filius & ~year), F.lit("BOTANICAL")),
        F.when((has_bas & ~has_comb) | year, F.lit("ZOOLOGICAL")),
    )
    uni = ~has_sp & ~F.col("__w.indet") & F.col("__w.isub").isNull() & F.col("__w.sub").isNull()
    by_suffix = F.when(uni, text.suffix_rank(F.col("__w.genus"), F.coalesce(own_code, F.when(F.col("__kind.viral"), F.lit("VIRUS")))))

    def told(codes: Column) -> Column:
        needed, found = codes["needed"], codes["found"]
        misfit = F.coalesce(needed.isNotNull() & own_code.isNotNull() & (found != needed), F.lit(False))
        zoo = has_isp & (F.col("__rank0") == "INFRASPECIFIC_NAME") & (found == "ZOOLOGICAL")
        full = F.when(zoo, F.lit("SUBSPECIES")).otherwise(F.coalesce("__rank0", by_suffix, F.lit("UNRANKED")))
        return F.struct(full.alias("rank"), F.when(misfit, needed).otherwise(found).alias("code"), misfit.alias("misfit"))

    found = F.coalesce(pinned, text.code_vote(votes), F.when(F.col("__kind.viral"), F.lit("VIRUS")))
    work = work.withColumn("__c", text.apart(F.when(F.col("__open"), F.struct(rank_code.alias("needed"), found.alias("found")))))
    return work.withColumn("__i", text.apart(F.when(F.col("__open"), told(F.col("__c"))))).drop("__c")


@recorded
def _steps(blacklist: tuple[str, ...]) -> Steps:
    """From __raw, __given, __rankh and __codeh to __p (the parsed struct), __etype and __kind."""
    work = Steps()
    # Printable ASCII with single spaces needs no repair.
    work = work.withColumn("__tidy", text.apart(_like(F.col("__raw"), r"^(?:[!-~]++(?: (?=[!-~]))?)++\z")))
    tidy = F.col("__tidy")
    work = work.withColumn("__s", text.apart(F.when(tidy, F.col("__raw")).otherwise(text.normalise_quotes(text.trim_control(F.coalesce("__raw", F.lit("")))))))
    fits = F.char_length("__raw") <= vocab.LONG_LENGTH
    unasked = F.col("__given").isNull() & F.col("__rankh").isNull() & F.col("__codeh").isNull()
    work = work.withColumn("__low", text.apart(F.lower("__s")))
    work = work.withColumn("__hint", text.apart(F.regexp_like("__low", F.lit(_HINTED))))
    special = F.regexp_like("__s", F.lit(_SPECIAL)) | (F.col("__hint") & reduce(lambda a, b: a | b, (F.contains("__low", F.lit(h)) for h in _VIRAL_HINTS)))
    # One match of the pattern gives all groups behind a mark that no trimmed text begins with.
    plain = F.regexp_replace("__s", _PLAIN, _MARK + "\t".join(f"${k}" for k in range(1, 7)))
    held = F.when(unasked & fits & ~special & (tidy | ~_like(F.col("__s"), r"[ſ\u0370-\u04FF\uFF00-\uFFEF\u3000]")), plain)
    work = work.withColumn("__m", text.apart(held))
    # Until the end a plain name is its text with the groups, which is much less to carry from step to step than a struct.
    work = work.withColumn("__m", text.apart(F.when(F.startswith("__m", F.lit(_MARK)), F.substring("__m", 2, vocab.LONG_LENGTH + 9))))
    work = kind_of(work, F.col("__raw"), F.col("__given"), F.col("__codeh"), F.col("__s"), F.col("__low"), F.col("__hint"), F.col("__m").isNull())
    open_ = F.col("__m").isNull() & F.col("__kind.type").isNull() & F.col("__kind.rescue_taxon").isNull()
    repaired = text.let(F.col("__s"), lambda x: text.collapse_space(text.repair_win1252(text.fold_lookalikes(x))))
    work = work.withColumn("__open", text.apart(open_))
    work = work.withColumn("__clean", text.apart(F.when(F.col("__open"), F.when(tidy, F.col("__s")).otherwise(repaired))))
    work = work.withColumns({"__cleanlow": text.apart(F.when(tidy & F.col("__open"), F.col("__low")).otherwise(F.lower("__clean"))), "__sep": text.apart(F.nullif(F.trim(F.col("__given")), F.lit("")))})
    sep = F.col("__sep")
    work = work.withColumns({"__gates": text.apart(F.when(F.col("__open"), strip.gates(F.col("__cleanlow"), F.when(tidy, F.col("__hint")).otherwise(_like(F.col("__cleanlow"), _HINTED))))), "__begun": text.apart(F.when(F.col("__open"), strip.begun(sep)))})
    work = work.withColumns({
        "__hits": text.apart(F.when(F.col("__open"), strip.triggered(F.col("__clean"), F.col("__cleanlow"), F.col("__gates")))),
        "__also": text.apart(F.when(F.col("__begun").isNotNull(), strip.triggered(F.col("__begun"), F.lower("__begun"), given=True))),
    })
    work = work.withColumns({"__done": strip.worked(F.col("__clean"), F.col("__hits")), "__other": strip.worked(F.col("__begun"), F.col("__also"))})
    work = work.withColumns({"__log": text.apart(strip.merged(F.col("__done"), F.col("__other"), sep)), "__left": text.apart(strip.left(F.col("__other"), sep))})
    told = strip.fields(F.coalesce("__done.t", "__clean"), F.col("__left"), F.col("__log"))
    work = work.withColumn("__f", text.apart(F.when(F.col("__m").isNull(), told))).drop("__cleanlow", "__sep", "__gates", "__begun", "__hits", "__also", "__done", "__other", "__log", "__left")
    odd = F.col("__open") & ~tidy & (text.collapse_space(F.col("__s")) != F.col("__clean"))
    work = work.withColumn("__odd", text.apart(odd)).drop("__clean", "__s", "__low", "__hint")
    work = _read_words(work, F.col("__f.text"), F.col("__open"), F.col("__rankh"))
    # The author within an autonym is that of the whole name.
    autonym = F.when((F.col("__w.isp") == F.col("__w.sp")) & (F.col("__w.auth") == ""), F.col("__w.sauth"))
    own = F.when(F.col("__f.phrase").isNull() & F.col("__w.iphrase").isNull(), F.coalesce(autonym, F.col("__w.auth")))
    work = _read_authors(work, F.col("__f.given"), own, F.col("__open"), F.col("__f.reference_year"), F.col("__f.imprint_year"), F.col("__w.gauth"), F.col("__w.sauth"))
    work = _infer(work, F.col("__rankh"), F.col("__codeh"))
    rescue = F.col("__kind.rescue_taxon").isNotNull()
    has_sp = F.col("__w.sp").isNotNull()
    abbreviated = _like(F.col("__w.genus"), r"\.\z")
    informal_type = rescue | F.col("__f.informal") | F.col("__w.indet") | F.col("__w.tag").isNotNull() | F.col("__w.qual").isNotNull() | abbreviated
    # Text that begins like no name at all is left unread as a whole; without a letter it is no name.
    lost = F.col("__open") & F.col("__w.genus").isNull()
    no_letter = lost & ~_like(F.col("__raw"), r"\p{L}")
    error_type = F.coalesce(F.col("__kind.type"), F.when(no_letter, F.lit("OTHER")))
    known = F.when(_among("__rankh", ranks.NAMES) & (F.col("__rankh") != "UNRANKED"), F.col("__rankh"))
    between = [n for n in ranks.NAMES if ranks.INFO[n]["infrageneric_strictly"]]
    above = [n for n in ranks.NAMES if ranks.ORDINAL[n] < ranks.ORDINAL["SPECIES"]]
    alone = ~has_sp & ~F.col("__w.indet") & F.col("__w.isub").isNull() & F.col("__w.sub").isNull() & F.col("__f.phrase").isNull() & F.col("__f.cultivar").isNull() & F.col("__w.genus").isNotNull()
    # A monomial of a rank that needs an epithet, one of a rank below genus, a binomial of a rank above species.
    unfinished = F.coalesce(alone & _among("__rankh", list(_SPECIES_DOWN)) & ~F.col("__f.informal"), F.lit(False))
    moved = F.coalesce(alone & F.coalesce(known, F.col("__i.rank")).isin(*between), F.lit(False))
    too_high = F.coalesce(has_sp & _among("__rankh", above) & (known != F.col("__i.rank")), F.lit(False))
    no_infra = F.coalesce(has_sp & F.col("__w.isp").isNull() & _among("__rankh", list(_SPECIES_DOWN[4:])), F.lit(False))
    flags = F.struct(*(c.alias(n) for n, c in (("unfinished", unfinished), ("moved", moved), ("too_high", too_high), ("no_infra", no_infra), ("lost", lost), ("known", known))))
    work = work.withColumn("__b", text.apart(F.when(F.col("__open"), flags)))
    unfinished, moved, too_high, no_infra, lost = (F.coalesce(F.col(f"__b.{c}"), F.lit(False)) for c in ("unfinished", "moved", "too_high", "no_infra", "lost"))
    known = F.col("__b.known")
    informal_type = informal_type | unfinished | too_high | no_infra
    kind = F.when(rescue, F.lit("INFORMAL")).when(F.col("__w.genus") == "?", F.lit("PLACEHOLDER")).when(informal_type & F.col("__f.cultivar").isNull(), F.lit("INFORMAL")).otherwise("SCIENTIFIC")
    as_genus = has_sp | F.col("__w.indet") | F.col("__w.isub").isNotNull() | F.col("__w.sub").isNotNull() | (F.col("__f.phrase").isNotNull() & ~F.col("__f.monomial")) | F.col("__f.cultivar").isNotNull() | unfinished
    quoted = F.col("__f.quoted")
    found = (
        F.when(F.char_length("__raw") > vocab.LONG_LENGTH, F.lit(vocab.WARNINGS["long"])),
        F.when((F.col("__w.indet") & (F.col("__w.iphrase").isNull() | F.col("__w.bare")) & F.col("__w.isp").isNull()) | unfinished | no_infra, F.lit(vocab.WARNINGS["indet"])),
        F.col("__w.dropped"), F.when(F.col("__w.dropped").isNotNull(), F.lit(vocab.WARNINGS["quadrinomial"])), F.when(F.col("__odd"), F.lit(vocab.WARNINGS["homoglyphs"])),
        F.when(too_high, F.lit(vocab.WARNINGS["rank_mismatch"])), F.when(F.col("__i.misfit"), F.lit(vocab.WARNINGS["code_mismatch"])), F.when(F.col("__a.ranged"), F.lit(vocab.WARNINGS["year"])),
        F.when((known == "SPECIES") & F.col("__w.isp").isNotNull(), F.lit(vocab.WARNINGS["subspecies"])),
        F.when(abbreviated, F.lit(vocab.WARNINGS["abbreviated"])), F.when(F.col("__w.shortsub"), F.lit(vocab.WARNINGS["abbreviated_subgenus"])), F.when(F.col("__w.qual") == "?", F.lit(vocab.WARNINGS["question"])),
        F.when(F.coalesce(text.is_unlikely_year(F.col("__a.comb.year")), F.lit(False)) | F.coalesce(text.is_unlikely_year(F.col("__a.bas.year")), F.lit(False)), F.lit(vocab.WARNINGS["unlikely_year"])),
        F.when((F.col("__w.sp") == "null") | (F.col("__w.isp") == "null"), F.lit(vocab.WARNINGS["null"])),
        F.when(F.lower("__w.sp").isin(*blacklist) | F.lower("__w.isp").isin(*blacklist) if blacklist else F.lit(False), F.lit(vocab.WARNINGS["blacklisted"])),
    )
    warn = F.when(F.coalesce(*found).isNotNull(), F.array_compact(F.array(*found)))
    crosses = (
        F.when(F.col("__w.hyb") & F.col("__w.genus").isNotNull(), F.lit("GENERIC")), F.when(F.col("__w.inotho"), F.lit("INFRAGENERIC")),
        F.when(F.col("__w.spx"), F.lit("SPECIFIC")), F.when(F.col("__w.ispx") | F.col("__w.notho"), F.lit("INFRASPECIFIC")),
    )
    notho = F.when(F.coalesce(*crosses).isNotNull(), F.array_compact(F.array(*crosses)))
    sure = lambda c: F.when(~rescue, c)
    parsed = _struct(
        rank=F.when(rescue | lost, F.lit("UNRANKED")).when(unfinished | too_high | no_infra, known).otherwise(F.col("__i.rank")),
        code=sure(F.col("__i.code")),
        uninomial=sure(F.when(~as_genus & ~moved, F.concat(F.coalesce(quoted, F.lit("")), F.col("__w.genus"), F.coalesce(quoted, F.lit(""))))),
        genus=F.when(rescue, F.col("__kind.rescue_taxon")).otherwise(F.when(as_genus, F.col("__w.genus"))),
        genericAuthorship=sure(F.col("__a.generic")),
        infragenericEpithet=sure(F.coalesce("__w.isub", "__w.sub", F.when(moved, F.col("__w.genus")))),
        specificEpithet=sure(F.col("__w.sp")),
        specificAuthorship=sure(F.col("__a.specific")),
        infraspecificEpithet=sure(F.col("__w.isp")),
        cultivarEpithet=sure(F.col("__f.cultivar")),
        phrase=F.when(rescue, F.col("__kind.rescue_phrase")).otherwise(F.coalesce("__f.phrase", "__w.iphrase", "__w.tag")),
        candidatus=F.col("__f.candidatus"),
        notho=sure(notho),
        originalSpelling=(F.col("__f.original_spelling") == "true"),
        epithetQualifier=sure(F.when(F.col("__w.qual").isNotNull(), F.create_map(F.when(F.col("__w.isp").isNotNull(), F.lit("INFRASPECIFIC")).otherwise("SPECIFIC"), F.col("__w.qual")))),
        type=kind,
        extinct=F.col("__f.extinct"),
        taxonomicNote=sure(F.col("__f.tax_note")),
        nomenclaturalNote=sure(F.col("__f.nom_note")),
        publishedIn=sure(F.col("__f.published_in")),
        publishedInYear=sure(text.published_year(F.coalesce("__f.published_in", F.lit("")))),
        publishedInPage=sure(F.col("__f.page")),
        unparsed=sure(F.when(lost, F.trim("__raw")).otherwise(F.coalesce("__f.unparsed", "__w.unread", "__a.unread"))),
        doubtful=(F.col("__f.doubtful") | too_high | F.col("__w.lowsub") | F.coalesce(F.col("__w.qual") == "?", F.lit(False))),
        manuscript=F.col("__f.manuscript"),
        state=F.when(~rescue & (lost | F.col("__f.unparsed").isNotNull() | F.col("__w.unread").isNotNull() | F.col("__a.unread").isNotNull()), F.lit("PARTIAL")).otherwise("COMPLETE"),
        warnings=F.when(warn.isNull() & (F.size("__f.warnings") < 2), F.col("__f.warnings")).otherwise(F.sort_array(F.array_union("__f.warnings", F.coalesce(warn, F.array().cast("array<string>"))))),
        combinationAuthorship=F.when(rescue | unfinished | lost, _nobody()).otherwise(F.col("__a.comb")),
        basionymAuthorship=F.when(rescue | unfinished | lost, _nobody()).otherwise(F.col("__a.bas")),
        sanctioningAuthor=sure(F.col("__a.sanct")),
    )
    work = work.withColumns({"__read": text.apart(F.when(F.col("__m").isNull() & error_type.isNull(), parsed)), "__etype": text.apart(F.when(F.col("__m").isNull(), error_type))})
    work = work.withColumn("__g", text.apart(F.split("__m", "\t"))).drop("__m", "__f", "__w", "__a", "__i", "__b", "__open", "__odd", "__rank0", "__tidy", "__hint")
    work = work.withColumns({"__comb": text.apart(text.filled(F.col("__g"), 6)), "__bas": text.apart(text.filled(F.col("__g"), 5))})
    work = work.withColumns({f"{c}1": text.apart(authors.simple(F.col(c))) for c in ("__comb", "__bas")})
    work = work.withColumns({c: text.apart(F.when(F.col("__g").isNotNull(), authors.simple_authorship(F.col(f"{c}1"), F.col(c)))) for c in ("__comb", "__bas")})
    return work.withColumn("__p", text.apart(F.when(F.col("__g").isNotNull(), _plain_name()).otherwise(F.col("__read"))))


def parse_names(df: DataFrame, name: str = "name", authorship: str | None = None, rank: str | None = None, code: str | None = None, blacklist: list[str] | None = None) -> DataFrame:
    """df with result ('parsed', 'informal' or 'error') and the structs parsed, informal and error.

    authorship, rank and code name optional columns with hints; unknown hints count as absent. blacklist
    is the list of epithets that get a warning (words of other languages, say). Null names are errors.
    """
    own = lambda c: (F.col(c) if c else F.expr(_NONE)).cast("string")
    raw, given, rank_hint, code_hint = own(name), own(authorship), own(rank), own(code)
    work = df.withColumns({"__raw": raw, "__given": text.normalise_quotes(given), "__rankh": rank_hint, "__codeh": F.when(code_hint.isin(*vocab.CODES), code_hint)})
    work = _steps(tuple(blacklist or ())).over(work)
    informal = (F.col("__p.type") == "INFORMAL") & F.col("__p.specificEpithet").isNull() & F.coalesce("__p.genus", "__p.uninomial", "__p.infragenericEpithet").isNotNull()
    taxon = F.struct(
        F.coalesce("__p.genus", "__p.uninomial", "__p.infragenericEpithet").alias("taxon"),
        F.when(F.col("__p.genus").isNotNull(), F.lit("GENUS")).otherwise(F.col("__p.rank")).alias("taxonRank"),
        F.col("__p.rank").alias("rank"), F.col("__p.phrase").alias("phrase"), F.col("__p.code").alias("code"),
    )
    reported = F.coalesce("__kind.name", F.lit(""))
    failed = F.struct(F.col("__etype").alias("type"), F.col("__kind.code").alias("code"), reported.alias("name"), error_message(F.col("__etype"), reported).alias("message"))
    state = F.when(F.col("__etype").isNotNull(), F.lit("error")).when(informal, F.lit("informal")).otherwise("parsed")
    # Out of a generator, so that Spark doesn't push a filter on the result through all the projections
    # above, which would copy their expressions over and over.
    row = F.struct(state.alias("result"), F.col("__p").alias("parsed"), F.when(informal, taxon).alias("informal"), F.when(F.col("__etype").isNotNull(), failed).alias("error"))
    return work.select(*df.columns, F.inline_outer(F.array(row)))

"""Authorship strings as structs: authors, the authors before ex, years; all Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from taxaflow.functions.text import filled, groups, let

AUTHORSHIP = "struct<authors:array<string>,exAuthors:array<string>,year:string,imprintYear:string>"
#: A year at the end, of a range the first, with an optional imprint year or second year and an optional letter.
_YEAR = r"^(|.*?[\s,(\[])([0-9]{3,4}\??)(?:[-–/][0-9]{2,4})?[A-Za-z]?\]?\s*\)?\s*(?:,\s*([0-9]{4})(?:[-–][0-9]{2,4})?|[\[(]\s*\"?([0-9]{4})\"?\s*[\])])?\s*\.?\s*\z"
_RANGE = r"[0-9]{4}[-–/][0-9]{2,4}(?![0-9])"
_SEPARATOR = r"\s*(?:&|;|,|\s(?:and|et|y)\s)\s*"
_SUFFIX = "(?:f|fil|filius|Jr|jr|Sr|sr|II|III|IV)"
_INITIALS = r"(?:\p{Lu}[a-z]?\.[\s-]?)+"
_EMPTY = "array<string>"
#: An author of letters and dots, or a list of surnames with initials before them and commas or ampersands between them, and a year: nothing in it has to be turned.
_SIMPLE = r"^(\p{Lu}\.|\p{Lu}[\p{L}.]*\p{Ll}[\p{L}.]*|(?:\p{Lu}\.)*+\p{Lu}\p{Ll}+\.?(?:(?: &|,) (?:\p{Lu}\.)*+\p{Lu}\p{Ll}{2,}+\.?)*+)(?:,? ((?:1[5-9]|20)[0-9]{2}))?\z"

#: A surname with two initials after it, which go before it, and a year.
_TURNED = r"^(\p{Lu}\p{Ll}{2,}+) (?!II(?:,| |\z)|IV(?:,| |\z))(?:(\p{Lu})(\p{Lu}))(?:,? ((?:1[5-9]|20)[0-9]{2}))?\z"


def author(x: Column) -> Column:
    """One author: initials before the surname, dotted, without spaces; shouted words of four letters or more in title case."""
    dotted = r"^(\p{Lu}[\p{L}'-]*\p{Ll})\s+(?!(?:II|III|IV)\z)((?:\p{Lu}\.?[\s-]?){1,4})\z"
    shouted = r"^(?:\p{Lu}\.)*\p{Lu}{4,}(?:-\p{Lu}{2,})*\.?\z"
    # Initials that hold a hyphen and no dot get one dot at their end, others one each.
    first = lambda i: F.when(F.contains(i, F.lit("-")) & ~F.contains(i, F.lit(".")), F.concat(F.trim(i), F.lit("."))).otherwise(F.regexp_replace(F.regexp_replace(i, r"[.\s]", ""), r"(\p{Lu})", r"$1."))
    turned = lambda x: F.when(F.regexp_like(x, F.lit(dotted)), F.concat(first(F.regexp_extract(x, dotted, 2)), F.regexp_extract(x, dotted, 1))).otherwise(x)
    close = lambda x: F.regexp_replace(F.regexp_replace(x, r"(?<![\p{L}.'-])(\p{Lu})\s+(?=\p{Lu}(?:\p{Ll}|\.))", "$1."), r"(?<=\.)\s+", "")
    title = lambda w: F.replace(F.initcap(F.regexp_replace(F.lower(w), r"([.-])", "$1 ")), F.lit(" "), F.lit(""))

    def full(x: Column) -> Column:
        words = F.array_join(F.transform(F.split(x, " "), lambda w: F.when(F.regexp_like(w, F.lit(shouted)), title(w)).when(w.isin("Ii", "Iii", "Iv"), F.upper(w)).otherwise(w)), " ")
        return F.when(F.regexp_like(x, F.lit(r"\p{Lu}{4}|\sI(?:ii?|v)\z")), words).otherwise(x)

    return F.when(F.regexp_like(x, F.lit(r"^(?:\p{Lu}\.)*\p{Lu}\p{Ll}+\.?\z")), x).otherwise(let(let(turned(x), close), full))


def team(x: Column) -> Column:
    """The authors of a list, in order; suffixes such as f. and Jr. stay with the author before them, initials
    after every surname go before it."""
    surname = r"(?<![\p{L}.'-])\p{Lu}[\p{L}'-]*\p{Ll}"
    steps = (
        # What a list must hold for a step, its pattern and what that becomes.
        (r"[\[\]()\"]", r"[\[\]()\"]", ""),
        (r",\s*(?:&|and\s|et\s)", r",\s*(?:&|and|et)\s+", " & "),
        (r",", rf"\s*,\s*(?={_SUFFIX}\.?(?:\s|,|&|\z))", " "),
        (r"\sf", r"\s+(?=(?:f|fil)\.(?:\s|,|&|\z))", " "),
        (r",\s*\p{Lu}[a-z]?\.", rf"({surname}),\s*({_INITIALS})(?=\s*(?:,|&|;|\z|and\s|et\s))", "$2$1"),
        (r"\s\p{Lu}{1,3}\s+\p{Lu}\p{Ll}", rf"({surname}\s+(?!II|IV)\p{{Lu}}{{1,3}})\s+(?=\p{{Lu}}\p{{Ll}}+\s+\p{{Lu}}{{1,3}}(?:\s|,|&|\z))", "$1, "),
    )

    def step(x: Column, k: int) -> Column:
        if k == len(steps):
            return F.filter(F.transform(F.split(x, _SEPARATOR), lambda a: author(F.trim(a))), lambda a: a != "")
        needs, pattern, become = steps[k]
        return let(F.when(F.regexp_like(x, F.lit(needs)), F.regexp_replace(x, pattern, become)).otherwise(x), lambda y: step(y, k + 1))

    none = F.array().cast(_EMPTY)
    return F.when(x == "", none).when(F.regexp_like(x, F.lit(r"^\p{Lu}[\p{L}.]*\p{Ll}[\p{L}.]*\z")), F.array(x)).otherwise(F.coalesce(step(x, 0), none))


def has_range(x: Column) -> Column:
    return F.coalesce(F.regexp_like(x, F.lit(_RANGE)), F.lit(False))


def authorship(x: Column) -> Column:
    """AUTHORSHIP of a string such as "Hook.f. ex Mill. & L., 1753" (null or empty: nothing).

    A year in square brackets is an imprint year. Where the end is no year, the first number of three or four
    digits is the year and a second one the imprint year, and numbers part the authors."""
    none = F.array().cast(_EMPTY)
    number = r"(?<![0-9])([0-9]{3,4})(?![0-9])"

    def named(names: Column, year: Column, imprint: Column) -> Column:
        def both(p: Column) -> Column:
            people = F.transform(p, team)
            return let(people, lambda t: F.struct(F.get(t, F.size(t) - 1).alias("authors"), F.when(F.size(t) > 1, F.get(t, F.lit(0))).otherwise(none).alias("exAuthors"), year.alias("year"), imprint.alias("imprintYear")))

        parts = F.when(F.contains(names, F.lit("ex")), F.split(F.regexp_replace(names, r"^ex\.?\s+", ""), r"\sex\.?\s+(?!.*\sex\.?\s)")).otherwise(F.array(names))
        return let(parts, both)

    def read(t: Column) -> Column:
        digits = F.regexp_like(t, F.lit("[0-9]{3}"))
        return let(F.when(digits, groups(t, _YEAR, 4)), lambda y: F.when(digits & y.isNull(), scattered(t)).otherwise(dated(t, y)))

    def dated(t: Column, y: Column) -> Column:
        names = F.regexp_replace(F.replace(F.coalesce(F.get(y, F.lit(0)), t), F.lit("?"), F.lit("")), r"[\s,(\[]+\z", "")
        bracket = F.coalesce(F.endswith(F.get(y, F.lit(0)), F.lit("[")), F.lit(False))
        return named(names, F.when(~bracket, filled(y, 2)), F.coalesce(F.when(bracket, filled(y, 2)), filled(y, 3), filled(y, 4)))

    def scattered(t: Column) -> Column:
        left = F.trim(F.regexp_replace(t, r"[0-9][\p{L}0-9/–?.-]*", ","))
        return let(F.regexp_extract_all(t, F.lit(number), 1), lambda n: named(F.regexp_replace(left, r"^[\s,]+|[\s,(\[\"]+\z", ""), F.get(n, F.lit(0)), F.get(n, F.lit(1))))

    null = F.lit(None).cast("string")
    nothing = F.struct(none.alias("authors"), none.alias("exAuthors"), null.alias("year"), null.alias("imprintYear"))
    return let(F.coalesce(F.trim(x), F.lit("")), lambda t: F.when(t == "", nothing).otherwise(read(t)))


def simple(x: Column) -> Column:
    """Of a string that is a list of plain surnames with or without a year, or a surname with two initials after it, the list and the year with a tab between them; else x."""
    return F.regexp_replace(F.regexp_replace(x, _SIMPLE, "$1\t$2"), _TURNED, "$2.$3.$1\t$4")


def simple_authorship(found: Column, x: Column) -> Column:
    """AUTHORSHIP of x (null or empty: nothing), where found is what simple gives for it."""
    none, null = F.array().cast(_EMPTY), F.lit(None).cast("string")
    made = lambda names, year: F.struct(names.alias("authors"), none.alias("exAuthors"), year.alias("year"), null.alias("imprintYear"))
    names = F.split(F.substring_index(found, "\t", 1), " & |, ")
    return F.when(F.coalesce(x, F.lit("")) == "", made(none, null)).when(F.contains(found, F.lit("\t")), made(names, F.nullif(F.substring_index(found, "\t", -1), F.lit("")))).otherwise(F.get(authorships(x), F.lit(0)))


def authorships(*xs: Column) -> Column:
    """An array with the AUTHORSHIP of each string: one expression, however many there are."""
    return F.transform(F.array(*xs), authorship)


def exists(a: Column) -> Column:
    """Authors or a year; those before ex alone don't count."""
    return (F.size(a["authors"]) > 0) | a["year"].isNotNull()


def render(a: Column, code: Column | None = None) -> Column:
    """Authors joined by commas and an ampersand, those before ex first, then the year."""
    code = F.lit(None).cast("string") if code is None else code

    def names(xs: Column) -> Column:
        n = F.size(xs)
        last = F.try_element_at(xs, F.lit(-1))
        head = F.array_join(F.slice(xs, 1, F.greatest(n - 1, F.lit(0))), ", ")
        many = (code == "BACTERIAL") & (n > 2)
        rest = F.when(last.isin("al.", "al"), F.concat(head, F.lit(" et al."))).otherwise(F.concat(head, F.lit(" & "), last))
        return F.when(n == 0, F.lit(None)).when(n == 1, F.get(xs, F.lit(0))).when(F.coalesce(many, F.lit(False)), F.concat(F.get(xs, F.lit(0)), F.lit(" et al."))).otherwise(rest)

    comma = F.when(F.coalesce(code == "BACTERIAL", F.lit(False)), F.lit(" ")).otherwise(F.lit(", "))
    who = F.concat_ws(" ex ", names(a["exAuthors"]), names(a["authors"]))
    return F.nullif(F.when(who == "", F.coalesce(a["year"], F.lit(""))).otherwise(F.concat(who, F.coalesce(F.concat(comma, a["year"]), F.lit("")))), F.lit(""))

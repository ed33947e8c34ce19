"""Normalisers of names, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from taxaflow.plans import vocab

#: A word's border by ASCII letters, digits and underscore alone (Java's own border knows accents).
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it.

    A projection that holds such a function over arrays is also a piece of its own to Spark's code generator,
    which else joins a chain of projections into methods too large to be compiled."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def code_break(x: Column) -> Column:
    """x itself, see let."""
    return let(x, lambda y: y)


def apart(x: Column) -> Column:
    """x itself. A projection that holds such a value isn't joined with its neighbours' generated code, as with
    code_break, but x is compiled, which is several times faster; for values that no function over arrays is part of."""
    return F.when(F.exists(F.array(F.lit(True)), lambda y: y), x)


def trie(words: set[str]) -> str:
    """A pattern of these words that looks at each letter once."""
    after = {w[0]: {v[1:] for v in words if v and v[0] == w[0]} for w in sorted(words) if w}
    found = "|".join((r"\." if c == "." else c) + trie(rest) for c, rest in after.items())
    return f"(?:{found})?+" if "" in words and found else f"(?:{found})" if found else ""


def any_of(words: set[str]) -> str:
    """A pattern that finds any of these texts; it tells by a few classes of first letters where none can begin."""
    firsts = sorted({w[0] for w in words})
    parts = [firsts[k : k + 5] for k in range(0, len(firsts), 5)]
    return "|".join(f"(?=[{''.join(part)}])" + trie({w for w in words if w[0] in part}) for part in parts)


def groups(x: Column, pattern: str, n: int) -> Column:
    """The n groups of a pattern that takes the whole text, as an array ('' for a group that took no part); null
    where it doesn't match. One replacement gives all groups; the text holds no tabs."""
    return F.when(F.regexp_like(x, F.lit(pattern)), F.split(F.regexp_replace(x, pattern, "\t".join(f"${k}" for k in range(1, n + 1))), "\t"))


def filled(groups: Column, k: int) -> Column:
    """Group k (from 1) without spaces around it, null if it is empty."""
    return F.nullif(F.trim(F.get(groups, F.lit(k - 1))), F.lit(""))


def trim_control(x: Column) -> Column:
    """Without code points up to U+0020 at both ends."""
    return F.regexp_replace(x, r"^[\x00-\x20]+|[\x00-\x20]+\z", "")


def normalise_quotes(x: Column) -> Column:
    """Typographic quotes and primes as ASCII quotes."""
    return F.translate(x, vocab.SINGLE_QUOTES + vocab.DOUBLE_QUOTES, "'" * len(vocab.SINGLE_QUOTES) + '"' * len(vocab.DOUBLE_QUOTES))


def repair_win1252(x: Column) -> Column:
    return F.translate(x, "".join(vocab.WIN1252), "".join(vocab.WIN1252.values()))


def fold_lookalikes(x: Column) -> Column:
    """Letters of other scripts that look like Latin ones, and full-width forms, as the latter."""
    return F.translate(x, "".join(vocab.LOOKALIKES), "".join(vocab.LOOKALIKES.values()))


def collapse_space(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(x, r"[ \t-\r\x1C-\x1F\u1680\u2000-\u2006\u2008-\u200A\u2028\u2029\u205F\u3000]+", " "))


def is_viral(word: Column) -> Column:
    return F.regexp_like(word, F.lit(vocab.VIRAL_SUFFIX))


def is_unlikely_year(year: Column) -> Column:
    """Not four digits (a trailing question mark aside), or outside 1500 to 2100; null for no year."""
    bare = F.regexp_replace(year, r"\?\z", "")
    four = F.regexp_like(bare, F.lit(r"^[0-9]{4}\z"))
    number = F.when(four, bare.cast("int"))
    return F.when(year.isNull(), F.lit(None)).when(F.endswith(year, F.lit("?")), F.lit(False)).otherwise(~four | ~number.between(1500, 2100))


def published_year(reference: Column) -> Column:
    """The last year from 1500 to 2100 in a reference."""
    years = F.regexp_extract_all(reference, F.lit(r"(?<![0-9])(1[5-9][0-9]{2}|20[0-9]{2}|2100)(?![0-9])"), 1)
    return F.try_element_at(years, F.lit(-1)).cast("int")


def suffix_rank(name: Column, code: Column) -> Column:
    """The rank that the ending of a name above genus tells, under the code or, without one, under any."""
    lower = F.lower(name)

    def cascade(table: dict[str, str]) -> Column:
        return F.coalesce(*(F.when(F.endswith(lower, F.lit(s)), F.lit(r)) for s, r in sorted(table.items(), key=lambda x: -len(x[0]))))

    out = F.when(code.isNull(), cascade(vocab.PLAIN_SUFFIX_RANKS))
    for own, table in vocab.SUFFIX_RANKS.items():
        out = out.when(code == own, cascade(table))
    return out


def code_vote(votes: Column) -> Column:
    """The one distinct vote of an array of codes (nulls don't vote), else null."""
    cast = F.array_distinct(F.array_compact(votes))
    return F.when(F.size(cast) == 1, F.get(cast, F.lit(0)))


#: A UNITE species hypothesis or a BOLD index number at the start.
BARCODE = r"(?i)^(?:SH[0-9]{6,}\.[0-9]+FU|BOLD:[A-Z]{3}[0-9]+)"


def is_barcode_otu(x: Column) -> Column:
    return F.regexp_like(x, F.lit(BARCODE))


def strip_html(x: Column) -> Column:
    """Tags removed, the four basic entities decoded, white space collapsed where either occurred."""
    plain = F.regexp_replace(x, r"</?[a-zA-Z][^<>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return F.when(F.contains(x, F.lit("<")) | F.contains(x, F.lit("&")), collapse_space(plain)).otherwise(x)

"""The words of a name: tokens with kinds, read by one grammar over the coded tokens.

A name is cut into tokens (words, numbers, signs). Each gets a kind, one letter, by a table of the words that
mean something and by its first letters otherwise. Coded, a token is its kind, its text with the space before
it, and a mark. The grammar is one pattern over coded tokens, whose groups are the parts of a name; a part is a
few kinds in a row, so nothing in it is tried letter by letter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from taxaflow.functions import text
from taxaflow.plans import vocab

END = "\u0001"
_TOKEN = r"\s*(?:[0-9]+-\p{Ll}[\p{L}\p{M}0-9'!-]*+|\p{L}[\p{L}\p{M}0-9'!]*+(?:[-_]\p{L}[\p{L}\p{M}0-9'!]*+)*+|[0-9]+|\S)"

# ---- Fixed values: words with a kind of their own. ----
_QUALIFIERS, _UNDETERMINED, _NOBODY, _JOINED = ("cf", "aff", "near"), ("sp", "spp", "species", "indet"), ("anon", "hort"), ("et", "and", "y")
#: Ends of an epithet that make it one of an aggregate.
AGGREGATES = ("-aggregate", "-complex", "-group")


def _kinds() -> dict[str, str]:
    marks = [(p + m, "m") for m in vocab.INFRASPECIFIC for p in ("", "notho")] + [("n" + m, "m") for m in ("var", "subsp", "ssp", "f", "subvar")]
    more = [(p + m, "i") for m in vocab.INFRAGENERIC for p in ("", "notho")]
    lists = {"q": _QUALIFIERS, "s": _UNDETERMINED, "a": _NOBODY, "e": _JOINED, "S": ("spec",), "z": ("agg", "aggregate", "group", "complex"), "x": ("ex",), "v": ("al",), "h": ("x", "X")}
    return {w: "p" for w in vocab.PARTICLES} | dict(more) | dict(marks) | {w: k for k, words in lists.items() for w in words}


#: The kinds, the most frequent last; they stand behind the text while it is coded, so that a pattern can pick one.
_LETTERS = "zveaSxisqoHhgpmInUCl"
_TAIL = "\u0004" + _LETTERS
#: No more letters of a word.
_OVER = r"(?![\p{L}\p{M}0-9'!]|[-_]\p{L})"


def _coder() -> tuple[str, str]:
    """The pattern of a token that finds its kind, and what a token becomes: its kind, its text and a mark."""
    listed: dict[str, set[str]] = {}
    for word, kind in _kinds().items():
        if word.islower():
            listed.setdefault(kind, set()).add(word)
    run = r"[\p{L}\p{M}0-9'!]|[-_](?=\p{L})"
    forms = [(text.trie(own) + _OVER, kind) for kind, own in listed.items()] + [
        (rf"\p{{Ll}}{_OVER}", "g"), (rf"\p{{Ll}}(?:(?!'\p{{Lu}})(?:{run}))*+'", "p"), (r"\p{Ll}", "l"),
        (f"X{_OVER}", "h"), (rf"\p{{Lu}}{_OVER}", "I"), (rf"\p{{Lu}}(?:(?!\p{{Ll}})(?:{run}))*+\p{{Ll}}", "C"), (r"\p{Lu}", "U"),
        (r"[0-9]++-\p{Ll}", "l"), ("[0-9]", "n"), (r"[×+]", "H"), (r"\p{L}", "l"),
    ]
    pick = lambda kind: rf"(?=.*({kind}).{{{len(_LETTERS) - 1 - _LETTERS.index(kind)}}}\z)"
    kinds = [form + pick(kind) for form, kind in forms] + [r"(?=([.,&()?:'-]))", pick("o")]
    become = "".join(f"${k}" for k in range(1, len(kinds) + 2))
    return rf"(?s)\s*+{_TAIL}\z|(?= *+(?:{'|'.join(kinds)}))({_TOKEN})", become + END


def coded(x: Column) -> Column:
    """The tokens of x, each as its kind, its text and a mark."""
    pattern, become = _coder()
    # The kinds behind the text become a mark of their own.
    held = F.regexp_replace(F.concat(x, F.lit(_TAIL)), pattern, become)
    return F.regexp_replace(held, rf"{END}\z", "")


def _t(kinds: str) -> str:
    """One token of one of these kinds."""
    return rf"[{kinds}][^{END}]*+{END}"


_DOT = rf"(?:{_t('.')})?"
#: An author between the parts of a name: surnames, particles, initials; or one in brackets and what follows it.
_PEOPLE = rf"(?:[CUIpv.,&'][^{END}]*+{END})"
_AMID = rf"(?:[CUIp][^{END}]*+{END}{_PEOPLE}*?|\([^{END}]*+{END}(?:[^()][^{END}]*+{END})*+\)[^{END}]*+{END}{_PEOPLE}*?)"
_EPITHET = _t("lg")
#: A year somewhere in what follows.
_DATED = rf"(?=.*n\s*[12][0-9]{{3}}{END})"


def _unit() -> str:
    """A further epithet with its marker (qualifier, author, marker, "sp", cross, epithet), or bare (qualifier, cross, epithet)."""
    marked = rf"({_AMID})??((?:{_t('m')}|s\s*sp{END})){_DOT}(?:({_t('sS')}){_DOT}(?=[lg]))?({_t('Hh')})?({_EPITHET}|I[^{END}]*+{END}(?!\.))"
    return rf"(?:({_t('q')}{_DOT}|{_t('?')})?(?:{marked}|({_t('Hh')})?({_t('l')})))?"


_PARTS = (
    "hyb", "genus", "sub", "gauth", "imark", "isub", "qual", "indet", "spx", "sp",
    *(f"{c}{k}" for k in (1, 2, 3) for c in ("q", "by", "mark", "fsp", "x", "isp", "bx", "bare")),
    "extra", "agg", "late", "sauth", "last", "tag", "number", "more", "auth",
)
_GENUS = rf"({_t('Hh')})?(I[^{END}]*+{END}{_t('.')}|C\p{{L}}{{1,4}}{END}{_t('.')}(?=[lgH])|{_t('CU')}|{_t('?')})"
#: A bracketed word is a subgenus before an epithet, at the end, before a year, or if it repeats the genus.
_SUBGENUS = rf"(?<!aceae{END})(?<!oideae{END}){_t('(')}(?:(?=[CUl][^{END}]*+{END}\)[^{END}]*+{END}(?:[lgHhqsSmi]|\z|{_DATED})|(?:\2)\)|[CUI][^{END}]*+{END}\.[^{END}]*+{END}\)[^{END}]*+{END}[lgHhqsS]))((?:{_t('CUIl')}){_DOT}){_t(')')}"
_GRAMMAR = (
    rf"^{_GENUS}(?:{_SUBGENUS}|({_AMID})??({_t('i')}){_DOT}({_t('CUI')}))?"
    rf"(?:({_t('q')}{_DOT}(?:{_t('CUI')}{_DOT}(?=[lg]))?|{_t('?')}(?=[lgHh])))?"
    rf"(?:({_t('s')}{_DOT}.*+|S(?![^{END}]*+{END}[CUI(]).*+)|({_t('Hh')})?({_t('l')}|S[^{END}]*+{END}|[mi][^{END}]*+{END}(?!\.|[lg]))"
    rf"{_unit()}{_unit()}{_unit()}((?:{_EPITHET})*+)(?:({_t('z')}){_DOT})?(?:(?:({_t('m')}){_DOT}(?=[CUI(]|\z)|({_AMID})(m(?!\s*f{END})[^{END}]*+{END}){_DOT}\z)|({_t('sS')}){_DOT}({_t('n')})(.*+)|{_t('sS')}{_DOT}\z)?)?(.*)\z"
)


def _short() -> tuple[str, str]:
    """A pattern of names that the grammar reads in one way, without their tokens, and what they become: all of _PARTS with tabs
    between them. Genus, epithet, a further one with or without a marker and an author before it; then people, brackets, signs
    and years, in which no word stands that could be a part of the name."""
    known = _kinds()
    word = rf"(?!{text.trie({w for w in known if w.islower()})}(?: |\z))\p{{Ll}}{{3,}}+(?= |\z)"
    marks = text.trie({m for m in vocab.INFRASPECIFIC if m.isalpha() and m.islower() and known[m] == "m"})
    one = r"(?!X(?:[ .]|\z))\p{Lu}\p{Ll}*+\.?"
    people = rf"{one}(?:(?: &)? {one})*+"
    years = r"(?:,? [0-9]{4})?"
    rest = rf"(?:\({people}{years}\)(?: {people}(?:(?<=\p{{Ll}}\.)f\.(?=\z))?{years})?|{people}(?:(?<=\p{{Ll}}\.)f\.(?=\z))?{years})"
    pattern = rf"^(\p{{Lu}}\p{{Ll}}{{2,}}+) (×(?=\p{{Ll}}))?({word})(?:(?: ({people}))? ({marks})\.? ({word})| ({word}))?(?: ({rest}))?\z"
    group = {part: k for k, part in enumerate(("genus", "spx", "sp", "by1", "mark1", "isp1", "bare1", "auth"), 1)}
    return pattern, "\t".join(f"${group[part]}" if part in group else "" for part in _PARTS)


def short(x: Column) -> Column:
    """The parts of a name that needs no tokens, with tabs between them; of all others x itself."""
    return F.regexp_replace(x, *_short())


def glued(x: Column) -> Column:
    """x with a space after a cross that touches the genus."""
    return F.regexp_replace(x, r"^[xX×](?=\p{Lu}\p{Ll})", "× ")


def matched(coded: Column, particle: Column) -> Column:
    """The parts of coded tokens with tabs between them, none where they begin like no name.

    particle tells whether a particle in the place of the epithet is one. One match of the grammar gives all parts."""
    free = F.when(particle, F.regexp_replace(coded, rf"^((?:{_t('Hh')})?[CU][^{END}]*+{END})p([^{END}]*+{END})(?![.lg])", "$1l$2")).otherwise(coded)
    return F.regexp_replace(free, _GRAMMAR, "\t".join(f"${k}" for k in range(1, len(_PARTS) + 1)))


def parted(matched: Column) -> Column:
    """An array with the text of each of _PARTS, null where there are none: kinds, marks and outer spaces go."""
    return F.when(F.contains(matched, F.lit("\t")), F.split(F.regexp_replace(matched, f"(^|\t)[^\t{END}]\\s*|{END}[^\t{END}]?", "$1"), "\t"))


def part(words: Column, name: str) -> Column:
    """One part, null if the name has none."""
    return F.nullif(F.get(words, F.lit(_PARTS.index(name))), F.lit(""))

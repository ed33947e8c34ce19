"""The annotation rules: an ordered table of what is taken out of a name before its words are read.

A rule has a pattern and, for each field it touches, an effect; where the pattern is found the match is
replaced. `triggered` first asks for each rule whether the name holds one of the texts that the rule can't do
without, which is much cheaper than its pattern; the rules that are left, none or a few for most names, are
worked off by one `aggregate` (`worked`) with one step for all of them. A rule's replacement holds both what is
left of the text and the entries for the fields, so a rule is one match; `fields` reads the entries.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from taxaflow.functions.text import EDGE, let
from taxaflow.plans import vocab

#: The fields that rules fill, with their types, beside the text that is left of the name.
FIELDS = {
    "warnings": "array<string>", "doubtful": "boolean", "extinct": "boolean", "candidatus": "boolean", "manuscript": "boolean", "aggregate": "boolean", "informal": "boolean", "monomial": "boolean",
    "original_spelling": "string", "tax_note": "string", "nom_note": "string", "published_in": "string", "page": "string", "imprint_year": "string", "reference_year": "string", "cultivar": "string",
    "phrase": "string", "pinned_rank": "string", "marker": "string", "pinned_code": "string", "unparsed": "string", "quoted": "string",
}
#: Fields that several rules add to, and fields whose first value counts; of others the last one does.
JOINED, FIRST = ("tax_note", "nom_note", "published_in"), ("imprint_year", "reference_year", "unparsed")


@dataclass(frozen=True)
class Rule:
    """pattern: what is found. become: what replaces it ($1 for groups). The rest: effects by field.

    put: set to a value, or to a group (an int). first: the same where the field is empty yet.
    add: append a text, or a group's, after a space. warn: warnings to add. unless: a pattern that forbids.
    needs: lower-case texts one of which a name must hold, in lower case, for the rule to be tried; a text in slashes
    is a pattern, after "/=" one for the name as it is.
    """

    name: str
    needs: tuple[str, ...]
    pattern: str
    become: str = ""
    put: dict[str, object] = field(default_factory=dict)
    first: dict[str, object] = field(default_factory=dict)
    add: dict[str, object] = field(default_factory=dict)
    warn: tuple[str, ...] = ()
    unless: str | None = None


_E = EDGE
_PAGES = r"(?<![0-9])[0-9]{3,}-[0-9]{3,}(?![0-9])"
_TITLE = r"\p{Lu}\p{Ll}{2,}[\p{L}.]*(?:\s+(?!(?:of|in|de|et|the|und|für)\s)(?:\p{Lu}[\p{L}.]+|\p{Ll}\p{L}+))*+\s+(?:of|in|de|et|the|und|für)\s+"
_AUTHOR_TAIL = r"(?=\s*\z)"

# ---- Fixed values: words that begin a note on whose name it is, whatever follows; those that need an author after them; negations; errors; senses. ----
_CONCEPTS = ("auctt", "auct", "sensu", "sec", "excl", "ss")
_OTHERS = ("nonn", "non", "emend", "fide")
_NEGATIONS = ("nec", "non", "not")
_ERRORS = ("misspelling", "misapplied", "misident")
_SENSES = ("lat", "l", "str", "ampl", "s")


def _bracketed(opening: str, words: tuple[str, ...], closing: str) -> str:
    """A note at the end, in brackets, that begins with one of these words."""
    return rf"\s*{opening}\s*((?i:{'|'.join(sorted(words, key=lambda w: (-len(w), w)))}){EDGE}(?:(?!{closing}).)*){closing}\s*\.?\s*\z"


# ---- Fixed values: the forms of annotations, in the order in which they are looked for. ----
RULES = (
    Rule("label stuck to a genus", ("/^[^ ]+$/",), vocab.GLUED_PHRASE, "$1", put={"phrase": 2, "informal": True}),
    Rule("trailing question mark", ("?",), r"\s\?\s*\z", put={"doubtful": True}, warn=("question",)),
    Rule("uncertain author", ("?",), r"(\p{L})\?(?=\s*(?:\z|[&,]))", "$1?", put={"doubtful": True}, warn=("uncertain",)),
    Rule("either author", (" or ",), r"(\p{Lu}\p{L}*\s+)or(\s+\p{Lu})", "$1or$2", put={"doubtful": True}, warn=("uncertain",)),
    Rule("author or author", ("/",), r"(\p{L}\s*)/(\s*\p{L})", "$1/$2", put={"doubtful": True}, warn=("uncertain",)),
    Rule("uncertain genus", ("? ",), r"^(\p{Lu}\p{Ll}+)\?\s+(?=\p{Ll})", "$1 ", put={"doubtful": True}, warn=("question",)),
    Rule("quoted monomial", ("'", '"'), r"^(['\"])\s*(\p{Lu}[\p{L}-]+)\s*\1(?=\s+\S|\z)", "$2", put={"quoted": 1, "doubtful": True}),
    Rule("quoted missing genus", ('"?',), r"^\"\?\s+", "? "),
    Rule("missing genus as a word", ("missing ",), r"^Missing (?=\p{Ll})", "? "),
    Rule("missing genus", (r"/=^[a-z][a-z-]+\s/",), rf"^(?!(?:non|nec|not|sensu|sec|auct|auctt|fide|emend|ss|s|cf|aff|hort){_E})(?!(?:{'|'.join(vocab.PARTICLES)})\s)(?=[a-z][a-z-]+\s+\p{{Lu}})", "? ", warn=("missing_genus",)),
    Rule("letter of another script", ("/[α-ω⍺]/",), r"([\p{Ll}.])\s*[α-ω⍺](?:\s+|\.\s*)(?=\p{Ll})", "$1 "),
    Rule("lone letter", ("/ [a-g] /",), r"(?<=\p{Ll}{2})\s+[a-g]\s+(?=\p{Ll}{3})", " "),
    Rule("stars", ("/[*]/",), r"(?<=\p{Ll})\s+\*+\s+(?=\p{Ll})", " "),
    Rule("letter subdivision", ("/ [a-z]\\./",), r"^(\p{Lu}[\p{Ll}-]+\s+\p{Ll}[\p{Ll}-]+(?:\s+\p{Lu}\p{Ll}*\.?)*)\s+(?:[a-z]\.){1,3}[a-z]?\s+(\p{Ll}[\p{Ll}-]{2,})\s*\z", "$1 infrasubdivision $2", unless=r"\s(?:[fv]\.|s\.\s?[sl]\.)\s+\p{Ll}+\z"),
    Rule("question mark in a word", ("?",), r"(\p{L})\?(\p{L})", "$1$2", put={"doubtful": True}, warn=("question",)),
    Rule("strain", (" str",), r"(?<=\p{Ll})\s+(?:str\.?|strain)\s+(['\"])([^'\"]+)\1\s*\z", put={"phrase": 2, "informal": True}),
    Rule("strain code", (r"/=\s(?:[dr]?RNA\S*|\p{Lu}[\p{L}0-9:]*[0-9]\S*)\s*\z/",), r"^(\p{Lu}\p{Ll}+\s+\p{Ll}+)\s+([dr]?RNA[a-zA-Z0-9_-]*|\p{Lu}[\p{L}0-9:]*[0-9][\p{L}0-9_:-]*)\s*\z", "$1", put={"phrase": 2, "informal": True}),
    Rule("culture accession", (r"/=\s[A-Z]{3,5}[ :=_-]*(?:[A-Z]{1,4}-)?[0-9]/",), r"^(\p{Lu}\p{Ll}+\s+\p{Ll}[\p{Ll}-]+)\s+((?:" + "|".join(sorted(vocab.CULTURE_COLLECTIONS, key=lambda x: (-len(x), x))) + r")[ :=_-]*(?:[A-Z]{1,4}-)?[0-9][0-9A-Za-z.:-]*)\s*\z", "$1", put={"phrase": 2, "informal": True}),
    Rule("quoted imprint year", ("[",), r"\s*\[\s*\"([0-9]{4})\"\s*\]", first={"imprint_year": 1}),
    Rule("imprint year", ("imprint", "(not", "( not"), r"(?i)\s*\(\s*(?:imprint|not)\s+([0-9]{4}(?:[-–][0-9]{4})?)\s*\)\s*\.?\s*\z", first={"imprint_year": 1}),
    Rule("second year", ("&",), r"(?<=[0-9]{4})\s+&\s+([0-9]{4})\s*\.?\s*\z", first={"imprint_year": 1}),
    Rule("null epithet", (" null ",), r"(?<=\p{Ll})\s+null\s+(?=\p{Ll})", " ", put={"doubtful": True}, warn=("null",)),
    Rule("hyphens", ("/[^ -~]/",), f"[{vocab.HYPHENS}]", "-", warn=("homoglyphs",)),
    Rule("underscores", ("__",), "__+", " "),
    Rule("otu code", ("_",), r"\s+([A-Z0-9]{3,}_[0-9]{3,})\s*\z", first={"unparsed": 1}),
    Rule("serovar", ("sero",), r"(?i)\s*\(?\s*sero(?:var|type|group)s?\.?\s+[^()]*\)?\s*\z"),
    Rule("authorship in angle brackets", ("<",), r"\s*<(\p{Lu}[^<>/]*)>\s*\z", put={"doubtful": True}, warn=("authorship", "unusual")),
    Rule("encoded markup", ("&lt;",), r"&lt;/?[a-zA-Z][^<>&;]*&gt;", " ", warn=("entities", "tags")),
    Rule("markup", ("<",), r"</?[a-zA-Z][^<>]*>", " ", warn=("tags",)),
    Rule("entity lt", ("&lt;",), "&lt;", "<", warn=("entities",)),
    Rule("entity gt", ("&gt;",), "&gt;", ">", warn=("entities",)),
    Rule("entity quot", ("&quot;",), "&quot;", '"', warn=("entities",)),
    Rule("entity amp", ("&amp;",), "&amp;", "&", warn=("entities",)),
    Rule("candidatus", ("candidatus", "ca."), r"^[\"']?(?:Candidatus|Ca\.)\s+(\p{Lu}[^\"']*)[\"']?", "$1", put={"candidatus": True, "pinned_code": "BACTERIAL"}),
    Rule("hortulanorum", ("cv.", "hort", "ht."), rf"{_E}(?:(?:cv\.|Hort\.|hortusa?{_E})(?=\s+ex\s)|ht\.)", "hort."),
    Rule("cultivar group", (" group",), r"\s+(\p{Lu}\p{L}+(?:\s+\p{Lu}\p{L}+)*)\s+Group\s*\z", put={"cultivar": 1, "pinned_rank": "CULTIVAR_GROUP", "pinned_code": "CULTIVARS"}),
    Rule("grex", (" grex", " gx"), r"\s+(\p{Lu}\p{L}+(?:\s+\p{Lu}\p{L}+)*)\s+(?:grex|gx)\s*\z", put={"cultivar": 1, "pinned_rank": "GREX", "pinned_code": "CULTIVARS"}),
    Rule("cultivar", ("'", '"'), r"(?<=\S)\s+(?:cv\.?\s*)?(?:'([^']+)'|\"([^\"]+)\")(?=\s*\z|\s+\p{Lu})", put={"cultivar": (1, 2), "pinned_rank": "CULTIVAR", "pinned_code": "CULTIVARS"}, unless=r"(?i)(?:var|f|subsp|ssp)\.?\s+['\"]"),
    Rule("open cultivar quote", ("'",), r"(?<=\.)\s+'(\p{Lu}[\p{L} -]+)\s*\z", put={"cultivar": 1, "pinned_rank": "CULTIVAR", "pinned_code": "CULTIVARS"}),
    Rule("cultivar marker", (" cv",), r"(?<=\S)\s+cv\.?\s+(\p{L}[\p{L} -]*)\s*\z", put={"cultivar": 1, "pinned_rank": "CULTIVAR", "pinned_code": "CULTIVARS"}),
    Rule("dagger", ("†", "✝"), r"\s*[†✝]\s*", " ", put={"extinct": True}),
    Rule("special form", ("f.",), r"(?<=[\p{Ll}.])\s+f\.\s*sp\.\s+(?=\p{Ll})", " fsp. "),
    Rule("infraspecific taxon", ("infr",), rf"{_E}[tT]\.?\s*infr\.?\s+"),
    Rule("genus in brackets", ("[",), r"^\[\s*(\p{Lu}[\p{L}-]+)\s*\](?=\s|\z)", "$1", put={"doubtful": True}, warn=("doubtful_genus",)),
    Rule("sic with a comment", (r"/[(\[]\s*sic/",), r"\s*[(\[]\s*sic\s*,\s*([^)\]]+?)\s*[)\]]", put={"original_spelling": True}, first={"unparsed": ("(sic,", 1, ")")}),
    Rule("sic", (r"/[(\[]\s*sic/",), r"\s*[(\[]\s*sic\s*!?\s*[)\]]", put={"original_spelling": True}),
    Rule("corrected", ("corrig",), r"\s*[(\[]\s*corrig\.?\s*[)\]]|(?<=\s)corrig\.?(?=\s|\z)", put={"original_spelling": False}),
    Rule("synonym in brackets", ("[",), r",*\s*(\[\s*=[^\]]*\]\.?)\s*\z", put={"doubtful": True}, first={"unparsed": 1}),
    Rule("status in brackets", (r"/[\[(](?:nom|comb|orth|typ)/",), rf"(?i),?\s*[\[(]((?:nom|nomen|comb|orth|typ){_E}[^\])]*)[\])]\s*\z", put={"nom_note": 1}),
    Rule("status", (r"/[ ,>](?:nom|comb|orth|(?:sp|spec|gen|fam|var|form)\.? ?nov|nov|pro syn|not validly|opus utique|no type|without)/",), rf"\s*,?\s+((?i:nom|comb|orth|nomen){_E}\.?(?:[\s.&]*[a-z][a-z.]*)*+|(?:(?i:sp|spec|gen|fam|var|form){_E}\.?\s*(?i:nov){_E}\.?\s*)+|(?i:nov){_E}\.?\s+(?:sp|spec|gen){_E}\.?|without\s+type\.?|pro\s+syn{_E}\.?|(?:not\s+validly|opus\s+utique|no\s+type)\s.*)\s*\z", add={"nom_note": 1}),
    Rule("authorship placeholder", ("not ",), r"(?i)\s*,?\s+not\s+(?:applicable|given|known|recorded|found)\s*\z", warn=("authorship",)),
    Rule("species as a word", (" species",), r"^(\p{Lu}\p{Ll}+)\s+species\s*\.?\z", "$1"),
    Rule("pro parte", ("pro parte", r"/p\. ?p\./"), r"(?i)\s*,\s*(?:pro\s+parte|p\.\s*p\.[A-Z]?)\s*\z", put={"doubtful": True}),
    Rule("pro species", ("pro ",), rf"(?i)\s+\(\s*pro\s+(?:sp|spec|syn|hyb){_E}\.?\s*\)\s*\.?\s*\z"),
    Rule("approved lists", ("approved",), r"(?i)\s*\(\s*Approved\s+Lists\s+[0-9]{4}\s*\)\s*\.?\s*\z"),
    Rule("mihi", (" mihi",), r"\s+mihi\.?(?=\s|\z|,)", warn=("authorship",)),
    Rule("anonymous", (" anon",), rf"(?<=\s)(?:Anon{_E}\.?|anon{_E}(?!\.))", "anon."),
    Rule("concept reference", (": ",), r"\s*:\s+(\p{Lu}[^:]*,\s*[0-9]{3,4})\s*\.?\s*\z", add={"tax_note": 1}),
    Rule("concept in brackets", ("[",), _bracketed(r"\[", (*_CONCEPTS, *_NEGATIONS, *_ERRORS), r"\]"), add={"tax_note": 1}),
    Rule("homonym in brackets", ("(non", "(nec", "(not", "( n"), _bracketed(r"\(", _NEGATIONS, r"\)"), add={"tax_note": 1}),
    Rule("broad sense before a rest", (" s.",), r"\s+(s\.)\s*((?:l|lat|str|ampl)\.?)\s+(\S.*?)\s*\z", add={"tax_note": (1, "", 2)}, first={"unparsed": 3}),
    Rule("strict sense", (" s.",), r"\s+s\.\s*s\.?(?:\s+(\S.*?))?\s*\z", add={"tax_note": "s.s."}, first={"unparsed": 1}),
    Rule("concept", (r"/[ ,>](?:auct|sensu|sec|nec|non|emend|fide|s\.|excl|ss|according to)/",), rf"\s+,?\s*((?i:{'|'.join(_CONCEPTS)}){_E}(?![-_]).*|(?i:nec){_E}.*|(?i:{'|'.join(_OTHERS)}){_E}\.?\s+\(?(?:[dl]')?(?:\p{{Lu}}|ss\.).*|(?i:according\s+to)\s.*|s\.\s*(?:{'|'.join(_SENSES)})\.?)\s*\z", put={"tax_note": 1}),
    Rule("status before a concept", (", nom",), rf"\s*,\s+(nom{_E}\.?(?:\s+[a-z][a-z.]*)+)\s*,\s*\z", add={"nom_note": 1}),
    Rule("aggregate", ("agg", "group", "complex"), r"(?i)(?:\s+(?:agg\.?|aggregate|species\s+group|species\s+complex|group|complex)|\s*-\s*group|\s*-\s*aggregate)\s*\z", put={"aggregate": True}),
    Rule("page", (":",), r"(?<=[0-9]{4})\s*:\s*([0-9]+(?:[-–][0-9]+)?)\s*\z", put={"page": 1}),
    Rule("in press", ("press",), rf"(?i)\s+[(\[]?(in\s+press{_E}\.?)[)\]]?", add={"nom_note": 1}, put={"manuscript": True}),
    Rule("publication of a basionym", (" in ", " apud "), r"\((\p{Lu}[^()]*?)\s+(?:in|apud)\s+(\p{Lu}[^()]*?),?\s*([0-9]{4})\)", "($1, $3)", add={"published_in": (2, ", ", 3)}),
    Rule("publication", (" in ", " apud "), r"\s+(?:in|apud)\s+(\p{Lu}[^\s].*?)(?:,?\s*\(?([0-9]{3,4})\)?\s*\.?)?\s*\z", add={"published_in": (1, ", ", 2)}, first={"reference_year": 2}),
    Rule("status in a citation", (r"/\([0-9]{4}\)/",), rf"(?i)(?<=\s)(\p{{Lu}}[\p{{L}}.]+,\s+.+?)\s+((?:in\s+obs{_E}\.?,?\s*)?pro\s+syn{_E}\.?|(?:nom|comb|orth){_E}\.?(?:\s+[a-z][a-z.]*)*)\s*(?=\([0-9]{{4}}\)\.?\s*\z)", "$1 ", add={"nom_note": 2}),
    Rule("citation with a year in brackets", (r"/\([0-9]{4}\)/",), r"(?<=\s)(\p{Lu}[\p{L}.]+),\s+(.+\(([0-9]{4})\))\.?\s*\z", "$1", put={"published_in": 2}, first={"reference_year": 3}),
    Rule("reference after a full stop, with pages", (r"/=\p{Lu}\p{L}{2,}\.\s+\p{Lu}/",), rf"(\s+\p{{Lu}}\p{{L}}{{2,}})\.\s+(?=.*{_PAGES})({_TITLE}.*?)\.?\s*\z", "$1", put={"published_in": 2}, warn=("reference",)),
    Rule("reference after a full stop", (r"/=\p{Lu}\p{L}{2,}\.\s+\p{Lu}/",), rf"(\s+\p{{Lu}}\p{{L}}{{2,}})\.\s+(?=.*?(?<![0-9])([0-9]{{4}})(?![0-9])|)({_TITLE}.*?)\.?\s*\z", "$1", put={"published_in": 3}, first={"reference_year": 2}),
    Rule("reference after a comma", (", ",), r"(\s+\p{Lu}[\p{L}.]+),\s+(\p{Lu}\p{Ll}{2,}[\p{L}.]*(?:\s+(?:\p{Lu}[\p{L}.]+|on|and|for))*\s+(?:of|in|de|et|the|und|für)\s+.*)\z", "$1", put={"published_in": 2}, warn=("reference",)),
    Rule("manuscript", ("ined", " ms", "unpublished"), r"(?i)\s*,?\s+(ined\.?|ms\.?|msc\.?|unpublished)\s*\z", add={"nom_note": 1}, put={"manuscript": True}),
    Rule("remark", (", ",), rf"(?<=[\p{{L}}.]),\s+((?!(?:{'|'.join(vocab.PARTICLES)}|and|et|ex|in|apud|fil|filius){_E})\p{{Ll}}{{3,}}(?:\s+[\p{{L}}.]+){{2,}})\s*\z", first={"unparsed": 1}),
    Rule("rank before a name", ("trib", "subfam"), r"^(?:\p{Lu}\p{Ll}+\s+)?(subfam|trib|subtrib|supertrib|infratrib)\.?\s+(?=\p{Lu}\p{Ll}+)", put={"marker": 1}),
    Rule("infrageneric marker first", (r"/^(?:sub|su[pr]\w*)?(?:g|gen|genus|sect|section|ser|series)\.?\s/",), r"(?i)^(subg|subgen|subgenus|sect|section|subsect|subsection|supersect|suprasect|ser|series|subser|subseries)\.?\s+(?=\p{L})", put={"marker": 1}, unless=r"^\p{L}+\.?\s+\p{Ll}"),
    Rule("underscore for a space", ("_",), r"^(\p{Lu}\p{Ll}+)_(?=\p{Ll}[\p{Ll}-]*\z)", "$1 "),
    Rule("underscore before a label", ("_",), r"^(\p{Lu}\p{Ll}+)_([\p{Lu}0-9]\w*)\z", "$1", put={"phrase": 2, "informal": True, "monomial": True}),
    Rule("phrase name", (" sp",), r"^(\p{Lu}\p{Ll}+)\s+(?:sp\.?\s+)(\p{Lu}[\p{L} ]+\([^()]+\))\s*\z", "$1", put={"phrase": 2, "informal": True, "pinned_rank": "SPECIES"}),
)
#: Ranks of the markers that stand before a name.
MARKER_RANKS = (
    {"subfam": "SUBFAMILY", "trib": "TRIBE", "subtrib": "SUBTRIBE", "supertrib": "SUPERTRIBE", "infratrib": "INFRATRIBE"}
    | dict.fromkeys(("subg", "subgen", "subgenus"), "SUBGENUS") | dict.fromkeys(("sect", "section"), "SECTION_BOTANY") | dict.fromkeys(("subsect", "subsection"), "SUBSECTION_BOTANY")
    | dict.fromkeys(("supersect", "suprasect"), "SUPERSECTION_BOTANY") | dict.fromkeys(("ser", "series"), "SERIES_BOTANY") | dict.fromkeys(("subser", "subseries"), "SUBSERIES_BOTANY")
)

#: Rules that a separate authorship goes through as well.
OF_AUTHORSHIPS = {
    "sic with a comment", "sic", "corrected", "question mark in a word", "hortulanorum", "homonym in brackets", "concept in brackets", "status in brackets", "status", "status before a concept", "broad sense before a rest",
    "strict sense", "concept", "manuscript", "authorship placeholder", "markup", "entity amp",
}
#: Stands before a separate authorship, so that what begins it has something before it.
_BEGIN = "\u0006"
#: In a joined field, what stands before this mark is overwritten.
_ANEW = "\u0001"
#: How notes are written: patterns and what they become.
_TIDY = {
    "nom_note": ((r"\.(?=\p{L})", ". "), (r"\s+et\s+", " & "), (r"(?i)(?<=\s)(nov|spec|sp)\z", "$1.")),
    "tax_note": ((r"\s{2,}", " "), (r"^Auct", "auct")),
}
#: Marks in a replacement: around an entry, and between its field and its value.
_ENTRY, _OF = "\u0002", "\u0003"
#: The letter of the first rule.
_FIRST = 0x100


def _value(effect: object) -> str:
    """The replacement text of a literal, a group, the filled one of two groups, or two parts with a text between them."""
    group = lambda k: f"${k}" if isinstance(k, int) else _plain(k)
    if isinstance(effect, bool):
        return str(effect).lower()
    if isinstance(effect, tuple):
        return "".join(group(x) for x in effect)
    return group(effect)


def _plain(text: str) -> str:
    return text.replace("\\", "\\\\").replace("$", "\\$")


def _template(rule: Rule) -> str:
    """What a match becomes: the text that is left, then the entries the rule makes."""
    entries = [(n, (_ANEW if n in JOINED else "") + _value(e)) for n, e in rule.put.items()]
    entries += [(n, _value(e)) for n, e in (*rule.first.items(), *rule.add.items())] + [("warnings", _plain(vocab.WARNINGS[w])) for w in rule.warn]
    return rule.become + "".join(f"{_ENTRY}{n}{_OF}{v}{_ENTRY}" for n, v in entries)


#: What a need can't be met without, by a pattern for the lower-case text each; a need is only looked for where its own is found.
_GATES = {"sign": r"[?/'\"\[<&_*]", "bracket": r"[(\[]", "foreign": "[^ -~]", "number": "[0-9]|rna", "stop": r"\. ", "word": " (?:or |str|null |gr|gx|cv|species|mihi|anon|s\\.|in |apud |ms|sp)"}
_GATED = {r"/ [a-g] /": None, r"/[α-ω⍺]/": "foreign", r"/[^ -~]/": "foreign", "†": "foreign", "✝": "foreign", "/": "sign", r"/=\p{Lu}\p{L}{2,}\.\s+\p{Lu}/": "stop"}


#: Needs that stand within words; see `gates`.
HINTS = {"missing ", "imprint", "sero", "candidatus", "ca.", "cv.", "hort", "ht.", "infr", "corrig", "not ", "pro parte", "pro ", "approved", "agg", "group", "complex", "press", "ined", "unpublished", "trib", "subfam"}


def _gate(need: str) -> str | None:
    """The gate of a need, None for one that is looked for in every name."""
    if need in _GATED:
        return _GATED[need]
    if need in HINTS:
        return "hint"
    if need.startswith("/"):
        return "bracket" if need.startswith((r"/[(\[]", r"/[\[(]", r"/\(")) else "number" if need.endswith(("[0-9]/", r"[0-9]\S*)\s*\z/")) else "sign" if need == "/[*]/" else None
    if any(c in need for c in "?/'\"[<&_"):
        return "sign"
    if "(" in need:
        return "bracket"
    return "word" if need.startswith((" or ", " str", " null ", " gr", " gx", " cv", " species", " mihi", " anon", " s.", " in ", " apud ", " ms", " sp")) else None


def gates(low: Column, hint: Column) -> Column:
    """A struct of which of _GATES a lower-case text passes, for `triggered`; hint tells whether it holds one of HINTS."""
    return F.struct(hint.alias("hint"), *(F.regexp_like(low, F.lit(p)).alias(n) for n, p in _GATES.items()))


def triggered(text: Column, low: Column, passed: Column | None = None, given: bool = False) -> Column:
    """The rules to try on a text (low is its lower-case form), one letter each, by what they can't do without; of the rules
    for separate authorships, if given. passed is what `gates` gives for low, None to look for every need."""

    def test(need: str) -> Column:
        if need.startswith("/="):
            found = F.regexp_like(text, F.lit(need[2:-1]))
        else:
            found = F.regexp_like(low, F.lit(need[1:-1])) if len(need) > 2 and need[0] == need[-1] == "/" else F.contains(low, F.lit(need))
        gate = _gate(need)
        return found if passed is None or gate is None else passed[gate] & found

    hits = (F.when(reduce(lambda x, y: x | y, map(test, r.needs)), F.lit(chr(_FIRST + k))) for k, r in enumerate(RULES) if not given or r.name in OF_AUTHORSHIPS)
    return F.concat_ws("", *hits)


#: So many rules are told apart by one comparison.
_BLOCK = 9


def _replaced(text: Column, number: Column) -> Column:
    """text after the rule of a number: its pattern is a literal, which Spark compiles once."""

    def one(r: Rule) -> Column:
        new = F.regexp_replace(text, F.lit(r.pattern), F.lit(_template(r)))
        return F.when(~F.regexp_like(text, F.lit(r.unless)), new).otherwise(text) if r.unless else new

    out = F
    for start in range(0, len(RULES), _BLOCK):
        block = F
        for k in range(start, min(start + _BLOCK, len(RULES))):
            block = block.when(number == k, one(RULES[k]))
        out = out.when((number >= start) & (number < start + _BLOCK), block)
    return out.otherwise(text)


def _step(state: Column, number: Column) -> Column:
    """The state (text and entries) after a rule: one replacement, which gives text and entries together."""
    text = state["t"]

    def after(new: Column) -> Column:
        entries = F.regexp_replace(new, f"[^{_ENTRY}]*{_ENTRY}([^{_ENTRY}]*){_ENTRY}[^{_ENTRY}]*", f"{_ENTRY}$1")
        left = F.when(F.contains(new, F.lit(_ENTRY)), F.regexp_replace(new, f"{_ENTRY}[^{_ENTRY}]*{_ENTRY}", "")).otherwise(new)
        log = F.when(F.contains(new, F.lit(_ENTRY)), F.concat(state["log"], entries)).otherwise(state["log"])
        return F.when(new == text, state).otherwise(F.struct(F.trim(left).alias("t"), log.alias("log")))

    return let(_replaced(text, number), after)


def worked(text: Column, hits: Column) -> Column:
    """A struct of what is left of text after the rules of hits and of the entries they make; null where no rule is tried."""
    begin = F.struct(text.alias("t"), F.lit("").alias("log"))
    return F.when(hits != "", F.aggregate(F.transform(F.split(hits, ""), lambda c: F.ascii(c) - _FIRST), begin, _step))


def begun(given: Column) -> Column:
    """A separate authorship as the rules take it."""
    return F.concat(F.lit(_BEGIN + " "), given)


def merged(own: Column, other: Column, given: Column) -> Column:
    """The entries of a name; those that a separate authorship's rules make are added to its own, without repeats and empty ones."""
    mine, theirs = F.coalesce(own["log"], F.lit("")), F.replace(F.coalesce(other["log"], F.lit("")), F.lit(_ANEW), F.lit(""))
    log = F.when(given.isNull(), mine).otherwise(F.array_join(F.array_distinct(F.split(F.concat(mine, theirs), _ENTRY)), _ENTRY))
    return F.when(log == "", log).otherwise(F.regexp_replace(log, f"{_ENTRY}[^{_ENTRY}{_OF}]*{_OF} *(?={_ENTRY}|\\z)", ""))


def left(other: Column, given: Column) -> Column:
    """What the rules leave of a separate authorship."""
    return F.regexp_replace(F.trim(F.replace(F.coalesce(other["t"], begun(given)), F.lit(_BEGIN), F.lit(""))), r"[\s,]+\z", "")


def fields(text: Column, given: Column, log: Column) -> Column:
    """A struct of text, FIELDS and given (a separate authorship) by the entries in log."""
    state = {"t": text, "given": given, "log": log}
    return F.when(log != "", _told(state)).otherwise(_untold(state))


def _untold(state: dict[str, Column]) -> Column:
    return F.struct(state["t"].alias("text"), state["given"].alias("given"), *((F.array().cast(kind) if kind == "array<string>" else F.lit(False if kind == "boolean" else None).cast(kind)).alias(name) for name, kind in FIELDS.items()))


def _told(state: dict[str, Column]) -> Column:
    """The fields from the entries that the rules made, none of them empty."""
    log = state["log"]

    def read(name: str, kind: str) -> Column:
        key = f"{_ENTRY}{name}{_OF}"
        has = F.contains(log, F.lit(key))
        held = F.regexp_extract_all(log, F.lit(f"{key}([^{_ENTRY}]*)"), 1)
        if kind == "array<string>":
            return F.when(has, F.array_distinct(held)).otherwise(F.array().cast(kind))
        if kind == "boolean":
            return has
        if name in JOINED:
            # A group that took no part leaves the text between two parts at its end.
            parts = F.transform(held, lambda v: F.regexp_replace(F.trim(v), r",\s*\z", ""))
            whole = F.regexp_replace(F.array_join(parts, " "), f"^.*{_ANEW}", "")
            tidy = whole
            for pattern, become in _TIDY.get(name, ()):
                tidy = F.regexp_replace(tidy, pattern, become)
            return F.when(has, F.nullif(tidy, F.lit("")))
        value = F.substr(log, F.locate(key, log) + len(key)) if name in FIRST else F.substring_index(log, key, -1)
        return F.when(has, F.trim(F.substring_index(value, _ENTRY, 1)))

    return F.struct(state["t"].alias("text"), state["given"].alias("given"), *(read(name, kind).alias(name) for name, kind in FIELDS.items()))

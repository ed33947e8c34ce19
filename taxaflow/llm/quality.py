"""Quality rules: base measures of a text and cross-document line frequency, in DataFrame functions only.

Lines are normalised (words joined by one space, lower case) and hashed. For each host (source) the
distinct documents that hold a line are counted; lines above the host's limit are boilerplate and are
removed; a document of which too little remains is rejected. Equal texts count as one, and so do near
copies by their whole texts: a text of which COPY_SHARE of the words stand in lines above the limits is
held against one other of them, the least by hash that shares its least such line, and counts as this one
if their five-word windows have a Jaccard similarity of COPY_SIMILARITY. It is found by the SKETCH least
hashes of all windows of either text, exactly if both have no more windows together. Copies and near copies
of a document thus don't make its lines boilerplate, they are left to the dedup stages; documents that share
lines only are counted one by one, however much of them these lines are.

Null text counts as empty (no words: base_failed). A null source is a host of its own. Repeated rows get
equal results, ties are no case; an empty table gives none; extra columns are carried along or ignored, whatever
their names. Texts of any length are read whole: what is made of a text (lines, windows) is a few times its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Words in a window of the repetition rule.
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A line is boilerplate for a host if more than LINE_DOCS distinct documents hold it that are more than
#: LINE_SHARE of the host's, or if more than MANY_DOCS do, however large the host.
LINE_DOCS = 20
LINE_SHARE = 0.1
MANY_DOCS = 200
#: Texts with at least this share of words in lines above the limits, so that they may be depleted, may be near copies,
#: and are if they are so similar; hashes of windows that this is found by.
COPY_SHARE = 0.7
COPY_SIMILARITY = 0.8
SKETCH = 64
#: A document is depleted if fewer words, or a smaller share of them, remain without boilerplate.
KEEP_WORDS = 10
KEEP_SHARE = 0.3

#: Rows of rejected documents, or keys of texts, that may be broadcast; beyond that both sides of the join are shuffled.
BROADCAST_ROWS = 200_000

_RUN = f"{common.WS}+"


def _host() -> Column:
    """A document's host: its source, marked so that a null source differs from any other."""
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text as an array; splitting leaves an empty string at either end at most."""
    return F.filter(F.split(text, _RUN), lambda w: w != "")


def base_measures(df: DataFrame, text: str = "text", sketch: str | None = None) -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed, and on demand with a
    column for the least hashes, of 32 bits, of its distinct windows (of a text without one, the hash of all its words).

    Steps whose results are used more than once are columns of their own, so that each is computed once.
    """
    names = {k: common.fresh_name(df, f"__{k}") for k in ("t", "w", "l", "h", "s", "p")}
    t, w, l, h, s, p = (F.col(names[k]) for k in "twlhsp")
    has_word = F.lit(common.NOT_WS)
    # 64-bit hashes of the windows; two windows of one text that differ share one by chance only.
    hashes = F.when(F.size(w) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))))).otherwise(F.array().cast("array<bigint>"))
    repeats = F.size(F.array_distinct(h)) < F.size(h)
    # Windows with their places, equal ones side by side; then the places of those found twice or more.
    sorted_windows = F.when(repeats, F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    same = lambda a, b: F.coalesce(F.get(s, a)["h"] == F.get(s, b)["h"], F.lit(False))
    places = F.array_sort(F.transform(F.filter(s, lambda x, i: ((i > 0) & same(i - 1, i)) | same(i, i + 1)), lambda x: x["i"]))
    # Words covered: from each place to the next one, five at most.
    covered = F.aggregate(
        F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x
    )
    return (
        df.withColumn(names["t"], common.text_of(text))
        .withColumn(names["w"], words_of(t))
        .withColumn(names["l"], F.filter(F.split(t, "\n"), lambda x: F.regexp_like(x, has_word)))
        .withColumn(names["h"], hashes)
        .withColumn(names["s"], sorted_windows)
        .withColumn(names["p"], places)
        .select(
            *df.columns,
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.regexp_replace(t, _RUN, "")).cast("long").alias("word_chars"),
            F.char_length(F.regexp_replace(t, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            (F.size(l) - F.size(F.array_distinct(l))).cast("long").alias("n_dup_lines"),
            F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
            *([F.slice(F.sort_array(F.array_distinct(F.transform(F.when(F.size(h) > 0, h).otherwise(F.array(F.xxhash64(F.concat_ws(" ", w)))), lambda x: F.shiftright(x, 32).cast("int")))), 1, SKETCH).alias(sketch)] if sketch else []),
        )
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    )


def _normal(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, _RUN, " ")))


def line_key(line: Column) -> Column:
    """A normalised line as a number of 60 bits: the head of its MD5, in an order that SQL has too."""
    return F.conv(F.substring(F.md5(line), 1, 15), 16, 10).cast("long")


def line_table(df: DataFrame) -> DataFrame:
    """One row for each line with words: its document, host, place, hash and words, and the words of its text."""
    held = df.select(F.col("doc_id").cast("long").alias("doc_id"), _host().alias("host"), common.text_of().alias("text"))
    normal = F.transform(F.split("text", "\n"), _normal)
    summary = F.transform(
        F.filter(normal, lambda x: x != ""),
        lambda x: F.struct(line_key(x).alias("line"), (F.char_length(x) - F.char_length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("n")),
    )
    arrays = held.select("doc_id", "host", F.xxhash64("text").alias("text_key"), summary.alias("lines"))
    total = F.aggregate("lines", F.lit(0), lambda a, x: a + x["n"])
    whole = arrays.select("doc_id", "host", "text_key", total.alias("of_words"), F.transform("lines", lambda x, i: F.struct(i.alias("pos"), x["line"].alias("line"), x["n"].alias("n"))).alias("lines"))
    # The outer form, since Spark guards the plain one by a filter that computes the arrays again.
    return whole.select("doc_id", "host", "text_key", "of_words", F.inline_outer("lines")).where("line IS NOT NULL")


def boilerplate(sketches: DataFrame, lines: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, many_docs: int = MANY_DOCS) -> DataFrame:
    """host, line of each line above the limits. sketches has host, text_key, order and sketch of the texts that
    lines came from.

    Counts are combined before they are shuffled, so a frequent line is no hot key. A text is compared with
    one other at most; a group of near copies, however large, is as many comparisons as it has texts."""
    hosts = lines.groupBy("host", "text_key").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count(F.lit(1)).alias("of"))
    above = (F.col("docs") > line_docs) & ((F.col("docs") > line_share * F.col("of")) | (F.col("docs") > many_docs))
    # First by equal texts; near copies can only lower a count, so what is not frequent here never is.
    counted = lines.groupBy("host", "line", "text_key").agg(F.lit(1).alias("one")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") > line_docs)
    frequent = common.cut(counted.join(hosts, "host").where(above).select("host", "line", "of"), "frequent")
    texts = (
        lines.join(frequent, ["host", "line"])
        .groupBy("host", "text_key", "pos").agg(F.first("line").alias("line"), F.first("n").alias("n"), F.first("of_words").alias("of_words"), F.first("of").alias("of"))
        .groupBy("host", "text_key").agg(F.collect_set("line").alias("held"), (F.sum("n") >= COPY_SHARE * F.first("of_words")).alias("copy"), F.first("of").alias("of"))
    )
    texts = common.cut(texts, "texts")
    likely = common.cut(texts.where("copy").select("host", "text_key", F.array_min("held").alias("least")), "copies")
    if likely.count() <= BROADCAST_ROWS:  # a host and two longs each; beyond that the sketches are shuffled as well
        likely = F.broadcast(likely)
    seen = common.cut(sketches.join(likely, ["host", "text_key"]).groupBy("host", "text_key", "least").agg(F.first("order").alias("order"), F.first("sketch").alias("sketch")), "likely")
    lead = seen.groupBy("host", "least").agg(F.min(F.struct("order", "text_key", "sketch")).alias("lead"))
    both = F.slice(F.sort_array(F.array_union("sketch", "lead.sketch")), 1, SKETCH)
    alike = F.size(F.array_intersect(F.array_intersect(both, "sketch"), F.col("lead.sketch"))) >= COPY_SIMILARITY * F.size(both)
    folded = seen.join(lead, ["host", "least"]).where(alike & (F.col("lead.text_key") != F.col("text_key"))).select("host", "text_key", F.col("lead.text_key").alias("key"))
    keyed = texts.join(folded, ["host", "text_key"], "left").select("host", "of", F.coalesce("key", "text_key").alias("key"), F.explode("held").alias("line"))
    counts = keyed.groupBy("host", "line", "key").agg(F.first("of").alias("of")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("docs"), F.first("of").alias("of"))
    return counts.where(above).select("host", "line")


def _judged(df: DataFrame, line_docs: int, line_share: float, many_docs: int) -> DataFrame:
    """quality_rules with own_host and own_key, which tell rows of one doc_id apart."""
    lines = line_table(df)
    keyed = df.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"), _host().alias("own_host"), F.xxhash64(common.text_of()).alias("own_key"), line_key(common.text_of()).alias("order"))
    base = common.cut(base_measures(keyed, sketch="sketch").drop("text"), "measures")  # a few hundred bytes a document
    sketches = base.select(F.col("own_host").alias("host"), F.col("own_key").alias("text_key"), "order", "sketch")
    common_lines = common.cut(boilerplate(sketches, lines, line_docs, line_share, many_docs), "boilerplate")
    removed = (
        lines.join(common_lines, ["host", "line"])
        .groupBy("doc_id", "host", "text_key", "pos").agg(F.first("n").alias("n"))
        .groupBy(F.col("doc_id").alias("of_doc"), "host", "text_key").agg(F.sum("n").cast("long").alias("removed"))
    )
    on = F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("own_host") == F.col("host")) & (F.col("own_key") == F.col("text_key"))
    left = F.col("n_words") - F.coalesce(F.col("removed"), F.lit(0))
    depleted = (left < KEEP_WORDS) | (left < KEEP_SHARE * F.col("n_words"))
    return base.join(removed, on, "left").select(
        "doc_id", "own_host", "own_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", left.alias("n_kept_words"), (~F.col("base_failed") & ~depleted).alias("kept")
    )


def quality_rules(df: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, many_docs: int = MANY_DOCS) -> DataFrame:
    """doc_id, the base measures, base_failed, n_kept_words and kept for every row of df (doc_id, text, source)."""
    return _judged(df, line_docs, line_share, many_docs).drop("own_host", "own_key")


def quality_filter(df: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, many_docs: int = MANY_DOCS) -> DataFrame:
    """The rows of df that the rules keep, with all their columns and whole texts."""
    doc, host, key = (common.fresh_name(df, c) for c in ("of_doc", "of_host", "of_key"))
    judged = _judged(df, line_docs, line_share, many_docs)
    gone = common.cut(judged.where(~F.col("kept")).select(F.col("doc_id").alias(doc), F.col("own_host").alias(host), F.col("own_key").alias(key)).distinct(), "rejected")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (_host() == F.col(host)) & (F.xxhash64(common.text_of()) == F.col(key))
    return df.join(gone, same, "left_anti")


def without_boilerplate(df: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, many_docs: int = MANY_DOCS) -> DataFrame:
    """Every row of df, with all its columns, its text without the lines that are boilerplate for its host.

    The texts that hold such lines are taken apart, once for each host and text, and put together again."""
    lines = line_table(df)
    texts = df.select(_host().alias("host"), F.xxhash64(common.text_of()).alias("text_key"), line_key(common.text_of()).alias("order"), common.text_of().alias("text"))
    sketches = common.cut(base_measures(texts, sketch="sketch").select("host", "text_key", "order", "sketch"), "sketches")
    found = common.cut(boilerplate(sketches, lines, line_docs, line_share, many_docs), "boilerplate")
    touched = common.cut(lines.join(found, ["host", "line"], "left_semi").select("host", "text_key").distinct(), "touched")
    whole = df.select(_host().alias("host"), F.col("text")).withColumn("text_key", F.xxhash64("text"))
    once = whole.join(touched, ["host", "text_key"]).groupBy("host", "text_key").agg(F.first("text").alias("text"))
    cut = once.select("host", "text_key", F.posexplode(F.split("text", "\n")).alias("pos", "raw")).withColumn("line", line_key(_normal(F.col("raw"))))
    left = cut.join(found, ["host", "line"], "left_anti").groupBy("host", "text_key").agg(F.array_sort(F.collect_list(F.struct("pos", "raw"))).alias("left"))
    host, key, new = (common.fresh_name(df, c) for c in ("of_host", "of_key", "new_text"))
    cleaned = touched.join(left, ["host", "text_key"], "left").select(F.col("host").alias(host), F.col("text_key").alias(key), F.coalesce(F.array_join(F.transform("left", lambda x: x["raw"]), "\n"), F.lit("")).alias(new))
    same = (_host() == F.col(host)) & (F.xxhash64("text") == F.col(key)) & F.col("text").isNotNull()
    return df.join(cleaned, same, "left").select(*(F.coalesce(F.col(new), F.col("text")).alias(c) if c == "text" else F.col(c) for c in df.columns))

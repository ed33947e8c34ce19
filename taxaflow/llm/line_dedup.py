"""Line dedup by an exact set-similarity join, in DataFrame functions only.

Lines are compared as sets of words. A line is removed if an earlier line that stays has a Jaccard
similarity of at least the threshold with it; earlier means a smaller doc_id (null first), then a smaller
line number. So the first line of each kind stays, and what is removed has a stand-in that stays.

1. Words are hashed and ordered by rarity: a first hash picks one of a fixed number of buckets, whose rank
   by frequency goes before the bits of a second hash.
2. Prefix filter. Let two sets of n and m words have overlap s, a = n - s, b = m - s. In the first set's
   rarity order, a pair of neighbours is also a pair of neighbours in the other set unless one of the a
   words is in it or one of the b words falls between: at most 2a + b pairs are lost. With Jaccard t or
   more that is at most 2 (1 - t) n, so among the first floor(2 (1 - t) n) + 1 neighbour pairs one is
   shared, in either set's prefix. Lines that share no prefix pair are never compared. (Pairs in place of
   single words make the lists of the index short.)
3. Length filter: t n <= m <= n / t. Positional filter: from the places of a shared pair follows how large
   the overlap can be at most. Parity signatures, a wide one once few lines are left, bound the difference likewise.
4. The lists are worked off in rounds. A line that passes the filters with no earlier line left in its
   lists stays; the later lines that pass the filters with it are compared with it, and what is similar
   goes; both leave the lists. The earliest line left always stays, so the rounds end; lines that are alike
   in their thousands go in one round, without being compared with each other. From the second round on the
   lines bring their words to the lists, and fitting means being similar: lines of one large group that are
   almost, but not quite, alike would otherwise stay one a round.
5. What passes is verified by the overlap of the word sets (64-bit hashes of words).

Lines without words are left alone. Null text counts as empty. Rows that repeat a doc_id are told apart by
the order of their texts; equal ones are one document twice, of which the second's lines are copies of the
first's. Equal lines of one document count by line number. An empty table gives an empty result; extra
columns are carried along by `line_dedup` and ignored by `line_decisions`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

THRESHOLD = 0.8
#: Buckets of word frequencies: 2 to this power. Their ranks are the only thing that is sent to all tasks.
BUCKET_BITS = 16
#: Rows of 8 bytes that may be broadcast; beyond that both sides of a join are shuffled.
BROADCAST_ROWS = 1_000_000

# Arrays are exploded in the outer form, since Spark guards the plain one by a filter that computes them again.
_RUN = f"{common.WS}+"


def rarity_ranks(df: DataFrame, bits: int = BUCKET_BITS) -> list[int]:
    """The rank by frequency of each bucket of words, over all words of all texts; rare buckets first."""
    words = df.select(F.explode_outer(F.split(F.regexp_replace(common.text_of(), r"[\x09-\x0D]", " "), " ")).alias("w"))
    bucket = _bucket(F.col("w"), bits).alias("bucket")
    counts = {r["bucket"]: r["count"] for r in words.where("w <> ''").groupBy(bucket).count().collect()}  # 2 ** bits rows at most
    order = sorted(range(1 << bits), key=lambda b: (counts.get(b, 0), b))
    ranks = [0] * (1 << bits)
    for rank, b in enumerate(order):
        ranks[b] = rank - (1 << (bits - 1))  # the codes are signed, so the rarest come first
    return ranks


def _bucket(word: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.hash(word), 32 - bits)


def word_set(line: Column, ranks: list[int], bits: int = BUCKET_BITS) -> Column:
    """The line's distinct words as sorted longs: the rank of the word's bucket, then bits of another hash."""
    table = F.split(F.lit(" ".join(map(str, ranks))), " ").cast("array<bigint>")  # folded into one literal
    low = (1 << (64 - bits)) - 1

    def code(w: Column) -> Column:
        return F.shiftleft(F.get(table, _bucket(w, bits)), 64 - bits).bitwiseOR(F.xxhash64(w).bitwiseAND(F.lit(low)))

    # Splitting at one character is much faster than at a pattern.
    words = F.array_distinct(F.array_remove(F.split(F.regexp_replace(line, r"[\x09-\x0D]", " "), " "), ""))
    return F.sort_array(F.transform(words, code))


def _overlap(n: Column, m: Column, t: float) -> Column:
    """The least overlap at which sets of n and m words reach the threshold."""
    return F.ceil(t / (1 + t) * (n + m) - F.lit(1e-9))


def _lines(df: DataFrame) -> DataFrame:
    """doc, text key, place and text of every line with words."""
    keyed = df.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(common.text_of()).alias("key"), F.posexplode_outer(F.split(common.text_of(), "\n")).alias("at", "line"))
    return keyed.where(F.regexp_like("line", F.lit(common.NOT_WS)))


def _place() -> Column:
    """A line's place in the order of all lines; nulls come first."""
    return F.struct("doc", "key", "at")


#: A member of a list is packed into one long: its signature's bits, then its set's size and its pair's place with this limit.
SIGNATURE_BITS, PACKED_LIMIT = 44, 1023


def _parity(w: Column) -> Column:
    """For each bit of the signature, whether the number of words that fall to it is odd."""
    return F.aggregate(w, F.lit(0).cast("long"), lambda p, x: p.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(x, F.lit(SIGNATURE_BITS)).cast("int"))))


def _fits(a: dict[str, Column], b: dict[str, Column], t: float) -> Column:
    """Length, positional and signature filters for two members of one list, by their n, i and parity.

    A place at the limit may be a later one, so the positional filter lets it through."""
    n, m, i, j = a["n"], b["n"], a["i"], b["i"]
    need = _overlap(n, m, t)
    reach = F.least(i, j) + 2 + F.least(n - i - 2, m - j - 2)
    differ = F.bit_count(a["parity"][0].bitwiseXOR(b["parity"][0]))
    for x, y in zip(a["parity"][1:], b["parity"][1:], strict=True):
        differ = differ + F.bit_count(x.bitwiseXOR(y))
    return (F.least(n, m) >= t * F.greatest(n, m) - 1e-9) & ((F.greatest(i, j) >= PACKED_LIMIT) | (reach >= need)) & (differ <= n + m - 2 * need)


def _packed(n: Column, i: Column, parity: Column) -> Column:
    held = [F.least(c.cast("long"), F.lit(PACKED_LIMIT)) for c in (n, i)]
    return F.shiftleft(parity, 20).bitwiseOR(F.shiftleft(held[0], 10)).bitwiseOR(held[1])


def _unpacked(alias: str) -> dict[str, Column]:
    member = F.col(f"{alias}.member")
    low = F.lit(PACKED_LIMIT)
    return {"n": F.shiftrightunsigned(member, 10).bitwiseAND(low).cast("int"), "i": member.bitwiseAND(low).cast("int"), "parity": [F.shiftrightunsigned(member, 20)]}


def _index(texts: DataFrame, ranks: list[int], t: float) -> DataFrame:
    """list, node, i for each prefix pair of a line for which its list has a line that passes the
    filters with it. The semi-join stops at the first such line and emits no pairs. Sets too large for
    the packed size pass unseen; the filters meet them again with their true sizes."""
    sets = texts.select("node", word_set(F.col("line"), ranks).alias("w"))
    last = F.least(F.floor(2 * (1 - t) * F.size("w") + 1e-9).cast("int"), F.size("w") - 2)
    pairs = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1)))).otherwise(F.array(F.xxhash64(F.get("w", F.lit(0)))))
    flat = sets.select("node", F.size("w").alias("n"), _parity(F.col("w")).alias("parity"), pairs.alias("pairs")).select("node", "n", "parity", F.posexplode_outer("pairs").alias("i", "list"))
    packed = flat.select("list", _packed(F.col("n"), F.col("i"), F.col("parity")).alias("member"), "node")
    a, b = packed.alias("a"), packed.alias("b")
    x, y = _unpacked("a"), _unpacked("b")
    large = F.greatest(x["n"], y["n"]) >= PACKED_LIMIT
    found = a.join(b, (F.col("a.list") == F.col("b.list")) & (F.col("a.node") != F.col("b.node")) & (large | _fits(x, y, t)), "left_semi")
    return found.select("list", "node", x["i"].alias("i"))


def _small(df: DataFrame) -> DataFrame:
    """A written table of 8-byte rows, marked for broadcast if it is small by count."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _verified(pairs: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    """The pairs (a earlier, b later, by node) whose sets reach the threshold."""
    left = sets.select(F.col("node").alias("a"), F.col("w").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("w").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(left, "a").join(right, "b").where(both >= _overlap(F.size("x"), F.size("y"), t)).select("a", "b")


def _without(members: DataFrame, gone: DataFrame) -> DataFrame:
    return members.join(gone, "node", "left_anti")


#: Words of 64 bits in the signature that members of lists have.
_WIDE = [f"p{k}" for k in range(4)]


def _wide_parity(w: Column) -> list[Column]:
    """256 bits: of the words whose last eight bits say so, whether their number is odd."""

    def part(k: int) -> Column:
        bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))
        return F.aggregate(w, F.lit(0).cast("long"), lambda p, x: F.when(F.shiftright(x, 6).bitwiseAND(F.lit(3)) == k, p.bitwiseXOR(bit(x))).otherwise(p))

    return [part(k).alias(c) for k, c in enumerate(_WIDE)]


def _of(alias: str) -> dict[str, Column]:
    return {c: F.col(f"{alias}.{c}") for c in ("n", "i")} | {"parity": [F.col(f"{alias}.{c}") for c in _WIDE]}


def near_lines(texts: DataFrame, firsts: DataFrame, ranks: list[int], t: float = THRESHOLD) -> DataFrame:
    """hash of each line that goes because a similar earlier one stays.

    texts: node, hash, line, one row for each distinct line; firsts: hash, first (its place). Nodes are
    numbers in the order of the written texts, which shuffle files hold in less room than hashes. The
    table texts is deleted once its lines of interest are known."""
    spark = texts.sparkSession
    index = common.cut(_index(texts, ranks, t), "lists")
    common.release(spark)
    wanted = common.cut(index.select("node").distinct(), "wanted")
    sets = common.cut(texts.join(_small(wanted), "node", "left_semi").select("node", "hash", word_set(F.col("line"), ranks).alias("w")), "sets")
    common.discard(texts, wanted)
    # Numbered by their first places, so that one number tells lines apart and which is earlier.
    placed = firsts.join(sets, "hash").orderBy("first").select(F.monotonically_increasing_id().alias("number"), "node", "hash", "w", F.size("w").alias("n"), *_wide_parity(F.col("w")))
    known = common.cut(placed, "known")
    common.discard(sets)
    sets = known.select(F.col("number").alias("node"), "w")
    members = common.cut(index.join(known.select("number", "node", "n", *_WIDE), "node").select("list", F.col("number").alias("node"), "n", "i", *_WIDE), "members")
    common.discard(index)
    common.release(spark)
    goes, similar = [], F.lit(True)
    while True:
        # What fits no earlier line that is left stays; what is like a later one lets it go.
        a, b = members.alias("a"), members.alias("b")
        earlier = (F.col("a.list") == F.col("b.list")) & (F.col("b.node") < F.col("a.node")) & _fits(_of("a"), _of("b"), t) & similar
        doubtful = common.cut(a.join(b, earlier, "left_semi").select("node").distinct(), "doubtful")
        if doubtful.isEmpty():
            break
        common.release(spark)
        doubtful = _small(doubtful)
        later_ones = members.join(doubtful, "node", "left_semi")
        a, b = _without(members, doubtful).alias("a"), later_ones.alias("b")
        later = (F.col("a.list") == F.col("b.list")) & (F.col("a.node") < F.col("b.node")) & _fits(_of("a"), _of("b"), t) & similar
        if "w" in members.columns:
            out = common.cut(b.join(a, later, "left_semi").select("node").distinct(), "goes")
        else:
            pairs = common.cut(a.join(b, later).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct(), "pairs")
            out = common.cut(_verified(pairs, sets, t).select(F.col("b").alias("node")).distinct(), "goes")
            common.discard(pairs)
        goes.append(out)
        left = _without(later_ones, _small(out))
        if "w" not in members.columns:  # few are left, so from here on they bring their words
            left = left.join(sets, "node")
            similar = F.size(F.array_intersect("a.w", "b.w")) >= _overlap(F.col("a.n"), F.col("b.n"), t)
        left = common.cut(left, "members")
        common.discard(members, doubtful)
        members = left
        common.release(spark)
    common.discard(members)
    if not goes:
        return known.select("hash").limit(0)
    every = goes[0]
    for more in goes[1:]:
        every = every.union(more)
    return known.select(F.col("number").alias("node"), "hash").join(every.distinct(), "node", "left_semi").select("hash")


def line_decisions(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc, key (XXH64 of the text), at (line number from 0) and stays for each line with words of df
    (doc_id, text). The rows of repeated documents stand once for each."""
    if not 0.75 < threshold <= 1:
        raise ValueError("the prefix of neighbour pairs needs a threshold over 0.75")
    ranks = rarity_ranks(df)
    lines = _lines(df)
    every = common.cut(lines.select("doc", "key", "at", F.xxhash64("line").alias("hash")), "lines")
    firsts = common.cut(every.groupBy("hash").agg(F.min(_place()).alias("first")), "firsts")
    texts = common.cut(lines.select("line").distinct().select(F.monotonically_increasing_id().alias("node"), F.xxhash64("line").alias("hash"), "line"), "texts", "zstd")
    common.release(df.sparkSession)
    gone = common.cut(near_lines(texts, firsts, ranks, threshold).withColumn("near", F.lit(True)), "gone")
    known = common.cut(firsts.join(gone, "hash", "left"), "known")
    return every.join(known, "hash").select("doc", "key", "at", (F.col("near").isNull() & _place().eqNullSafe(F.col("first"))).alias("stays"))


def removed_lines(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc, key, removed (sorted line numbers), n_lines of each document with lines."""
    marked = line_decisions(df, threshold)
    return marked.groupBy("doc", "key").agg(F.sort_array(F.collect_set(F.when(~F.col("stays"), F.col("at")))).alias("removed"), F.count_distinct("at").alias("n_lines"))


def line_dedup(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """df with the later matches taken out of its text; rows, their order of lines and other columns stay,
    but for n_chars, which follows the text where df has it.

    A text that loses all its lines with words becomes what remains of it, at least the empty string."""
    gone = removed_lines(df, threshold).where(F.size("removed") > 0).select(F.col("doc").alias("__doc"), F.col("key").alias("__key"), F.col("removed").alias("__removed"))
    joined = df.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("__doc")) & (F.xxhash64(common.text_of()) == F.col("__key")), "left")
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("__removed", i)), "\n")
    out = joined.withColumn("text", F.when(F.col("__removed").isNull(), F.col("text")).otherwise(left))
    if "n_chars" in df.columns:
        out = out.withColumn("n_chars", F.when(F.col("__removed").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(df.schema["n_chars"].dataType))
    return out.select(*df.columns)


def line_report(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_lines (with words), n_removed, removed_lines (numbers from 0, joined by commas) for each row of df."""
    gone = removed_lines(df, threshold).withColumnRenamed("key", "__key")
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(common.text_of()).alias("key"))
    joined = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("key") == F.col("__key")), "left")
    return joined.select(
        "doc_id",
        F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join("removed", ","), F.lit("")).alias("removed_lines"),
    )

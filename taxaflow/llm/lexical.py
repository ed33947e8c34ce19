"""Ranked lexical search over a clustered index whose documents recursive graph bisection has reordered.

Building reads the documents where they lie, in blocks of bounded size, without a shuffle. Within a block
the documents are halved again and again; at each halving documents change sides in pairs while this lowers
the estimated bits of the gaps of all terms. What is left at the bottom are clusters of like documents. The
index has a row for each block and term: the places of the documents that hold it, their impacts (the
score's part that doesn't depend on the query's weights) and the greatest impact in each cluster; one further
row a block maps places back to doc_id.

A search reads the rows of the queries' terms. For each query the clusters are visited by falling bound, the
sum of weights times greatest impacts. It stops for good at the first cluster whose bound is below the tenth
best score so far: a bound equal to it may still hide an equal score with a smaller doc_id. The first blocks
give every query a tenth best score to begin with in all others.

Null or termless texts are in no result. Equal scores go by doc_id, null ones last; repeated rows are rows of
their own. Repeated item rows give their results once each. No documents or no items give no rows. Extra columns
are ignored. Documents of any length are indexed whole.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

TOP = 10
#: A block ends with the document that reaches either bound; a cluster has at most so many documents.
BLOCK_DOCS, BLOCK_BYTES, CLUSTER_DOCS = 4096, 8 << 20, 64
#: Passes over the documents of one halving.
PASSES = 5
#: Items that are searched for at once; their terms are broadcast.
ITEMS = 1000
#: Blocks that give the scores to begin with.
SEED_BLOCKS = 8
#: Rows of a record batch of the index.
BATCH_ROWS = 20_000

#: Each byte as it stands in a term, space for those that part terms.
_LETTERS = bytes(b if b >= 0x80 or bytes((b,)).isalnum() else 0x20 for b in range(256)).lower()


def terms_of(text: str) -> list[bytes]:
    """The terms of a text in UTF-8; bytes are lower-cased in ASCII alone."""
    return text.encode("utf-8", "replace").translate(_LETTERS).split()


def corpus_size(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """N and L: the documents with a term, and all their terms."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0
        for part in parts:
            for whole in part.column(0).to_pylist():
                found = len(terms_of(whole or ""))
                n, total = n + (found > 0), total + found
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total])], names=["n", "l"])

    row = docs.select(text).mapInArrow(count, "n long, l long").agg(F.sum("n").alias("n"), F.sum("l").alias("l")).first()
    return row.n or 0, row.l or 0


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """What a term that occurs tf times in a document of n terms adds to a score, per unit of weight."""
    m = 10 + 90 * n * docs // total
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def bisect(doc: np.ndarray, term: np.ndarray, docs: int, least: int = CLUSTER_DOCS, passes: int = PASSES) -> np.ndarray:
    """The cluster of each document, in the order of the recursion, from the edges (doc, term).

    All halvings of a level are made at once. Terms that one document of a part alone holds can't tell
    its halves apart and are left out there."""
    node = np.zeros(docs, np.int64)
    place = np.arange(docs)
    log = np.concatenate([[0.0], np.log2(np.arange(1, docs + 3))])
    for _ in range(max(0, math.ceil(math.log2(max(1, docs) / least)))):
        order = np.lexsort((place, node))
        size = np.bincount(node)
        start = np.cumsum(size) - size
        rank = np.empty(docs, np.int64)
        rank[order] = np.arange(docs) - start[node[order]]
        left = (size + 1) // 2
        side = (rank >= left[node]).astype(np.int64)
        pair, edge = np.unique(node[doc] * (int(term.max()) + 1 if len(term) else 1) + term, return_inverse=True)
        shared = np.bincount(edge, minlength=len(pair)) > 1
        doc, term, edge = doc[shared[edge]], term[shared[edge]], (np.cumsum(shared) - 1)[edge[shared[edge]]]
        of = np.zeros(int(shared.sum()), np.int64)
        of[edge] = node[doc]
        held = np.bincount(edge, minlength=len(of))
        a, b = log[left[of]], log[np.maximum(1, size[of] - left[of])]
        bits = lambda x, n: x * (n - log[x + 1])
        for _ in range(passes):
            right = np.bincount(edge, weights=side[doc], minlength=len(of)).astype(np.int64)
            stay = held - right
            now = bits(stay, a) + bits(right, b)
            out = now - bits(np.maximum(stay - 1, 0), a) - bits(right + 1, b)
            back = now - bits(stay + 1, a) - bits(np.maximum(right - 1, 0), b)
            gain = np.bincount(doc, weights=np.where(side[doc] == 0, out[edge], back[edge]), minlength=docs)
            # The k-th best of either half change sides while both together gain.
            best = np.lexsort((place, -gain, side, node))
            lefts, rights = best[side[best] == 0], best[side[best] == 1]
            first = np.cumsum(left) - left
            partner = first[node[rights]] + np.arange(len(rights)) - (np.cumsum(size - left) - (size - left))[node[rights]]
            lefts = lefts[partner]
            swap = gain[lefts] + gain[rights] > 1e-9
            if not swap.any():
                break
            side[lefts[swap]], side[rights[swap]] = 1, 0
        node = 2 * node + side
    return np.unique(node, return_inverse=True)[1]


def _block(block: int, ids: list[int | None], counts: list[Counter], docs: int, total: int) -> Iterator[pa.RecordBatch]:
    """The rows of one block of the index."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    edges = [list(map(number.__getitem__, c)) for c in counts]
    sizes = np.array([len(e) for e in edges])
    doc = np.repeat(np.arange(len(ids)), sizes)
    term = np.array([t for e in edges for t in e], np.int64)
    tf = np.array([n for c in counts for n in c.values()], np.int64)
    words = sorted(number)
    at = np.empty(len(words), np.int64)
    at[[number[w] for w in words]] = np.arange(len(words))
    term = at[term]
    cluster = bisect(doc, term, len(ids))
    order = np.argsort(cluster, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    impact = impacts(tf, np.array([sum(c.values()) for c in counts], np.int64)[doc], docs, total)
    by = np.lexsort((place[doc], term))
    term, spot, impact, cluster = term[by], place[doc][by].astype("<i4"), impact[by].astype("<i4"), cluster[doc][by]
    rows = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1], [True]]))
    parts = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (cluster[1:] != cluster[:-1])]))
    tops = np.maximum.reduceat(impact, parts).astype("<i4")
    spans = np.stack([cluster[parts], parts - rows[:-1][term[parts]], tops], 1).astype("<i4")
    heads = np.searchsorted(parts, rows)

    def cells(data: np.ndarray, ends: np.ndarray, width: int) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((width * (ends - ends[0])).astype("<i4").tobytes()), pa.py_buffer(data[ends[0] : ends[-1]].tobytes())])

    schema = pa.schema([("block", pa.int64()), ("term", pa.string()), ("df", pa.int64()), ("places", pa.binary()), ("impacts", pa.binary()), ("clusters", pa.binary()), ("ids", pa.list_(pa.int64()))])
    yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([None], pa.string()), pa.array([0]), *(pa.array([b""], pa.binary()) for _ in range(3)), pa.array([[ids[k] for k in order]], pa.list_(pa.int64()))], schema=schema)
    for k in range(0, len(words), BATCH_ROWS):
        ends, n = rows[k : k + BATCH_ROWS + 1], len(words[k : k + BATCH_ROWS])
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(n, block)), pa.array([w.decode() for w in words[k : k + BATCH_ROWS]], pa.string()), pa.array(np.diff(ends)), cells(spot, ends, 4), cells(impact, ends, 4), cells(spans, heads[k : k + n + 1], 12),
            pa.nulls(n, pa.list_(pa.int64())),
        ], schema=schema)


def build_index(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Write the index of docs (doc_id, text) below path and read it back."""
    count, total = corpus_size(docs, text)

    def blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts, size, made = [], [], 0, TaskContext.get().partitionId() << 32
        for part in parts:
            for doc_id, whole in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                held = Counter(terms_of(whole or ""))
                if not held:
                    continue
                ids.append(doc_id)
                counts.append(held)
                size += len(whole)
                if len(ids) >= BLOCK_DOCS or size >= BLOCK_BYTES:
                    yield from _block(made, ids, counts, count, total)
                    ids, counts, size, made = [], [], 0, made + 1
        if ids:
            yield from _block(made, ids, counts, count, total)

    schema = "block long, term string, df long, places binary, impacts binary, clusters binary, ids array<long>"
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    held.mapInArrow(blocks, schema).write.parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def _search_block(rows: pa.Table, queries: list[tuple[int, dict[str, int]]], begin: dict[int, int]) -> list[tuple[int, int, int | None, int]]:
    """(item, place, doc_id, score) of the best documents of one block for each query, none that begin rules out."""
    terms = rows.column("term").to_pylist()
    if None not in terms:
        return []
    ids = rows.column("ids")[terms.index(None)].as_py()
    by_id = np.array([(1 << 63) - 1 if i is None else i for i in ids], np.int64)
    columns = [rows.column(c).to_pylist() for c in ("places", "impacts", "clusters")]
    held = {t: (np.frombuffer(p, "<i4"), np.frombuffer(q, "<i4").astype(np.int64), np.frombuffer(c, "<i4").reshape(-1, 3).astype(np.int64)) for t, p, q, c in zip(terms, *columns, strict=True) if t is not None}
    clusters = 1 + max((int(c[:, 0].max()) for _, _, c in held.values()), default=0)
    found = []
    for item, weights in queries:
        own = [(w, *held[t]) for t, w in weights.items() if w and t in held]
        if not own:
            continue
        bound = np.zeros(clusters, np.int64)
        spans = np.zeros((len(own), clusters, 2), np.int64)  # where a cluster begins and ends in each list
        for k, (w, places, _, c) in enumerate(own):
            bound[c[:, 0]] += w * c[:, 2]
            spans[k, c[:, 0], 0] = c[:, 1]
            spans[k, c[:, 0], 1] = np.append(c[1:, 1], len(places))
        score = np.zeros(len(ids), np.int64)
        best, least = np.zeros(0, np.int64), max(1, begin.get(item, 1))
        for c in np.argsort(-bound, kind="stable"):
            if bound[c] < least:
                break
            touched = []
            for k, (w, places, impact, _) in enumerate(own):
                a, b = spans[k, c]
                if a < b:
                    score[places[a:b]] += w * impact[a:b]
                    touched.append(places[a:b])
            new = np.unique(np.concatenate(touched))
            best = np.concatenate([best, new[score[new] >= least]])
            best = best[np.lexsort((best, by_id[best], -score[best]))[:TOP]]
            if len(best) == TOP:
                least = max(least, int(score[best[-1]]))
        found += [(item, int(p), ids[p], int(score[p])) for p in best]
    return found


def search(index: DataFrame, items: DataFrame, docs: int) -> DataFrame:
    """item_id, rank, doc_id and score of the best documents for each row of items (item_id, text).

    docs is the corpus's N. Items are dealt into sets of about ITEMS, so what is broadcast has a bound."""
    spark = index.sparkSession
    sets = -(-items.count() // ITEMS)
    schema = "item_id long, rank int, doc_id long, score long"
    dealt = items.select(F.col("item_id").cast("long").alias("item_id"), "text", F.monotonically_increasing_id().alias("row"))
    dealt = common.cut(dealt.withColumn("set", F.pmod(F.xxhash64("row"), F.lit(max(1, sets)))), "items")
    found = [_search_set(index, dealt.where(F.col("set") == k), docs) for k in range(sets)]
    out = spark.createDataFrame([], schema)
    for part in found:
        out = out.unionByName(part)
    return out


def _search_set(index: DataFrame, items: DataFrame, docs: int) -> DataFrame:
    spark = index.sparkSession
    rows = items.select("item_id", "text").collect()  # about ITEMS rows
    wanted = [(k, r.item_id, {t.decode() for t in terms_of(r.text or "")}) for k, r in enumerate(sorted(rows, key=lambda r: (r.item_id is None, r.item_id or 0)))]
    terms = sorted({t for _, _, own in wanted for t in own})
    if not terms:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    listed = F.broadcast(spark.createDataFrame([(t,) for t in terms], "term string"))  # the terms of about ITEMS items
    held = index.where("term IS NOT NULL").join(listed, "term", "left_semi")
    df = {r.term: r.df for r in held.groupBy("term").agg(F.sum("df").alias("df")).collect()}
    weight = {t: math.floor(1000 * math.log((2 * docs + 2) / (2 * n + 1))) for t, n in df.items()}
    queries = [(k, {t: weight[t] for t in sorted(own) if t in weight}) for k, _, own in wanted]
    lists = common.cut(held.unionByName(index.where("term IS NULL")), "lists")
    form = "item long, block long, place long, doc_id long, score long"

    def best(chosen: DataFrame, begin: dict[int, int]) -> DataFrame:
        def block(key: tuple, rows: pa.Table) -> pa.Table:
            found = _search_block(rows, queries, begin)
            columns = [[f[0] for f in found], [key[0].as_py()] * len(found), *([f[i] for f in found] for i in (1, 2, 3))]
            return pa.table([pa.array(c, pa.int64()) for c in columns], names=["item", "block", "place", "doc_id", "score"])

        return chosen.groupBy("block").applyInArrow(block, form)

    def ranked(df: DataFrame) -> DataFrame:
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "block", "place")
        return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)

    first = [r.block for r in lists.where("term IS NULL").select("block").orderBy("block").limit(SEED_BLOCKS).collect()]
    seeds = common.cut(ranked(best(lists.where(F.col("block").isin(first)), {})).select("item", "block", "place", "doc_id", "score", "rank"), "seeds")
    begin = {r.item: r.score for r in seeds.where(F.col("rank") == TOP).collect()}
    rest = best(lists.where(~F.col("block").isin(first)), begin)
    names = F.broadcast(spark.createDataFrame([(k, i) for k, i, _ in wanted], "item long, item_id long"))  # about ITEMS rows
    return ranked(seeds.drop("rank").unionByName(rest)).join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The TOP best rows of docs (doc_id, text) for each row of items (item_id, text)."""
    index = build_index(docs, common.shared_path(docs.sparkSession, "index"))
    return search(index, items, index.where("term IS NULL").agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("n")).first().n)

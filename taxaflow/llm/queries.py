"""The registered queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common, piece_bpe, warc
from .exact_dedup import exact_dedup
from .html_extract import extract
from .lexical import ranked_search
from .line_dedup import line_report
from .packing import pack_documents
from .quality import quality_rules
from .sharding import SHARDS, key_shard, size_of, write_shards
from .simhash import simhash_components
from .token_counts import token_counts
from .vector_codes import vector_codes


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(common.table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(common.table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(common.table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = write_shards(docs, common.shared_path(spark, "shards"))
    return rows.select(
        "doc_id",
        size_of(F.col("text")).alias("size"),
        F.crc32(F.encode(common.text_of(), "utf-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        key_shard(F.col("doc_id"), SHARDS + 1).alias("grown_shard"),
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    root = warc.write_archive(pages, common.shared_path(spark, "warc"), min_bytes=0)
    return warc.read_captures(warc.keys_of(pages), root)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op11_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.round_trip(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(common.table(spark, sf_dir, "embeddings"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_html_extraction": op2_html_extraction,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_byte_bpe": op4_byte_bpe,
        "op5_quality_rules": op5_quality_rules,
        "op6_sharding": op6_sharding,
        "op7_packing": op7_packing,
        "op8_simhash": op8_simhash,
        "op9_warc": op9_warc,
        "op10_token_counts": op10_token_counts,
        "op11_piece_bpe": op11_piece_bpe,
        "op12_vector_codes": op12_vector_codes,
        "op13_lexical_search": op13_lexical_search,
    }


def _vector_codes_sql() -> str:
    """Product quantization in SQL: one pair of steps (assign, move) a round."""
    near = "SELECT x.vec_id, x.p, first(c.e ORDER BY list_sum(list_transform(list_zip(x.a, c.a), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c.e) AS e, min(list_sum(list_transform(list_zip(x.a, c.a), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS far FROM x JOIN c{k} c USING (p) GROUP BY x.vec_id, x.p"
    steps = []
    for k in range(6):
        steps.append(f"n{k} AS MATERIALIZED ({near.format(k=k)})")
        steps.append(
            f"""c{k + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.a, c.a) AS a FROM c{k} c LEFT JOIN (
                    SELECT p, e, list(s ORDER BY d) AS a FROM (SELECT n.p, n.e, d, CAST(floor(CAST(sum(x.a[d]) AS DOUBLE) / count(*)) AS BIGINT) AS s FROM n{k} n JOIN x USING (vec_id, p), (SELECT unnest(range(1, 9)) AS d) GROUP BY ALL) GROUP BY p, e) m USING (p, e))"""
        )
    return f"""
            WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(4096 * CAST(c AS DOUBLE)) AS BIGINT)) AS a FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
                 x AS MATERIALIZED (SELECT vec_id, p, a[1 + p * len(a) // 8 : (p + 1) * len(a) // 8] AS a FROM v, (SELECT unnest(range(8)) AS p)),
                 c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, a FROM x QUALIFY e < 16),
                 {", ".join(steps)},
                 n6 AS MATERIALIZED ({near.format(k=6)}),
                 sha AS (SELECT sha256(string_agg(array_to_string(a, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c6),
                 found AS (SELECT vec_id, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(far) AS BIGINT) AS error FROM n6 GROUP BY vec_id)
            SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM found JOIN v USING (vec_id), sha"""


def oracle_sql() -> dict[str, str]:
    return {
        "op12_vector_codes": _vector_codes_sql(),
        "op13_lexical_search": r"""
            WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
                 d AS (SELECT doc_id, w, len(w) AS n FROM t WHERE len(w) > 0),
                 c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM d),
                 q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark),
                 u AS (SELECT doc_id, n, unnest(w) AS term FROM d),
                 p AS (SELECT doc_id, n, term, count(*) AS tf FROM u SEMI JOIN q USING (term) GROUP BY ALL),
                 f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
                 s AS (SELECT item_id, doc_id, CAST(sum(CAST(floor(1000 * ln((2 * c.docs + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * c.docs) // c.total)))) AS BIGINT) AS score
                       FROM q JOIN p USING (term) JOIN f USING (term), c GROUP BY ALL)
            SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10""",
        "op5_quality_rules": r"""
            WITH d AS (SELECT doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS t FROM documents),
                 w AS (SELECT doc_id, host, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
                              list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
                 win AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w),
                 rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i : i + 4], ' ')) AS c FROM win),
                 cov AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM (SELECT doc_id, i, unnest(range(5)) AS k FROM rep WHERE c > 1) GROUP BY doc_id),
                 base AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
                                 len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN cov USING (doc_id)),
                 nl AS (SELECT host, t, w, list_filter(list_transform(string_split(t, chr(10)), lambda x: lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g')))), lambda x: x <> '') AS l FROM (SELECT DISTINCT host, t, w FROM w)),
                 lines AS MATERIALIZED (SELECT host, t, l AS line, len(string_split(l, ' ')) AS n FROM (SELECT host, t, unnest(l) AS l FROM nl)),
                 hosts AS (SELECT host, count(DISTINCT t) AS n FROM lines GROUP BY host),
                 frequent AS MATERIALIZED (SELECT host, line, hosts.n AS o FROM (SELECT host, line, count(DISTINCT t) AS docs FROM lines GROUP BY ALL) JOIN hosts USING (host) WHERE docs > 20 AND (docs > 0.1 * hosts.n OR docs > 200)),
                 likely AS (SELECT host, t, min(substr(md5(line), 1, 15)) AS least FROM lines JOIN frequent USING (host, line) GROUP BY host, t
                            HAVING sum(lines.n) >= 0.7 * (SELECT sum(x.n) FROM lines x WHERE x.host = lines.host AND x.t = lines.t)),
                 seen AS MATERIALIZED (SELECT host, t, least, substr(md5(t), 1, 15) AS o, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) ELSE [array_to_string(w, ' ')] END AS s FROM likely JOIN nl USING (host, t)),
                 lead AS (SELECT host, least, first(t ORDER BY o) AS t1, first(s ORDER BY o) AS s1 FROM seen GROUP BY ALL),
                 folded AS (SELECT host, t, t1 FROM (SELECT *, len(list_intersect(s, s1)) AS k FROM seen JOIN lead USING (host, least)) WHERE k >= 0.8 * (len(s) + len(s1) - k)),
                 bad AS (SELECT host, line FROM (SELECT DISTINCT host, line, o, coalesce(t1, t) AS t FROM lines JOIN frequent USING (host, line) LEFT JOIN folded USING (host, t)) GROUP BY host, line, o HAVING count(*) > 20 AND (count(*) > 0.1 * o OR count(*) > 200)),
                 removed AS (SELECT doc_id, CAST(sum(r) AS BIGINT) AS r FROM d JOIN (SELECT host, t, sum(n) AS r FROM lines SEMI JOIN bad USING (host, line) GROUP BY ALL) USING (host, t) GROUP BY doc_id)
            SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
                   n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_words - coalesce(r, 0) AS n_kept_words,
                   NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (n_words - coalesce(r, 0) < 10 OR n_words - coalesce(r, 0) < 0.3 * n_words) AS kept
            FROM base LEFT JOIN removed USING (doc_id)""",
        "op9_warc": r"""
            WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages),
                 d AS (SELECT page_id, last, octet_length(b) AS n, unhex(sha1(b)) AS h FROM p),
                 bits AS (SELECT page_id, last, n, CAST(h AS BIT)::VARCHAR AS s FROM d)
            SELECT page_id, n AS payload_bytes,
                   array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(CAST(substr(s, CAST(5 * i + 1 AS BIGINT), 5) AS BIT) AS INTEGER), 1)), '') AS payload_digest,
                   CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
                   CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
            FROM bits""",
        "op3_exact_dedup": r"""
            WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
                 g AS (SELECT norm, first(doc_id ORDER BY n DESC, doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
            SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256 FROM n JOIN g USING (norm)""",
    }

"""One query per operator over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripline.llm.text import prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = lambda spark, d: fn(prepare(spark), d)
        if sql:
            SQL[name] = sql
        return fn

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


def part(modulus: int, rest: int) -> str:
    """SQL condition: crc32 of the id's text leaves ``rest``."""
    return f"crc32(cast(cast(doc_id as string) as binary)) % {modulus} = {rest}"


@query("op3_quality_classifier")
def op3(spark: SparkSession, d: str) -> DataFrame:
    from tripline.llm.quality_classifier import quality_scores, train

    docs = read(spark, d, "documents")
    model = train(docs, read(spark, d, "labels"), f"not {part(4, 2)}")
    return quality_scores(docs, model, part(4, 2))


@query("op7_language_id")
def op7(spark: SparkSession, d: str) -> DataFrame:
    from tripline.llm.language_id import language_id, train

    docs = read(spark, d, "documents")
    return language_id(docs, train(docs.where(f"not {part(5, 0)}").select("text", "lang")), part(5, 0))


@query("op9_quality_rules")
def op9(spark: SparkSession, d: str) -> DataFrame:
    from tripline.llm.quality_rules import quality_rules, train

    docs = read(spark, d, "documents")
    return quality_rules(docs, train(docs, read(spark, d, "labels")))


@query("op5_token_output")
def op5(spark: SparkSession, d: str) -> DataFrame:
    from tripline.llm.token_output import decoded, ids_crc32, with_starts, write_tokens

    written = write_tokens(read(spark, d, "documents"))
    return with_starts(ids_crc32(decoded(written)), written)


@query("op10_packing")
def op10(spark: SparkSession, d: str) -> DataFrame:
    from tripline.llm.packing import pack

    return pack(read(spark, d, "documents"))[1]


@query("op2_suffix_dedup")
def op2(spark: SparkSession, d: str) -> DataFrame:
    from tripline.llm.suffix_dedup import suffix_dedup

    return (suffix_dedup(read(spark, d, "documents"))
            .select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("span_start").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")))


@query("op8_near_dedup")
def op8(spark: SparkSession, d: str) -> DataFrame:
    from tripline.llm.near_dedup import near_duplicates

    return near_duplicates(read(spark, d, "documents"))


@query("op1_ann")
def op1(spark: SparkSession, d: str) -> DataFrame:
    from tripline.llm.ann import nearest

    return nearest(read(spark, d, "embeddings"), "id % 20 = 0")


# bare upper-case base32 has no function in SQL: 5 bits of the digest's bit string per letter
_WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     d AS (SELECT page_id, strlen(h) AS payload_bytes, unhex(sha1(h))::BLOB::BIT::VARCHAR AS bits, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[list_sum(list_transform(range(5), lambda k: (bits[i * 5 + k + 1] = '1')::INT * (16 >> k)::INT))::INT + 1]), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM d
"""


@query("op6_warc", _WARC_SQL)
def op6(spark: SparkSession, d: str) -> DataFrame:
    from tripline.llm.warc import read_archives, write_archives
    from tripline.session import scratch

    folder = scratch(spark)
    folder = folder if "://" in folder else f"file://{folder.removeprefix('file:')}"
    return read_archives(write_archives(read(spark, d, "pages"), folder)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op4_sentencepiece")
def op4(spark: SparkSession, d: str) -> DataFrame:
    """Every text is sampled and decoded again."""
    from tripline.llm.sampling import decode, encode
    from tripline.llm.token_output import checksum

    ids = decode(encode(read(spark, d, "documents")))
    return checksum(ids, "ids", "ids_crc32").select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"))


_JACCARD_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
     g AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(len(w) - 2), lambda i: array_to_string(w[i + 1 : i + 3], ' ')) END) AS s FROM d),
     n AS (SELECT doc_id, len(s) AS n FROM g),
     u AS (SELECT doc_id, unnest(s) AS x FROM g),
     inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
     link AS (SELECT a, b FROM inter JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
     both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
     reach(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id FROM n JOIN reach r ON r.a = n.doc_id GROUP BY n.doc_id, n.n
"""


@query("op11_jaccard_join", _JACCARD_SQL)
def op11(spark: SparkSession, d: str) -> DataFrame:
    from tripline.llm.jaccard_join import jaccard_components

    return jaccard_components(read(spark, d, "documents"))


# the low two bits of CRC-32, byte by byte and bit by bit, decide how many opening turns are shared
_TRIE_SQL = r"""
WITH RECURSIVE src AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
     turns AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS pos, role, text FROM src),
     convs AS (SELECT c, c - c % 20 AS donor,
                      xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
                                      lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)), 4294967295::BIGINT) % 4 AS h
               FROM (SELECT DISTINCT c FROM src)),
     taken AS (SELECT v.c, t.pos, t.role, t.text FROM convs v JOIN turns t ON t.c = v.donor AND t.pos <= v.h),
     k AS (SELECT v.c, v.h, count(t.pos) AS k FROM convs v LEFT JOIN taken t ON t.c = v.c GROUP BY v.c, v.h),
     rebuilt AS (SELECT c, pos, role, text FROM taken UNION ALL SELECT t.c, t.pos - k.h + k.k, t.role, t.text FROM turns t JOIN k ON k.c = t.c WHERE t.pos > k.h),
     chain AS (SELECT c, pos AS depth, list({'r': role, 't': text}) OVER (PARTITION BY c ORDER BY pos) AS path, text FROM rebuilt),
     member AS (SELECT c, depth, path, text FROM chain UNION ALL SELECT c, 0, [], '' FROM convs),
     named AS (SELECT c, depth, min(c) OVER (PARTITION BY depth, path) AS node, length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM member),
     node AS (SELECT node, depth, count(*) AS n_convs, max(words) AS words FROM named GROUP BY node, depth),
     linked AS (SELECT n.*, p.node AS parent FROM node n LEFT JOIN named p ON p.c = n.node AND p.depth = n.depth - 1),
     kids AS (SELECT n.node, n.depth, n.parent, n.n_convs, n.words, count(k.node) AS n_children FROM linked n LEFT JOIN linked k ON k.parent = n.node AND k.depth = n.depth + 1 GROUP BY ALL),
     total AS (SELECT a.node, a.depth, sum((k.n_children = 0)::BIGINT) AS n_leaves, sum((k.n_convs - 1) * k.words) AS saved_tokens
               FROM kids k JOIN named a ON a.c = k.node AND a.depth <= k.depth GROUP BY a.node, a.depth),
     tail AS (SELECT c, max(depth) AS depth FROM member GROUP BY c),
     ends AS (SELECT n.node, n.depth, string_agg(t.c::VARCHAR, ',' ORDER BY t.c) AS ids FROM tail t JOIN named n USING (c, depth) GROUP BY n.node, n.depth)
SELECT k.node AS conv_id, k.depth::BIGINT AS depth, k.parent AS parent_conv_id, k.n_convs, k.n_children, t.n_leaves::BIGINT AS n_leaves, t.saved_tokens::BIGINT AS saved_tokens,
       sha256(coalesce(e.ids, '')) AS ends_sha256
FROM kids k JOIN total t USING (node, depth) LEFT JOIN ends e USING (node, depth)
"""


@query("op12_prefix_trie", _TRIE_SQL)
def op12(spark: SparkSession, d: str) -> DataFrame:
    from tripline.llm.prefix_trie import rebuilt_trie

    return rebuilt_trie(read(spark, d, "conversations"))


_NEGATIVES_SQL = """
WITH v AS (SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS same, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 100 = 0),
     p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b)::INT AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY rank <= 10
"""


@query("op13_hard_negatives", _NEGATIVES_SQL)
def op13(spark: SparkSession, d: str) -> DataFrame:
    from tripline.llm.hard_negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector")), "id % 100 = 0")

"""Each operator as a query over the line item table, and the same in ANSI SQL.

The index is part -> orders, every posting of the table; the query batch is
every order with all its distinct parts. Results are exact and unordered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlane.operators import codec as C
from postlane.operators import intersect as I
from postlane.operators import postings as P
from postlane.sources import formats, places


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.postings_from(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_partkey", "l_orderkey")


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.queries_from(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_orderkey", "l_partkey")


def _on_index(f: Callable[[DataFrame], DataFrame]) -> Callable:
    return lambda spark, d: f(index(spark, d))


def _on_both(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable:
    return lambda spark, d: f(index(spark, d), batch(spark, d))


def _on_compressed(postings: DataFrame, queries: DataFrame) -> DataFrame:
    """Only the queried lists are decoded, once, then intersected."""
    lists = C.compress(postings).join(queries.select("term_id").distinct(), "term_id", "left_semi")
    return I.and_division(places.saved(C.decode(lists)), queries, sift=True)


def _stream_words(postings: DataFrame) -> DataFrame:
    return C.pack_stream(postings)


def _stream_decode(postings: DataFrame) -> DataFrame:
    offsets = C.stream_offsets(C.headers(postings))
    return C.decode(C.unpack_stream(C.pack_stream(postings), offsets))


def _all_lists(postings: DataFrame) -> DataFrame:
    """Nested lists of every term from 0 to the largest, empty ones too, as an index file holds them."""
    top = postings.agg(F.max("term_id")).first()[0]
    terms = postings.sparkSession.range(0 if top is None else top + 1).withColumnRenamed("id", "term_id")
    lists = terms.join(P.nested_lists(postings), "term_id", "left")
    return lists.select("term_id", F.coalesce("doc_ids", F.array().cast("array<bigint>")).alias("doc_ids"))


def _index_file(postings: DataFrame) -> DataFrame:
    """The index written as index files and scanned again; the files' lists count on."""
    path = places.folder(postings.sparkSession)
    formats.write_index(_all_lists(postings), path)
    lists = formats.numbered(formats.read_index(postings.sparkSession, path), "term_id", "term_id")
    return lists.select("term_id", F.explode("doc_ids").alias("doc_id"))


def _query_file(queries: DataFrame) -> DataFrame:
    """The batch written as a query file and scanned again."""
    path = places.folder(queries.sparkSession)
    formats.write_queries(queries, path)
    return formats.read_queries(queries.sparkSession, path)


def _word_file(postings: DataFrame) -> DataFrame:
    """The stream of all lists written as word files and read again."""
    path = places.folder(postings.sparkSession)
    formats.write_words(C.pack_stream(postings), path)
    return formats.numbered(formats.read_words(postings.sparkSession, path), "pos", "k").select("k", "word")


def _decompress_file(postings: DataFrame) -> DataFrame:
    """All lists in one word file; from the file alone: headers, offsets, lists."""
    spark, path = postings.sparkSession, places.folder(postings.sparkSession)
    lists = _all_lists(postings)
    formats.write_words(C.pack_stream(postings, lists.select("term_id")), path, files=1)
    words = formats.read_words(spark, path).select(F.col("pos").alias("k"), "word")
    return C.decode(C.unpack_stream(words, formats.stream_offsets(spark, path)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "postings_scan": _on_index(lambda p: p),
    "flatten_lists": _on_index(lambda p: P.flatten_lists(P.nested_lists(p))),
    "term_lookup": _on_both(P.term_lookup),
    "active_terms": _on_both(lambda p, q: P.active_terms(q)),
    "index_stats": _on_index(P.index_stats),
    "list_lengths": _on_index(P.list_lengths),
    "query_term_order": _on_both(P.query_term_order),
    "bucket_directory": _on_index(P.bucket_directory),
    "lower_bound": _on_both(lambda p, q: P.lower_bound(p, q.select("term_id", F.col("query_id").alias("target")))),
    "pair_intersect_count": _on_both(I.pair_counts),
    "and_division": _on_both(I.and_division),
    "and_svs_semi": _on_both(I.and_svs_semi),
    "and_svs_merge": _on_both(lambda p, q: I.and_svs_semi(p, q, hint="merge")),
    "and_svs_fold": _on_both(I.and_svs_fold),
    "and_svs_nullmark": _on_both(I.and_svs_nullmark),
    "and_svs_range": _on_both(I.and_svs_range),
    "and_adp_range": _on_both(I.and_adp_range),
    "and_adp_block1024": _on_both(I.and_adp_block),
    "and_hash512": _on_both(I.and_hash_bucket),
    "and_hash512_dealt": _on_both(I.and_hash_dealt),
    "and_search": _on_both(I.search),
    "index_file_scan": _on_index(_index_file),
    "query_file_scan": _on_both(lambda p, q: _query_file(q)),
    "word_file_round_trip": _on_index(_word_file),
    "decompress_file": _on_index(_decompress_file),
    "index_metrics": _on_index(C.metrics),
    "dgap": _on_index(lambda p: C.gaps(p).select("term_id", "doc_id", "gap")),
    "bit_width": _on_index(lambda p: C.headers(p).select("term_id", "n", "w")),
    "compressed_size": _on_index(lambda p: C.headers(p).select("term_id", "bits", F.col("n_words").alias("words"))),
    "stream_offsets": _on_index(lambda p: C.stream_offsets(C.headers(p))),
    "pack_words": _on_index(C.pack_words),
    "pack_stream": _on_index(_stream_words),
    "unpack_gaps": _on_index(lambda p: C.unpack_gaps(C.compress(p)).select("term_id", "i", "gap")),
    "decode": _on_index(lambda p: C.decode(C.compress(p))),
    "decode_two_level": _on_index(lambda p: C.decode_two_level(C.compress(p))),
    "decode_stream": _on_index(_stream_decode),
    "roundtrip_diff": _on_index(C.roundtrip_diff),
    "and_on_compressed": _on_both(_on_compressed),
}

_POSTINGS = "p AS (SELECT DISTINCT l_partkey AS term_id, l_orderkey AS doc_id FROM lineitem WHERE l_partkey IS NOT NULL AND l_orderkey IS NOT NULL)"
_TERMS = "q AS (SELECT DISTINCT l_orderkey AS query_id, l_partkey AS term_id FROM lineitem WHERE l_partkey IS NOT NULL AND l_orderkey IS NOT NULL)"
_LENS = "lens AS (SELECT term_id, count(*) AS len FROM p GROUP BY term_id)"
_AND = f"""WITH {_POSTINGS}, {_TERMS}, need AS (SELECT query_id, count(*) AS n FROM q GROUP BY query_id)
SELECT h.query_id, h.doc_id FROM (SELECT q.query_id, p.doc_id, count(*) AS n FROM q JOIN p USING (term_id) GROUP BY q.query_id, p.doc_id) h
JOIN need USING (query_id) WHERE h.n = need.n"""
_GAPS = f"""{_POSTINGS}, g AS (SELECT term_id, doc_id, row_number() OVER w - 1 AS i, doc_id - coalesce(lag(doc_id) OVER w, 0) AS gap
FROM p WINDOW w AS (PARTITION BY term_id ORDER BY doc_id))"""
_HEADS = f"""{_GAPS}, hd AS (SELECT term_id, count(*) AS n, CASE WHEN max(gap) = 0 THEN 0 ELSE length(bin(max(gap))) END AS w FROM g GROUP BY term_id),
sz AS (SELECT term_id, n, CAST(w AS INTEGER) AS w, 38 + w * n AS bits FROM hd)"""
_OFFSETS = f"""{_HEADS}, off AS (SELECT term_id, n, w, bits, CAST(sum(bits) OVER (ORDER BY term_id) - bits AS BIGINT) AS start_bit, CAST(sum(bits) OVER (ORDER BY term_id) AS BIGINT) AS end_bit FROM sz)"""


def _fields(heads: str, start: str) -> str:
    return f"""f AS (SELECT g.term_id, {start} + 38 + g.i * h.w AS bit, g.gap AS v FROM g JOIN {heads} h USING (term_id)
UNION ALL SELECT term_id, {start}, n FROM {heads} h UNION ALL SELECT term_id, {start} + 32, w FROM {heads} h),
parts AS (SELECT term_id, bit // 32 AS k, (v << (bit % 32)::BIGINT) & 4294967295 AS part FROM f UNION ALL SELECT term_id, bit // 32 + 1, v >> (32 - bit % 32)::BIGINT FROM f)"""


_SCAN = f"WITH {_POSTINGS} SELECT term_id, doc_id FROM p"

ORACLE_SQL: dict[str, str] = {
    "postings_scan": _SCAN,
    "flatten_lists": f"WITH {_POSTINGS} SELECT term_id, CAST(row_number() OVER (PARTITION BY term_id ORDER BY doc_id) - 1 AS INTEGER) AS pos, doc_id FROM p",
    "term_lookup": f"WITH {_POSTINGS}, {_TERMS} SELECT term_id, doc_id FROM p WHERE term_id IN (SELECT term_id FROM q)",
    "active_terms": f"WITH {_TERMS} SELECT query_id, count(*) AS n_terms FROM q GROUP BY query_id",
    "index_stats": f"WITH {_POSTINGS}, {_LENS} SELECT (SELECT count(*) FROM lens) AS n_lists, (SELECT count(*) FROM p) AS n_postings, (SELECT max(doc_id) FROM p) AS max_doc_id, (SELECT avg(len) FROM lens) AS avg_len",
    "list_lengths": f"WITH {_POSTINGS}, {_LENS} SELECT term_id, len FROM lens",
    "query_term_order": f"WITH {_POSTINGS}, {_TERMS}, {_LENS} SELECT query_id, term_id, len, CAST(row_number() OVER (PARTITION BY query_id ORDER BY len, term_id) AS INTEGER) AS rank FROM q JOIN lens USING (term_id)",
    "bucket_directory": f"WITH {_POSTINGS}, pos AS (SELECT term_id, doc_id, row_number() OVER (PARTITION BY term_id ORDER BY doc_id) - 1 AS pos FROM p) SELECT term_id, doc_id // 512 AS bucket, min(pos) AS begin_pos, max(pos) AS end_pos FROM pos GROUP BY ALL",
    "lower_bound": f"WITH {_POSTINGS}, {_TERMS} SELECT q.term_id, q.query_id AS target, count(p.doc_id) AS pos FROM q LEFT JOIN p ON p.term_id = q.term_id AND p.doc_id < q.query_id GROUP BY q.term_id, q.query_id",
    "pair_intersect_count": f"WITH {_POSTINGS}, {_TERMS}, pairs AS (SELECT DISTINCT a.term_id AS term_a, b.term_id AS term_b FROM q a JOIN q b ON a.query_id = b.query_id AND a.term_id < b.term_id) SELECT term_a, term_b, count(*) AS n FROM pairs JOIN p a ON a.term_id = term_a JOIN p b ON b.term_id = term_b AND a.doc_id = b.doc_id GROUP BY term_a, term_b",
    **{f"and_{k}": _AND for k in ("division", "svs_semi", "svs_merge", "svs_fold", "svs_nullmark", "svs_range", "adp_range", "adp_block1024", "hash512", "hash512_dealt", "search", "on_compressed")},
    "dgap": f"WITH {_GAPS} SELECT term_id, doc_id, gap FROM g",
    "bit_width": f"WITH {_HEADS} SELECT term_id, n, w FROM sz",
    "compressed_size": f"WITH {_HEADS} SELECT term_id, bits, (bits + 31) // 32 AS words FROM sz",
    "stream_offsets": f"WITH {_OFFSETS} SELECT term_id, start_bit, end_bit FROM off",
    "pack_words": f"WITH {_HEADS}, {_fields('sz', '0')} SELECT parts.term_id, k, bit_or(part) AS word FROM parts JOIN sz USING (term_id) WHERE k < (bits + 31) // 32 GROUP BY parts.term_id, k",
    "pack_stream": f"WITH {_OFFSETS}, {_fields('off', 'h.start_bit')} SELECT k, bit_or(part) AS word FROM parts WHERE k < ((SELECT max(end_bit) FROM off) + 31) // 32 GROUP BY k",
    "unpack_gaps": f"WITH {_GAPS} SELECT term_id, i, gap FROM g",
    "decode": _SCAN,
    "decode_two_level": _SCAN,
    "decode_stream": _SCAN,
    "roundtrip_diff": "SELECT CAST(0 AS BIGINT) AS n_diff",
    "index_file_scan": _SCAN,
    "query_file_scan": f"WITH {_TERMS} SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY term_id) - 1 AS INTEGER) AS ord, term_id FROM q",
    "decompress_file": _SCAN,
    "index_metrics": f"WITH {_HEADS}, t AS (SELECT count(*) AS lists, CAST(sum(n) AS BIGINT) AS postings, CAST(sum(bits) AS BIGINT) AS bits, CAST(sum((bits + 31) // 32) AS BIGINT) AS words FROM sz), "
    "m AS (SELECT max(doc_id) AS top FROM p) SELECT u.metric, u.value FROM t, m, LATERAL (VALUES ('lists', lists::DOUBLE), ('postings', postings::DOUBLE), ('max_doc_id', top::DOUBLE), "
    "('mean_length', postings::DOUBLE / lists), ('bits', bits::DOUBLE), ('words', words::DOUBLE), ('bits_per_posting', bits::DOUBLE / postings)) AS u(metric, value)",
}
ORACLE_SQL["word_file_round_trip"] = ORACLE_SQL["pack_stream"]

"""Posting lists as rows (term_id, doc_id), and what can be read off them.

Conventions: ids are bigint; rows with a null id hold no posting; an unknown
term has an empty list; term 0 is an ordinary term.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def postings_from(df: DataFrame, term: str, doc: str, multiset: bool = False) -> DataFrame:
    """Index of any table: one row per (term_id, doc_id), repeated pairs only with `multiset`."""
    rows = df.select(F.col(term).cast("bigint").alias("term_id"), F.col(doc).cast("bigint").alias("doc_id")).dropna()
    return rows if multiset else rows.distinct()


def queries_from(df: DataFrame, query: str, term: str) -> DataFrame:
    """Query table (query_id, ord, term_id): the distinct terms of each query, in ascending order."""
    rows = df.select(F.col(query).cast("bigint").alias("query_id"), F.col(term).cast("bigint").alias("term_id")).dropna().distinct()
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("term_id")) - 1
    return rows.select("query_id", place.alias("ord"), "term_id")


def distinct_terms(queries: DataFrame) -> DataFrame:
    """A repeated term counts once, at its first place."""
    return queries.groupBy("query_id", "term_id").agg(F.min("ord").alias("ord"))


def term_lookup(postings: DataFrame, queries: DataFrame) -> DataFrame:
    """Postings of the terms that some query names. A semi join: no row of `postings` is repeated."""
    return postings.join(queries.select("term_id").distinct(), "term_id", "left_semi").select("term_id", "doc_id")


def list_lengths(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term_id").agg(F.count("*").alias("len"))


def nested_lists(postings: DataFrame) -> DataFrame:
    """(term_id, len, doc_ids): ascending arrays, duplicates kept."""
    return postings.groupBy("term_id").agg(F.sort_array(F.collect_list("doc_id")).alias("doc_ids")).select("term_id", F.size("doc_ids").cast("bigint").alias("len"), "doc_ids")


def flatten_lists(lists: DataFrame) -> DataFrame:
    """Rows (term_id, pos, doc_id) of nested lists, in list order."""
    return lists.select("term_id", F.posexplode("doc_ids").alias("pos", "doc_id"))


def index_stats(postings: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """One row: lists, postings, largest doc id, mean length. `terms` (term_id) adds empty lists to the mean."""
    lens = list_lengths(postings).select("term_id", "len")
    tops = postings.groupBy("term_id").agg(F.max("doc_id").alias("top"))
    per_term = lens.join(tops, "term_id")
    if terms is not None:
        per_term = terms.select("term_id").distinct().join(per_term, "term_id", "left").fillna({"len": 0})
    return per_term.agg(
        F.count("*").alias("n_lists"), F.coalesce(F.sum("len"), F.lit(0)).alias("n_postings"), F.max("top").alias("max_doc_id"), F.avg("len").alias("avg_len")
    )


def query_term_order(postings: DataFrame, queries: DataFrame) -> DataFrame:
    """Each query's terms by list length, shortest first; ties keep the written order. Unknown terms have length 0."""
    lens = distinct_terms(queries).join(list_lengths(postings), "term_id", "left").fillna({"len": 0})
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("len", "ord", "term_id"))
    return lens.select("query_id", "term_id", "len", rank.alias("rank"))


#: 64-bit words of a list's marks.
MARK_WORDS = 4


def _mark(doc: Column) -> tuple[Column, Column]:
    """The word and the bit that stand for an id in a list's marks."""
    h = F.xxhash64(doc)
    return F.pmod(h, F.lit(MARK_WORDS)).cast("int"), F.shiftright(h, 8).bitwiseAND(F.lit(63).cast("bigint")).cast("int")


def marked(doc: Column, marks: Column) -> Column:
    """Whether `marks` may hold an id: false only where no list could have it that they were made of."""
    word, bit = _mark(doc)
    return F.call_function("shiftright", F.get(marks, word), bit).bitwiseAND(F.lit(1).cast("bigint")) == 1


def query_marks(postings: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, n_terms, marks): the marks that all lists of a query have in common, as bit sets of hashed ids.

    An id that all lists hold is marked in each, so ids without a mark can go before anything is shuffled by query. That loses
    nothing, for lists of any length; of long lists all bits are set, and nothing goes. A query with an unknown term has no marks.
    """
    word, bit = _mark(F.col("doc_id"))
    words = [f"_m{i}" for i in range(MARK_WORDS)]
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)
    lists = postings.groupBy("term_id").agg(*[F.bit_or(F.when(word == i, one).otherwise(F.lit(0).cast("bigint"))).alias(w) for i, w in enumerate(words)])
    terms = distinct_terms(queries).select("query_id", "term_id").join(lists, "term_id", "left")
    common = terms.groupBy("query_id").agg(F.count("*").alias("n_terms"), *[F.bit_and(F.coalesce(w, F.lit(0).cast("bigint"))).alias(w) for w in words])
    return common.select("query_id", "n_terms", F.array(*words).alias("marks"))


def active_terms(queries: DataFrame) -> DataFrame:
    """(query_id, n_terms) over distinct terms."""
    return queries.groupBy("query_id").agg(F.count_distinct("term_id").alias("n_terms"))


#: Ids of one list that a window sees at once; longer lists are cut there, and what the cuts carry over is worked out apart.
SPAN = 1 << 20


def spans(postings: DataFrame, span: int = SPAN, at: str = "doc_id") -> DataFrame:
    """`postings` with `span`: which stretch of `span` ids a row lies in. A window by (term_id, span) is bounded for any list."""
    return postings.withColumn("span", F.floor(F.col(at) / span).cast("bigint"))


def positions(postings: DataFrame, span: int = SPAN) -> DataFrame:
    """0-based place of each posting in its ascending list, and the id before it (null for the first): (..., pos, before).

    Places inside spans, plus what the spans before hold: one row a span is put in order over the whole list.
    """
    cut = spans(postings, span)
    inside, over = Window.partitionBy("term_id", "span").orderBy("doc_id"), Window.partitionBy("term_id").orderBy("span")
    sums = cut.groupBy("term_id", "span").agg(F.count("*").alias("_n"), F.max("doc_id").alias("_top"))
    carried = sums.select("term_id", "span", (F.sum("_n").over(over) - F.col("_n")).alias("_base"), F.lag("_top").over(over).alias("_last"))
    placed = cut.withColumn("_i", F.row_number().over(inside) - 1).withColumn("_lag", F.lag("doc_id").over(inside)).join(carried, ["term_id", "span"])
    return placed.select(*postings.columns, (F.col("_base") + F.col("_i")).cast("bigint").alias("pos"), F.coalesce("_lag", "_last").alias("before"))


def bucket_directory(postings: DataFrame, width: int = 512) -> DataFrame:
    """(term_id, bucket, begin_pos, end_pos), inclusive; a bucket without postings has no row.

    The begin of a bucket is the running total of the bucket sizes before it,
    so only (term, bucket) counts are sorted, never the postings of a long list.
    """
    sizes = postings.withColumn("bucket", F.floor(F.col("doc_id") / width).cast("bigint")).groupBy("term_id", "bucket").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("term_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    return sizes.select("term_id", "bucket", (upto - F.col("n")).alias("begin_pos"), (upto - 1).alias("end_pos"))


def block_directory(postings: DataFrame, size: int = 1024) -> DataFrame:
    """Lists cut into runs of `size` ids: (term_id, block, lo, hi, ids)."""
    blocks = positions(postings).withColumn("block", F.floor(F.col("pos") / size).cast("bigint"))
    return blocks.groupBy("term_id", "block").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.sort_array(F.collect_list("doc_id")).alias("ids"))


def _running(rows: DataFrame, start: Callable[[Column], Column], span: int) -> DataFrame:
    """Of rows (term_id, at, order, value, others): `value` summed up or carried over, by `start`, over a list in the order of (at, order).

    `start` is a window aggregate of a column. Spans are worked off apart, and their results carried on, as in `positions`.
    """
    cut = spans(rows, span, "at")
    inside, over = Window.partitionBy("term_id", "span").orderBy("at", "order").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("term_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    whole = cut.groupBy("term_id", "span").agg(start(F.col("value")).alias("_whole"))
    carried = whole.select("term_id", "span", start(F.col("_whole")).over(over).alias("_carried"))
    return cut.withColumn("_upto", start(F.col("value")).over(inside)).join(carried, ["term_id", "span"])


def lower_bound(postings: DataFrame, probes: DataFrame, span: int = SPAN) -> DataFrame:
    """For each distinct probe (term_id, target): the number of ids below the target, that is the first place with an id >= target.

    Probes and postings of a term are merged in one ordered pass, a running
    count instead of a probe x posting join. Unknown terms give 0.
    """
    marks = probes.select("term_id", F.col("target").alias("at"), F.lit(0).alias("order"), F.lit(0).alias("value")).dropna().distinct()
    ids = postings.select("term_id", F.col("doc_id").alias("at"), F.lit(1).alias("order"), F.lit(1).alias("value"))
    merged = _running(marks.unionByName(ids), F.sum, span).filter("order = 0")
    return merged.select("term_id", F.col("at").alias("target"), (F.coalesce("_upto", F.lit(0)) + F.coalesce("_carried", F.lit(0))).cast("bigint").alias("pos"))


def block_of(blocks: DataFrame, probes: DataFrame, span: int = SPAN) -> DataFrame:
    """Rows (term_id, doc_id, others) with `lo`, the bound of the term's last block that begins at or before the id: null where none does.

    Blocks (term_id, lo) and rows are merged in one ordered pass; neither is repeated, however far apart a list's ids are.
    """
    starts = blocks.select("term_id", F.col("lo").alias("at"), F.lit(0).alias("order"), F.col("lo").alias("value"))
    marks = probes.withColumns({"at": F.col("doc_id"), "order": F.lit(1), "value": F.lit(None).cast("bigint")})
    merged = _running(marks.unionByName(starts, allowMissingColumns=True), F.max, span).filter("order = 1")
    return merged.select(*probes.columns, F.coalesce("_upto", "_carried").alias("lo"))

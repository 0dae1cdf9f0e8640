"""Batches of AND queries: (query_id, ord, term_id) x (term_id, doc_id) -> (query_id, doc_id).

Every strategy returns the same relation. A repeated term counts once, an
unknown term or a query without terms gives no row, one term gives its list.
All are set-oriented: one plan for the whole batch, no job per query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlane.operators import postings as P
from postlane.sources import places


def and_division(postings: DataFrame, queries: DataFrame, sift: bool = False) -> DataFrame:
    """Relational division: keep a document that as many distinct terms point to as the query has.

    The counts combine before the shuffle; no order of terms matters. With `sift`, only documents are counted that the marks of
    all lists of the query allow: two passes over the postings, and far fewer rows shuffled where lists are short.
    """
    if sift:
        terms = _marked_terms(postings, queries)
        met = terms.join(postings.distinct(), "term_id").filter(P.marked(F.col("doc_id"), F.col("marks")))
        return met.groupBy("query_id", "doc_id", "n_terms").agg(F.count("*").alias("hits")).filter("hits = n_terms").select("query_id", "doc_id")
    terms = P.distinct_terms(queries).select("query_id", "term_id")
    need = P.active_terms(queries)
    found = terms.join(postings.distinct(), "term_id").groupBy("query_id", "doc_id").agg(F.count("*").alias("hits"))
    return found.join(need, "query_id").filter("hits = n_terms").select("query_id", "doc_id")


def _marked_terms(postings: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, term_id, n_terms, marks): each distinct term with what all lists of its query have in common."""
    return P.distinct_terms(queries).select("query_id", "term_id").join(P.query_marks(postings, queries), "query_id")


def _survive(postings: DataFrame, queries: DataFrame, probe) -> DataFrame:
    """Shortest list first, then one round for each further rank.

    Rows carry their query's terms, shortest list first, so a round names the
    survivors once and plans stay linear in the number of terms of the longest
    query. `probe(rows)` adds `hit`, not null where (term_id, doc_id) is a
    posting; a query without a term of the rank passes on what it has.
    """
    order = P.query_term_order(postings, queries)
    terms = order.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term_id"))), lambda e: e["term_id"]).alias("terms"))
    ranks = order.agg(F.max("rank")).first()[0] or 0
    left = terms.withColumn("term_id", F.get("terms", F.lit(0))).join(postings.distinct(), "term_id").select("query_id", "doc_id", "terms")
    for k in range(1, ranks):
        left = probe(left.withColumn("term_id", F.get("terms", F.lit(k)))).filter("term_id is null or hit is not null").select("query_id", "doc_id", "terms")
    return left.select("query_id", "doc_id")


def _marked(postings: DataFrame) -> DataFrame:
    return postings.distinct().withColumn("hit", F.lit(True))


def and_svs_semi(postings: DataFrame, queries: DataFrame, hint: str | None = None) -> DataFrame:
    """Small-versus-small, rank by rank. `hint`: a join strategy for the list side, "merge" for the two-pointer form."""
    lists = _marked(postings)
    lists = lists.hint(hint) if hint else lists
    return _survive(postings, queries, lambda rows: rows.join(lists, ["term_id", "doc_id"], "left"))


def _sliced(postings: DataFrame, queries: DataFrame, width: int) -> DataFrame:
    """(query_id, range, slices): for each stretch of `width` ids, what all lists of a query hold there, shortest slice first.

    Lists are cut once, to slices of at most `width` distinct ids; a query's slices meet by (query, range) and never leave
    it, so the lists of one query split over tasks. Ids that the marks of some list of the query rule out, and slices of such
    ids alone, end before they are shuffled by query; ranges that some list has nothing in end here.
    """
    cut = P.spans(postings.distinct(), width).groupBy("term_id", F.col("span").alias("range")).agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))
    met = _marked_terms(postings, queries).join(cut, "term_id").withColumn("ids", F.filter("ids", lambda x: P.marked(x, F.col("marks")))).filter(F.size("ids") > 0)
    met = met.groupBy("query_id", "range", "n_terms").agg(F.array_sort(F.collect_list(F.struct(F.size("ids").alias("n"), "term_id", "ids"))).alias("met"))
    return met.filter(F.size("met") == F.col("n_terms")).select("query_id", "range", F.transform("met", lambda e: e["ids"]).alias("slices"))


def _others() -> F.Column:
    return F.slice("slices", F.lit(2), F.size("slices"))


def and_svs_range(postings: DataFrame, queries: DataFrame, width: int = 4096) -> DataFrame:
    """Small-versus-small inside id ranges: in each, list after list narrows what the shortest slice holds; the union of the ranges is the result."""
    kept = F.aggregate(_others(), F.get("slices", F.lit(0)), lambda kept, ids: F.filter(kept, lambda x: F.array_contains(ids, x)))
    return _sliced(postings, queries, width).select("query_id", F.explode(kept).alias("doc_id"))


def and_adp_range(postings: DataFrame, queries: DataFrame, width: int = 4096) -> DataFrame:
    """Element by element inside id ranges: an id of the shortest slice is looked up in one list after another and dropped at its
    first miss; the range bounds every lookup at both ends."""
    hits = F.filter(F.get("slices", F.lit(0)), lambda x: F.forall(_others(), lambda ids: F.array_contains(ids, x)))
    return _sliced(postings, queries, width).select("query_id", F.explode(hits).alias("doc_id"))


def and_hash_bucket(postings: DataFrame, queries: DataFrame, width: int = 512, hint: str | None = "shuffle_hash") -> DataFrame:
    """Lists hashed into buckets of `width` ids: a probe is joined to its own (term, bucket) and scans what that holds."""
    buckets = P.spans(postings.distinct(), width).groupBy("term_id", F.col("span").alias("bucket")).agg(F.collect_list("doc_id").alias("ids"))
    buckets = buckets.hint(hint) if hint else buckets

    def probe(rows: DataFrame) -> DataFrame:
        met = rows.withColumn("bucket", F.floor(F.col("doc_id") / width).cast("bigint")).join(buckets, ["term_id", "bucket"], "left")
        return met.withColumn("hit", F.when(F.array_contains("ids", F.col("doc_id")), True))

    return _survive(postings, queries, probe)


def and_hash_dealt(postings: DataFrame, queries: DataFrame, width: int = 512) -> DataFrame:
    """Buckets dealt to tasks: a query's lists meet bucket by bucket, and hash sets of their ids are intersected there."""
    kept = F.aggregate(_others(), F.get("slices", F.lit(0)), lambda kept, ids: F.array_intersect(kept, ids))
    return _sliced(postings, queries, width).select("query_id", F.explode(kept).alias("doc_id"))


def _fold(postings: DataFrame, queries: DataFrame, step, done=lambda c: c) -> DataFrame:
    order = P.query_term_order(postings, queries)
    lists = order.join(P.nested_lists(postings.distinct()).select("term_id", "doc_ids"), "term_id", "left")
    entry = F.struct("rank", F.coalesce("doc_ids", F.array().cast("array<bigint>")).alias("ids"))
    per_query = lists.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["ids"]).alias("lists"))
    rest = F.slice("lists", 2, F.greatest(F.size("lists") - 1, F.lit(0)))
    hits = per_query.select("query_id", done(F.aggregate(rest, F.get("lists", F.lit(0)), step)).alias("ids"))
    return hits.select("query_id", F.explode("ids").alias("doc_id"))


def and_svs_fold(postings: DataFrame, queries: DataFrame) -> DataFrame:
    """Nested form: fold `array_intersect` over a query's lists, shortest first. For lists that fit in a row."""
    return _fold(postings, queries, lambda kept, ids: F.array_intersect(kept, ids))


def and_svs_nullmark(postings: DataFrame, queries: DataFrame) -> DataFrame:
    """Nested form that keeps places: a miss becomes null, and nulls go at the end. No reserved id."""
    mark = lambda kept, ids: F.transform(kept, lambda x: F.when(F.array_contains(ids, F.coalesce(x, F.lit(-1))), x))
    return _fold(postings, queries, mark, done=F.array_compact)


def and_adp_block(postings: DataFrame, queries: DataFrame, size: int = 1024) -> DataFrame:
    """Block skipping: an id of the shortest list looks, in each other list, only into the one block of `size` ids that can hold it.

    The block is the last one that begins at or before the id, found by one ordered pass over block bounds and the probes of
    all queries and lists; then an equi join on (term, bound) fetches it. Lists with ids far apart cost no more than others,
    and the plan is the same for any number of terms. Ids that the marks of another list rule out are not probed. Blocks and
    probes, which it names twice, are written to the shared folder.
    """
    order = P.query_term_order(postings, queries)
    terms = order.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term_id"))), lambda e: e["term_id"]).alias("terms"))
    first = terms.withColumn("term_id", F.get("terms", F.lit(0))).join(P.query_marks(postings, queries), "query_id").join(postings.distinct(), "term_id")
    first = first.filter(P.marked(F.col("doc_id"), F.col("marks")))
    others = F.slice("terms", F.lit(2), F.size("terms"))
    probes = places.saved(first.select("query_id", "doc_id", (F.size("terms") - 1).alias("need"), F.explode_outer(others).alias("term_id")))
    blocks = places.saved(P.block_directory(postings.distinct(), size).select("term_id", "lo", "hi", "ids"))
    met = P.block_of(blocks, probes.filter("need > 0")).join(blocks, ["term_id", "lo"])
    held = met.filter((F.col("doc_id") <= F.col("hi")) & F.array_contains("ids", F.col("doc_id")))
    counted = held.groupBy("query_id", "doc_id", "need").agg(F.count("*").alias("hits")).filter("hits = need")
    return counted.select("query_id", "doc_id").unionByName(probes.filter("need = 0").select("query_id", "doc_id"))


def semi_multiset(first: DataFrame, others: list[DataFrame]) -> DataFrame:
    """Membership of each id of `first` in every other list; ids repeated in `first` all stay."""
    for other in others:
        first = first.join(other.select("doc_id"), "doc_id", "left_semi")
    return first


def pair_counts(postings: DataFrame, queries: DataFrame) -> DataFrame:
    """(term_a, term_b, n): size of the intersection for every two terms that stand in one query; 0 when disjoint.

    Each document goes the cheaper way: it makes all pairs of its queried terms, or, where these are more than the queried
    pairs that begin with its terms, its postings are joined by the first term of these and looked up by the second.
    """
    terms = P.distinct_terms(queries).select("query_id", "term_id")
    pairs = terms.withColumnRenamed("term_id", "term_a").join(terms.withColumnRenamed("term_id", "term_b"), "query_id").filter("term_a < term_b").select("term_a", "term_b").distinct()
    # How many pairs a term begins; a term that only ends pairs begins none.
    begun = pairs.select(F.explode(F.array(F.struct(F.col("term_a").alias("term_id"), F.lit(1).alias("one")), F.struct(F.col("term_b").alias("term_id"), F.lit(0).alias("one")))).alias("e"))
    begun = begun.groupBy(F.col("e.term_id").alias("term_id")).agg(F.sum("e.one").alias("begun"))
    lists = postings.distinct().join(begun, "term_id")
    costs = lists.groupBy("doc_id").agg(F.count("*").alias("held"), F.sum("begun").alias("cost")).select("doc_id", (F.col("held") * (F.col("held") - 1) <= 2 * F.col("cost")).alias("own"))
    dealt = lists.select("term_id", "doc_id").join(costs, "doc_id")
    side = lambda own, name: dealt.filter(F.col("own") == own).select(F.col("term_id").alias(name), "doc_id")
    within = side(True, "term_a").join(side(True, "term_b"), "doc_id").filter("term_a < term_b").groupBy("term_a", "term_b").agg(F.count("*").alias("n"))
    probed = pairs.join(side(False, "term_a"), "term_a").join(side(False, "term_b"), ["term_b", "doc_id"], "left_semi").groupBy("term_a", "term_b").agg(F.count("*").alias("n"))
    counts = within.unionByName(probed).groupBy("term_a", "term_b").agg(F.sum("n").alias("n"))
    return pairs.join(counts, ["term_a", "term_b"], "left").fillna({"n": 0})


STRATEGIES = {
    "division": and_division, "svs_semi": and_svs_semi, "svs_range": and_svs_range, "hash_bucket": and_hash_bucket, "hash_dealt": and_hash_dealt, "svs_fold": and_svs_fold,
    "svs_nullmark": and_svs_nullmark, "adp_range": and_adp_range, "adp_block": and_adp_block,
}


def choose(postings: DataFrame, queries: DataFrame, spread: float = 4.0) -> str:
    """Strategy by list sizes: semi joins from the shortest list when the queried lists are over `spread` times as long as
    the shortest ones in total, else division, which touches every queried posting once and takes one round."""
    sums = P.query_term_order(postings, queries).agg(F.sum("len"), F.sum(F.when(F.col("rank") == 1, F.col("len")))).first()
    return "svs_semi" if sums[0] and sums[0] > spread * max(sums[1] or 0, 1) else "division"


def search(postings: DataFrame, queries: DataFrame, strategy: str | None = None) -> DataFrame:
    return STRATEGIES[strategy or choose(postings, queries)](postings, queries)

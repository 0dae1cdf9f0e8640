"""Gap encoding and fixed-width bit packing of posting lists.

A list is `len` (32 bits), `w` (6 bits) and `len` gaps of `w` bits, least
significant bit first; the first gap is the first id, and `w` is the bit width
of the largest gap. Words are 32 bits in a bigint. Each list starts at bit 0 of
its own words; `pack_stream` lays all lists end to end in term order instead.
An empty list is a header alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlane.functions import bits as B
from postlane.operators import postings as P


def gaps(postings: DataFrame) -> DataFrame:
    """(term_id, i, doc_id, gap): 0-based place and difference to the id before. An id outside 0 to 2^32 - 1 raises an error:
    the format's fields hold no more. Long lists are worked off in spans, so that no window sees one whole."""
    placed = P.positions(postings.select("term_id", "doc_id"))
    wrong = (F.col("doc_id") < 0) | (F.col("doc_id") > B.WORD_MASK)
    gap = F.when(wrong, F.raise_error(F.concat(F.lit("id outside 0 to 4294967295: "), F.col("doc_id").cast("string"))).cast("bigint")).otherwise(F.col("doc_id") - F.coalesce("before", F.lit(0).cast("bigint")))
    return placed.select("term_id", F.col("pos").alias("i"), "doc_id", gap.alias("gap"))


def headers(postings: DataFrame, terms: DataFrame | None = None, gapped: DataFrame | None = None) -> DataFrame:
    """(term_id, n, w, bits, n_words) of each list; `terms` (term_id) adds empty lists."""
    seen = (gapped if gapped is not None else gaps(postings)).groupBy("term_id").agg(F.count("*").alias("n"), F.max("gap").alias("mx"))
    if terms is not None:
        seen = terms.select("term_id").distinct().join(seen, "term_id", "left").fillna({"n": 0, "mx": 0})
    sized = seen.select("term_id", "n", B.bit_width(F.col("mx")).alias("w"))
    sized = sized.withColumn("bits", B.list_bits(F.col("n"), F.col("w")))
    return sized.withColumn("n_words", B.words_for(F.col("bits")))


def stream_offsets(heads: DataFrame, groups: int = 64) -> DataFrame:
    """(term_id, start_bit, end_bit) in one stream by ascending term.

    Two-level prefix sum: a running sum inside each of `groups` runs of terms,
    and the totals of the runs before; no window sees all lists at once.
    """
    cut = _runs(heads, groups)
    inside = F.sum("bits").over(Window.partitionBy("run").orderBy("term_id").rowsBetween(Window.unboundedPreceding, 0))
    totals = cut.groupBy("run").agg(F.sum("bits").alias("total"))
    base = totals.select("run", (F.sum("total").over(Window.orderBy("run")) - F.col("total")).alias("base"))
    local = cut.withColumn("upto", inside).join(F.broadcast(base), "run")  # at most `groups` rows
    return local.select("term_id", (F.col("base") + F.col("upto") - F.col("bits")).alias("start_bit"), (F.col("base") + F.col("upto")).alias("end_bit"))


def _runs(heads: DataFrame, groups: int) -> DataFrame:
    """Term ids cut into at most `groups` runs of equal id span; the span comes from one small aggregate."""
    lo, hi = heads.agg(F.min("term_id"), F.max("term_id")).first()
    width = max(1, -(-((hi or 0) - (lo or 0) + 1) // groups))
    return heads.withColumn("run", F.floor((F.col("term_id") - (lo or 0)) / width).cast("bigint"))


def _contributions(gapped: DataFrame, heads: DataFrame) -> DataFrame:
    """(term_id, start, bit, value): every field of every list."""
    body = gapped.join(heads.select("term_id", "start", "w"), "term_id").select("term_id", (F.col("start") + B.HEADER_BITS + F.col("i") * F.col("w")).alias("bit"), F.col("gap").alias("value"))
    length = heads.select("term_id", F.col("start").alias("bit"), F.col("n").alias("value"))
    width = heads.select("term_id", (F.col("start") + B.LENGTH_BITS).alias("bit"), F.col("w").cast("bigint").alias("value"))
    return body.unionByName(length).unionByName(width)


def pack_words(postings: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(term_id, k, word): the words of each list; fields that share a word meet in a partial bit_or."""
    gapped = gaps(postings)
    heads = headers(postings, terms, gapped).withColumn("start", F.lit(0).cast("bigint"))
    parts = _contributions(gapped, heads).select("term_id", F.inline(B.field_parts(F.col("bit"), F.col("value"))))
    words = parts.groupBy("term_id", "k").agg(F.bit_or("part").alias("word"))
    return words.join(heads.select("term_id", "n_words"), "term_id").filter("k < n_words").select("term_id", "k", "word")


def pack_stream(postings: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(k, word) of all lists end to end, without word alignment between lists."""
    gapped = gaps(postings)
    heads = headers(postings, terms, gapped)
    placed = heads.join(stream_offsets(heads).withColumnRenamed("start_bit", "start"), "term_id")
    parts = _contributions(gapped, placed).select(F.inline(B.field_parts(F.col("bit"), F.col("value"))))
    end = placed.agg(F.max("end_bit")).first()[0] or 0
    return parts.groupBy("k").agg(F.bit_or("part").alias("word")).filter(F.col("k") < -(-end // B.WORD_BITS))


def compress(postings: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(term_id, n, w, words): one row per list."""
    packed = pack_words(postings, terms).groupBy("term_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda e: e["word"]).alias("words"))
    return with_headers(packed)


def with_headers(lists: DataFrame) -> DataFrame:
    """(term_id, n, w, words) with length and width as the words themselves say."""
    zero = F.lit(0).cast("bigint")
    n, w = B.read_field(F.col("words"), zero, F.lit(32)), B.read_field(F.col("words"), zero + B.LENGTH_BITS, F.lit(B.WIDTH_BITS))
    return lists.select("term_id", n.alias("n"), w.cast("int").alias("w"), "words")


def unpack_gaps(lists: DataFrame) -> DataFrame:
    """(term_id, i, n, gap) of compressed lists; an empty list gives no row."""
    places = lists.filter("n > 0").select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("i"))
    bit = F.lit(B.HEADER_BITS) + F.col("i") * F.col("w")
    return places.select("term_id", "i", "n", B.read_field(F.col("words"), bit, F.col("w")).alias("gap"))


def decode(lists: DataFrame) -> DataFrame:
    """(term_id, doc_id): prefix sums of the gaps, term by term."""
    upto = F.sum("gap").over(Window.partitionBy("term_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return unpack_gaps(lists).select("term_id", upto.alias("doc_id"))


def decode_two_level(lists: DataFrame, segments: int = 4) -> DataFrame:
    """As `decode`, with a list's gaps split over tasks: sums inside segments, then the totals of the segments before. The words of
    a list are one row either way, less than 2 GB, or some 500 million postings."""
    width = F.greatest(F.floor(F.col("n") / segments), F.lit(1)).cast("bigint")
    cut = unpack_gaps(lists).withColumn("seg", F.least(F.floor(F.col("i") / width), F.lit(segments)).cast("bigint"))
    inside = F.sum("gap").over(Window.partitionBy("term_id", "seg").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    totals = cut.groupBy("term_id", "seg").agg(F.sum("gap").alias("total"))
    base = totals.select("term_id", "seg", (F.sum("total").over(Window.partitionBy("term_id").orderBy("seg")) - F.col("total")).alias("base"))
    return cut.withColumn("upto", inside).join(base, ["term_id", "seg"]).select("term_id", (F.col("base") + F.col("upto")).alias("doc_id"))


def unpack_stream(words: DataFrame, offsets: DataFrame) -> DataFrame:
    """Lists of a stream (k, word), given each list's bits (term_id, start_bit, end_bit), realigned to bit 0: (term_id, n, w, words).

    A list is found from its offsets alone, so no list waits for the one before.
    """
    spans = offsets.select("term_id", "start_bit", "end_bit", F.explode(F.sequence(B.word_index(F.col("start_bit")), B.word_index(F.col("end_bit") - 1))).alias("k"))
    raw = spans.join(words, "k").groupBy("term_id", "start_bit", "end_bit").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda e: e["word"]).alias("raw"))
    count = B.words_for(F.col("end_bit") - F.col("start_bit"))
    shift = B.bit_offset(F.col("start_bit")).cast("bigint")
    left = F.col("end_bit") - F.col("start_bit")
    place = lambda j: F.least(F.lit(32).cast("bigint"), left - j * 32).cast("int")
    words32 = F.transform(F.sequence(F.lit(0).cast("bigint"), count - 1), lambda j: B.read_field(F.col("raw"), shift + j * 32, place(j)))
    return with_headers(raw.select("term_id", words32.alias("words")))


def roundtrip_diff(postings: DataFrame) -> DataFrame:
    """One row n_diff: postings that the codec changes, in either direction; 0 when lossless."""
    back = decode(compress(postings)).withColumn("sign", F.lit(1))
    pairs = postings.select("term_id", "doc_id", F.lit(-1).alias("sign"))
    return back.unionByName(pairs).groupBy("term_id", "doc_id").agg(F.sum("sign").alias("d")).agg(F.coalesce(F.sum(F.abs("d")), F.lit(0)).alias("n_diff"))


def metrics(postings: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(metric, value) of an index and its compressed form: lists, postings, largest id, mean length, bits, words, bits a posting."""
    stats, heads = P.index_stats(postings, terms), headers(postings, terms)
    sizes = heads.agg(F.coalesce(F.sum("bits"), F.lit(0)).alias("bits"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("words"))
    row = stats.crossJoin(F.broadcast(sizes))  # one row each
    value = lambda c: F.col(c).cast("double")
    named = {"lists": value("n_lists"), "postings": value("n_postings"), "max_doc_id": value("max_doc_id"), "mean_length": value("avg_len"), "bits": value("bits"), "words": value("words"), "bits_per_posting": F.try_divide(value("bits"), value("n_postings"))}
    return row.select(F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in named.items()])))

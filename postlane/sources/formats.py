"""Readers and writers.

* index file: per list an int32 length and that many uint32 ids, little-endian; ids may be unsorted.
* query file: text, one query a line, term ids between blanks.
* word file: uint32 words, little-endian, no header.

Reading goes through Spark's own readers, so any store that Spark reaches will do.
Writing goes to any store that has a pyarrow file system, or is mounted. A file
is one binary value while it is read, so index and word files hold less than
2 GB each; an index of any size is many files.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from postlane.sources.places import filesystem

INDEX_SCHEMA = "file string, term_id bigint, len bigint, doc_ids array<bigint>"


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(file, term_id, len, doc_ids ascending) of each list; term ids count up within a file.

    Where a list starts depends on all lengths before it, so one task reads one
    file, and files load side by side. A file that ends inside a list raises an
    error. An empty file holds no list.
    """

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        schema = pa.schema([("file", pa.string()), ("term_id", pa.int64()), ("len", pa.int64()), ("doc_ids", pa.list_(pa.int64()))])
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                words = np.frombuffer(content.as_buffer(), "<u4", len(content.as_buffer()) // 4)
                if len(content.as_buffer()) % 4:
                    raise ValueError(f"{name}: size is no multiple of 4 bytes")
                at, term, rows = 0, 0, []
                while at < len(words):
                    n = int(words[at])
                    if at + 1 + n > len(words):
                        raise ValueError(f"{name}: list {term} is cut short")
                    rows.append((name, term, n, np.sort(words[at + 1 : at + 1 + n]).astype("i8")))
                    at, term = at + 1 + n, term + 1
                    if len(rows) == 1024:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(lists, INDEX_SCHEMA)


def numbered(rows: DataFrame, place: str, name: str) -> DataFrame:
    """`rows` (file, `place`, others) with `name` in its stead: the place counted on over all files, in name order.

    Only one row for each file is put in order.
    """
    last = rows.groupBy("file").agg((F.max(place) + 1).alias("n"))
    base = last.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("_base"))
    return rows.join(F.broadcast(base), "file").withColumn(place, F.col("_base") + F.col(place)).drop("_base", "file").withColumnRenamed(place, name)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, ord, term_id): query_id is the 0-based line of the file, blank lines counted but without rows.

    All tokens of a line count, a last line without a line end too; a malformed
    token raises an error. Meant for query batches: the file is read whole.
    """
    text = spark.read.text(path, wholetext=True)
    lines = text.select(F.posexplode(F.split("value", "\r?\n")).alias("query_id", "line"))
    tokens = lines.select(F.col("query_id").cast("bigint").alias("query_id"), F.posexplode(F.filter(F.split("line", r"\s+"), lambda t: t != "")).alias("ord", "token"))
    return tokens.select("query_id", "ord", F.col("token").cast("bigint").alias("term_id"))


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, word) of word files; a trailing part of a word is left out. JVM-side: no Python per word."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content", F.floor(F.length("content") / 4).alias("n"))
    places = files.filter("n > 0").select("file", "content", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("pos"))
    at = lambda k: F.hex(F.substring("content", (F.col("pos") * 4 + k).cast("int"), F.lit(1)))
    return places.select("file", "pos", F.conv(F.concat(at(4), at(3), at(2), at(1)), 16, 10).cast("bigint").alias("word"))


def stream_offsets(spark: SparkSession, path: str) -> DataFrame:
    """(term_id, start_bit, end_bit) of the lists in one word file, which lie end to end; term ids count up.

    A list's header says where the next one starts, so one task walks the headers; postings are not touched. What fills the last
    word is shorter than a header.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                data = memoryview(content.as_buffer())
                bits = len(data) // 4 * 32
                at, rows = 0, []
                while bits - at >= 38:
                    # 38 bits from any bit on lie in six bytes, least significant bit first.
                    field = int.from_bytes(data[at // 8 : at // 8 + 6], "little") >> at % 8
                    n, w = field & 0xFFFFFFFF, field >> 32 & 0x3F
                    end = at + 38 + n * w
                    if end > bits or w > 32:
                        raise ValueError(f"{name}: list {len(rows)} is cut short")
                    rows.append((len(rows), at, end))
                    at = end
                cols = list(zip(*rows)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["term_id", "start_bit", "end_bit"])

    files = spark.read.format("binaryFile").load(path).select("path", "content").filter(F.length("content") > 0)
    return files.mapInArrow(walk, "term_id bigint, start_bit bigint, end_bit bigint")


class _Binary(DataSource):
    """Writes rows, in the order that each task gets them, as little-endian uint32 words: one file for each partition."""

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _BinaryWriter(self.options["path"], self.pack, overwrite)


class _BinaryWriter(DataSourceWriter):
    def __init__(self, path: str, pack, overwrite: bool) -> None:
        self.path, self.pack, self.overwrite = path, pack, overwrite

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        store, path = filesystem(self.path)
        store.create_dir(path, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}.bin"
        own = f"{path}/.{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(own) as out:
            for row in rows:
                out.write(self.pack(row))
        message = WriterCommitMessage()
        message.files = (own, f"{path}/{name}")
        return message

    def commit(self, messages: list) -> None:
        """Files take their names only now, so a task that ran twice leaves one file."""
        from pyarrow import fs

        store, path = filesystem(self.path)
        if self.overwrite:
            named = {m.files[1] for m in messages if m}
            for x in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
                if x.base_name.startswith("part-") and f"{path}/{x.base_name}" not in named:
                    store.delete_file(x.path)
        for m in filter(None, messages):
            store.move(*m.files)

    def abort(self, messages: list) -> None:
        store, _ = filesystem(self.path)
        for m in filter(None, messages):
            if store.get_file_info(m.files[0]).is_file:
                store.delete_file(m.files[0])


def _pack_word(row) -> bytes:
    return struct.pack("<I", row[0])


def _pack_list(row) -> bytes:
    ids = row[0] or []
    return struct.pack(f"<i{len(ids)}I", len(ids), *ids)


class WordFile(_Binary):
    pack = staticmethod(_pack_word)

    @classmethod
    def name(cls) -> str:
        return "uint32words"


class IndexFile(_Binary):
    pack = staticmethod(_pack_list)

    @classmethod
    def name(cls) -> str:
        return "postinglists"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WordFile)
    spark.dataSource.register(IndexFile)


def write_words(words: DataFrame, path: str, order: str = "k", files: int | None = None) -> None:
    """Word files in `order`: name order of the files is word order. `path` is a folder that driver and executors share."""
    register(words.sparkSession)
    words.repartitionByRange(*([files] if files else []), order).sortWithinPartitions(order).select("word").write.format("uint32words").mode("overwrite").save(path)


def write_index(lists: DataFrame, path: str) -> None:
    """Index files of (term_id, doc_ids), by ascending term over the files."""
    register(lists.sparkSession)
    lists.repartitionByRange("term_id").sortWithinPartitions("term_id").select("doc_ids").write.format("postinglists").mode("overwrite").save(path)


def write_queries(queries: DataFrame, path: str) -> None:
    """A query file of (query_id, ord, term_id): line by query id, blank where an id has no terms. For batches that one task can write."""
    top = queries.agg(F.max("query_id")).first()[0]
    lines = queries.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "term_id"))), lambda e: e["term_id"].cast("string")), " ").alias("line"))
    every = queries.sparkSession.range(0 if top is None else top + 1).withColumnRenamed("id", "query_id").join(lines, "query_id", "left")
    every.coalesce(1).sortWithinPartitions("query_id").select(F.coalesce("line", F.lit("")).alias("value")).write.mode("overwrite").text(path)

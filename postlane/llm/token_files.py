"""Token ids in flat binary files.

A folder holds, for each part p of the document order, `p.ids` (unsigned
integers, 2 bytes each where the vocabulary allows, else 4), `p.off` (64-bit
offsets of the documents in ids from the part's start, one more than
documents) and `p.doc` (64-bit document ids), all little-endian, and a Parquet
table `manifest` with each part's sizes and its base: the ids in all parts
before it, a prefix sum. Parts, and documents in them, ascend by document id.
There are as many parts as the texts' bytes ask for (PART_BYTES each), one for
each shuffle partition at least. Files are mapped into memory where the folder
is a local or mounted one, and read in ranges elsewhere.

Null texts are empty. Rows that repeat are kept; rows of equal ids are in the
order of their texts. Null document ids come first; the manifest says how many
of a part's are null, and their places hold 0. Texts of any length are encoded
whole; a part is written as it is encoded, never held. An empty table gives
files without documents. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlane.llm import store, tokens

PART_BYTES = 256 << 20
MANIFEST = "part int, n_docs bigint, n_ids bigint, n_null bigint"


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, keeps_blanks: bool, vocabulary: int, parts: int | None = None, remembered: int = tokens.REMEMBERED) -> None:
    """Encode `text` of every row, append `end_id`, and write the files of (doc_id, text).

    A part's files get their names when they are whole; a task that runs again
    writes the same bytes under the same names. The driver sees one row a part.
    """
    docs = store.lean(docs)
    spark = docs.sparkSession
    width = "<u2" if max(vocabulary, end_id + 1) <= 1 << 16 else "<u4"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens.trim()
        part = TaskContext.get().partitionId()
        fs, path = store.filesystem(folder)
        fs.create_dir(path, recursive=True)
        own = f"{path}/.{part:06d}-{uuid.uuid4().hex}"
        encoder, n_docs, at = tokens.shared(tokenizer, keeps_blanks, remembered), 0, 0
        n_null = 0
        end = np.array([end_id], width)
        with fs.open_output_stream(f"{own}.ids") as ids, fs.open_output_stream(f"{own}.off") as off, fs.open_output_stream(f"{own}.doc") as doc:
            off.write(np.array([0], "<u8").tobytes())
            for batch in batches:
                sizes = []
                for x in encoder.encode(batch.column("text")):
                    ids.write(x.astype(width).tobytes() + end.tobytes())
                    sizes.append(len(x) + 1)
                ends = at + np.cumsum(np.array(sizes, np.int64))
                off.write(ends.astype("<u8").tobytes())
                doc.write(batch.column("doc_id").fill_null(0).to_numpy().astype("<i8").tobytes())
                n_null += batch.column("doc_id").null_count
                n_docs, at = n_docs + len(sizes), int(ends[-1]) if len(ends) else at
        for kind in ("ids", "off", "doc"):
            fs.move(f"{own}.{kind}", f"{path}/{part:06d}.{kind}")
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([at], pa.int64()), "n_null": pa.array([n_null], pa.int64())})

    n = parts or max(store.partitions(spark), -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES))
    ordered = docs.select(F.col("doc_id").cast("bigint"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    done = sorted(tuple(r) for r in ordered.mapInArrow(task, MANIFEST).collect())
    bases = [0, *accumulate(r[2] for r in done)]
    rows = [(*r, base, width) for r, base in zip(done, bases)]
    spark.createDataFrame(rows, f"{MANIFEST}, base bigint, width string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")


class _Ranged:
    """A remote file as an array of which only the slices asked for are read."""

    def __init__(self, fs, path: str, kind: str) -> None:
        self.file, self.kind = fs.open_input_file(path), np.dtype(kind)

    def __getitem__(self, some: slice) -> np.ndarray:
        lo, hi = int(some.start), int(some.stop)
        return np.frombuffer(self.file.read_at((hi - lo) * self.kind.itemsize, lo * self.kind.itemsize), self.kind)


def _mapped(fs, path: str, kind: str) -> np.ndarray | _Ranged:
    """A file as an array: mapped where it is local, else read by slices."""
    from pyarrow import fs as pfs

    if isinstance(fs, pfs.LocalFileSystem):
        return np.memmap(path, kind, "r") if fs.get_file_info(path).size else np.empty(0, kind)
    return _Ranged(fs, path, kind)


def read(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, and ids if asked for): start counts the ids of all documents before; the checksum is over ids as 4-byte little-endian."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        fs, path = store.filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                ids, off, doc = (_mapped(fs, f"{path}/{row['part']:06d}.{k}", t) for k, t in (("ids", row["width"]), ("off", "<u8"), ("doc", "<i8")))
                for lo in range(0, row["n_docs"], 512):
                    hi = min(lo + 512, row["n_docs"])
                    bounds = off[lo : hi + 1].astype(np.int64)
                    flat = np.asarray(ids[bounds[0] : bounds[-1]]).astype("<u4")
                    cuts = bounds - bounds[0]
                    crc = [zlib.crc32(flat[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
                    names = np.asarray(doc[lo:hi])
                    columns = {"doc_id": pa.array(names, pa.int64(), mask=np.arange(lo, hi) < row["n_null"]), "start": pa.array(row["base"] + bounds[:-1]), "n_tokens": pa.array(np.diff(bounds)), "ids_crc32": pa.array(crc, pa.int64())}
                    if with_ids:
                        columns["ids"] = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat.astype(np.int32)))
                    yield pa.RecordBatch.from_pydict(columns)

    manifest = spark.read.parquet(f"{folder}/manifest").repartition(store.partitions(spark), "part")
    return manifest.mapInArrow(task, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)

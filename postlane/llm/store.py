"""Tables and files in the folder that the cluster's machines share."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlane.sources.places import filesystem, folder

__all__ = ["filesystem", "folder", "lean", "mark", "partitions", "saved", "settled", "without_ids"]


SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Tables that this process saved, in order.
_MADE: list[str] = []


def saved(df: DataFrame) -> DataFrame:
    """`df` written once as a table in the shared folder and read back: its lineage ends there, and lost executors cost no rerun.
    What was shuffled to make it goes as soon as it is written, not when the driver happens to collect its garbage."""
    path, conf = folder(df.sparkSession), df.sparkSession.conf
    before = conf.get(SHUFFLES_GO, None)
    conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(SHUFFLES_GO) if before is None else conf.set(SHUFFLES_GO, before)
    _MADE.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> int:
    """For `settled`: where tables saved from now on begin."""
    return len(_MADE)


def settled(df: DataFrame, since: int) -> DataFrame:
    """`saved`, and all tables saved since `since` that `df` may have been made of are deleted. Other frames made of them are lost."""
    out = saved(df)
    jvm = df.sparkSession._jvm
    for path in _MADE[since:-1]:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    _MADE[since:] = _MADE[-1:]
    return out


#: Bytes of one Arrow batch. Spark's own limit of 64 MB takes several times as much beside the heap for long texts and sets.
BATCH_BYTES = "8m"


def lean(df: DataFrame) -> DataFrame:
    """`df`, with small Arrow batches from now on in its session, unless the session asks for smaller ones itself."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    plain = re.fullmatch(r"(-?\d+)b?", conf.get(key))  # as the default reads; other forms are a user's own
    if plain and not 0 < int(plain[1]) <= 8 << 20:
        conf.set(key, BATCH_BYTES)
    return df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def without_ids(docs: DataFrame, ids: DataFrame, few: int = 500_000) -> DataFrame:
    """`docs` but the rows whose doc_id is in `ids` (doc_id); sent to all tasks only up to `few` ids, some 8 MB. Null ids stay."""
    gone = saved(ids.select("doc_id").distinct())
    return docs.join(F.broadcast(gone) if gone.count() <= few else gone, "doc_id", "left_anti").select(*docs.columns)

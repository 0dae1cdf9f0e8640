"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlane.llm import store

HUB, SALT, BROADCAST_HUBS = 1000, 32, 500_000


def components(links: DataFrame, labels: DataFrame | None = None, rounds: int = 200) -> DataFrame:
    """(node, label): the smallest node reachable, for each node of `links` (a, b) and of `labels`.

    Each round takes the least label among neighbours, hands it to the node
    that the old label names, and jumps: label of label. Rounds grow with the
    logarithm of the longest path for usual graphs. Every round is a table in
    the shared folder; nothing of size goes to the driver. Hot nodes and labels
    meet in partial minima; joins on them are salted: nodes of more than HUB
    links, and labels that move, are held SALT times.
    """
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))
    salt = lambda x: F.pmod(F.xxhash64(x), F.lit(SALT)).cast("int")
    both = links.select("a", "b").union(links.select("b", "a")).distinct()
    hubs = store.saved(both.groupBy("b").agg(F.count("*").alias("n")).filter(F.col("n") > HUB).select("b"))  # at most 2 / HUB of the links
    n_hubs = hubs.count()
    if n_hubs:
        hubs = F.broadcast(hubs) if n_hubs <= BROADCAST_HUBS else hubs
        both = both.join(hubs.withColumn("hub", F.lit(True)), "b", "left").select("a", "b", F.when(F.col("hub"), salt("a")).otherwise(0).alias("salt"))
    both = store.saved(both)
    nodes = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    if labels is not None:
        nodes = nodes.unionByName(labels.select("node", "label")).groupBy("node").agg(F.min("label").alias("label"))
    now = store.saved(nodes)
    for _ in range(rounds):
        known = now.select(F.col("node").alias("b"), "label")
        if n_hubs:
            few = F.when(F.col("hub"), F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0)))
            known = known.join(hubs.withColumn("hub", F.lit(True)), "b", "left").select("b", "label", F.explode(few).alias("salt"))
        near = both.join(known, ["b", "salt"] if n_hubs else "b").select(F.col("a").alias("node"), "label")
        least = now.unionByName(near).groupBy("node").agg(F.min("label").alias("label"))
        hooked = now.join(least.withColumnRenamed("label", "low"), "node").filter("low < label").groupBy(F.col("label").alias("node")).agg(F.min("low").alias("label"))
        low = store.saved(least.unionByName(hooked).groupBy("node").agg(F.min("label").alias("label")))
        moving = low.filter("node <> label").select(F.col("node").alias("label"), F.col("label").alias("root")).join(low.select("label").distinct(), "label", "left_semi")
        salted = low.withColumn("salt", salt("node")).join(moving.withColumn("salt", salts), ["label", "salt"], "left")
        new = store.saved(salted.select("node", F.coalesce("root", "label").alias("label")))
        changed = new.join(now, "node").filter(new["label"] != now["label"]).limit(1).count()
        now = new
        if not changed:
            return now
    raise RuntimeError("components did not settle")

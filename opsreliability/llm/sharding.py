"""Shards over fixed virtual slots.

Records are hashed into a fixed number of slots, for good.  Bytes are added up per slot, and a
small versioned table maps slots to shards.  Rebalancing edits that table: it moves whole slots
from the fullest shards, so only their records move.  Growing moves slots to the new shard only.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from opsreliability.session import materialise

#: Virtual slots: fixed, far more than shards.  The map is a table of this many rows.
SLOTS = 4096
#: Pieces of a slot that rows are numbered in, so that no slot is one sorted group.
PARTS = 16


def slotted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, vslot.  A null text has no bytes; rows without an id share
    a slot chosen by their text, as do repeated rows."""
    d = docs.select(docs[id_col].cast("long").alias("doc_id"),
                    F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    crc = F.crc32(F.encode("text", "UTF-8"))
    return d.select("doc_id", (F.octet_length("text").cast("long") + 1).alias("size"),
                    crc.alias("text_crc32"),
                    F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text"))
                           .otherwise(F.xxhash64("doc_id")), F.lit(SLOTS)).cast("int").alias("vslot"))


def slot_bytes(rows: DataFrame) -> list[int]:
    """Bytes of each slot: a list of ``SLOTS`` numbers."""
    got = dict(rows.groupBy("vslot").agg(F.sum("size")).collect())
    return [got.get(s, 0) for s in range(SLOTS)]


def rebalance(weights: list[int], shards: int, old: list[int] | None = None,
              slack: float = 0.0) -> list[int]:
    """Shard of each slot.  Without an old map: largest slot first, each to the lightest shard.
    With one: only as many slots move as bring every shard to the mean plus ``slack``, the
    largest that fit first.  Equal sizes are decided by the slot's number."""
    order = sorted(range(len(weights)), key=lambda s: (-weights[s], s))
    if old is None:
        heap, out = [(0, 0, k) for k in range(shards)], [0] * len(weights)
        for s in order:
            held, n, k = heapq.heappop(heap)
            out[s] = k
            heapq.heappush(heap, (held + weights[s], n + 1, k))
        return out
    out, held = list(old), [0] * shards
    for s, k in enumerate(out):
        held[k] += weights[s]
    most = sum(weights) / shards * (1 + slack)
    targets = sorted(set(range(shards)) - set(old)) or range(shards)  # growing fills new shards only
    for s in order:
        low = min(targets, key=lambda k: (held[k], k))
        if held[out[s]] > most and out[s] != low and held[low] + weights[s] <= most:
            held[out[s]] -= weights[s]
            held[low] += weights[s]
            out[s] = low
    return out


def save_map(spark: SparkSession, path: str, version: int, shard_of: list[int],
             weights: list[int]) -> None:
    """Store one version of the map; earlier versions stay."""
    rows = [(s, k, w) for s, (k, w) in enumerate(zip(shard_of, weights))]
    (spark.createDataFrame(rows, "vslot int, shard int, bytes long").coalesce(1)
     .write.parquet(f"{path}/version={version}"))


def load_map(spark: SparkSession, path: str, version: int) -> list[int]:
    got = dict(spark.read.parquet(f"{path}/version={version}").select("vslot", "shard").collect())
    return [got[s] for s in range(SLOTS)]


def placed(rows: DataFrame, shard_of: list[int]) -> DataFrame:
    """Add shard and slot, the place of a row in its shard: gapless from 0, by virtual slot, part
    and id.  Rows are numbered inside parts of slots; the parts' offsets come from their counts."""
    spark = rows.sparkSession
    where = spark.createDataFrame(list(enumerate(shard_of)), "vslot int, shard int")
    # the map has SLOTS rows whatever the data
    r = rows.join(F.broadcast(where), "vslot").withColumn(
        "part", F.pmod(F.xxhash64(F.lit(3), "doc_id", "text_crc32"), F.lit(PARTS)).cast("int"))
    counts = r.groupBy("shard", "vslot", "part").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("vslot", "part").rowsBetween(W.unboundedPreceding, -1)
    base = counts.select("vslot", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("vslot", "part").orderBy("doc_id", "text_crc32", "size")
    return (r.withColumn("rank", F.row_number().over(inside))
            .join(base, ["vslot", "part"])
            .withColumn("slot", F.col("base") + F.col("rank") - 1).drop("base", "rank", "part"))


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text",
          map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, vslot, shard, slot under the law of near equal bytes.

    Version 0 of the map is stored under ``map_path`` if given.  An empty table gives no rows;
    ties are decided by id, then by text; repeated rows get places of their own.
    """
    rows = materialise(slotted(docs, id_col, text_col), "shard-rows")
    weights = slot_bytes(rows)
    shard_of = rebalance(weights, shards)
    if map_path:
        save_map(docs.sparkSession, map_path, 0, shard_of, weights)
    return placed(rows, shard_of)


def write_shards(docs: DataFrame, path: str, shard_of: list[int], id_col: str = "doc_id",
                 text_col: str = "text") -> None:
    """The records themselves, in one folder for each shard."""
    spark = docs.sparkSession
    where = spark.createDataFrame(list(enumerate(shard_of)), "__vslot int, __shard int")
    spot = F.when(docs[id_col].isNull(), F.xxhash64(docs[text_col].cast("string"))).otherwise(
        F.xxhash64(docs[id_col].cast("long")))
    (docs.withColumn("__vslot", F.pmod(spot, F.lit(SLOTS)).cast("int"))
     .join(F.broadcast(where), "__vslot").drop("__vslot")
     .write.partitionBy("__shard").parquet(path))

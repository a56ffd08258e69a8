"""Sharding by jump consistent hashing (Lamping and Veach): a key and the number of shards decide a row's shard without a
ring table, and one more shard takes rows only into itself, 1 / (shards + 1) of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import mix64

#: Buckets of a shard's rows, over which slots are numbered in two steps. With 4,096, a shard of 10**9 rows has
#: about 250,000 in each.
SLOT_BUCKETS = 4096


def mixed_key(ids: np.ndarray) -> np.ndarray:
    """64 well spread bits of an integer key."""
    return mix64(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard, 0 to shards - 1, of each uint64 key."""
    key, at, ahead = keys.astype(np.uint64, copy=True), np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
    while (moving := np.flatnonzero(ahead < shards)).size:
        at[moving] = ahead[moving]
        key[moving] = key[moving] * np.uint64(2862933555777941757) + np.uint64(1)
        ahead[moving] = ((at[moving] + 1) * (float(1 << 31) / ((key[moving] >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
    return at.astype(np.int32)


#: Rows from which a key is split, and as many times fewer keys than rows at most.
HOT_KEY, HOT_SHARE = 10_000, 10_000


def shard_documents(docs: DataFrame, shards: int = 40, hot_key: int = HOT_KEY) -> DataFrame:
    """Puts every row into a shard by doc_id.

    Adds to the columns of ``docs`` (replacing any of the same names): size (UTF-8 bytes of the text, none for null,
    plus 16), text_crc32 (null for a null text), law ('key'), shard, slot (0, 1, ... within the shard) and
    grown_shard (the shard if there were one more). Integer ids are keys as they are, other types by a 64-bit hash. Rows with a null doc_id
    share one fixed key, 0; repeated rows share their shard and take neighbouring slots. Slots follow the mixed key, then checksum and size of
    the text; rows alike in these take any order. An empty table gives an empty result.

    Slots are numbered by counting rows in each (shard, bucket of the key) and adding the row's place in its bucket, so
    no task holds a shard. Keys of more than ``hot_key`` rows (and a HOT_SHARE of all) are buckets of their own, 4,097 each by the checksum,
    so only rows with the same key and text meet. The text is read for its size and checksum and isn't shuffled if the caller drops it.
    """
    own = "key bigint, bucket int, shard int, grown int"

    @F.pandas_udf(own)
    def place(ids: pd.Series) -> pd.DataFrame:
        keys = mixed_key(ids.to_numpy(np.int64))
        return pd.DataFrame({"key": keys.view(np.int64), "bucket": (keys >> np.uint64(52)).astype(np.int32), "shard": jump_hash(keys, shards), "grown": jump_hash(keys, shards + 1)})

    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long")
    made = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    kept = [c for c in docs.columns if c not in made]
    whole = dict(docs.dtypes)["doc_id"] in ("tinyint", "smallint", "int", "bigint")
    own_key = F.col("doc_id").cast("long") if whole else F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))
    key = F.coalesce(own_key, F.lit(0))  # pandas would make a column with nulls float64, which rounds ids above 2**53
    rows = docs.select(F.struct(*kept).alias("row"), size.alias("size"), F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"), place(key).alias("placed"))
    rows = rows.select("row", "size", "text_crc32", F.col("placed.key").alias("key"), F.col("placed.shard").alias("shard"), F.col("placed.bucket").alias("bucket"), F.col("placed.grown").alias("grown_shard"))

    # In a bucket with hot keys: even numbers for what lies between them, odd ones for each, then by checksum.
    often = rows.groupBy("bucket", "key").agg(F.count("*").alias("n")).filter(F.col("n") > max(hot_key, docs.count() // HOT_SHARE))
    hot = F.broadcast(often.groupBy("bucket").agg(F.collect_list("key").alias("hot")))  # fewer than HOT_SHARE keys
    rows = rows.join(hot, "bucket", "left")
    is_hot = F.coalesce(F.array_contains("hot", F.col("key")), F.lit(False))
    between = F.coalesce(F.size(F.filter("hot", lambda x: x < F.col("key"))) * 2, F.lit(0)) + is_hot.cast("int")
    part = F.when(is_hot, F.coalesce(F.shiftright("text_crc32", 20), F.lit(-1))).otherwise(0).cast("int")
    rows = rows.withColumns({"between": F.when(F.col("hot").isNull(), 0).otherwise(between), "part": part}).drop("hot").repartition("shard", "bucket", "between", "part")
    group = ["shard", "bucket", "between", "part"]
    before = Window.partitionBy("shard").orderBy(*group[1:]).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*group).agg(F.count("*").alias("n"))
    start = counts.select(*group, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy(*group).orderBy("key", "text_crc32", "size")
    numbered = rows.withColumn("at", F.row_number().over(within) - 1).join(start, group)
    return numbered.select(*(F.col("row")[c].alias(c) for c in kept), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("at")).alias("slot"), "grown_shard")

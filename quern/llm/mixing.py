"""Mixing sources to target weights by hash-threshold histograms.

A source's target is its share of all words by weight, at most ``cap`` times what it has, the excess shared again by
weight until no target is above its cap. A source that must give more than it has is taken whole as often as that fits; the
rest of the target comes from documents whose hash is under the source's threshold. Thresholds are found without
sorting: words are summed by source and leading hash bits, the bucket in which the running sum passes the budget is refined
by the next bits, level by level, until the hash is used up. Thresholds nest: a larger target keeps every document that a
smaller one takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import settle

#: A document's hash has LEVELS * BITS bits, as many as a level's histogram has for each source.
LEVELS, BITS = 4, 12
_WIDE = "decimal(19,0)"
WORD = r"[^\x20\x09-\x0D]+"


def document_hash(salt: str = "mix"):
    """48 bits from the MD5 of doc_id, so other engines can compute them."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 12), 16, 10).cast("long")


def ranked(names: DataFrame) -> DataFrame:
    """source and place (from 0, by code point, null last) of distinct sources, numbered without meeting in one
    task: by ranges, then within each."""
    held = settle(names.repartitionByRange(F.col("source").isNull(), "source").withColumn("_range", F.spark_partition_id()))
    counts = held.groupBy("_range").agg(F.count("*").alias("_n"))
    start = counts.select(F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(F.col("source").asc_nulls_last())) - 1
    return held.withColumn("_at", within).join(start, F.col("_range") == F.col("_r")).select("source", (F.col("_start") + F.col("_at")).alias("place"))


def targets(sizes: DataFrame, weight, cap: int) -> DataFrame:
    """Adds target to (source, source_size, place): its part by weight of the sum of source_size, at most
    ``cap`` times its source_size, the excess shared again until none is above."""
    rows = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * cap)
    level, full = None, F.lit(False)
    total = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    while True:
        now = rows.agg(F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)), F.count(F.when(full, 1))).first()
        left, weights, n = total - now[0], now[1], now[2]
        if level == n or not weights:
            break
        # full: a source that the words left, shared by weight, would lift to its cap or above it. Taking out full sources never lowers
        # left / weights, as each takes less than its part, so a source once full stays so and the last condition says it all.
        level, full = n, F.lit(left).cast(_WIDE) * F.col("weight") >= F.col("most").cast(_WIDE) * F.lit(weights)
    share = (F.lit(left) * F.col("weight")).cast("double") / F.lit(float(max(weights, 1)))
    return rows.select("source", "source_size", F.when(full, F.col("most").cast("double")).otherwise(share).alias("target"))


def thresholds(docs: DataFrame, budgets: DataFrame) -> DataFrame:
    """source, threshold: the words of the documents (source, hash, size) with hash < threshold come as near to the budget as
    a threshold can: of the two around the boundary document, the one that misses by less."""
    found = budgets.select("source", F.col("budget").alias("left"), F.lit(0).cast("long").alias("start"))
    for k in range(LEVELS):
        shift = BITS * (LEVELS - 1 - k)
        d, f = docs.alias("d"), found.alias("f")
        at = F.shiftright("d.hash", shift + BITS) == F.shiftright("f.start", shift + BITS)
        inside = d.join(f, F.col("d.source").eqNullSafe(F.col("f.source")) & at) if k else d
        sums = inside.groupBy("d.source", F.shiftright("d.hash", shift).alias("bucket")).agg(F.sum("d.size").alias("words")).filter("words > 0")
        upto = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))).alias("s")
        over = upto.join(f, F.col("s.source").eqNullSafe(F.col("f.source"))).filter("s.upto > f.left")
        first = over.groupBy("f.source").agg(F.min(F.struct("s.bucket", "s.words", (F.col("f.left") - F.col("s.upto") + F.col("s.words")).alias("left"))).alias("m"))
        found = settle(first.select("source", F.col("m.left").alias("left"), F.shiftleft("m.bucket", shift).alias("start"), F.col("m.words").alias("words")))
    return found.select("source", (F.col("start") + F.when(F.col("words") < 2 * F.col("left"), 1).otherwise(0)).alias("threshold"))


#: Sources up to which their plan is broadcast: about 100 bytes each.
MOST_BROADCAST = 20_000


def plan(docs: DataFrame, cap: int, weight) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, hash) of every row, and (_name, source_size, target, whole, threshold) of every source."""
    weight = F.pmod("place", F.lit(3)) + 1 if weight is None else weight
    slim = settle(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), document_hash().alias("hash")))
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    places = ranked(sizes.select("source")).withColumnRenamed("source", "_name")
    goal = settle(targets(sizes.join(places, F.col("source").eqNullSafe(F.col("_name"))).drop("_name"), weight, cap))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goal = goal.withColumn("whole", whole.cast("long")).withColumn("budget", F.floor(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    limit = thresholds(slim, goal.filter("source_size > 0 and budget > 0"))
    both = goal.alias("g").join(limit.alias("t"), F.col("g.source").eqNullSafe(F.col("t.source")), "left")
    by_source = settle(both.select(F.col("g.source").alias("_name"), "source_size", "target", "whole", F.coalesce("threshold", F.lit(0)).alias("threshold")))
    return slim, F.broadcast(by_source) if by_source.count() <= MOST_BROADCAST else by_source


def _copies():
    return F.col("whole") + F.when(F.col("hash") < F.col("threshold"), 1).otherwise(0)


def mix(docs: DataFrame, cap: int = 3, weight=None) -> DataFrame:
    """doc_id, size (words), source, source_size, target (of its source) and taken (words the mix takes, repeats
    counted) of every row.

    ``weight``: a column of ``place`` (the source's number by code point, null last); by default 1, 2, 3, repeating. Null
    texts have size 0; null is a source like any other; rows with one doc_id are taken or left together within a source
    (a null doc_id counts as one), so the mix misses a target by at most half of such a group's words. Without words, all targets
    are 0. An empty table gives an empty result. No row is taken more than ``cap`` times.
    """
    slim, by_source = plan(docs, cap, weight)
    return slim.join(by_source, F.col("source").eqNullSafe(F.col("_name"))).select("doc_id", "size", "source", "source_size", "target", (F.col("size") * _copies()).alias("taken"))


def mixed_documents(docs: DataFrame, cap: int = 3, weight=None) -> DataFrame:
    """The columns of ``docs`` for the rows that the mix takes at least once, and copies, how often."""
    _, by_source = plan(docs, cap, weight)
    rows = docs.select(F.struct(*docs.columns).alias("row"), document_hash().alias("hash"))  # apart from the plan's names
    rows = rows.join(by_source, F.col("row.source").eqNullSafe(F.col("_name"))).withColumn("copies", _copies().cast("int"))
    return rows.filter("copies > 0").select(*(F.col("row")[c].alias(c) for c in docs.columns if c != "copies"), "copies")

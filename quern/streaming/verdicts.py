"""Verdicts over arriving archives with Structured Streaming (an extension: the batch operators, on a stream)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import parse, verify


def streamed_summaries(archives: DataFrame) -> DataFrame:
    """Counts by archive over a stream of (archive_id, volume, content) of single archives; state is a row of counts for each archive."""
    return verify.summary(verify.verdicts(parse.blocks(archives).filter(verify.is_judged())))


def windowed_damage(archives: DataFrame, time: str, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Entries and damaged ones by window of arrival; rows later than ``late`` are left out."""
    judged = verify.verdicts(parse.blocks(archives.select(F.concat_ws("|", "archive_id", F.col(time).cast("string")).alias("archive_id"), "volume", "content")).filter(verify.is_file()))
    timed = judged.withColumn("at", F.substring_index("archive_id", "|", -1).cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width).alias("window")).agg(F.count("*").alias("entries"), F.count_if(F.col("status") == verify.MISMATCH).alias("damaged"))

"""Assembly across volumes, verdicts of entries and archives, listings."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import METHODS, compression_fields, empty, label, ratio_percent

OK, MISMATCH, NO_CHECKSUM, UNSUPPORTED, ERROR = range(5)
VERIFIED, DAMAGED, INCOMPLETE = range(3)


def is_file() -> Column:
    return ((F.col("family") == 50) & (F.col("type") == 2)) | ((F.col("family") == 15) & (F.col("type") == 0x74))


def headers_encrypted() -> Column:
    """The block after which everything, headers too, is encrypted."""
    return ((F.col("family") == 50) & (F.col("type") == 4)) | ((F.col("family") == 15) & (F.col("type") == 0x73) & F.coalesce("is_encrypted", F.lit(False)))


def is_judged() -> Column:
    """Files, and the block (without a name) that stands for those hidden behind encrypted headers."""
    return is_file() | headers_encrypted()


def _stored() -> Column:
    return F.when(F.col("family") == 15, F.col("info") == 0).otherwise(compression_fields("info")["method"] == 0)


def _run(order: Window) -> Column:
    """Numbers the runs of pieces: one continues the piece before it only in the next volume."""
    opens = ~F.col("split_before") | (F.lag("name").over(order).isNull()) | (F.lag("name").over(order) != F.col("name")) | ~F.lag("split_after").over(order) | (F.lag("volume").over(order) + 1 != F.col("volume"))
    return F.sum(F.when(opens, 1).otherwise(0)).over(order)


def _joined_payload() -> Column:
    return F.coalesce(F.expr("listagg(payload) within group (order by volume, block)"), empty())


def blake2sp(data: bytes) -> bytes:
    """BLAKE2sp: 64-byte blocks dealt to eight leaves, whose digests a root hashes."""
    leaves = []
    for i in range(8):
        leaf = hashlib.blake2s(fanout=8, depth=2, inner_size=32, node_offset=i, node_depth=0, last_node=i == 7)
        for at in range(64 * i, len(data), 512):
            leaf.update(data[at : at + 64])
        leaves.append(leaf.digest())
    root = hashlib.blake2s(fanout=8, depth=2, inner_size=32, node_depth=1, last_node=True)
    root.update(b"".join(leaves))
    return root.digest()


@F.pandas_udf(T.BinaryType())
def blake2sp_udf(payload: pd.Series) -> pd.Series:
    return payload.map(lambda x: None if x is None else blake2sp(bytes(x)))


def assembled(blocks: DataFrame) -> DataFrame:
    """Logical files: an opener and the pieces that continue it in the next volumes, without a gap. complete: the run has
    its opener and its last piece; parts_ok: every leading piece has the checksum of its bytes."""
    own = blocks.filter(is_judged()).select("archive_id", "volume", "block", "family", "name", "size", "mtime", "crc", "info", "is_directory", "is_encrypted", "split_before", "split_after", "payload", "blake2sp")
    runs = own.withColumn("run", _run(Window.partitionBy("archive_id").orderBy("volume", "block")))
    ends = F.struct("volume", "block")
    part_ok = F.when(F.col("split_after") & ~F.col("is_encrypted") & F.col("crc").isNotNull(), F.crc32("payload") == F.col("crc")).otherwise(True)
    return runs.groupBy("archive_id", "run").agg(
        F.min_by("name", ends).alias("name"), F.min_by("size", ends).alias("size"), F.min_by("mtime", ends).alias("mtime"), F.min_by("info", ends).alias("info"), F.first("family").alias("family"),
        F.max_by("crc", ends).alias("crc"), F.max_by("blake2sp", ends).alias("blake2sp"), F.bool_or("is_directory").alias("is_directory"), F.bool_or("is_encrypted").alias("is_encrypted"),
        (~F.min_by("split_before", ends) & ~F.max_by("split_after", ends)).alias("complete"), F.bool_and(part_ok).alias("parts_ok"), F.count("*").alias("pieces"),
        _joined_payload().alias("payload"),
    )


def blake_of(payload: str, where: Column) -> Column:
    """The digest of the payloads for which ``where`` holds; no others are hashed, as they reach Python as nulls."""
    return blake2sp_udf(F.when(where, F.col(payload)))


def verdicts(files: DataFrame) -> DataFrame:
    """Adds bytes_verified, crc_actual, blake_actual and status to files (name, size, crc, blake2sp, info, payload, is_directory,
    is_encrypted). Every checksum that an entry has is compared. Only stored payloads can be hashed; others are UNSUPPORTED,
    which is never damage."""
    stored = F.coalesce(_stored(), F.lit(False))
    readable = ~F.col("is_directory") & ~F.col("is_encrypted") & stored
    rows = files.withColumn("crc_actual", F.when(readable, F.crc32("payload"))).withColumn("bytes_verified", F.when(readable, F.octet_length("payload")).otherwise(0).cast("long"))
    wrong = (F.col("bytes_verified") != F.col("size")) | (F.col("crc").isNotNull() & (F.col("crc") != F.col("crc_actual")))
    rows = rows.withColumn("blake_actual", blake_of("payload", readable & F.col("blake2sp").isNotNull()))
    wrong = wrong | (F.col("blake2sp").isNotNull() & (F.col("blake2sp") != F.col("blake_actual")))
    has_sum = F.col("crc").isNotNull() | F.col("blake2sp").isNotNull()
    status = F.when(F.col("is_directory"), OK).when(F.col("is_encrypted") | ~stored, UNSUPPORTED).when(wrong, MISMATCH).when(~has_sum, NO_CHECKSUM).otherwise(OK)
    return rows.withColumn("status", status)


def summary(verdict: DataFrame) -> DataFrame:
    """Counts and status of each archive. One with encrypted headers shows no entries, which makes it INCOMPLETE."""
    count = lambda cond: F.count_if(cond).cast("long")
    named = F.col("name").isNotNull()
    plain = ~F.col("is_directory") & named
    rolled = verdict.groupBy("archive_id").agg(
        F.count("name").alias("entry_count"), count(plain & (F.col("status") == OK)).alias("verified"), count(plain & (F.col("status") == MISMATCH)).alias("damaged"), count(plain & (F.col("status") == NO_CHECKSUM)).alias("no_checksum"),
        count(plain & (F.col("status") == UNSUPPORTED)).alias("unsupported"), count(plain & (F.col("status") == ERROR)).alias("error_count"), count("is_directory").alias("directory_count"), count(named & F.col("is_encrypted")).alias("encrypted_count"),
        F.bool_or(~named).alias("headers_encrypted"),
    )
    unread = (F.col("unsupported") > 0) | F.col("headers_encrypted")
    status = F.when(F.col("damaged") + F.col("error_count") > 0, DAMAGED).when(unread | (F.col("no_checksum") > 0), INCOMPLETE).otherwise(VERIFIED)
    leaves = F.when(F.col("damaged") + F.col("error_count") > 0, 1).when(unread, 69).when(F.col("no_checksum") > 0, 65).otherwise(0)
    return rolled.withColumn("status", status).withColumn("exit_code", leaves)


#: What can be wrong besides what ends a walk (see ``parse``), as codes.
HEADERS_ENCRYPTED, HEADER_DIFFERS, COMMENT_DIFFERS, PAYLOAD_MISSING, VOLUME_MISSING = "HEADERS_ENCRYPTED", "HEADER_DIFFERS", "COMMENT_DIFFERS", "PAYLOAD_MISSING", "VOLUME_MISSING"
CRC32_DIFFERS, BLAKE2SP_DIFFERS, PART_CRC32_DIFFERS, PART_BLAKE2SP_DIFFERS = "CRC32_DIFFERS", "BLAKE2SP_DIFFERS", "PART_CRC32_DIFFERS", "PART_BLAKE2SP_DIFFERS"


def _judged_rows(rows: DataFrame, at: Column) -> DataFrame:
    """What ``_judged_runs`` gives of rows that are all runs of their own."""
    where = lambda c: F.when(F.col(c).isNotNull(), at)
    runs = rows.withColumns({"complete": ~F.col("split_before") & ~F.col("split_after"), "at": where("wrong"), "more_at": where("next_volume"), "last": at})
    lost = F.col("split") & ~F.col("complete")
    return runs.select(
        "archive_id", "family", F.col("type").isNotNull().cast("long").alias("blocks"), F.col("is_piece").cast("long").alias("files"), "is_encrypted", "hidden", "skipped", "split", "complete",
        F.coalesce("at", F.when(lost, F.col("last"))).alias("at"), F.coalesce("wrong", F.when(lost, VOLUME_MISSING)).alias("wrong"),
        F.col("volume_number").alias("last_number"), F.col("volume_number").isNotNull().cast("int").alias("numbers"), F.col("next_volume").alias("more"), "more_at",
    )


def _judged_runs(rows: DataFrame, at: Column, order: Window) -> DataFrame:
    """The runs of an archive's pieces, each with the first thing wrong and its place."""
    runs = rows.withColumn("run", _run(order)).groupBy("archive_id", "is_piece", "run").agg(
        F.max("family").alias("family"), F.count("type").alias("blocks"), F.count_if("is_piece").alias("files"), F.bool_or("is_encrypted").alias("is_encrypted"), F.bool_or("hidden").alias("hidden"), F.bool_or("skipped").alias("skipped"),
        F.min_by("wrong", F.when(F.col("wrong").isNotNull(), at)).alias("wrong"), F.min(F.when(F.col("wrong").isNotNull(), at)).alias("at"), F.max(at).alias("last"), F.bool_or("split").alias("split"),
        (~F.min_by("split_before", at) & ~F.max_by("split_after", at)).alias("complete"), F.max_by("crc", at).alias("crc"), F.max_by("blake2sp", at).alias("blake2sp"), _joined_payload().alias("payload"),
        F.max("volume_number").alias("last_number"), F.size(F.collect_set("volume_number")).alias("numbers"), F.max_by("next_volume", F.when(F.col("next_volume").isNotNull(), at)).alias("more"), F.max(F.when(F.col("next_volume").isNotNull(), at)).alias("more_at"),
    )
    whole = F.col("split") & F.col("complete") & ~F.col("skipped")
    runs = runs.withColumn("blake_actual", blake_of("payload", whole & F.col("blake2sp").isNotNull()))
    joined = F.when(whole & (F.crc32("payload") != F.col("crc")), CRC32_DIFFERS).when(whole & (F.col("blake_actual") != F.col("blake2sp")), BLAKE2SP_DIFFERS)
    joined = F.when(F.col("split") & ~F.col("complete"), VOLUME_MISSING).otherwise(joined)
    return runs.withColumn("at", F.coalesce("at", F.when(joined.isNotNull(), F.col("last")))).withColumn("wrong", F.coalesce("wrong", joined))


def validation(blocks: DataFrame, single: bool = False) -> DataFrame:
    """One verdict for each archive: the first thing wrong, in block order, or none; with counts of what was read.

    Stored payloads are compared with every checksum they have, those of split entries once their pieces are joined (at the
    last piece); leading pieces with the checksum of their own bytes. A split entry of which a piece is missing, or a set of which a volume is
    (a number is skipped, or the last volume announces another), isn't valid. unverified counts entries that can't be verified: encrypted and compressed
    ones, and split ones of which a piece is missing. An archive with encrypted headers isn't valid and has headers_encrypted set, as
    nothing is known of its contents; nor is one of a family that isn't read here. An entry without a checksum passes, and lengths aren't compared: ``verdicts`` does both.

    single: every archive_id has one volume. An entry continues only in the next volume, so then no pieces are looked for and no payloads travel."""
    at, order = F.struct("volume", "block"), Window.partitionBy("archive_id", "is_piece").orderBy("volume", "block")
    file = F.coalesce(is_file(), F.lit(False))
    plain = file & ~F.col("is_directory") & ~F.col("is_encrypted")
    split, stored = plain & (F.col("split_before") | F.col("split_after")), F.coalesce(_stored(), F.lit(False))
    own = (plain & ~split & stored) | (plain & F.col("split_after"))
    rows = blocks.withColumns({"is_piece": file, "blake_actual": blake_of("payload", own & F.col("blake2sp").isNotNull())})
    part = lambda own, whole: F.when(F.col("split_after"), own).otherwise(whole)
    wrong = F.when(F.col("error").isNotNull(), F.col("error")).when(~F.col("crc_ok"), HEADER_DIFFERS).when(headers_encrypted(), HEADERS_ENCRYPTED).when(~F.col("comment_ok"), COMMENT_DIFFERS)
    wrong = wrong.when(plain & ~split & (F.col("family") == 50) & (F.col("size") > 0) & (F.col("data_size") == 0), PAYLOAD_MISSING)
    wrong = wrong.when(own & (F.crc32("payload") != F.col("crc")), part(PART_CRC32_DIFFERS, CRC32_DIFFERS)).when(own & (F.col("blake_actual") != F.col("blake2sp")), part(PART_BLAKE2SP_DIFFERS, BLAKE2SP_DIFFERS))
    skipped = F.coalesce("is_encrypted", F.lit(False)) | (plain & ~stored)
    rows = rows.select(
        "archive_id", "volume", "block", "family", "type", "name", "crc", "blake2sp", "is_piece", "split_before", "split_after", F.coalesce("is_encrypted", F.lit(False)).alias("is_encrypted"), wrong.alias("wrong"),
        "volume_number", "next_volume", F.coalesce(headers_encrypted() & F.col("crc_ok"), F.lit(False)).alias("hidden"), skipped.alias("skipped"), split.alias("split"), F.when(split & stored, F.col("payload")).alias("payload"),
    )
    found = _judged_rows(rows, at) if single else _judged_runs(rows, at, order)
    found = found.groupBy("archive_id").agg(
        F.max("family").alias("family"), F.sum("blocks").alias("block_count"), F.sum("files").alias("file_count"), F.bool_or("is_encrypted").alias("has_encrypted"), F.bool_or("hidden").alias("headers_encrypted"),
        F.count_if(F.col("skipped") | (F.col("split") & ~F.col("complete"))).alias("unverified"), F.min_by("wrong", "at").alias("error"),
        (F.sum("numbers") <= F.max("last_number")).alias("gap"), F.max_by("more", "more_at").alias("more"),
    )
    missing = F.coalesce("gap", F.lit(False)) | F.coalesce("more", F.lit(False))
    return found.withColumn("error", F.coalesce("error", F.when(missing, VOLUME_MISSING))).withColumn("is_valid", F.col("error").isNull()).drop("gap", "more")


def listing(blocks: DataFrame) -> DataFrame:
    """archive_id, name (folders with a final slash), size, packed, ratio, method and crc of every file block."""
    method = F.when(F.col("family") == 15, F.col("info")).otherwise(compression_fields("info")["method"])
    return blocks.filter(is_file()).select(
        "archive_id", F.concat("name", F.when(F.col("is_directory"), "/").otherwise("")).alias("name"), "size", F.col("data_size").alias("packed"), ratio_percent("data_size", "size").alias("ratio"), label(method, METHODS).alias("method"), "crc", "is_encrypted"
    )


def file_info(blocks: DataFrame) -> DataFrame:
    """archive_id and the fields of every file block that a reader shows; numbers that it lacks are 0."""
    method = F.when(F.col("family") == 15, F.col("info")).otherwise(compression_fields("info")["method"])
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return blocks.filter(is_file()).select(
        "archive_id", "name", "size", F.col("data_size").alias("packed"), number("crc").alias("crc"), number("mtime").alias("mtime"), method.cast("int").alias("method"), "host", number("version").alias("version"),
        "is_directory", "is_encrypted", "split_before", "split_after",
    )


def metadata(blocks: DataFrame) -> DataFrame:
    """archive_id, name, attributes, time and its kind (0: none, 1: Unix seconds, 2: local DOS time), and whether the attributes
    are a POSIX mode."""
    old = F.col("family") == 15
    kind = F.when(F.col("mtime").isNull(), 0).when(old, 2).otherwise(1)
    return blocks.filter(is_file()).select("archive_id", "name", "attributes", "mtime", kind.alias("time_kind"), (F.col("host") == F.when(old, 3).otherwise(1)).alias("has_posix_mode"))


def extract_totals(blocks: DataFrame) -> DataFrame:
    """archive_id, files (without folders) and the bytes that they hold once unpacked; split entries count at their first piece."""
    first = is_file() & ~F.col("split_before")
    return blocks.filter(first).groupBy("archive_id").agg(F.count_if(~F.col("is_directory")).alias("files"), F.sum("size").alias("bytes"))


def solid_runs(rows: DataFrame, key: list[str], order: list[str], resets: str) -> DataFrame:
    """Numbers the runs of rows that share a dictionary: a new one begins wherever ``resets`` is true."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("run", F.sum(F.when(F.col(resets) | (F.row_number().over(w) == 1), 1).otherwise(0)).over(w))

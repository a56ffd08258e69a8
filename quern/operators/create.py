"""Writing archives and volume sets (store method) from rows of entries, as column expressions.

A block is ``crc32 | size | type | flags | [extra size] | [data size] | body | [extra] | data`` with integers in groups of
7 bits. Every archive has a bounded number of entries (see ``sources``), so joining its blocks is a bounded aggregate.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import SIGNATURES, default_attributes, empty, le_bytes, vint, vint_size
from .verify import blake_of

MAIN, FILE, END = 1, 2, 5


def mark() -> Column:
    return F.unhex(F.lit(SIGNATURES[50]))


def constant(*values: int) -> bytes:
    """Numbers below 128 as they stand in a header."""
    return bytes(values)


def framed_constant(header: bytes) -> Column:
    """A fixed short header with its size before it and the checksum of both before that."""
    sized = bytes([len(header)]) + header
    return F.lit(zlib.crc32(sized).to_bytes(4, "little") + sized)


def main_block(volume: Column | None = None) -> Column:
    """volume: the number of a set's volume, from 0, or None for a single archive."""
    if volume is None:
        return framed_constant(constant(MAIN, 0, 0))
    header = F.concat(F.lit(constant(MAIN, 0, 3)), vint(volume))
    sized = F.concat(le_bytes(F.octet_length(header), 1), header)
    return F.when(volume > 0, F.concat(le_bytes(F.crc32(sized), 4), sized)).otherwise(framed_constant(constant(MAIN, 0, 1)))


def end_block(more: Column | None = None) -> Column:
    last = framed_constant(constant(END, 0, 0))
    return last if more is None else F.when(more, framed_constant(constant(END, 0, 1))).otherwise(last)


#: An extra record of type 1 (encryption) without parameters, as a marker: size 2, type 1, one byte.
ENCRYPTED_EXTRA = b"\x02\x01\x00"
#: What stands before the 32 bytes of a BLAKE2sp digest in an extra record of type 2 (hash): size 34, type 2, kind 0.
BLAKE_EXTRA = b"\x22\x02\x00"


def with_blocks(rows: DataFrame, data: Column, crc: Column, before: Column, after: Column, size: Column) -> DataFrame:
    """Adds block, the bytes of a file block with ``data`` of an entry of ``size`` bytes, to rows of name, mtime, is_directory, is_encrypted and
    has_crc. Where a column _hash is there and not null, the block has it as its BLAKE2sp record. A step for each part, so that none
    is computed twice; numbers that stay below 128 are single bytes."""
    hashed = F.col("_hash") if "_hash" in rows.columns else F.lit(None).cast("binary")
    flags = F.when(F.col("is_encrypted") | hashed.isNotNull(), 1).otherwise(0) + F.when(F.octet_length(data) > 0, 2).otherwise(0) + F.when(before, 8).otherwise(0) + F.when(after, 16).otherwise(0)
    kind = F.when(F.col("is_directory"), 1).otherwise(0) + 2 + F.when(F.col("has_crc"), 4).otherwise(0)
    rows = rows.withColumns({"_data": data, "_name": F.encode("name", "UTF-8"), "_crc": crc, "_flags": le_bytes(flags, 1), "_kind": le_bytes(kind, 1)})
    extra = F.concat(F.when(F.col("is_encrypted"), F.lit(ENCRYPTED_EXTRA)).otherwise(empty()), F.when(hashed.isNotNull(), F.concat(F.lit(BLAKE_EXTRA), hashed)).otherwise(empty()))
    extra_size = F.when(F.octet_length(extra) > 0, le_bytes(F.octet_length(extra), 1)).otherwise(empty())
    header = F.concat(
        F.lit(constant(FILE)), F.col("_flags"), extra_size, F.when(F.octet_length("_data") > 0, vint(F.octet_length("_data"))).otherwise(empty()),
        F.col("_kind"), vint(size), le_bytes(default_attributes(F.lit(0), "is_directory"), 1), le_bytes("mtime", 4), F.when(F.col("has_crc"), le_bytes("_crc", 4)).otherwise(empty()),
        F.lit(constant(0, 1)), vint(F.octet_length("_name")), F.col("_name"), extra,
    )
    rows = rows.withColumn("_header", header)
    rows = rows.withColumn("_sized", F.concat(vint(F.octet_length("_header")), F.col("_header")))
    made = rows.withColumn("block", F.concat(le_bytes(F.crc32("_sized"), 4), F.col("_sized"), F.col("_data")))
    return made.drop("_data", "_name", "_crc", "_hash", "_flags", "_kind", "_header", "_sized")


def block_size(data: Column, name: str = "name") -> Column:
    """Bytes of ``with_blocks`` for a plain file with a checksum, without writing it."""
    n, named = F.octet_length(data), F.octet_length(F.encode(name, "UTF-8"))
    header = 1 + 1 + F.when(n > 0, vint_size(n)).otherwise(0) + 1 + vint_size(n) + 1 + 4 + 4 + 1 + 1 + vint_size(named) + named
    return (4 + vint_size(header) + header + n).cast("long")


def _joined(rows: DataFrame, keys: list[str], order: str, before: Column, after: Column) -> DataFrame:
    grouped = rows.groupBy(*keys).agg(F.expr(f"listagg(block) within group (order by {order})").alias("parts"))
    return grouped.withColumn("content", F.concat(before, F.coalesce("parts", empty()), after)).drop("parts")


def archives(entries: DataFrame, alone: bool = False) -> DataFrame:
    """archive_id, volume (0) and content of one archive for each archive_id, entries in their order. A column written,
    if there, holds the bytes that are stored in place of the payload that the header describes; has_blake, if there, says
    which entries have a BLAKE2sp record. alone: every archive_id has one entry, so that nothing needs to be brought together."""
    data = F.col("written") if "written" in entries.columns else F.col("payload")
    if "has_blake" in entries.columns:
        entries = entries.withColumn("_hash", blake_of("payload", F.col("has_blake")))
    blocks = with_blocks(entries, data, F.crc32("payload"), F.lit(False), F.lit(False), F.octet_length("payload"))
    start, end = F.concat(mark(), main_block()), end_block()
    done = blocks.withColumn("content", F.concat(start, F.col("block"), end)) if alone else _joined(blocks.select("archive_id", "entry", "block"), ["archive_id"], "entry", start, end)
    return done.select("archive_id", F.lit(0).alias("volume"), "content")


def pieces(entries: DataFrame, volume_bytes: int) -> DataFrame:
    """The entries cut where the archive's payload stream, in entry order, passes a multiple of ``volume_bytes``, as ``_cut`` has
    them. An empty entry is one empty piece."""
    upto = F.sum(F.octet_length("payload")).over(Window.partitionBy("archive_id").orderBy("entry"))
    rows = entries.withColumn("_upto", upto).withColumn("_from", upto - F.octet_length("payload"))
    rows = rows.withColumns({"_first": F.floor(F.col("_from") / volume_bytes), "_last": F.floor(F.greatest("_from", F.col("_upto") - 1) / volume_bytes)})
    rows = rows.withColumn("last", F.max("_last").over(Window.partitionBy("archive_id")))
    start, end = lambda v: F.greatest("_from", v * volume_bytes), lambda v: F.least("_upto", (v + 1) * volume_bytes)
    places = F.transform(F.sequence("_first", "_last"), lambda v: F.struct(v.alias("volume"), (start(v) - F.col("_from")).alias("from"), (end(v) - F.col("_from")).alias("to")))
    return _cut(rows.withColumn("_places", places).drop("_upto", "_from", "_first", "_last"))


def _cut(rows: DataFrame) -> DataFrame:
    """A row for each of an entry's _places (volume, from, to). In place of the payload, which would travel with each of its pieces,
    rows have size, _crc_whole, _hash_whole (with has_blake), volume, piece (bytes), split_before and split_after."""
    n = F.octet_length("payload")
    whole = {"size": n, "_crc_whole": F.crc32("payload")}
    if "has_blake" in rows.columns:
        whole["_hash_whole"] = blake_of("payload", F.col("has_blake"))
    piece = lambda p: F.substring("payload", (p["from"] + 1).cast("int"), (p["to"] - p["from"]).cast("int"))
    parts = F.transform("_places", lambda p: F.struct(p["volume"].alias("volume"), piece(p).alias("piece"), (p["from"] > 0).alias("split_before"), (p["to"] < n).alias("split_after")))
    rows = rows.withColumns(whole | {"_parts": parts}).drop("payload", "_places")
    return rows.withColumn("_part", F.explode("_parts")).select(*(c for c in rows.columns if c != "_parts"), "_part.*")


def _vint_len(n: int) -> int:
    return max(1, -(-n.bit_length() // 7))


def fill(sizes: list[tuple], volume_bytes: int) -> list[tuple]:
    """(place, volume, from, to) of the pieces of entries given as (payload bytes, bytes of a header's fields, bytes of a digest
    record): each volume is filled up to ``volume_bytes``, its mark and headers counted. What doesn't fit an empty volume raises ValueError."""
    fixed = lambda v: 8 + 8 + (_vint_len(v) if v else 0) + 8  # noqa: E731  mark, main block, end block

    def block(n: int, d: int, own: int) -> int:
        header = own + _vint_len(n) + (_vint_len(d) if d else 0)
        return 4 + _vint_len(header) + header + d

    out, volume, used = [], 0, fixed(0)
    for place, (n, own) in enumerate(sizes):
        start = 0
        while True:
            room = volume_bytes - used
            d = min(n - start, max(0, room - block(n, 0, own)))
            while d > 0 and block(n, d, own) > room:  # the size of the size
                d -= 1
            if block(n, d, own) <= room and (d > 0 or n == start):
                out.append((place, volume, start, start + d))
                used += block(n, d, own)
                start += d
                if start == n:
                    break
            elif used == fixed(volume):
                raise ValueError(f"a header doesn't fit a volume of {volume_bytes} bytes")
            volume += 1
            used = fixed(volume)
    return out


def pieces_by_file(entries: DataFrame, volume_bytes: int) -> DataFrame:
    """As ``pieces``, but cut so that each volume's file has at most ``volume_bytes``. The layout is found from sizes alone, one bounded
    archive at a time; payloads are cut by expressions."""
    named = F.octet_length(F.encode("name", "UTF-8"))
    extra = F.when(F.col("is_encrypted"), len(ENCRYPTED_EXTRA)).otherwise(0)
    if "has_blake" in entries.columns:
        extra = extra + F.when(F.col("has_blake"), len(BLAKE_EXTRA) + 32).otherwise(0)
    own = 1 + 1 + F.when(extra > 0, 1).otherwise(0) + 1 + 1 + 4 + F.when(F.col("has_crc"), 4).otherwise(0) + 1 + 1 + vint_size(named) + named + extra
    slim = entries.select("archive_id", "entry", F.octet_length("payload").alias("n"), own.alias("own"))
    places = pa.list_(pa.struct([("volume", pa.int64()), ("from", pa.int64()), ("to", pa.int64())]))

    def lay(part: pa.Table) -> pa.Table:
        part = part.sort_by("entry")
        rows = fill(list(zip(part.column("n").to_pylist(), part.column("own").to_pylist(), strict=True)), volume_bytes)
        of: list[list[dict]] = [[] for _ in range(part.num_rows)]
        for place, volume, start, end in rows:
            of[place].append({"volume": volume, "from": start, "to": end})
        last = pa.array([rows[-1][1]] * part.num_rows, pa.int64())
        return pa.table({"archive_id": part.column("archive_id"), "entry": part.column("entry"), "last": last, "_places": pa.array(of, places)})

    layout = slim.groupBy("archive_id").applyInArrow(lay, "archive_id string, entry long, last long, _places array<struct<volume: long, from: long, to: long>>")
    return _cut(entries.join(layout, ["archive_id", "entry"]))


def volumes(entries: DataFrame, volume_bytes: int, headers_count: bool = False) -> DataFrame:
    """archive_id, volume and content of volume sets. Every piece repeats the entry's size; the checksums are the
    piece's own, but the whole entry's in its last piece. has_blake, if there, is as in ``archives``. ``volume_bytes`` are of the
    payload in a volume or, if ``headers_count``, of its whole file."""
    cut = pieces_by_file(entries, volume_bytes) if headers_count else pieces(entries, volume_bytes)
    if "has_blake" in cut.columns:
        cut = cut.withColumn("_hash", F.when(F.col("split_after"), blake_of("piece", F.col("has_blake") & F.col("split_after"))).otherwise(F.col("_hash_whole")))
    crc = F.when(F.col("split_after"), F.crc32("piece")).otherwise(F.col("_crc_whole"))
    blocks = with_blocks(cut, F.col("piece"), crc, F.col("split_before"), F.col("split_after"), F.col("size"))
    joined = _joined(blocks.select("archive_id", "volume", "last", "entry", "block"), ["archive_id", "volume", "last"], "entry", empty(), empty())
    content = F.concat(mark(), main_block(F.col("volume")), F.col("content"), end_block(F.col("volume") < F.col("last")))
    return joined.select("archive_id", F.col("volume").cast("int").alias("volume"), content.alias("content"))


def old_archives(entries: DataFrame) -> DataFrame:
    """Archives of the older family: fixed fields, 16-bit header checksums, local DOS times (here 2020-01-01)."""
    encoded = F.encode("name", "UTF-8")
    n = F.octet_length("payload")
    fields = F.concat(
        F.unhex(F.lit("74")), le_bytes(F.when(F.col("is_encrypted"), 4).otherwise(0) + 32768, 2), le_bytes(32 + F.octet_length(encoded), 2), le_bytes(n, 4),
        le_bytes(n, 4), le_bytes(F.lit(3), 1), le_bytes(F.crc32("payload"), 4), le_bytes(F.lit(40 * 33554432 + 2097152 + 65536), 4), le_bytes(F.lit(20), 1), le_bytes(F.lit(0x30), 1), le_bytes(F.octet_length(encoded), 2), le_bytes(F.lit(32), 4), encoded,
    )
    blocks = entries.withColumn("block", F.concat(le_bytes(F.crc32(fields).bitwiseAND(F.lit(65535)), 2), fields, F.col("payload")))
    main = F.unhex(F.lit("730000" + "0D00" + "000000000000"))
    end = F.unhex(F.lit("7B00400700"))
    close = lambda h: F.concat(le_bytes(F.crc32(h).bitwiseAND(F.lit(65535)), 2), h)
    done = _joined(blocks.select("archive_id", "entry", "block"), ["archive_id"], "entry", F.concat(F.unhex(F.lit(SIGNATURES[15])), close(main)), close(end))
    return done.select("archive_id", F.lit(0).alias("volume"), "content")

"""Column functions over archive fields: integers packed as bytes, times, sizes, names, codes. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def empty() -> Column:
    """No bytes."""
    return F.expr("X''")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- integers as bytes

def le_bytes(v, n: int) -> Column:
    """The low ``n`` bytes of a non-negative integer, lowest first."""
    digits = F.lpad(F.hex(col(v).cast("long")), 2 * n, "0")
    return F.unhex(F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in reversed(range(n)))))


def vint_size(v) -> Column:
    """Bytes of a non-negative integer in groups of 7 bits."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(col(v).cast("long"))) / 7)).cast("int")


def vint(v) -> Column:
    """A non-negative integer in groups of 7 bits, lowest first, the high bit set on all but the last."""
    v = col(v).cast("long")

    def group(i: Column) -> Column:
        rest = F.call_function("shiftright", v, (i * 7).cast("int"))
        return F.lpad(F.hex(rest.bitwiseAND(F.lit(127)) + F.when(i < vint_size(v) - 1, 128).otherwise(0)), 2, "0")

    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), vint_size(v) - 1), group), ""))


# ---------------------------------------------------------------- times

def dos_time_encode(ts) -> Column:
    """A local time as 7 + 4 + 5 + 5 + 6 + 5 bits (years from 1980, two-second steps); null outside 1980 to 2107."""
    ts = col(ts)
    year = F.year(ts)
    packed = (year - 1980) * 33554432 + F.month(ts) * 2097152 + F.dayofmonth(ts) * 65536 + F.hour(ts) * 2048 + F.minute(ts) * 32 + F.floor(F.second(ts) / 2)
    return F.when(year.between(1980, 2107), packed.cast("long"))


def dos_time_decode(v) -> Column:
    """The local time of a packed one; null where it isn't a real date or time."""
    v = col(v).cast("long")
    bits = lambda shift, mask: F.shiftright(v, shift).bitwiseAND(F.lit(mask)).cast("int")
    seconds = v.bitwiseAND(F.lit(31)) * 2
    made = F.try_make_timestamp_ntz(bits(25, 127) + 1980, bits(21, 15), bits(16, 31), bits(11, 31), bits(5, 63), seconds.cast("decimal(8,6)"))
    return F.when(seconds < 60, made)


#: 100 ns steps from 1601 to 1970.
EPOCH_TICKS = 116444736000000000


def windows_ticks_to_unix(t) -> Column:
    t = col(t)
    seconds = F.expr("cast(null as bigint)")
    whole = (t - EPOCH_TICKS - F.pmod(t - EPOCH_TICKS, F.lit(10000000))) / 10000000
    return F.when((t >= EPOCH_TICKS) & (whole <= 4294967295), whole.cast("long")).otherwise(seconds)


def unix_guard(seconds) -> Column:
    """Seconds that an unsigned 32-bit field can hold, else null."""
    s = col(seconds)
    return F.when(s.between(0, 4294967295), s.cast("long"))


def calendar_date(ts) -> Column:
    """YYYY-MM-DD, or ten spaces for null."""
    return F.coalesce(F.date_format(col(ts), "yyyy-MM-dd"), F.lit(" " * 10))


# ---------------------------------------------------------------- sizes

def format_bytes(n) -> Column:
    """B, KB, MB or GB in steps of 1024, with one decimal above B."""
    n = col(n)
    one = lambda d, unit: F.concat(F.format_string("%.1f", F.bround(n / d, 1)), F.lit(f" {unit}"))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1048576, one(1024.0, "KB")).when(n < 1073741824, one(1048576.0, "MB")).otherwise(one(1073741824.0, "GB"))


def ratio_percent(packed, unpacked) -> Column:
    """Whole percent that packing leaves; 100 for empty entries."""
    p, u = col(packed).cast("long"), col(unpacked).cast("long")
    return F.when(u == 0, 100).otherwise((p * 100 - F.pmod(p * 100, F.when(u == 0, 1).otherwise(u))) / F.when(u == 0, 1).otherwise(u)).cast("long")


#: What a size suffix multiplies by.
SIZE_UNITS = {"": 1000, "b": 1, "B": 1, "k": 1024, "m": 1048576, "g": 1073741824, "t": 1099511627776, "K": 1000, "M": 1000000, "G": 1000000000, "T": 1000000000000}


def size_suffix(s) -> Column:
    """The bytes that digits and a suffix mean; null where malformed, zero or beyond 2**63 - 1."""
    s = col(s)
    digits, unit = F.regexp_extract(s, "^([0-9]+)([bBkKmMgGtT]?)$", 1), F.regexp_extract(s, "^([0-9]+)([bBkKmMgGtT]?)$", 2)
    factor = F.create_map(*(F.lit(x) for kv in SIZE_UNITS.items() for x in (kv[0], int(kv[1]))))
    n = digits.try_cast("decimal(20,0)")
    total = n * factor[unit].cast("decimal(18,0)")
    return F.when((total > 0) & (total <= F.lit(2**63 - 1).cast("decimal(19,0)")), total.cast("long"))


# ---------------------------------------------------------------- names

def normalize_path(p) -> Column:
    return F.translate(col(p), "\\", "/")


def versioned_name(name, version) -> Column:
    return F.concat_ws(";", col(name), col(version).cast("string"))


def archive_name(path) -> Column:
    """The last part of a path, its extension replaced."""
    return F.concat(F.regexp_replace(F.substring_index(col(path), "/", -1), r"(?<=.)\.[^.]*$", ""), F.lit(".rar"))


def part_digits(count) -> Column:
    c = col(count)
    return F.when(c > 999, 4).when(c > 99, 3).when(c > 9, 2).otherwise(1)


def part_name(stem, index, count) -> Column:
    return F.concat(col(stem), F.lit(".part"), F.lpad(col(index).cast("string"), part_digits(count), "0"), F.lit(".rar"))


# ---------------------------------------------------------------- codes

def compression_info(version, solid, method, dictionary) -> Column:
    """Version in 6 bits, solid in one, method in three, dictionary code above."""
    return (col(version) + F.when(col(solid), 64).otherwise(0) + col(method) * 128 + col(dictionary) * 1024).cast("long")


def compression_fields(raw) -> Column:
    raw = col(raw).cast("long")
    bits = lambda shift, mask: F.shiftright(raw, shift).bitwiseAND(F.lit(mask))
    return F.struct(bits(0, 63).alias("version"), (bits(6, 1) == 1).alias("solid"), bits(7, 7).alias("method"), F.when(bits(0, 63) == 0, bits(10, 15)).otherwise(bits(10, 31)).alias("dictionary"), bits(15, 31).alias("fraction"))


def dictionary_window(code, fraction=0) -> Column:
    """Bytes of a dictionary: 128 kB doubled ``code`` times, and 32nds of that on top."""
    base = F.expr("131072L") * F.pow(F.lit(2), col(code)).cast("long")
    return base + base / 32 * (F.lit(fraction) if isinstance(fraction, int) else col(fraction))


def dictionary_bits(window) -> Column:
    """Bits that address a window, 17 at least."""
    return F.greatest(F.lit(17), F.length(F.bin(col(window).cast("long") - 1)))


def old_dictionary_window(flags) -> Column:
    return F.pow(F.lit(2), 16 + F.least(F.lit(6), F.shiftright(col(flags).cast("long"), 5).bitwiseAND(F.lit(7)))).cast("long")


def length_bonus(distance) -> Column:
    """How much shorter a match is written for its distance: one for each of three thresholds passed."""
    d = col(distance)
    return sum((F.when(d > t, 1).otherwise(0) for t in (0x2000, 0x40000)), F.when(d > 0x100, 1).otherwise(0))


def length_slot(length) -> Column:
    """Slot, extra bits and their number of a match length (from 2): eight plain slots, then four for each doubling."""
    n = col(length).cast("long") - 2
    bits = F.when(n < 8, 0).otherwise(F.length(F.bin(n)) - 3)
    top = F.when(n < 8, n).otherwise((bits + 1) * 4 + F.floor(n / F.pow(F.lit(2), bits)) - 4)
    extra = F.when(n < 8, 0).otherwise(F.pmod(n, F.pow(F.lit(2), bits).cast("long")))
    return F.struct(top.cast("long").alias("slot"), extra.cast("long").alias("extra"), bits.cast("long").alias("bits"))


def distance_slot(distance) -> Column:
    """Slot, extra bits and their number of a match distance (from 1): four plain slots, then two for each doubling."""
    n = col(distance).cast("long") - 1
    bits = F.when(n < 4, 0).otherwise(F.length(F.bin(n)) - 2)
    top = F.when(n < 4, n).otherwise((bits + 1) * 2 + F.floor(n / F.pow(F.lit(2), bits)) - 2)
    extra = F.when(n < 4, 0).otherwise(F.pmod(n, F.pow(F.lit(2), bits).cast("long")))
    return F.struct(top.cast("long").alias("slot"), extra.cast("long").alias("extra"), bits.cast("long").alias("bits"))


def default_attributes(given, is_directory) -> Column:
    return F.when(col(given) != 0, col(given)).when(col(is_directory), 16).otherwise(32).cast("long")


def posix_mode(attributes) -> Column:
    return col(attributes).cast("long").bitwiseAND(F.lit(511))


# Names of codes.
METHODS = ("store", "fastest", "fast", "normal", "good", "best")
VERDICTS = ("OK", "MISMATCH", "NO_CHECKSUM", "UNSUPPORTED", "ERROR")


def label(code, names: tuple) -> Column:
    return F.coalesce(F.get(F.array(*(F.lit(n) for n in names)), col(code).cast("int")), F.lit("unknown"))


# First bytes of container families, and the codes that this library gives them.
SIGNATURES = {51: "526172211A526576", 50: "526172211A070100", 15: "526172211A0700", 14: "52457E5E"}


def family(content) -> Column:
    """50, 15 or 14 by the bytes a container begins with, 51 for recovery data, 0 for none; the marks of 50 followed by another
    version (2 to 4) are none."""
    c = col(content)
    out = F.lit(0)
    for code, mark in reversed(SIGNATURES.items()):
        out = F.when(F.substring(c, 1, len(mark) // 2) == F.unhex(F.lit(mark)), code).otherwise(out)
    return out


def embedded_offset(content, code: int = 50) -> Column:
    """The byte (from 0) at which a family's mark first stands in a file, -1 if nowhere: self-extracting files have code before it."""
    return (F.locate(bytes.fromhex(SIGNATURES[code]).decode("latin-1"), F.decode(col(content), "ISO-8859-1")) - 1).cast("long")


def detect(content) -> Column:
    """(family, at): the family whose mark stands first in a file, and where; (0, -1) for none."""
    found = F.array(*(F.struct(embedded_offset(content, code).alias("at"), F.lit(code).alias("family")) for code in SIGNATURES))
    first = F.array_min(F.filter(found, lambda x: x["at"] >= 0))
    return F.struct(F.coalesce(first["family"], F.lit(0)).alias("family"), F.coalesce(first["at"], F.lit(-1).cast("long")).alias("at"))

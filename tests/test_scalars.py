"""Column functions against plain Python."""

import datetime as dt
import hashlib
import zlib

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import scalars as S
from quern.operators import campaign, parse
from quern.operators.verify import blake2sp


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_vint_reads_back(spark):
    values = [0, 1, 127, 128, 16383, 16384, 2**31, 2**56 - 1, 2**62, 2**63 - 1]
    for r in spark.createDataFrame([(v,) for v in values], "v long").select("v", S.vint("v").alias("b"), S.vint_size("v").alias("n")).collect():
        assert parse.read_vint(bytes(r.b), 0) == (r.v, r.n) and len(r.b) == r.n


def test_little_endian(spark):
    r = one(spark, a=S.le_bytes(F.lit(0x01020304), 4), b=S.le_bytes(F.lit(5), 2))
    assert bytes(r.a) == b"\x04\x03\x02\x01" and bytes(r.b) == b"\x05\x00"


def test_dos_times(spark):
    when = dt.datetime(2024, 2, 29, 23, 59, 58)
    r = one(spark, v=S.dos_time_encode(F.lit(when)), bad=S.dos_time_decode(F.lit((2 << 21) | (30 << 16))), late=S.dos_time_encode(F.lit(dt.datetime(1979, 1, 1))))
    assert r.bad is None and r.late is None
    assert one(spark, t=S.dos_time_decode(F.lit(r.v))).t == when


def test_ticks_and_guard(spark):
    r = one(spark, a=S.windows_ticks_to_unix(F.lit(S.EPOCH_TICKS)), b=S.windows_ticks_to_unix(F.lit(S.EPOCH_TICKS - 1)), c=S.windows_ticks_to_unix(F.lit(S.EPOCH_TICKS + 29_999_999)), d=S.unix_guard(F.lit(2**32)), e=S.unix_guard(F.lit(2**32 - 1)))
    assert tuple(r) == (0, None, 2, None, 2**32 - 1)


def test_sizes(spark):
    r = one(spark, a=S.format_bytes(F.lit(1023)), b=S.format_bytes(F.lit(1536)), c=S.format_bytes(F.lit(3 << 30)), d=S.ratio_percent(F.lit(1), F.lit(3)), e=S.ratio_percent(F.lit(0), F.lit(0)))
    assert tuple(r) == ("1023 B", "1.5 KB", "3.0 GB", 33, 100)
    given_sizes = {"10": 10_000, "1k": 1024, "2M": 2_000_000, "0": None, "x": None, "": None, "99999999999999999999g": None, "3b": 3}
    for r in spark.createDataFrame([(g,) for g in given_sizes], "g string").select("g", S.size_suffix("g").alias("n")).collect():
        assert r.n == given_sizes[r.g]


def test_names(spark):
    r = one(spark, a=S.normalize_path(F.lit("a\\b")), b=S.versioned_name(F.lit("n"), F.lit(3)), c=S.versioned_name(F.lit("n"), F.lit(None)), d=S.archive_name(F.lit("x/.hidden")), e=S.archive_name(F.lit("x/y.tar.gz")), f=S.part_name(F.lit("s"), F.lit(7), F.lit(100)))
    assert tuple(r) == ("a/b", "n;3", "n", ".hidden.rar", "y.tar.rar", "s.part007.rar")


def test_slots_decode(spark):
    rows = spark.range(2, 4098).select("id", S.length_slot("id").alias("s"), S.distance_slot(F.col("id") * 1009).alias("d")).collect()
    for r in rows:
        s, bits = r.s.slot, r.s.bits
        assert r.id == (s + 2 if s < 8 else 2 + ((4 | (s & 3)) << (s // 4 - 1)) + r.s.extra) and bits == (0 if s < 8 else s // 4 - 1)
        s, bits = r.d.slot, r.d.bits
        assert r.id * 1009 == (s + 1 if s < 4 else ((2 | (s & 1)) << (s // 2 - 1)) + r.d.extra + 1) and bits == (0 if s < 4 else s // 2 - 1)


def test_families(spark):
    marks = {b"Rar!\x1a\x07\x01\x00x": 50, b"Rar!\x1a\x07\x00": 15, b"Rar!\x1aRev": 51, b"RE~^": 14, b"Rar!\x1a\x07\x02\x00": 0, b"": 0}
    for r in spark.createDataFrame([(k,) for k in marks], "c binary").select("c", S.family("c").alias("f")).collect():
        assert r.f == marks[bytes(r.c)]


def test_intervals(spark):
    r = one(spark, a=campaign.wilson(F.lit(0), F.lit(10)), b=campaign.wilson(F.lit(10), F.lit(10)), c=campaign.wilson(F.lit(6921), F.lit(6930)), n=campaign.sample_size(campaign.z_of(0.95), F.lit(0.05)))
    assert r.a.low == 0 and r.b.high == 1 and 0.9975 < r.c.low < 0.99870 < r.c.high < 0.9994 and r.n == 385


def test_blake2sp_of_nothing():
    # The published digest of the empty input.
    assert blake2sp(b"").hex() == "dd0e891776933f43c7d032b08a917e25741f8aa9a12c12e1cac8801500f2ca4f"


@given(st.binary(max_size=3000))
def test_blake2sp_depends_on_every_byte(data):
    assert len(blake2sp(data)) == hashlib.blake2s().digest_size and blake2sp(data) != blake2sp(data + b"\0")


def test_mutations(spark):
    data = bytes(range(50))
    r = one(spark, x=campaign.xor_byte(F.lit(data), F.lit(7)), y=campaign.drop_suffix(F.lit(data), F.lit(3)), z=campaign.drop_suffix(F.lit(data), F.lit(99)), p=campaign.sniper_positions(F.lit(10)))
    assert bytes(r.x) == data[:7] + bytes([7 ^ 255]) + data[8:] and bytes(r.y) == data[:-3] and bytes(r.z) == b"" and r.p == [0, 2, 5, 7, 9]
    assert zlib.crc32(bytes(r.x)) != zlib.crc32(data)

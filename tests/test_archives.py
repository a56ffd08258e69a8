"""Archives written by expressions, read back, judged; small fixtures, damaged in every way that a reader can meet."""

import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.operators import campaign, create, extract, parse, verify
from quern.sources import archives as sources
from quern.streaming.verdicts import streamed_summaries

SCHEMA = "archive_id string, entry long, name string, payload binary, mtime long, is_directory boolean, is_encrypted boolean, has_crc boolean"


@pytest.fixture
def entries(spark):
    rows = [("a", 0, "d", b"", 1, True, False, False), ("a", 1, "d/x.txt", b"hello world" * 50, 2, False, False, True), ("a", 2, "empty", b"", 3, False, False, True), ("a", 3, "éè.txt", bytes(range(256)) * 9, 4, False, False, True)]
    rows += [("b", 0, "secret", b"????", 5, False, True, True), ("b", 1, "bare", b"no sum", 6, False, False, False), ("c", 0, "only", b"z" * 70_000, 7, False, False, True)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def judged(blocks):
    return {(r.archive_id, r.name): r for r in verify.verdicts(verify.assembled(blocks)).collect()}


def test_round_trip(entries):
    blocks = parse.blocks(create.archives(entries))
    assert blocks.filter("not crc_ok or error is not null").count() == 0
    got = judged(blocks)
    for e in entries.collect():
        r = got[e.archive_id, e.name]
        assert r.size == len(e.payload) and bytes(r.payload) == bytes(e.payload) and r.mtime == e.mtime and r.is_directory == e.is_directory
        assert r.status == (verify.UNSUPPORTED if e.is_encrypted else verify.OK if e.is_directory or e.has_crc else verify.NO_CHECKSUM)


def test_planned_size(entries):
    plain = entries.filter("archive_id = 'c'")
    planned = plain.agg(F.sum(create.block_size(F.col("payload"))) + 24).first()[0]
    assert planned == len(create.archives(plain).first().content)


@pytest.mark.parametrize("size", [100, 777, 65536, 10**6])
def test_volumes(entries, size):
    blocks = parse.blocks(create.volumes(entries, size))
    got = judged(blocks)
    for e in entries.collect():
        r = got[e.archive_id, e.name]
        assert bytes(r.payload) == bytes(e.payload) and r.complete and r.parts_ok
    assert blocks.filter("type = 5 and next_volume").count() == blocks.filter("type = 1").count() - 3


def test_a_missing_volume_is_never_verified(entries):
    blocks = parse.blocks(create.volumes(entries.filter("archive_id = 'c'"), 10_000).filter("volume != 3"))
    files = verify.assembled(blocks)
    assert files.filter("complete").count() == 0
    assert verify.verdicts(files).filter(F.col("status") == verify.OK).count() == 0


def test_every_changed_byte_is_noticed(spark):
    e = spark.createDataFrame([("a", 0, "n", b"payload", 1, False, False, True)], SCHEMA)
    whole = create.archives(e)
    n = len(whole.first().content)
    mutants = whole.crossJoin(spark.range(n)).select(F.concat_ws("-", "archive_id", "id").alias("archive_id"), "volume", campaign.xor_byte("content", F.col("id")).alias("content"))
    assert verify.validation(parse.blocks(mutants)).filter("is_valid").count() == 0
    cut = whole.crossJoin(spark.range(1, n + 1)).select(F.concat_ws("-", "archive_id", "id").alias("archive_id"), "volume", campaign.drop_suffix("content", F.col("id")).alias("content"))
    errors = {r.error for r in verify.validation(parse.blocks(cut)).collect()}
    assert None not in errors and {parse.EMPTY_ARCHIVE, parse.NO_MARK, parse.BROKEN_BLOCK, parse.NO_END_BLOCK} <= errors


def test_old_family(entries):
    plain = entries.filter("archive_id = 'c' or name = 'bare'")
    got = judged(parse.blocks(create.old_archives(plain)))
    assert all(r.status == verify.OK and r.family == 15 for r in got.values()) and len(got) == 2


def test_summary(entries):
    got = {r.archive_id: r for r in verify.summary(verify.verdicts(verify.assembled(parse.blocks(create.archives(entries))))).collect()}
    assert (got["a"].status, got["a"].verified, got["a"].directory_count, got["a"].exit_code) == (verify.VERIFIED, 3, 1, 0)
    assert (got["b"].status, got["b"].encrypted_count, got["b"].no_checksum, got["b"].exit_code) == (verify.INCOMPLETE, 1, 1, 69)


def test_files_and_folders(spark, entries, tmp_path):
    for r in create.archives(entries).collect():
        (tmp_path / "x" / r.archive_id).mkdir(parents=True)
        (tmp_path / "x" / r.archive_id / "f.rar").write_bytes(bytes(r.content))
    files = sources.archive_files(spark, f"file://{tmp_path}")
    assert verify.validation(parse.blocks(files)).filter("is_valid").count() == 3
    paths = spark.createDataFrame([("a/b/c.txt",), ("a/d.txt",), ("e",)], "path string")
    assert {r.directory for r in sources.directories(paths).collect()} == {"a", "a/b"}


def test_volume_names(spark):
    names = [f"s.part{i}.rar" for i in (1, 2, 4)] + ["t.rar", "t.r00", "t.r01", "t.r03", "u.part02.rar", "other.zip"]
    got = {(r.set_id, r.volume) for r in sources.volume_sets(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got == {("s.part1", 1), ("s.part1", 2), ("t.old", 1), ("t.old", 2), ("t.old", 3)}


def test_order_of_rows_does_not_matter(entries):
    one, many = create.volumes(entries.coalesce(1), 500), create.volumes(entries.repartition(7), 500)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_stream(spark, entries, tmp_path):
    create.archives(entries).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("archive_id string, volume int, content binary").parquet(str(tmp_path / "in"))
    q = streamed_summaries(stream).writeStream.format("memory").queryName("sums").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.archive_id: r.verified for r in spark.table("sums").collect()}
    assert got == {"a": 3, "b": 0, "c": 1}


def test_a_damaged_entry_that_has_only_blake2sp(spark):
    rows = [("a", 0, "good", b"x" * 5000, 1, False, False, False, b"x" * 5000), ("a", 1, "bad", b"y" * 5000, 1, False, False, False, b"y" * 4999 + b"z"), ("a", 2, "both", b"w", 1, False, False, True, b"w")]
    e = spark.createDataFrame(rows, SCHEMA + ", written binary").withColumn("has_blake", F.lit(True))
    blocks = parse.blocks(create.archives(e))
    assert blocks.filter("not crc_ok or error is not null").count() == 0 and blocks.filter("octet_length(blake2sp) = 32").count() == 3
    assert {k[1]: r.status for k, r in judged(blocks).items()} == {"good": verify.OK, "bad": verify.MISMATCH, "both": verify.OK}
    plain = e.drop("written")
    got = judged(parse.blocks(create.volumes(plain, 700)))
    assert {r.status for r in got.values()} == {verify.OK} and all(bytes(r.blake2sp) == verify.blake2sp(bytes(r.payload)) for r in got.values())
    damaged = create.volumes(plain, 700).withColumn("content", F.when(F.col("volume") == 3, campaign.xor_byte("content", F.octet_length("content") - 30)).otherwise(F.col("content")))
    assert judged(parse.blocks(damaged))["a", "good"].status == verify.MISMATCH


def one(spark, content: bytes, *more: bytes):
    return parse.blocks(spark.createDataFrame([("a", i, c) for i, c in enumerate([content, *more])], "archive_id string, volume int, content binary"))


def framed(header: bytes) -> bytes:
    sized = bytes([len(header)]) + header
    return zlib.crc32(sized).to_bytes(4, "little") + sized


def test_validation_joins_split_entries(spark):
    e = spark.createDataFrame([("a", 0, "n", bytes(range(250)) * 4, 1, False, False, True)], SCHEMA)
    for made, want in ((e, verify.CRC32_DIFFERS), (e.withColumn("has_crc", F.lit(False)).withColumn("has_blake", F.lit(True)), verify.BLAKE2SP_DIFFERS)):
        parts = [bytes(r.content) for r in create.volumes(made, 400).orderBy("volume").collect()]
        assert verify.validation(one(spark, *parts)).first().is_valid
        last = parts[2][:-20] + bytes([parts[2][-20] ^ 1]) + parts[2][-19:]
        assert verify.validation(one(spark, parts[0], parts[1], last)).first().error == want
        assert verify.validation(one(spark, parts[0][:-20] + bytes([parts[0][-20] ^ 1]) + parts[0][-19:], *parts[1:])).first().error == "PART_" + want
        for some in (parts[:2], parts[1:], [parts[0], parts[2]]):
            r = verify.validation(parse.blocks(spark.createDataFrame([("a", parts.index(c), c) for c in some], "archive_id string, volume int, content binary"))).first()
            assert r.unverified >= 1 and (r.is_valid, r.error) == (False, verify.VOLUME_MISSING)


def test_validation_of_payloads_it_cannot_read(spark):
    """A compressed entry, whose checksum isn't that of its packed bytes, is unverified; a stored one with a changed digest isn't valid."""
    packed = bytes([2, 2, 5, 4, 9, 0]) + zlib.crc32(b"unpacked!").to_bytes(4, "little") + bytes([3 << 7 & 127 | 128, 3]) + bytes([1, 1]) + b"n"
    r = verify.validation(one(spark, parse.NEW + framed(bytes([1, 0, 0])) + framed(packed) + b"12345" + framed(bytes([5, 0, 0])))).first()
    assert (r.is_valid, r.unverified, r.file_count) == (True, 1, 1)
    e = spark.createDataFrame([("a", 0, "n", b"payload", 1, False, False, False)], SCHEMA).withColumn("has_blake", F.lit(True)).withColumn("written", F.encode(F.lit("pAyload"), "UTF-8"))
    assert verify.validation(parse.blocks(create.archives(e))).first().error == verify.BLAKE2SP_DIFFERS


def test_encrypted_headers(spark):
    new = parse.NEW + framed(bytes([4, 0, 0, 0, 15]) + bytes(16)) + b"cipher" * 9
    main = bytes([0x73, 0x80, 0, 13, 0]) + bytes(6)
    old = parse.OLD + (zlib.crc32(main) & 0xFFFF).to_bytes(2, "little") + main + b"cipher" * 9
    for content in (new, old):
        b = one(spark, content)
        r, s = verify.validation(b).first(), verify.summary(verify.verdicts(verify.assembled(b))).first()
        assert (r.is_valid, r.headers_encrypted, r.error, r.file_count) == (False, True, verify.HEADERS_ENCRYPTED, 0)
        assert (s.status, s.exit_code, s.entry_count, s.headers_encrypted) == (verify.INCOMPLETE, 69, 0, True)


def test_code_before_an_archive(spark, entries):
    plain = entries.filter("archive_id = 'c'")
    for made in (create.archives(plain), create.old_archives(plain)):
        content = bytes(made.first().content)
        r = verify.validation(one(spark, b"MZ code " * 300 + content)).first()
        assert r.is_valid and r.file_count == 1
        assert verify.validation(one(spark, b"MZ code " * 300 + content[:900] + b"?" + content[901:])).first().error == verify.CRC32_DIFFERS


def test_families_that_are_not_read(spark):
    for content, family, error in ((b"Rar!\x1aRev data", 51, parse.RECOVERY_DATA), (b"MZ RE~^ data", 14, parse.OLDEST_FAMILY), (b"Rar!\x1a\x07\x03\x00", 0, parse.LATER_VERSION), (b"text", 0, parse.NO_MARK), (b"", 0, parse.NO_MARK)):
        r = verify.validation(one(spark, content)).first()
        assert (r.family, r.error, r.is_valid) == (family, error, False)


def test_extra_records(spark):
    """Times in Unix seconds or ticks override the header's, where they can be held; versions are read."""
    ticks = lambda s: (116444736000000000 + s * 10_000_000 + 7).to_bytes(8, "little")
    unix, windows, early = bytes([6, 3, 3]) + (77).to_bytes(4, "little"), bytes([10, 3, 2]) + ticks(88), bytes([10, 3, 2]) + bytes(8)
    version = bytes([3, 4, 0, 5])
    for extra, mtime, number in ((unix, 77, None), (windows + version, 88, 5), (early, 9, None), (version, 9, 5), (bytes([2, 3, 0]), 9, None)):
        body = bytes([2, 1, len(extra), 2, 0, 32]) + (9).to_bytes(4, "little") + bytes([0, 1, 1]) + b"n" + extra
        row = one(spark, parse.NEW + framed(bytes([1, 0, 0])) + framed(body) + framed(bytes([5, 0, 0]))).filter("type = 2").first()
        assert (row.mtime, row.version, row.error) == (mtime, number, None)


def old_block(kind: int, flags: int, body: bytes, data: bytes = b"", covered: int | None = None) -> bytes:
    header = bytes([kind]) + flags.to_bytes(2, "little") + (7 + len(body)).to_bytes(2, "little") + body
    return (zlib.crc32(header[: None if covered is None else covered - 2]) & 0xFFFF).to_bytes(2, "little") + header + data


def old_file(flags: int, tail: bytes, data: bytes = b"abc") -> bytes:
    n = len(data).to_bytes(4, "little")
    body = n + n + bytes([3]) + zlib.crc32(data).to_bytes(4, "little") + (0x285D0000).to_bytes(4, "little") + bytes([20, 0x30]) + (1).to_bytes(2, "little") + (33188).to_bytes(4, "little") + b"n" + tail
    return old_block(0x74, 0x8000 | flags, body, data)


def test_old_times_and_salt(spark):
    main = old_block(0x73, 0, bytes(6))
    times = (0xF << 12 | 0x9 << 4).to_bytes(2, "little") + (1234567).to_bytes(3, "little") + (5).to_bytes(4, "little") + b"\x07"
    b = one(spark, parse.OLD + main + old_file(0x1400, b"saltsalt" + times)).filter("type = 116").first()
    assert bytes(b.salt) == b"saltsalt" and b.crc_ok and b.error is None
    assert [tuple(t) for t in b.times] == [(0, 0x285D0000, True, 1234567), (2, 5, False, 7 << 16)]
    assert one(spark, parse.OLD + main + old_file(0x1000, b"")).filter("error is not null").first().error == parse.BROKEN_BLOCK


def test_old_comments(spark):
    def comment(text: bytes, method: int = 0x30, own: int | None = None) -> bytes:
        rest = len(text).to_bytes(2, "little") + bytes([20, method]) + ((zlib.crc32(text) & 0xFFFF) if own is None else own).to_bytes(2, "little")
        return old_block(0x75, 0, rest + text, covered=13)

    for inner, ok in ((comment(b"hello"), True), (comment(b"hello", own=1), False), (comment(b"packed", 0x33), None), (comment(b"x", 0x40), False), (b"short", False)):
        b = one(spark, parse.OLD + old_block(0x73, 2, bytes(6) + inner, covered=13) + old_file(0, b""))
        assert b.filter("type = 115").first().comment_ok == ok and b.filter("not crc_ok").count() == 0
        assert verify.validation(b).first().error == (verify.COMMENT_DIFFERS if ok is False else None)


@pytest.mark.parametrize("size", [150, 700, 10**6])
def test_volumes_by_file_size(entries, size):
    made = create.volumes(entries, size, headers_count=True)
    assert made.filter(F.octet_length("content") > size).count() == 0
    got = judged(parse.blocks(made))
    assert all(bytes(got[e.archive_id, e.name].payload) == bytes(e.payload) and got[e.archive_id, e.name].complete for e in entries.collect())
    with pytest.raises(ValueError):
        create.fill([(5, 90)], 60)


def test_sets_are_opened_from_files(spark, entries, tmp_path):
    made = create.volumes(entries, 3000, headers_count=True)
    extract.write_files(extract.volume_files(made), str(tmp_path)).count()
    files = sources.archive_files(spark, str(tmp_path))
    assert files.select("archive_id").distinct().count() == 3 and files.count() == made.count()
    blocks = parse.blocks(files)
    assert verify.validation(blocks).filter("is_valid").count() == 3
    assert {n for _, n in judged(blocks)} == {e.name for e in entries.collect()}
    (tmp_path / "c.part02.rar").unlink()
    assert {r.error for r in verify.validation(parse.blocks(sources.archive_files(spark, str(tmp_path), "c.*"))).collect()} == {verify.VOLUME_MISSING}
    places = [r.path for r in sources.walk(spark, str(tmp_path.parent), "*.rar").filter(F.col("path").contains(tmp_path.name)).orderBy("place").collect()]
    assert places[-1].endswith(tmp_path.name) and len(places) == made.count()


def test_extract(spark, entries, tmp_path):
    bad = [("a", 9, n, b"x", 1, False, False, True) for n in ("../up", "/root", "C:/x", "a/../b", "", "two", "two", "d2/f", "d2", "bell\x07")]
    both = entries.union(spark.createDataFrame([(*r[:1], 10 + i, *r[2:]) for i, r in enumerate(bad)], SCHEMA))
    files = verify.verdicts(verify.assembled(parse.blocks(create.archives(both)))).withColumn("mode", F.lit(0o4640))
    table = extract.extract(files, str(tmp_path / "out")).collect()
    why = {(r.archive_id, r.name): r.reason for r in table}
    assert {n: w for (_, n), w in why.items() if w} == {"../up": "NOT_BELOW", "/root": "NOT_BELOW", "C:/x": "NOT_BELOW", "a/../b": "NOT_BELOW", "": "EMPTY_NAME", "two": "NAME_TAKEN", "d2": "NAME_TAKEN", "bell\x07": "CONTROL_CHARACTER", "secret": "UNSUPPORTED"}
    for e in entries.filter("name != 'secret'").collect():
        path = tmp_path / "out" / e.archive_id / e.name
        assert path.is_dir() if e.is_directory else path.read_bytes() == bytes(e.payload)
        assert path.stat().st_mtime == e.mtime and path.stat().st_mode & 0o7777 == 0o640
    assert not (tmp_path / "up").exists() and not (tmp_path / "out" / "a" / "two").exists()


def test_small_archives_share_batches():
    """Blocks of many small archives travel in few batches, those of a large one in several; order and numbers stay."""
    made = lambda ids, contents: pa.RecordBatch.from_pydict({"archive_id": ids, "volume": pa.array([0] * len(ids), pa.int32()), "content": contents})
    ids = [str(i) for i in range(10_000)]
    few = list(parse.batched(iter([made(ids[:5000], [b"RE~^"] * 5000), made(ids[5000:], [b"RE~^", b""] * 2500)])))
    assert len(few) <= 1 + 10_000 // parse.BATCH_ROWS
    assert [x for b in few for x in b.column("archive_id").to_pylist()] == ids and {x for b in few for x in b.column("block").to_pylist()} == {0}
    header = bytes([2, 2]) + b"\x80\x80\x40" + bytes([0]) + b"\x80\x80\x40" + bytes([0, 0, 1, 1]) + b"n"  # a file of 1 MB without a checksum
    sized = bytes([len(header)]) + header
    block = zlib.crc32(sized).to_bytes(4, "little") + sized + bytes(1 << 20)
    large = list(parse.batched(iter([made(["x"], [parse.NEW + block * 10])])))
    assert len(large) > 1 and [x for b in large for x in b.column("block").to_pylist()] == list(range(11))
    assert all(sum(len(x or b"") for x in b.column("payload").to_pylist()) <= parse.BATCH_BYTES for b in large)


def test_validation_of_single_volumes(spark, entries):
    """The way without a search for pieces gives the same, and sorts no payloads."""
    hit = F.col("entry") % 2 == 1
    faulty = entries.withColumn("written", F.when(hit & ~F.col("is_directory"), F.concat("payload", F.lit(b"x"))).otherwise(F.col("payload")))
    cut = create.volumes(entries, 700).filter("volume = 1").withColumn("archive_id", F.concat("archive_id", F.lit("-cut")))
    hidden = spark.createDataFrame([("none", 0, b"no mark"), ("oldest", 0, b"RE~^"), ("empty", 0, b"")], "archive_id string, volume int, content binary")
    broken = create.archives(entries).select(F.concat("archive_id", F.lit("-broken")).alias("archive_id"), "volume", campaign.drop_suffix("content", F.lit(9)).alias("content"))
    old = create.old_archives(entries).select(F.concat("archive_id", F.lit("-old")).alias("archive_id"), "volume", "content")
    blocks = parse.blocks(create.archives(faulty).union(cut).union(hidden).union(broken).union(old)).cache()
    assert "Window" not in verify.validation(parse.blocks(hidden), single=True)._jdf.queryExecution().toString()
    want = {r.archive_id: r for r in verify.validation(blocks).collect()}
    assert {r.archive_id: r for r in verify.validation(blocks, single=True).collect()} == want and len({r.error for r in want.values()}) > 3


def test_archives_of_one_entry(spark, entries):
    """Without bringing entries together, archives of one entry have the same bytes and nothing is shuffled."""
    each = spark.createDataFrame(entries.withColumn("archive_id", F.concat_ws("-", "archive_id", "entry")).collect(), entries.schema)
    alone = create.archives(each, alone=True)
    assert "Exchange" not in alone._jdf.queryExecution().executedPlan().toString()
    assert {r.archive_id: (r.volume, bytes(r.content)) for r in alone.collect()} == {r.archive_id: (r.volume, bytes(r.content)) for r in create.archives(each).collect()}


def test_pieces_carry_no_whole_payloads(spark, entries, tmp_path):
    """An entry of many pieces isn't copied into each of them, and entries are read and cut once for a set."""
    entries.write.parquet(str(tmp_path / "entries"))
    stored = spark.read.parquet(str(tmp_path / "entries"))
    cut = create.pieces(stored, 1000)
    assert "payload" not in cut.columns and "payload" not in create.pieces_by_file(stored, 1000).columns
    assert cut.filter("archive_id = 'c'").agg(F.count("*"), F.sum(F.octet_length("piece")), F.min("size"), F.max("last")).first()[:] == (70, 70_000, 70_000, 69)
    plan = create.volumes(stored, 1000)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1


def test_files_are_read_by_tasks(spark, tmp_path):
    """Files are found by the paths in rows: nothing lists the folder, a path without a file gives null, batches stay small."""
    contents = {f"d{i % 3}/{i}.txt": bytes([i]) * (i * 100_000) for i in range(60)}
    extract.write_files(spark.createDataFrame(list(contents.items()), "path string, content binary"), str(tmp_path)).count()
    rows = spark.createDataFrame([(i, p) for i, p in enumerate([*contents, "d0/none.txt"])], "i int, path string").coalesce(1)
    read = extract.read_files(rows, str(tmp_path))
    assert "binaryFile" not in read._jdf.queryExecution().toString() and read.columns == ["i", "path", "content"]
    assert {r.path: r.content and bytes(r.content) for r in read.filter("i != 0").collect()} == {**{p: c for p, c in contents.items() if c}, "d0/none.txt": None}
    assert bytes(read.filter("i = 0").first().content) == b""

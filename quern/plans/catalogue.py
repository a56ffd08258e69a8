"""The registered queries over the driver's tables, and their SQL. The Spark side builds archive bytes, reads them back and
judges them; the SQL computes the expected answer from the tables alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import campaign, create, extract, parse, verify
from ..sources.archives import ENTRIES, archive_files, document_entries, shared_folder, table, volume_sets, walk

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.replace("{ARCHIVE}", f"source || '-' || (doc_id // {ENTRIES})::VARCHAR")
        return f

    return register


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.blocks(create.archives(document_entries(spark, sf_dir)))


def _faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of which some are encrypted, some lack a checksum and some were changed after it was taken."""
    e = document_entries(spark, sf_dir)
    secret, bare = F.col("entry") % 29 == 0, F.col("entry") % 23 == 0
    changed = (F.col("entry") % 17 == 0) & ~secret & ~bare & (F.octet_length("payload") > 0)
    half = F.floor(F.octet_length("payload") / 2)
    return e.withColumn("is_encrypted", secret).withColumn("has_crc", secret | ~bare).withColumn("written", F.when(changed, campaign.xor_byte("payload", half)).otherwise(F.col("payload")))


_STATUS = "CASE WHEN doc_id % 29 = 0 THEN 3 WHEN doc_id % 23 = 0 THEN 2 WHEN doc_id % 17 = 0 AND strlen(text) > 0 THEN 1 ELSE 0 END"

# ---------------------------------------------------------------- archives: create, parse, list, verify


@query("SELECT {ARCHIVE} AS archive_id, count(*) AS entry_count, count(*) AS verified, 0::BIGINT AS damaged, sum(strlen(text))::BIGINT AS bytes_verified, 0 AS status FROM documents GROUP BY 1")
def archive_summary(spark, sf_dir):
    v = verify.verdicts(verify.assembled(_blocks(spark, sf_dir)))
    sums = v.groupBy("archive_id").agg(F.sum("bytes_verified").alias("bytes_verified"))
    return verify.summary(v).join(sums, "archive_id").select("archive_id", "entry_count", "verified", "damaged", "bytes_verified", "status")


@query(f"SELECT {{ARCHIVE}} AS archive_id, lang || '/' || doc_id::VARCHAR || '.txt' AS name, {_STATUS} AS status, CASE WHEN doc_id % 29 = 0 THEN 0 ELSE strlen(text) END::BIGINT AS bytes_verified FROM documents")
def verify_entries(spark, sf_dir):
    v = verify.verdicts(parse.blocks(create.archives(_faulty(spark, sf_dir))).filter(verify.is_file()))
    return v.select("archive_id", "name", "status", "bytes_verified")


@query("SELECT {ARCHIVE} AS archive_id, lang || '/' || doc_id::VARCHAR || '.txt' AS name, CASE WHEN doc_id % 14 = 0 AND strlen(text) > 0 THEN 1 ELSE 0 END AS status, strlen(text)::BIGINT AS bytes_verified FROM documents")
def verify_hash_records(spark, sf_dir):
    """Every seventh entry has a BLAKE2sp record in place of its CRC32; half of these were changed."""
    e = document_entries(spark, sf_dir)
    hashed, changed = F.col("entry") % 7 == 0, (F.col("entry") % 14 == 0) & (F.octet_length("payload") > 0)
    half = F.floor(F.octet_length("payload") / 2)
    made = e.withColumn("has_blake", hashed).withColumn("has_crc", ~hashed).withColumn("written", F.when(changed, campaign.xor_byte("payload", half)).otherwise(F.col("payload")))
    v = verify.verdicts(verify.assembled(parse.blocks(create.archives(made))))
    return v.select("archive_id", "name", "status", "bytes_verified")


@query(
    f"""WITH v AS (SELECT {{ARCHIVE}} AS archive_id, {_STATUS} AS s, doc_id FROM documents), g AS (SELECT archive_id, count(*) AS entry_count, count(*) FILTER (s = 0) AS verified, count(*) FILTER (s = 1) AS damaged,
    count(*) FILTER (s = 2) AS no_checksum, count(*) FILTER (s = 3) AS unsupported, count(*) FILTER (doc_id % 29 = 0) AS encrypted_count FROM v GROUP BY 1)
    SELECT *, CASE WHEN damaged > 0 THEN 1 WHEN unsupported + no_checksum > 0 THEN 2 ELSE 0 END AS status, CASE WHEN damaged > 0 THEN 1 WHEN unsupported > 0 THEN 69 WHEN no_checksum > 0 THEN 65 ELSE 0 END AS exit_code FROM g"""
)
def verify_summary_faults(spark, sf_dir):
    s = verify.summary(verify.verdicts(parse.blocks(create.archives(_faulty(spark, sf_dir))).filter(verify.is_file())))
    return s.select("archive_id", "entry_count", "verified", "damaged", "no_checksum", "unsupported", "encrypted_count", "status", "exit_code")


@query(f"WITH v AS (SELECT {{ARCHIVE}} AS archive_id, {_STATUS} AS s FROM documents) SELECT archive_id, count(*) AS accounted FROM v GROUP BY 1")
def verify_accounting(spark, sf_dir):
    """The exclusive counts add up to the entries."""
    s = verify.summary(verify.verdicts(parse.blocks(create.archives(_faulty(spark, sf_dir))).filter(verify.is_file())))
    return s.select("archive_id", (F.col("verified") + F.col("damaged") + F.col("no_checksum") + F.col("unsupported") + F.col("error_count") + F.col("directory_count")).alias("accounted"))


@query("SELECT {ARCHIVE} AS archive_id, CASE WHEN count(*) FILTER (doc_id % 29 = 0) = 0 THEN 'none' WHEN count(*) FILTER (doc_id % 29 = 0) < count(*) THEN 'mixed' ELSE 'all' END AS encryption FROM documents GROUP BY 1")
def encryption_class(spark, sf_dir):
    b = parse.blocks(create.archives(_faulty(spark, sf_dir))).filter(verify.is_file())
    n = F.count_if("is_encrypted")
    return b.groupBy("archive_id").agg(F.when(n == 0, "none").when(n < F.count("*"), "mixed").otherwise("all").alias("encryption"))


@query("SELECT {ARCHIVE} AS archive_id, lang || '/' || doc_id::VARCHAR || '.txt' AS name, strlen(text)::BIGINT AS size, strlen(text)::BIGINT AS packed, 100::BIGINT AS ratio, 'store' AS method FROM documents")
def listing(spark, sf_dir):
    return verify.listing(_blocks(spark, sf_dir)).select("archive_id", "name", "size", "packed", "ratio", "method")


@query("SELECT {ARCHIVE} AS archive_id, count(*) AS files, sum(strlen(text))::BIGINT AS size, sum(strlen(text))::BIGINT AS packed FROM documents GROUP BY 1")
def list_totals(spark, sf_dir):
    return verify.listing(_blocks(spark, sf_dir)).groupBy("archive_id").agg(F.count("*").alias("files"), F.sum("size").alias("size"), F.sum("packed").alias("packed"))


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def roundtrip_md5(spark, sf_dir):
    b = _blocks(spark, sf_dir).filter(verify.is_file())
    return b.select(F.regexp_extract("name", "([0-9]+)\\.txt$", 1).cast("long").alias("doc_id"), F.md5("payload").alias("digest"))


@query("SELECT {ARCHIVE} AS archive_id, count(*) + 2 AS headers_ok FROM documents GROUP BY 1")
def header_crc_ok(spark, sf_dir):
    return _blocks(spark, sf_dir).groupBy("archive_id").agg(F.count_if("crc_ok").alias("headers_ok"))


@query("SELECT {ARCHIVE} AS archive_id, 1::BIGINT AS main, count(*) AS file, 1::BIGINT AS ending FROM documents GROUP BY 1")
def block_census(spark, sf_dir):
    n = lambda t: F.count_if(F.col("type") == t)
    return _blocks(spark, sf_dir).groupBy("archive_id").agg(n(1).alias("main"), n(2).alias("file"), n(5).alias("ending"))


_VS = "greatest(1, ((length(bin({0})) + 6) // 7))"
_SIZES = f"""s AS (SELECT {{ARCHIVE}} AS archive_id, doc_id, strlen(text) AS n, strlen(lang || '/' || doc_id::VARCHAR || '.txt') AS m FROM documents),
h AS (SELECT *, 2 + CASE WHEN n > 0 THEN {_VS.format("n")} ELSE 0 END + 1 + {_VS.format("n")} + 1 + 4 + 4 + 1 + 1 + {_VS.format("m")} + m AS header FROM s),
b AS (SELECT archive_id, doc_id, (4 + {_VS.format("header")} + header + n)::BIGINT AS block FROM h)"""


@query(f"WITH {_SIZES} SELECT archive_id, (8 + 8 + 8 + sum(block))::BIGINT AS bytes FROM b GROUP BY 1")
def archive_size(spark, sf_dir):
    a = create.archives(document_entries(spark, sf_dir))
    return a.select("archive_id", F.octet_length("content").cast("long").alias("bytes"))


@query(f"WITH {_SIZES} SELECT archive_id, (24 + sum(block))::BIGINT AS bytes FROM b GROUP BY 1")
def archive_size_planned(spark, sf_dir):
    """The size of an archive without writing it."""
    e = document_entries(spark, sf_dir)
    return e.groupBy("archive_id").agg((F.sum(create.block_size(F.col("payload"))) + 24).alias("bytes"))


@query(f"WITH {_SIZES} SELECT archive_id, doc_id, (16 + sum(block) OVER (PARTITION BY archive_id ORDER BY doc_id) - block)::BIGINT AS header_start FROM b")
def block_offsets(spark, sf_dir):
    b = _blocks(spark, sf_dir).filter(verify.is_file())
    return b.select("archive_id", F.regexp_extract("name", "([0-9]+)\\.txt$", 1).cast("long").alias("doc_id"), "header_start")


@query("SELECT {ARCHIVE} AS archive_id, lang || '/' || doc_id::VARCHAR || '.txt' AS name, strlen(text)::BIGINT AS size, md5(text) AS digest, true AS crc_ok FROM documents")
def volume_assembly(spark, sf_dir):
    f = verify.assembled(parse.blocks(create.volumes(document_entries(spark, sf_dir), 4096)))
    return f.filter("complete").select("archive_id", "name", F.octet_length("payload").cast("long").alias("size"), F.md5("payload").alias("digest"), (F.crc32("payload") == F.col("crc")).alias("crc_ok"))


@query("WITH v AS (SELECT unnest([1000, 4096, 65536]) AS volume_bytes) SELECT volume_bytes, n.verified FROM v, (SELECT count(*) AS verified FROM documents) n")
def volume_split_invariance(spark, sf_dir):
    """Every entry verifies whatever the volumes' size."""
    out = []
    for n in (1000, 4096, 65536):
        v = verify.verdicts(verify.assembled(parse.blocks(create.volumes(document_entries(spark, sf_dir), n))).filter("complete and parts_ok"))
        out.append(v.agg(F.count_if(F.col("status") == 0).alias("verified")).select(F.lit(n).alias("volume_bytes"), "verified"))
    return out[0].union(out[1]).union(out[2])


@query(
    """WITH s AS (SELECT {ARCHIVE} AS archive_id, doc_id, strlen(text) AS n FROM documents), c AS (SELECT *, sum(n) OVER (PARTITION BY archive_id ORDER BY doc_id) AS upto FROM s)
    SELECT archive_id, count(*) FILTER (n > 0 AND (upto - n) // 4096 < (upto - 1) // 4096)::BIGINT AS split_entries, sum(greatest(0, greatest(upto - n, upto - 1) // 4096 - (upto - n) // 4096))::BIGINT AS leading_parts FROM c GROUP BY 1"""
)
def packed_part_crc(spark, sf_dir):
    """Of volumes of 4,096 bytes: the entries that are split, and the leading parts whose own checksum is right."""
    b = parse.blocks(create.volumes(document_entries(spark, sf_dir), 4096)).filter(verify.is_file())
    ok = F.col("split_after") & (F.crc32("payload") == F.col("crc"))
    return b.groupBy("archive_id").agg(F.count_if(F.col("split_after") & ~F.col("split_before")).alias("split_entries"), F.count_if(ok).alias("leading_parts"))


@query(
    """WITH s AS (SELECT {ARCHIVE} AS archive_id, doc_id, strlen(text) AS n FROM documents), c AS (SELECT *, sum(n) OVER (PARTITION BY archive_id ORDER BY doc_id) AS upto FROM s),
    v AS (SELECT *, (upto - n) // 4096 AS a, greatest(upto - n, upto - 1) // 4096 AS b FROM c) SELECT archive_id, count(*) FILTER (a <= 1 AND b >= 1 AND a < b)::BIGINT AS incomplete FROM v GROUP BY 1"""
)
def orphan_chunks(spark, sf_dir):
    """Without the second volume, the entries that had a piece there beside others are incomplete. A run across the gap
    counts once."""
    b = parse.blocks(create.volumes(document_entries(spark, sf_dir), 4096).filter("volume != 1"))
    return verify.assembled(b).groupBy("archive_id").agg(F.count_distinct(F.when(~F.col("complete"), F.col("name"))).alias("incomplete"))


@query("SELECT {ARCHIVE} AS archive_id, CASE WHEN min(doc_id) FILTER (doc_id % 17 = 0 AND doc_id % 29 <> 0 AND doc_id % 23 <> 0 AND strlen(text) > 0) IS NULL THEN NULL ELSE 'CRC32_DIFFERS' END AS error, count(*) + 2 AS block_count, count(*) AS file_count, count(*) FILTER (doc_id % 29 = 0) AS unverified FROM documents GROUP BY 1")
def validate_first_error(spark, sf_dir):
    v = verify.validation(parse.blocks(create.archives(_faulty(spark, sf_dir))), single=True)
    return v.select("archive_id", "error", "block_count", "file_count", "unverified")


@query("SELECT DISTINCT {ARCHIVE} AS archive_id, cut, false AS is_valid FROM documents, (SELECT unnest([1, 7, 9, 40]) AS cut)")
def truncation_verdict(spark, sf_dir):
    """No archive that lost its last bytes is valid."""
    a = create.archives(document_entries(spark, sf_dir)).withColumn("cut", F.explode(F.array(*(F.lit(n) for n in (1, 7, 9, 40)))))
    cut = a.select(F.concat_ws("|", "archive_id", F.col("cut").cast("string")).alias("archive_id"), "volume", campaign.drop_suffix("content", F.col("cut")).alias("content"))
    v = verify.validation(parse.blocks(cut), single=True)
    return v.select(F.substring_index("archive_id", "|", 1).alias("archive_id"), F.substring_index("archive_id", "|", -1).cast("int").alias("cut"), "is_valid")


@query("WITH s AS (SELECT strlen(text) AS n FROM documents WHERE strlen(text) > 0) SELECT sum(len(list_distinct([0, n // 4, n * 2 // 4, n * 3 // 4, n - 1])))::BIGINT AS mutants, sum(len(list_distinct([0, n // 4, n * 2 // 4, n * 3 // 4, n - 1])))::BIGINT AS damaged FROM s")
def sniper_mutations(spark, sf_dir):
    """One changed byte at the five places of each payload (fewer, where they fall together) damages exactly that entry."""
    e = document_entries(spark, sf_dir).filter(F.octet_length("payload") > 0)
    shots = e.withColumn("at", F.explode(F.array_distinct(campaign.sniper_positions(F.octet_length("payload").cast("long")))))
    shots = shots.withColumn("archive_id", F.concat_ws("|", "archive_id", "entry", F.monotonically_increasing_id().cast("string"))).withColumn("written", campaign.xor_byte("payload", F.col("at")))
    s = verify.summary(verify.verdicts(parse.blocks(create.archives(shots, alone=True)).filter(verify.is_file())))
    return s.agg(F.count("*").alias("mutants"), F.count_if(F.col("damaged") == 1).alias("damaged"))


@query("SELECT {ARCHIVE} AS archive_id, 15 AS family, count(*) AS file_count, true AS is_valid, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY 1")
def old_family_archives(spark, sf_dir):
    b = parse.blocks(create.old_archives(document_entries(spark, sf_dir)))
    size = b.groupBy("archive_id").agg(F.sum("size").alias("bytes"))
    return verify.validation(b, single=True).join(size, "archive_id").select("archive_id", "family", "file_count", "is_valid", "bytes")


@query(
    """WITH s AS (SELECT {ARCHIVE} AS archive_id, doc_id, strlen(text) AS n FROM documents), c AS (SELECT *, sum(n) OVER (PARTITION BY archive_id ORDER BY doc_id) AS upto FROM s),
    v AS (SELECT archive_id, (max(upto) - 1) // 4096 AS last, max(doc_id) FILTER (n > 0) AS final FROM c GROUP BY 1), p AS (SELECT v.*, (upto - n) // 4096 AS a FROM v JOIN c ON c.archive_id = v.archive_id AND c.doc_id = final)
    SELECT archive_id, kind, CASE kind WHEN 'whole' THEN NULL WHEN 'changed' THEN 'CRC32_DIFFERS' ELSE CASE WHEN last >= 1 THEN 'VOLUME_MISSING' END END AS error, kind = 'whole' OR (kind = 'missing' AND last < 1) AS is_valid
    FROM p, (SELECT unnest(['whole', 'changed', 'missing']) AS kind)"""
)
def validate_volumes(spark, sf_dir):
    """Volume sets as they were made, with a byte of the last payload in their last volume changed, and without their second volume."""
    v = create.volumes(document_entries(spark, sf_dir), 4096).withColumn("last", F.max("volume").over(Window.partitionBy("archive_id")))
    kinds = v.withColumn("kind", F.explode(F.array(*(F.lit(k) for k in ("whole", "changed", "missing"))))).filter("kind != 'missing' or volume != 1")
    changed = campaign.xor_byte("content", F.octet_length("content") - 9)  # the last byte before the end block
    content = F.when((F.col("kind") == "changed") & (F.col("volume") == F.col("last")), changed).otherwise(F.col("content"))
    sets = kinds.select(F.concat_ws("|", "archive_id", "kind").alias("archive_id"), "volume", content.alias("content"))
    found = verify.validation(parse.blocks(sets))
    return found.select(F.substring_index("archive_id", "|", 1).alias("archive_id"), F.substring_index("archive_id", "|", -1).alias("kind"), "error", "is_valid")


@query(
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 51 WHEN 1 THEN 14 WHEN 2 THEN 0 WHEN 3 THEN 0 WHEN 4 THEN 50 ELSE 15 END AS family,
    CASE event_id % 6 WHEN 0 THEN 'RECOVERY_DATA' WHEN 1 THEN 'OLDEST_FAMILY' WHEN 2 THEN 'LATER_VERSION' WHEN 3 THEN 'NO_MARK' ELSE 'HEADERS_ENCRYPTED' END AS error, event_id % 6 > 3 AS has_encrypted FROM events"""
)
def validate_dispatch(spark, sf_dir):
    """Files of families that aren't read, of later versions, without a mark, and with encrypted headers, some behind other bytes."""
    e, kind = table(spark, sf_dir, "events"), F.col("event_id") % 6
    old = F.unhex(F.lit("73" + "8000" + "0D00" + "000000000000"))
    old = F.concat(F.unhex(F.lit(S.SIGNATURES[15])), S.le_bytes(F.crc32(old).bitwiseAND(F.lit(65535)), 2), old)
    new = F.concat(create.mark(), create.framed_constant(bytes([4, 0, 0, 0, 15]) + bytes(16)))
    mark = F.when(kind == 0, F.unhex(F.lit(S.SIGNATURES[51]))).when(kind == 1, F.unhex(F.lit(S.SIGNATURES[14]))).when(kind == 2, F.unhex(F.lit("526172211A070300"))).when(kind == 3, F.unhex(F.lit("00"))).when(kind == 4, new).otherwise(old)
    code = F.when(F.col("event_id") % 5 == 0, F.encode("props", "UTF-8")).otherwise(F.expr("X''"))
    files = e.select(F.col("event_id").cast("string").alias("archive_id"), F.lit(0).alias("volume"), F.concat(code, mark, F.encode("props", "UTF-8")).alias("content"))
    v = verify.validation(parse.blocks(files), single=True)
    return v.select(F.col("archive_id").cast("long").alias("event_id"), "family", "error", "has_encrypted")


@query("SELECT {ARCHIVE} AS archive_id, count(*) AS verified, 0::BIGINT AS too_large, true AS filled FROM documents GROUP BY 1")
def volume_file_sizes(spark, sf_dir):
    """Volumes whose files, headers included, have at most 4,096 bytes: none is larger, each but the last lacks no more than a header, and
    every entry verifies."""
    v = create.volumes(document_entries(spark, sf_dir), 4096, headers_count=True)
    last = v.groupBy("archive_id").agg(F.max("volume").alias("last"))
    size = F.octet_length("content")
    fits = v.join(last, "archive_id").groupBy("archive_id").agg(F.count_if(size > 4096).alias("too_large"), F.bool_and((size > 4096 - 80) | (F.col("volume") == F.col("last"))).alias("filled"))
    good = verify.verdicts(verify.assembled(parse.blocks(v)).filter("complete and parts_ok")).groupBy("archive_id").agg(F.count_if(F.col("status") == 0).alias("verified"))
    return good.join(fits, "archive_id").select("archive_id", "verified", "too_large", "filled")


@query("SELECT {ARCHIVE} AS archive_id, lang || '/' || doc_id::VARCHAR || '.txt' AS name, md5(text) AS digest, 0 AS status FROM documents")
def files_round_trip(spark, sf_dir):
    """Volume sets written as files, found again by their names, opened as sets."""
    folder = shared_folder(spark, "volumes")
    extract.write_files(extract.volume_files(create.volumes(document_entries(spark, sf_dir), 65536, headers_count=True)), folder).count()
    v = verify.verdicts(verify.assembled(parse.blocks(archive_files(spark, folder, "*.rar"))))
    return v.select(F.regexp_extract("archive_id", r"([^/]*?)(\.part[0-9]+)?\.rar$", 1).alias("archive_id"), "name", F.md5("payload").alias("digest"), "status")


@query("SELECT {ARCHIVE} || '/' || lang || '/' || doc_id::VARCHAR || '.txt' AS path, md5(text) AS digest, CASE WHEN doc_id % 29 = 0 THEN 'UNSUPPORTED' WHEN doc_id % 17 = 0 AND doc_id % 23 <> 0 AND strlen(text) > 0 THEN 'DAMAGED' END AS reason FROM documents")
def extract_tree(spark, sf_dir):
    """Archives with faults, extracted to a folder: digests of the files read back, and reasons of those that weren't written. (Digests
    of refused entries are those of the documents, so that both sides have one.)"""
    folder = shared_folder(spark, "tree")
    files = verify.verdicts(verify.assembled(parse.blocks(create.archives(_faulty(spark, sf_dir))))).withColumn("mode", F.lit(0o644))
    done = extract.extract(files, folder).select(F.concat_ws("/", "archive_id", "path").alias("path"), "reason")
    read = extract.read_files(done, folder).withColumn("digest", F.md5("content")).drop("content")
    source = document_entries(spark, sf_dir).select(F.concat_ws("/", "archive_id", "name").alias("path"), F.md5("payload").alias("own"))
    both = read.join(source, "path")
    return both.select("path", F.when(F.col("reason").isNull(), F.col("digest")).when(F.col("digest").isNull(), F.col("own")).alias("digest"), "reason")


@query("SELECT {ARCHIVE} AS archive_id, lang || '/' || doc_id::VARCHAR || '.txt' AS name, strlen(text)::BIGINT AS size, strlen(text)::BIGINT AS packed, 1700000000::BIGINT AS mtime, 0 AS method, 1 AS host, 0::BIGINT AS version, false AS is_directory, doc_id % 29 = 0 AS is_encrypted, false AS split_before, false AS split_after FROM documents")
def file_info(spark, sf_dir):
    return verify.file_info(parse.blocks(create.archives(_faulty(spark, sf_dir)))).drop("crc")


@query("SELECT {ARCHIVE} AS archive_id, lang || '/' || doc_id::VARCHAR || '.txt' AS name, f, 32::BIGINT AS attributes, CASE f WHEN 50 THEN 1700000000 ELSE 1344339968 END::BIGINT AS mtime, CASE f WHEN 50 THEN 1 ELSE 2 END AS time_kind, true AS has_posix_mode FROM documents, (SELECT unnest([50, 15]) AS f)")
def entry_metadata(spark, sf_dir):
    e = document_entries(spark, sf_dir)
    made = lambda a, f: verify.metadata(parse.blocks(a)).withColumn("f", F.lit(f))
    return made(create.archives(e), 50).union(made(create.old_archives(e), 15))


@query("SELECT {ARCHIVE} AS archive_id, count(*) AS files, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY 1")
def extract_totals(spark, sf_dir):
    return verify.extract_totals(parse.blocks(create.volumes(document_entries(spark, sf_dir), 4096)))


@query()
def blake2sp_digests(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.lower(F.hex(verify.blake2sp_udf(F.encode("text", "UTF-8")))).alias("digest"))


# ---------------------------------------------------------------- checksums and bytes

_CRC = """t AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
h AS (SELECT {key}, hex(encode({text})) AS h FROM {table}),
l AS (SELECT {key}, list_transform(range(length(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT) AS bytes FROM h),
c AS (SELECT {key}, xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]))) AS crc FROM l, t)"""


@query(f"WITH {_CRC.format(key='p_partkey', text='p_name', table='part')} SELECT p_partkey, crc::BIGINT AS crc32, (crc & 65535)::BIGINT AS crc16 FROM c")
def crc32_names(spark, sf_dir):
    crc = F.crc32(F.encode("p_name", "UTF-8"))
    return table(spark, sf_dir, "part").select("p_partkey", crc.alias("crc32"), crc.bitwiseAND(F.lit(65535)).alias("crc16"))


@query(f"WITH v AS (SELECT l_orderkey, l_linenumber, (l_extendedprice * 100)::BIGINT * l_partkey AS v FROM lineitem) SELECT l_orderkey, l_linenumber, {_VS.format('v')}::INT AS vint_size FROM v")
def vint_size(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.round(F.col("l_extendedprice") * 100).cast("long") * F.col("l_partkey")).alias("v"))
    return rows.select("l_orderkey", "l_linenumber", S.vint_size("v").alias("vint_size"))


@query(
    f"""WITH v AS (SELECT o_orderkey, o_orderkey * o_custkey AS v FROM orders), n AS (SELECT *, {_VS.format('v')} AS n FROM v)
    SELECT o_orderkey, array_to_string(list_transform(range(n), lambda i: printf('%02X', ((v >> (7 * i)) & 127) + CASE WHEN i < n - 1 THEN 128 ELSE 0 END)), '') AS written FROM n"""
)
def vint_bytes(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * F.col("o_custkey")).alias("v"))
    return rows.select("o_orderkey", F.hex(S.vint("v")).alias("written"))


@query("SELECT event_type, count(*) AS files, CASE event_type[1] WHEN 'c' THEN 50 WHEN 'v' THEN 15 WHEN 'p' THEN 51 WHEN 's' THEN 14 ELSE 0 END AS family FROM events GROUP BY 1")
def detect_family(spark, sf_dir):
    """The family of files that begin with different marks."""
    first = F.substring("event_type", 1, 1)
    mark = F.when(first == "c", S.SIGNATURES[50]).when(first == "v", S.SIGNATURES[15]).when(first == "p", S.SIGNATURES[51]).when(first == "s", S.SIGNATURES[14]).otherwise("00")
    e = table(spark, sf_dir, "events").select("event_type", S.family(F.concat(F.unhex(mark), F.encode("props", "UTF-8"))).alias("family"))
    return e.groupBy("event_type", "family").agg(F.count("*").alias("files"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN -1 ELSE strlen(props) END::BIGINT AS at, CASE event_id % 4 WHEN 0 THEN 50 WHEN 1 THEN 15 WHEN 2 THEN 51 ELSE 0 END AS family FROM events")
def sfx_offset(spark, sf_dir):
    """The byte at which an archive begins behind other bytes, and its family; every fourth file holds none."""
    e, kind = table(spark, sf_dir, "events"), F.col("event_id") % 4
    mark = F.when(kind == 0, S.SIGNATURES[50]).when(kind == 1, S.SIGNATURES[15]).when(kind == 2, S.SIGNATURES[51]).otherwise("00")
    found = e.select("event_id", S.detect(F.concat(F.encode("props", "UTF-8"), F.unhex(mark), F.encode("props", "UTF-8"))).alias("d"))
    return found.select("event_id", F.col("d.at").alias("at"), F.col("d.family").alias("family"))


@query("SELECT ascii(c)::INT AS symbol, count(*) AS n FROM (SELECT unnest(string_split(p_name, '')) AS c FROM part) WHERE c <> '' GROUP BY 1")
def symbol_histogram(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", "")).alias("c")).filter("c != ''")
    return p.groupBy(F.ascii("c").alias("symbol")).agg(F.count("*").alias("n"))


@query(
    """WITH b AS (SELECT p_partkey, i, (i - 1) % 3 AS channel, ascii(substr(p_name, i, 1)) AS v FROM (SELECT p_partkey, p_name, unnest(range(1, length(p_name) + 1)) AS i FROM part))
    SELECT p_partkey, i::INT AS at, ((-sum(v) OVER (PARTITION BY p_partkey, channel ORDER BY i))::BIGINT & 255)::BIGINT AS filtered FROM b"""
)
def delta_filter(spark, sf_dir):
    from pyspark.sql import Window

    p = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.split("p_name", "")).alias("k", "c")).filter("c != ''")
    w = Window.partitionBy("p_partkey", F.col("k") % 3).orderBy("k")
    return p.select("p_partkey", (F.col("k") + 1).alias("at"), (-F.sum(F.ascii("c")).over(w)).bitwiseAND(F.lit(255).cast("long")).alias("filtered"))


# ---------------------------------------------------------------- fields

@query("SELECT p_partkey, p_size % 16 AS code, (131072::BIGINT << (p_size % 16)) AS plain, (131072::BIGINT << (p_size % 16)) + (131072::BIGINT << (p_size % 16)) // 32 * (p_size % 32) AS more, greatest(17, length(bin((131072::BIGINT << (p_size % 16)) - 1)))::INT AS bits FROM part")
def dictionary_windows(spark, sf_dir):
    p, code = table(spark, sf_dir, "part"), F.col("p_size") % 16
    window = S.dictionary_window(code)
    return p.select("p_partkey", code.alias("code"), window.cast("long").alias("plain"), S.dictionary_window(code, F.col("p_size") % 32).cast("long").alias("more"), S.dictionary_bits(window).alias("bits"))


@query("SELECT DISTINCT l_linenumber, 1::BIGINT << (16 + least(6, ((l_linenumber * 37) >> 5) & 7)) AS window_bytes FROM lineitem")
def old_dictionary_windows(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_linenumber", S.old_dictionary_window(F.col("l_linenumber") * 37).alias("window_bytes")).distinct()


@query("SELECT p_brand, coalesce(max(CASE WHEN p_size % 5 <> 0 THEN 131072::BIGINT << (p_size % 16) END), 0)::BIGINT AS most FROM part GROUP BY 1")
def max_dictionary(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    window = F.when(F.col("p_size") % 5 != 0, S.dictionary_window(F.col("p_size") % 16))
    return p.groupBy("p_brand").agg(F.coalesce(F.max(window), F.lit(0)).cast("long").alias("most"))


@query("SELECT p_partkey, (p_size % 2 + CASE WHEN p_size % 3 = 0 THEN 64 ELSE 0 END + (p_size % 6) * 128 + (p_size % 15) * 1024)::BIGINT AS raw, (p_size % 6)::BIGINT AS method, p_size % 3 = 0 AS solid, (p_size % 15)::BIGINT AS dictionary FROM part")
def compression_info_bits(spark, sf_dir):
    n = F.col("p_size")
    raw = S.compression_info(n % 2, n % 3 == 0, n % 6, n % 15)
    f = table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"), S.compression_fields(raw).alias("f"))
    return f.select("p_partkey", "raw", "f.method", "f.solid", "f.dictionary")


@query("SELECT o_orderkey, ((year(o_orderdate) - 1980) * 33554432 + month(o_orderdate) * 2097152 + day(o_orderdate) * 65536 + hour(o_orderdate) * 2048 + minute(o_orderdate) * 32 + second(o_orderdate) // 2)::BIGINT AS packed FROM orders")
def dos_time_encode(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", S.dos_time_encode("o_orderdate").alias("packed"))


@query(
    """WITH v AS (SELECT o_orderkey, o_orderkey * 7919 % 4294967296 AS v FROM orders), f AS (SELECT o_orderkey, ((v >> 25) & 127) + 1980 AS y, (v >> 21) & 15 AS mo, (v >> 16) & 31 AS d, (v >> 11) & 31 AS h, (v >> 5) & 63 AS mi, (v & 31) * 2 AS s FROM v)
    SELECT o_orderkey, CASE WHEN h < 24 AND mi < 60 AND s < 60 THEN strftime(try_cast(printf('%04d-%02d-%02d %02d:%02d:%02d', y, mo, d, h, mi, s) AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') END AS local_time FROM f"""
)
def dos_time_decode(spark, sf_dir):
    v = F.pmod(F.col("o_orderkey") * 7919, F.lit(4294967296))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(S.dos_time_decode(v), "yyyy-MM-dd HH:mm:ss").alias("local_time"))


@query("SELECT event_id, CASE WHEN floor(epoch(ts))::BIGINT + (event_id % 3 - 1) * 4000000000 BETWEEN 0 AND 4294967295 THEN floor(epoch(ts))::BIGINT + (event_id % 3 - 1) * 4000000000 END AS guarded FROM events")
def unix_guard(spark, sf_dir):
    seconds = F.unix_timestamp("ts") + (F.col("event_id") % 3 - 1) * 4000000000
    return table(spark, sf_dir, "events").select("event_id", S.unix_guard(seconds).alias("guarded"))


@query("WITH t AS (SELECT event_id, 116444736000000000 + (event_id % 4 - 1) * 10000000000000 + event_id * 1234567 AS t FROM events) SELECT event_id, CASE WHEN t >= 116444736000000000 THEN (t - 116444736000000000) // 10000000 END AS seconds FROM t")
def windows_ticks(spark, sf_dir):
    t = F.lit(S.EPOCH_TICKS) + (F.col("event_id") % 4 - 1) * 10000000000000 + F.col("event_id") * 1234567
    return table(spark, sf_dir, "events").select("event_id", S.windows_ticks_to_unix(t).alias("seconds"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '          ' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders")
def format_date(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", S.calendar_date(F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate"))).alias("d"))


@query("WITH v AS (SELECT p_partkey, p_partkey * p_partkey * 1013 AS n FROM part) SELECT p_partkey, CASE WHEN n < 1024 THEN n::VARCHAR || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0::DOUBLE) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0::DOUBLE) ELSE printf('%.1f GB', n / 1073741824.0::DOUBLE) END AS shown FROM v")
def format_bytes(spark, sf_dir):
    n = F.col("p_partkey") * F.col("p_partkey") * 1013
    return table(spark, sf_dir, "part").select("p_partkey", S.format_bytes(n).alias("shown"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 7 = 0 THEN 100 ELSE (l_partkey * 100) // (l_suppkey % 7 * 1000) END::BIGINT AS ratio FROM lineitem")
def ratio_percent(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.ratio_percent(F.col("l_partkey"), F.col("l_suppkey") % 7 * 1000).alias("ratio"))


@query(
    """WITH s AS (SELECT p_partkey, (p_size % 9) AS d, substr('bkmgtKMGTx', p_size % 11 + 1, 1) AS u FROM part)
    SELECT p_partkey, d::VARCHAR || u AS given, CASE WHEN d = 0 OR u = 'x' THEN NULL ELSE d * CASE u WHEN '' THEN 1000 WHEN 'b' THEN 1 WHEN 'k' THEN 1024 WHEN 'm' THEN 1048576 WHEN 'g' THEN 1073741824 WHEN 't' THEN 1099511627776 WHEN 'K' THEN 1000 WHEN 'M' THEN 1000000 WHEN 'G' THEN 1000000000 ELSE 1000000000000 END END::BIGINT AS bytes FROM s"""
)
def size_suffix(spark, sf_dir):
    given = F.concat((F.col("p_size") % 9).cast("string"), F.substring(F.lit("bkmgtKMGTx"), F.col("p_size") % 11 + 1, F.lit(1)))
    return table(spark, sf_dir, "part").select("p_partkey", given.alias("given"), S.size_suffix(given).alias("bytes"))


@query("SELECT p_partkey, replace(replace(p_name, ' ', '\\'), '\\', '/') AS path, p_name || ';' || p_size::VARCHAR AS versioned, split_part(p_name, ' ', -1) || '.rar' AS archive FROM part")
def names(spark, sf_dir):
    p, path = table(spark, sf_dir, "part"), F.translate("p_name", " ", "\\")
    return p.select("p_partkey", S.normalize_path(path).alias("path"), S.versioned_name("p_name", "p_size").alias("versioned"), S.archive_name(F.concat(S.normalize_path(path), F.lit(".txt"))).alias("archive"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 <> 0 THEN p_size % 4 WHEN p_size % 8 = 0 THEN 16 ELSE 32 END::BIGINT AS attributes, (p_partkey & 511)::BIGINT AS mode FROM part")
def attributes(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.default_attributes(F.col("p_size") % 4, F.col("p_size") % 8 == 0).alias("attributes"), S.posix_mode("p_partkey").alias("mode"))


@query("SELECT o_orderkey, 'set.part' || lpad((o_orderkey % 2000 + 1)::VARCHAR, CASE WHEN o_custkey > 999 THEN 4 WHEN o_custkey > 99 THEN 3 WHEN o_custkey > 9 THEN 2 ELSE 1 END, '0') || '.rar' AS name FROM orders")
def part_names(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", S.part_name(F.lit("set"), F.col("o_orderkey") % 2000 + 1, "o_custkey").alias("name"))


@query(
    """WITH n AS (SELECT DISTINCT o_custkey, o_custkey % 3 AS kind, (o_orderkey % 12 + 1) AS v FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY v) AS place FROM n)
    SELECT o_custkey::VARCHAR AS stem, count(*) AS volumes FROM r WHERE place = v GROUP BY 1"""
)
def volume_discovery(spark, sf_dir):
    """The volumes of each customer's set up to the first that is missing."""
    o = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") % 12 + 1).alias("v")).distinct()
    stem = F.col("o_custkey").cast("string")
    old = F.when(F.col("v") == 1, F.concat(stem, F.lit(".rar"))).otherwise(F.concat(stem, F.lit(".r"), F.lpad((F.col("v") - 2).cast("string"), 2, "0")))
    named = o.select(F.when(F.col("o_custkey") % 3 == 0, old).otherwise(F.concat(stem, F.lit(".part"), F.lpad(F.col("v").cast("string"), 2, "0"), F.lit(".rar"))).alias("name"))
    return volume_sets(named).groupBy(F.substring_index("set_id", ".", 1).alias("stem")).agg(F.count("*").alias("volumes"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN d > 256 THEN 1 ELSE 0 END + CASE WHEN d > 8192 THEN 1 ELSE 0 END + CASE WHEN d > 262144 THEN 1 ELSE 0 END AS bonus FROM (SELECT *, l_partkey * l_suppkey AS d FROM lineitem)")
def length_adjust(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.length_bonus(F.col("l_partkey") * F.col("l_suppkey")).alias("bonus"))


_SLOT = """WITH v AS (SELECT p_partkey, {v} AS n FROM part), b AS (SELECT *, CASE WHEN n < {plain} THEN 0 ELSE length(bin(n)) - {top} END AS bits FROM v)
SELECT p_partkey, CASE WHEN n < {plain} THEN n ELSE (bits + 1) * {per} + (n >> bits) - {per} END::BIGINT AS slot, CASE WHEN n < {plain} THEN 0 ELSE n & ((1 << bits) - 1) END::BIGINT AS extra, bits::BIGINT AS bits FROM b"""


@query(_SLOT.format(v="p_partkey % 4096", plain=8, top=3, per=4))
def length_slot(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.length_slot(F.col("p_partkey") % 4096 + 2).alias("s")).select("p_partkey", "s.*")


@query(_SLOT.format(v="p_partkey * 97", plain=4, top=2, per=2))
def distance_slot(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.distance_slot(F.col("p_partkey") * 97 + 1).alias("s")).select("p_partkey", "s.*")


# ---------------------------------------------------------------- rows in order

@query(
    """WITH r AS (SELECT *, row_number() OVER o AS place FROM lineitem WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice))
    SELECT l_orderkey, place::INT AS place, (sum(CASE WHEN l_returnflag = 'N' OR place = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY place))::BIGINT AS run FROM r"""
)
def solid_runs(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(w).alias("place"), (F.col("l_returnflag") == "N").alias("resets"))
    return verify.solid_runs(rows, ["l_orderkey"], ["place"], "resets").select("l_orderkey", "place", "run")


@query("SELECT p_name AS name, count(*) AS entries FROM part GROUP BY 1 HAVING count(*) > 1 AND NOT bool_and(p_size % 10 = 0)")
def name_collisions(spark, sf_dir):
    p = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("entries"), F.bool_and(F.col("p_size") % 10 == 0).alias("folders"))
    return p.filter("entries > 1 and not folders").select("name", "entries")


@query("SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY length(p_name) DESC, p_partkey)::INT AS place FROM part")
def restore_order(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("p_brand").orderBy(F.length("p_name").desc(), "p_partkey")
    return table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.row_number().over(w).alias("place"))


# ---------------------------------------------------------------- corruption statistics

_TRIALS = """t AS (SELECT user_id % 6 AS input, event_type AS profile, CASE event_id % 4 WHEN 0 THEN 'valid' WHEN 3 THEN 'unverifiable' ELSE 'damaged' END AS tool, CASE event_id % 5 WHEN 0 THEN 'valid' WHEN 4 THEN 'other' ELSE 'damaged' END AS reference FROM events),
o AS (SELECT *, CASE WHEN reference NOT IN ('valid', 'damaged') THEN 'inconclusive' WHEN reference = 'damaged' AND tool = 'damaged' THEN 'detected' WHEN reference = 'damaged' AND tool = 'unverifiable' THEN 'unverifiable' WHEN reference = 'damaged' THEN 'missed' WHEN tool = 'valid' THEN 'survived' ELSE 'disagreement' END AS outcome FROM t)"""


def _trials(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    tool = campaign.tool_class(F.when(F.col("event_id") % 4 == 0, 0).when(F.col("event_id") % 4 == 3, 69).otherwise(1))
    reference = F.when(F.col("event_id") % 5 == 0, "valid").when(F.col("event_id") % 5 == 4, "other").otherwise("damaged")
    return e.select("event_id", (F.col("user_id") % 6).alias("input"), F.col("event_type").alias("profile"), campaign.pair_outcome(tool, reference).alias("outcome"))


@query(f"WITH {_TRIALS} SELECT input, profile, outcome, count(*) AS trials FROM o GROUP BY ALL")
def pair_outcomes(spark, sf_dir):
    return _trials(spark, sf_dir).groupBy("input", "profile", "outcome").agg(F.count("*").alias("trials"))


_Z = 1.959963984540054


@query(
    f"""WITH {_TRIALS}, c AS (SELECT input, profile, count(*) AS trials, count(*) FILTER (outcome = 'detected') AS k, count(*) FILTER (outcome IN ('detected', 'missed', 'unverifiable')) AS n FROM o GROUP BY ALL),
    w AS (SELECT *, k / n AS p, {_Z * _Z}::DOUBLE AS z2 FROM c)
    SELECT input, profile, trials, k AS detected, n AS eligible, round(CASE WHEN k = 0 THEN 0 ELSE greatest(0, (p + z2 / (2 * n) - {_Z}::DOUBLE * sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)) END, 9) AS low,
    round(CASE WHEN k = n THEN 1 ELSE least(1, (p + z2 / (2 * n) + {_Z}::DOUBLE * sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)) END, 9) AS high, n >= 385 AS precision_met FROM w"""
)
def campaign_cells(spark, sf_dir):
    c = campaign.cells(_trials(spark, sf_dir), "input", "profile")
    return c.select("input", "profile", "trials", "detected", "eligible", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"), "precision_met")


@query(f"SELECT DISTINCT p_size, ceil({_Z * _Z}::DOUBLE / (4 * (p_size / 100) * (p_size / 100)))::BIGINT AS trials FROM part")
def sample_sizes(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_size", campaign.sample_size(_Z, F.col("p_size") / 100).alias("trials")).distinct()


@query("SELECT o_orderkey % 140 AS code, CASE WHEN o_orderkey % 140 = 124 THEN 'timeout' WHEN o_orderkey % 140 = 137 THEN 'killed' WHEN o_orderkey % 140 BETWEEN 134 AND 139 THEN 'crash' WHEN o_orderkey % 140 BETWEEN 125 AND 127 THEN 'launch' ELSE 'ended' END AS class, count(*) AS runs FROM orders GROUP BY ALL")
def execution_classes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 140).alias("code"))
    return o.groupBy("code", F.coalesce(campaign.execution_class(F.col("code")), F.lit("ended")).alias("class")).agg(F.count("*").alias("runs"))


@query(
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN CASE event_id % 3 WHEN 0 THEN 'valid' WHEN 1 THEN 'tool-error' ELSE 'damaged' END WHEN 1 THEN CASE event_id % 3 WHEN 1 THEN 'damaged' ELSE 'tool-error' END
    WHEN 2 THEN 'damaged' WHEN 3 THEN CASE event_id % 3 WHEN 0 THEN 'damaged' ELSE 'tool-error' END ELSE 'tool-error' END AS class FROM events"""
)
def reference_classes(spark, sf_dir):
    """What exit codes 0, 1, 3, 13 and 2 of another reader say beside three messages."""
    e, code = table(spark, sf_dir, "events"), F.element_at(F.array(*(F.lit(c) for c in (0, 1, 3, 13, 2))), (F.col("event_id") % 5 + 1).cast("int"))
    kind = F.col("event_id") % 3
    text = F.when(kind == 0, "x.rar\nERROR: Bad archive x.rar").when(kind == 1, "x.rar\r\nUnexpected end of archive\r\n").otherwise("The archive comment is corrupt\nx")
    return e.select("event_id", campaign.reference_class(code, text).alias("class"))


@query(
    """WITH c AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'valid' WHEN 1 THEN 'damaged' ELSE 'tool-error' END AS r, CASE event_id % 4 WHEN 0 THEN 'valid' WHEN 1 THEN 'damaged' WHEN 2 THEN 'unverifiable' ELSE 'valid' END AS t FROM events)
    SELECT event_id, CASE WHEN r = 'valid' AND t = 'valid' THEN 'benign' WHEN r = 'valid' AND t = 'damaged' THEN 'stricter' WHEN r = 'damaged' AND t = 'valid' THEN 'missed' WHEN r = 'damaged' AND t = 'damaged' THEN 'detected' ELSE 'inconclusive' END AS pair FROM c"""
)
def mutation_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    reference = F.when(F.col("event_id") % 3 == 0, "valid").when(F.col("event_id") % 3 == 1, "damaged").otherwise("tool-error")
    tool = F.when(F.col("event_id") % 4 == 1, "damaged").when(F.col("event_id") % 4 == 2, "unverifiable").otherwise("valid")
    return e.select("event_id", campaign.mutation_pair(reference, tool).alias("pair"))


@query(
    f"""WITH {_TRIALS.replace('user_id % 6 AS input', 'event_id, user_id % 6 AS input')}, w AS (SELECT *, row_number() OVER p AS turn, coalesce(sum((outcome IN ('detected', 'missed', 'unverifiable'))::INT) OVER (PARTITION BY input, profile ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done
    FROM o WINDOW p AS (PARTITION BY input, profile ORDER BY event_id)) SELECT input, profile, count(*) AS attempts, count(*) FILTER (outcome = 'detected') AS detected FROM w WHERE done < 20 AND turn <= 80 GROUP BY ALL"""
)
def campaign_stop(spark, sf_dir):
    """What a campaign runs of each cell's trials that stops at 20 eligible ones or at 80 attempts."""
    run = campaign.until_target(_trials(spark, sf_dir), "input", "profile", order="event_id", target=20)
    return run.groupBy("input", "profile").agg(F.count("*").alias("attempts"), F.count_if(F.col("outcome") == "detected").alias("detected"))


@query("SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN 'tool-error' WHEN event_id % 4 = 0 THEN 'valid' WHEN event_id % 4 = 1 THEN 'damaged' WHEN event_id % 4 = 2 THEN 'unverifiable' ELSE 'tool-error' END AS class FROM events")
def tool_verdicts(spark, sf_dir):
    """A verdict counts if the output has one line of it, not none nor two."""
    e = table(spark, sf_dir, "events")
    code = F.element_at(F.array(*(F.lit(c) for c in (0, 1, 69, 2))), (F.col("event_id") % 4 + 1).cast("int"))
    output = F.when(F.col("event_id") % 3 == 0, "x\nValidation: y\n").when(F.col("event_id") % 3 == 1, "x").otherwise("Validation: y\nValidation: z")
    return e.select("event_id", campaign.tool_verdict(code, output).alias("class"))

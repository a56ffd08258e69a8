"""Where archives and entries come from: files, tables, volume names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Documents with neighbouring ids that one archive holds at most: archives are units of bounded size.
ENTRIES = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the cluster's shared one; on a single machine without such a setting, in its temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="quern-")
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def archive_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """archive_id, volume and content of every file under a folder. The volumes of a set (see ``volume_sets``) are one archive under the
    path of the first, numbered from 0; files behind a missing volume, and all others, are archives of their own under their paths."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    sets = volume_sets(files.select("path"), "path")
    first = sets.filter("volume = 1").select("set_id", F.col("name").alias("first"))
    placed = sets.join(first, "set_id").select(F.col("name").alias("path"), "first", F.col("volume") - 1)
    placed = placed.toDF("path", "first", "volume")
    return files.select("path", "content").join(placed, "path", "left").select(F.coalesce("first", "path").alias("archive_id"), F.coalesce("volume", F.lit(0)).cast("int").alias("volume"), "content")


def walk(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, is_directory and place of all files under a folder and of the folders above them, every folder after what is in
    it. Only names and sizes are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "length")
    root = F.lit(path.split("://", 1)[-1].split(":", 1)[-1].rstrip("/"))
    below = files.select(F.substring_index(F.col("path"), "://", -1).alias("path"), "length")
    below = below.select(F.regexp_replace("path", "^(file:)?/*", "/").alias("path"), "length")
    folders = directories(below).withColumnRenamed("directory", "path").filter(F.col("path").startswith(F.concat(root, F.lit("/"))))
    both = below.withColumn("is_directory", F.lit(False)).union(folders.select("path", F.lit(0).cast("long"), F.lit(True)))
    # A folder sorts behind all paths below it: "/" ends files' parents, and the last code point ends folders.
    return both.withColumn("place", F.when(F.col("is_directory"), F.concat("path", F.lit("/\U0010ffff"))).otherwise(F.col("path")))


def directories(paths: DataFrame, name: str = "path") -> DataFrame:
    """The folders above the given paths, each once."""
    parts = F.split(F.col(name), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    some = paths.filter(F.size(parts) > 1).select(F.explode(prefixes).alias("directory"))
    return some.filter("directory != ''").distinct()


def document_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as entries: one archive for each source and ENTRIES neighbouring ids, in the order of doc_id."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.concat_ws("-", "source", F.floor(F.col("doc_id") / ENTRIES).cast("string")).alias("archive_id"), F.col("doc_id").alias("entry"),
        F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.encode("text", "UTF-8").alias("payload"),
        F.lit(1700000000).cast("long").alias("mtime"), F.lit(False).alias("is_directory"), F.lit(False).alias("is_encrypted"), F.lit(True).alias("has_crc"),
    )


def volume_sets(names: DataFrame, name: str = "name") -> DataFrame:
    """set_id, volume and the name of the volumes of each set, from the first up to the first that is missing.
    Names are ``x.partN.rar`` (equal digits in a set) or ``x.rar, x.r00, x.r01, ...``."""
    n = F.col(name)
    new, old = r"^(.*)\.part([0-9]{1,4})\.rar$", r"^(.*)\.r([0-9]{2})$"
    digits = F.regexp_extract(n, new, 2)
    rows = names.select(
        n.alias("name"),
        F.when(n.rlike(new), F.concat(F.regexp_extract(n, new, 1), F.lit(".part"), F.length(digits).cast("string")))
        .when(n.rlike(old), F.concat(F.regexp_extract(n, old, 1), F.lit(".old"))).when(n.rlike(r"\.rar$"), F.concat(F.regexp_replace(n, r"\.rar$", ""), F.lit(".old"))).alias("set_id"),
        F.when(n.rlike(new), digits.try_cast("int")).when(n.rlike(old), F.regexp_extract(n, old, 2).try_cast("int") + 2).otherwise(1).alias("volume"),
    )
    placed = rows.filter("set_id is not null").withColumn("at", F.row_number().over(Window.partitionBy("set_id").orderBy("volume")))
    return placed.filter("at = volume").select("set_id", "volume", "name")

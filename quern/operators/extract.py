"""Writing files from tasks: archives and volumes by their names, and the entries of archives as a tree with a table of what was written."""

from __future__ import annotations

import os
import posixpath

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import normalize_path, part_name
from .parse import BATCH_BYTES

WRITTEN = "path string, bytes long"


def _put(store: fs.FileSystem, path: str, data: bytes) -> None:
    """Writes beside the file and moves it there, so a task that runs twice leaves one whole file."""
    store.create_dir(posixpath.dirname(path), recursive=True)
    part = f"{path}.part-{os.getpid()}"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, path)


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes rows (path below the folder, content) as files when it is run; gives path and bytes of each. ``folder``: a place that
    every executor reaches, as a path or an address."""

    def run(batches):
        store, base = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        for batch in batches:
            paths, data = batch.column("path").to_pylist(), batch.column("content").to_pylist()
            for path, content in zip(paths, data, strict=True):
                _put(store, f"{base}/{path}", content or b"")
            yield pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string()), "bytes": pa.array([len(c or b"") for c in data], pa.int64())})

    return files.select("path", "content").mapInArrow(run, WRITTEN)


def read_files(files: DataFrame, folder: str) -> DataFrame:
    """Adds content to rows with a path below the folder: the bytes of its file, null where there is none. Tasks open the files by these paths, so no
    list of them passes the driver. ``folder`` as in ``write_files``."""
    kept = files.columns

    def run(batches):
        store, base = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        for batch in batches:
            first, found, held = 0, [], 0
            for path in batch.column("path").to_pylist():
                try:
                    with store.open_input_stream(f"{base}/{path}") as file:
                        found.append(file.read())
                except FileNotFoundError:
                    found.append(None)
                held += len(found[-1] or b"")
                if held >= BATCH_BYTES or first + len(found) == batch.num_rows:
                    part = batch.slice(first, len(found))
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(found, pa.binary())], names=[*kept, "content"])
                    first, found, held = first + len(found), [], 0

    return files.mapInArrow(run, ", ".join([*(f"{c} {t}" for c, t in files.dtypes), "content binary"]))


def volume_files(volumes: DataFrame) -> DataFrame:
    """path and content of volume sets (archive_id, volume, content): ``id.partN.rar``, ``id.rar`` for a single volume."""
    count = volumes.groupBy("archive_id").agg(F.count("*").alias("n"))
    name = F.when(F.col("n") == 1, F.concat("archive_id", F.lit(".rar"))).otherwise(part_name("archive_id", F.col("volume") + 1, "n"))
    return volumes.join(count, "archive_id").select(name.alias("path"), "content")


def refused(name: Column) -> Column:
    """Why a name can't be a path below a folder; null if it can."""
    parts = F.split(name, "/")
    return (
        F.when(F.coalesce(F.length(name), F.lit(0)) == 0, "EMPTY_NAME").when(name.startswith("/") | name.rlike("^[A-Za-z]:"), "NOT_BELOW").when(F.array_contains(parts, "..") | F.array_contains(parts, "."), "NOT_BELOW")
        .when(name.rlike("[\\x00-\\x1f]"), "CONTROL_CHARACTER")
    )


def planned(files: DataFrame) -> DataFrame:
    """Adds path and reason to judged files (see ``verify.verdicts``). A reason keeps an entry from being written: a name that leads out of
    the folder, one that another entry of the archive has too (two folders may share one) or that is a folder above another entry's,
    a missing piece, a payload that can't be read or differs from its checksum."""
    path = F.regexp_replace(normalize_path("name"), "/+$", "")
    rows = files.withColumn("path", path)
    names = rows.groupBy("archive_id", "path").agg(F.count("*").alias("sharing"), F.bool_and("is_directory").alias("all_folders"))
    above = rows.select("archive_id", F.split("path", "/").alias("p")).filter(F.size("p") > 1)
    above = above.select("archive_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.array_join(F.slice("p", 1, i), "/"))).alias("path")).distinct()
    rows = rows.join(names, ["archive_id", "path"]).join(above.withColumn("is_above", F.lit(True)), ["archive_id", "path"], "left")
    clash = ((F.col("sharing") > 1) & ~F.col("all_folders")) | (F.coalesce("is_above", F.lit(False)) & ~F.col("is_directory"))
    reason = F.coalesce(refused(F.col("path")), F.when(clash, "NAME_TAKEN").when(~F.col("complete"), "PIECE_MISSING").when(F.col("status") == 3, "UNSUPPORTED").when(F.col("status").isin(1, 4), "DAMAGED"))
    return rows.withColumn("reason", reason).drop("sharing", "all_folders", "is_above")


def extract(files: DataFrame, folder: str) -> DataFrame:
    """Writes judged files (see ``planned``; with archive_id, name, mtime, mode, payload, is_directory) to ``folder/archive_id/path``, and beside
    them a Parquet table ``_entries`` of archive_id, name, path, bytes, mtime, mode, is_directory and reason, which it returns. On a file
    system, times and permission bits (the low nine, nothing more) are restored, of folders after what is in them."""
    rows = planned(files)
    kept = ["archive_id", "name", "path", "mtime", "mode", "is_directory", "reason"]

    def run(batches):
        store, base = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        for batch in batches:
            sizes = []
            for r in batch.to_pylist():
                target = f"{base}/{r['archive_id']}/{r['path']}"
                size = 0
                if r["reason"] is None and r["is_directory"]:
                    store.create_dir(target, recursive=True)
                elif r["reason"] is None:
                    size = len(r["payload"] or b"")
                    _put(store, target, r["payload"] or b"")
                    _restore(store, target, r)
                sizes.append(size)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sizes, pa.int64())], names=[*kept, "bytes"])

    types = dict(rows.dtypes)
    written = rows.select(*kept, "payload").mapInArrow(run, ", ".join([*(f"{c} {types[c]}" for c in kept), "bytes long"]))
    written.write.mode("overwrite").parquet(f"{folder}/_entries")
    table = files.sparkSession.read.parquet(f"{folder}/_entries")

    def folders(batches):
        store, base = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        for batch in batches:
            for r in batch.to_pylist():
                _restore(store, f"{base}/{r['archive_id']}/{r['path']}", r)
            yield batch.select(["path"])

    deep_first = table.filter("is_directory and reason is null").select("archive_id", "path", "mtime", "mode", F.size(F.split("path", "/")).alias("depth"))
    deep_first.repartition("archive_id").sortWithinPartitions(F.desc("depth")).mapInArrow(folders, "path string").count()
    return table


def _restore(store: fs.FileSystem, target: str, row: dict) -> None:
    if not isinstance(store, fs.LocalFileSystem):
        return
    if row["mode"] is not None:
        os.chmod(target, row["mode"] & 0o777)
    if row["mtime"] is not None:
        os.utime(target, (row["mtime"], row["mtime"]))

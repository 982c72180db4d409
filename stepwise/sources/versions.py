"""Tables that change by whole versions: row-level DELETE, MERGE and replace that rewrite touched files only.

A table is a folder of Parquet files that never change, plus ``_versions/<n>``, one small text file per version that
lists the files the version consists of. A change writes its new files first and the list last, under the next
number, which only one writer can create. Readers take the newest complete list: whatever stops a writer, they see
the version before or the version after, whole. Lists without their last line belong to writers that stopped, and
are passed over.

* ``replace_table`` — ``CREATE OR REPLACE TABLE t AS SELECT … FROM t`` (S07).
* ``delete_rows``, ``replace_rows``, ``merge_rows`` — S09, S11, S10: the files that hold a key are found by one
  semi join over the key column and ``_metadata.file_path``; they alone are read, rewritten and left out of the new list.
* ``drop_unreferenced`` — deletes files of older versions.

A plain Parquet folder becomes such a table with its first change; plain readers go on seeing its old files. Folders
partitioned by column values are refused (overwrite their partitions instead). The driver holds file names, never rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stepwise.operators.joins import key_frame
from stepwise.sources.sinks import delete_keys, merge_update

VERSIONS, DATA, END = "_versions", "_data", "end"


class TableChanged(RuntimeError):
    """Another writer made a version while this one was at work; repeat the change."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(p)


def _files_below(spark: SparkSession, path: str) -> list[str]:
    """Data files in a folder and below, relative to it; hidden ones (``_``, ``.``) are left out."""
    fs, root = _fs(spark, path)
    if not fs.exists(root):
        return []
    found, base = fs.listFiles(root, True), root.toUri().getPath().rstrip("/") + "/"
    out = []
    while found.hasNext():
        name = found.next().getPath().toUri().getPath().removeprefix(base)
        if not any(part[0] in "_." for part in name.split("/")):
            out.append(name)
    return sorted(out)


def _lists(spark: SparkSession, path: str) -> list[tuple[int, bool]]:
    """(number, complete) of every list that was begun, rising."""
    fs, folder = _fs(spark, f"{path.rstrip('/')}/{VERSIONS}")
    if not fs.exists(folder):
        return []
    numbers = sorted(int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit())
    return [(n, _read_list(spark, path, n) is not None) for n in numbers]


def _read_list(spark: SparkSession, path: str, number: int) -> tuple[StructType, list[str]] | None:
    fs, file = _fs(spark, f"{path.rstrip('/')}/{VERSIONS}/{number:08d}")
    stream = fs.open(file)
    try:
        lines = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n")
    finally:
        stream.close()
    return (StructType.fromJson(json.loads(lines[0])), lines[1:-1]) if lines[-1] == END else None


def current(spark: SparkSession, path: str) -> tuple[int, StructType, list[str]]:
    """(number, schema, files) of the newest version; number 0 is a plain folder's content."""
    for number, complete in reversed(_lists(spark, path)):
        if complete:
            return number, *_read_list(spark, path, number)
    files = _files_below(spark, path)
    if any("=" in part for f in files for part in f.split("/")[:-1]):
        raise ValueError(f"{path} is partitioned by column values: overwrite its partitions instead")
    return 0, spark.read.parquet(path).schema if files else StructType(), files


def _read(spark: SparkSession, path: str, schema: StructType, files: Sequence[str]) -> DataFrame:
    root = path.rstrip("/")
    return spark.read.schema(schema).parquet(*[f"{root}/{f}" for f in files]) if files else spark.createDataFrame([], schema)


def read_version(spark: SparkSession, path: str) -> DataFrame:
    """The table's newest version (a plain Parquet folder's content if it has none)."""
    _, schema, files = current(spark, path)
    return _read(spark, path, schema, files)


def _write_files(df: DataFrame, path: str) -> list[str]:
    folder = f"{DATA}/{uuid.uuid4().hex}"
    df.write.parquet(f"{path.rstrip('/')}/{folder}")
    return [f"{folder}/{f}" for f in _files_below(df.sparkSession, f"{path.rstrip('/')}/{folder}")]


def _commit(spark: SparkSession, path: str, after: int, schema: StructType, files: Sequence[str]) -> int:
    """Write the list of the version that follows version ``after``; the one step that readers see."""
    begun = _lists(spark, path)
    if any(complete and n > after for n, complete in begun):
        raise TableChanged(f"{path} has a newer version than {after}")
    number = max([after, *(n for n, _ in begun)]) + 1
    fs, file = _fs(spark, f"{path.rstrip('/')}/{VERSIONS}/{number:08d}")
    try:
        out = fs.create(file, False)
    except Exception as ex:  # the file system says that it exists
        raise TableChanged(f"{path}: version {number} was begun by another writer") from ex
    out.write(bytearray("\n".join([schema.json(), *files, END]).encode()))
    out.close()
    return number


def replace_table(df: DataFrame, path: str) -> int:
    """``CREATE OR REPLACE TABLE``: ``df`` may read the table itself. Returns the new version's number."""
    spark = df.sparkSession
    begun = _lists(spark, path)
    after = max((n for n, complete in begun if complete), default=0)
    return _commit(spark, path, after, df.schema, _write_files(df, path))


def _keys(table: DataFrame, keys, on: str) -> DataFrame:
    k = key_frame(table.sparkSession, keys, "_vk", table.schema[on].dataType) if not isinstance(keys, DataFrame) else \
        keys.select(F.col(on if on in keys.columns else keys.columns[0]).alias("_vk"))
    return k.where("_vk is not null").distinct()


def touched_files(table: DataFrame, keys: DataFrame, on: str, among: Column | None = None) -> list[str]:
    """Paths of the files of ``table`` that hold one of ``keys`` (in a row for which ``among`` holds)."""
    held = (table if among is None else table.where(among)).select(F.col(on).alias("_on"), F.col("_metadata.file_path").alias("_file"))
    found = held.join(keys, F.col("_on") == F.col("_vk"), "left_semi").select("_file").distinct().collect()
    uri = table.sparkSession._jvm.java.net.URI
    return sorted(uri(r["_file"]).getPath() for r in found)


def _rewrite(spark: SparkSession, path: str, keys, on: str, change: Callable[[DataFrame, DataFrame], DataFrame],
             among: Column | None = None, more: DataFrame | None = None) -> int:
    number, schema, files = current(spark, path)
    table = _read(spark, path, schema, files)
    ks = _keys(table, keys, on)
    root = _fs(spark, path)[1].toUri().getPath().rstrip("/") + "/"
    hit = {f.removeprefix(root) for f in touched_files(table, ks, on, among)} if files else set()
    new = change(_read(spark, path, schema, sorted(hit)), ks) if hit else None
    if more is not None:
        rows = more.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
        new = rows if new is None else new.unionByName(rows)
    if new is None:
        return number
    return _commit(spark, path, number, schema, [f for f in files if f not in hit] + _write_files(new, path))


def delete_rows(spark: SparkSession, path: str, keys, on: str) -> int:
    """``DELETE FROM t WHERE on IN (keys)``; rows with a null key stay. Returns the number of the version it leaves."""
    return _rewrite(spark, path, keys, on, lambda part, ks: delete_keys(part, ks, on, "_vk"))


def replace_rows(spark: SparkSession, path: str, rows: DataFrame, on: str, keys=None) -> int:
    """``DELETE FROM t WHERE on IN (keys); INSERT INTO t SELECT rows`` as one version; ``keys`` default to those of ``rows``."""
    ks = rows.select(on) if keys is None else keys
    return _rewrite(spark, path, ks, on, lambda part, ks: delete_keys(part, ks, on, "_vk"), more=rows)


def merge_rows(spark: SparkSession, path: str, source: DataFrame, on: str, updates: dict[str, Column], when: Column | None = None,
               among: Column | None = None) -> int:
    """``MERGE t USING source ON on WHEN MATCHED [AND when] THEN UPDATE SET …``, as in ``merge_update``. ``among`` is a
    condition on the table's own columns that ``when`` implies: files without such a matching row stay."""
    return _rewrite(spark, path, source.select(on), on, lambda part, ks: merge_update(part, source, [on], updates, when), among=among)


def drop_unreferenced(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Delete the files that none of the last ``keep`` versions lists, and the older lists; the number of files deleted.
    Run it when no reader or writer is at work on an older version."""
    done = [n for n, complete in _lists(spark, path) if complete]
    if not done:
        return 0
    kept = {f for n in done[-keep:] for f in _read_list(spark, path, n)[1]}
    root, folder = path.rstrip("/"), f"{path.rstrip('/')}/{DATA}"
    gone = [f for f in _files_below(spark, root) + [f"{DATA}/{f}" for f in _files_below(spark, folder)] if f not in kept]
    for name in [*gone, *(f"{VERSIONS}/{n:08d}" for n in done[:-keep])]:
        fs, file = _fs(spark, f"{root}/{name}")
        fs.delete(file, False)
    return len(gone)

"""Table maintenance: append, keyed delete/replace, conditional merge, create-or-replace.

Parquet paths have no row-level DELETE/MERGE, so each statement is expressed as the DataFrame of the
table's *new content* (pure, testable) plus one writer that stages it and swaps it in:

* ``delete_keys``   — ``DELETE FROM t WHERE k IN (…)`` → ``t LEFT ANTI keys`` (null keys survive).
* ``replace_keys``  — ``DELETE …; INSERT …`` as one write (no window where the rows are missing).
* ``merge_update``  — ``MERGE … WHEN MATCHED AND cond THEN UPDATE SET col = …``.
* ``only_new``      — ``WHERE id NOT IN (SELECT id FROM target)`` with null-aware semantics.
* ``write_replace`` — ``CREATE OR REPLACE TABLE t AS SELECT … FROM t``: write to a staging path,
  then swap, because Spark cannot overwrite a path it is reading.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwise.operators.joins import anti_null_aware, key_frame


def _names(cols) -> list[str]:
    if isinstance(cols, str):
        return [cols]
    return list(cols)


def align(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``INSERT INTO t (cols) SELECT …``: positional mapping of the select list onto ``columns``."""
    if len(df.columns) != len(columns):
        raise ValueError(f"{len(df.columns)} values for {len(columns)} columns")
    return df.select(*[F.col(c).alias(t) for c, t in zip(df.columns, columns)])


def append_rows(df: DataFrame, path: str, columns: Sequence[str] | None = None, fmt: str = "parquet") -> None:
    """Append rows to a table path (positional column list like ``INSERT INTO t (cols)``)."""
    out = align(df, columns) if columns else df
    out.write.mode("append").format(fmt).save(path)


def delete_keys(target: DataFrame, keys, on: str, key_col: str | None = None) -> DataFrame:
    """Content of ``target`` after ``DELETE … WHERE on IN (keys)``; rows with a null key are kept."""
    k = key_frame(target.sparkSession, keys, "_dk") if not isinstance(keys, DataFrame) else \
        keys.select(F.col(key_col or keys.columns[0]).alias("_dk"))
    k = k.filter(F.col("_dk").isNotNull()).distinct()
    return target.join(k, target[on] == k["_dk"], "left_anti")


def replace_keys(target: DataFrame, rows: DataFrame, on: str, keys=None) -> DataFrame:
    """``DELETE FROM t WHERE on IN (keys); INSERT INTO t SELECT rows`` as one new content.

    ``keys`` defaults to the keys present in ``rows``; pass the full id list when ids without new
    rows must be deleted too (the warehouse script deletes the whole list).
    """
    ks = keys if keys is not None else rows.select(on)
    kept = delete_keys(target, ks, on)
    return kept.unionByName(rows.select(*target.columns))


def merge_update(target: DataFrame, source: DataFrame, on: Sequence[str], updates: dict[str, Column],
                 when: Column | None = None) -> DataFrame:
    """``MERGE target USING source ON on WHEN MATCHED [AND when] THEN UPDATE SET col = expr``.

    ``updates`` and ``when`` reference target columns as ``t.<col>`` and source columns as
    ``s.<col>``. Two source rows with one key stop the job, as MERGE does. Updates take the target
    column's type.
    """
    on = _names(on)
    t = target.alias("t")
    # one row per key, or an error: the count rides along with the grouping that the join needs anyway
    row = F.struct(*[F.col(c) for c in source.columns])
    only = source.filter(F.expr(" and ".join(f"`{k}` is not null" for k in on))).groupBy(*on).agg(
        F.any_value(row).alias("_row"), F.count(F.lit(1)).alias("_n"))
    checked = F.when(F.col("_n") == 1, F.col("_row")).otherwise(F.raise_error(F.lit("MERGE: several source rows match one key")).cast(
        only.schema["_row"].dataType))
    s = only.select(checked.alias("_row")).select("_row.*").alias("s")
    j = t.join(s, [F.col(f"t.{k}") == F.col(f"s.{k}") for k in on], "left")
    matched = F.col(f"s.{on[0]}").isNotNull()
    for k in on[1:]:
        matched = matched & F.col(f"s.{k}").isNotNull()
    cond = matched if when is None else (matched & F.coalesce(when, F.lit(False)))
    out = []
    for c in target.columns:
        if c in updates:
            out.append(F.when(cond, updates[c].cast(target.schema[c].dataType)).otherwise(F.col(f"t.{c}")).alias(c))
        else:
            out.append(F.col(f"t.{c}").alias(c))
    return j.select(*out)


def only_new(df: DataFrame, target: DataFrame, on: str, target_key: str | None = None) -> DataFrame:
    """Rows of ``df`` whose key is ``NOT IN (SELECT key FROM target)`` (SQL null semantics)."""
    return anti_null_aware(df, target, on, target_key or on)


def write_replace(df: DataFrame, path: str, fmt: str = "parquet", staging_root: str | None = None) -> str:
    """``CREATE OR REPLACE TABLE`` for a path that ``df`` may itself read from.

    Writes to a staging folder next to the table (same file system, so the swap is a rename), then
    replaces the table folder. Returns the final path. Each rename is checked; the swap is two renames,
    so it is not atomic, and on object stores a rename is a copy.
    """
    spark = df.sparkSession
    jvm = spark._jvm
    hconf = spark._jsc.hadoopConfiguration()
    dst = jvm.org.apache.hadoop.fs.Path(path)
    fs = dst.getFileSystem(hconf)
    staging = f"{staging_root or path.rstrip('/')}.__staging_{uuid.uuid4().hex}"
    df.write.mode("overwrite").format(fmt).save(staging)
    backup = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.__old_{uuid.uuid4().hex}")
    had_old = fs.exists(dst)
    if had_old and not fs.rename(dst, backup):
        fs.delete(jvm.org.apache.hadoop.fs.Path(staging), True)
        raise RuntimeError(f"could not move {path} aside")
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(staging), dst):
        if had_old:
            fs.rename(backup, dst)
        raise RuntimeError(f"could not move {staging} to {path}")
    if had_old:
        fs.delete(backup, True)
    return path

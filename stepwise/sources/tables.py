"""Readers: tables, sharded datasets, JDBC queries and untyped sheets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path_or_name: str, fmt: str = "parquet") -> DataFrame:
    """``FROM table``: a catalog table name or a path (Parquet by default)."""
    if "/" in path_or_name or path_or_name.endswith(f".{fmt}"):
        return spark.read.format(fmt).load(path_or_name)
    return spark.table(path_or_name)


def write_shards(df: DataFrame, path: str, shard_col: str, mode: str = "overwrite", rows_per_file: int = 4_000_000) -> None:
    """Lay a dataset out as ``path/<shard_col>=<value>/`` so a shard filter prunes directories.

    The shards are counted first, and each is spread over as many tasks as its rows ask for by a hash
    of their content (a deterministic salt, so a retried task writes the same rows): a shard holding a
    third of the data is written by many tasks, whatever the data's size.
    """
    counts = df.groupBy(F.col(shard_col).alias("_shard")).agg(F.greatest(F.ceil(F.count(F.lit(1)) / rows_per_file), F.lit(1)).alias("_files"))
    sized = df.join(counts, df[shard_col].eqNullSafe(counts["_shard"])).withColumn(
        "_salt", F.pmod(F.xxhash64(*[df[c] for c in df.columns]), F.col("_files")))
    sized.repartition(F.col(shard_col), F.col("_salt")).select(*[df[c] for c in df.columns]).write.mode(mode).partitionBy(shard_col).parquet(path)


def read_shards(spark: SparkSession, path: str, shard_col: str, shards: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """``FROM t.* WHERE _table_suffix = x``: read a partitioned dataset and keep some shards.

    A literal shard list becomes a partition filter (directories are never listed/opened). Pass a
    DataFrame of shard names to let dynamic partition pruning pick them at run time from a join.
    """
    df = spark.read.parquet(path)
    if shards is None:
        return df
    if isinstance(shards, DataFrame):
        s = shards.select(F.col(shards.columns[0]).alias("_shard")).distinct()
        return df.join(s, df[shard_col] == s["_shard"], "left_semi")
    return df.filter(F.col(shard_col).isin(list(shards)))


def read_jdbc(spark: SparkSession, url: str, query: str, *, properties: dict | None = None,
              partition_column: str | None = None, lower_bound=None, upper_bound=None,
              num_partitions: int | None = None, reader=None) -> DataFrame:
    """``EXTERNAL_QUERY(conn, sql)``: a pushed-down query on an operational database.

    With ``partition_column`` and bounds the read is split into ``num_partitions`` parallel range
    queries (the query is wrapped as a subquery); without it one task reads the whole result, which is
    meant for dimension tables only. ``reader`` lets tests inject any DataFrame
    factory instead of a live connection.
    """
    if reader is not None:
        return reader(query)
    r = spark.read.format("jdbc").option("url", url)
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    if partition_column:
        r = (r.option("dbtable", f"({query}) q").option("partitionColumn", partition_column)
             .option("lowerBound", str(lower_bound)).option("upperBound", str(upper_bound))
             .option("numPartitions", str(num_partitions or 8)))
    else:
        r = r.option("query", query)
    return r.load()


def read_sheet(spark: SparkSession, path: str, n_fields: int, header_value: str = "Item",
               header_field: int = 0) -> DataFrame:
    """Untyped spreadsheet export: every column a string ``string_field_N``; header rows dropped.

    The header row is recognised by ``header_value`` in ``string_field_<header_field>`` (the
    export keeps it as data). Typing is left to the import job (``try_cast``).
    """
    schema = ", ".join(f"string_field_{i} string" for i in range(n_fields))
    df = spark.read.schema(schema).option("header", "false").csv(path)
    hf = f"string_field_{header_field}"
    return df.filter(~F.coalesce(F.col(hf) == F.lit(header_value), F.lit(False)))

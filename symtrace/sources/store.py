"""Writing to and merging relations: insert-or-ignore, upserts, surrogate keys, merges, schema evolution, integrity."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symtrace.operators.lineage import cut


def insert_or_ignore(rows: DataFrame, key: list[str], target: DataFrame | None = None, order: Iterable[str | Column] = ()) -> DataFrame:
    """New rows of distinct keys that the target doesn't have; with an order the first of equal keys wins."""
    order = list(order) or [c for c in rows.columns if c not in key] or key
    w = Window.partitionBy(*key).orderBy(*order)
    out = rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    return out if target is None else out.join(target.select(*key), key, "left_anti")


def upsert_sum(rows: DataFrame, key: list[str], counter: str) -> DataFrame:
    """One row of each key with the sum of the counter."""
    return rows.groupBy(*key).agg(F.sum(counter).alias(counter))


def upsert_replace(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new, and those of old whose keys new doesn't have."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def numbered(rows: DataFrame, *order: str | Column, id_col: str = "id") -> DataFrame:
    """Dense ids from 1 in the given order, which must be total: rows are range-partitioned, numbered within their range,
    and the ranges' counts (one number a partition) are summed up before them. No single task holds all rows."""
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = rows.repartitionByRange(*by).withColumn("__p", F.spark_partition_id())
    # The partition of a row depends on sampled bounds, so it is fixed by a checkpoint before it is used twice.
    local = cut(ranged.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy(*by))))
    ends = local.groupBy("__p").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = ends.withColumn("__s", F.coalesce(F.sum("__n").over(before), F.lit(0))).select("__p", "__s")
    return local.join(F.broadcast(starts), "__p").withColumn(id_col, (F.col("__s") + F.col("__r")).cast("long")).drop("__p", "__r", "__s")


def balanced(files: DataFrame, size: str, n: int) -> DataFrame:
    """files with a chunk 0..n-1: dealt round-robin from large to small; ties go by the other columns."""
    ranked = numbered(files, F.desc(size), *[c for c in files.columns if c != size], id_col="__k")
    return ranked.withColumn("chunk", ((F.col("__k") - 1) % n).cast("int")).drop("__k")


def merge_sources(functions: DataFrame, strings: DataFrame, usage: DataFrame, calls: DataFrame) -> dict[str, DataFrame]:
    """Outputs of many workers, unioned with natural keys, as one set of relations. functions: hash, ...; strings: content;
    usage: hash, content, usage_count; calls: caller_hash, callee_hash, call_line."""
    f = numbered(insert_or_ignore(functions, ["hash"]), "hash")
    s = numbered(strings.where("content <> ''").select("content").distinct(), "content").withColumn("length", F.length("content"))
    fid = lambda h, i: f.select(F.col("hash").alias(h), F.col("id").alias(i))
    mapping = usage.join(fid("hash", "function_id"), "hash").join(s.select("content", F.col("id").alias("string_id")), "content")
    graph = calls.join(fid("caller_hash", "caller_id"), "caller_hash").join(fid("callee_hash", "callee_id"), "callee_hash")
    return {
        "functions": f,
        "strings": s.select("id", "content", "length"),
        "function_string_map": upsert_sum(mapping, ["function_id", "string_id"], "usage_count"),
        "source_call_graph": graph.select("caller_id", "callee_id", "call_line").distinct(),
    }


def with_missing_columns(rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """rows with the columns that an older schema lacks."""
    return rows.withColumns({c: v for c, v in defaults.items() if c not in rows.columns})


def violations(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows of child whose reference no row of parent has."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, row_count."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("table_name"), F.count("*").alias("row_count"))
        out = one if out is None else out.unionByName(one)
    return out

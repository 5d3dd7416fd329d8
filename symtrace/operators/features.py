"""Features of functions: their strings, string rarity, indirect strings and degrees.

String sets are exploded, distinct rows (func_id, s); graphs are distinct edges (caller_id, callee_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def function_strings(mapping: DataFrame, strings: DataFrame) -> DataFrame:
    """mapping (func_id, string_id) with strings (id, content): the distinct strings of each function."""
    return mapping.join(strings.select(F.col("id").alias("string_id"), F.col("content").alias("s")), "string_id").where("s <> ''").select("func_id", "s").distinct()


def caller_strings(mapping: DataFrame, strings: DataFrame, functions: DataFrame, calls: DataFrame) -> DataFrame:
    """Strings of call records, credited to the calling function. mapping: function_id, string_id."""
    records = functions.where("is_def = 0").select(F.col("id").alias("function_id"))
    callers = calls.select("caller_id", F.col("callee_id").alias("function_id")).distinct()
    texts = strings.select(F.col("id").alias("string_id"), F.col("content").alias("s"))
    return mapping.join(records, "function_id").join(callers, "function_id").join(texts, "string_id").select(F.col("caller_id").alias("func_id"), "s").distinct()


def direct_refs(refs: DataFrame) -> DataFrame:
    """The direct references; all of them if there is no direct one."""
    direct = refs.where("ref_type = 'direct'")
    return refs if direct.isEmpty() else direct


def indirect_strings(edges: DataFrame, strings: DataFrame) -> DataFrame:
    """The strings of the functions that a function calls."""
    return edges.select("caller_id", F.col("callee_id").alias("func_id")).join(strings, "func_id").select(F.col("caller_id").alias("func_id"), "s").distinct()


def document_frequency(strings: DataFrame) -> DataFrame:
    """s, df: in how many functions a string is."""
    return strings.groupBy("s").agg(F.count("*").alias("df"))


def idf(strings: DataFrame) -> DataFrame:
    """s, idf = ln((N + 1) / (df + 1)) over the functions that have a string. N is one row, so it is sent to all."""
    n = strings.agg(F.greatest(F.countDistinct("func_id"), F.lit(1)).alias("n"))
    return document_frequency(strings).crossJoin(F.broadcast(n)).select("s", F.log((F.col("n") + 1.0) / (F.col("df") + 1.0)).alias("idf"))


def weighted(strings: DataFrame, rarity: DataFrame) -> DataFrame:
    """func_id, s, w: the rarity of each string, 1 for those without."""
    return strings.join(rarity, "s", "left").select("func_id", "s", F.coalesce("idf", F.lit(1.0)).alias("w"))


def unique_strings(strings: DataFrame) -> DataFrame:
    """func_id, s of the strings that one function alone has."""
    return strings.groupBy("s").agg(F.min("func_id").alias("func_id"), F.max("func_id").alias("last")).where("func_id = last").select("func_id", "s")


def unique_indirect(edges: DataFrame, strings: DataFrame) -> DataFrame:
    """func_id, s of the indirect strings that one caller alone has, without listing indirect strings: the smallest and the
    largest caller of the functions that have a string are the same. s is a 128-bit hash of the string."""
    callers = edges.groupBy(F.col("callee_id").alias("func_id")).agg(F.min("caller_id").alias("least"), F.max("caller_id").alias("most"))
    called = strings.select("func_id", hashed(F.col("s")).alias("s")).join(callers, "func_id")
    return called.groupBy("s").agg(F.min("least").alias("func_id"), F.max("most").alias("last")).where("func_id = last").select("func_id", "s")


def hashed(s: Column) -> Column:
    """128 bits that stand for a string."""
    return F.substring(F.unhex(F.sha2(s, 256)), 1, 16)


def both_sides(bins: DataFrame, srcs: DataFrame) -> DataFrame:
    """func_id, s, b: the rows (func_id, s) of the binary (b) and the source side, with hashes for strings."""
    side = lambda df, b: df.select("func_id", hashed(F.col("s")).alias("s"), F.lit(b).alias("b"))
    return side(bins, True).unionByName(side(srcs, False))


def degrees(edges: DataFrame) -> DataFrame:
    """func_id, callers, callees over distinct edges."""
    e = edges.select("caller_id", "callee_id").distinct()
    ends = e.select(F.col("caller_id").alias("func_id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(e.select(F.col("callee_id").alias("func_id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("func_id").agg(F.sum("i").alias("callers"), F.sum("o").alias("callees"))


def most_called(functions: DataFrame, calls: DataFrame, k: int = 10) -> DataFrame:
    """name, call_count of the k functions with the most call records."""
    counts = calls.groupBy(F.col("callee_id").alias("id")).agg(F.count("*").alias("call_count"))
    return functions.join(counts, "id").select("id", "name", "call_count").orderBy(F.desc("call_count"), "id").limit(k)


def most_calling(functions: DataFrame, calls: DataFrame, k: int = 10) -> DataFrame:
    counts = calls.groupBy(F.col("caller_id").alias("id")).agg(F.count("*").alias("call_count"))
    return functions.join(counts, "id").select("id", "name", "call_count").orderBy(F.desc("call_count"), "id").limit(k)

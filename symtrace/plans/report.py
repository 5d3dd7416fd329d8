"""Reports over exported tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symtrace.functions import scalars


def _count(copies: str | None) -> Column:
    """How many results the rows stand for. copies: the column that says so, where a row stands for many."""
    return F.coalesce(F.sum(copies), F.lit(0)) if copies else F.count("*")


def _average(copies: str | None) -> Column:
    return F.sum(F.col("confidence") * F.col(copies)) / F.sum(copies) if copies else F.avg("confidence")


def overall(results: DataFrame, copies: str | None = None) -> DataFrame:
    """total, avg, min, max of the confidence; nulls on an empty table."""
    return results.agg(_count(copies).alias("total"), _average(copies).alias("avg_confidence"), F.min("confidence").alias("min_confidence"), F.max("confidence").alias("max_confidence"))


def buckets(results: DataFrame, copies: str | None = None) -> DataFrame:
    return results.groupBy(scalars.bucket(F.col("confidence")).alias("level")).agg(_count(copies).alias("count"))


def methods(results: DataFrame, copies: str | None = None) -> DataFrame:
    return results.groupBy("method").agg(_count(copies).alias("count"), _average(copies).alias("avg_confidence")).orderBy(F.desc("count"), "method")


def top(results: DataFrame, k: int = 20, at_least: float = 0.0) -> DataFrame:
    return results.where(F.col("confidence") >= at_least).orderBy(F.desc("confidence"), "bin_func_id", "src_func_id").limit(k)


def top_candidates(candidates: DataFrame, names: DataFrame, k: int = 10, bin_id: int | None = None) -> DataFrame:
    """Candidates with the source name (names: src_func_id, src_func_name): all of one binary function, or the k best."""
    rows = candidates.join(names, "src_func_id").orderBy(F.desc("score"), "bin_func_id", "src_func_id")
    return rows.limit(k) if bin_id is None else rows.where(F.col("bin_func_id") == bin_id)


def search(results: DataFrame, text: str) -> DataFrame:
    return results.where(scalars.name_contains(F.col("src_func_name"), text)).orderBy(F.desc("confidence"), "bin_func_id")


def summary(results: DataFrame, functions: DataFrame, copies: str | None = None) -> DataFrame:
    """matched, total, match_percent (null where there is no function)."""
    n = functions.agg(F.count("*").alias("total"))
    return results.agg(_count(copies).alias("matched")).crossJoin(F.broadcast(n)).select("matched", "total", F.expr("matched * 100.0D / nullif(total, 0)").alias("match_percent"))


def rename_lines(results: DataFrame, at_least: float = scalars.MEDIUM) -> DataFrame:
    """One line of a rename script for each match that is certain enough, the surest first: address, name, confidence."""
    address = F.concat(F.lit("0x"), F.regexp_replace("bin_address", "^0[xX]", ""))
    name = F.regexp_replace(F.regexp_replace("src_func_name", r"\\", r"\\\\"), '"', r'\\"')
    line = F.format_string('    (%s, "%s"),  # %.3f', address, name, "confidence")
    return results.where(F.col("confidence") >= at_least).orderBy(F.desc("confidence"), "bin_func_id").select(line.alias("line"))


#: What stands around the lines, for the disassembler's Python: a list of matches and a loop that sets their names.
HEAD = ("import idc", "", "MATCHES = [")
TAIL = ("]", "", "done = sum(bool(idc.set_name(address, name, idc.SN_CHECK)) for address, name in MATCHES)", 'print(f"{done} of {len(MATCHES)} functions renamed")')


def write_rename_script(results: DataFrame, path: str, at_least: float = scalars.MEDIUM) -> None:
    """A script of one text file; it has a line for each function of one program, so one task writes it."""
    spark = results.sparkSession
    fixed = spark.createDataFrame([(0, k, x) for k, x in enumerate(HEAD)] + [(2, k, x) for k, x in enumerate(TAIL)], "part int, at long, line string")
    lines = rename_lines(results, at_least).select(F.lit(1).alias("part"), F.monotonically_increasing_id().alias("at"), "line")
    fixed.unionByName(lines).coalesce(1).sortWithinPartitions("part", "at").select("line").write.mode("overwrite").text(path)

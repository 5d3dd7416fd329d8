"""From stored relations to the matcher's inputs: Parquet folders that `scan` and `import` write, or SQLite files."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symtrace.operators import features
from symtrace.operators.lineage import cut
from symtrace.plans.state import Inputs

from . import sqlite


def function_info(functions: DataFrame) -> DataFrame:
    """src_id, name, size, file_path of source functions, definitions and call records alike. The size is the number of
    lines between the first and the last, 0 where one isn't known."""
    size = F.coalesce(F.col("line_end") - F.col("line_start"), F.lit(0)).cast("long")
    return functions.select(F.col("id").alias("src_id"), "name", size.alias("size"), "file_path")


def non_library(functions: DataFrame) -> DataFrame:
    """bin_id, name, size, address of the binary functions that belong to no library. Strings and calls keep those that do."""
    return functions.where("is_library = 0").select(F.col("id").alias("bin_id"), "name", F.coalesce("size", F.lit(0)).cast("long").alias("size"), "address")


def source_strings(functions: DataFrame, strings: DataFrame, usage: DataFrame, calls: DataFrame, mode: str) -> DataFrame:
    """v3: the strings of each record itself; v2: those of call records, credited to the callers."""
    if mode == "v2":
        return features.caller_strings(usage.select("function_id", "string_id"), strings, functions, calls)
    return features.function_strings(usage.select(F.col("function_id").alias("func_id"), "string_id"), strings)


def binary_strings(refs: DataFrame, strings: DataFrame, mode: str) -> DataFrame:
    """v3: strings of direct references, or of all if these give none (older relations know no kinds); v2: of all."""
    if mode == "v3" and "ref_type" in refs.columns:
        direct = cut(features.function_strings(refs.where("ref_type = 'direct'").select("func_id", "string_id"), strings))
        if not direct.isEmpty():
            return direct
    return features.function_strings(refs.select("func_id", "string_id"), strings)


def edges(calls: DataFrame) -> DataFrame:
    return calls.select("caller_id", "callee_id").distinct()


@dataclass(frozen=True)
class RelationLoader:
    """A Loader of a source side and a binary side; each is a folder of Parquet tables or an SQLite file with the tables."""

    sources: str
    binaries: str
    mode: str = "v3"

    @staticmethod
    def _table(spark: SparkSession, where: str, name: str) -> DataFrame:
        return sqlite.read_table(spark, where, name) if os.path.isfile(where) else spark.read.parquet(f"{where}/{name}")

    def load(self, spark: SparkSession) -> Inputs:
        src = {n: self._table(spark, self.sources, n) for n in ("functions", "strings", "function_string_map", "source_call_graph")}
        bins = {n: self._table(spark, self.binaries, n) for n in ("binary_functions", "binary_strings", "binary_func_string_refs", "binary_call_graph")}
        return Inputs.of(
            non_library(bins["binary_functions"]),
            function_info(src["functions"]),
            cut(binary_strings(bins["binary_func_string_refs"], bins["binary_strings"], self.mode)),
            cut(source_strings(src["functions"], src["strings"], src["function_string_map"], src["source_call_graph"], self.mode)),
            cut(edges(bins["binary_call_graph"])),
            cut(edges(src["source_call_graph"])),
        )


@dataclass(frozen=True)
class PreparedLoader:
    """A Loader of the six tables of Inputs, stored as Parquet."""

    path: str

    def load(self, spark: SparkSession) -> Inputs:
        return Inputs.of(*[spark.read.parquet(f"{self.path}/{n}") for n in ("bin_info", "src_info", "bin_strings", "src_strings", "bin_edges", "src_edges")])

"""What phases read and write: immutable frames. A phase is a function from a state to a state."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symtrace import schemas
from symtrace.operators import features, similarity
from symtrace.operators.lineage import cut


@dataclass(frozen=True)
class Inputs:
    """functions: bin_info (bin_id, name, size, address), src_info (src_id, name, size, file_path); string sets
    (func_id, s), direct and one hop away; distinct edges (caller_id, callee_id); rarity (s, idf) of the binary side."""

    bin_info: DataFrame
    src_info: DataFrame
    bin_strings: DataFrame
    src_strings: DataFrame
    bin_edges: DataFrame
    src_edges: DataFrame
    bin_indirect: DataFrame
    src_indirect: DataFrame
    rarity: DataFrame

    @classmethod
    def of(cls, bin_info: DataFrame, src_info: DataFrame, bin_strings: DataFrame, src_strings: DataFrame, bin_edges: DataFrame, src_edges: DataFrame) -> Inputs:
        """What is derived is checkpointed when a phase first reads it, and so are the edges."""
        return _Derived(bin_info, src_info, bin_strings, src_strings, bin_edges, src_edges)

    @cached_property
    def hashes(self) -> DataFrame:
        """The direct strings of both sides as hashes."""
        return cut(features.both_sides(self.bin_strings, self.src_strings))

    @cached_property
    def shared(self) -> similarity.Shared:
        """What the functions of the two sides have in common of their direct strings. Rarity is that of the binary side."""
        return similarity.sets_of(self.hashes)

    def unique_indirect(self) -> tuple[DataFrame, DataFrame]:
        """(binary, source) rows func_id, s of the indirect strings that one function of the side alone has."""
        return features.unique_strings(self.bin_indirect), features.unique_strings(self.src_indirect)

    def indirect_sets(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(binary, source, rarity): indirect strings, or units of them, whose sets are compared by weight."""
        return self.bin_indirect, self.src_indirect, self.rarity


class _Derived(Inputs):
    def __init__(self, bin_info: DataFrame, src_info: DataFrame, bin_strings: DataFrame, src_strings: DataFrame, bin_edges: DataFrame, src_edges: DataFrame):
        self.__dict__.update(bin_info=bin_info, src_info=src_info, bin_strings=bin_strings, src_strings=src_strings, _edges=(bin_edges, src_edges))

    @cached_property
    def bin_edges(self) -> DataFrame:
        return cut(self._edges[0])

    @cached_property
    def src_edges(self) -> DataFrame:
        return cut(self._edges[1])

    @cached_property
    def bin_indirect(self) -> DataFrame:
        return cut(features.indirect_strings(self.bin_edges, self.bin_strings))

    @cached_property
    def src_indirect(self) -> DataFrame:
        return cut(features.indirect_strings(self.src_edges, self.src_strings))

    @cached_property
    def rarity(self) -> DataFrame:
        return cut(features.idf(self.bin_strings))

    def unique_indirect(self) -> tuple[DataFrame, DataFrame]:
        return features.unique_indirect(self.bin_edges, self.bin_strings), features.unique_indirect(self.src_edges, self.src_strings)

    def indirect_sets(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        bins, srcs, rarity = similarity.string_units(self.bin_strings, self.src_strings)
        return cut(features.indirect_strings(self.bin_edges, bins)), cut(features.indirect_strings(self.src_edges, srcs)), rarity


@dataclass(frozen=True)
class State:
    """confirmed: bin_id, src_id, confidence, method, seq; candidates: bin_id, src_id, score, method, seq; log: phase, bin_id,
    src_id, score, reason. seq is the order in which rows came about."""

    confirmed: DataFrame
    candidates: DataFrame
    log: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> State:
        return cls(spark.createDataFrame([], schemas.CONFIRMED), spark.createDataFrame([], schemas.CANDIDATES), spark.createDataFrame([], "phase STRING, bin_id LONG, src_id LONG, score DOUBLE, reason STRING"))

    def settled(self) -> State:
        """The same state without the plans that led to its matches and candidates. The log is read once, at the end, from
        rows that phases have cut, so it stays a union."""
        return replace(self, confirmed=cut(self.confirmed), candidates=cut(self.candidates))

    def confirm(self, rows: DataFrame, phase: int) -> State:
        """rows: bin_id, src_id, confidence, method."""
        new = rows.select("bin_id", "src_id", "confidence", "method", F.lit(phase).cast("long").alias("seq"))
        return replace(self, confirmed=self.confirmed.unionByName(new))

    def propose(self, rows: DataFrame, phase: int) -> State:
        """rows: bin_id, src_id, score, method, and order within the phase."""
        new = rows.select("bin_id", "src_id", "score", "method", (F.lit(phase).cast("long") * (1 << 40) + F.col("order").cast("long")).alias("seq"))
        return replace(self, candidates=self.candidates.unionByName(new))

    def noted(self, phase: str, rows: DataFrame) -> State:
        """rows: bin_id, src_id, score, reason."""
        return replace(self, log=self.log.unionByName(rows.select(F.lit(phase).alias("phase"), "bin_id", "src_id", F.col("score").cast("double").alias("score"), "reason")))

    def open_candidates(self) -> DataFrame:
        return self.candidates.join(self.confirmed.select("bin_id"), "bin_id", "left_anti")


class Loader(Protocol):
    """Where inputs come from: sources.relations has one for stored relations and one for prepared tables."""

    def load(self, spark: SparkSession) -> Inputs: ...


class Exporter(Protocol):
    """Where results go: engine.ParquetExporter writes the four result tables."""

    def export(self, inputs: Inputs, state: State, statistics: DataFrame, mode: str) -> None: ...


class Logger(Protocol):
    """Who is told about each phase when it has ended: name, confirmed matches, candidates, seconds."""

    def phase(self, name: str, confirmed: int, candidates: int, seconds: float) -> None: ...


Phase = Callable[[Inputs, State], State]

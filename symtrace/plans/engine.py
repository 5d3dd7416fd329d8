"""Running phases, phase statistics, export and resuming."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symtrace.functions import scalars
from symtrace.operators import assign, similarity
from symtrace.operators.lineage import cut

from . import v2, v3
from .state import Exporter, Inputs, Loader, Logger, Phase, State

MODES = {"v2": v2.PHASES, "v3": v3.PHASES}


def statistics(state: State, phase: str, seconds: float | None = None) -> DataFrame:
    """One row: cumulative counts, candidates of confirmed functions included."""
    c = state.confirmed.agg(F.count("*").alias("confirmed_count"), F.avg("confidence").alias("avg_confidence"))
    return c.crossJoin(F.broadcast(state.candidates.agg(F.count("*").alias("candidate_count")))).select(F.lit(phase).alias("phase"), "confirmed_count", "candidate_count", F.coalesce("avg_confidence", F.lit(0.0)).alias("avg_confidence"), F.lit(seconds).cast("double").alias("execution_time"))


@dataclass
class MatchEngine:
    """Runs the phases over the inputs, one statistics row after each. The mode says which rules the results follow."""

    phases: Sequence[tuple[str, Phase]]
    mode: str = "v3"
    logger: Logger | None = None
    stats: list[DataFrame] = field(default_factory=list)

    @classmethod
    def of(cls, mode: str, only: Sequence[str] = (), logger: Logger | None = None) -> MatchEngine:
        """The phases of a mode, or those named."""
        if unknown := set(only) - {name for name, _ in MODES[mode]}:
            raise ValueError(f"{mode} has no {', '.join(sorted(unknown))}")
        return cls([(name, phase) for name, phase in MODES[mode] if not only or name in only], mode, logger)

    def run(self, inputs: Inputs, state: State | None = None) -> State:
        state = state or State.empty(inputs.bin_info.sparkSession)
        for name, phase in self.phases:
            began = time.time()
            state = phase(inputs, state)
            seconds = time.time() - began
            self.stats.append(statistics(state, name, seconds))
            if self.logger:
                row = self.stats[-1].first()
                self.logger.phase(name, row["confirmed_count"], row["candidate_count"], seconds)
        return state

    def execute(self, spark: SparkSession, loader: Loader, exporter: Exporter, state: State | None = None) -> State:
        """Load, run all phases, export."""
        inputs = loader.load(spark)
        state = self.run(inputs, state)
        exporter.export(inputs, state, self.statistics(), self.mode)
        return state

    def statistics(self) -> DataFrame:
        out = self.stats[0]
        for x in self.stats[1:]:
            out = out.unionByName(x)
        return out.orderBy("phase")


@dataclass(frozen=True)
class ParquetExporter:
    """Overwrites the four result tables under a path."""

    path: str

    def export(self, inputs: Inputs, state: State, statistics: DataFrame, mode: str) -> None:
        for name, df in (("mapping_results", results(inputs, state, mode)), ("mapping_candidates", candidates(state, mode)), ("mapping_log", match_log(state)), ("statistics", statistics)):
            df.write.mode("overwrite").parquet(f"{self.path}/{name}")


class PrintLogger:
    """Tells the standard output about each phase."""

    def phase(self, name: str, confirmed: int, candidates: int, seconds: float) -> None:
        print(f"{name}: {confirmed} confirmed, {candidates} candidates, {seconds:.1f} s")


def results(inputs: Inputs, state: State, mode: str = "v3") -> DataFrame:
    """mapping_results: confirmed matches with records on both sides; v3 keeps one match of each source name, v2 all, with
    the call similarity against the final mapping."""
    b = inputs.bin_info.select("bin_id", F.col("address").alias("bin_address"))
    s = inputs.src_info.select("src_id", F.col("name").alias("src_name"), F.col("file_path").alias("src_file_path"))
    rows = state.confirmed.join(b, "bin_id").join(s, "src_id")
    if mode == "v3":
        rows = assign.one_per_name(similarity.shared_strings(rows, inputs.bin_strings, inputs.src_strings)).withColumn("call", F.lit(0.0))
    else:
        rows = cut(rows)
        shared = inputs.shared.of(rows).select("bin_id", "src_id", F.col("shared").cast("int").alias("n"))
        rows = rows.join(shared, ["bin_id", "src_id"], "left").withColumn("shared_strings", F.coalesce("n", F.lit(0))).drop("n")
        rows = rows.join(similarity.call_similarity(rows, inputs.bin_edges, inputs.src_edges, state.confirmed), ["bin_id", "src_id"], "left")
    return rows.select(
        F.col("bin_id").alias("bin_func_id"), "bin_address", F.col("src_id").alias("src_func_id"), F.col("src_name").alias("src_func_name"), "src_file_path", "confidence", "method",
        scalars.ref_type(F.col("method")).alias("ref_type"), "shared_strings", F.coalesce("call", F.lit(0.0)).alias("call_similarity"), F.current_timestamp().alias("timestamp"),
    )


def candidates(state: State, mode: str = "v3", k: int = 5) -> DataFrame:
    """mapping_candidates: k of each open binary function; v3 in order of arrival, v2 by score."""
    order = ["seq", "src_id"] if mode == "v3" else [F.desc(F.round("score", 12)), "seq", "src_id"]
    return assign.top_per_bin(state.open_candidates(), k, *order).select(F.col("bin_id").alias("bin_func_id"), F.col("src_id").alias("src_func_id"), "score", "method")


def match_log(state: State) -> DataFrame:
    return state.log.select("phase", F.col("bin_id").alias("bin_func_id"), F.col("src_id").alias("src_func_id"), "score", "reason", F.current_timestamp().alias("timestamp"))


def export(path: str, inputs: Inputs, state: State, engine: MatchEngine) -> None:
    """Overwrite the four result tables under path, by the rules of the engine's mode."""
    ParquetExporter(path).export(inputs, state, engine.statistics(), engine.mode)


def resume(spark: SparkSession, path: str) -> State:
    """The state that exported results stand for: confirmed matches only. Read into the state before anything is written,
    so the same path may be exported to again."""
    rows = spark.read.parquet(f"{path}/mapping_results")
    order = F.row_number().over(Window.partitionBy("bin_func_id").orderBy(F.desc("confidence"), "src_func_id"))
    kept = rows.withColumn("r", order).where("r = 1").select(F.col("bin_func_id").alias("bin_id"), F.col("src_func_id").alias("src_id"), "confidence", "method")
    return State.empty(spark).confirm(kept, 0).settled()


__all__ = ["MODES", "MatchEngine", "ParquetExporter", "PrintLogger", "candidates", "export", "match_log", "results", "resume", "statistics"]

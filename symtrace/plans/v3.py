"""The phases of the pluggable engine: unique strings in two rounds, then weighted similarity of indirect strings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symtrace.operators import assign, similarity

from .state import Inputs, State

DIRECT, INDIRECT = 0.95, 0.80
SIMILAR, FACTOR, CONFLICT = 0.6, 0.85, 0.9


def _round(state: State, pairs: DataFrame, confidence: float, method: str, phase: int) -> State:
    matches, conflicts = assign.assign(pairs, "evidence", state.confirmed)
    state = state.confirm(matches.select("bin_id", "src_id", F.lit(confidence).alias("confidence"), F.lit(method).alias("method")), phase)
    lost = conflicts.select("bin_id", "src_id", (confidence * (1 - 1 / (F.col("evidence") + 1))).alias("score"), F.lit(f"{method}_conflict").alias("method"), (-F.col("evidence")).alias("order"))
    return state.propose(lost, phase).settled()


def first_round(inputs: Inputs, state: State) -> State:
    return _round(state, assign.evidence_pairs(inputs.bin_strings, inputs.src_strings), DIRECT, "unique_string_direct", 10)


def unique_strings(inputs: Inputs, state: State) -> State:
    state = first_round(inputs, state)
    return _round(state, assign.evidence(*inputs.unique_indirect()), INDIRECT, "unique_string_indirect", 11)


def indirect_similarity(inputs: Inputs, state: State, variant: str = "all") -> State:
    """variant 'all': every pair that is similar enough competes; 'best': each binary function's best pair only."""
    bins, srcs, rarity = inputs.indirect_sets()
    bins = bins.join(state.confirmed.select(F.col("bin_id").alias("func_id")), "func_id", "left_anti")
    srcs = srcs.join(state.confirmed.select(F.col("src_id").alias("func_id")).distinct(), "func_id", "left_anti")
    pairs = similarity.similar_pairs(bins, srcs, SIMILAR, rarity).withColumn("weighted", F.round("weighted", 12))
    if variant == "best":
        pairs = assign.best_per_bin(pairs, "weighted")
    matches, conflicts = assign.assign(pairs, "weighted")
    method = "indirect_multi_string"
    state = state.confirm(matches.select("bin_id", "src_id", (F.col("weighted") * FACTOR).alias("confidence"), F.lit(method).alias("method")), 20)
    lost = conflicts.select("bin_id", "src_id", (F.col("weighted") * FACTOR * CONFLICT).alias("score"), F.lit(f"{method}_conflict").alias("method"), (-F.col("weighted") * 1e12).cast("long").alias("order"))
    return state.propose(lost, 20).settled()


PHASES = (("phase1", unique_strings), ("phase2", indirect_similarity))

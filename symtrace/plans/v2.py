"""The five phases of the monolithic mapper. Scores are compared after rounding to 12 digits; phases 4 and 5 use the
mapping as it is when the phase or round starts."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symtrace.functions.scalars import size_similarity
from symtrace.operators import assign, similarity
from symtrace.operators.lineage import cut

from .state import Inputs, State

ROUNDS = 5


def _confirmed(rows: DataFrame) -> DataFrame:
    return rows.select("bin_id", "src_id", F.col("score").alias("confidence"), "method")


def unique_string(inputs: Inputs, state: State) -> State:
    """Phase 1: the first string that is unique on both sides; source functions may be claimed more than once."""
    rows = cut(assign.first_of(inputs.bin_strings, inputs.hashes).join(state.confirmed.select("bin_id"), "bin_id", "left_anti"))
    note = rows.select("bin_id", "src_id", F.lit(0.95).alias("score"), F.format_string('unique_string: "%s"', F.substring("s", 1, 60)).alias("reason"))
    return state.confirm(rows.select("bin_id", "src_id", F.lit(0.95).alias("confidence"), F.lit("unique_string").alias("method")), 1).noted("phase1", note)


def string_set(inputs: Inputs, state: State) -> State:
    """Phase 2: combined Jaccard and weighted similarity; above 0.25 a candidate, above 0.75 with a gap confirmed."""
    scored = cut(inputs.shared.without(state.confirmed).above(0.25))
    rows = scored.select("bin_id", "src_id", "score", F.lit("string_set").alias("method"), F.col("src_id").alias("order"))
    note = scored.select("bin_id", "src_id", "score", F.format_string("jaccard=%.3f, weighted=%.3f, shared=%d", "jaccard", "weighted", "shared").alias("reason"))
    state = state.propose(rows, 2).noted("phase2", note)
    return state.confirm(cut(_confirmed(assign.best_with_gap(state.open_candidates(), 0.75, 0.15))), 2)


def call_graph(inputs: Inputs, state: State) -> State:
    """Phase 3: calls raise candidates' scores; open functions without candidates get the neighbours of what their own
    neighbours are mapped to. The best above 0.70 is confirmed, without a gap."""
    if state.confirmed.isEmpty():
        return state
    mapping = state.confirmed.select("bin_id", "src_id")
    calls = similarity.call_similarity(state.open_candidates(), inputs.bin_edges, inputs.src_edges, mapping)
    # A call similarity above 0 implies that both functions have an edge.
    boosted = cut(state.candidates.join(state.confirmed.select("bin_id", F.lit(True).alias("done")), "bin_id", "left").join(calls, ["bin_id", "src_id"], "left"))
    up = F.col("done").isNull() & (F.round("call", 12) > 0.1)
    after = boosted.select("bin_id", "src_id", F.when(up, F.col("score") * 0.6 + F.col("call") * 0.4).otherwise(F.col("score")).alias("score"), F.when(up, "string+callgraph").otherwise(F.col("method")).alias("method"), "seq")
    note = boosted.where(up).select("bin_id", "src_id", F.col("call").alias("score"), F.format_string("call_similarity=%.3f", "call").alias("reason"))
    lonely = inputs.bin_info.select("bin_id").join(state.confirmed.select("bin_id"), "bin_id", "left_anti").join(state.candidates.select("bin_id").distinct(), "bin_id", "left_anti")
    found = cut(similarity.inferred_pairs(lonely, inputs.bin_edges, inputs.src_edges, mapping, 0.3).join(inputs.src_info.select("src_id"), "src_id", "left_semi"))
    rows = found.select("bin_id", "src_id", (F.col("call") * 0.8).alias("score"), F.lit("callgraph").alias("method"), F.col("src_id").alias("order"))
    note2 = found.select("bin_id", "src_id", F.col("call").alias("score"), F.format_string("neighbor_infer, call_similarity=%.3f", "call").alias("reason"))
    state = replace(state, candidates=after).propose(rows, 3).noted("phase3", note).noted("phase3", note2)
    return state.confirm(cut(_confirmed(assign.best_with_gap(state.open_candidates(), 0.70, None))), 3)


def hybrid(inputs: Inputs, state: State) -> State:
    """Phase 4: open candidates are scored again by strings, calls and size; sources without a record leave."""
    mapping = state.confirmed.select("bin_id", "src_id")
    opened = state.open_candidates().join(inputs.src_info.select("src_id", F.col("size").alias("src_size")), "src_id").join(inputs.bin_info.select("bin_id", F.col("size").alias("bin_size")), "bin_id", "left")
    strings = inputs.shared.of(opened).select("bin_id", "src_id", similarity.string_score(F.col("jaccard"), F.col("weighted")).alias("string"))
    calls = similarity.call_similarity(opened, inputs.bin_edges, inputs.src_edges, mapping)
    joined = opened.join(strings, ["bin_id", "src_id"], "left").join(calls, ["bin_id", "src_id"], "left")
    string, call = F.coalesce("string", F.lit(0.0)), F.coalesce("call", F.lit(0.0))
    size = size_similarity(F.coalesce("bin_size", F.lit(0)), F.coalesce("src_size", F.lit(0)))
    scored = cut(joined.select("bin_id", "src_id", similarity.hybrid(string, call, size).alias("score"), F.lit("hybrid").alias("method"), "seq", string.alias("st"), call.alias("ca"), size.alias("si")))
    done = state.candidates.join(state.confirmed.select("bin_id"), "bin_id", "left_semi")
    note = scored.select("bin_id", "src_id", "score", F.format_string("string=%.3f, call=%.3f, size=%.3f", "st", "ca", "si").alias("reason"))
    state = replace(state, candidates=cut(done.unionByName(scored.drop("st", "ca", "si")))).noted("phase4", note)
    return state.confirm(cut(_confirmed(assign.best_with_gap(state.open_candidates(), 0.70, 0.10))), 4)


def propagated(inputs: Inputs, state: State) -> DataFrame:
    """The open candidates after one round of propagation."""
    opened = state.open_candidates().join(inputs.src_info.select("src_id"), "src_id", "left_semi")
    bonus = similarity.propagation_bonus(opened, inputs.bin_edges, inputs.src_edges, state.confirmed.select("bin_id", "src_id"))
    score = F.least(F.col("score") + F.coalesce("bonus", F.lit(0.0)), F.lit(0.98))
    return opened.join(bonus, ["bin_id", "src_id"], "left").select("bin_id", "src_id", score.alias("score"), F.concat("method", F.lit("+propagation")).alias("method"), "seq")


def propagation(inputs: Inputs, state: State, rounds: int = ROUNDS) -> State:
    """Phase 5: scores rise by the neighbours that agree, until a round confirms nothing. Each round sees the mapping of
    its start; what a round makes is checkpointed once, so plans don't grow."""
    for k in range(rounds):
        done = state.candidates.join(state.confirmed.select("bin_id"), "bin_id", "left_semi")
        state = replace(state, candidates=cut(done.unionByName(propagated(inputs, state))))
        new = cut(assign.best_with_gap(state.open_candidates(), 0.68, 0.12))
        if new.isEmpty():
            break
        note = new.select("bin_id", "src_id", "score", F.lit(f"iteration={k + 1}, propagation_bonus").alias("reason"))
        state = state.confirm(_confirmed(new), 5 + k).noted("phase5", note)
    return state


PHASES = (("phase1", unique_string), ("phase2", string_set), ("phase3", call_graph), ("phase4", hybrid), ("phase5", propagation))

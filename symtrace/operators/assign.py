"""Choosing matches from scored pairs. Every order is total: weight descending, then bin_id, then src_id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import features
from .lineage import cut

#: So many pairs are finished on the driver, where the sequential algorithm is a single pass.
ON_DRIVER = 100_000
#: So many doubly unique strings are sent to all executors; more are shuffled.
SENT = 1_000_000


def evidence_pairs(bins: DataFrame, srcs: DataFrame) -> DataFrame:
    """bin_id, src_id, evidence: number of strings that are unique on both sides."""
    return evidence(*[features.unique_strings(df.select("func_id", features.hashed(F.col("s")).alias("s"))) for df in (bins, srcs)])


def evidence(bins: DataFrame, srcs: DataFrame) -> DataFrame:
    """evidence_pairs of the strings (func_id, s) that are unique on their side."""
    b, s = bins.select(F.col("func_id").alias("bin_id"), "s"), srcs.select(F.col("func_id").alias("src_id"), "s")
    return b.join(s, "s").groupBy("bin_id", "src_id").agg(F.count("*").alias("evidence"))


def first_wins(bins: DataFrame, srcs: DataFrame) -> DataFrame:
    """bin_id, src_id, s: per binary function its smallest doubly unique string; source functions may be reused."""
    return first_of(bins, cut(features.both_sides(bins, srcs)))


def first_of(bins: DataFrame, rows: DataFrame) -> DataFrame:
    """first_wins, with both_sides as a checkpoint (rows). Hashes tell which strings are unique; the texts of those alone are
    looked up, by a list that all executors get if it is short."""
    b, s = (features.unique_strings(rows.where(side)).select(F.col("func_id").alias(i), F.col("s").alias("h")) for side, i in ((F.col("b"), "bin_id"), (~F.col("b"), "src_id")))
    found = cut(b.join(s, "h"))
    found = F.broadcast(found) if found.count() <= SENT else found
    texts = bins.select(F.col("func_id").alias("bin_id"), "s", features.hashed(F.col("s")).alias("h")).join(found, ["bin_id", "h"])
    return texts.groupBy("bin_id").agg(F.min(F.struct("s", "src_id")).alias("m")).select("bin_id", "m.src_id", "m.s")


def sequential(rows: list, taken_bins: set, taken_srcs: set) -> list[tuple[int, int]]:
    """Greedy by definition: rows (bin_id, src_id, weight) from the heaviest; those with both ends free are confirmed."""
    out = []
    for b, s, _ in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if b not in taken_bins and s not in taken_srcs:
            taken_bins.add(b)
            taken_srcs.add(s)
            out.append((b, s))
    return out


def greedy(pairs: DataFrame, weight: str, on_driver: int = ON_DRIVER) -> DataFrame:
    """bin_id, src_id of the greedy one-to-one assignment. Pairs that are the best of both their ends are what the
    sequential scan confirms too; they are taken, their ends leave, and the rest goes round again. Where such a round
    settles less than a tenth (chains of ever heavier pairs), the heaviest `on_driver` pairs are settled by the sequential
    scan itself, so the number of rounds is at most of the order of log(pairs) + pairs / on_driver. So many pairs or
    fewer are finished on the driver; the limit is checked before anything is collected."""
    spark = pairs.sparkSession
    rest = pairs.select("bin_id", "src_id", F.col(weight).cast("double").alias("w"))

    def scanned(rows: list) -> DataFrame:
        return spark.createDataFrame(sequential([(r["bin_id"], r["src_id"], r["w"]) for r in rows], set(), set()), "bin_id long, src_id long")

    rows = rest.limit(on_driver + 1).collect()
    if len(rows) <= on_driver:
        return scanned(rows)
    taken, slow, rest = [], False, cut(rest)
    n = rest.count()
    while n > on_driver:
        if slow:
            chosen = scanned(rest.orderBy(F.desc("w"), "bin_id", "src_id").limit(on_driver).collect())
        else:
            best = lambda end: rest.groupBy(end).agg(F.min(F.struct((-F.col("w")).alias("v"), F.col("bin_id").alias("b"), F.col("src_id").alias("s"))).alias("m")).select("m.b", "m.s")  # noqa: E731, B023
            chosen = cut(best("bin_id").join(best("src_id"), ["b", "s"]).select(F.col("b").alias("bin_id"), F.col("s").alias("src_id")))
        taken.append(chosen)
        rest = cut(rest.join(chosen.select("bin_id"), "bin_id", "left_anti").join(chosen.select("src_id"), "src_id", "left_anti"))
        before, n = n, rest.count()
        slow = not slow and n > 0.9 * before
    return reduce(DataFrame.unionByName, [*taken, scanned(rest.collect())])


def assign(pairs: DataFrame, weight: str, confirmed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(matches, conflicts): pairs (bin_id, src_id, weight, ...) split by the greedy assignment. Ends that `confirmed`
    has are taken from the start, so pairs that touch them are conflicts."""
    pairs = cut(pairs)  # used three times
    free = pairs
    if confirmed is not None:
        free = pairs.join(confirmed.select("bin_id"), "bin_id", "left_anti").join(confirmed.select("src_id").distinct(), "src_id", "left_anti")
    chosen = greedy(free, weight)
    return pairs.join(chosen, ["bin_id", "src_id"]), pairs.join(chosen, ["bin_id", "src_id"], "left_anti")


def best_per_bin(pairs: DataFrame, score: str, *ties: str) -> DataFrame:
    """The best pair of each binary function."""
    w = Window.partitionBy("bin_id").orderBy(F.desc(F.round(score, 12)), *(ties or ("src_id",)))
    return pairs.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def best_with_gap(candidates: DataFrame, at_least: float, gap: float | None, score: str = "score") -> DataFrame:
    """The best candidate of each binary function if its score is above at_least and, unless it is alone, more than gap
    above the next."""
    w = Window.partitionBy("bin_id").orderBy(F.desc(F.round(score, 12)), "seq", "src_id")
    ranked = candidates.withColumn("r", F.row_number().over(w)).withColumn("next", F.lead(score).over(w))
    best = ranked.where((F.col("r") == 1) & (F.round(score, 12) > at_least))
    if gap is not None:
        best = best.where(F.col("next").isNull() | (F.round(F.col(score) - F.col("next"), 12) > gap))
    return best.drop("r", "next")


def top_per_bin(candidates: DataFrame, k: int, *order) -> DataFrame:
    w = Window.partitionBy("bin_id").orderBy(*order)
    return candidates.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def one_per_name(matches: DataFrame) -> DataFrame:
    """Per source name the match with the most shared strings, the earliest confirmed of equals."""
    w = Window.partitionBy("src_name").orderBy(F.desc("shared_strings"), "seq", "bin_id")
    return matches.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")

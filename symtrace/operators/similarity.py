"""Similarity of functions by strings, calls and size, as joins and aggregates over exploded sets."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import features
from .lineage import cut


def overlaps(bins: DataFrame, srcs: DataFrame) -> DataFrame:
    """bin_id, src_id, n_i, w_i: number and weight of the strings both have. Inputs: func_id, s, w. The join is on the
    string, pairs without a common one never arise; pair counts are summed before they are shuffled. All pairs of a string
    that many functions have arise, as the result has them all: for a threshold, similar_pairs never makes them."""
    b = bins.select(F.col("func_id").alias("bin_id"), "s", "w")
    s = srcs.select(F.col("func_id").alias("src_id"), "s")
    return b.join(s, "s").groupBy("bin_id", "src_id").agg(F.count("*").alias("n_i"), F.sum("w").alias("w_i"))


def totals(strings: DataFrame) -> DataFrame:
    return strings.groupBy("func_id").agg(F.count("*").alias("n"), F.sum("w").alias("w"))


def similarity(bins: DataFrame, srcs: DataFrame, rarity: DataFrame | None = None, bin_info: DataFrame | None = None, src_info: DataFrame | None = None) -> DataFrame:
    """bin_id, src_id, shared, jaccard, weighted of all pairs with a common string. Inputs: func_id, s. rarity: s, idf of
    the binary side by default. The output is all such pairs; what they share is counted once for all functions with the
    same shared strings. bin_info, src_info: func_id and columns that the pairs are to have too (an inner join)."""
    return shared_sets(bins, srcs, rarity).pairs(bin_info, src_info)


#: So many functions or classes of a side are sent to all executors; more are shuffled.
SENT = 1_000_000
#: Functions of one set of strings that a row holds at most, so that a large set is many rows.
CHUNK = 256


@dataclass(frozen=True)
class Shared:
    """members: b (binary side), func_id, set, class, n, w of the functions that share a string with the other side. Those of
    a set have the same shared strings, those of a class the same number and weight of all strings too; both are named by
    their smallest function. posts: b, set, s, w of the strings that a set shares with the other side. overlaps: bin_set,
    src_set, n_i, w_i of the sets with a common string."""

    members: DataFrame
    posts: DataFrame
    overlaps: DataFrame

    def without(self, bins: DataFrame) -> Shared:
        """The same without the binary functions of bins (bin_id)."""
        gone = bins.select(F.col("bin_id").alias("func_id"), F.lit(True).alias("b"))
        return replace(self, members=cut(self.members.join(gone, ["func_id", "b"], "left_anti")))

    def near(self, above: float) -> Shared:
        """The same with no overlaps but of sets that may have functions with a combined score above `above` (0 or more); weights
        are 0 or more. A string adds its share of a function to the score at most. Of two functions that are above, the strings
        from the first common one on, from rare to common, make up more than `above` of each, so these ends meet in it."""
        least = self.members.groupBy("b", "set").agg(F.min("n").alias("n"), F.min("w").alias("all"))
        share = combined(1 / F.col("n"), F.when(F.col("all") > 0, F.col("w") / F.col("all")).otherwise(0.0))
        after = Window.partitionBy("b", "set").orderBy("w", F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
        ends = cut(self.posts.join(least, ["b", "set"]).withColumn("rest", F.sum(share).over(after)).where(F.col("rest") > above - 1e-9).select("b", "set", "s"))
        b, s = (ends.where(F.col("b") == side).select(F.col("set").alias(c), "s") for side, c in ((True, "bin_set"), (False, "src_set")))
        return replace(self, overlaps=_set_overlaps(self.posts, b.join(s, "s").select("bin_set", "src_set").distinct()))

    def above(self, above: float) -> DataFrame:
        """bin_id, src_id, shared, jaccard, weighted, score of the pairs whose combined score is above `above`. Classes of functions
        are compared; only the pairs of classes that are above become pairs of functions."""
        scored = self.near(above).classes().drop("copies").withColumn("score", combined(F.col("jaccard"), F.col("weighted"))).where(F.round("score", 12) > above)
        return self.expanded(scored).select("bin_id", "src_id", "shared", "jaccard", "weighted", "score")

    def of(self, pairs: DataFrame) -> DataFrame:
        """bin_id, src_id, shared, jaccard, weighted of the given pairs that share a string."""
        b, s = (self.members.where(F.col("b") == side).select(F.col("func_id").alias(i), F.col("set").alias(c), F.col("n").alias(n), F.col("w").alias(w)) for side, i, c, n, w in ((True, "bin_id", "bin_set", "n_a", "w_a"), (False, "src_id", "src_set", "n_b", "w_b")))
        each = cut(pairs.select("bin_id", "src_id").distinct().join(b, "bin_id").join(s, "src_id"))
        return _scored(each.join(_set_overlaps(self.posts, each.select("bin_set", "src_set").distinct()), ["bin_set", "src_set"]))

    def pairs(self, bin_info: DataFrame | None = None, src_info: DataFrame | None = None) -> DataFrame:
        """The similarities of all pairs of functions, and the columns of bin_info and src_info."""
        ends = [self.members.where(F.col("b") == side) if info is None else self.members.where(F.col("b") == side).join(info, "func_id") for side, info in ((True, bin_info), (False, src_info))]
        more = [[c for c in info.columns if c != "func_id"] if info is not None else [] for info in (bin_info, src_info)]
        return _scored(self._met(*[e.select("set", "n", "w", F.col("func_id").alias(i), *m) for e, i, m in zip(ends, ("bin_id", "src_id"), more, strict=True)]), "bin_id", "src_id", *more[0], *more[1])

    def valued(self, **values: Column) -> DataFrame:
        """bin_id, src_id of all pairs with a common string, and values: columns made of shared, jaccard and weighted. They are made
        once for the functions of two classes (CHUNK of a class at most), whose pairs are then listed."""
        at = F.row_number().over(Window.partitionBy("b", "set").orderBy("n", "w", "func_id"))
        piece = self.members.withColumn("piece", F.floor((at - 1) / CHUNK)).groupBy("b", "set", "piece", "n", "w").agg(F.collect_list("func_id").alias("ids"))
        pieces = cut(piece.groupBy("b", "set", "piece").agg(F.collect_list(F.struct("n", "w", "ids")).alias("rows"), F.sum(F.size("ids")).alias("held")))

        def end(side: bool, name: str, chunk: str, n: str, w: str, ids: str) -> DataFrame:
            rows = F.transform("rows", lambda x: F.struct(x["n"].alias(n), x["w"].alias(w), x["ids"].alias(ids)))
            return pieces.where(F.col("b") == side).select(F.col("set").alias(name), F.col("piece").alias(chunk), rows.alias(f"{chunk}_rows"), F.col("held").alias(f"{chunk}_held"))

        each = self._dealt(end(True, "bin_set", "bin_chunk", "n_a", "w_a", "bins"), end(False, "src_set", "src_chunk", "n_b", "w_b", "srcs"))
        each = _scored(each, "bins", "srcs").select("bins", "srcs", *[v.alias(k) for k, v in values.items()])
        return each.select(F.explode("bins").alias("bin_id"), "srcs", *values).select("bin_id", F.explode("srcs").alias("src_id"), *values)

    def classes(self) -> DataFrame:
        """bin_class, src_class, copies (how many pairs of functions), shared, jaccard, weighted of the pairs of classes."""
        kinds = self.members.groupBy("b", "class").agg(F.first("set").alias("set"), F.first("n").alias("n"), F.first("w").alias("w"), F.count("*").alias("c"))
        ends = [kinds.where(F.col("b") == side).select("set", "n", "w", F.col("class").alias(i), F.col("c").alias(c)) for side, i, c in ((True, "bin_class", "c_a"), (False, "src_class", "c_b"))]
        return _scored(self._met(*ends), "bin_class", "src_class", (F.col("c_a") * F.col("c_b")).alias("copies"))

    def expanded(self, classes: DataFrame, k: int | None = None) -> DataFrame:
        """Rows of classes (bin_class, src_class, ...) for their functions, bin_id and src_id; k: for the k smallest source
        functions of a class only."""
        b, s = (self.members.where(F.col("b") == side).select(F.col("class").alias(c), F.col("func_id").alias(i)) for side, c, i in ((True, "bin_class", "bin_id"), (False, "src_class", "src_id")))
        return classes.join(_least(s, "src_class", "src_id", k) if k else s, "src_class").join(b, "bin_class").drop("bin_class", "src_class")

    def best(self, classes: DataFrame, k: int, score: str) -> DataFrame:
        """Of all pairs of functions some that have the k first by score (descending), bin_id, src_id among them: the k first
        pairs of classes hold them, as a class is named by its smallest function."""
        first = classes.orderBy(F.desc(score), "bin_class", "src_class").limit(k)
        b, s = (_least(self.members.where(F.col("b") == side).select(F.col("class").alias(c), F.col("func_id").alias(i)).join(F.broadcast(first.select(c).distinct()), c), c, i, k) for side, c, i in ((True, "bin_class", "bin_id"), (False, "src_class", "src_id")))
        return first.join(b, "bin_class").join(s, "src_class").drop("bin_class", "src_class")

    def _met(self, bins: DataFrame, srcs: DataFrame) -> DataFrame:
        """Rows of bins and srcs (set, n, w, ...) whose sets meet, with n_a, w_a, n_b, w_b, n_i, w_i. A set goes in chunks."""
        return self._dealt(_packed(bins, "bin_set", "bin_chunk", "n_a", "w_a"), _packed(srcs, "src_set", "src_chunk", "n_b", "w_b"))

    def _dealt(self, b: DataFrame, s: DataFrame) -> DataFrame:
        """n_i, w_i with the rows of two chunks, for all chunks whose sets meet: dealt out by chunk, so that two large sets are the
        work of many tasks."""
        dealt = self.overlaps.join(_sent(b.select("bin_set", "bin_chunk")), "bin_set").repartition("bin_set", "bin_chunk", "src_set")
        each = dealt.join(_sent(b), ["bin_set", "bin_chunk"]).join(_sent(s), "src_set")
        each = each.select("n_i", "w_i", F.col("src_chunk_rows"), F.inline("bin_chunk_rows"))
        return each.select(*[c for c in each.columns if c != "src_chunk_rows"], F.inline("src_chunk_rows"))


def _least(rows: DataFrame, key: str, what: str, k: int) -> DataFrame:
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(what))).where(F.col("__r") <= k).drop("__r")


def _packed(rows: DataFrame, name: str, chunk: str, n: str, w: str) -> DataFrame:
    """name, chunk, <chunk>_rows: rows (set, n, w, ...) in arrays of CHUNK at most."""
    more = [c for c in rows.columns if c not in ("set", "n", "w")]
    at = F.row_number().over(Window.partitionBy("set").orderBy(*more))
    dealt = rows.withColumn("__at", F.floor((at - 1) / CHUNK))
    return cut(dealt.groupBy(F.col("set").alias(name), F.col("__at").alias(chunk)).agg(F.collect_list(F.struct(F.col("n").alias(n), F.col("w").alias(w), *more)).alias(f"{chunk}_rows")))


def _sent(packed: DataFrame) -> DataFrame:
    """packed, to be sent to all if it has few rows and they hold SENT functions at most."""
    rows, held = (next((c for c in packed.columns if c.endswith(end)), None) for end in ("_rows", "_held"))
    n = packed.agg(F.sum(held) if held else F.sum(F.size(rows)) if rows else F.count("*")).first()[0] or 0
    packed = packed.drop(held) if held else packed
    return F.broadcast(packed) if n <= SENT else packed


def shared_sets(bins: DataFrame, srcs: DataFrame, rarity: DataFrame | None = None) -> Shared:
    """Inputs and rarity as for similarity. Most functions of a large program share few strings with the other side, and
    many share the same: overlaps are counted between the different sets of shared strings alone."""
    return sets_of(cut(features.both_sides(bins, srcs)), rarity)


def sets_of(rows: DataFrame, rarity: DataFrame | None = None) -> Shared:
    """shared_sets of both_sides, a checkpoint."""
    each = rows.groupBy("s").agg(F.count_if("b").alias("df"), F.count_if(~F.col("b")).alias("others"))
    if rarity is None:
        n = rows.where("b").agg(F.greatest(F.countDistinct("func_id"), F.lit(1)).alias("n"))
        each = each.crossJoin(F.broadcast(n)).withColumn("idf", F.when(F.col("df") > 0, F.log((F.col("n") + 1.0) / (F.col("df") + 1.0))))
    else:
        each = each.join(rarity.select(features.hashed(F.col("s")).alias("s"), "idf"), "s", "left")
    each = each.select("s", F.coalesce("idf", F.lit(1.0)).alias("w"), ((F.col("df") > 0) & (F.col("others") > 0)).alias("met"))
    own = rows.join(each, "s").groupBy("b", "func_id").agg(F.sort_array(F.collect_list("w")).alias("ws"), F.sort_array(F.collect_list(F.when(F.col("met"), F.struct("s", "w")))).alias("met"))
    # Weights are added in one order, so equal sets weigh the same to the last digit.
    total = F.aggregate("ws", F.lit(0.0), lambda a, x: a + x)
    own = cut(own.where(F.size("met") > 0).select("b", "func_id", F.size("ws").cast("long").alias("n"), total.alias("w"), "met", features.hashed(F.array_join(F.transform("met", lambda x: F.hex(x["s"])), "")).alias("key")))
    sets = cut(own.groupBy("b", "key").agg(F.min("func_id").alias("set"), F.first("met").alias("met")))
    members = own.select("b", "key", "func_id", "n", "w").join(sets.select("b", "key", "set"), ["b", "key"])
    members = cut(members.select("b", "func_id", "set", "n", "w", F.min("func_id").over(Window.partitionBy("b", "set", "n", "w")).alias("class")))
    posts = sets.select("b", "set", F.inline("met"))
    return Shared(members, posts, _set_overlaps(posts))


def _set_overlaps(posts: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """bin_set, src_set, n_i, w_i of the sets with a common string; of the given pairs (bin_set, src_set) only."""
    b, s = posts.where("b").select(F.col("set").alias("bin_set"), "s", "w"), posts.where(~F.col("b")).select(F.col("set").alias("src_set"), "s")
    met = b.join(s, "s") if pairs is None else pairs.join(b, "bin_set").join(s, ["src_set", "s"])
    return met.groupBy("bin_set", "src_set").agg(F.count("*").alias("n_i"), F.sum("w").alias("w_i"))


def _scored(pairs: DataFrame, *kept: Column | str) -> DataFrame:
    """Both similarities from n_i, w_i (what a pair shares) and n_a, w_a, n_b, w_b (what each has). kept: what else stays, the
    two ids by default."""
    union = F.col("w_a") + F.col("w_b") - F.col("w_i")
    return pairs.select(
        *(kept or ("bin_id", "src_id")), F.col("n_i").alias("shared"),
        (F.col("n_i") / (F.col("n_a") + F.col("n_b") - F.col("n_i"))).alias("jaccard"),
        F.when(F.round(union, 12) > 0, F.col("w_i") / union).otherwise(0.0).alias("weighted"),
    )


def _prefix(strings: DataFrame, measure: Column, threshold: float) -> DataFrame:
    """func_id, s: each function's strings from rare to common, up to where what is left is less than threshold times
    the whole. Of two sets with a similarity of threshold or more, these ends have a string in common."""
    after = Window.partitionBy("func_id").orderBy("w", F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)  # read once
    rows = strings.withColumn("rest", F.sum(measure).over(after)).withColumn("all", F.sum(measure).over(Window.partitionBy("func_id")))
    return rows.where(F.col("rest") >= (threshold - 1e-9) * F.col("all")).select("func_id", "s")


def _meeting(bins: DataFrame, srcs: DataFrame) -> DataFrame:
    return bins.select(F.col("func_id").alias("bin_id"), "s").join(srcs.select(F.col("func_id").alias("src_id"), "s"), "s").select("bin_id", "src_id")


def pair_similarity(pairs: DataFrame, b: DataFrame, s: DataFrame) -> DataFrame:
    """bin_id, src_id, shared, jaccard, weighted of the given pairs that share a string. b, s: func_id, s, w."""
    tb = totals(b).select(F.col("func_id").alias("bin_id"), F.col("n").alias("n_a"), F.col("w").alias("w_a"))
    ts = totals(s).select(F.col("func_id").alias("src_id"), F.col("n").alias("n_b"), F.col("w").alias("w_b"))
    each = pairs.select("bin_id", "src_id").distinct().join(b.select(F.col("func_id").alias("bin_id"), "s", "w"), "bin_id")
    common = each.join(s.select(F.col("func_id").alias("src_id"), "s"), ["src_id", "s"]).groupBy("bin_id", "src_id").agg(F.count("*").alias("n_i"), F.sum("w").alias("w_i"))
    return _scored(common.join(tb, "bin_id").join(ts, "src_id"))


def similar_pairs(bins: DataFrame, srcs: DataFrame, threshold: float, rarity: DataFrame | None = None) -> DataFrame:
    """bin_id, src_id, shared, weighted of the pairs with weighted >= threshold. Candidates come from a prefix filter, so
    very common strings, which would join all with all, are looked up for candidates only, never joined."""
    rarity = features.idf(bins) if rarity is None else rarity
    b, s = features.weighted(bins, rarity).where("w > 0"), features.weighted(srcs, rarity).where("w > 0")
    found = _meeting(_prefix(b, F.col("w"), threshold), _prefix(s, F.col("w"), threshold)).distinct()
    size = lambda x, c, w: totals(x).select(F.col("func_id").alias(c), F.col("w").alias(w))
    ratio = F.least("x", "y") >= (threshold - 1e-9) * F.greatest("x", "y")
    able = found.join(size(b, "bin_id", "x"), "bin_id").join(size(s, "src_id", "y"), "src_id").where(ratio)
    return pair_similarity(able, b, s).where(F.round("weighted", 12) >= threshold).select("bin_id", "src_id", "shared", "weighted")


def string_units(bins: DataFrame, srcs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(binary, source, rarity) as for similar_pairs, with numbers of units for strings: strings that the same functions of both
    sides have are one unit of their whole weight. Whoever calls one of these functions has all strings of the unit, so sets
    of indirect units weigh what sets of indirect strings do. That two lists of functions are the same is told by 128 bits."""
    rows = cut(features.both_sides(bins, srcs))
    total = rows.where("b").agg(F.greatest(F.countDistinct("func_id"), F.lit(1)).alias("total"))
    each = rows.groupBy("s").agg(F.count_if("b").alias("df"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("func_id", "b")).alias("x"), F.bit_xor(F.xxhash64("b", "func_id")).alias("y"), F.min("func_id").alias("func_id"))
    each = cut(each)
    idf = F.when(F.col("df") > 0, F.log((F.col("total") + 1.0) / (F.col("df") + 1.0))).otherwise(1.0)
    units = each.crossJoin(F.broadcast(total)).groupBy("df", "n", "x", "y").agg(F.sum(idf).alias("idf"), F.min("func_id").alias("func_id"))
    units = cut(cut(units).withColumn("unit", F.monotonically_increasing_id()))
    one = units.where("n = 1").select("func_id", F.col("unit").alias("s"), (F.col("df") > 0).alias("b"))  # most strings: these need no join
    named = each.where("n > 1").select("s", "df", "n", "x", "y").join(units.where("n > 1").select("df", "n", "x", "y", "unit"), ["df", "n", "x", "y"]).select("s", "unit")
    more = rows.join(named, "s").select("func_id", F.col("unit").alias("s"), "b").distinct()
    of = cut(one.unionByName(more))
    return of.where("b").select("func_id", "s"), of.where(~F.col("b")).select("func_id", "s"), units.select(F.col("unit").alias("s"), "idf")


def combined_candidates(bins: DataFrame, srcs: DataFrame, above: float, rarity: DataFrame | None = None) -> DataFrame:
    """bin_id, src_id, shared, jaccard, weighted, score of the pairs whose combined score is above `above`."""
    return shared_sets(bins, srcs, rarity).above(above)


def combined_best(bins: DataFrame, srcs: DataFrame, above: float, at_least: float, gap: float) -> DataFrame:
    """bin_id, src_id, score: of the combined candidates of each binary function the best, if its score is above at_least and,
    unless it is alone, more than gap above the next. Decided between classes: a class with two source functions is its
    own next, and candidates too low to be in the way of any best one leave before they are ordered."""
    shared = shared_sets(bins, srcs)
    scored = shared.classes().withColumn("score", combined(F.col("jaccard"), F.col("weighted"))).where(F.round("score", 12) > max(above, at_least - gap - 1e-9))
    alone = shared.members.where(~F.col("b")).groupBy(F.col("class").alias("src_class")).agg((F.count("*") == 1).alias("alone"))
    order = Window.partitionBy("bin_class").orderBy(F.desc(F.round("score", 12)), "src_class")
    ranked = scored.select("bin_class", "src_class", "score").withColumn("r", F.row_number().over(order)).withColumn("next", F.lead("score").over(order))
    best = ranked.where((F.col("r") == 1) & (F.round("score", 12) > at_least) & (F.col("next").isNull() | (F.round(F.col("score") - F.col("next"), 12) > gap)))
    best = best.join(alone.where("alone"), "src_class", "left_semi")
    return shared.expanded(best.select("bin_class", "src_class", "score")).select("bin_id", "src_id", "score")


def combined(jaccard: Column, weighted: Column) -> Column:
    return 0.35 * jaccard + 0.65 * weighted


def string_score(jaccard: Column, weighted: Column) -> Column:
    return 0.4 * jaccard + 0.6 * weighted


def hybrid(string: Column, call: Column, size: Column) -> Column:
    return 0.50 * string + 0.35 * call + 0.15 * size


def shared_strings(pairs: DataFrame, bins: DataFrame, srcs: DataFrame) -> DataFrame:
    """pairs (bin_id, src_id, ...) with shared_strings, the number of common strings."""
    b = bins.select(F.col("func_id").alias("bin_id"), "s")
    s = srcs.select(F.col("func_id").alias("src_id"), "s")
    counts = pairs.select("bin_id", "src_id").distinct().join(b, "bin_id").join(s, ["src_id", "s"]).groupBy("bin_id", "src_id").agg(F.count("*").alias("n"))
    return pairs.join(counts, ["bin_id", "src_id"], "left").withColumn("shared_strings", F.coalesce("n", F.lit(0)).cast("int")).drop("n")


def _side(pairs: DataFrame, bin_edges: DataFrame, src_edges: DataFrame, mapping: DataFrame, own: str, other: str, two_hops: bool) -> DataFrame:
    """bin_id, src_id, n_m, n_s, n_i over the `other` ends of edges whose `own` end is the function: mapped neighbours of
    the binary function, neighbours of the source function, and those in both."""
    m = mapping.select(F.col("bin_id").alias("nb"), F.col("src_id").alias("ns"))
    mapped = cut(_of(bin_edges, own, other, pairs, "bin_id", "nb").join(m, "nb").select("bin_id", "ns").distinct())
    near = cut(_of(src_edges, own, other, pairs, "src_id", "ns"))
    wanted = pairs.select("bin_id", "src_id")
    if two_hops:  # the pairs are about what the join on the common neighbour makes anyway
        met = mapped.join(near, "ns")
    else:  # few pairs: their neighbours only
        met = wanted.join(mapped, "bin_id").join(near, ["src_id", "ns"])
    both = met.groupBy("bin_id", "src_id").agg(F.count("*").alias("n_i"))
    n_m, n_s = mapped.groupBy("bin_id").agg(F.count("*").alias("n_m")), near.groupBy("src_id").agg(F.count("*").alias("n_s"))
    out = wanted.join(n_m, "bin_id", "left").join(n_s, "src_id", "left").join(both, ["bin_id", "src_id"], "left")
    return out.select("bin_id", "src_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_m", "n_s", "n_i")])


def _of(edges: DataFrame, own: str, other: str, pairs: DataFrame, end: str, name: str) -> DataFrame:
    """end, name: the distinct edges whose `own` end is an `end` of the pairs. Ids that all executors can have are sent to
    them, so edges that no pair needs are never shuffled."""
    ids = cut(pairs.select(end).distinct())
    ids = F.broadcast(ids) if ids.count() <= SENT else ids
    return edges.select(F.col(own).alias(end), F.col(other).alias(name)).join(ids, end, "left_semi").distinct()


def call_similarity(pairs: DataFrame, bin_edges: DataFrame, src_edges: DataFrame, mapping: DataFrame, two_hops: bool = False) -> DataFrame:
    """bin_id, src_id, call: the mean over callers and callees of the Jaccard similarity between the mapped confirmed
    neighbours of the binary function and all neighbours of the source function; 0 for an empty union. two_hops: the pairs
    come from neighbour_candidates."""
    union = F.col("n_m") + F.col("n_s") - F.col("n_i")
    value = F.when(union > 0, F.col("n_i") / F.when(union > 0, union)).otherwise(0.0)
    pairs = cut(pairs.select("bin_id", "src_id").distinct())
    callers = _side(pairs, bin_edges, src_edges, mapping, "callee_id", "caller_id", two_hops).select("bin_id", "src_id", value.alias("up"))
    callees = _side(pairs, bin_edges, src_edges, mapping, "caller_id", "callee_id", two_hops).select("bin_id", "src_id", value.alias("down"))
    return callers.join(callees, ["bin_id", "src_id"]).select("bin_id", "src_id", ((F.col("up") + F.col("down")) / 2).alias("call"))


def propagation_bonus(pairs: DataFrame, bin_edges: DataFrame, src_edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """bin_id, src_id, bonus: 0.20 times the share of mapped neighbours that are neighbours of the source function too."""
    m = mapping.select(F.col("bin_id").alias("nb"), F.col("src_id").alias("ns"))
    wanted = cut(pairs.select("bin_id", "src_id").distinct())
    sides = []
    for own, other in (("callee_id", "caller_id"), ("caller_id", "callee_id")):
        # Neighbours count as binary functions: two that are mapped to one source function are two.
        mapped = _of(bin_edges, own, other, wanted, "bin_id", "nb").join(m, "nb")
        near = _of(src_edges, own, other, wanted, "src_id", "ns").withColumn("hit", F.lit(1))
        sides.append(wanted.join(mapped, "bin_id").join(near, ["src_id", "ns"], "left").groupBy("bin_id", "src_id").agg(F.count("*").alias("n"), F.count("hit").alias("h")))
    total = sides[0].unionByName(sides[1]).groupBy("bin_id", "src_id").agg(F.sum("n").alias("n"), F.sum("h").alias("h"))
    return wanted.join(total, ["bin_id", "src_id"], "left").select("bin_id", "src_id", F.coalesce(0.20 * F.col("h") / F.col("n"), F.lit(0.0)).alias("bonus"))


def neighbour_candidates(bins: DataFrame, bin_edges: DataFrame, src_edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """bin_id, src_id: for the given binary functions (bin_id), the neighbours of the source functions that their confirmed
    neighbours are mapped to, in either direction. Starts from the few open functions, so two hops stay small."""
    both = lambda e: e.select(F.col("caller_id").alias("x"), F.col("callee_id").alias("y")).unionByName(e.select(F.col("callee_id").alias("x"), F.col("caller_id").alias("y"))).distinct()
    first = bins.select(F.col("bin_id").alias("x")).join(both(bin_edges), "x").select(F.col("x").alias("bin_id"), F.col("y").alias("nb"))
    mapped = first.join(mapping.select(F.col("bin_id").alias("nb"), F.col("src_id").alias("x")), "nb").select("bin_id", "x").distinct()
    return mapped.join(both(src_edges), "x").select("bin_id", F.col("y").alias("src_id")).distinct()


#: Sets of more neighbours have a wide sketch too.
WIDE_ABOVE, WORDS = 64, 16


def _sketched(near: DataFrame, func: str, order: DataFrame, two: DataFrame, above: float) -> DataFrame:
    """ns, f, at, n, both, t0, t1: for each function (func) of near (func, ns) those of its neighbours, from rare to common, of
    which any set that is similar enough has the first common one. at: the place, n: how many there are, both: it has
    neighbours on the other side too (two: func), so either side may be what makes a pair; t0, t1: a bitmap of them all."""
    rows = near.select(F.col(func).alias("f"), "ns").join(order, "ns", "left").repartition("f")
    every = Window.partitionBy("f")
    placed = rows.select(
        "f", "ns", F.row_number().over(every.orderBy("df", "ns")).alias("at"), F.count("*").over(every).alias("n"), *[_word(k, 2).over(every).alias(f"t{k}") for k in range(2)]
    )
    placed = placed.join(two.select(F.col(func).alias("f"), F.lit(True).alias("both")).distinct(), "f", "left").withColumn("both", F.coalesce("both", F.lit(False)))
    return placed.where(F.col("n") - F.col("at") + 1 >= F.when(F.col("both"), above).otherwise(2 * above) * F.col("n") - 1e-6)


def _word(k: int, words: int) -> Column:
    """Word k of a bitmap of so many words, of the neighbours ns."""
    h = F.xxhash64("ns")
    return F.bit_or(F.when(F.pmod(F.shiftright(h, 6), F.lit(words)) == k, F.expr("shiftleft(1L, cast(xxhash64(ns) & 63 as int))")).otherwise(F.lit(0).cast("long")))


def _wide(near: DataFrame, func: str, name: str) -> DataFrame:
    """func and a wide bitmap, of the functions with more than WIDE_ABOVE neighbours."""
    maps = near.select(func, "ns").repartition(func).groupBy(func).agg(F.count("*").alias("n"), F.array(*[_word(k, WORDS) for k in range(WORDS)]).alias(name))
    return maps.where(F.col("n") > WIDE_ABOVE).select(func, name)


def _bits_apart(x: str, y: str) -> Column:
    return F.bit_count(F.col(x).bitwiseXOR(F.col(y)))


def inferred_pairs(bins: DataFrame, bin_edges: DataFrame, src_edges: DataFrame, mapping: DataFrame, above: float) -> DataFrame:
    """bin_id, src_id, call: the pairs of neighbour_candidates whose call similarity is more than `above` (0 or more).
    Edges are distinct. The mean of two sides is that much only if one of them is, or one is twice that where the other is empty. A side is only
    for pairs that meet in a rare enough neighbour (the first common one leaves as many as the similarity takes) and whose
    bitmaps do not rule it out; so few pairs that are not similar are ever made, and those left are computed exactly."""
    bin_edges, src_edges = cut(bin_edges), cut(src_edges)
    m = mapping.select(F.col("bin_id").alias("nb"), F.col("src_id").alias("ns"))
    open_edges = {own: bin_edges.select(F.col(own).alias("bin_id"), F.col(other).alias("nb")).join(bins.select("bin_id"), "bin_id", "left_semi").join(m, "nb").select("bin_id", "ns").distinct() for own, other in (("callee_id", "caller_id"), ("caller_id", "callee_id"))}
    open_edges = {own: cut(df) for own, df in open_edges.items()}
    sides = []
    for own, other in (("callee_id", "caller_id"), ("caller_id", "callee_id")):
        near = src_edges.select(F.col(own).alias("src_id"), F.col(other).alias("ns"))
        order = cut(near.groupBy("ns").agg(F.count("*").alias("df")))
        b = cut(_sketched(open_edges[own], "bin_id", order, open_edges[other], above))
        s = cut(_sketched(near, "src_id", order, src_edges.select(F.col(other).alias("src_id")), above))
        met = b.select("ns", *[F.col(c).alias(f"b_{c}") for c in b.columns if c != "ns"]).join(s.select("ns", *[F.col(c).alias(f"s_{c}") for c in s.columns if c != "ns"]), "ns")
        least = F.when(F.col("b_both") & F.col("s_both"), above).otherwise(2 * above)
        enough = least / (1 + least) * (F.col("b_n") + F.col("s_n")) - 1e-6  # so many neighbours are common
        tiny = _bits_apart("b_t0", "s_t0") + _bits_apart("b_t1", "s_t1")
        able = met.where((1 + F.least(F.col("b_n") - F.col("b_at"), F.col("s_n") - F.col("s_at")) >= enough) & (F.col("b_n") + F.col("s_n") - tiny >= 2 * enough))
        able = cut(able.select(F.col("b_f").alias("bin_id"), F.col("s_f").alias("src_id"), (F.col("b_n") + F.col("s_n") - 2 * enough).alias("apart")).distinct())
        able = able.join(_wide(open_edges[own], "bin_id", "x"), "bin_id", "left").join(_wide(near, "src_id", "y"), "src_id", "left")
        apart = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
        sides.append(cut(able.where(F.coalesce(apart <= F.col("apart"), F.lit(True))).select("bin_id", "src_id")))
    pairs = cut(sides[0].unionByName(sides[1]).distinct())
    ends = lambda edges, end: [edges.join(pairs.select(F.col(end).alias(c)).distinct(), c, "left_semi") for c in ("caller_id", "callee_id")]
    bin_near, src_near = (cut(up.unionByName(down).distinct()) for up, down in (ends(bin_edges, "bin_id"), ends(src_edges, "src_id")))
    return call_similarity(pairs, bin_near, src_near, mapping).where(F.round("call", 12) > above)

"""Resharding by minimum-cost flow.

Old shards are sources (their bytes), new shards are sinks (their capacities), and moving a byte to another shard costs
one; the cheapest flow says how many bytes go from each old shard to each new one, and so moves the fewest bytes. Within
an old shard documents lie on an axis, large ones first, so that what stays is a prefix and the cuts between transfers
fall among small documents. The axis is cut hierarchically: sums of a bounded number of blocks (shard, size class,
leading hash bits) go to the driver; only blocks that a cut runs through are divided again, by further hash bits and at
last by where a row lies, until what is still cut is few rows, which are ordered one by one. No text is shuffled.

Defined results: a null text has size 1 and CRC 0; an empty table gives an empty plan. The hash that places a row is that
of its id, size and text CRC, so equal texts (one group of the query) lie on the axis wherever their ids put them. Rows
that are equal in all three are told apart by where they lie in the input, so the shards stay near equal however often a
row is repeated; which of them goes where doesn't show. Rows with a null id are like others. Slots order a shard's rows by
hash, id, CRC; repeated rows get different slots. Columns besides the id and the text are not looked at by `plan`, and
kept by `rewrite`, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _util as u

OLD_SHARDS, NEW_SHARDS = 12, 16
#: Leading hash bits of a block and of its parts: (shards x classes x 2^6) sums at most go to the driver.
BLOCK_BITS, PART_BITS = 6, 10
SLOT_ROWS = 20_000
#: So many rows that are still cut are ordered in one window.
WINDOW_ROWS = 100_000


def min_cost_flow(supply: Sequence[int], capacity: Sequence[int], cost) -> dict[tuple[int, int], int]:
    """Successive shortest paths (Bellman-Ford) from sources to sinks; cost(i, j) for a unit. Supplies must fit."""
    n, m = len(supply), len(capacity)
    s, t = n + m, n + m + 1
    graph: list[list[list]] = [[] for _ in range(n + m + 2)]  # edges: to, room, cost, index of the reverse

    def edge(a: int, b: int, room: int, price: int) -> None:
        graph[a].append([b, room, price, len(graph[b])])
        graph[b].append([a, 0, -price, len(graph[a]) - 1])

    total = sum(supply)
    for i, x in enumerate(supply):
        edge(s, i, x, 0)
        for j in range(m):
            edge(i, n + j, total, cost(i, j))
    for j, x in enumerate(capacity):
        edge(n + j, t, x, 0)
    while True:
        far: list = [None] * len(graph)
        far[s], via = 0, [None] * len(graph)
        queue = [s]
        while queue:
            after = []
            for a in queue:
                for e in graph[a]:
                    if e[1] and (far[e[0]] is None or far[a] + e[2] < far[e[0]]):
                        far[e[0]], via[e[0]] = far[a] + e[2], (a, e)
                        after.append(e[0])
            queue = list(dict.fromkeys(after))
        if far[t] is None:
            break
        path, at = [], t
        while at != s:
            at, e = via[at]
            path.append(e)
        push = min(e[1] for e in path)
        for e in path:
            e[1] -= push
            graph[e[0]][e[3]][1] += push
    return {(i, e[0] - n): total - e[1] for i in range(n) for e in graph[i] if n <= e[0] < n + m and total - e[1] > 0}


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def transfers(sizes: Sequence[int], capacities: Sequence[int]) -> list[list[tuple[int, int]]]:
    """Per old shard the cuts of its axis, in order: (new shard, end). What stays comes first."""
    flow = min_cost_flow(sizes, capacities, lambda i, j: int(i != j))
    out = []
    for i in range(len(sizes)):
        end, cuts = 0, []
        for j in sorted((j for a, j in flow if a == i), key=lambda j: (j != i, j)):
            end += flow[i, j]
            cuts.append((j, end))
        out.append(cuts or [(min(i, len(capacities) - 1), 0)])
    return out


def old_shard(id_col: str = "doc_id", shards: int = OLD_SHARDS) -> Column:
    """The layout that the query takes as given: by the id's CRC."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(shards)).cast("int")


def measured(docs: DataFrame, old: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, old (the old shard), cls (size class, large first), h (0 to 2^32-1), and salt, which tells
    equal rows apart and is fixed once the frame is written."""
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), old.alias("old"))
    salt = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 32)
    return rows.withColumns({"cls": (64 - F.length(F.bin("size"))).cast("int"), "h": F.shiftrightunsigned(F.xxhash64("doc_id", "text_crc32", "size"), 32), "salt": salt})


def assign(rows: DataFrame, old_shards: int, capacities: Sequence[int], window_rows: int = WINDOW_ROWS) -> DataFrame:
    """rows (of measured, written) with the new `shard`. Capacities must add up to the sizes of all rows."""
    spark = rows.sparkSession
    bits, levels = 32, {}
    for name, width in (("block", BLOCK_BITS), ("part", PART_BITS), ("fine", PART_BITS)):
        bits -= width
        levels[name] = F.shiftright("h", bits).cast("long")
    levels["pile"] = F.pmod("salt", F.lit(1 << PART_BITS))
    rest, key, cuts, at, settled = rows.withColumns(levels), ["old", "cls"], [], {}, []
    types = {"old": "int", "cls": "int"}

    def where(shard: int, start: float, end: float) -> int | None:
        """The new shard of an interval of the axis; None if a cut runs through it."""
        for j, stop in cuts[shard]:
            if end <= stop:
                return j
            if start < stop:
                return None
        return cuts[shard][-1][0]

    def listed(found: list, last: str) -> DataFrame:
        """A small table of groups: at most shards x size classes x 2^BLOCK_BITS, below that cuts x 2^PART_BITS."""
        return F.broadcast(spark.createDataFrame(found, ", ".join(f"{k} {types.get(k, 'long')}" for k in key) + f", {last}"))

    for level in levels:
        key.append(level)
        sums = rest.groupBy(*key).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).orderBy(*key).collect()
        if not cuts:
            sizes = [0] * old_shards
            for r in sums:
                sizes[r["old"]] += r["bytes"]
            cuts = transfers(sizes, capacities)
            at = {(i,): 0 for i in range(old_shards)}
        whole, cut, most = [], [], 0
        for r in sums:
            group = tuple(r[k] for k in key)
            within = group[:1] if level == "block" else group[:-1]
            start = at[within]
            at[within] = end = start + r["bytes"]
            j = where(r["old"], start, end)
            (cut if j is None else whole).append((*group, start if j is None else j))
            most = max(most, r["n"] if j is None else 0)
        settled.append(rest.join(listed(whole, "shard int"), key))
        if not cut:
            break
        rest, at = rest.join(listed(cut, "base long"), key), {c[:-1]: c[-1] for c in cut}
        if most <= window_rows or level == "pile":
            # Few rows a group: one by one, each by its middle. ROWS, so that repeated rows don't move as one.
            w = Window.partitionBy(*key).orderBy("h", "doc_id", "text_crc32", "size", "salt").rowsBetween(Window.unboundedPreceding, 0)
            middle = F.col("base") + F.sum("size").over(w) - F.col("size") / 2
            stops = F.array(*[F.array(*[F.struct(F.lit(e).cast("double").alias("stop"), F.lit(j).alias("to")) for j, e in c]) for c in cuts])
            mine = F.filter(F.element_at(stops, F.col("old") + 1), lambda c: F.col("middle") <= c["stop"])
            last = F.element_at(F.element_at(stops, F.col("old") + 1), -1)
            settled.append(rest.withColumn("middle", middle).withColumn("shard", F.coalesce(F.get(mine, F.lit(0))["to"], last["to"])))
            break
        rest = rest.drop("base")
    out = None
    for x in settled:
        x = x.select(*rows.columns, "shard")
        out = x if out is None else out.unionByName(x)
    return out


def slots(rows: DataFrame, n: int, shards: int, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """rows with `slot`, gapless from 0 in each shard: ranks within buckets of some slot_rows rows, plus the counts of
    the buckets before. A bucket that repeated rows swell is divided by their salt."""
    buckets = max(64, math.ceil(n / shards / slot_rows))
    rows = rows.withColumn("bucket", F.pmod("h", F.lit(buckets)))
    fair = max(shards * slot_rows, math.ceil(n / buckets))
    hot = rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > 2 * fair).select("bucket", F.ceil(F.col("n") / fair).alias("parts"))
    few = hot.limit(10_001).collect()
    if few:
        # So many buckets are sent to all; more are joined.
        hot = F.broadcast(rows.sparkSession.createDataFrame(few, "bucket long, parts long")) if len(few) <= 10_000 else hot
        rows = rows.join(hot, "bucket", "left").withColumn("pile", F.pmod("salt", F.coalesce("parts", F.lit(1)))).drop("parts")
    else:
        rows = rows.withColumn("pile", F.lit(0))
    by = ["shard", "bucket", "pile"]
    before = Window.partitionBy("shard").orderBy("bucket", "pile").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*by).agg(F.count("*").alias("n")).select(*by, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("h", "doc_id", "text_crc32", "size", "salt"))
    ranked = rows.withColumn("rank", rank)
    return ranked.join(starts, by).withColumn("slot", (F.col("start") + F.col("rank") - 1).cast("long")).drop("bucket", "pile", "start", "rank")


def plan(docs: DataFrame, old: Column | None = None, old_shards: int = OLD_SHARDS, new_shards: int = NEW_SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The new place of every row: doc_id, size, text_crc32, old, shard, slot."""
    rows = u.materialise(measured(docs, old_shard(id_col, old_shards) if old is None else old, id_col, text_col), "reshard")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    placed = assign(rows, old_shards, equal_capacities(total, new_shards))
    return slots(placed, n, new_shards).select("doc_id", "size", "text_crc32", "old", "shard", "slot")


def affected(planned: DataFrame) -> list[int]:
    """Shards whose files change: those that some row leaves or enters (at most as many as there are shards)."""
    moved = planned.where("old <> shard")
    return sorted(r[0] for r in moved.select(F.explode(F.array("old", "shard")).alias("s")).distinct().collect())


def rewrite(docs: DataFrame, planned: DataFrame, out_dir: str, old: Column | None = None, old_shards: int = OLD_SHARDS, id_col: str = "doc_id", text_col: str = "text") -> list[int]:
    """Write the affected shards, and only those, to out_dir/shard=N, all columns of docs; returns their numbers.
    Rows of an affected shard are dealt over several files by hash, so a shard is never one task."""
    touched = affected(planned)
    names = {c: u.fresh(c, docs) for c in ("shard", "crc", "size", "key_id", "key_crc", "key_size")}
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    keyed = docs.withColumn(names["crc"], F.crc32(data)).withColumn(names["size"], (F.octet_length(data) + 1).cast("long"))
    to = planned.where(F.col("shard").isin(touched)).select(F.col("doc_id").alias(names["key_id"]), F.col("text_crc32").alias(names["key_crc"]), F.col("size").alias(names["key_size"]), F.col("shard").alias(names["shard"])).distinct()
    same = keyed[id_col].cast("long").eqNullSafe(to[names["key_id"]]) & (keyed[names["crc"]] == to[names["key_crc"]]) & (keyed[names["size"]] == to[names["key_size"]])
    keyed.join(to, same).select(*docs.columns, names["shard"]).write.partitionBy(names["shard"]).mode("overwrite").parquet(out_dir)
    return touched

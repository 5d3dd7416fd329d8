"""Variable-capacity best-fit packing of documents into training sequences.

Documents are measured in tokens (words of the contracts plus one end). A document longer than the largest permitted
length is cut into full pieces and a rest, so no token is lost. Pieces are dealt by a hash into groups of about
`group_tokens` tokens (the number of groups grows with the corpus, the work in each doesn't); a group that repeated rows
swell is divided by where its rows lie. In each group the permitted lengths are optimised jointly: best-fit decreasing is
run for the sets of lengths that bins may be opened at (all sets of a few lengths, else a local search over sets). Each
piece goes to the open bin that it fills best; if none holds it, it opens the bin of the least cost per token that it and
the pieces still to come can put there. At the end every bin is downsized to the smallest permitted length that holds
its contents, and the plan of the lowest total cost wins. A sequence costs its length, an overhead, and a share that grows
with the square of the length, as attention does.

Defined results: a null or empty text is its end token; repeated rows are packed each, and may come to several groups; an
empty table packs into nothing; ties go to the smaller id, then the smaller piece. Rows with a null id are packed like
others. Very long texts become many pieces; columns besides the id and the text are not looked at.
"""

from __future__ import annotations

import bisect
import itertools
import math
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _util as u

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: Cost of a sequence besides its length: an overhead, and its length once more for each ATTENTION tokens in it.
OVERHEAD, ATTENTION = 16, 65_536
GROUP_TOKENS = 1 << 19
#: With more permitted lengths than this, sets of lengths are searched by single changes.
ALL_SETS = 5


def bin_cost(capacity: int) -> float:
    return capacity + OVERHEAD + capacity * capacity / ATTENTION


def best_fit(lengths: Sequence[int], largest: int, opened: Callable[[int, int], int]) -> tuple[list[int], list[int], list[int]]:
    """Best-fit of lengths in the given order. opened: the size of the bin that a piece opens if none holds it, given its
    length and the tokens that follow it. Returns per piece its bin and its offset there, and per bin its contents."""
    room: list[list[int]] = [[] for _ in range(largest + 1)]  # bins by what is free in them
    there = 0  # bit r: some bin has r free
    left = sum(lengths)
    bins, offsets, filled, sizes = [], [], [], []
    for n in lengths:
        left -= n
        fits = there >> n
        if fits:
            r = (fits & -fits).bit_length() - 1 + n
            b = room[r].pop()
            if not room[r]:
                there ^= 1 << r
        else:
            b = len(filled)
            filled.append(0)
            sizes.append(opened(n, left))
        bins.append(b)
        offsets.append(filled[b])
        filled[b] += n
        r = sizes[b] - filled[b]
        if r:
            room[r].append(b)
            there |= 1 << r
    return bins, offsets, filled


def pack(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = bin_cost) -> tuple[list[int], list[int], list[int]]:
    """Per piece its bin and offset, per bin its final capacity. lengths: from long to short, at most max(capacities)."""
    sizes = sorted(capacities)
    least = lambda n: sizes[bisect.bisect_left(sizes, n)]
    price = {c: cost(c) for c in sizes}
    plans: dict[tuple, tuple] = {}

    def plan(allowed: tuple) -> float:
        """The cost of the plan that opens bins of the allowed sizes only (or the smallest that holds a piece)."""
        if allowed not in plans:

            def opened(n: int, left: int) -> int:
                """The least cost per token that can come into the bin; of equals the larger."""
                return min((c for c in allowed if c >= n), key=lambda c: (price[c] / min(c, n + left), -c), default=least(n))

            bins, offsets, filled = best_fit(lengths, sizes[-1], opened)
            final = [least(x) for x in filled]
            plans[allowed] = sum(price[c] for c in final), bins, offsets, final
        return plans[allowed][0]

    best = tuple(sizes)
    total = plan(best)
    if len(sizes) <= ALL_SETS:
        sets = [s for n in range(len(sizes) - 1, 0, -1) for s in itertools.combinations(sizes, n)]
        best = min([best, *sets], key=plan)
    else:
        while True:
            near = [tuple(c for c in sizes if (c in best) != (c == x)) for x in sizes]
            other = min((s for s in near if s), key=plan)
            if plan(other) >= total:
                break
            best, total = other, plan(other)
    return plans[best][1:]


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h (a hash that deals rows out, also those with a null or the same id), salt (tells equal rows apart, fixed
    once the frame is written), n_tokens."""
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("salt", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in u.pieces(b):
                yield u.batch(schema, [*x.columns[:3], [len(t.encode("utf-8", "surrogatepass").split()) + 1 for t in x.column(3).to_pylist()]])

    cols = u.id_text(docs, id_col, text_col)
    salted = cols.select("doc_id", F.xxhash64("doc_id", "text").alias("h"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"), "text")
    return salted.mapInArrow(run, "doc_id long, h long, salt long, n_tokens long")


def pack_documents(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, group_tokens: int = GROUP_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start (first token), n_tokens, bin_id, bin_offset, capacity, bin_tokens."""
    lengths = u.materialise(measured(docs, id_col, text_col), "lengths")
    return pack_lengths(lengths, capacities, group_tokens)


def _dealt(lengths: DataFrame, group_tokens: int) -> DataFrame:
    """doc_id, n_tokens, grp: groups of about group_tokens tokens. Where a hash has far more (equal rows), its rows are
    dealt once more, by their salt, into groups with numbers of their own."""
    total = lengths.agg(F.sum("n_tokens")).first()[0] or 0
    groups = max(1, math.ceil(total / group_tokens))
    dealt = lengths.select("doc_id", "n_tokens", "salt", F.pmod("h", F.lit(groups)).alias("grp"))
    sums = dealt.groupBy("grp").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"))
    # A single long document can't be what swells a group: it is one row.
    hot = sums.where(F.col("tokens") > 4 * group_tokens).where("rows > 1").select("grp", F.ceil(F.col("tokens") / group_tokens).alias("parts"))
    if hot.isEmpty():
        return dealt.drop("salt")
    before = F.sum("parts").over(Window.orderBy("grp").rowsBetween(Window.unboundedPreceding, -1))  # a row a hot group
    numbered = u.materialise(hot.select("grp", "parts", (groups + F.coalesce(before, F.lit(0))).alias("first")), "groups")
    joined = dealt.join(numbered, "grp", "left")
    return joined.select("doc_id", "n_tokens", F.coalesce(F.col("first") + F.pmod("salt", "parts"), "grp").alias("grp"))


def pack_lengths(lengths: DataFrame, capacities: Sequence[int] = CAPACITIES, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """As pack_documents, from doc_id, h, salt, n_tokens."""
    capacities = tuple(sorted(capacities))
    names = ["doc_id", "piece", "start", "n_tokens", "bin_id", "bin_offset", "capacity", "bin_tokens"]
    schema = pa.schema([(n, pa.int64()) for n in names])
    largest = capacities[-1]

    def run(table: pa.Table) -> pa.Table:
        group = table.column("grp")[0].as_py()
        items = []
        for i, n in zip(table.column("doc_id").to_pylist(), table.column("n_tokens").to_pylist(), strict=True):
            items += [(-min(largest, n - at), i is None, i or 0, at // largest, at) for at in range(0, n, largest)]
        items.sort()
        bins, offsets, final = pack([-x[0] for x in items], capacities)
        used = [0] * len(final)
        for x, b in zip(items, bins, strict=True):
            used[b] -= x[0]
        cols = [[None if x[1] else x[2] for x in items], [x[3] for x in items], [x[4] for x in items], [-x[0] for x in items], [group << 32 | b for b in bins], offsets, [final[b] for b in bins], [used[b] for b in bins]]
        return pa.Table.from_arrays([pa.array(c, type=pa.int64()) for c in cols], schema=schema)

    return _dealt(lengths, group_tokens).groupBy("grp").applyInArrow(run, ", ".join(f"{n} long" for n in names))

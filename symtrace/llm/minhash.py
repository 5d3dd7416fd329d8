"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document is the set of its distinct shingles. Texts with the same words are one class from the start, however many
copies there are, and only classes are sketched. The sketch is filled in rounds: in round i < t every shingle is thrown
into a hashed bin and brings the value i + hash, in round t + j all go to bin j, so each of the t coordinates is filled
after 2t rounds at the latest, and a coordinate keeps its smallest value. Equal coordinates then estimate the similarity
with concentration bounds; classes that agree in a whole band meet in a bucket.

Within a bucket every class is first compared with the bucket's smallest, and links are joined into components. Only
classes of one bucket that are still in different components are then compared pairwise, and of those only the ones
that can link at all. Shingles that few of these classes have are rare; a pair shares at most the smaller of its numbers
of other shingles, plus the rare ones that it shares, which an equality join counts; and a link needs 180 * shared >=
80 * (size + size). So a large group of near copies doesn't become all its pairs, while no candidate pair that could
link two components is left out. Every link is confirmed on the full sets of words.

Bands: 48 of 6 coordinates; a pair at the limit of 0.8 shares no band with a chance of (1-0.8^6)^48 < 5e-7.

Defined results: texts that are null or without words have 0 shingles and link with nothing; with fewer words than a
shingle the whole sequence is the one shingle. Rows with a null id link with nothing, have a null component and are
kept. Rows that share an id are one node of the graph; each is kept if the id is the smallest of its own component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _util as u
from .components import components

BANDS, ROWS = 48, 6
PERCENT = 80
#: Words whose hashes a worker remembers at a time.
REMEMBERED = 100_000
#: So many ids (4 MB) are sent to all executors instead of shuffling the texts they belong to.
FEW_IDS = 500_000
#: A shingle is rare if so many classes of open buckets have it at most.
RARE = 64

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over x plus a seed's multiple of an odd constant."""
    z = x + np.uint64((seed + 1) * _GOLD & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * _M1
    z = (z ^ (z >> np.uint64(27))) * _M2
    return z ^ (z >> np.uint64(31))


def tokens(text: str) -> list[bytes]:
    """Words, A-Z lower-cased (bytes.lower and bytes.split know ASCII only)."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], k: int) -> set:
    if not words:
        return set()
    return set(zip(*(words[i:] for i in range(k)), strict=False)) if len(words) >= k else {tuple(words)}


def shingle_hashes(words: list[bytes], k: int, memo: dict[bytes, int]) -> np.ndarray:
    """64-bit hashes of the shingles, distinct."""
    h = np.fromiter([memo[w] if w in memo else memo.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in words], np.uint64, len(words))
    k = min(k, len(words))
    out = np.full(len(h) - k + 1, np.uint64(k))
    for i in range(k):
        out = mix(out ^ h[i : len(h) - k + 1 + i], i)
    return np.unique(out)


def sketch(sets: list[np.ndarray], t: int) -> np.ndarray:
    """The sketches of many sets of hashes at once: uint64[len(sets), t], round in the top 16 bits. No set is empty."""
    out = np.full((len(sets), t), _EMPTY)
    flat = out.reshape(-1)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    items, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    for i in range(2 * t):
        if i < t:
            z = mix(items, i)
            bins = ((z >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64)
        else:
            z, bins = mix(items, i), i - t
        np.minimum.at(flat, owner * t + bins, np.uint64(i << 48) | mix(z, -2) >> np.uint64(16))
        open_sets = (out == _EMPTY).any(axis=1)
        if not open_sets.any():
            break
        left = open_sets[owner]
        items, owner = items[left], owner[left]
    return out


def band_keys(sketches: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """64-bit bucket keys: one a band, different bands never share one on purpose."""
    out = np.empty((len(sketches), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(sketches), np.uint64(b + 1))
        for r in range(rows):
            key = mix(key ^ sketches[:, b * rows + r], r)
        out[:, b] = key
    return out


def classes(docs: DataFrame, k: int) -> DataFrame:
    """Per row: doc_id, n_shingles and (h1, h2), the 128-bit hash of its words (null: no words)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in u.pieces(b, 128):
                words = [tokens(t) for t in x.column(1).to_pylist()]
                hashes = np.frombuffer(b"".join(xxhash.xxh3_128_digest(b" ".join(w)) for w in words), np.int64).reshape(-1, 2)
                none = np.array([not w for w in words], bool)
                yield u.batch(schema, [x.column(0), [len(shingles(w, k)) for w in words], *(pa.array(hashes[:, c], mask=none) for c in (0, 1))])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long")


def buckets(texts: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """texts: rep, text. One row per class and band: rep, key."""
    schema = pa.schema([("rep", pa.int64()), ("key", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        for b in batches:
            for x in u.pieces(b, 128):
                if len(memo) > REMEMBERED:
                    memo.clear()
                found = [(r, w) for r, w in zip(x.column(0).to_pylist(), map(tokens, x.column(1).to_pylist()), strict=True) if w]
                if found:
                    keys = band_keys(sketch([shingle_hashes(w, k, memo) for _, w in found], bands * rows), bands, rows)
                    yield u.batch(schema, [np.repeat([r for r, _ in found], bands), keys.reshape(-1).view(np.int64)])

    return texts.select("rep", "text").mapInArrow(run, "rep long, key long")


def _compressed(texts: DataFrame) -> DataFrame:
    """rep, text of texts, the text as compressed bytes: it is shuffled with every pair that it is in."""
    schema = pa.schema([("rep", pa.int64()), ("text", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=6).compress
        for b in batches:
            for x in u.pieces(b, 128):
                yield u.batch(schema, [x.column(0), [pack(t.encode("utf-8", "surrogatepass")) for t in x.column(1).to_pylist()]])

    return texts.mapInArrow(run, "rep long, text binary")


def verify(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, right = None, set()
        unpack = zstandard.ZstdDecompressor().decompress
        words = lambda t: unpack(t).lower().split()
        for batch in batches:
            for x in u.pieces(batch, 256):
                keep = []
                a, b, left_texts, right_texts = x.columns
                for i, j, s, t in zip(a.to_pylist(), b.to_pylist(), left_texts.to_pylist(), right_texts.to_pylist(), strict=True):
                    if j != last:
                        last, right = j, shingles(words(t), k)
                    left = shingles(words(s), k)
                    both = len(left & right)
                    if 100 * both >= percent * (len(left) + len(right) - both):
                        keep.append((i, j))
                yield u.batch(schema, [[i for i, _ in keep], [j for _, j in keep]])

    named = lambda c, t: texts.select(F.col("rep").alias(c), F.col("text").alias(t))
    # The joins shuffle and may be split where one class is in very many pairs; a broadcast would grow with the texts.
    joined = pairs.hint("merge").join(named("a", "s").hint("merge"), "a").join(named("b", "t").hint("merge"), "b")
    return joined.select("a", "b", "s", "t").mapInArrow(run, "a long, b long")


def near_components(docs: DataFrame, k: int = 5, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept; and h1, h2, the hash of the row's words."""
    cols = u.id_text(docs, id_col, text_col)
    members = u.materialise(classes(cols, k), "classes")
    known = members.where("doc_id is not null and h1 is not null")
    by_id = known.groupBy("h1", "h2", "doc_id").agg(F.count("*").alias("n"), F.first("n_shingles").alias("size"))
    least = by_id.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "n", "size")).alias("x"))
    reps = u.materialise(least.select("h1", "h2", F.col("x.doc_id").alias("rep"), "x.n", "x.size"), "reps")
    texts = u.materialise(_texts(cols, reps), "texts")
    keyed = u.materialise(buckets(texts, k, bands, rows), "buckets")
    shared = u.unkeyed(keyed.groupBy("key").agg(F.min("rep").alias("b"), F.max("rep").alias("last")).where("b < last").select("key", "b"), "key")
    meeting = u.materialise(keyed.join(shared, "key").select("key", F.col("rep").alias("a"), "b"), "meeting")
    u.drop_files(keyed)
    stars = u.materialise(meeting.where("a <> b").select("a", "b").distinct(), "stars")
    ends = stars.select(F.col("a").alias("rep")).unionByName(stars.select(F.col("b").alias("rep"))).distinct()
    ids = u.materialise(ends, "ends")
    ends = F.broadcast(ids) if ids.count() <= FEW_IDS else ids
    near = u.materialise(_compressed(texts.join(ends, "rep", "left_semi")), "near")
    u.drop_files(texts)
    links = u.materialise(verify(stars, near, k, percent), "links")
    roots = u.materialise(components(links), "roots")
    done = [ids]
    rows = u.materialise(_open(meeting, roots), "open")
    able, made = _able_pairs(rows, near, reps, k, percent)
    open_pairs = u.materialise(able.join(stars, ["a", "b"], "left_anti"), "pairs")
    u.drop_files(*made)
    if not open_pairs.isEmpty():
        done += [links, roots]
        links = u.materialise(links.unionByName(verify(open_pairs, near, k, percent)), "links")
        roots = u.materialise(components(links), "roots")
    by_class = reps.drop("n", "size").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", F.coalesce("root", "rep").alias("root"))
    joined = members.join(by_class, ["h1", "h2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    out = joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "h1", "h2")
    out = u.materialise(out, "near")
    u.drop_files(members, reps, meeting, stars, near, rows, open_pairs, links, roots, *done)
    return out


def _texts(cols: DataFrame, reps: DataFrame) -> DataFrame:
    """rep and text of each class: of the row with its smallest id. Rows that share this id are one node of the graph."""
    own = reps.groupBy("rep").agg(F.max("n").alias("n"))
    texts = cols.join(u.unkeyed(own, "rep"), cols.doc_id == F.col("rep")).select("rep", "text")
    return texts if reps.where("n > 1").isEmpty() else texts.distinct()


def _several(rows: DataFrame) -> DataFrame:
    """rows (key, root, ...) of the buckets that hold more than one component."""
    keys = rows.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 < r2").select("key")
    return rows.join(u.unkeyed(keys, "key"), "key", "left_semi")


def _open(meeting: DataFrame, roots: DataFrame) -> DataFrame:
    root = roots.withColumnRenamed("node", "a")
    return _several(meeting.join(root, "a", "left").select("key", "a", F.coalesce("root", "a").alias("root")))


def _able_pairs(rows: DataFrame, near: DataFrame, reps: DataFrame, k: int, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs (a, b), a > b, and what was written to find them: pairs of the open rows (key, a, root) that are in different components and may link. Shingles are
    told apart by 32 bits here: where two collide, classes seem to share more than they do, never less. A class has
    `most` shingles that aren't rare; it `lacks` what a link with the smallest class of its bucket needs beyond them, or 1
    where only a link with a larger class needs more."""
    schema = pa.schema([("a", pa.int64()), ("h", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for x in u.pieces(b, 128):
                if len(memo) > REMEMBERED:
                    memo.clear()
                hashes = [np.unique(shingle_hashes(w, k, memo).astype(np.uint32)) if w else np.empty(0, np.uint32) for w in (unpack(t).lower().split() for t in x.column(1).to_pylist())]
                yield u.batch(schema, [np.repeat(x.column(0).to_numpy(), [len(h) for h in hashes]), np.concatenate(hashes).view(np.int32)])

    texts = near.join(rows.select(F.col("a").alias("rep")).distinct(), "rep", "left_semi")
    each = u.materialise(texts.select("rep", "text").mapInArrow(run, "a long, h int"), "shingles")
    few = u.unkeyed(each.withColumn("h", F.col("h").cast("long")).groupBy("h").agg(F.count("*").alias("df")).where(F.col("df") <= RARE), "h")
    rare = u.materialise(each.withColumn("h", F.col("h").cast("long")).join(few, "h"), "rare")
    counts = rare.groupBy("a").agg(F.count("*").alias("n"), F.count(F.when(F.col("df") > 1, 1)).alias("common"))
    # An id with several texts has no bounds: its size is the least, and all it has counts as shared.
    sizes = reps.groupBy("rep").agg(F.min("size").alias("size"), F.count("*").alias("texts")).withColumnRenamed("rep", "a")
    known = sizes.join(u.unkeyed(counts, "a"), "a", "left")
    facts = known.select("a", "size", F.when(F.col("texts") == 1, F.col("size") - F.coalesce("n", F.lit(0))).otherwise(1 << 40).alias("most"), F.coalesce("common", F.lit(0)).alias("common"))
    rows = rows.join(u.unkeyed(facts, "a"), "a")
    ends = u.unkeyed(rows.groupBy("key").agg(F.min("size").alias("least"), F.max("size").alias("greatest")), "key")
    rows = u.materialise(rows.join(ends, "key"), "rows")
    lack = lambda other: F.ceil(percent * (F.col("size") + other) / (100.0 + percent) - F.col("most") - 1e-9)
    lacks, worst = lack(F.col("least")), lack(F.least("greatest", F.floor(F.col("size") * 100.0 / percent + 1e-9)))
    alive = u.materialise(_several(rows.where(lacks <= 0).select("key", "a", "root", "size", "most")), "alive")
    # A class may lack shingles in one bucket and none in another: what counts is the least that it lacks where it does.
    # One that lacks none with the smallest class but some with the largest that it can link with lacks 1 at the least.
    own = rows.groupBy("a").agg(F.min("root").alias("root"), F.max("size").alias("size"), F.max("most").alias("most"), F.max("common").alias("common"), F.min(lacks).alias("least"), F.min(F.when(worst > 0, F.greatest(lacks, F.lit(1)))).alias("lacks"))
    need = lambda shared, n, m: (100.0 + percent) * shared >= percent * (n + m)
    pairs, made = _component_pairs(alive, need)
    return pairs.unionByName(_rare_pairs(rare.where("df > 1"), own, need)).distinct(), [each, rare, rows, alive, *made]


def _rare_pairs(rare: DataFrame, own: DataFrame, need) -> DataFrame:
    """Pairs that can link only by the rare shingles they share: a class that lacks n for a link must share n of its
    rare ones with its partner, so at least one of its rarest, all but n - 1 of them. What a pair shares of the rest can't
    be more than those n - 1."""
    lacking = own.where("common >= lacks").select("a", "root", "size", "most", "common", "lacks", (F.col("common") - F.col("lacks") + 1).alias("first"))
    w = Window.partitionBy("a").orderBy("df", "h")
    rarest = rare.join(u.unkeyed(lacking.select("a", "first"), "a"), "a").withColumn("r", F.row_number().over(w)).where("r <= first").select("h", F.col("a").alias("x"))
    met = rarest.join(rare.select("h", F.col("a").alias("y")), "h").where("x <> y").groupBy("x", "y").agg(F.count("*").alias("n"))
    one = lacking.drop("first").withColumnRenamed("a", "x")
    two = own.where("common >= least").select(F.col("a").alias("y"), F.col("root").alias("r2"), F.col("size").alias("s2"), F.col("most").alias("m2"), F.col("common").alias("c2"))
    both = met.join(one, "x").join(two, "y").where("root <> r2")
    share = F.least(F.col("n") + F.col("lacks") - 1, "common", "c2") + F.least("most", "m2")
    return both.where(need(share, F.col("size"), F.col("s2"))).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))


def _component_pairs(rows: DataFrame, need) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs of different components that meet in a bucket and may link without a rare shingle. Two components are paired
    bucket by bucket, or, where they meet in so many buckets that this would repeat pairs, once as wholes."""
    here = u.materialise(rows.groupBy("key", "root").agg(F.count("*").alias("n")), "groups")
    there = here.select("key", F.col("root").alias("other"), F.col("n").alias("m"))
    meet = u.materialise(here.join(there, "key").where("root < other").select("key", "root", "other", (F.col("n") * F.col("m")).alias("pairs")), "meet")
    members = u.materialise(rows.select("root", "a", "size", "most").distinct(), "members")
    whole = members.groupBy("root").agg(F.count("*").alias("n"))
    cost = meet.groupBy("root", "other").agg(F.sum("pairs").alias("pairs"))
    cost = cost.join(whole, "root").join(whole.select(F.col("root").alias("other"), F.col("n").alias("m")), "other")
    way = u.materialise(cost.select("root", "other", (F.col("pairs") <= F.col("n") * F.col("m")).alias("by_key"), (F.col("n") > F.col("m")).alias("turn")), "way")
    may = need(F.least("most", "most2"), F.col("size"), F.col("size2"))
    second = [F.col("root").alias("other"), F.col("a").alias("b"), F.col("size").alias("size2"), F.col("most").alias("most2")]
    # The smaller component is spread out first, the larger one only as far as its members may link.
    small, large = F.when(F.col("turn"), F.col("other")).otherwise(F.col("root")), F.when(F.col("turn"), F.col("root")).otherwise(F.col("other"))
    once = way.where("not by_key").select(small.alias("root"), large.alias("other")).join(members, "root").join(members.select(*second), "other").where(may)
    keyed = meet.join(way.where("by_key"), ["root", "other"]).select("key", "root", "other").join(rows, ["key", "root"]).join(rows.select("key", *second), ["key", "other"]).where(may)
    both = once.select("a", "b").unionByName(keyed.select("a", "b"))
    return both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), [here, meet, members, way]


def near_digest(docs: DataFrame, k: int = 2, **options) -> DataFrame:
    return near_components(docs, k, **options).select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with one document of each group: the row whose id is the smallest of its component."""
    found = near_components(docs, k, percent, id_col=id_col, text_col=text_col)
    gone = u.materialise(found.where("not kept").select(F.col("doc_id").alias(u.fresh("gone", docs))).distinct(), "gone")
    name = gone.columns[0]
    out = docs.join(gone, docs[id_col].cast("long") == gone[name], "left_anti")
    repeated = not found.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    u.drop_files(found)
    return _first_rows(out, id_col) if repeated else out


def _first_rows(docs: DataFrame, id_col: str) -> DataFrame:
    """One row of each id; rows without an id all stay."""
    return docs.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).unionByName(docs.where(F.col(id_col).isNull()))


def brute_force(rows: list[tuple[int, str | None]], k: int, percent: int = PERCENT) -> dict[int, int]:
    """component_id by doc_id from all pairs; for tests on small tables."""
    sets = {i: shingles(tokens(t or ""), k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            s, t = sets[a], sets[b]
            if s and t and 100 * min(len(s), len(t)) >= percent * max(len(s), len(t)):
                both = len(s & t)
                if 100 * both >= percent * (len(s) + len(t) - both) and find(a) != find(b):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: find(i) for i in sets}

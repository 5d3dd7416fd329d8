"""Nearest neighbours by additive quantisation.

A vector is approximated by a sum of full-dimensional codewords, one of each codebook. Codebooks come from residual
k-means on a bounded sample (the TRAIN different vectors with the smallest hashes), less its median and divided by its
median norm, and are then refitted jointly by least squares; every vector is encoded by a beam search over the codebooks
and stored with its codes, the norm of its approximation and the distance between both. A task decodes a piece of codes
once for all queries; the inner products with the decoded sums are those that tables of all codewords would add up to.

The codes only order and rule out. The RERANK best of a piece get exact distances on the original vectors, which bound how
far a neighbour can be. A vector stays out if its approximation is further from the query than this bound and its own
distance from the approximation together; all others get exact distances too. So codes that fit badly (many dimensions,
norms of all sizes) cost time, but no neighbour: the neighbours are those of brute force.

Equal vectors are one entry of the index, so copies, however many, can't crowd a list; they are spread out at the end
(a query needs K + 1 of each at most). Queries go through in blocks of a fixed size: a block is broadcast, the codes
are scanned where they are, each task keeps its best K a query. The whole index is searched.

Defined results: vectors that are null, zero, or hold null or non-finite components, or have another length than most
vectors, are no query and no candidate, nor are rows without an id; rows that share an id are different candidates, but
none of them is a candidate for a query of that id; ties go to the smaller id. Fewer than K candidates are all returned.
Query rows with the same id and the same vector are one query; the same id with different vectors is a query for each
of them, so such an id has several lists. Columns besides the id and the vector are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from . import _util as u

BOOKS, WORDS, BEAM = 64, 16, 4
TRAIN = 8192
RERANK = 128
NEAREST = 10
QUERY_BLOCK = 4096
#: Vectors that a task scans at most before it hands on its best.
TASK_ROWS = 65_536
#: Of a piece's pairs that codes can't rule out: from this share on, inner products of the vectors rule out first.
OPEN = 0.02
#: Relative error that is allowed for in the distances that rule out; they are made of centred and scaled doubles.
SLACK = 1e-12


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = (np.sum(centres**2, 1) - 2 * x @ centres.T).argmin(1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), k)])
    return centres


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes uint8[n, M] by beam search: of all extensions of the kept partial sums, those with the least error stay."""
    m, k, _ = books.shape
    n = len(x)
    flat = books.reshape(m * k, -1).astype(np.float32)
    gram, norms = 2 * flat @ flat.T, np.sum(flat**2, 1)
    gain = norms - 2 * (x.astype(np.float32) @ flat.T)  # what a codeword alone adds to the squared error
    codes = np.zeros((n, 1, m), np.uint8)
    errors = np.zeros((n, 1), np.float32)  # without the constant |x|^2
    cross = np.zeros((n, 1, m * k), np.float32)  # twice the inner products of the partial sum with the codewords to come
    rows = np.arange(n)[:, None]
    for b in range(m):
        total = errors[:, :, None] + gain[:, None, b * k : (b + 1) * k] + cross[:, :, :k]
        total = total.reshape(n, -1)
        width = min(beam, total.shape[1])
        best = np.argpartition(total, width - 1, 1)[:, :width] if width < total.shape[1] else np.tile(np.arange(width), (n, 1))
        parent, word = best // k, best % k
        codes = codes[rows, parent]
        codes[:, :, b] = word
        errors = total[rows, best]
        if b + 1 < m:
            cross = cross[:, :, k:][rows, parent]
            cross += gram[b * k + word, (b + 1) * k :]
    return codes[np.arange(n), errors.argmin(1)]


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    out = np.zeros((len(codes), books.shape[2]))
    for words, chosen in zip(books, codes.T, strict=True):
        out += words[chosen]
    return out


def train(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 2, seed: int = 7) -> np.ndarray:
    """Codebooks [M, K, D]: residual k-means, then rounds of beam encoding and joint least squares."""
    rng, residual, out = np.random.default_rng(seed), x.copy(), []
    for _ in range(books):
        c = _kmeans(residual, words, rng)
        residual = residual - c[(np.sum(c**2, 1) - 2 * residual @ c.T).argmin(1)]
        out.append(c)
    fitted = np.stack(out)
    for _ in range(rounds):
        codes = np.concatenate([encode(x[i : i + 1024], fitted) for i in range(0, len(x), 1024)])
        chosen = np.zeros((len(x), books * words), np.float32)
        chosen[np.arange(len(x))[:, None], codes.astype(int) + np.arange(books) * words] = 1
        gram = (chosen.T @ chosen).astype(float) + 1e-2 * np.eye(books * words)
        old = fitted.reshape(books * words, -1)
        fitted = np.linalg.solve(gram, chosen.T.astype(float) @ x + 1e-2 * old).reshape(fitted.shape)
    return fitted


def valid(vector: Column) -> Column:
    """Neither null nor zero, and all components finite."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda v: v != 0)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, x (floats as they are, others as doubles, as bytes), h1, h2 of the vectors that take part."""
    kind = _kind(vectors, vector_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("v")).where(valid(F.col("v")) & F.col("vec_id").isNotNull())
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    schema = pa.schema([("vec_id", pa.int64()), ("x", pa.binary()), ("h1", pa.int64()), ("h2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) + np.zeros(1, DTYPES[kind])  # -0 becomes 0
            data = [r.tobytes() for r in x]
            h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, data)), np.int64).reshape(-1, 2)
            yield u.batch(schema, [b.column(0), data, h[:, 0], h[:, 1]])

    return rows.where(F.size("v") == (lengths["d"] if lengths else 0)).mapInArrow(run, "vec_id long, x binary, h1 long, h2 long")


DTYPES = {"float": np.float32, "double": np.float64}


def _kind(vectors: DataFrame, vector_col: str) -> str:
    kind = vectors.select(vector_col).schema[0].dataType
    return "float" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "double"


def _matrix(column, kind: str) -> np.ndarray:
    values = column.to_pylist() if isinstance(column, pa.Array) else column
    return np.frombuffer(b"".join(values), DTYPES[kind]).reshape(len(values), -1).astype(float)


class Frame:
    """Where codes are made: vectors less the median of a sample, divided by its median norm. Only ordering and ruling
    out happen there."""

    def __init__(self, sample: np.ndarray):
        self.centre, self.scale = np.median(sample, 0), 1.0
        with np.errstate(all="ignore"):
            self.centre = np.where(np.isfinite(self.centre), self.centre, 0.0)
            norms = np.linalg.norm(sample - self.centre, axis=1)
            scale = float(np.median(norms))
            self.scale = scale if np.isfinite(scale) and scale > 0 else 1.0
            near = norms <= 1e4 * scale  # a few huge vectors would leave nothing of the others
            self.books = train(self.of(sample[near] if near.any() else np.zeros_like(sample[:1])))

    def of(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre) / self.scale

    def reach(self, distance: np.ndarray) -> np.ndarray:
        """An exact distance in this frame, not below: squares of tiny ones are lost on the way to it."""
        return np.maximum(distance, 1e-150) / self.scale * (1 + 1e-9)


KEY = ["query_id", "q1", "q2"]


class _Nearest:
    """Each query's k best entries of the index so far, by distance and the smallest id that isn't the query's."""

    def __init__(self, n: int, k: int):
        self.k, self.have = k, np.zeros((n, k), bool)
        self.score, self.key = np.full((n, k), np.inf), np.zeros((n, k), np.int64)
        self.hashes = np.zeros((n, k, 2), np.int64)

    def limit(self, part: slice) -> np.ndarray:
        """No entry beyond this distance can come in."""
        return np.where(self.have[part, -1], self.score[part, -1], np.inf)

    def add(self, at: int, query: np.ndarray, score: np.ndarray, key: np.ndarray, hashes: np.ndarray) -> None:
        """Entries of queries at + query."""
        some = score <= self.limit(slice(None))[at + query]
        query, score, key, hashes = at + query[some], score[some], key[some], hashes[some]
        touched = np.unique(query)
        old, column = np.nonzero(self.have[touched])
        old = touched[old]
        query, score, key = np.concatenate([old, query]), np.concatenate([self.score[old, column], score]), np.concatenate([self.key[old, column], key])
        hashes = np.concatenate([self.hashes[old, column], hashes])
        order = np.lexsort((key, score, query))
        place = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        order, place = order[place < self.k], place[place < self.k]
        to = query[order], place
        self.have[to], self.score[to], self.key[to], self.hashes[to] = True, score[order], key[order], hashes[order]


def _exact(queries: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out, step = np.empty(len(i)), max(1, (1 << 18) // x.shape[1])
    for at in range(0, len(i), step):
        out[at : at + step] = np.sqrt(np.sum((x[j[at : at + step]] - queries[i[at : at + step]]) ** 2, 1))
    return out


def _left(z: np.ndarray, z_norm: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Rows whose product with a row of _right is above 0 only if |z - approximation| > reach + error: the difference of both
    squares, each term so much less or more that rounding to single precision can't make it positive. Rows that single
    precision can't hold are NaN, which rules out nothing."""
    loss = 4 * (z.shape[1] + 16) * np.finfo(np.float32).eps
    return _single(np.column_stack([z, z_norm * (1 - loss) - reach**2 * (1 + loss), np.ones(len(z)), reach]))


def _right(approx: np.ndarray, norm: np.ndarray, error: np.ndarray) -> np.ndarray:
    loss = 4 * (approx.shape[1] + 16) * np.finfo(np.float32).eps
    return _single(np.column_stack([-2 * approx, np.ones(len(approx)), norm * (1 - loss) - error**2 * (1 + loss), -2 * error * (1 + loss)]))


def _single(x: np.ndarray) -> np.ndarray:
    return np.where((np.abs(x).max(1) < 1e15)[:, None], x, np.nan).astype(np.float32)


def _scan(frame: Frame, kind: str, keys: list[np.ndarray], queries: np.ndarray, nearest: int, rerank: int):
    """Keeps each query's nearest entries of a task. keys: KEY of each query."""
    schema = pa.schema([*((k, pa.int64()) for k in KEY), ("h1", pa.int64()), ("h2", pa.int64()), ("key", pa.int64()), ("score", pa.float64())])
    n, d = queries.shape
    loss = 4 * (d + 8) * np.finfo(float).eps  # what rounding can take of a sum of squares, relatively

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(all="ignore"):
            best = _Nearest(n, nearest)
            z = frame.of(queries)
            z_norm = np.sum(z**2, 1)
            for whole in batches:
                for b in u.pieces(whole, 4096):
                    hashes = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1)
                    least, alone = b.column(2).to_numpy(), b.column(3).is_null().to_numpy(zero_copy_only=False)
                    following = b.column(3).fill_null(0).to_numpy()
                    x = _matrix(b.column(4), kind)
                    approx = decode(np.frombuffer(b"".join(b.column(5).to_pylist()), np.uint8).reshape(len(x), -1), frame.books)
                    norm, error = b.column(6).to_numpy(), b.column(7).to_numpy()
                    right = _right(approx, norm, error)
                    y = frame.of(x)
                    y_norm = np.sum(y**2, 1)
                    whole_right = _right(y, y_norm, SLACK * np.sqrt(y_norm))
                    for at in range(0, n, 128):
                        part = slice(at, at + 128)
                        ids = keys[0][part]

                        def add(i, j):
                            some = (least[j] != ids[i]) | ~alone[j]  # the query itself is no candidate  # noqa: B023
                            i, j = i[some], j[some]
                            key = np.where(least[j] == ids[i], following[j], least[j])  # noqa: B023
                            best.add(at, i, _exact(queries[part], x, i, j), key, hashes[j])  # noqa: B023

                        first = None
                        if not np.isfinite(best.limit(part)).all():
                            width = min(rerank, len(x))
                            first = np.argpartition(norm - 2 * (z[part] @ approx.T), width - 1, 1)[:, :width]
                            add(np.repeat(np.arange(len(ids)), width), first.ravel())
                        reach = frame.reach(best.limit(part)) + SLACK * np.sqrt(z_norm[part])
                        left = _left(z[part], z_norm[part], reach)
                        opened = ~(left @ right.T > 0)
                        if first is not None:
                            np.put_along_axis(opened, first, False, 1)
                        if np.count_nonzero(opened) > OPEN * opened.size:
                            opened &= ~(left @ whole_right.T > 0)
                        if np.count_nonzero(opened) > OPEN * opened.size:
                            some = np.flatnonzero(opened.any(0))
                            full = (z_norm[part, None] + y_norm[some]) * (1 - loss) - 2 * (z[part] @ y[some].T)
                            opened[:, some] &= ~(full > (reach[:, None] + SLACK * np.sqrt(y_norm[some])) ** 2)
                        i, j = np.nonzero(opened)
                        if len(i):
                            add(i, j)
            for at in range(0, n, 4096):
                i, k = np.nonzero(best.have[at : at + 4096])
                i += at
                yield u.batch(schema, [*(c[i] for c in keys), best.hashes[i, k, 0], best.hashes[i, k, 1], best.key[i, k], best.score[i, k]])

    return run


def search(vectors: DataFrame, is_query: Column, nearest: int = NEAREST, rerank: int = RERANK, train_rows: int = TRAIN, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The nearest of every query row: query_id, rank, vec_id, score (Euclidean distance in double precision).
    is_query is a condition on the column vec_id."""
    spark = vectors.sparkSession
    out, kind = "query_id long, rank int, vec_id long, score double", _kind(vectors, vector_col)
    rows = u.materialise(usable(vectors, id_col, vector_col), "vectors")
    sample = u.hash_sample(rows.select(F.col("h1").alias("h"), "x"), train_rows).orderBy("h").limit(train_rows).collect()
    if not sample:
        u.drop_files(rows)
        return spark.createDataFrame([], out)
    frame = Frame(_matrix([bytes(r["x"]) for r in sample], kind))
    code_schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("least", pa.int64()), ("following", pa.int64()), ("x", pa.binary()), ("code", pa.binary()), ("norm", pa.float64()), ("error", pa.float64())])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(all="ignore"):
            for whole in batches:
                for b in u.pieces(whole, 512):
                    y = frame.of(_matrix(b.column(4), kind))
                    codes = encode(y, frame.books)
                    approx = decode(codes, frame.books)
                    error = np.linalg.norm(y - approx, axis=1) * (1 + 1e-9) + SLACK * np.linalg.norm(y, axis=1)
                    yield u.batch(code_schema, [*b.columns, [c.tobytes() for c in codes], np.sum(approx**2, 1), error])

    copies = u.materialise(_copies(rows, nearest), "copies")
    index = _distinct(rows, copies).mapInArrow(encoded, "h1 long, h2 long, least long, following long, x binary, code binary, norm double, error double")
    index = u.materialise(index, "codes")
    n = index.count()
    tasks = max(1, -(-n // TASK_ROWS), min(8, n // 4096))
    queries = rows.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("h1").alias("q1"), F.col("h2").alias("q2"), F.col("x").alias("q"))
    queries = u.materialise(queries.groupBy(*KEY).agg(F.first("q").alias("q")), "queries")
    blocks = (queries.count() + QUERY_BLOCK - 1) // QUERY_BLOCK
    found = []
    for k in range(blocks):  # by a hash: blocks of about QUERY_BLOCK queries, whatever their number
        mine = queries.where(F.pmod(F.xxhash64(*KEY), F.lit(blocks)) == k)
        part = mine.orderBy(*KEY).collect()
        if part:
            keys = [np.array([r[c] for r in part]) for c in KEY]
            scan = _scan(frame, kind, keys, _matrix([bytes(r["q"]) for r in part], kind), nearest, rerank)
            hits = index.coalesce(tasks).mapInArrow(scan, ", ".join(f"{c} long" for c in [*KEY, "h1", "h2", "key"]) + ", score double")
            found.append(u.materialise(_best(hits, nearest), "hits"))
    if not found:
        u.drop_files(rows, copies, index, queries)
        return spark.createDataFrame([], out)
    hits = found[0]
    for x in found[1:]:
        hits = hits.unionByName(x)
    result = u.materialise(_spread(hits, copies, nearest), "nearest")
    u.drop_files(rows, copies, index, queries, *found)
    return result


def _copies(rows: DataFrame, nearest: int) -> DataFrame:
    """h1, h2, vec_id, r, n: of each distinct vector the first ids with their ranks, as many as a list can need, and how
    many rows each has, as many as a list can need."""
    ids = rows.groupBy("h1", "h2", "vec_id").agg(F.count("*").alias("n"))
    first = ids.withColumn("r", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))).where(F.col("r") <= nearest + 1)
    return first.select("h1", "h2", "vec_id", "r", F.least("n", F.lit(nearest)).cast("int").alias("n"))


def _distinct(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """h1, h2, the smallest id (least) and the next (following, null: none), x of each distinct vector. Partial sums first:
    copies cost their count only."""
    each = rows.groupBy("h1", "h2").agg(F.min("x").alias("x"), F.min("vec_id").alias("least"))
    second = copies.where("r = 2").select("h1", "h2", F.col("vec_id").alias("following"))
    return each.join(second, ["h1", "h2"], "left").select("h1", "h2", "least", "following", "x")


def _best(hits: DataFrame, k: int) -> DataFrame:
    return hits.withColumn("r", F.row_number().over(Window.partitionBy(*KEY).orderBy("score", "key", "h1", "h2"))).where(F.col("r") <= k).drop("r")


def _spread(hits: DataFrame, copies: DataFrame, nearest: int) -> DataFrame:
    """The rows of the entries found. Each entry has a row that isn't the query's own, and `key` is the first such id, so the
    nearest rows are among those of as many nearest entries."""
    spread = hits.drop("key").join(copies.drop("r"), ["h1", "h2"]).where("vec_id <> query_id").select(*KEY, "vec_id", "score", F.explode(F.array_repeat(F.lit(0), F.col("n"))))
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy("score", "vec_id"))
    return spread.withColumn("rank", rank).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def brute_force(ids: np.ndarray, x: np.ndarray, queries: np.ndarray, nearest: int = NEAREST) -> dict[int, list[tuple[float, int]]]:
    """All exact answers, for tests: per query id the (distance, id) of its nearest."""
    out = {}
    for q in np.flatnonzero(queries):
        d = np.sqrt(np.sum((x - x[q]) ** 2, 1))
        out[int(ids[q])] = sorted((float(d[i]), int(ids[i])) for i in range(len(ids)) if ids[i] != ids[q])[:nearest]
    return out

"""Language-model scores from a class-based bigram model after Brown et al.

Tokens are read once: blocks of documents are written to the shared folder as arrays of local word numbers plus the
block's dictionary, so that every later pass works on integers. Counts of all training words come from the blocks'
dictionaries by a distributed sum. The model has three parts:

- Exchange clustering puts every word of the training text into one of CLASSES classes, so that the bigram likelihood of
  the classes rises. It starts with the SEEDS most frequent words, from exact counts on the driver (a bounded matrix): one
  word after the other moves to its best class. Then all other words, however many and however rare, are put by the same
  gain into the class that the counts of the classes around them call for, as in distributed exchange; those counts are
  sums a word over the whole corpus, which grow with it and stay distributed.
- p(w | v) = (1 - u(c_v)) * [(1 - MIX) * p(c_w | c_v) * p(w | c_w) + MIX * p(w)], and u(c_v) for all unseen words
  together; u is the share of words seen once among those that follow class c_v. The probabilities of the known
  words and the unseen word add up to one after every class.

A document's score depends on its words only, not on how rows lie in files; classes of a block's words come back by a join on
the word, in rows of numbers, and are put together with the block by a cogroup whose size is that of a block.

Defined results: a null or empty text is its end token; repeated rows count as often as they occur and get equal
scores; a null id has the CRC of the empty text and is thus held out or not like others; an empty table gives an empty
result; if there is no training text, every token is unseen and certain, and the base is that of an empty count. Equally
frequent words come in the order of their bytes; of equal gains the class of the smaller number is taken, or a word stays.
Words are told apart by 64-bit hashes where their contexts are summed, by their bytes where they are counted. Very long
texts are blocks of their own; columns besides the id and the text are not looked at.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _util as u

SEEDS, CLASSES = 1000, 128
SWEEPS = 8
MIX = 0.05
BLOCK_CHARS = 16 << 20
#: Tokens that are looked at together within a block.
PART = 1 << 18
#: Fixed word numbers in a block: the end of a text, which is also what comes before its first word.
END = 0

_PACKED = pa.schema([("block", pa.int64()), ("data", pa.binary())])


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


class Block:
    """Documents as word numbers: ids (0: null), has_id, held (per document), ends (exclusive, in tokens), tokens, words
    (the dictionary; number 0 is the end), counts (training tokens by number)."""

    def __init__(self):
        self.number: dict[bytes, int] = {b"": END}
        self.flat, self.ends, self.ids = array("i"), array("q"), []

    def add(self, ids: list, texts: list[str]) -> None:
        number = self.number
        for t in texts:
            self.flat.extend([number.setdefault(w, len(number)) for w in t.encode("utf-8", "surrogatepass").lower().split()])
            self.flat.append(END)
            self.ends.append(len(self.flat))
        self.ids += ids

    def word_ids(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words)).view(np.int64)

    def pack(self) -> tuple[int, bytes]:
        ids, has_id = np.array([i or 0 for i in self.ids], np.int64), np.array([i is not None for i in self.ids], np.int8)
        held = np.array([is_held_out(i) for i in self.ids], np.int8)
        parts = [ids.tobytes(), has_id.tobytes(), held.tobytes(), self.ends.tobytes(), self.flat.tobytes(), b" ".join(self.number)]
        data = b"".join([np.array([len(p) for p in parts], np.int64).tobytes(), *parts])
        return xxhash.xxh3_64_intdigest(data) - (1 << 63), zstandard.compress(data, 3)

    @classmethod
    def unpack(cls, data: bytes) -> Block:
        raw, out = zstandard.decompress(data), object.__new__(cls)
        sizes, at = np.frombuffer(raw, np.int64, 6), 48
        parts = []
        for n in sizes.tolist():
            parts.append(raw[at : at + n])
            at += n
        out.ids, out.has_id, out.held, out.ends, out.tokens = (np.frombuffer(p, t) for p, t in zip(parts, (np.int64, np.int8, np.int8, np.int64, np.int32), strict=False))
        out.words = parts[5].split(b" ")
        return out

    def doc_spans(self) -> Iterator[tuple[int, int]]:
        """Ranges of documents of some PART tokens, so that what is computed a token stays small."""
        at, n = 0, len(self.ends)
        while at < n:
            end = max(at + 1, int(np.searchsorted(self.ends, (self.ends[at - 1] if at else 0) + PART, "right")))
            yield at, end
            at = end

    def spans(self) -> Iterator[tuple[int, int]]:
        """The same as ranges of tokens."""
        for at, end in self.doc_spans():
            yield int(self.ends[at - 1]) if at else 0, int(self.ends[end - 1])

    def training(self, at: int, end: int) -> np.ndarray:
        """Whether each token of a range is of a training document."""
        return self.held[np.searchsorted(self.ends, np.arange(at, end), "right")] == 0

    def before(self, at: int, end: int) -> np.ndarray:
        """The token before each of a range that begins a document (before a document's first token is an end)."""
        return np.concatenate([[END], self.tokens[at : end - 1]]).astype(np.int32)

    def after(self, at: int, end: int) -> np.ndarray:
        return np.concatenate([self.tokens[at + 1 : end], [END]]).astype(np.int32)

    def counts(self) -> np.ndarray:
        out = np.zeros(len(self.words), np.int64)
        for at, end in self.spans():
            out += np.bincount(self.tokens[at:end][self.training(at, end)], minlength=len(out))
        return out


def blocks(docs: DataFrame, chars: int = BLOCK_CHARS) -> DataFrame:
    """docs (doc_id, text) as rows (block, data), on disk in the shared folder. A block has some `chars` code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = Block(), 0
        for b in batches:
            for x in u.pieces(b):
                texts = x.column(1).to_pylist()
                block.add(x.column(0).to_pylist(), texts)
                size += sum(map(len, texts))
                if size >= chars:
                    yield u.batch(_PACKED, [[v] for v in block.pack()])
                    block, size = Block(), 0
        if block.ids:
            yield u.batch(_PACKED, [[v] for v in block.pack()])

    return u.materialise(docs.mapInArrow(run, "block long, data binary"), "blocks")


def each_block(packed: DataFrame, schema: pa.Schema, ddl: str, rows) -> DataFrame:
    """rows(block id, Block) gives columns for every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                yield u.batch(schema, rows(b.column(0)[k].as_py(), Block.unpack(b.column(1)[k].as_py())))

    return packed.mapInArrow(run, ddl)


def exchange(counts: np.ndarray, fixed: int, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Exchange clustering on a matrix of bigram counts. The first `fixed` words keep a class of their own (0, 1, ...),
    the others move among `classes` more. Returns the class of each word. Words are visited from the most frequent."""
    n = len(counts)
    total = fixed + classes
    mass = counts.sum(0) + counts.sum(1)
    order = [int(w) for w in np.argsort(-mass[fixed:], kind="stable") + fixed]
    of = np.zeros(n, int)
    of[:fixed] = range(fixed)
    for k, w in enumerate(order):
        of[w] = fixed + k % classes
    member = np.zeros((n, total))
    member[np.arange(n), of] = 1
    joint = member.T @ counts @ member
    xlog = lambda a: a * np.log(np.maximum(a, 1e-300))
    movable = np.arange(fixed, total)
    for _ in range(sweeps):
        moved = 0
        for w in order:
            to = np.bincount(of, weights=counts[w], minlength=total)
            back = np.bincount(of, weights=counts[:, w], minlength=total)
            self_count = counts[w, w]
            a = of[w]
            to[a] -= self_count
            back[a] -= self_count
            joint[a] -= to
            joint[:, a] -= back
            joint[a, a] -= self_count
            left, right = joint.sum(1) + back, joint.sum(0) + to  # the word's neighbours keep their counts
            # What putting w into each class changes in the log-likelihood of class bigrams.
            gain = (xlog(joint[movable] + to) - xlog(joint[movable])).sum(1) + (xlog(joint[:, movable] + back[:, None]) - xlog(joint[:, movable])).sum(0)
            own = joint[movable, movable]
            gain += xlog(own + to[movable] + back[movable] + self_count) - xlog(own + to[movable]) - xlog(own + back[movable]) + xlog(own)
            wl, wr = to.sum() + self_count, back.sum() + self_count
            gain -= xlog(left[movable] + wl) - xlog(left[movable]) + xlog(right[movable] + wr) - xlog(right[movable])
            best = fixed + int(gain.argmax())
            if gain[best - fixed] <= gain[a - fixed] + 1e-9:
                best = a
            moved += best != a
            of[w] = best
            joint[best] += to
            joint[:, best] += back
            joint[best, best] += self_count
        if not moved:
            break
    return of


def top_words(words: DataFrame, top: int) -> list[bytes]:
    return [r["word"] for r in words.where("c > 0 and length(word) > 0").orderBy(F.desc("c"), "word").limit(top).collect()]


def _bigrams(packed: DataFrame, top: list[bytes]) -> np.ndarray:
    """Counts of pairs in training text among END (0), all other words (1) and the top words (2, 3, ...)."""
    n, place = len(top) + 2, {w: k + 2 for k, w in enumerate(top)}
    schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])

    def rows(_: int, b: Block) -> list:
        code = np.array([0, *(place.get(w, 1) for w in b.words[1:])])
        times = np.zeros(n * n, np.int64)
        for at, end in b.spans():
            times += np.bincount((code[b.before(at, end)] * n + code[b.tokens[at:end]])[b.training(at, end)], minlength=n * n)
        found = np.flatnonzero(times)
        return [found, times[found]]

    counts = np.zeros(n * n)
    for r in each_block(packed, schema, "pair long, n long", rows).groupBy("pair").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["pair"]] = r["n"]
    return counts.reshape(n, n)


#: Class numbers: 0 the end, 1 to CLASSES, then words that no class around them speaks for; as a context only, one more
#: for unseen words.
REST, N = CLASSES + 1, CLASSES + 2
_CONTEXT = pa.schema([("wid", pa.int64()), ("ctx", pa.int32()), ("n", pa.int64())])


def contexts(b: Block, cls: np.ndarray) -> list:
    """How often the words without a class (-1) have each class behind them (ctx: the class) and before them (ctx: N more),
    in training text."""
    kind = np.int32 if len(b.words) * 2 * N < 1 << 31 else np.int64
    cls, keys = cls.astype(kind), []
    for at, end in b.spans():
        t = b.tokens[at:end]
        able = b.training(at, end) & (cls[t] < 0)
        for side, other in enumerate((b.after(at, end), b.before(at, end))):
            use = able & (cls[other] >= 0)
            keys.append(t[use].astype(kind) * (2 * N) + side * N + cls[other[use]])
    key = np.concatenate(keys) if keys else np.empty(0, kind)
    key.sort()
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, int)
    word = key[first] // (2 * N)
    return [b.word_ids()[word], key[first] % (2 * N), np.diff(np.append(first, len(key)))]


def place(starts: np.ndarray, ctx: np.ndarray, n: np.ndarray, joint: np.ndarray) -> np.ndarray:
    """The best class of each word by the gain in the likelihood of class bigrams, given the counts joint[N, N]. starts:
    where a word's entries (ctx, n) begin, each word has some."""
    xlog = lambda a: a * np.log(np.maximum(a, 1e-300))
    entries = np.append(starts, len(ctx))
    of = np.repeat(np.arange(len(starts)), np.diff(entries))
    around = np.concatenate([joint, joint.T], 1)  # [class, ctx]: what follows a class, then what comes before it
    plain = xlog(around)
    total = np.stack([joint.sum(1), joint.sum(0)])
    side = (ctx >= N).astype(int)
    mass = np.zeros((2, len(starts)))
    np.add.at(mass, (side, of), n)
    movable = np.arange(1, REST)
    gain = np.zeros((len(starts), CLASSES))
    few = n <= 8  # most entries: looked up
    for k in range(1, 9):
        table = (xlog(around + k) - plain)[movable].T
        at = np.flatnonzero(n == k)
        if len(at):
            _add_rows(gain, of[at], table, ctx[at])
    at = np.flatnonzero(~few)
    for i in range(0, len(at), 65_536):
        some = at[i : i + 65_536]
        before = around[movable][:, ctx[some]].T
        _add_rows(gain, of[some], xlog(before + n[some][:, None]) - xlog(before))
    for s in (0, 1):
        gain -= xlog(total[s][movable] + mass[s][:, None]) - xlog(total[s][movable])
    return gain.argmax(1) + 1


def _add_rows(out: np.ndarray, rows: np.ndarray, table: np.ndarray, pick: np.ndarray | None = None) -> None:
    """out[rows] += table[pick], where rows come in order; table rows are picked some at a time."""
    for i in range(0, len(rows), 65_536):
        r = rows[i : i + 65_536]
        x = table[pick[i : i + 65_536]] if pick is not None else table[i : i + 65_536]
        first = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        out[r[first]] += np.add.reduceat(x, first)


def _placed(rows: DataFrame, joint: np.ndarray) -> DataFrame:
    """wid, cls of the words of rows (wid, ctx, n)."""
    schema = pa.schema([("wid", pa.int64()), ("cls", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in u.pieces(b, 8192):
                lists = x.column(1)
                entries = lists.flatten()
                offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
                yield u.batch(schema, [x.column(0), place(offsets[:-1], entries.field(0).to_numpy(), entries.field(1).to_numpy(), joint)])

    # Sums by word and context first: a frequent word is many groups, and has 2 * N entries at most.
    sums = rows.groupBy("wid", "ctx").agg(F.sum("n").alias("n"))
    return sums.groupBy("wid").agg(F.collect_list(F.struct("ctx", "n")).alias("x")).mapInArrow(run, "wid long, cls int")


def seed_classes(packed: DataFrame, words: DataFrame, seeds: int) -> tuple[dict[bytes, int], np.ndarray]:
    """The classes of the most frequent words, and the counts of pairs of their classes and the end."""
    frequent = top_words(words, seeds)
    counts = _bigrams(packed, frequent)
    of = exchange(counts, 2, CLASSES) - 1  # 0: all other words
    of[0] = -1
    member = np.zeros((len(of), N))
    for k, c in enumerate(of):
        if k != 1:
            member[k, 0 if k == 0 else c] = 1
    return {w: int(c) for w, c in zip(frequent, of[2:], strict=True)}, member.T @ counts @ member


def score(docs: DataFrame, seeds: int = SEEDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    packed = blocks(u.id_text(docs, id_col, text_col))
    count_schema = pa.schema([("word", pa.binary()), ("wid", pa.int64()), ("n", pa.int64())])

    def counted(_: int, b: Block) -> list:
        n = b.counts()
        seen = n > 0
        return [pa.array([w for w, s in zip(b.words, seen.tolist(), strict=True) if s], type=pa.binary()), b.word_ids()[seen], n[seen]]

    first = each_block(packed, count_schema, "word binary, wid long, n long", counted).groupBy("word", "wid").agg(F.sum("n").alias("c"))
    first = u.materialise(first, "counts")
    known_seeds, joint = seed_classes(packed, first, seeds)

    def around_seeds(_: int, b: Block) -> list:
        return contexts(b, np.array([0, *(known_seeds.get(w, -1) for w in b.words[1:])]))

    placed = _placed(each_block(packed, _CONTEXT, "wid long, ctx int, n long", around_seeds), joint)
    seeded = spark.createDataFrame([(bytearray(w), k) for w, k in [*known_seeds.items(), (b"", 0)]], "word binary, seed int")
    words = first.join(F.broadcast(seeded), "word", "left").join(placed, "wid", "left")  # SEEDS + 1 rows
    words = u.materialise(words.select("word", "c", F.coalesce("seed", "cls", F.lit(REST)).alias("cls")), "words")

    # The classes of each block's words come back as numbers.
    word_schema = pa.schema([("block", pa.int64()), ("number", pa.int32()), ("word", pa.binary())])
    numbered = each_block(packed, word_schema, "block long, number int, word binary", lambda k, b: [[k] * len(b.words), np.arange(len(b.words), dtype=np.int32), pa.array(b.words, type=pa.binary())])
    known = u.materialise(numbered.join(words.hint("merge"), "word").select("block", "number", "c", "cls"), "known")
    sides = lambda: packed.groupBy("block").cogroup(known.groupBy("block"))

    def codes(b: Block, table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        c, cls = np.zeros(len(b.words), np.int64), np.full(len(b.words), N)
        at = table.column("number").to_numpy()
        c[at], cls[at] = table.column("c").to_numpy(), table.column("cls").to_numpy()
        cls[END] = 0
        return c, cls

    by_class = words.groupBy("cls").agg(F.sum("c").alias("c"), F.count("*").alias("v"), F.sum(F.when(F.col("c") == 1, 1).otherwise(0)).alias("once")).collect()
    size = np.zeros(N + 1)
    for r in by_class:
        size[r["cls"]] = r["c"]
    total, types = float(size.sum()), sum(r["v"] for r in by_class)
    once = sum(r["once"] for r in by_class)
    n = N
    pair_schema = pa.schema([("pair", pa.int64()), ("n", pa.int64()), ("once", pa.int64())])

    def transitions(left: pa.Table, right: pa.Table) -> pa.Table:
        times, single = np.zeros(n * n, np.int64), np.zeros(n * n, np.int64)
        for data in left.column("data").to_pylist():  # several: equal blocks, whose rows all count
            b = Block.unpack(data)
            c, cls = codes(b, right)
            for at, end in b.spans():
                learn, tokens = b.training(at, end), b.tokens[at:end]
                pair = (cls[b.before(at, end)] * n + cls[tokens])[learn]
                times += np.bincount(pair, minlength=n * n)
                single += np.bincount(pair[c[tokens][learn] == 1], minlength=n * n)
        found = np.flatnonzero(times)
        out = {"pair": found, "n": times[found], "once": single[found]}
        return pa.Table.from_arrays([pa.array(out[f.name], type=f.type) for f in pair_schema], schema=pair_schema)

    joint, singles = np.zeros((n, n)), np.zeros((n, n))
    for r in sides().applyInArrow(transitions, "pair long, n long, once long").groupBy("pair").agg(F.sum("n").alias("n"), F.sum("once").alias("once")).collect():
        joint[divmod(r["pair"], n)], singles[divmod(r["pair"], n)] = r["n"], r["once"]

    follow, unseen = _transitions(joint, singles, size[:n], once, total)
    denominator = total + 0.1 * (types + 1)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        tables = []
        for data in left.column("data").to_pylist():
            b = Block.unpack(data)
            c, cls = codes(b, right)
            base = np.log10((c + 0.1) / denominator)
            emit = np.where(c > 0, c / np.maximum(size[cls], 1), 0.0)
            uni = c / max(total, 1.0)
            for first, last in b.doc_spans():
                at, end = int(b.ends[first - 1]) if first else 0, int(b.ends[last - 1])
                starts = np.concatenate([[0], b.ends[first : last - 1] - at])
                add = lambda x, starts=starts: np.add.reduceat(x, starts)
                tokens, before = b.tokens[at:end], cls[b.before(at, end)]
                known_token = c[tokens] > 0
                p = (1 - MIX) * follow[before, np.minimum(cls[tokens], n - 1)] * emit[tokens] + MIX * uni[tokens]
                own = np.where(known_token, (1 - unseen[before]) * p, unseen[before])
                lengths = np.diff(b.ends[first:last], prepend=at)
                ids = pa.array(b.ids[first:last], mask=b.has_id[first:last] == 0)
                columns = [ids, b.held[first:last] == 1, lengths, add(known_token.astype(np.int64)), np.full(last - first, int(total)), add(base[tokens]), add(np.log10(own))]
                tables.append(pa.Table.from_batches([u.batch(schema, columns)]))
        return pa.concat_tables(tables) if tables else schema.empty_table()

    result = u.materialise(sides().applyInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"), "scores")
    u.drop_files(packed, first, words, known)
    return result


def _transitions(joint: np.ndarray, singles: np.ndarray, size: np.ndarray, once: int, total: float) -> tuple[np.ndarray, np.ndarray]:
    """p(class | class before) over known words, and the probability of an unseen word after each class (with one more
    row for unseen words as context). Both are smoothed by the rates over the whole corpus."""
    n = len(size)
    overall = size / total if total else np.full(n, 1.0 / n)
    seen = np.vstack([joint, np.zeros(n)])
    follow = (seen + 10.0 * overall) / (seen.sum(1, keepdims=True) + 10.0)
    rate = min(0.5, (once + 0.5) / (total + 1.0)) if total else 1.0
    unseen = np.append((singles.sum(1) + 20.0 * rate) / (joint.sum(1) + 20.0), rate)
    return follow, np.clip(unseen, 1e-9, 0.9) if total else np.ones(n + 1)


def perplexity(scores: DataFrame) -> dict[str, float]:
    """Perplexity of the held-out texts under the base and under the model (nan without held-out tokens)."""
    r = scores.where("held_out").agg(F.sum("n_tokens").alias("n"), F.sum("base_score").alias("b"), F.sum("score").alias("s")).first()
    return {k: 10 ** (-r[v] / r["n"]) if r["n"] else math.nan for k, v in (("base", "b"), ("model", "s"))}

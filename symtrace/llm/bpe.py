"""Byte-level BPE by speculation and verification.

A word is first split greedily into the longest vocabulary tokens. Such a split is what the merges would give if and
only if every token and every adjacent pair of tokens comes out of the merges unchanged; that is known per pair, so
all new pairs of a block are tested at once against a table of pairs (sorted arrays), and only pairs never seen
before are merged exactly. Words with a failing pair, and only those, go through exact merging as a whole.

The vocabulary file is a parameter and is read on the executors, once per Python worker. Text is split at added tokens,
then by the byte-level pattern. Defined results: a null or empty text has no tokens; the digest of no ids is that of
the empty string. Each text is encoded whole; memory grows with the longest text only, as words and pairs are remembered up
to a bound. Repeated rows are encoded each; of equally ranked merges the leftmost comes first, as in the library; rows with
a null id are like others; columns besides the id and the text are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import _util as u

#: Fixed pattern of byte-level BPE pre-tokenisation.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words and tested pairs remembered per worker; beyond that the memory is emptied, which changes speed, not results.
REMEMBERED, REMEMBERED_PAIRS = 1_200_000, 2_000_000
#: Up to so many bytes a word's pairs are searched again after each merge; NONE comes after every rank.
SHORT = 24
NONE = (1 << 40, -1)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable Latin-1 stands for itself, the rest follows from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(other)}


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, model = _byte_letters(), spec["model"]
        raw = lambda s: bytes(letters[c] for c in s)
        added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.ids = {raw(t): i for t, i in model["vocab"].items() if t not in added}
        self.pair: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = map(raw, m.split(" ") if isinstance(m, str) else m)
            self.pair.setdefault((self.ids[a], self.ids[b]), (rank, self.ids[a + b]))
        self.bytes = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in added.items()}
        self.spelled = {str(i): t for i, t in self.bytes.items()}
        self.added = added
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.words = regex.compile(PATTERN)
        self.longest: dict[bytes, int] = {}  # by a token's first three bytes
        for t in self.ids:
            self.longest[t[:3]] = max(len(t), self.longest.get(t[:3], 2))
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.tested = np.empty(0, np.int64)  # pairs, sorted
        self.fine = np.empty(0, bool)  # those that merges leave alone
        self.known: dict[str, str] = {}
        self.speculated = self.merged = 0

    def merge(self, data: bytes) -> list[int]:
        """Exact merging: the pair of lowest rank first, the leftmost of equals; in long words by a heap of pairs over a linked list."""
        ids = [self.single[b] for b in data]
        n = len(ids)
        if n <= SHORT:
            pair = self.pair.get
            best = [pair(p, NONE) for p in zip(ids, ids[1:], strict=False)]
            while best and (m := min(best)) is not NONE:
                i = best.index(m)
                ids[i : i + 2] = [m[1]]
                del best[i]
                if i:
                    best[i - 1] = pair((ids[i - 1], m[1]), NONE)
                if i < len(best):
                    best[i] = pair((m[1], ids[i + 1]), NONE)
            return ids
        right, left, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        heap = [(self.pair[p][0], i, p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in self.pair]
        heapq.heapify(heap)
        while heap:
            _, i, p = heapq.heappop(heap)
            j = right[i]
            if not alive[i] or j < 0 or (ids[i], ids[j]) != p:
                continue
            ids[i], alive[j], right[i] = self.pair[p][1], False, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b >= 0 and (q := (ids[a], ids[b])) in self.pair:
                    heapq.heappush(heap, (self.pair[q][0], a, q))
        return [x for x, a in zip(ids, alive, strict=True) if a]

    def greedy(self, data: bytes) -> list[int]:
        out, at, n = [], 0, len(data)
        while at < n:
            for end in range(min(n, at + self.longest.get(data[at : at + 3], 2)), at, -1):
                if (i := self.ids.get(data[at:end])) is not None:
                    out.append(i)
                    at = end
                    break
        return out

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of both tokens gives just these two tokens, for every pair at once. A right token
        of -1 asks whether the left one comes out of the merges by itself."""
        pairs, of = np.unique(left << 32 | (right & 0xFFFFFFFF), return_inverse=True)
        at = np.searchsorted(self.tested, pairs)
        known = at < len(self.tested)
        known[known] = self.tested[at[known]] == pairs[known]
        fine = np.zeros(len(pairs), bool)
        fine[known] = self.fine[at[known]]
        for k in np.flatnonzero(~known).tolist():
            a, b = int(pairs[k]) >> 32, int(pairs[k]) & 0xFFFFFFFF
            want = [a] if b == 0xFFFFFFFF else [a, b]
            fine[k] = self.merge(b"".join(self.bytes[i] for i in want)) == want
        if len(self.tested) > REMEMBERED_PAIRS:
            self.tested, self.fine = pairs, fine
        elif not known.all():
            self.tested, self.fine = np.insert(self.tested, at[~known], pairs[~known]), np.insert(self.fine, at[~known], fine[~known])
        return fine[of]

    def learn(self, words: list[str]) -> None:
        """Encode words not met before: propose, test all adjacent pairs, merge the failing words exactly."""
        data = [w.encode("utf-8", "replace") for w in words]
        proposed = [self.greedy(d) for d in data]
        lengths = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((i for p in proposed for i in p), np.int64, int(lengths.sum()))
        ends = np.cumsum(lengths)
        after = np.append(flat[1:], -1)
        after[ends - 1] = -1  # the last token of a word is tested alone
        fails = ~self.compatible(flat, after)
        word_fails = np.add.reduceat(fails, ends - lengths) > 0
        self.speculated += len(words)
        self.merged += int(word_fails.sum())
        for w, d, p, f in zip(words, data, proposed, word_fails.tolist(), strict=True):
            self.known[w] = ",".join(map(str, self.merge(d) if f else p))

    def split(self, text: str) -> list[str]:
        """Words and added tokens in order; an added token comes as itself preceded by a zero character no word has."""
        if self.splitter is None or not any(t in text for t in self.added):
            return self.words.findall(text)
        out = []
        for k, part in enumerate(self.splitter.split(text)):
            out += ["\x00\x00" + part] if k % 2 else self.words.findall(part)
        return out

    def encode_block(self, texts: list[str]) -> list[tuple[int, str]]:
        """Per text: the number of tokens and the ids, decimal, joined by commas."""
        split = [self.split(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = set().union(*split) - self.known.keys()
        for w in [w for w in new if w[:2] == "\x00\x00" and w[2:] in self.added]:
            self.known[w] = str(self.added[w[2:]])
            new.discard(w)
        if new:
            self.learn(list(new))
        out = [",".join(map(self.known.__getitem__, s)) for s in split]
        return [(x.count(",") + 1 if x else 0, x) for x in out]

    def encode(self, text: str) -> list[int]:
        ids = self.encode_block([text])[0][1]
        return [int(i) for i in ids.split(",")] if ids else []

    def decode(self, ids: list[int]) -> str:
        """The tokens' bytes as UTF-8; bytes that are none become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")

    def decode_decimal(self, ids: str) -> str:
        """decode() of ids written decimal and joined by commas."""
        return b"".join(map(self.spelled.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""


@functools.lru_cache(2)
def load(path: str) -> Bpe:
    return Bpe(path)


def encode(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id and ids, the token ids."""
    path = vocabulary or default_vocabulary()
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            for x in u.pieces(b, 256):
                yield u.batch(schema, [x.column(0), [[int(i) for i in s.split(",")] if s else [] for _, s in bpe.encode_block(x.column(1).to_pylist())]])

    return u.id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per document: doc_id and text, the decoded ids (null: none)."""
    path = vocabulary or default_vocabulary()
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            for x in u.pieces(b, 256):
                yield u.batch(schema, [x.column(0), [bpe.decode(i or []) for i in x.column(1).to_pylist()]])

    return encoded.select(encoded[id_col].cast("long").alias("doc_id"), encoded[ids_col].alias("ids")).mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    path = vocabulary or default_vocabulary()
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    sha = lambda s: hashlib.sha256(s).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            for x in u.pieces(b, 256):
                out = bpe.encode_block(x.column(1).to_pylist())
                decoded = [bpe.decode_decimal(s) for _, s in out]
                yield u.batch(schema, [x.column(0), [n for n, _ in out], [sha(s.encode()) for _, s in out], [sha(d.encode()) for d in decoded]])

    return u.id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

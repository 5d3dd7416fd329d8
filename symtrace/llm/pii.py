"""Personal data by patterns and a skip-chain conditional random field.

Patterns find e-mail addresses, IP addresses, card and phone numbers (the base). A field over the tokens that have a
digit or an @ adds spans of these kinds that the patterns miss: neighbouring tokens share a potential, and so do distant
ones that are repeated or similar (equal digits, equal last seven digits, equal letters before an @), which makes labels
agree across a document. Loopy message passing gives each token's marginals; tokens inside a base span are observed.
Tokens with neither digit nor @ are observed as no entity, so a document's graph has its active tokens only; each is
linked with the previous token of its key, so the graph grows in proportion to the text.

The weights are fitted by pseudo-likelihood on the base labels of TRAIN_DOCS different texts at most (a documented
bound), those with the smallest hashes, whatever their ids. Texts with more than TRAIN_TOKENS active tokens aren't among
them. Everything else covers every whole text.

Defined results: null and empty texts have no spans; repeated rows get equal spans and count once in the fit; an empty
table gives an empty result and a field of zero weights, which adds nothing. A span is added where its marginal reaches
ADDED and no base span is touched; of equally likely labels the first in the order of LABELS counts. Rows that share an id
or have none are like others; columns besides the id and the text are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _util as u

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
TRAIN_DOCS, TRAIN_TOKENS = 20_000, 512
ADDED = 0.95
ROUNDS = 12
#: Prior mean of the skip potential of equal labels: samples have few repeated tokens, and repeated ones mostly agree.
AGREE = 2.0
FEATURES = 26

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ACTIVE = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_NO_DIGIT = re.compile(r"[^0-9]+")
_EDGE = ".,;:!?\"'<>[]{}"
_FOUR = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_ADDRESS = re.compile(r"[^@]+@[^@]+\.[^@.]+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def _is_part(digits: str) -> bool:
    """Whether digits, however many zeros lead, are at most 255. int() refuses texts of thousands of digits."""
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping: at each @ the longest run of local characters that no earlier match has taken."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, m.end()))
            free = m.end()
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[Span]:
    """The base in order of kind, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _ACTIVE.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(_is_part(p) for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NO_DIGIT.sub("", m[0])) <= 15]
    return out


class Graph:
    """The active tokens of a text: spans, features, edges and observed labels."""

    def __init__(self, text: str, base: list[Span]):
        tokens = [(m[0], m.start(), m.end()) for m in _TOKEN.finditer(text)] if len(text) < 4096 else self._near(text)
        active = [i for i, t in enumerate(tokens) if _ACTIVE.search(t[0])]
        self.spans = [tokens[i][1:] for i in active]
        self.words = [tokens[i][0] for i in active]
        follows = [i + 1 == j and text[tokens[i][2] : tokens[j][1]] == " " for i, j in zip(active, active[1:], strict=False)]
        self.chain = [(k, k + 1) for k, f in enumerate(follows) if f]
        digits = [_NO_DIGIT.sub("", w) for w in self.words]
        run, start = [0] * len(active), 0
        for k in range(len(active)):
            if k + 1 == len(active) or not follows[k]:
                joined = "".join(digits[start : k + 1])
                for x in range(start, k + 1):
                    run[x] = joined if k > start else ""
                start = k + 1
        self.features = np.zeros((len(active), FEATURES))
        for k, w in enumerate(self.words):
            self._describe(k, w, digits, run[k] or "", follows)
        self.skip = self._similar(digits)
        self.observed = np.full(len(active), -1)
        spans = sorted((a, b, LABELS.index(kind)) for kind, a, b in base)
        at = 0
        for k, (s, e) in enumerate(self.spans):
            while at < len(spans) and max(b for _, b, _ in spans[at : at + 1]) <= s:
                at += 1
            for a, b, label in spans[max(0, at - 4) : at + 4]:
                if a < e and s < b:
                    self.observed[k] = label
                    break

    @staticmethod
    def _near(text: str) -> list[tuple[str, int, int]]:
        """The active tokens and their neighbours only, each once, in order; of a long text the rest isn't tokenised."""
        out, done = [], 0
        space = re.compile(r"[\x20\x09-\x0D]")
        for m in _ACTIVE.finditer(text):
            if m.start() < done:
                continue
            start = m.start()
            while start > done and not space.match(text, start - 1):
                start -= 1
            t = _TOKEN.match(text, start)
            if out and text[out[-1][2] : start].strip(u.SPACE):
                out.append(("", start, start))  # something inactive lies between
            out.append((t[0], start, t.end()))
            done = t.end()
        return out

    def _describe(self, k: int, w: str, digits: list[str], run: str, follows: list[bool]) -> None:
        f, n = self.features[k], len(digits[k])
        core = w.strip(_EDGE + "()")
        letters = any(c.isalpha() for c in w)
        four = _FOUR.fullmatch(core) is not None
        before, after = k > 0 and follows[k - 1], k < len(follows) and follows[k]
        f[0] = 1
        f[1], f[2] = "@" in w, _ADDRESS.fullmatch(core) is not None
        f[3], f[4] = four, four and all(len(p) <= 3 and int(p) <= 255 for p in core.split("."))
        f[5], f[6], f[7] = letters, core.isascii() and core.isdigit(), not letters and n > 0
        f[8], f[9] = w.startswith("+"), "(" in w or ")" in w
        f[10], f[11], f[12], f[13], f[14] = 1 <= n <= 4, 5 <= n <= 8, 9 <= n <= 12, 13 <= n <= 19, n >= 20
        f[15], f[16], f[17] = 13 <= n <= 19 and luhn(digits[k]), "-" in core, "=" in w or '"' in w
        f[18], f[19] = before, after
        f[20] = before and self.words[k - 1].startswith("+")
        f[21] = before and k > 1 and follows[k - 2] and self.words[k - 2].startswith("+")
        f[22], f[23] = 9 <= len(run) <= 15 and not letters, 13 <= len(run) <= 19 and luhn(run) and not letters
        f[24], f[25] = w.count(".") >= 2, letters and n > 0 and "@" not in w

    def _similar(self, digits: list[str]) -> list[tuple[int, int]]:
        """Each token with the last one before that shares a key with it."""
        out, last = set(), {}
        for k, w in enumerate(self.words):
            keys = [("w", w.strip(_EDGE).lower())]
            if len(digits[k]) >= 7:
                keys += [("d", digits[k]), ("e", digits[k][-7:])]
            if "@" in w:
                keys.append(("l", w.strip(_EDGE).split("@")[0].lower()))
            for key in keys:
                if key in last and last[key] != k:
                    out.add((last[key], k))
                last[key] = k
        return sorted(out)


class Field:
    """Weights of the field: unary[label, feature], chain and skip [label, label]."""

    def __init__(self):
        n = len(LABELS)
        self.unary, self.chain, self.skip = np.zeros((n, FEATURES)), np.zeros((n, n)), AGREE * np.eye(n)

    def fit(self, samples: list[tuple[np.ndarray, np.ndarray, list, list]], rounds: int = 300, rate: float = 0.5, decay: float = 1e-3) -> Field:
        """Pseudo-likelihood: each label given its neighbours' labels; gradient steps with running scales (Adam)."""
        if not samples:
            self.skip[:] = 0
            return self
        offsets = np.cumsum([0, *(len(s[1]) for s in samples)])
        x, y = np.concatenate([s[0] for s in samples]), np.concatenate([s[1] for s in samples])
        n, one = len(y), np.eye(len(LABELS))[y]
        joined = lambda which: np.concatenate([np.array(s[which], int).reshape(-1, 2) + o for s, o in zip(samples, offsets[:-1], strict=True)])
        chain, skip = joined(2), joined(3)
        before, after, alike = (np.zeros_like(one) for _ in range(3))
        before[chain[:, 1]] = one[chain[:, 0]]
        after[chain[:, 0]] = one[chain[:, 1]]
        np.add.at(alike, skip[:, 0], one[skip[:, 1]])
        np.add.at(alike, skip[:, 1], one[skip[:, 0]])
        params = [self.unary, self.chain, self.skip]
        prior = [p.copy() for p in params]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, rounds + 1):
            z = x @ self.unary.T + before @ self.chain + after @ self.chain.T + alike @ self.skip
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            d = one - p / p.sum(1, keepdims=True)
            s = alike.T @ d
            grads = [d.T @ x, before.T @ d + d.T @ after, (s + s.T) / 2]
            for k, (w, g) in enumerate(zip(params, grads, strict=True)):
                g = g / n - decay * (w - prior[k])
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
                w += rate * 0.1 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def marginals(self, g: Graph) -> np.ndarray:
        """Loopy sum-product over chain and skip edges, damped; observed tokens are clamped."""
        n, labels = len(g.observed), len(LABELS)
        unary = g.features @ self.unary.T
        seen = g.observed >= 0
        unary[seen] = -1e4
        unary[seen, g.observed[seen]] = 0
        edges = np.array(g.chain + g.skip, int).reshape(-1, 2)
        if len(edges):
            pair = np.concatenate([np.repeat(self.chain[None], len(g.chain), 0), np.repeat(self.skip[None], len(g.skip), 0)])
            source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
            pair = np.concatenate([pair, pair.transpose(0, 2, 1)])
            back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
            messages = np.zeros((2 * len(edges), labels))
            for _ in range(ROUNDS):
                belief = unary.copy()
                np.add.at(belief, target, messages)
                z = (belief[source] - messages[back])[:, :, None] + pair
                top = z.max(1, keepdims=True)
                new = np.log(np.exp(z - top).sum(1)) + top[:, 0]
                messages = 0.3 * messages + 0.7 * (new - new.max(1, keepdims=True))
            np.add.at(unary, target, messages)
        p = np.exp(unary - unary.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def added_spans(text: str, base: list[Span], field: Field) -> list[Span]:
    """What the field finds beside the base; neighbouring tokens of one kind are one span."""
    if not _ACTIVE.search(text):
        return []
    g = Graph(text, base)
    if not len(g.observed) or (g.observed >= 0).all():
        return []
    p = field.marginals(g)
    label = np.where((p.max(1) >= ADDED) & (g.observed < 0), p.argmax(1), 0)
    out: list[Span] = []
    linked = set(g.chain)
    for k in np.flatnonzero(label).tolist():
        kind, (s, e), w = LABELS[label[k]], g.spans[k], g.words[k]
        s, e = s + len(w) - len(w.lstrip(_EDGE)), e - len(w) + len(w.rstrip(_EDGE))
        if s >= e:
            continue
        if out and out[-1][0] == kind and (k - 1, k) in linked and label[k - 1] == label[k]:
            out[-1] = (kind, out[-1][1], e)
        else:
            out.append((kind, s, e))
    return [x for x in out if not any(a < x[2] and x[1] < b for _, a, b in base)]


def _order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Field:
    """Fit the field on train_docs different texts of docs (doc_id, text) at most; only features come to the driver."""
    schema = pa.schema([("h", pa.int64()), ("n", pa.int32()), ("x", pa.binary()), ("y", pa.binary()), ("chain", pa.binary()), ("skip", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for h, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if _ACTIVE.search(text):
                    g = Graph(text, base_spans(text))
                    if len(g.observed) <= TRAIN_TOKENS:
                        y = np.maximum(g.observed, 0).astype(np.int8)
                        rows.append((h, len(y), g.features.astype(np.int8).tobytes(), y.tobytes(), np.array(g.chain, np.int32).tobytes(), np.array(g.skip, np.int32).tobytes()))
            if rows:
                yield u.batch(schema, list(zip(*rows, strict=True)))

    sample = u.hash_sample(docs.where("text <> ''").select(F.xxhash64("text").alias("h"), "text"), train_docs)
    sample = sample.mapInArrow(run, "h long, n int, x binary, y binary, chain binary, skip binary").orderBy("h").limit(train_docs).drop("h")
    pairs = lambda data: np.frombuffer(data, np.int32).reshape(-1, 2)
    rows = sorted(sample.collect(), key=tuple)  # the order must not depend on partitions
    return Field().fit([(np.frombuffer(r["x"], np.int8).reshape(r["n"], FEATURES).astype(float), np.frombuffer(r["y"], np.int8).astype(int), pairs(r["chain"]), pairs(r["skip"])) for r in rows])


def find(docs: DataFrame, field: Field | None = None, train_docs: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_<kind> (base spans), base_sha256, spans (base and added), n_added."""
    cols = u.id_text(docs, id_col, text_col)
    field = field or train(cols, train_docs)
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in u.pieces(b):
                rows = []
                for text in x.column(1).to_pylist():
                    base = base_spans(text)
                    more = added_spans(text, base, field)
                    rows.append((*(sum(s[0] == k for s in base) for k in KINDS), hashlib.sha256(written(base).encode()).hexdigest(), written(_order(base + more)), len(more)))
                yield u.batch(schema, [x.column(0), *zip(*rows, strict=True)])

    return cols.mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long")


def mask(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; spans that overlap become one, named by the first."""
    out, at = [], 0
    merged: list[list] = []
    for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([k, a, b])
    for k, a, b in merged:
        out += [text[at:a], f"[{k}]"]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, field: Field | None = None, train_docs: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with all spans of the text masked; a null text stays null. One pass, no shuffle."""
    field = field or train(u.id_text(docs, id_col, text_col), train_docs)
    at, columns = docs.columns.index(text_col), docs.columns

    def masked(text: str | None) -> str | None:
        if not text or not _ACTIVE.search(text):
            return text
        base = base_spans(text)
        spans = base + added_spans(text, base, field)
        return mask(text, spans) if spans else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in u.pieces(b):
                cols = list(x.columns)
                cols[at] = pa.array([masked(t) for t in cols[at].to_pylist()], type=cols[at].type)
                yield pa.RecordBatch.from_arrays(cols, names=columns)

    return docs.mapInArrow(run, docs.schema)

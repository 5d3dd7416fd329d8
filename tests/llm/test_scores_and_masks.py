"""The language model's score and the masking of texts, held against plain versions."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from symtrace.llm import lm, pii

from .test_corpus_operators import ODD, frame


def plain_scores(rows, seeds):
    """The log10 probability of each text, token by token, from dictionaries. The exchange of the most frequent words and the
    gain by which others enter a class have tests of their own."""
    token_lists = [[*(text or "").encode().lower().split(), b""] for _, text in rows]
    learn = [zlib.crc32(b"" if i is None else str(i).encode()) % 10 != 0 for i, _ in rows]
    pairs = Counter(p for t, use in zip(token_lists, learn, strict=True) if use for p in zip([b"", *t], t, strict=False))
    count = Counter(w for t, use in zip(token_lists, learn, strict=True) if use for w in t)
    top = sorted((w for w in count if w), key=lambda w: (-count[w], w))[:seeds]
    number = {b"": 0} | {w: k + 2 for k, w in enumerate(top)}
    matrix = np.zeros((len(top) + 2, len(top) + 2))
    for (a, b), n in pairs.items():
        matrix[number.get(a, 1), number.get(b, 1)] += n
    exchanged = lm.exchange(matrix, 2, lm.CLASSES)
    seed = {b"": 0} | {w: int(exchanged[number[w]]) - 1 for w in top}
    joint, around = np.zeros((lm.N, lm.N)), defaultdict(Counter)
    for (a, b), n in pairs.items():
        if a in seed and b in seed:
            joint[seed[a], seed[b]] += n
        if a not in seed and b in seed:
            around[a][seed[b]] += n
        if b not in seed and a in seed:
            around[b][lm.N + seed[a]] += n
    cls = dict(seed)
    for w in count:
        if w not in seed:
            ctx = sorted(around[w])
            cls[w] = int(lm.place(np.array([0]), np.array(ctx), np.array([around[w][x] for x in ctx]), joint)[0]) if ctx else lm.REST
    total, size, follow, leave, single = sum(count.values()), Counter(), Counter(), Counter(), Counter()
    for w, n in count.items():
        size[cls[w]] += n
    for (a, b), n in pairs.items():
        follow[cls[a], cls[b]] += n
        leave[cls[a]] += n
        single[cls[a]] += n * (count[b] == 1)
    rate = min(0.5, (sum(n == 1 for n in count.values()) + 0.5) / (total + 1))

    def probability(before, w):
        a = cls.get(before, "unseen")
        unseen = (single[a] + 20 * rate) / (leave[a] + 20)
        if w not in count:
            return unseen
        c = cls[w]
        transition = (follow[a, c] + 10 * size[c] / total) / (leave[a] + 10)
        return (1 - unseen) * ((1 - lm.MIX) * transition * count[w] / size[c] + lm.MIX * count[w] / total)

    return [sum(math.log10(probability(a, w)) for a, w in zip([b"", *t], t, strict=False)) for t in token_lists]


@pytest.mark.parametrize("seeds", [12, 1000])
def test_score_is_the_plain_sum(spark, seeds):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(150)] + ["Straße", "x y", "Ünder"]
    weights = [1 / (k + 1) for k in range(len(words))]
    rows = [(5000 + k, " ".join(rng.choices(words, weights, k=rng.randint(1, 40)))) for k in range(160)]
    rows += ODD + rows[:7] + [(9000 + k, f"only{k} w1 W2\nlonely{k} lonely{k + 1}") for k in range(30)]
    got = lm.score(frame(spark, rows), seeds=seeds).collect()
    want = sorted((str(i), len((t or "").encode().split()), s) for (i, t), s in zip(rows, plain_scores(rows, seeds), strict=True))
    found = sorted((str(r.doc_id), r.n_tokens - 1, r.score) for r in got)
    assert len(found) == len(want)
    for g, w in zip(found, want, strict=True):
        assert g[:2] == w[:2] and g[2] == pytest.approx(w[2], rel=1e-9)


def plain_mask(text, spans):
    """Spans that share a character are joined, one after the other, until none do."""
    groups = [(a, b, [(a, pii.KINDS.index(k), k)]) for k, a, b in spans]
    while True:
        hit = next(((x, y) for x in groups for y in groups if x is not y and x[0] < y[1] and y[0] < x[1]), None)
        if hit is None:
            break
        x, y = hit
        groups = [g for g in groups if g is not x and g is not y] + [(min(x[0], y[0]), max(x[1], y[1]), x[2] + y[2])]
    for a, b, names in sorted(groups, reverse=True):
        text = text[:a] + f"[{min(names)[2]}]" + text[b:]
    return text


def test_masked_texts_are_the_plain_ones(spark):
    mail, card, phone = "ann.lee@mail.example.org", "4539 1488 0343 6467", "+49 (30) 1234-5678"
    texts = [None, "", "nothing here", f"{mail}{mail}", f"a {card} b 10.2.3.4 c {phone}\n{mail}", f"é{phone}é 1.2.3.4.5.6.7.8 {card}1", f"{phone} {card} " * 50]
    docs = frame(spark, [*enumerate(texts), *((100 + r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect())])
    field = pii.train(docs.select("doc_id", "text"))
    spans = {r.doc_id: [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)] for r in pii.find(docs, field).collect()}
    masked = {r.doc_id: r.text for r in pii.redact(docs, field).collect()}
    changed = 0
    for r in docs.collect():
        assert masked[r.doc_id] == (None if r.text is None else plain_mask(r.text, spans[r.doc_id]))
        changed += masked[r.doc_id] != r.text
    assert changed > 5
    assert plain_mask("abcdef", [("ip", 1, 4), ("email", 3, 5)]) == pii.mask("abcdef", [("ip", 1, 4), ("email", 3, 5)]) == "a[ip]f"

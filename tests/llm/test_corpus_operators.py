"""Near duplicates, packing, resharding, language model, neighbours and the pipeline: against brute force."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from symtrace.llm import _util, aq, components, lm, minhash, packing, pii, quality, reshard

from .test_text_operators import ODD, frame, plain_lines, plain_spans

SF = "/root/testdata/sf0.001"


def copies(seed=1):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows = list(ODD)
    for g in range(12):
        base = rng.choices(words, k=rng.choice([3, 6, 40, 120]))
        for _ in range(rng.randrange(1, 14)):
            text = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 12) + 1)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((1000 + len(rows), " ".join(text).upper() if rng.random() < 0.3 else " ".join(text)))
    return rows


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, k):
    rows = copies(k)
    got = minhash.near_digest(frame(spark, rows), k=k).collect()
    want = minhash.brute_force([r for r in rows if r[0] is not None], k)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
            assert r.n_shingles == len(minhash.shingles(minhash.tokens(next(t for i, t in rows if i == r.doc_id) or ""), k))
    docs = frame(spark, rows)
    kept = minhash.drop_near_duplicates(docs, k=k)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted({i for i, c in want.items() if i == c})
    assert minhash.near_digest(frame(spark, []), k=k).count() == 0


def test_group_of_near_copies_makes_few_pairs(spark):
    """A group that is connected only by chains: every link counts, whatever the smallest id of a bucket is."""
    rng = random.Random(9)
    base = [f"v{k}" for k in range(150)]
    rows = []
    for k in range(160):
        text = list(base)
        for p in rng.sample(range(150), rng.randrange(0, 22)):
            text[p] = f"v{rng.randrange(400)}"
        rows.append((k, " ".join(text)))
    got = {r.doc_id: r.component_id for r in minhash.near_digest(frame(spark, rows), k=2).collect()}
    assert got == minhash.brute_force(rows, 2)


def test_sketch_fills_every_coordinate_and_estimates():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 2, 7, 300, 2000)]
    s = minhash.sketch(sets, 96)
    assert not (s == np.uint64(0xFFFFFFFFFFFFFFFF)).any()
    a, b = sets[4], np.concatenate([sets[4][:1800], sets[3]])
    sa, sb = minhash.sketch([a, b], 2048)
    assert abs((sa == sb).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.05


def test_components(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(7, k) for k in range(8, 60)] + [(3, 3), (500, 200)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got[140] == 100 and got[59] == 7 and got[500] == 200 and got[200] == 200 and 3 not in got


def test_packing(spark):
    rng = random.Random(3)
    rows = ODD + [(100 + k, "w " * rng.choice([1, 30, 500, 600, 2000, 9000])) for k in range(80)]
    got = packing.pack_documents(frame(spark, rows), group_tokens=60_000).collect()
    per_doc, bins = Counter(), {}
    for r in got:
        per_doc[r.doc_id, r.start] += r.n_tokens
        bins.setdefault(r.bin_id, []).append(r)
    total = sum(len((t or "").encode().split()) + 1 for _, t in rows)
    assert sum(r.n_tokens for r in got) == total
    for b in bins.values():
        used = sum(r.n_tokens for r in b)
        assert b[0].capacity == min(c for c in packing.CAPACITIES if c >= used) and b[0].bin_tokens == used
        at = 0
        for r in sorted(b, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.n_tokens
    assert packing.pack_documents(frame(spark, [])).count() == 0


def test_best_fit_is_best_fit():
    rng = random.Random(5)
    lengths = sorted((rng.randrange(1, 101) for _ in range(200)), reverse=True)
    bins, _, filled = packing.best_fit(lengths, 100, lambda n, left: 100)
    room: list[int] = []
    for n, b in zip(lengths, bins, strict=True):
        fits = [r for r in room if r >= n]
        if fits:
            assert room[b] == min(fits)
            room[b] -= n
        else:
            assert b == len(room)
            room.append(100 - n)
    assert [100 - r for r in room] == filled
    cost = lambda sizes: sum(map(packing.bin_cost, sizes))
    joint = packing.pack(lengths, [25, 50, 100])[2]
    assert cost(joint) <= cost([100] * len(filled))


def test_min_cost_flow_moves_the_fewest():
    rng = random.Random(1)
    for _ in range(50):
        n, m = rng.randrange(1, 6), rng.randrange(1, 7)
        supply = [rng.randrange(0, 50) for _ in range(n)]
        capacity = reshard.equal_capacities(sum(supply), m)
        flow = reshard.min_cost_flow(supply, capacity, lambda i, j: int(i != j))
        assert [sum(f for (i, _), f in flow.items() if i == a) for a in range(n)] == supply
        assert [sum(f for (_, j), f in flow.items() if j == a) for a in range(m)] == capacity
        stay = sum(min(s, c) for s, c in zip(supply, capacity, strict=False))
        assert sum(f for (i, j), f in flow.items() if i != j) == sum(supply) - stay


def test_reshard(spark, tmp_path):
    rng = random.Random(8)
    rows = [(k, "x" * rng.randrange(0, 400) if k % 9 else None) for k in range(900)] + [(5, "tie"), (5, "tie"), (None, "no id")]
    docs = frame(spark, rows)
    got = reshard.plan(docs).collect()
    assert len(got) == len(rows)
    sizes, slots = Counter(), {}
    for r in got:
        sizes[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    mean = sum(sizes.values()) / reshard.NEW_SHARDS
    assert set(sizes) == set(range(reshard.NEW_SHARDS)) and all(abs(s - mean) < 0.05 * mean + 400 for s in sizes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    text = {i: t for i, t in rows if i != 5}
    assert all(r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) and r.size == len(text[r.doc_id] or "") + 1 for r in got if r.doc_id in text)
    planned = reshard.plan(docs)
    touched = reshard.rewrite(docs, planned, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len([r for r in got if r.shard in touched]) and set(docs.columns) < set(back.columns)
    assert reshard.plan(frame(spark, [])).count() == 0


def plain_base(rows):
    tokens = lambda t: (t or "").encode().lower().split() + [b""]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return [(i, held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))) for i, t in rows]


def test_language_model(spark):
    rng = random.Random(6)
    vocabularies = [[f"{x}{k}" for k in range(80)] for x in "abc"]
    rows = ODD + [(100 + k, " ".join(rng.choices(vocabularies[k % 3], k=60))) for k in range(300)]
    got = sorted(lm.score(frame(spark, rows), seeds=100).collect(), key=lambda r: (str(r.doc_id), r.n_tokens))
    want = sorted(plain_base(rows), key=lambda r: (str(r[0]), r[2]))
    for r, w in zip(got, want, strict=True):
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:5]
        assert r.base_score == pytest.approx(w[5], rel=1e-9) and r.score < 0
    p = lm.perplexity(spark.createDataFrame(got))
    assert p["model"] < 0.6 * p["base"]  # words follow words of their own vocabulary
    assert lm.score(frame(spark, [])).count() == 0
    assert lm.score(frame(spark, [(10, "a b")])).count() == 1


def test_model_probabilities_add_up():
    joint = np.random.default_rng(0).integers(0, 50, (6, 6)).astype(float)
    follow, unseen = lm._transitions(joint, joint // 5, joint.sum(0), 30, joint.sum())
    assert np.allclose(follow.sum(1), 1) and ((unseen > 0) & (unseen < 1)).all()


def test_exchange_never_lowers_the_likelihood():
    counts = np.random.default_rng(4).poisson(3, (30, 30)).astype(float)

    def likelihood(of):
        member = np.eye(max(of) + 1)[of]
        joint = member.T @ counts @ member
        xlog = lambda a: float((a * np.log(np.maximum(a, 1e-300))).sum())
        return xlog(joint) - xlog(joint.sum(0)) - xlog(joint.sum(1))

    steps = [likelihood(lm.exchange(counts, 2, 4, sweeps)) for sweeps in range(6)]
    assert steps == sorted(steps) and steps[-1] > steps[0]


def test_exchange_finds_classes():
    rng = np.random.default_rng(1)
    counts = np.zeros((22, 22))
    for a in range(2, 22):  # even words are followed by odd ones and the other way round
        for b in range(2, 22):
            counts[a, b] = rng.poisson(20 if a % 2 != b % 2 else 1)
    of = lm.exchange(counts, 2, 2)
    assert len(set(of[2::2])) == len(set(of[3::2])) == 1 and of[2] != of[3]


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 24))
    x[300:420] = x[7]
    rows = [(k, [float(v) for v in x[k]]) for k in range(1500)]
    bad = [(9000, None), (9001, [0.0] * 24), (9002, [float("nan")] * 24), (9003, [None] * 24), (9100, [1.0, 2.0]), (None, [1.0] * 24), (9004, [float("inf")] * 24), (9005, [])]
    vectors = spark.createDataFrame([(*r, "z") for r in rows + bad], "vec_id long, embedding array<double>, RANK string")
    got = aq.search(vectors, F.col("vec_id") % 100 == 0).collect()
    want = aq.brute_force(np.arange(1500), x, np.arange(1500) % 100 == 0)
    found = {}
    for r in got:
        found.setdefault(r.query_id, {})[r.rank] = (r.score, r.vec_id)
    assert set(found) == set(want)
    hits = 0
    for q, answers in want.items():
        mine = [found[q][k] for k in range(1, 11)]
        assert mine == sorted(mine) and all(abs(s - np.linalg.norm(x[q] - x[i])) < 1e-12 for s, i in mine)
        hits += len({i for _, i in mine} & {i for _, i in answers})
    assert hits >= 0.9 * 10 * len(want)
    assert [i for _, i in sorted(found[300].values())] == [7, *range(301, 310)]
    few = aq.search(vectors.where("vec_id in (0, 1, 2)"), F.col("vec_id") % 100 == 0).collect()
    assert [(r.query_id, r.rank) for r in few] == [(0, 1), (0, 2)]
    assert aq.search(vectors.where("false"), F.col("vec_id") % 100 == 0).count() == 0


def test_neighbours_of_rows_that_codes_fit_badly(spark):
    """Far from the origin, norms of all sizes, more dimensions than codes can hold, far clusters, many ties, a huge row."""
    rng = np.random.default_rng(8)
    n = 3000
    kinds = {
        "offset": rng.normal(size=(n, 16)) + 1e5,
        "norms": rng.normal(size=(n, 32)) * np.exp(3 * rng.normal(size=(n, 1))),
        "wide": rng.normal(size=(n, 256)),
        "clusters": rng.normal(size=(9, 24))[rng.integers(0, 9, n)] * 1e4 + rng.normal(size=(n, 24)),
        "ties": np.concatenate([np.eye(1, 9) + 1.0, rng.integers(0, 3, size=(n - 1, 9)) * 1.0]) + np.eye(9)[8],
        "huge": np.concatenate([rng.normal(size=(n - 1, 8)), np.full((1, 8), 1e180)]),
    }
    for name, x in kinds.items():
        vectors = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "vec_id long, embedding array<double>")
        found = {}
        for r in aq.search(vectors, F.col("vec_id") % 100 == 0, train_rows=512).orderBy("query_id", "rank").collect():
            found.setdefault(r.query_id, []).append((r.score, r.vec_id))
        with np.errstate(over="ignore"):
            want = aq.brute_force(np.arange(n), x, np.arange(n) % 100 == 0)
        assert {q: [i for _, i in v] for q, v in found.items()} == {q: [i for _, i in v] for q, v in want.items()}, name


def test_beam_beats_greedy():
    x = np.random.default_rng(5).normal(size=(400, 16))
    books = aq.train(x, 4, 16, 1)
    error = lambda beam: np.sum((x - aq.decode(aq.encode(x, books, beam), books)) ** 2)
    assert error(8) < error(1)


def test_pipeline_against_plain_stages(spark):
    import corpus_pipeline

    docs = _util.read(spark, SF, "documents")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    rows = [(i, t) for i, t in rows if not _failed(t)]
    out = corpus_pipeline.quality_rules(spark, docs, SF)
    assert sorted((r.doc_id, r.text) for r in out.collect()) == rows
    rows = [(i, t) for i, _, gone, t in plain_lines(rows) if not gone or t.split()]
    out = corpus_pipeline.line_dedup(spark, _util.materialise(out, "t"), SF)
    assert sorted((r.doc_id, r.text) for r in out.collect()) == rows
    component = minhash.brute_force(rows, 5)
    rows = [(i, t) for i, t in rows if component[i] == i]
    out = corpus_pipeline.near_dedup(spark, _util.materialise(out, "t"), SF)
    assert sorted((r.doc_id, r.text) for r in out.collect()) == rows
    out = _util.materialise(corpus_pipeline.mask_personal_data(spark, _util.materialise(out, "t"), SF), "t")
    assert out.columns == docs.columns
    masked = sorted((r.doc_id, r.text) for r in out.collect())
    for (i, t), (j, m) in zip(rows, masked, strict=True):
        base = plain_spans(t)
        assert i == j and (m == t if not pii._ACTIVE.search(t) else True)
        assert not base or m != t
    packed = corpus_pipeline.pack_sequences(spark, out, SF)
    tokens = Counter()
    for r in packed.collect():
        tokens[r.doc_id] += r.n_tokens
    assert tokens == Counter({i: len(t.encode().split()) + 1 for i, t in masked})
    assert corpus_pipeline.run(spark, SF).count() == packed.count()


def _failed(text):
    values = dict(zip(quality.MEASURES, quality.measure(text or ""), strict=True))
    return any(eval(fails, {}, values) for bit, fails in quality.RULES.values() if bit & quality.POLICIES[quality.DEFAULT_POLICY])

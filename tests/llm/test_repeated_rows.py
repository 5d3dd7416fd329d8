"""Repeated rows, hot groups, odd ids and texts, clashing names: whole results, spread over tasks."""

from __future__ import annotations

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from symtrace.llm import _util, aq, bpe, linededup, lm, minhash, packing, pii, quality, reshard

from .test_text_operators import ODD, frame, plain_spans


def test_near_duplicates_by_few_rare_shingles(spark):
    """One passage in over 64 classes of spread sizes; pairs of 87 common shingles, 10 of their own and 3 rare ones that
    both have: 90 of 110. The passage alone would do with the smaller classes of the bucket, not with each other."""
    rng, passage = random.Random(5), [f"c{i}" for i in range(87)]
    rows = [(i, " ".join(rng.sample(passage, 74) + [f"f{i}x{j}" for j in range(rng.randrange(12, 22))])) for i in range(300)]
    for i in range(300, 320):
        rows.append((i, " ".join(passage + [f"r{i // 2}x{j}" for j in range(3)] + [f"o{i}x{j}" for j in range(10)])))
    want = minhash.brute_force(rows, 1)
    assert all(want[i] == i - i % 2 for i in range(300, 320))
    got = {r.doc_id: r.component_id for r in minhash.near_digest(spark.createDataFrame(rows, "doc_id long, text string"), k=1).collect()}
    assert got == want


def test_equal_blocks_all_count(spark):
    """The same rows in two partitions are two equal blocks: scores are those of one partition that holds them twice."""
    rows = [(i, f"a b{i % 7} c d{i % 5} e{i % 3}") for i in range(40)]
    twice = lambda parts: spark.createDataFrame(spark.sparkContext.parallelize(rows + rows, parts), "doc_id long, text string")
    score = lambda docs: {(r.doc_id, round(r.score, 9), r.train_tokens) for r in lm.score(docs, seeds=6).collect()}
    assert score(twice(2)) == score(twice(1))


def test_words_enter_by_the_gain_of_the_likelihood():
    """The class that `place` finds is the one with which the likelihood of class bigrams is greatest, by brute force."""
    rng = np.random.default_rng(8)
    joint = np.zeros((lm.N, lm.N))
    joint[: lm.REST, : lm.REST] = rng.poisson(2, (lm.REST, lm.REST))
    xlog = lambda a: float((a * np.log(np.maximum(a, 1e-300))).sum())

    def likelihood(j):
        return xlog(j) - xlog(j.sum(0)) - xlog(j.sum(1))

    for _ in range(20):
        ctx = np.sort(rng.choice([*range(lm.REST), *range(lm.N, lm.N + lm.REST)], rng.integers(1, 12), replace=False))
        n = rng.integers(1, 30, len(ctx))
        gains = []
        for a in range(1, lm.REST):
            j = joint.copy()
            for k, m in zip(ctx, n, strict=True):
                if k < lm.N:
                    j[a, k] += m
                else:
                    j[k - lm.N, a] += m
            own = sum(m for k, m in zip(ctx, n, strict=True) if k % lm.N == a)
            gains.append((likelihood(j), own))
        got = int(lm.place(np.array([0]), ctx, n, joint)[0])
        # Contexts of the neighbours' own totals are the same for every class, so only the order counts.
        want = int(np.argmax([g for g, _ in gains])) + 1
        assert gains[got - 1][0] >= gains[want - 1][0] - 1e-6 or any(o for _, o in gains)


def test_scores_depend_on_rows_alone(spark):
    """However rows lie in partitions, scores are the same, and held-out texts gain by their words' classes."""
    rng = random.Random(13)
    rows = [(k, " ".join(rng.choices([f"a{j}" for j in range(9)] + [f"b{j}" for j in range(40)], k=30))) for k in range(120)]
    got = {r.doc_id: r for r in lm.score(frame(spark, rows), seeds=5).collect()}
    same = {r.doc_id: r for r in lm.score(frame(spark, rows).repartition(7), seeds=5).collect()}
    assert all(abs(got[k].score - same[k].score) < 1e-9 for k in got)
    assert all(r.score < 0 and r.n_tokens == 31 for r in got.values())
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) * 1.2


LONG_PART = "x " + "0" * 5000 + ".1.1.1 and " + "7" * 6000 + ".1.1.1"


def test_address_parts_of_thousands_of_digits(spark):
    assert pii.base_spans(LONG_PART)[0] == ("ip", 2, 5008) and len(pii.base_spans(LONG_PART)) == 1
    docs = frame(spark, [(1, LONG_PART), (2, "mail a@b.co")])
    assert {r.doc_id: r.n_ip for r in pii.find(docs).collect()} == {1: 1, 2: 0}
    assert "[ip]" in pii.redact(docs).where("doc_id = 1").first().text


@pytest.mark.parametrize("ids", [None, 7])
def test_samples_do_not_depend_on_ids(spark, ids):
    """All rows with one id, or with none: the samples are bounded and not empty."""
    rows = [(ids, f"call +1 (988) 555-{k:04d} or user{k}@mail.example.com") for k in range(400)]
    field = pii.train(frame(spark, rows).select("doc_id", "text"), 50)
    assert np.abs(field.unary).sum() > 0
    sample = _util.hash_sample(frame(spark, rows + rows).select(F.xxhash64("text").alias("h"), "text"), 50)
    assert 0 < sample.count() < 100
    x = np.random.default_rng(2).normal(size=(300, 8))
    vectors = spark.createDataFrame([(ids, [float(v) for v in r]) for r in x], "vec_id long, embedding array<double>")
    assert aq.search(vectors, F.col("vec_id") % 7 == 0, train_rows=64).count() == 0  # an id's rows are not its neighbours


def test_long_and_short_texts_give_the_same_graph():
    rng = random.Random(7)
    parts = ["+1", "555-2485", "(988)", "a@b.co", "word", "10.0.0.1", "4111111111111111", "x7", "\n", "\t", "  ", "é", "no", "."]
    for _ in range(400):
        text = " ".join(rng.choices(parts, k=rng.randrange(1, 25)))
        base = pii.base_spans(text)
        one, graph = pii.Graph(text, base), object.__new__(pii.Graph)
        near = pii.Graph._near(text)
        assert [t for t in near if pii._ACTIVE.search(t[0])] == list(zip(one.words, *zip(*one.spans, strict=True), strict=True)) if one.words else not near
        padded = pii.Graph(text + " " + "y" * 5000, base)
        assert padded.spans == one.spans and padded.chain == one.chain and padded.skip == one.skip
        assert (padded.observed == one.observed).all() and (padded.features == one.features).all()
        assert graph is not one


def test_marginals_are_exact_on_chains():
    """On a graph without loops message passing is exact: held against the sum over all labellings."""
    rng = np.random.default_rng(3)
    field = pii.Field()
    n = len(pii.LABELS)
    field.unary, field.chain, field.skip = rng.normal(size=field.unary.shape), rng.normal(size=(n, n)), rng.normal(size=(n, n))
    field.skip = field.skip + field.skip.T
    for text in ("12 34x 56-7", "1.2.3.4 99 a@b", "77 word 5 6", "9 word 8 word 9"):
        g = pii.Graph(text, pii.base_spans(text))
        unary = g.features @ field.unary.T
        want = np.zeros((len(g.observed), n))
        for labels in itertools.product(range(n), repeat=len(g.observed)):
            if any(o >= 0 and o != x for o, x in zip(g.observed, labels, strict=True)):
                continue
            e = sum(unary[k, x] for k, x in enumerate(labels) if g.observed[k] < 0)
            e += sum(field.chain[labels[a], labels[b]] for a, b in g.chain) + sum(field.skip[labels[a], labels[b]] for a, b in g.skip)
            for k, x in enumerate(labels):
                want[k, x] += np.exp(e)
        want /= want.sum(1, keepdims=True)
        assert np.abs(field.marginals(g) - want).max() < 1e-3


def test_repeated_query_rows(spark):
    x = np.random.default_rng(1).normal(size=(150, 8))
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)]
    cols = "vec_id long, embedding array<double>"
    search = lambda r: aq.search(spark.createDataFrame(r, cols), F.col("vec_id") % 100 == 0).collect()
    plain = sorted(map(tuple, search(rows)))
    assert len(plain) == 20 and sorted(map(tuple, search([*rows, rows[100]]))) == plain
    # One id, two vectors: each is a query of its own, and the id is no candidate for either.
    other = (100, [float(v) for v in -x[100]])
    got = Counter(r.query_id for r in search([*rows, other]))
    assert got == {0: 10, 100: 20}
    assert all(r.vec_id != 100 for r in search([*rows, other]) if r.query_id == 100)
    # A repeated candidate is two candidates; an id with many equal rows doesn't crowd out the others.
    near = (5, [float(v) for v in x[0]])
    twice = [r for r in search([*rows, near, near]) if r.query_id == 0]
    assert [(r.rank, r.vec_id, r.score) for r in twice if r.score == 0] == [(1, 5, 0.0), (2, 5, 0.0)] and len(twice) == 10
    assert len([r for r in search([*rows, *[rows[0]] * 40]) if r.query_id == 0]) == 10


def test_repeated_rows_are_resharded_near_equal(spark):
    rows = [(1, "z" * 50)] * 2000 + [(k, "y" * (k % 40)) for k in range(2, 200)]
    measured = _util.materialise(reshard.measured(frame(spark, rows), reshard.old_shard()), "m")
    total = sum(r.size for r in measured.collect())
    for window in (reshard.WINDOW_ROWS, 10):
        sizes = Counter()
        for r in reshard.assign(measured, reshard.OLD_SHARDS, reshard.equal_capacities(total, 16), window).collect():
            sizes[r.shard] += r.size
        assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 2 * 51, window
    planned = reshard.assign(measured, reshard.OLD_SHARDS, reshard.equal_capacities(total, 16))
    slots = {}
    for r in reshard.slots(planned, len(rows), 16, slot_rows=2).collect():
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_resharded_slots_use_many_windows(spark):
    rows = spark.range(5000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    planned = reshard.plan(rows).collect()
    assert Counter(Counter(r.shard for r in planned).values()) == {313: 8, 312: 8}


def test_rewrite_keeps_clashing_columns(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"t{k}", k, k, "s", k * 1.5) for k in range(60)], "doc_id long, text string, shard long, crc int, size string, __doc double")
    planned = reshard.plan(docs)
    touched = reshard.rewrite(docs, planned, str(tmp_path / "o"))
    back = spark.read.parquet(str(tmp_path / "o"))
    want = {r.doc_id for r in planned.collect() if r.shard in touched}
    assert set(docs.columns) < set(back.columns) and {r.doc_id for r in back.collect()} == want
    clash = docs.withColumnsRenamed({"crc": "__row", "size": "gone", "shard": "m_n_words"}).withColumn("failed", F.lit(1))
    for out in (linededup.drop_lines(clash), minhash.drop_near_duplicates(clash), pii.redact(clash), quality.keep(clash, 0)):
        assert out.columns == clash.columns and out.count() == 60


def test_one_row_many_times_is_packed_by_many_tasks(spark):
    rows = spark.range(20_000).select(F.lit(3).cast("long").alias("doc_id"), F.lit("a b c").alias("text")).unionByName(spark.range(100).select("id", F.lit("w " * 50).alias("text")).toDF("doc_id", "text"))
    out = packing.pack_documents(rows, group_tokens=4096)
    assert out.select(F.shiftright("bin_id", 32).alias("g")).distinct().count() > 10
    got = out.groupBy("bin_id", "capacity", "bin_tokens").agg(F.sum("n_tokens").alias("n"), F.max(F.col("bin_offset") + F.col("n_tokens")).alias("end")).collect()
    assert sum(r.n for r in got) == 80_000 + 5100 and all(r.n == r.bin_tokens == r.end <= r.capacity for r in got)


def test_packing_against_all_partitions():
    """The plan of small groups against the cheapest partition into bins there is, and against single sizes."""
    rng = random.Random(11)
    cost = lambda c: c + 3 + c * c / 20
    sizes = (4, 8, 16)
    least = lambda n: next((c for c in sizes if c >= n), None)

    def cheapest(pieces):
        if not pieces:
            return 0.0
        first, rest, best = pieces[0], pieces[1:], float("inf")
        for mask in range(1 << len(rest)):
            inside = first + sum(x for k, x in enumerate(rest) if mask >> k & 1)
            if c := least(inside):
                best = min(best, cost(c) + cheapest([x for k, x in enumerate(rest) if not mask >> k & 1]))
        return best

    ratios, opened = [], set()
    for _ in range(60):
        pieces = sorted((rng.randrange(1, 17) for _ in range(rng.randrange(1, 7))), reverse=True)
        bins, offsets, final = packing.pack(pieces, sizes, cost)
        assert len(bins) == len(offsets) == len(pieces) and set(final) <= set(sizes)
        total, single = sum(map(cost, final)), packing.best_fit(pieces, 16, lambda n, left: 16)[2]
        assert total <= sum(cost(least(x)) for x in single) + 1e-9
        ratios.append(total / cheapest(pieces))
        opened |= set(final)
    assert min(ratios) >= 1 - 1e-9 and np.mean(ratios) < 1.02 and max(ratios) < 1.25 and opened == set(sizes)


def test_packing_opens_the_least_cost_size():
    steep = lambda c: c * c
    assert packing.pack([3, 3, 3, 3], (4, 8, 16), steep)[2] == [4, 4, 4, 4]  # a long sequence would cost more
    flat = lambda c: c + 100
    assert packing.pack([3, 3, 3, 3], (4, 8, 16), flat)[2] == [16]
    many = (3, 5, 8, 13, 21, 34, 55)  # more than ALL_SETS: a local search
    pieces = sorted((random.Random(2).randrange(1, 56) for _ in range(60)), reverse=True)
    assert sum(map(flat, packing.pack(pieces, many, flat)[2])) <= sum(map(flat, packing.pack(pieces, (55,), flat)[2]))


def test_bpe_memory_is_bounded(monkeypatch):
    own = bpe.Bpe(bpe.default_vocabulary())
    texts = [" ".join(f"w{k}x{j}qz" for j in range(40)) for k in range(30)]
    want = [own.encode(t) for t in texts]
    monkeypatch.setattr(bpe, "REMEMBERED_PAIRS", 50)
    small = bpe.Bpe(bpe.default_vocabulary())
    assert [small.encode(t) for t in texts] == want and len(small.tested) < 2000


def test_emptied_documents_leave_the_pipeline(spark):
    import corpus_pipeline

    words = [f"word{k}" for k in range(60)]
    rows = [(k, "\n".join([" ".join(words[:30]), " ".join(words[30:])])) for k in (1, 2, 3)]
    rows += [(4, " ".join(words) + "\nanother line of this document here"), (5, None), (6, " "), (7, "no line of this is elsewhere")]
    out = corpus_pipeline.line_dedup(spark, frame(spark, rows), "").collect()
    assert sorted(r.doc_id for r in out) == [1, 4, 5, 6, 7]
    assert linededup.drop_lines(frame(spark, rows)).count() == 7


def test_groups_keep_one_document(spark):
    rows = [(k, f"a{k % 3} " + " ".join(f"t{j}" for j in range(40))) for k in range(12)] + [(None, "x")] + ODD
    kept = minhash.drop_near_duplicates(frame(spark, rows), k=5)
    assert [r.doc_id for r in kept.where("doc_id between 0 and 11").collect()].count(0) == 1
    assert zlib.crc32(b"") == 0 and plain_spans("") == []

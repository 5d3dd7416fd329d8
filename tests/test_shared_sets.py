"""Reports and similarities over tables in which many functions share a few strings, held against brute force."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from symtrace.operators import features, similarity
from symtrace.plans import engine, fixtures, report, v2, v3
from symtrace.plans.queries import QUERIES
from symtrace.plans.state import Inputs, State


def test_top_matches_have_a_total_order(spark):
    rows = [(1, s, 1.0) for s in range(90, 0, -1)] + [(2, 0, 0.5)]
    frame = spark.createDataFrame(rows, "bin_func_id long, src_func_id long, confidence double").repartition(5)
    assert [r.src_func_id for r in report.top(frame, 20, 0.3).collect()] == list(range(1, 21))


def _tables(spark, path):
    """Documents of few lines, most of them shared, with copies; and what brute force says of their pairs."""
    rng = random.Random(5)
    texts = ["\n".join(["shared line"] * (k % 3 > 0) + [f"line {rng.randrange(6)}" for _ in range(k % 4)] + [f"own line {k}"] * (k % 5 == 0)) for k in range(60)]
    texts += texts[:25]
    spark.createDataFrame([(k, t, 10 + k % 7) for k, t in enumerate(texts)], "doc_id long, text string, n_chars long").write.parquet(f"{path}/documents.parquet")
    sets = {k: {x for x in t.split("\n") if len(x) >= 5} for k, t in enumerate(texts)}
    bins, srcs = ({k: v for k, v in sets.items() if v and k % 2 == side} for side in (1, 0))
    df = Counter(s for v in bins.values() for s in v)
    weight = {s: math.log((len(bins) + 1) / (df[s] + 1)) if s in df else 1.0 for v in sets.values() for s in v}
    total = lambda v: sum(weight[s] for s in v)
    pairs = {}
    for b, x in bins.items():
        for c, y in srcs.items():
            if x & y:
                union = total(x | y)
                pairs[b, c] = (len(x & y), len(x & y) / len(x | y), total(x & y) / union if union > 1e-12 else 0.0)
    return pairs


def test_all_pairs_come_from_sets_alone(spark, tmp_path, monkeypatch):
    pairs = _tables(spark, tmp_path)
    score = {k: round(0.35 * j + 0.65 * w, 6) for k, (_, j, w) in pairs.items()}
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    near = lambda a, b: a.keys() == b.keys() and all(abs(a[k] - b[k]) < 2e-6 for k in a)
    for sent, chunk in ((similarity.SENT, similarity.CHUNK), (0, 2)):  # sent to all in one chunk; shuffled in many
        monkeypatch.setattr(similarity, "SENT", sent)
        monkeypatch.setattr(similarity, "CHUNK", chunk)
        assert near({(r.bin_id, r.src_id): r.jaccard for r in run("jaccard_pairs")}, {k: v[1] for k, v in pairs.items()})
        assert near({(r.bin_id, r.src_id): r.weighted for r in run("weighted_jaccard")}, {k: v[2] for k, v in pairs.items()})
        assert {(r.bin_id, r.src_id): r.shared_strings for r in run("export_shared_strings")} == {k: v[0] for k, v in pairs.items()}
        assert sum(r["count"] for r in run("confidence_buckets")) == len(pairs)
    size = lambda k: 10 + k % 7
    hybrid = {(b, c): 0.5 * (0.4 * j + 0.6 * w) + 0.15 * min(size(b), size(c)) / max(size(b), size(c)) for (b, c), (_, j, w) in pairs.items()}
    assert near({(r.bin_id, r.src_id): r.score for r in run("hybrid_score")}, hybrid)
    assert run("overall_stats")[0].total == run("run_summary")[0].matched == sum(r["count"] for r in run("method_histogram")) == len(pairs)
    assert abs(run("overall_stats")[0].avg_confidence - sum(score.values()) / len(score)) < 1e-5
    order = sorted(score, key=lambda k: (-score[k], k))
    assert [(r.bin_func_id, r.src_func_id) for r in run("top_candidates")] == order[:10]
    assert [(r.bin_func_id, r.src_func_id) for r in run("top_matches")] == order[:20]
    each = defaultdict(list)
    for b, c in sorted(score, key=lambda k: (-score[k], k[1])):
        each[b].append(c)
    assert {(r.bin_func_id, r.src_func_id) for r in run("top5_per_bin")} == {(b, c) for b, x in each.items() for c in x[:5]}
    assert len(run("rename_script")) == sum(v >= 0.7 for v in score.values())


def test_pairs_of_a_shared_string_are_counted_by_sets(spark):
    """Of 200 functions a side that share one string, the join on the string meets one set of each side."""
    rows = lambda odd: spark.createDataFrame([(2 * k + odd, s) for k in range(200) for s in ("shared", f"own {odd} {k % 3} {k}")], "func_id long, s string")
    shared = similarity.shared_sets(rows(1), rows(0))
    assert [r.n_i for r in shared.overlaps.collect()] == [1]
    assert [r.copies for r in shared.classes().collect()] == [40_000]


def test_inputs_are_derived_when_they_are_read(spark, monkeypatch):
    """Phase 1 of v3 reads no edge and no indirect string, so none is made for it."""
    made = []
    real = features.indirect_strings
    monkeypatch.setattr(features, "indirect_strings", lambda *a: made.append(1) or real(*a))
    sets = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c")], "func_id long, s string")
    edges = spark.createDataFrame([(1, 3)], "caller_id long, callee_id long")
    given = Inputs.of(None, None, sets, sets, edges, edges)
    assert v3.first_round(given, State.empty(spark)).confirmed.count() == 2 and not made
    assert sorted(map(tuple, given.bin_indirect.collect())) == [(1, "c")] and len(made) == 1 and given.bin_indirect is given.bin_indirect


def test_combined_candidates_compare_classes(spark, monkeypatch):
    rows = lambda odd: spark.createDataFrame([(2 * k + odd, s) for k in range(120) for s in ("shared", f"pair {k % 2}", f"own {odd} {k}")[: 2 + k % 2]], "func_id long, s string")
    seen = []
    real = similarity.Shared.expanded
    monkeypatch.setattr(similarity.Shared, "expanded", lambda self, classes, k=None: seen.append(classes.count()) or real(self, classes, k))
    found = similarity.combined_candidates(rows(1), rows(0), 0.25).count()
    assert found == similarity.similarity(rows(1), rows(0)).where("0.35 * jaccard + 0.65 * weighted > 0.25").count() > 3_000 and seen == [seen[0]] and seen[0] <= 4


def test_inferred_pairs_are_those_of_all_pairs(spark, monkeypatch):
    """Functions with callers alone, callees alone and both, small and large sets, against the similarity of every pair."""
    rng = random.Random(9)
    callers = [(a, 1000 + p) for p in range(40) for a in rng.sample(range(30), 3 + p % 9)] + [(1000 + p, 1000 + (p * 7 + 3) % 40) for p in range(0, 40, 3)]
    callers += [(50 + a, 5000 + p) for a in range(4) for p in rng.sample(range(120), 100 - a)]
    src = sorted(set(callers))
    bins = [e for e in src if rng.random() < 0.9]
    frame = lambda rows, names: spark.createDataFrame(rows, " long, ".join(names.split()) + " long")
    be, se = frame(bins, "caller_id callee_id"), frame(src, "caller_id callee_id")
    nodes = sorted({x for e in bins for x in e})
    opened, mapped = frame([(x,) for x in nodes if x % 3 == 0], "bin_id"), frame([(x, x) for x in nodes if x % 3], "bin_id src_id")
    seen = []
    real = similarity.call_similarity
    monkeypatch.setattr(similarity, "call_similarity", lambda pairs, *a: seen.append(pairs.count()) or real(pairs, *a))
    for above in (0.0, 0.2, 0.3, 0.45):
        every = similarity.neighbour_candidates(opened, be, se, mapped)
        expected = {(r.bin_id, r.src_id): r.call for r in real(every, be, se, mapped).collect() if round(r.call, 12) > above}
        found = {(r.bin_id, r.src_id): r.call for r in similarity.inferred_pairs(opened, be, se, mapped, above).collect()}
        assert found.keys() == expected.keys() and expected and all(abs(found[k] - expected[k]) < 1e-12 for k in found)
    assert seen[-1] < 0.2 * every.count()


def test_gaps_are_decided_between_classes(spark, tmp_path, monkeypatch):
    pairs = _tables(spark, tmp_path)
    ranked = defaultdict(list)
    for (b, c), (_, j, w) in pairs.items():
        if round(0.35 * j + 0.65 * w, 12) > 0.25:
            ranked[b].append((-round(0.35 * j + 0.65 * w, 12), c))
    best = {b: sorted(v) for b, v in ranked.items()}
    expected = {(b, v[0][1]) for b, v in best.items() if v[0][0] < -0.75 and (len(v) == 1 or round(v[1][0] - v[0][0], 12) > 0.15)}
    made, expanded = [], similarity.Shared.expanded
    monkeypatch.setattr(similarity.Shared, "expanded", lambda self, classes, k=None: made.append(out := expanded(self, classes, k)) or out)
    found = {(r.bin_id, r.src_id) for r in QUERIES["top1_gap_confirm"](spark, str(tmp_path)).collect()}
    assert found == expected and made[0].count() == len(expected)


def test_pieces_of_single_rows_are_not_shuffled(spark, tmp_path):
    rows = [(1, "line one\n line one \nline two\nabc"), (2, "line one"), (3, None)]
    for name, more in (("once", []), ("again", [(2, "line one\nline six")])):
        spark.createDataFrame(rows + more, "doc_id long, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
    once, again = (fixtures.line_strings(spark, f"{tmp_path}/{name}") for name in ("once", "again"))
    own = {(1, "line one", 1), (1, "line two", 1), (2, "line one", 0)}
    assert sorted(map(tuple, once.collect())) == sorted(own) and sorted(map(tuple, again.collect())) == sorted(own | {(2, "line six", 0)})
    assert "Exchange" not in once._jdf.queryExecution().executedPlan().toString()


def test_indirect_strings_are_compared_as_units(spark, monkeypatch):
    rng = random.Random(3)
    own = {k: {f"own {k} {i}" for i in range(5)} | {f"group {rng.randrange(4)} {i}" for i in range(3)} for k in range(40)}
    frame = lambda rows, names: spark.createDataFrame(sorted(rows), names)
    strings = [frame({(k, s.replace("own 0 ", "own 1 ")) for k, v in own.items() if k % 2 == side for s in v}, "func_id long, s string") for side in (1, 0)]
    calls = [{(100 + side + 2 * rng.randrange(8), k) for k in own if k % 2 == side for _ in range(2)} | {(200 + side, 0 + side)} for side in (1, 0)]
    edges = [frame(e, "caller_id long, callee_id long") for e in calls]
    info = [frame({(k,) for k in range(side, 300, 2)}, f"{i} long") for side, i in ((1, "bin_id"), (0, "src_id"))]
    listed = [features.indirect_strings(e, s) for e, s in zip(edges, strings, strict=True)]
    plain = Inputs(*info, *strings, *edges, *listed, features.idf(strings[0]))
    made, indirect = [], features.indirect_strings
    monkeypatch.setattr(features, "indirect_strings", lambda e, s: made.append(out := indirect(e, s)) or out)
    results = []
    for inputs in (plain, Inputs.of(*info, *strings, *edges)):
        state = v3.unique_strings(inputs, State.empty(spark))
        monkeypatch.setattr(v3, "SIMILAR", 0.05)
        state = v3.indirect_similarity(inputs, state)
        results.append([sorted((r.bin_id, r.src_id, r.method, round(r[2], 9)) for r in df.collect()) for df in (state.confirmed, state.candidates)])
    assert results[0] == results[1] and len({r[2] for r in results[0][0]}) >= 2
    assert [x.count() for x in made] < [x.count() for x in listed] and made[0].schema["s"].dataType.typeName() == "long"


def test_overlaps_of_sets_that_cannot_be_similar_are_not_made(spark):
    """Every function has a common string beside five of its own; one in ten has a counterpart. The common string makes over
    10,000 pairs of sets, of which the counterparts and few others are counted; random sets lose no candidate."""
    rows = lambda odd: [(2 * k + odd, s) for k in range(200) for s in ("common", f"met {odd} {k % 100}", *(f"both {k} {i}" if k % 10 == 0 else f"own {odd} {k} {i}" for i in range(5)))]
    extra = [(1000 + odd, f"met {1 - odd} {k}") for odd in (0, 1) for k in range(100)]  # so that the strings "met" make sets
    frame = lambda r: spark.createDataFrame(r, "func_id long, s string")
    shared = similarity.shared_sets(frame(rows(1) + extra[100:]), frame(rows(0) + extra[:100]))
    assert shared.overlaps.count() > 10_000 and shared.near(0.25).overlaps.count() <= 200
    assert {(r.bin_id, r.src_id) for r in shared.above(0.25).collect()} == {(2 * k + 1, 2 * k) for k in range(0, 200, 10)}
    rng = random.Random(8)
    sets = {k: {f"s{min(rng.randrange(12), rng.randrange(12))}" for _ in range(rng.randrange(1, 7))} | {f"o{k}"} for k in range(120)}
    sides = [{k: v for k, v in sets.items() if k % 2 == side} for side in (1, 0)]
    for least in (0.0, 0.25, 0.6):
        found = similarity.combined_candidates(*(frame([(k, s) for k, v in x.items() for s in v]) for x in sides), least).collect()
        df = Counter(s for v in sides[0].values() for s in v)
        total = lambda v: sum(math.log((len(sides[0]) + 1) / (df[s] + 1)) if s in df else 1.0 for s in v)  # noqa: B023, E731
        want = {(b, c): 0.35 * len(x & y) / len(x | y) + 0.65 * total(x & y) / total(x | y) for b, x in sides[0].items() for c, y in sides[1].items() if x & y}
        assert {(r.bin_id, r.src_id): round(r.score, 9) for r in found} == {k: round(v, 9) for k, v in want.items() if round(v, 12) > least}


def test_v2_scores_strings_by_sets(spark, monkeypatch):
    """Phases 2 and 4 and the results count what sets share: no text is joined, nor weighed for each function."""
    texts = lambda odd: [(2 * k + odd, s) for k in range(6) for s in (f"text {k}", f"more {k // 2}", "all have it", f"own {odd} {k}")]
    frame = lambda r: spark.createDataFrame(r, "func_id long, s string")
    info = [spark.createDataFrame([(2 * k + odd, f"f{k}", 10, "x") for k in range(6)], f"{i} long, name string, size int, {more} string") for odd, i, more in ((1, "bin_id", "address"), (0, "src_id", "file_path"))]
    edges = spark.createDataFrame([], "caller_id long, callee_id long")
    for name in ("weighted", "idf"):
        monkeypatch.setattr(features, name, None)
    inputs = Inputs.of(*info, frame(texts(1)), frame(texts(0)), edges, edges)
    state = v2.propagation(inputs, v2.hybrid(inputs, v2.string_set(inputs, State.empty(spark))))
    assert {r.reason for r in state.log.where("phase = 'phase4' and bin_id = src_id + 1").collect()} and state.candidates.count() >= 6
    shared = engine.results(inputs, v2.unique_string(inputs, State.empty(spark)), "v2")
    assert {(r.bin_func_id, r.src_func_id, r.shared_strings) for r in shared.collect()} == {(2 * k + 1, 2 * k, 3) for k in range(6)}


def test_values_are_made_for_pairs_of_classes(spark):
    """Of 200 functions a side, with one common string and one or two of their own, 40,000 pairs are listed; four are computed."""
    rows = lambda odd: spark.createDataFrame([(2 * k + odd, s) for k in range(200) for s in ("shared", *(f"own {odd} {k} {i}" for i in range(1 + k % 2)))], "func_id long, s string")
    made = spark.sparkContext.accumulator(0)
    value = F.udf(lambda j: made.add(1) or j, "double")("jaccard")
    found = similarity.shared_sets(rows(1), rows(0)).valued(jaccard=value).collect()
    assert {(r.bin_id, r.src_id): round(r.jaccard, 9) for r in found} == {(2 * b + 1, 2 * c): round(1 / (3 + b % 2 + c % 2), 9) for b in range(200) for c in range(200)}
    assert len(found) == 40_000 and made.value == 4

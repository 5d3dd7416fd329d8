"""Hand-worked fixtures of the operators, property tests, and both pipelines on one input."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from symtrace.operators import assign, features, similarity
from symtrace.plans import engine, report, v2, v3
from symtrace.plans.state import Inputs, State


def strings(spark, sets):
    return spark.createDataFrame([(f, s) for f, x in sets.items() for s in x], "func_id long, s string")


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "caller_id long, callee_id long")


def mapping(spark, pairs):
    return spark.createDataFrame(pairs, "bin_id long, src_id long")


def test_evidence_and_bijection(spark):
    src = strings(spark, {10: "abc", 11: "d", 12: "e"})
    bins = strings(spark, {100: "ab", 101: "cd", 102: "ef"})
    pairs = assign.evidence_pairs(bins, src)
    assert sorted(map(tuple, pairs.collect())) == [(100, 10, 2), (101, 10, 1), (101, 11, 1), (102, 12, 1)]
    matches, conflicts = assign.assign(pairs, "evidence")
    assert sorted((r.bin_id, r.src_id) for r in matches.collect()) == [(100, 10), (101, 11), (102, 12)]
    assert [(r.bin_id, r.src_id) for r in conflicts.collect()] == [(101, 10)]


def test_idf_and_similarity(spark):
    bins = strings(spark, {100: "ab", 101: "ac", 102: "abd"})
    src = strings(spark, {10: "abx"})
    idf = {r.s: round(r.idf, 6) for r in features.idf(bins).collect()}
    assert idf == {"a": 0.0, "b": 0.287682, "c": 0.693147, "d": 0.693147}
    got = {r.bin_id: (round(r.jaccard, 6), round(r.weighted, 6), round(0.35 * r.jaccard + 0.65 * r.weighted, 6)) for r in similarity.similarity(bins, src).collect()}
    assert got == {100: (0.666667, 0.223411, 0.378550), 102: (0.5, 0.145233, 0.269402), 101: (0.25, 0.0, 0.0875)}


def test_call_similarity_and_propagation(spark):
    bin_edges, src_edges = edges(spark, [(1, 9), (2, 9), (9, 3)]), edges(spark, [(11, 19), (12, 19), (19, 13)])
    confirmed = mapping(spark, [(1, 11), (3, 13)])
    pair = mapping(spark, [(9, 19)])
    assert similarity.call_similarity(pair, bin_edges, src_edges, confirmed).first().call == 0.75
    assert similarity.propagation_bonus(pair, bin_edges, src_edges, confirmed).first().bonus == pytest.approx(0.20)
    assert similarity.call_similarity(mapping(spark, [(50, 60)]), bin_edges, src_edges, confirmed).first().call == 0.0
    near = similarity.neighbour_candidates(spark.createDataFrame([(9,)], "bin_id long"), bin_edges, src_edges, confirmed)
    assert [tuple(r) for r in near.collect()] == [(9, 19)]


def test_calls_of_few_pairs_keep_their_edges_alone(spark, monkeypatch):
    bin_edges, src_edges = edges(spark, [(1, 9), (2, 9), (9, 3)] + [(k, k + 1) for k in range(100, 300)]), edges(spark, [(11, 19), (12, 19), (19, 13)] + [(k, k + 1) for k in range(100, 300)])
    kept = []
    monkeypatch.setattr(similarity, "cut", lambda df: kept.append(df.count()) or df)
    confirmed = mapping(spark, [(1, 11), (3, 13)] + [(k, k) for k in range(100, 300)])
    assert similarity.call_similarity(mapping(spark, [(9, 19)] * 2), bin_edges, src_edges, confirmed).first().call == 0.75
    assert kept and max(kept) <= 2


def test_hybrid_and_size():
    assert 0.5 * 0.5 + 0.35 * 0.75 + 0.15 * 0.8 == pytest.approx(0.6325)


@pytest.mark.parametrize(("scores", "ok"), [((0.90, 0.80), False), ((0.90, 0.70), True), ((0.76,), True), ((0.75,), False)])
def test_gap_rule(spark, scores, ok):
    rows = spark.createDataFrame([(1, k, s, k) for k, s in enumerate(scores)], "bin_id long, src_id long, score double, seq long")
    assert (assign.best_with_gap(rows, 0.75, 0.15).count() == 1) == ok


@given(st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7), st.integers(1, 3)), max_size=30, unique_by=lambda x: x[:2]))
@settings(max_examples=8, deadline=None)
def test_greedy_rounds_equal_the_sequential_scan(spark, rows):
    pairs = spark.createDataFrame(rows, "bin_id long, src_id long, w long")
    want = sorted(assign.sequential(rows, set(), set()))
    assert sorted(map(tuple, assign.greedy(pairs, "w", on_driver=0).collect())) == want
    assert sorted(map(tuple, assign.greedy(pairs, "w").collect())) == want


@pytest.mark.parametrize("seed", range(3))
def test_prefix_filter_loses_nothing(spark, seed):
    rng = random.Random(seed)
    pool = [f"s{k}" for k in range(25)]
    some = lambda first: {first + k: rng.sample(pool, rng.randrange(1, 6)) for k in range(40)}
    bins, src = strings(spark, some(100)), strings(spark, some(500))
    for t in (0.4, 0.6):
        want = similarity.similarity(bins, src).where(F.round("weighted", 12) >= t).select("bin_id", "src_id", F.round("weighted", 9))
        got = similarity.similar_pairs(bins, src, t).select("bin_id", "src_id", F.round("weighted", 9))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def inputs(spark):
    info = lambda key, ids, **more: spark.createDataFrame([(i, more.get("name", "f") + str(i % more.get("mod", 1000)), 40, "x") for i in ids], f"{key} long, name string, size long, {'address' if key == 'bin_id' else 'file_path'} string")
    bins = strings(spark, {100: ["a", "b"], 101: ["c", "d"], 102: ["e", "f"], 103: ["m", "n", "z"], 104: []})
    src = strings(spark, {10: ["a", "b", "c"], 11: ["d"], 12: ["e"], 13: ["m", "n", "z"], 14: ["m"]})
    return Inputs.of(info("bin_id", range(100, 105)), info("src_id", range(10, 15)), bins, src, edges(spark, [(100, 104), (102, 104)]), edges(spark, [(10, 14), (12, 14)]))


def test_modes_differ_where_they_should(spark):
    given_ = inputs(spark)
    two, three = engine.MatchEngine.of("v2"), engine.MatchEngine.of("v3")
    a, b = two.run(given_), three.run(given_)
    first = {r.bin_id: (r.src_id, r.method) for r in a.confirmed.collect()}
    assert first[101] == (10, "unique_string") and first[100] == (10, "unique_string")  # sources may be reused
    second = {r.bin_id: (r.src_id, r.method) for r in b.confirmed.collect()}
    assert second[101] == (11, "unique_string_direct") and second[100][0] == 10
    assert len({s for s, _ in second.values()}) == len(second)
    found = a.candidates.where("bin_id = 104").collect()  # what the neighbours are mapped to has this neighbour
    assert [(r.src_id, r.method.split("+")[0]) for r in found] == [(14, "hybrid")]
    assert {r.phase for r in two.statistics().collect()} == {f"phase{k}" for k in range(1, 6)}
    assert [r.phase for r in three.statistics().collect()] == ["phase1", "phase2"]
    assert engine.match_log(a).where("phase = 'phase1'").count() > 0 and engine.match_log(b).count() == 0


def test_export_resume_and_reports(spark, tmp_path):
    given_ = inputs(spark)
    run = engine.MatchEngine.of("v3")
    state = run.run(given_)
    path = str(tmp_path / "out")
    engine.export(path, given_, state, run)
    rows = spark.read.parquet(f"{path}/mapping_results")
    assert rows.select("src_func_name").distinct().count() == rows.count()
    before = rows.count()
    again = engine.resume(spark, path)
    engine.export(path, given_, again, run)
    rows = spark.read.parquet(f"{path}/mapping_results")
    assert rows.count() == before == again.confirmed.count()
    assert report.overall(rows.where("false")).first().avg_confidence is None
    assert report.summary(rows, rows.where("false")).first().match_percent is None
    odd = rows.withColumn("bin_address", F.lit("0x0010")).withColumn("src_func_name", F.lit('a"b\\c')).limit(1)
    report.write_rename_script(odd, str(tmp_path / "script"))
    script = "\n".join(r.value for r in spark.read.text(str(tmp_path / "script")).collect())
    named = []
    fake = type("idc", (), {"SN_CHECK": 0, "set_name": staticmethod(lambda a, n, f: named.append((a, n)) or True)})
    exec(script.replace("import idc", ""), {"idc": fake})
    assert named == [(0x10, 'a"b\\c')]


def test_empty_sides(spark):
    none = strings(spark, {})
    given_ = inputs(spark)
    empty = Inputs.of(given_.bin_info, given_.src_info, none, none, given_.bin_edges.where("false"), given_.src_edges.where("false"))
    for mode in ("v2", "v3"):
        assert engine.MatchEngine.of(mode).run(empty).confirmed.count() == 0


def test_phase_two_variants(spark):
    given_ = inputs(spark)
    state = State.empty(spark)
    both = [v3.indirect_similarity(given_, state, v).confirmed.count() for v in ("all", "best")]
    assert both[0] >= both[1]
    assert v2.propagation(given_, state).confirmed.count() == 0


def test_name_search_is_like(spark):
    rows = spark.createDataFrame([("Foo_Bar",), ("fooXbar",), ("a\\b",), ("zz",)], "src_func_name string").selectExpr("src_func_name", "1.0D as confidence", "1L as bin_func_id")
    names = lambda text: sorted(r.src_func_name for r in report.search(rows, text).collect())
    assert names("FOO_BAR") == ["Foo_Bar", "fooXbar"] and names("a\\b") == ["a\\b"] and names("o%r") == ["Foo_Bar", "fooXbar"]


def test_greedy_settles_chains_in_few_rounds(spark, monkeypatch):
    """Ever heavier pairs of a chain, where a round of mutual best pairs takes one: the scan of the heaviest goes on."""
    chain = [(k // 2, (k + 1) // 2, float(k)) for k in range(600)]
    ties = [(1000 + k // 2, 1000 + (k + 1) // 2, 0.5) for k in range(300)]
    easy = [(5000 + k, 5000 + k, 700.0 + k % 3) for k in range(40)]
    rows = chain + ties + easy
    cuts = []
    real = assign.cut
    monkeypatch.setattr(assign, "cut", lambda df: cuts.append(1) or real(df))
    found = assign.greedy(spark.createDataFrame(rows, "bin_id long, src_id long, w double"), "w", on_driver=100)
    assert sorted(map(tuple, found.collect())) == sorted(assign.sequential(rows, set(), set()))
    assert len(cuts) < 40

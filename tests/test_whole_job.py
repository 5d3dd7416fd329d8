"""Queries over whole tables, held against brute force on small ones."""

from __future__ import annotations

import random
from collections import defaultdict

from symtrace.operators import assign
from symtrace.plans import fixtures, queries


def _graph(lines):
    """Edges of F2 from rows (order, supplier, part): binary and source."""
    src = {(s, 100000 + p) for _, s, p in lines}
    return {(s, 100000 + p) for o, s, p in lines if o % 10}, src


def test_neighbor_inference_has_all_open_functions(spark, tmp_path):
    rng = random.Random(1)
    lines = [(rng.randrange(1, 60), rng.randrange(1, 13), rng.randrange(1, 31)) for _ in range(150)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    bins, src = _graph(lines)
    nodes = {x for e in bins for x in e}
    seeds = {x for x in nodes if x % 10}

    def ends(edges):
        up, down = defaultdict(set), defaultdict(set)
        for caller, callee in edges:
            up[callee].add(caller)
            down[caller].add(callee)
        return up, down

    (bin_up, bin_down), (src_up, src_down) = ends(bins), ends(src)
    expected = {}
    for b in nodes - seeds:
        mapped = (bin_up[b] | bin_down[b]) & seeds
        for s in {x for m in mapped for x in src_up[m] | src_down[m]}:
            jaccard = [len(x & y) / len(x | y) if x | y else 0.0 for x, y in ((bin_up[b] & seeds, src_up[s]), (bin_down[b] & seeds, src_down[s]))]
            if round(sum(jaccard) / 2, 12) > 0.3:
                expected[b, s] = round(sum(jaccard) / 2 * 0.8, 6)
    found = {(r.bin_id, r.src_id): r.score for r in queries.QUERIES["neighbor_inference"](spark, str(tmp_path)).collect()}
    assert found.keys() == expected.keys() and all(abs(found[k] - expected[k]) < 2e-6 for k in found)
    assert {b for b, _ in found} >= {10, 100010, 100020}


def test_all_lines_of_an_order_count(spark, tmp_path):
    lines = [(1, 1, 5, 1), (1, 2, 6, 2), (1, 3, 7, 3), (10, 1, 8, 2), (2, 2, 6, 3)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_partkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(1, 41), (2, 42), (10, 41)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(p, f"type {p}") for p in range(5, 9)], "p_partkey long, p_type string").write.parquet(str(tmp_path / "part.parquet"))
    found = {tuple(r) for r in queries.QUERIES["caller_attributed_strings"](spark, str(tmp_path)).select("func_id", "s").collect()}
    assert found == {(41, "type 5"), (41, "type 6"), (41, "type 7"), (41, "type 8"), (42, "type 6")}
    bins, srcs = ({tuple(r) for r in e.collect()} for e in fixtures.document_edges(spark, str(tmp_path)))
    assert srcs == {(s * 2, p * 2) for _, s, p, _ in lines}
    assert bins == {(s * 2 + 1, p * 2 + 1) for o, s, p, _ in lines if o % 10}


def _chain(spark, path):
    """Documents of lines that overlap in long chains, so that rounds of mutual best pairs are more than the 12 of the SQL; in DuckDB
    the similar pairs of the SQL, and what a scan from the heaviest pair on chooses."""
    import duckdb

    texts = ["\n".join(f"line {x}" for x in range(5 * k, 8 * k + 30)) for k in range(80)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    near = con.execute(f"WITH {queries.LINES}, {queries.IDF} SELECT bin_id, src_id, round(weighted, 12) FROM sim WHERE round(weighted, 12) >= 0.6").fetchall()
    return con, near, set(assign.sequential(near, set(), set()))


def test_similarity_phase_assigns_beyond_the_rounds_of_its_sql(spark, tmp_path):
    con, near, chosen = _chain(spark, tmp_path)
    rows = lambda found: {(b, s): (round(x, 6), m) for b, s, x, m in found}
    found = rows(map(tuple, queries.QUERIES["indirect_similarity_phase"](spark, str(tmp_path)).collect()))
    assert found.keys() == {(b, s) for b, s, _ in near}
    assert {k for k, v in found.items() if v[1] == "indirect_multi_string"} == chosen
    cut_off = rows(con.execute(queries.SQL["indirect_similarity_phase"]).fetchall())
    settled = {k for k, v in cut_off.items() if v[1] == "indirect_multi_string"}
    assert settled < chosen
    assert {k for k in found if found[k] != cut_off[k]} == chosen - settled


def test_similarity_assignment_goes_beyond_the_rounds_of_its_sql(spark, tmp_path):
    con, near, chosen = _chain(spark, tmp_path)
    found = {(b, s): round(x, 6) for b, s, x in map(tuple, queries.QUERIES["similarity_bijective"](spark, str(tmp_path)).collect())}
    assert found.keys() == chosen
    cut_off = {(b, s): round(x, 6) for b, s, x in con.execute(queries.SQL["similarity_bijective"]).fetchall()}
    assert cut_off.keys() < chosen and all(found[k] == v for k, v in cut_off.items())

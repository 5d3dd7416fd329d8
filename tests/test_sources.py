"""Scans, parsing, binary import, stores and streaming ingestion."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from symtrace.functions import scalars
from symtrace.plans import queries
from symtrace.sources import extract, source_scan, sqlite, store
from symtrace.streaming import ingest

C = """
#include <stdio.h>
/* int ghost(void) { } */
static int helper(int a)
{
    log_line("in \\"helper\\"", a);   // call("x")
    if (a) { return twice(a); }
    return obj.method(1);
}
int main(void) { helper(3); for (;;) { puts("bye"); } }
int declared(int);
"""


def test_parse_c():
    rows = source_scan.parse(C, "c")
    assert [(r["kind"], r["name"]) for r in rows] == [("def", "helper"), ("call", "log_line"), ("call", "twice"), ("def", "main"), ("call", "helper"), ("call", "puts"), ("call", "declared")]
    helper = rows[0]
    assert (helper["line_start"], helper["line_end"]) == (5, 9)
    assert rows[1]["strings"] == ['in \\"helper\\"'] and rows[5]["strings"] == ["bye"]


@pytest.mark.parametrize(("lang", "text", "want"), [
    ("go", "func Add(a int) int { return sub(a, \"s\") }", [("def", "Add"), ("call", "sub")]),
    ("rust", "pub fn run<T>(x: T) -> u8 { go_on(1) }", [("def", "run"), ("call", "go_on")]),
    ("javascript", "function f(a) { g(a); }", [("def", "f"), ("call", "g")]),
    ("java", "class A { int f(int a) { g(a); return 1; } }", [("def", "f")]),
    ("python", "def f(a):\n    g(a)\n\nasync def h():\n    pass\n", [("def", "f"), ("def", "h")]),
])
def test_parse_languages(lang, text, want):
    assert [(r["kind"], r["name"]) for r in source_scan.parse(text, lang)] == want


def test_caller_attribution():
    text = "x();\nvoid f(void) {\n a();\n void g(void) { b(); }\n c();\n}\n"
    by = {m: {r["name"]: r["caller_hash"] for r in source_scan.records("p", text, "c", m) if r["kind"] == "call"} for m in ("last_opened", "enclosing")}
    hashes = {r["name"]: r["hash"] for r in source_scan.records("p", text, "c") if r["kind"] == "def"}
    assert by["last_opened"] == {"x": None, "a": hashes["f"], "b": hashes["g"], "c": hashes["g"]}
    assert by["enclosing"]["c"] == hashes["f"]


def test_scan_and_relations(spark, tmp_path):
    (tmp_path / "src/node_modules").mkdir(parents=True)
    (tmp_path / "src/a.c").write_text(C)
    (tmp_path / "src/b.h").write_text("int x;")
    (tmp_path / "src/node_modules/c.c").write_text(C)
    files = source_scan.scan(spark, str(tmp_path / "src"))
    assert [r.file_path for r in files.collect()] == [f"{tmp_path}/src/a.c"]
    assert source_scan.scan(spark, str(tmp_path / "src/a.c")).count() == 1
    out = source_scan.source_relations(source_scan.parsed(files))
    assert out["functions"].count() == 7 and out["strings"].count() == 2
    assert sorted(r.id for r in out["functions"].collect()) == list(range(1, 8))
    assert out["source_call_graph"].count() == 5
    bad = spark.createDataFrame([("p", "c", None)], "file_path string, lang string, content binary")
    assert [r.kind for r in source_scan.parsed(bad).collect()] == ["error"]


def test_next_call(spark):
    refs = spark.createDataFrame([(1, a, k) for k, a in enumerate((0x100, 0x110, 0x0C0, 0x150))], "func long, addr long, string long")
    calls = spark.createDataFrame([(1, 0x110, 1, 7), (1, 0x140, 2, 8)], "func long, addr long, seq long, callee long")
    got = {r.addr: r.callee for r in extract.next_call(refs, calls).collect()}
    assert got == {0x100: 7, 0x110: 8, 0x0C0: None, 0x150: None}
    twice = spark.createDataFrame([(1, 0x110, 2, 9), (1, 0x110, 1, 7)], "func long, addr long, seq long, callee long")
    assert extract.next_call(refs, twice).where("addr = 256").first().callee == 7
    fan = extract.ref_fanout(extract.next_call(refs, calls))
    assert fan.count() == 6 and fan.where("ref_type = 'direct'").count() == 2


def document():
    return {
        "program": "p", "image_base": "0x00000000",
        "functions": [{"address": f"0x{a:08x}", "name": f"FUN_{a}", "size": 9, "is_library": 0} for a in (0x100, 0x200)] + [{"address": "0x00000100", "name": "again"}],
        "strings": [{"address": "0x00000900", "content": "hello", "length": 5}],
        "call_graph": [{"caller": "0x00000100", "callee": "0x00000200", "call_addr": "0x00000120"}, {"caller": "0x00000100", "callee": "0x00000777", "call_addr": "0x00000130"}],
        "func_string_refs": [{"func_addr": "0x00000100", "string_addr": "0x00000900", "ref_addr": "0x00000110"}],
    }


def test_import_extract(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps(document(), indent=2))
    out = extract.import_extract(extract.read_extract(spark, str(tmp_path / "x.json")))
    assert [(r.id, r.address) for r in out["binary_functions"].orderBy("id").collect()] == [(1, "0x00000100"), (2, "0x00000200")]
    assert sorted((r.func_id, r.ref_type, r.ref_addr) for r in out["binary_func_string_refs"].collect()) == [(1, "indirect", "0x00000110"), (2, "direct", "0x00000110")]
    assert {r.table: r.n for r in out["skipped"].collect()} == {"call_graph": 1, "func_string_refs": 0}
    (tmp_path / "y.json").write_text('{"program": "empty"}')
    assert extract.import_extract(extract.read_extract(spark, str(tmp_path / "y.json")))["binary_functions"].count() == 0
    extract.write_extract(extract.read_extract(spark, str(tmp_path / "x.json")), str(tmp_path / "z"), "p")
    assert extract.read_extract(spark, str(tmp_path / "z"))["functions"].count() == 3


def test_stream_ingestion_is_idempotent(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.json").write_text(json.dumps(document()))
    out = str(tmp_path / "out")
    ingest.ingest(ingest.read_extracts(spark, str(tmp_path / "in")), out, str(tmp_path / "c1")).awaitTermination(120)
    (tmp_path / "in/y.json").write_text(json.dumps(document() | {"program": "q"}))
    ingest.ingest(ingest.read_extracts(spark, str(tmp_path / "in")), out, str(tmp_path / "c2")).awaitTermination(120)
    rows = spark.read.parquet(f"{out}/functions")
    assert rows.count() == 4 and rows.where("program = 'q'").count() == 2


def test_raw_strings(spark):
    data = b"\x00ab\x01  hello\t\x00\x00abcde\xff" + b"x" * 4
    got = extract.raw_strings(spark.createDataFrame([(0x1000, bytearray(data))], "start long, data binary")).collect()
    assert [(r.address, r.content, r.length) for r in got] == [("0x00001004", "hello", 8), ("0x0000100e", "abcde", 5)]


def test_scalars(spark):
    rows = spark.createDataFrame([('"a"',), ("'''doc'''",), ("x",), ("`t`",), ("''",)], "raw string")
    assert [r[0] for r in rows.select(scalars.unquoted(F.col("raw"))).collect()] == [source_scan.literal(r.raw) for r in rows.collect()] == ["a", "doc", "x", "t", ""]
    one = spark.range(1).select(scalars.from_hex(F.lit("0x0001f")), scalars.from_hex(F.lit("zz")), scalars.to_hex(F.lit(31)), scalars.size_similarity(F.lit(40), F.lit(50)), scalars.size_similarity(F.lit(0), F.lit(50))).first()
    assert tuple(one) == (31, None, "0x0000001f", 0.8, 0.5)


def test_sqlite_tables(spark, tmp_path):
    import sqlite3

    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as db:
        db.execute('CREATE TABLE strings (id INTEGER PRIMARY KEY, content TEXT, "odd name" REAL)')
        db.executemany("INSERT INTO strings VALUES (?, ?, ?)", [(k, f"s{k}" if k % 3 else None, k / 2) for k in range(1, 26)])
    rows = sqlite.read_table(spark, path, "strings", rows=7).orderBy("id").collect()
    assert sqlite.table_names(path) == ["strings"] and [r.id for r in rows] == list(range(1, 26))
    assert rows[2].content is None and rows[3]["odd name"] == 2.0


def test_defined_strings(spark):
    rows = spark.createDataFrame([(0x2000, "string", "hi"), (0x10, "string", "low"), (0x3000, "char[4]", "x"), (0x4000, "TerminatedCString", "yes"), (0x5000, "int", "no")], "offset long, data_type string, value string")
    assert sorted(r.content for r in extract.defined_strings(rows).collect()) == ["hi", "yes"]


def test_store(spark):
    rows = spark.createDataFrame([(1, "a", 5), (1, "a", 3), (2, "b", 1)], "k long, v string, n long")
    assert sorted(map(tuple, store.insert_or_ignore(rows, ["k"], order=["n"]).collect())) == [(1, "a", 3), (2, "b", 1)]
    assert store.insert_or_ignore(rows, ["k"], rows.where("k = 1")).count() == 1
    assert [r.id for r in store.numbered(rows.select("v").distinct(), "v").orderBy("v").collect()] == [1, 2]
    assert store.violations(rows, "k", rows.where("k = 2"), "k").count() == 2


def test_every_query_matches_its_sql(spark):
    import os

    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")

    def rows(df):
        cols = sorted(df.columns)
        return sorted([tuple(None if x != x else round(x, 6) if isinstance(x, float) else x for x in r) for r in df[cols].astype(object).itertuples(index=False)], key=repr)

    for name in ("evidence_pairs", "greedy_bijective", "similarity_bijective", "threshold_all_pairs", "call_similarity", "propagation_fixpoint", "asof_next_call", "merge_remap"):
        assert rows(queries.QUERIES[name](spark, sf).toPandas()) == rows(con.execute(queries.SQL[name]).fetch_df()), name


def test_next_call_of_a_hot_function(spark):
    """Very many references and calls of one function: as by a sorted list, over many groups, in seconds."""
    import bisect
    import random
    import time

    rng = random.Random(5)
    refs = [(1, rng.randrange(0, 4_000_000), k) for k in range(40_000)]
    calls = [(1, rng.randrange(0, 4_000_000), k, 1000 + k) for k in range(40_000)]
    began = time.time()
    got = extract.next_call(spark.createDataFrame(refs, "func long, addr long, string long"), spark.createDataFrame(calls, "func long, addr long, seq long, callee long")).collect()
    assert time.time() - began < 60 and len(got) == len(refs)
    order = sorted((a, s, c) for _, a, s, c in calls)
    starts = [a for a, _, _ in order]
    for r in got:
        k = bisect.bisect_right(starts, r.addr)
        near = order[k] if k < len(order) and order[k][0] - r.addr <= extract.TOLERANCE else None
        assert (r.callee, r.call_addr) == ((near[2], near[0]) if near else (None, None))


def test_methods_are_no_calls():
    js = "class A { run(x) { go(x); } }\nitems.map(x => { show(x); });\nfunction top(a) { later(); }\nif (cond(a)) { b(); }\n"
    rows = [(r["kind"], r["name"]) for r in source_scan.parse(js, "javascript")]
    assert rows == [("call", "go"), ("def", "x"), ("call", "show"), ("def", "top"), ("call", "later"), ("call", "cond"), ("call", "b")]
    go = "func (r *T) Method(x int) int { return plain(x) }\nfunc Plain(x int) int { go func() { other(x) }(); if check(x) { return 1 } }\n"
    assert [(r["kind"], r["name"]) for r in source_scan.parse(go, "go")] == [("call", "plain"), ("def", "Plain"), ("call", "other"), ("call", "check")]


def test_extracts_by_program(spark, tmp_path):
    rows = spark.createDataFrame([("a", "0x1", "f"), ("a", "0x2", "g"), ("b", "0x1", "h")], "program string, address string, name string")
    extract.write_extract({"functions": rows}, str(tmp_path / "x"))
    docs = spark.read.option("multiLine", True).json(str(tmp_path / "x")).collect()
    assert {d.program: sorted(f.name for f in d.functions) for d in docs} == {"a": ["f", "g"], "b": ["h"]}
    assert extract.read_extract(spark, str(tmp_path / "x"))["functions"].count() == 3

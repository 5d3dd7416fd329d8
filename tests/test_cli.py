"""The command line, in process."""

from __future__ import annotations

import json

from symtrace import cli
from tests.test_matching import inputs
from tests.test_sources import C, document


def test_match_and_reports(spark, tmp_path, capsys):
    given_ = inputs(spark)
    for name in ("bin_info", "src_info", "bin_strings", "src_strings", "bin_edges", "src_edges"):
        getattr(given_, name).write.parquet(f"{tmp_path}/in/{name}")
    out = f"{tmp_path}/out"
    assert cli.main(["match", "v2", f"{tmp_path}/in", out]) == 0
    for args in (["summary", out], ["top", out, "5", "0.5"], ["candidates", out, "3"], ["search", out, "F1"]):
        assert cli.main(args) == 0
    assert "unique_string" in capsys.readouterr().out
    assert cli.main(["export", out, f"{tmp_path}/script"]) == 0
    assert spark.read.text(f"{tmp_path}/script").count() > 0
    assert cli.main(["nonsense", out]) == cli.main([]) == 2


def test_scan_and_import(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.c").write_text(C)
    assert cli.main(["scan", f"{tmp_path}/src", f"{tmp_path}/rel"]) == 0
    assert spark.read.parquet(f"{tmp_path}/rel/functions").count() == 7
    (tmp_path / "x.json").write_text(json.dumps(document()))
    assert cli.main(["import", f"{tmp_path}/x.json", f"{tmp_path}/bin"]) == 0
    assert spark.read.parquet(f"{tmp_path}/bin/binary_functions").count() == 2


def _sqlite(spark, folder, path):
    """The Parquet tables of a folder as an SQLite file."""
    import sqlite3
    from pathlib import Path

    with sqlite3.connect(path) as db:
        for table in Path(folder).iterdir():
            rows = spark.read.parquet(str(table))
            kinds = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL"}
            db.execute(f"CREATE TABLE {table.name} ({', '.join(f'"{c}" {kinds.get(t, 'TEXT')}' for c, t in rows.dtypes)})")
            db.executemany(f"INSERT INTO {table.name} VALUES ({', '.join('?' * len(rows.columns))})", [tuple(r) for r in rows.collect()])


SOURCE = """int alpha(int x) { log_it("first message"); return beta(x); }
int beta(int x) { log_it("second message"); return x; }
"""
EXTRACT = {
    "program": "p",
    "functions": [{"address": a, "name": n, "size": 32, "is_library": lib} for a, n, lib in (("0x1000", "FUN_1000", 0), ("0x2000", "FUN_2000", 0), ("0x3000", "printf", 1))],
    "strings": [{"address": "0x9000", "content": "first message", "length": 13}, {"address": "0x9100", "content": "second message", "length": 14}],
    "call_graph": [{"caller": "0x1000", "callee": "0x2000", "call_addr": "0x1010"}, {"caller": "0x1000", "callee": "0x3000", "call_addr": "0x1008"}],
    "func_string_refs": [{"func_addr": "0x1000", "string_addr": "0x9000", "ref_addr": "0x1004"}, {"func_addr": "0x2000", "string_addr": "0x9100", "ref_addr": "0x2004"}],
}


def test_scan_import_match(spark, tmp_path, capsys):
    """The whole way from a source tree and an extract to matches, from Parquet and from SQLite; phases and resuming."""
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.c").write_text(SOURCE)
    (tmp_path / "x.json").write_text(json.dumps(EXTRACT))
    assert cli.main(["scan", f"{tmp_path}/src", f"{tmp_path}/rel"]) == 0
    assert cli.main(["import", f"{tmp_path}/x.json", f"{tmp_path}/bin"]) == 0
    assert cli.main(["match", "v2", f"{tmp_path}/rel", f"{tmp_path}/bin", f"{tmp_path}/out"]) == 0
    found = lambda out: {(r.bin_address, r.src_func_name) for r in spark.read.parquet(f"{tmp_path}/{out}/mapping_results").collect()}
    assert found("out") == {("0x1000", "alpha"), ("0x2000", "beta")}
    assert "phase5" in capsys.readouterr().out
    for side in ("rel", "bin"):
        _sqlite(spark, tmp_path / side, tmp_path / f"{side}.db")
    assert cli.main(["match", "v2", f"{tmp_path}/rel.db", f"{tmp_path}/bin.db", f"{tmp_path}/out2"]) == 0
    assert found("out2") == found("out")
    # v3: strings stay with the called records, in the binary with what is called right after.
    assert cli.main(["match", "v3", f"{tmp_path}/rel.db", f"{tmp_path}/bin", f"{tmp_path}/one", "--phase", "phase1"]) == 0
    assert spark.read.parquet(f"{tmp_path}/one/statistics").count() == 1
    assert cli.main(["match", "v3", f"{tmp_path}/rel", f"{tmp_path}/bin", f"{tmp_path}/two", "--phase", "phase2", "--resume", f"{tmp_path}/one"]) == 0
    assert found("one") <= found("two") and {r.phase for r in spark.read.parquet(f"{tmp_path}/two/statistics").collect()} == {"phase2"}
    assert cli.main(["match", "v9", "a", "b", "c"]) == cli.main(["match", "v3", "a"]) == 2


def test_loaded_inputs(spark, tmp_path):
    from symtrace.sources import relations

    functions = spark.createDataFrame([(1, "f", "a.c", 3, 9, "h", 1), (2, "g", "a.c", 5, None, "i", 0)], "id long, name string, file_path string, line_start int, line_end int, hash string, is_def int")
    assert [tuple(r) for r in relations.function_info(functions).orderBy("src_id").collect()] == [(1, "f", 6, "a.c"), (2, "g", 0, "a.c")]
    bins = spark.createDataFrame([(1, "0x1", "FUN_1", 4, 0), (2, "0x2", "puts", 4, 1), (3, "0x3", "FUN_3", None, 0)], "id long, address string, name string, size long, is_library int")
    assert [tuple(r) for r in relations.non_library(bins).orderBy("bin_id").collect()] == [(1, "FUN_1", 4, "0x1"), (3, "FUN_3", 0, "0x3")]

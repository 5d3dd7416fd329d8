"""Tables of an SQLite file as DataFrames. Each task reads a range of rowids; the file must be readable by all executors."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

TYPES = {"INT": ("long", pa.int64(), int), "REA": ("double", pa.float64(), float), "FLO": ("double", pa.float64(), float), "DOU": ("double", pa.float64(), float)}
ROWS = 100_000


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def table_names(path: str) -> list[str]:
    with _open(path) as db:
        return [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]


def read_table(spark: SparkSession, path: str, table: str, rows: int = ROWS) -> DataFrame:
    """One table; columns keep their names, integers become longs, reals doubles, all else strings."""
    with _open(path) as db:
        columns = [(r[1], TYPES.get((r[2] or "").upper()[:3], ("string", pa.string(), str))) for r in db.execute(f"PRAGMA table_info({_quoted(table)})")]
        last = db.execute(f"SELECT coalesce(max(rowid), 0) FROM {_quoted(table)}").fetchone()[0]
    if not columns:
        raise ValueError(f"no table {table!r} in {path}")
    schema = pa.schema([(c, t[1]) for c, t in columns])
    picked = ", ".join(_quoted(c) for c, _ in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in b.column(0).to_pylist():
                with _open(path) as db:
                    found = db.execute(f"SELECT {picked} FROM {_quoted(table)} WHERE rowid > ? AND rowid <= ?", (start, start + rows)).fetchall()
                data = [[None if r[k] is None else t[2](r[k]) for r in found] for k, (_, t) in enumerate(columns)]
                yield pa.RecordBatch.from_arrays([pa.array(d, type=f.type) for d, f in zip(data, schema, strict=True)], schema=schema)

    starts = spark.range(0, last + 1, rows, numPartitions=max(1, -(-(last + 1) // rows)))
    return starts.mapInArrow(run, ", ".join(f"`{c}` {t[0]}" for c, t in columns))

"""Line-level deduplication over the whole corpus.

Lines are exploded and normalised, each key is hashed to 128 bits, and the smallest and largest document id of each
hash are counted up (partial sums first, so a line that a third of all documents share stays cheap; two different
ids mean at least two documents). Hashes over the threshold go back to their lines by a join that adaptive execution
may split, which gives the line positions that each document loses; documents are then reassembled by position.

Defined results: a null or empty text is one empty line; lines with keys under `least` code points always stay; in
the document with the smallest id all lines stay, also those repeated within it. Rows with a null id take no part and
stay whole. Rows that share an id count as one document, and each is reassembled by its own lines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _util as u

LEAST = 10


def key(line: str) -> bytes:
    """A line without white space at its ends, A-Z lower-cased (bytes.strip and bytes.lower are ASCII-only)."""
    return line.encode("utf-8", "surrogatepass").strip().lower()


def _lines(least: int):
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("pos", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in u.pieces(b, 2048):
                ids, rows, at, hashes = [], [], [], bytearray()
                for i, r, text in zip(*(c.to_pylist() for c in x.columns), strict=True):
                    if i is None:
                        continue
                    for pos, line in enumerate(text.split("\n")):
                        k = key(line)
                        if len(k) >= least and (len(k) >= 4 * least or len(k.decode("utf-8", "surrogatepass")) >= least):
                            ids.append(i)
                            rows.append(r)
                            at.append(pos)
                            hashes += xxhash.xxh3_128_digest(k)
                words = pa.Array.from_buffers(pa.int64(), 2 * len(ids), [None, pa.py_buffer(bytes(hashes))])
                yield u.batch(schema, [ids, rows, at, *(words.take(pa.array(range(side, 2 * len(ids), 2), type=pa.int64())) for side in (0, 1))])

    return run


def shared_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The lines to drop, one row each: doc_id, row (hash of the row's text), pos. docs: doc_id, text."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("row"), "text")
    lines = keyed.mapInArrow(_lines(least), "doc_id long, row long, pos int, h1 long, h2 long")
    keys = lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("h1", "h2", "first")
    keys = u.unkeyed(keys, "h1", "h2")
    return lines.join(keys, ["h1", "h2"]).where("doc_id <> first").select("doc_id", "row", "pos")


def _drops(docs: DataFrame, least: int) -> DataFrame:
    """Per row that loses lines: __doc, __row, __pos (a list no longer than the row's lines)."""
    drops = shared_lines(docs, least).groupBy("doc_id", "row").agg(F.collect_set("pos").alias("pos"))
    return drops.select(F.col("doc_id").alias("__doc"), F.col("row").alias("__row"), F.col("pos").alias("__pos"))


def _without(text: str, drop: list | None) -> tuple[str, int, int]:
    lines = text.split("\n")
    if not drop:
        return text, len(lines), 0
    gone = set(drop)
    return "\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone)


def line_digest(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_sha256 (of the text after dropping)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in u.pieces(b):
                ids, texts, drops = (c.to_pylist() for c in x.columns)
                out = [_without(t, d) for t, d in zip(texts, drops, strict=True)]
                yield u.batch(schema, [ids, [n for _, n, _ in out], [d for _, _, d in out], [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t, _, _ in out]])

    cols = u.id_text(docs, id_col, text_col)
    drops = _drops(cols, least)
    joined = cols.join(drops, (cols.doc_id == drops["__doc"]) & (F.xxhash64(cols.text) == drops["__row"]), "left")
    return joined.select("doc_id", "text", F.col("__pos").alias("pos")).mapInArrow(digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def drop_lines(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text", keep_emptied: bool = True) -> DataFrame:
    """docs with the shared lines gone from the text; all other columns as they are (a null text stays null). Unless
    keep_emptied, rows that lost lines and have no word left go too: all that they had is in other documents."""
    drops = _drops(u.id_text(docs, id_col, text_col), least)
    renamed = {c: u.fresh(c, docs) for c in drops.columns}
    for old, new in renamed.items():
        drops = drops.withColumnRenamed(old, new)
    doc, row, pos = renamed.values()
    at, columns = docs.columns.index(text_col), docs.columns

    def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in u.pieces(b):
                *cols, lost = x.columns
                lost = lost.to_pylist()
                texts = [t if t is None else _without(t, d)[0] for t, d in zip(cols[at].to_pylist(), lost, strict=True)]
                cols[at] = pa.array(texts, type=cols[at].type)
                out = pa.RecordBatch.from_arrays(cols, names=columns)
                if not keep_emptied:
                    out = out.filter(pa.array([not d or bool(t.strip(u.SPACE)) for t, d in zip(texts, lost, strict=True)], type=pa.bool_()))
                yield out

    joined = docs.join(drops, (docs[id_col].cast("long") == drops[doc]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == drops[row]), "left")
    return joined.select(*[docs[c] for c in columns], drops[pos]).mapInArrow(rewritten, docs.schema)

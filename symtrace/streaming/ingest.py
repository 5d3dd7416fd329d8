"""Incremental ingestion: extracts that arrive as files are imported batch by batch into the stored relations.

Rows are keyed by their addresses within a program, so a batch that is replayed after a failure adds nothing: each batch
goes through the same insert-or-ignore as a full import. Relations are stored by program, and a batch reads only the programs
that it brings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from symtrace import schemas
from symtrace.sources import store

KEYS = {"functions": ["program", "address"], "strings": ["program", "address"], "call_graph": ["program", "caller", "callee", "call_addr"], "func_string_refs": ["program", "func_addr", "string_addr", "ref_addr"]}


def read_extracts(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schemas.EXTRACT).option("multiLine", True).option("maxFilesPerTrigger", files_per_batch).json(path)


def _append(batch: DataFrame, out: str) -> None:
    spark = batch.sparkSession
    programs = [r[0] for r in batch.where("program is not null").select("program").distinct().collect()]  # of a batch's files
    for name, key in KEYS.items():
        rows = batch.where(F.col(name).isNotNull()).select("program", F.inline(name))
        path = f"{out}/{name}"
        try:
            known = spark.read.schema(rows.schema).parquet(path).where(F.col("program").isin(programs) | F.col("program").isNull())
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = None
        store.insert_or_ignore(rows, key, known).write.partitionBy("program").mode("append").parquet(path)


def ingest(extracts: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start the import of a stream of extracts into Parquet relations under out; trigger(**trigger), by default once
    for all that is there."""
    run = lambda batch, _: _append(batch, out)
    return extracts.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

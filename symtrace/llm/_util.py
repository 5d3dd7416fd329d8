"""Helpers shared by the operators of this subpackage: shared scratch space, fresh names, Arrow columns."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: blank and the six controls \t \n \v \f \r (bytes.split() splits at exactly these).
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or the checkpoint folder set by the
    caller. Where neither is set, a local one is made, but only if the executors run in the driver."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        known = sc._jsc.sc().getCheckpointDir()
        if known.isEmpty():
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="symtrace-"))
            known = sc._jsc.sc().getCheckpointDir()
        found = known.get()
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/symtrace/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._written = path
    return out


def drop_files(*frames: DataFrame) -> None:
    """Delete the files of frames that nothing reads any more; of others than materialised ones nothing is deleted."""
    for df in frames:
        if written := getattr(df, "_written", None):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(written)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def hash_sample(rows: DataFrame, n: int) -> DataFrame:
    """Of rows (h, ...), h a hash of all the rest, about n different ones at most, those with the smallest h, wherever copies
    lie. Only these are shuffled. A caller that needs the exact bound takes the n smallest h of what is left."""
    many = rows.agg(F.approx_count_distinct("h", 0.02)).first()[0]
    if many > n:
        rows = rows.where(F.col("h") < F.lit(int(-(1 << 63) + min(1.0, 1.1 * n / many) * ((1 << 64) - 1024))))
    return rows.dropDuplicates(["h"])


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, whatever the case of its letters."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that matter, renamed; a null text is the empty text. Other columns can't clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def pieces(b: pa.RecordBatch, rows: int = 512):
    """A batch in slices, so that only a few texts are Python objects at a time."""
    for at in range(0, b.num_rows, rows):
        yield b.slice(at, rows)


def unkeyed(df: DataFrame, *keys: str) -> DataFrame:
    """df, of whose partitioning by the (long) keys the planner no longer knows. A join with aggregated rows then gets
    an exchange on both sides, and only then can adaptive execution split a hot key's partition of the other side."""
    return df.withColumns({k: F.col(k).bitwiseXOR(F.lit(0).cast("long")) for k in keys})

"""Cutting the lineage of iterated frames."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The frame written as Parquet to the folder of spark.checkpoint.dir and read back: a reliable checkpoint, but in columns,
    so it takes a fraction of the disk. Where that folder is unset, a local one does if the executors run in the driver
    (tests), and is refused elsewhere. A frame that is a checkpoint already stays as it is."""
    if getattr(df, "_is_cut", False):
        return df
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="symtrace-"))
    path, schema = f"{sc._jsc.sc().getCheckpointDir().get()}/cut-{uuid.uuid4().hex}", df.schema
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._is_cut = True
    sc._jvm.System.gc()  # what the cleaner finds unused now are the shuffle files of the plan that ends here
    return out

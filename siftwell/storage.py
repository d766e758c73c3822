"""Tables between the steps of a plan, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local[...] session without it gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", made := f"file://{tempfile.mkdtemp(prefix='siftwell-')}")
    return made


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written and read again: later plans start from a short scan, and survive lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def narrowed(cells: DataFrame, *columns: str | None) -> DataFrame:
    """The given columns of all cells, stored: cells may be a join of large tables, which every pass would run anew."""
    return stored(cells.select(*dict.fromkeys(c for c in columns if c)), "cells")

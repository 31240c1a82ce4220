"""Small Spark helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of two or three numbers that may be broadcast: about 100 MB in a task at the most.
BROADCAST_ROWS = 2_000_000
#: Parts in which fixed-size arrays travel, so that no task or message holds many whole ones.
PARTS = 64


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where none is set, a temporary one, but only if driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage: what follows starts from files that outlive any executor.
    """
    path = new_path(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Hint a broadcast only after counting: a larger table keeps Spark's shuffled join.

    ``df`` should be cheap to count (a ``durable`` table).
    """
    rows = BROADCAST_ROWS if rows is None else rows
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def packed(total: np.ndarray) -> pa.RecordBatch:
    """An array as PARTS rows (part, data), compressed: what a task sends to ``merged``."""
    parts = [zlib.compress(x.tobytes(), 1) for x in np.split(total, PARTS)]
    return pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(parts, pa.binary())], ["part", "data"])


def merged(parts: DataFrame, width: int, dtype: type, combine: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Arrays of a fixed ``width`` from many tasks (rows of ``packed``), combined part by part in Spark; only one array reaches the driver."""

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = None
        for x in table.column("data"):
            own = np.frombuffer(zlib.decompress(x.as_py()), dtype)
            total = own if total is None else combine(total, own)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    out, step = np.zeros(width, dtype), width // PARTS
    for row in parts.groupBy("part").applyInArrow(add, "part int, data binary").collect():
        out[row["part"] * step : (row["part"] + 1) * step] = np.frombuffer(zlib.decompress(row["data"]), dtype)
    return out

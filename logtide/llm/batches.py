"""Arrow batches in slices of bounded size, shared by the operators here."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one call of a batch function gets (a longer text comes alone).
SLICE_BYTES = 4 << 20
LETTER = re.compile(r"[^\W\d_]")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """Only doc_id and text, so that further columns cannot clash."""
    return docs.select("doc_id", "text")


def text_or_empty() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def map_arrow(frame: DataFrame, run: Callable, schema) -> DataFrame:
    """``mapInArrow`` whose workers can import this package.

    A cluster gets the package with the job (``--py-files``). Elsewhere the
    workers are given the folder that the driver imported it from.
    """
    env = frame.sparkSession.sparkContext.environment
    root = str(Path(__file__).resolve().parents[2])
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])
    return frame.mapInArrow(run, schema)


def fold(count: int, name: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``count``; a null id reads as empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit(""))) % count


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch whose texts add up to about ``limit`` bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes, dtype=np.int64), 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def map_texts(frame: DataFrame, make: Callable, schema: str, column: str = "text", **setup) -> DataFrame:
    """Rows of ``make(**setup)``'s function over bounded slices of ``frame``.

    ``make`` runs once per task and returns a function from a RecordBatch to a
    dict of columns in the order of ``schema``. Broadcast values in ``setup``
    are opened on the executor. Python workers outlive their tasks: what a function keeps for
    later batches it gives up in its ``forget``, called when the task ends.
    """
    def run(batches):
        work = make(**{k: getattr(v, "value", v) for k, v in setup.items()})
        try:
            for batch in batches:
                for part in slices(batch, column):
                    out = work(part)
                    arrays = [v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v, types[k]) for k, v in out.items()]
                    yield pa.RecordBatch.from_arrays(arrays, names=list(out))
        finally:
            getattr(work, "forget", bool)()
            pa.default_memory_pool().release_unused()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = frame.sparkSession.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    assert isinstance(kind, StructType)
    types = {f.name: f.type for f in to_arrow_schema(kind)}
    return map_arrow(frame, run, kind)


def strings(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null reads as empty."""
    return pc.fill_null(batch.column(column), "").to_pylist()

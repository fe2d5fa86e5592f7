"""Helpers shared by the operators: table access, staged tables, checked broadcasts."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

import tillroll

from tillroll.sources.staging import stage

#: A side of a join is broadcast only after its rows were counted and are at most so many
#: (each a few numbers wide); beyond that Spark shuffles both sides.
BROADCAST_ROWS = 1_000_000

#: Bytes of the Arrow batches that pass between Spark and its Python workers, and the setting for it. Rows
#: are texts of any length, so a number of rows would not bound them.
BATCH_BYTES, BATCH_SETTING = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
SPARKS_OWN = {"64MB", "67108864", "67108864b"}

_shipped: set[str] = set()


def _given_back(function: Callable) -> Callable:
    """function, after which a worker gives the memory it no longer uses back, for it is reused by other stages."""
    def run(batches):
        yield from function(batches)
        pa.default_memory_pool().release_unused()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written once to the shared folder: later passes neither recompute it nor keep its lineage."""
    return stage(df, label)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has few rows. df should be a staged table of narrow rows."""
    return F.broadcast(df) if df.count() <= rows else df


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once: inside use it is a variable, not the expression again."""
    return F.element_at(F.transform(F.array(value), use), 1)


def meeting_route() -> Column:
    """What to partition by, besides the key, to let rows with words.routes() meet."""
    return F.when(F.col("route") > 1, F.col("route")).otherwise(0)


def map_batches(df: DataFrame, function: Callable, schema: str | StructType) -> DataFrame:
    """df.mapInArrow(function, schema), with this package sent to the executors first.

    Batches get at most BATCH_BYTES, unless the session was given another limit than Spark's own.
    """
    setting = df.sparkSession.conf
    if setting.get(BATCH_SETTING) in SPARKS_OWN:
        setting.set(BATCH_SETTING, str(BATCH_BYTES))
    context = df.sparkSession.sparkContext
    if context.applicationId not in _shipped:
        package = Path(tillroll.__file__).parent
        archive = os.path.join(tempfile.mkdtemp(prefix="tillroll-"), "tillroll.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted(package.rglob("*.py")):
                out.write(path, path.relative_to(package.parent))
        context.addPyFile(archive)
        _shipped.add(context.applicationId)
    return df.mapInArrow(_given_back(function), schema)


def keyed_texts(docs: DataFrame) -> DataFrame:
    """(doc, copy, text): doc is the doc_id, the largest long if null; copy is a hash of the text.

    doc and copy together tell rows apart that share a doc_id; rows alike in both are one.
    """
    text = F.col("text").cast("string")
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("doc"), F.xxhash64(text).alias("copy"),
        text.alias("text"))

"""Helpers that the operators share: staged tables, bounded joins, Python workers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key counts as hot when it holds over 1/HOT_SHARE of the rows, so fewer than HOT_SHARE keys are hot.
HOT_SHARE = 256
#: Stands for a null doc_id while rows are worked on: below every other.
NO_ID = -(1 << 63)
#: Bits of the bitmap that tells which rows may be in a list, for each that is listed, and at most; and bits of one part of it.
BITS_EACH, BITMAP_BITS, BITMAP_PART = 32, 1 << 26, 1 << 15

_staged: list[tuple[SparkSession, str]] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table ``documents`` under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def on_workers(spark: SparkSession) -> None:
    """Lets Python workers that start from now on import this package from where the driver has it."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep) and root not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    if root not in sys.path:
        sys.path.append(root)


def some_id(name: str = "doc_id") -> Column:
    """A column of ids with NO_ID in place of null."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def given_id(name: str = "doc_id") -> Column:
    """The other way round."""
    return F.when(F.col(name) != NO_ID, F.col(name))


def trimmed(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that hands free memory back when it ends: an idle Python worker still counts against its executor."""
    def run(batches: Iterator) -> Iterator:
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only glibc has it
                ctypes.CDLL(None).malloc_trim(0)

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, a temporary one under a local master and an error on a cluster."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="mapweave-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends at files that outlive any executor.

    The files go when the session's driver exits, or earlier by ``unstage``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _staged.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(df: DataFrame) -> None:
    """Deletes the files behind a staged table that no later plan reads."""
    path = getattr(df, "_staged_at", None)
    if path:
        _delete(df.sparkSession, path)
        _staged[:] = [x for x in _staged if x[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _staged:
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone by now
            return


def join_counted(big: DataFrame, small: DataFrame, key: str, size: str, total: int, salt_by: Column) -> DataFrame:
    """``big`` left-joined to ``small``, which has one row for each ``key`` and in ``size`` the rows of ``big`` with it.

    Keys with over 1/HOT_SHARE of ``total`` rows (fewer than HOT_SHARE keys, so their list may be broadcast) are dealt
    over as many salts as keep each part below that share; the rest joins by key. Null-safe on neither side: ``key`` isn't null.
    """
    parts = F.ceil(F.col(size) * F.lit(HOT_SHARE) / F.lit(max(1, total))).cast("int")
    sized = small.withColumn("_parts", F.greatest(parts, F.lit(1)))
    hot = sized.where("_parts > 1").select(key, F.col("_parts").alias("_hot_parts"))
    left = big.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.when(F.col("_hot_parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(salt_by), F.col("_hot_parts")).cast("int")))
    right = sized.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts", size)
    return left.drop("_hot_parts").join(right, [key, "_salt"], "left").drop("_salt")


def listed(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` with ``_listed``: true for all whose ``on`` is in the staged table ``keys`` and, as a bitmap of hashes answers, for a few that aren't.

    The bitmap has BITMAP_BITS at most and is broadcast, so rows that aren't listed needn't be shipped however long the list
    is; with very long lists more of them are. Both sides have the same types.
    """
    bits = min(BITMAP_BITS, max(BITMAP_PART, 1 << (BITS_EACH * keys.count()).bit_length()))
    at, last = F.pmod(F.xxhash64(*on), F.lit(bits)), BITMAP_PART.bit_length() - 1
    places = keys.select(F.shiftright(at, last).alias("_part"), at.bitwiseAND(BITMAP_PART - 1).alias("_bit"))
    maps = places.repartition("_part").groupBy("_part").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    byte = F.conv(F.hex(F.substring(F.col("_map"), (F.shiftright("_at", 3) % (BITMAP_PART // 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    asked = rows.withColumn("_at", at).withColumn("_part", F.shiftright("_at", last)).join(F.broadcast(maps), "_part", "left")
    return asked.withColumn("_listed", F.coalesce(F.getbit(byte, (F.col("_at") % 8).cast("int")), F.lit(0)) == 1).drop("_at", "_part", "_map")


def unlisted(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` without those whose ``on`` is in the staged table ``keys``; only rows that may be are shipped."""
    asked = listed(rows, keys, on)
    return asked.where("not _listed").drop("_listed").unionByName(asked.where("_listed").drop("_listed").join(keys, on, "left_anti").select(*rows.columns))

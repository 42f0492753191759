"""Semi-join closure to a fixpoint, and the shared folder that cuts its lineage."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

MAX_ROUNDS = 1000


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; where that is unset, a temporary folder under a local master and an error on a cluster."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        known = spark.conf.get("spark.checkpoint.dir", None)
        if not known and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(known or tempfile.mkdtemp(prefix="mapweave-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and cut from its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def closure(start: DataFrame, edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Ids reachable from ``start`` (id) over ``edges`` (src, dst), themselves included; cycles end by the anti-join on what is known.

    Every round is a written table of the ids new in it; what is known is their union, which is never written again.
    """
    rounds = [checkpointed(start.select("id").distinct())]
    for _ in range(MAX_ROUNDS):
        step = edges.join(rounds[-1].withColumnRenamed("id", src), src, "left_semi").select(edges[dst].alias("id")).distinct()
        seen = reduce(DataFrame.unionAll, rounds)
        front = checkpointed(step.join(seen, "id", "left_anti"))
        if front.isEmpty():
            return seen
        rounds.append(front)
    raise RuntimeError(f"no fixpoint in {MAX_ROUNDS} rounds")

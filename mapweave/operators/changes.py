"""Change streams: order, last change, merging, application."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.model import Dataset


def merge_changes(streams: list[DataFrame]) -> DataFrame:
    """Streams one after the other: ``seq`` becomes (stream, seq), which orders the result."""
    parts = [s.withColumn("stream", F.lit(k)) for k, s in enumerate(streams)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def last_change(changes: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The last change of each (kind, id). A maximum that combines before the shuffle, so a hot element is no hot task."""
    order = order or [c for c in ("stream", "seq") if c in changes.columns]
    rest = [c for c in changes.columns if c not in ("kind", "id")]
    top = changes.groupBy("kind", "id").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_c"))
    return top.select("kind", "id", "_c.*")


def simplify(changes: DataFrame) -> DataFrame:
    """The last change of each element with its place: creates, modifies, deletes, each by kind and id."""
    group = F.when(F.col("action") == "create", 0).when(F.col("action") == "modify", 1).otherwise(2)
    kind = F.when(F.col("kind") == "n", 0).when(F.col("kind") == "w", 1).otherwise(2)
    return last_change(changes).withColumns({"action_rank": group, "kind_rank": kind})


def apply_changes(base: DataFrame, changes: DataFrame, kind: str, whole: bool = False) -> DataFrame:
    """``base`` after the last change of each id: deleted rows go, creates and modifies replace or add, whatever was there before.

    Deleting what isn't there does nothing; versions aren't compared. ``whole`` takes changes of one moment, each id's
    with all its new elements (``derive_whole``), so that elements which share an id all stand.
    """
    mine = changes.where(F.col("kind") == kind)
    last = mine if whole else last_change(mine)
    columns = base.columns
    kept = base.join(last.select("id"), "id", "left_anti").select(columns)
    return kept.unionByName(last.where("action <> 'delete'").select(columns))


def located_changes(base: Dataset, changes: DataFrame) -> DataFrame:
    """(way_id, pos, node_id, lat_e7, lon_e7) of created and modified ways: from changed nodes, else base nodes, else (0, 0).

    Ways of the base that no change touches keep what they store, even where a node moved.
    """
    last = last_change(changes)
    ways = last.where("kind = 'w' and action <> 'delete'").select(F.col("id").alias("way_id"), F.posexplode("refs").alias("pos", "node_id"))
    moved = last.where("kind = 'n' and action <> 'delete'").select(F.col("id").alias("node_id"), F.col("lat_e7").alias("_lat"), F.col("lon_e7").alias("_lon"))
    old = base.nodes.select(F.col("id").alias("node_id"), F.col("lat_e7").alias("_blat"), F.col("lon_e7").alias("_blon"))
    rows = ways.join(moved, "node_id", "left").join(old, "node_id", "left")
    return rows.select("way_id", "pos", "node_id", F.coalesce("_lat", "_blat", F.lit(0)).alias("lat_e7"), F.coalesce("_lon", "_blon", F.lit(0)).alias("lon_e7"))

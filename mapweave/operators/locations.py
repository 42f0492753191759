"""Node locations on ways."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.functions.tags import tag_value
from mapweave.model import Dataset


def located_refs(ds: Dataset) -> DataFrame:
    """(way_id, pos, node_id, lat_e7, lon_e7, found) of every way ref; a missing node, or one at (0, 0), counts as missing with (0, 0)."""
    nodes = ds.nodes.select(F.col("id").alias("node_id"), "lat_e7", "lon_e7")
    joined = ds.way_refs.join(nodes, "node_id", "left")
    lat, lon = (F.coalesce(F.col(c), F.lit(0)) for c in ("lat_e7", "lon_e7"))
    return joined.select("way_id", "pos", "node_id", lat.alias("lat_e7"), lon.alias("lon_e7"), ((lat != 0) | (lon != 0)).alias("found"))


def add_locations(ds: Dataset) -> DataFrame:
    """Ways with an array of locations in the order of their refs. A group gathers one way's refs, which formats bound."""
    rows = located_refs(ds)
    place = F.struct("pos", F.struct("lat_e7", "lon_e7").alias("at"))
    got = rows.groupBy("way_id").agg(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["at"]).alias("locations"), F.count_if(~F.col("found")).alias("n_missing"))
    base = ds.ways.drop("locations")
    return base.join(got.withColumnRenamed("way_id", "id"), "id", "left")


def kept_nodes(ds: Dataset, keep_all: bool = False) -> DataFrame:
    """Nodes that stay beside located ways: all of them, or the tagged ones and members of relations."""
    if keep_all:
        return ds.nodes
    members = ds.rel_members.where("mtype = 'n'").select(F.col("ref").alias("id"), F.lit(True).alias("_member")).distinct()
    return ds.nodes.join(members, "id", "left").where((F.size("tags") > 0) | F.col("_member")).drop("_member")


def prepass(ds: Dataset) -> tuple[DataFrame, DataFrame]:
    """What readers of located ways want to know: ids of ways in multipolygon or boundary relations, and ids of nodes that two or more ways use."""
    whole = ds.relations.where(tag_value("type").isin("multipolygon", "boundary")).select(F.col("id").alias("rel_id"))
    ways = ds.rel_members.where("mtype = 'w'").join(whole, "rel_id", "left_semi").select(F.col("ref").alias("id")).distinct()
    shared = ds.way_refs.groupBy("node_id").agg(F.count_distinct("way_id").alias("n")).where("n >= 2").select(F.col("node_id").alias("id"))
    return ways, shared

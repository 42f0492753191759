"""Selection by id: getid, removeid, parents."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.model import Dataset


def parse_ids(specs: list[str], default: str = "n") -> list[tuple[str, int]]:
    """``n1``, ``w2``, ``r3``; a bare number is of the default kind. Negative ids are rejected."""
    out = []
    for spec in specs:
        m = re.fullmatch(r"([nwr]?)(-?\d+)", spec.strip())
        if not m:
            raise ValueError(f"not an id: {spec!r}")
        if int(m[2]) < 0:
            raise ValueError(f"negative id: {spec!r}")
        out.append((m[1] or default, int(m[2])))
    return out


def read_ids(spark: SparkSession, path: str, default: str = "n") -> DataFrame:
    """(kind, id) from a text file with one id a line; ``#`` starts a comment. Parsed by executors, so a long list isn't gathered."""
    line = F.trim(F.regexp_replace("value", "#.*$", ""))
    rows = spark.read.text(path).select(line.alias("s")).where("s <> ''")
    kind = F.regexp_extract("s", r"^([nwr]?)\d+$", 1)
    return rows.select(F.when(kind == "", default).otherwise(kind).alias("kind"), F.regexp_extract("s", r"^[nwr]?(\d+)$", 1).cast("bigint").alias("id")).distinct()


def id_table(spark: SparkSession, ids: list[tuple[str, int]]) -> DataFrame:
    return spark.createDataFrame(ids or [], "kind string, id bigint").distinct()


def _of(ids: DataFrame, kind: str) -> DataFrame:
    return ids.where(F.col("kind") == kind).select("id")


def getid(ds: Dataset, ids: DataFrame, add_referenced: bool = False) -> Dataset:
    """The listed elements; with ``add_referenced`` the nodes of listed ways too. Members of relations are not added."""
    nodes = _of(ids, "n")
    if add_referenced:
        way_nodes = ds.way_refs.join(_of(ids, "w").withColumnRenamed("id", "way_id"), "way_id", "left_semi")
        nodes = nodes.unionAll(way_nodes.select(F.col("node_id").alias("id")))
    return ds.keep(nodes, _of(ids, "w"), _of(ids, "r"))


def removeid(ds: Dataset, ids: DataFrame) -> Dataset:
    """Everything but the listed elements."""
    part = lambda df, k, key: df.join(_of(ids, k).withColumnRenamed("id", key), key, "left_anti") if df is not None else None
    return Dataset(part(ds.nodes, "n", "id"), part(ds.ways, "w", "id"), part(ds.relations, "r", "id"), part(ds.refs, "w", "way_id"), part(ds.members, "r", "rel_id"))


def missing(ds: Dataset, ids: DataFrame) -> DataFrame:
    """Listed ids that the dataset lacks."""
    return ids.join(ds.ids(), ["kind", "id"], "left_anti")


def parents(ds: Dataset, ids: DataFrame, add_self: bool = False) -> DataFrame:
    """(kind, id) of ways that use a listed node and relations with a listed member, one step up; with ``add_self`` the listed elements that exist."""
    ways = ds.way_refs.join(_of(ids, "n").withColumnRenamed("id", "node_id"), "node_id", "left_semi").select(F.lit("w").alias("kind"), F.col("way_id").alias("id"))
    wanted = ids.select(F.col("kind").alias("mtype"), F.col("id").alias("ref"))
    rels = ds.rel_members.join(wanted, ["mtype", "ref"], "left_semi").select(F.lit("r").alias("kind"), F.col("rel_id").alias("id"))
    found = ways.unionAll(rels)
    if add_self:
        found = found.unionAll(ids.join(ds.ids(), ["kind", "id"], "left_semi"))
    return found.distinct()

"""Projections and tag filters over datasets."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.functions.tags import Expression, matches
from mapweave.model import Dataset
from mapweave.operators.fixpoint import closure

ATTRIBUTES = ("version", "changeset", "timestamp", "uid", "user")


def only_kinds(ds: Dataset, kinds: str) -> Dataset:
    """Elements of the kinds in ``kinds`` (letters n, w, r)."""
    part = lambda df, k: df if k in kinds else df.limit(0)
    return Dataset(part(ds.nodes, "n"), part(ds.ways, "w"), part(ds.relations, "r"), ds.refs if "w" in kinds else ds.way_refs.limit(0), ds.members if "r" in kinds else ds.rel_members.limit(0))


def clean(df: DataFrame, attributes: list[str]) -> DataFrame:
    """Zeroes the chosen attributes (an empty user) where metadata exist; rows without metadata stay without."""
    unknown = set(attributes) - set(ATTRIBUTES)
    if unknown:
        raise ValueError(f"unknown attributes: {sorted(unknown)}")
    info = F.col("info")
    for a in attributes:
        name = "ts_s" if a == "timestamp" else a
        info = info.withField(name, F.lit("") if a == "user" else F.lit(0).cast("bigint" if name in ("ts_s", "changeset") else "int"))
    return df.withColumn("info", F.when(F.col("info").isNotNull(), info))


def strip_tags(df: DataFrame, unless: Column) -> DataFrame:
    """Drops the tags of rows that don't meet ``unless``."""
    return df.withColumn("tags", F.when(unless, F.col("tags")).otherwise(F.array().cast(df.schema["tags"].dataType)))


def direct(ds: Dataset, expressions: list[Expression | str], invert: bool = False) -> Dataset:
    """Elements that match themselves; inverted, those that don't."""
    test = lambda kind: matches(expressions, kind) != F.lit(invert)
    ways, relations = ds.ways.where(test("w")), ds.relations.where(test("r"))
    refs = ds.refs.join(ways.select(F.col("id").alias("way_id")), "way_id", "left_semi") if ds.refs is not None else None
    members = ds.members.join(relations.select(F.col("id").alias("rel_id")), "rel_id", "left_semi") if ds.members is not None else None
    return Dataset(ds.nodes.where(test("n")), ways, relations, refs, members)


def with_referenced(ds: Dataset, expressions: list[Expression | str], invert: bool = False) -> DataFrame:
    """(kind, id, reason) of matching elements and what they need: 1 matches itself, 2 a node of a matching way, 3 reached from a matching relation.

    Relations pull their member nodes, ways and relations, to a fixpoint; ways reached so pull their nodes. The least reason counts.
    """
    own = direct(ds, expressions, invert)
    reach = closure(own.relations, ds.rel_members.where("mtype = 'r'").select("rel_id", "ref"), "rel_id", "ref")
    inner = ds.rel_members.join(reach.withColumnRenamed("id", "rel_id"), "rel_id", "left_semi")
    rel_ways = inner.where("mtype = 'w'").select(F.col("ref").alias("id")).distinct()
    nodes_of = lambda ways: ds.way_refs.join(ways.select(F.col("id").alias("way_id")), "way_id", "left_semi").select(F.col("node_id").alias("id"))
    tagged = lambda df, kind, why: df.select(F.lit(kind).alias("kind"), "id", F.lit(why).alias("reason"))
    parts = [
        tagged(own.nodes, "n", 1), tagged(own.ways, "w", 1), tagged(own.relations, "r", 1), tagged(nodes_of(own.ways), "n", 2),
        tagged(inner.where("mtype = 'n'").select(F.col("ref").alias("id")), "n", 3), tagged(nodes_of(rel_ways), "n", 3),
        tagged(rel_ways, "w", 3), tagged(reach, "r", 3),
    ]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionAll(p)
    best = found.groupBy("kind", "id").agg(F.min("reason").alias("reason"))
    return best.join(ds.ids(), ["kind", "id"], "left_semi")


def tags_filter(ds: Dataset, expressions: list[Expression | str], invert: bool = False, references: bool = True, remove_tags: bool = False) -> Dataset:
    """The filtered dataset; ``remove_tags`` takes the tags of what is there only for reference."""
    if not references:
        return direct(ds, expressions, invert)
    found = with_referenced(ds, expressions, invert)
    part = lambda k: found.where(F.col("kind") == k).select("id", "reason")
    kept = ds.keep(part("n"), part("w"), part("r"))
    if not remove_tags:
        return kept
    bare = lambda df, k: strip_tags(df.join(part(k), "id"), F.col("reason") == 1).drop("reason")
    return replace(kept, nodes=bare(ds.nodes, "n"), ways=bare(ds.ways, "w"), relations=bare(ds.relations, "r"))


def filter_changes(changes: DataFrame, expressions: list[Expression | str]) -> DataFrame:
    """Creates and modifies that match, and all deletes; metadata go."""
    test = F.lit(False)
    for kind in "nwr":
        test = test | ((F.col("kind") == kind) & F.coalesce(matches(expressions, kind), F.lit(False)))
    out = changes.where((F.col("action") == "delete") | test)
    return out.withColumn("info", F.lit(None).cast(out.schema["info"].dataType)) if "info" in out.columns else out

"""A dataset of map elements as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dataset:
    """Nodes, ways and relations. ``refs`` (way_id, pos, node_id) and ``members`` (rel_id, pos, mtype, ref, role) are long tables
    that joins work on; where they aren't given they are unfolded from the arrays of ways and relations.
    """

    nodes: DataFrame
    ways: DataFrame
    relations: DataFrame
    refs: DataFrame | None = None
    members: DataFrame | None = None

    @property
    def way_refs(self) -> DataFrame:
        if self.refs is not None:
            return self.refs
        return self.ways.select(F.col("id").alias("way_id"), F.posexplode("refs").alias("pos", "node_id"))

    @property
    def rel_members(self) -> DataFrame:
        if self.members is not None:
            return self.members
        m = self.relations.select(F.col("id").alias("rel_id"), F.posexplode("members").alias("pos", "m"))
        return m.select("rel_id", "pos", F.col("m.type").alias("mtype"), F.col("m.ref").alias("ref"), F.col("m.role").alias("role"))

    def by_kind(self) -> dict[str, DataFrame]:
        return {"n": self.nodes, "w": self.ways, "r": self.relations}

    def ids(self) -> DataFrame:
        """(kind, id) of every element."""
        n, w, r = (df.select(F.lit(k).alias("kind"), "id") for k, df in self.by_kind().items())
        return n.unionAll(w).unionAll(r)

    def tags(self) -> DataFrame:
        """(kind, id, k, v), a row a tag."""
        n, w, r = (df.select(F.lit(k).alias("kind"), "id", F.explode("tags").alias("t")) for k, df in self.by_kind().items())
        return n.unionAll(w).unionAll(r).select("kind", "id", F.col("t.k").alias("k"), F.col("t.v").alias("v"))

    def keep(self, nodes: DataFrame | None = None, ways: DataFrame | None = None, relations: DataFrame | None = None) -> Dataset:
        """The elements whose id is in the given tables (column ``id``); a kind without a table goes."""
        part = lambda df, ids: df.join(ids.select("id"), "id", "left_semi") if ids is not None else df.limit(0)
        return replace(self, nodes=part(self.nodes, nodes), ways=part(self.ways, ways), relations=part(self.relations, relations), refs=self._long(self.refs, "way_id", ways), members=self._long(self.members, "rel_id", relations))

    @staticmethod
    def _long(rows: DataFrame | None, key: str, ids: DataFrame | None) -> DataFrame | None:
        if rows is None:
            return None
        return rows.join(ids.select(F.col("id").alias(key)), key, "left_semi") if ids is not None else rows.limit(0)


def id_key(column: str = "id") -> list:
    """Sort keys of the canonical order: 0, then negative ids by absolute value, then positive ids."""
    c = F.col(column)
    return [F.when(c > 0, 2).when(c == 0, 0).otherwise(1), F.when(c == -9223372036854775808, F.lit(9223372036854775807)).otherwise(F.abs(c))]

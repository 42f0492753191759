"""Snapshot differences and the changes that lead from one to the other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What makes two elements of one kind equal; metadata and inline locations don't.
CONTENT = {"n": ("lat_e7", "lon_e7", "tags"), "w": ("refs", "tags"), "r": ("tags", "members")}


def _same(kind: str, a: str, b: str) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in CONTENT[kind]])


def _pairs(old: DataFrame, new: DataFrame, kind: str) -> DataFrame:
    """Old and new elements (structs ``o`` and ``n``) by a full outer join on id, with ``status``: created, deleted, modified or common."""
    side = lambda df, c: df.select(F.col("id").alias(f"_{c}"), F.struct(*df.columns).alias(c))
    pair = side(old, "o").join(side(new, "n"), F.col("_o") == F.col("_n"), "full_outer")
    status = F.when(F.col("_o").isNull(), "created").when(F.col("_n").isNull(), "deleted").when(_same(kind, "o", "n"), "common").otherwise("modified")
    return pair.select(F.coalesce("_o", "_n").alias("id"), status.alias("status"), "o", "n")


def diff(old: DataFrame, new: DataFrame, kind: str) -> DataFrame:
    """(kind, id, status, old_version, new_version) by a full outer join on id; status is created, deleted, modified or common."""
    version = lambda side: F.col(f"{side}.info.version") if "info" in old.columns and "info" in new.columns else F.lit(None).cast("int")
    return _pairs(old, new, kind).select(F.lit(kind).alias("kind"), "id", "status", version("o").alias("old_version"), version("n").alias("new_version"))


def summary(found: DataFrame) -> DataFrame:
    """One row: created, modified, deleted, common, and left, right, same, different."""
    n = lambda s: F.count_if(F.col("status") == s)
    return found.agg(n("created").alias("created"), n("modified").alias("modified"), n("deleted").alias("deleted"), n("common").alias("common"),
                     (n("deleted") + n("modified") + n("common")).alias("left"), (n("created") + n("modified") + n("common")).alias("right"),
                     n("common").alias("same"), (n("created") + n("modified") + n("deleted")).alias("different"))


def lines(found: DataFrame, suppress_common: bool = False) -> DataFrame:
    """Text lines of a difference: a mark, kind and id, and versions where they are known (both where they differ)."""
    mark = F.when(F.col("status") == "created", "+").when(F.col("status") == "deleted", "-").when(F.col("status") == "modified", "*").otherwise(" ")
    v = F.coalesce("new_version", "old_version")
    one = F.when(v.isNotNull(), F.concat(F.lit(" v"), v.cast("string"))).otherwise("")
    both = F.concat(F.lit(" v"), F.col("old_version").cast("string"), F.lit(" -> v"), F.col("new_version").cast("string"))
    tail = F.when((F.col("status") == "modified") & (F.col("old_version") != F.col("new_version")), both).otherwise(one)
    rows = found.where("status <> 'common'") if suppress_common else found
    return rows.select("kind", "id", F.concat(mark, "kind", F.col("id").cast("string"), tail).alias("line"))


def derive_changes(old: DataFrame, new: DataFrame, kind: str, increment_version: bool = False) -> DataFrame:
    """Changes from ``old`` to ``new``: creates and modifies with the whole new element, deletes with the old version (raised by one on request).

    A change for each differing pair of an old and a new element of one id, so ids that occur more than once give as many changes as they have pairs.
    """
    found = _pairs(old, new, kind).where("status <> 'common'")
    action = F.when(F.col("status") == "created", "create").when(F.col("status") == "modified", "modify").otherwise("delete")
    rows = [F.col(f"n.{c}").alias(c) for c in new.columns if c not in ("id", "info", "kind")]
    if "info" in new.columns:
        kinds = {f.name: f.dataType for f in new.schema["info"].dataType}
        version = F.col("o.info.version") + (1 if increment_version else 0) if "info" in old.columns else F.lit(None)
        gone = F.struct(*[(version if n == "version" else F.lit(None)).cast(t).alias(n) for n, t in kinds.items()])
        rows.append(F.when(F.col("status") == "deleted", gone).otherwise(F.col("n.info")).alias("info"))
    return found.select("id", action.alias("action"), *rows, F.lit(kind).alias("kind"))


def derive_whole(old: DataFrame, new: DataFrame, kind: str) -> DataFrame:
    """The same where ids may occur more than once: an id that differs in any element, or in how many it has, is given with all its new elements.

    For ``apply_changes(whole=True)``, which puts them in place of all old ones.
    """
    count = lambda df, a, b: df.select("id", F.lit(a).alias("a"), F.lit(b).alias("b"))
    sizes = count(old, 1, 0).unionAll(count(new, 0, 1)).groupBy("id").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    other = _pairs(old, new, kind).where("status = 'modified'").select("id").distinct().withColumn("_differs", F.lit(True))
    found = sizes.join(other, "id", "left").where("a <> b or _differs")
    ups = found.where("b > 0").select("id", F.when(F.col("a") == 0, "create").otherwise("modify").alias("action")).join(new.drop("kind"), "id").withColumn("kind", F.lit(kind))
    gone = found.where("b = 0").select("id", F.lit("delete").alias("action"), F.lit(kind).alias("kind"))
    return ups.unionByName(gone, allowMissingColumns=True)

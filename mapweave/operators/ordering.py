"""Order: sorting, ranks, duplicates, chunks, and checks of order."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mapweave.model import Dataset, id_key
from mapweave.operators.fixpoint import checkpointed

#: Elements that a block holds by default (fixed value).
BLOCK = 8000


def kind_rank(kind: str | Column = "kind") -> Column:
    c = F.col(kind) if isinstance(kind, str) else kind
    return F.when(c == "n", 0).when(c == "w", 1).otherwise(2)


def sort_elements(df: DataFrame) -> DataFrame:
    """By kind, canonical id order, version (missing first). One range exchange; every task writes a run of its own."""
    return df.orderBy(kind_rank(), *id_key(), F.col("version").asc_nulls_first()) if "version" in df.columns else df.orderBy(kind_rank(), *id_key())


#: Rows that one task numbers, about, and ranges at most.
RANGE_ROWS = 2_000_000
MAX_RANGES = 8192


def range_of(key: Column, cuts: list[float]) -> Column:
    """How many of the ascending ``cuts`` are below the key, by halving."""
    bounds, step = F.array(*map(F.lit, cuts)), 1 << max(0, len(cuts).bit_length() - 1)
    steps = []
    while step:
        steps.append(step)
        step >>= 1
    further = lambda at, s: F.when(F.get(bounds, at + s - 1) < key, at + s).otherwise(at)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), further)


def numbered(df: DataFrame, by: list[str], key: Column, parts: int | None = None) -> DataFrame:
    """Adds ``place``: each row's number from 0 in its group ``by``, in the order of the integer ``key`` (unique in a group).

    Rows are numbered in ranges of the key and the sizes of a group's earlier ranges added, so no task sees a whole
    group. There is a range for about RANGE_ROWS rows, cut at approximate quantiles, which only balance the work.
    """
    rows = df.withColumn("_key", key)
    parts = parts or min(MAX_RANGES, df.count() // RANGE_ROWS + 1)
    cuts = sorted(set(rows.approxQuantile("_key", [i / parts for i in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    ranged = rows.withColumn("_part", range_of(F.col("_key").cast("double"), [float(c) for c in cuts]) if cuts else F.lit(0))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy(*by, "_part").count().select(*by, "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    ranked = ranged.withColumn("_rank", F.row_number().over(Window.partitionBy(*by, "_part").orderBy("_key")))
    return ranked.join(offsets, [*by, "_part"]).withColumn("place", F.col("_before") + F.col("_rank") - 1).drop("_key", "_part", "_before", "_rank")


def canonical(column: str = "id") -> Column:
    """One number that sorts ids canonically: 0, -1, -2, ... before 1, 2, ... (ids below 2^62 in size)."""
    c = F.col(column)
    return F.when(c > 0, c).otherwise(F.lit(-(1 << 62)) - c)


def rank_by_id(ids: DataFrame, start: int = 0, parts: int | None = None) -> DataFrame:
    """(id, new_id): ``start`` plus the rank of each id in ascending order."""
    ranked = numbered(ids.select("id", F.lit(0).alias("_all")).distinct(), ["_all"], F.col("id"), parts)
    return ranked.select("id", (F.col("place") + start).alias("new_id"))


def placed(df: DataFrame) -> DataFrame:
    """Adds ``place``: each row's number from 0 in the order that ``df`` stands in, by its partitions and inside them.

    The ordered rows are written once, so that both looks at them see the same partitions; the table of their sizes has a row a partition.
    """
    rows = checkpointed(df.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(F.broadcast(sizes.select("_part", "_first", before.alias("_before"))), "_part").withColumn("place", F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_before")


#: Places that one task compares at once.
STRETCH = 1_000_000


def with_previous(df: DataFrame) -> DataFrame:
    """Adds ``prev``: the id one place before in the kind's file order (column ``pos``).

    Inside a stretch of places by a window; the first of a stretch takes the last id of the kind's stretch before.
    """
    rows = df.withColumn("_stretch", F.floor(F.col("pos") / F.lit(float(STRETCH))))
    ends = rows.groupBy("kind", "_stretch").agg(F.max_by("id", "pos").alias("_last"))
    ends = ends.select("kind", "_stretch", F.lag("_last").over(Window.partitionBy("kind").orderBy("_stretch")).alias("_last"))
    inside = rows.withColumn("_prev", F.lag("id").over(Window.partitionBy("kind", "_stretch").orderBy("pos")))
    return inside.join(ends, ["kind", "_stretch"]).withColumn("prev", F.coalesce("_prev", "_last")).drop("_stretch", "_prev", "_last")


def renumber(ds: Dataset, start: tuple[int, int, int] = (1, 1, 1)) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """New ids by kind, and refs and members rewritten. References to what isn't there keep their id. A negative id is an error."""
    if not ds.ids().where("id < 0").isEmpty():
        raise ValueError("negative ids can't be renumbered")
    maps = {k: rank_by_id(df, s) for (k, df), s in zip(ds.by_kind().items(), start, strict=True)}

    def mapped(rows: DataFrame, key: str, kind: str) -> DataFrame:
        m = maps[kind].select(F.col("id").alias(key), F.col("new_id").alias("_new"))
        return rows.join(m, key, "left").withColumn(key, F.coalesce("_new", key)).drop("_new")

    refs = mapped(mapped(ds.way_refs, "node_id", "n"), "way_id", "w")
    parts = [mapped(ds.rel_members.where(F.col("mtype") == k), "ref", k) for k in "nwr"]
    other = ds.rel_members.where(~F.col("mtype").isin("n", "w", "r"))
    members = mapped(reduce(DataFrame.unionByName, [*parts, other]), "rel_id", "r")
    return maps, refs, members


def dedupe(files: list[DataFrame]) -> DataFrame:
    """The union of sorted files without repeats of one (kind, id, version); the first file's row stays, other versions all stay."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.withColumn("_file", F.lit(k)) for k, f in enumerate(files)])
    rest = [c for c in rows.columns if c not in ("kind", "id", "version")]
    return rows.groupBy("kind", "id", "version").agg(F.min_by(F.struct(*rest), "_file").alias("_e")).select("kind", "id", "version", "_e.*").drop("_file")


def cat(files: list[DataFrame], kinds: str = "nwr") -> DataFrame:
    """The union of all files' rows of the given kinds."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), files)
    return rows.where(F.col("kind").isin(*kinds))


def blocks(df: DataFrame, size: int = BLOCK) -> DataFrame:
    """Adds ``block``: each kind's elements in canonical id order, ``size`` to a block. Physical files bound rows by ``maxRecordsPerFile`` instead."""
    return numbered(df, ["kind"], canonical()).withColumn("block", F.floor(F.col("place") / F.lit(float(size))).cast("bigint")).drop("place")


def unsort(df: DataFrame, at: int = 1) -> DataFrame:
    """(kind, id, place) in file order with elements number ``at`` and ``at`` + 1 of each kind exchanged, where both exist."""
    rows = numbered(df, ["kind"], canonical()).withColumn("place", F.col("place") + 1)
    sizes = df.groupBy("kind").agg(F.count("*").alias("_size"))
    swapped = F.when((F.col("place") == at) & (F.col("_size") > at), at + 1).when(F.col("place") == at + 1, at).otherwise(F.col("place"))
    return rows.join(F.broadcast(sizes), "kind").withColumn("place", swapped.cast("bigint")).drop("_size")  # a row a kind


def check_ids(df: DataFrame, max_errors: int = 0) -> DataFrame:
    """(kind, pos, id, prev) where an id isn't above the one before it in its kind's file order (column ``pos``); 0 is no limit."""
    bad = with_previous(df).select("kind", "pos", "id", "prev").where("id <= prev")
    return bad.orderBy("kind", "pos").limit(max_errors) if max_errors else bad


def duplicates(df: DataFrame) -> DataFrame:
    """(kind, id, extra) of ids that occur more than once in a kind, with how many are too many."""
    return df.groupBy("kind", "id").agg((F.count("*") - 1).alias("extra")).where("extra > 0")


def type_order(df: DataFrame) -> DataFrame:
    """(before, after, first_after, last_before) for node/way and way/relation where an element of the later kind comes before the earlier kind's last one."""
    ends = df.groupBy("kind").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    a, b = ends.alias("a"), ends.alias("b")
    pair = ((F.col("a.kind") == "n") & (F.col("b.kind") == "w")) | ((F.col("a.kind") == "w") & (F.col("b.kind") == "r"))
    return a.join(b, pair).where("b.first < a.last").select(F.col("a.kind").alias("before"), F.col("b.kind").alias("after"), F.col("b.first").alias("first_after"), F.col("a.last").alias("last_before"))


def segments(block_table: DataFrame) -> DataFrame:
    """Runs of one kind in a table of blocks (block, kind): (segment, kind, n_blocks).

    Runs are counted inside stretches of blocks; a stretch takes the kind before it and the runs of earlier ones from a table with a row a stretch.
    """
    rows = block_table.withColumn("_stretch", F.floor(F.col("block") / F.lit(float(STRETCH))))
    inside, over = Window.partitionBy("_stretch").orderBy("block"), Window.orderBy("_stretch")
    starts = rows.withColumn("_new", F.when(F.col("kind") == F.lag("kind").over(inside), 0).otherwise(1))
    ends = starts.groupBy("_stretch").agg(F.min_by("kind", "block").alias("_first"), F.max_by("kind", "block").alias("_last"), F.sum("_new").alias("_runs"))
    joined = F.when(F.col("_first") == F.lag("_last").over(over), 1).otherwise(0)  # the first run goes on from the stretch before
    ends = ends.withColumn("_joined", joined).withColumn("_own", F.col("_runs") - F.col("_joined"))
    ends = ends.select("_stretch", (F.coalesce(F.sum("_own").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("_joined")).alias("_before"))
    named = starts.withColumn("_run", F.sum("_new").over(inside)).join(F.broadcast(ends), "_stretch").withColumn("segment", F.col("_run") + F.col("_before"))
    return named.groupBy("segment", "kind").agg(F.count("*").alias("n_blocks"))


def missing_refs(ds: Dataset) -> DataFrame:
    """(way_id, node_id) of refs whose node isn't there, every occurrence."""
    return ds.way_refs.join(ds.nodes.select(F.col("id").alias("node_id")), "node_id", "left_anti").select("way_id", "node_id")


def missing_members(ds: Dataset) -> DataFrame:
    """(rel_id, mtype, ref) of members whose element isn't there, every occurrence; members of unknown kind are passed over."""
    known = ds.ids().select(F.col("kind").alias("mtype"), F.col("id").alias("ref"))
    return ds.rel_members.where(F.col("mtype").isin("n", "w", "r")).join(known, ["mtype", "ref"], "left_anti").select("rel_id", "mtype", "ref")


def drop_hash(kind: Column, id_: Column, seed: int) -> Column:
    """The selection hash of an element as an unsigned decimal."""

    @F.pandas_udf("decimal(20,0)")
    def run(kinds: pd.Series, ids: pd.Series) -> pd.Series:
        with np.errstate(over="ignore"):
            z = ids.to_numpy(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            z = z ^ (kinds.to_numpy(np.uint64) * np.uint64(0xD1B54A32D192ED03)) ^ np.uint64(seed)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            z ^= z >> np.uint64(31)
        return pd.Series([Decimal(int(x)) for x in z])

    return run(kind, id_)


def drop_ids(df: DataFrame, count: int, seed: int) -> DataFrame:
    """The ``count`` elements (kind, id, hash) of smallest hash, which a degraded file lacks; what refers to them stays."""
    if count < 1:
        raise ValueError("count must be at least 1")
    hashed = df.select("kind", "id", drop_hash(kind_rank(), F.col("id"), seed).alias("hash"))
    return hashed.orderBy("hash", kind_rank(), "id").limit(count)

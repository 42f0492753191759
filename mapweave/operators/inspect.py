"""Counts and statistics of datasets and blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mapweave.functions.tags import Expression, matches, parse
from mapweave.model import Dataset
from mapweave.operators.ordering import canonical, numbered, with_previous

#: Values in a frame of the coordinate statistics, and upper bounds of its classes of bit widths (fixed values).
FRAME = 128
WIDTHS = (8, 16, 20, 24, 28, 32)


def tags_count(ds: Dataset, expressions: list[Expression | str] | None = None, kinds: str = "nwr", min_count: int = 0, max_count: int | None = None, sort: str | None = None) -> DataFrame:
    """(k, v, n) of all tags, or of the tags that meet an expression of their kind; ``sort`` is count_desc, count_asc, name_asc or name_desc."""
    parts = []
    wanted = [parse(e) if isinstance(e, str) else e for e in expressions or []]
    for kind, df in ds.by_kind().items():
        if kind not in kinds:
            continue
        t = df.select(F.explode("tags").alias("t"))
        if wanted:
            mine = [e for e in wanted if kind in e.kinds]
            t = t.where(reduce(lambda a, b: a | b, [e.tag_test(F.col("t")) for e in mine], F.lit(False)))
        parts.append(t.select(F.col("t.k").alias("k"), F.col("t.v").alias("v")))
    out = reduce(DataFrame.unionAll, parts).groupBy("k", "v").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    if max_count is not None:
        out = out.where(F.col("n") <= max_count)
    orders = {"count_desc": [F.desc("n"), "k", "v"], "count_asc": ["n", "k", "v"], "name_asc": ["k", "v"], "name_desc": [F.desc("k"), F.desc("v")]}
    return out.orderBy(*orders[sort]) if sort else out


def counts(ds: Dataset) -> DataFrame:
    """(kind, n, n_tagged) of each kind."""
    parts = [df.agg(F.lit(k).alias("kind"), F.count("*").alias("n"), F.count_if(F.size("tags") > 0).alias("n_tagged")) for k, df in ds.by_kind().items()]
    return reduce(DataFrame.unionAll, parts)


def id_ranges(rows: DataFrame) -> DataFrame:
    """(kind, n, min_id, max_id, monotonic) from rows (kind, pos, id) in file order."""
    return with_previous(rows).withColumnRenamed("prev", "_p").groupBy("kind").agg(F.count("*").alias("n"), F.min("id").alias("min_id"), F.max("id").alias("max_id"), F.bool_and(F.coalesce(F.col("id") > F.col("_p"), F.lit(True))).alias("monotonic"))


def extended(rows: DataFrame) -> DataFrame:
    """(kind, n, first_ts, last_ts, n_version, n_ts, n_hidden) from rows with version, ts_s and visible; a time of 0 is none."""
    ts = F.when(F.col("ts_s") != 0, F.col("ts_s"))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("version").alias("n_version"), F.count(ts).alias("n_ts"), F.count_if(~F.coalesce("visible", F.lit(True))).alias("n_hidden"))


def data_box(nodes: DataFrame) -> DataFrame:
    return nodes.agg(*[f(c).alias(f"{n}_{c}") for c in ("lat_e7", "lon_e7") for n, f in (("min", F.min), ("max", F.max))])


def locations(ways: DataFrame) -> DataFrame:
    """(n_with, n_without) of ways by whether they carry locations."""
    has = F.coalesce(F.size("locations"), F.lit(0)) > 0
    return ways.agg(F.count_if(has).alias("n_with"), F.count_if(~has).alias("n_without"))


def block_index(rows: DataFrame) -> DataFrame:
    """(kind, block, n, min_id, max_id and, of nodes, the box) of rows with a block number."""
    return rows.groupBy("kind", "block").agg(F.count("*").alias("n"), F.min("id").alias("min_id"), F.max("id").alias("max_id"), F.min("lat_e7").alias("min_lat"), F.max("lat_e7").alias("max_lat"), F.min("lon_e7").alias("min_lon"), F.max("lon_e7").alias("max_lon"))


def block_tag_keys(rows: DataFrame) -> DataFrame:
    """(kind, block, k) of the distinct tag keys in each block."""
    return rows.select("kind", "block", F.explode("tags").alias("t")).select("kind", "block", F.col("t.k").alias("k")).distinct()


def anomalies(index: DataFrame) -> DataFrame:
    """Blocks (kind, block, n, flag) under half (small) or over one and a half times (large) their kind's upper median.

    Works on the table of blocks. Kind ``mixed`` is always flagged.
    """
    ordered = index.select("kind", "block", "n", F.row_number().over(Window.partitionBy("kind").orderBy("n", "block")).alias("_r"), F.count("*").over(Window.partitionBy("kind")).alias("_c"))
    half = F.expr("_c div 2") + 1
    med = ordered.where(F.col("_r") == half).select("kind", F.col("n").alias("_m"))
    flag = F.when(F.col("kind") == "mixed", "mixed").when(F.col("n") * 2 < F.col("_m"), "small").when(F.col("n") > F.expr("_m * 3 div 2"), "large")
    return ordered.join(med, "kind").select("kind", "block", "n", flag.alias("flag")).where("flag is not null")


def bits_needed(span: Column) -> Column:
    return F.when(span == 0, 0).otherwise(F.length(F.bin(span)))


def node_stats(nodes: DataFrame) -> DataFrame:
    """(axis, width_class, n_frames, sum_bits): how many bits the coordinates of FRAME nodes in id order need over their least one."""
    placed = numbered(nodes.select("id", "lat_e7", "lon_e7", F.lit(0).alias("_all")), ["_all"], canonical())
    frames = placed.select("lat_e7", "lon_e7", F.floor(F.col("place") / F.lit(float(FRAME))).alias("frame")).groupBy("frame").agg(*[(F.max(c).cast("bigint") - F.min(c).cast("bigint")).alias(c) for c in ("lat_e7", "lon_e7")])
    long = frames.select(F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), bits_needed(F.col(c)).alias("bits")) for a, c in (("lat", "lat_e7"), ("lon", "lon_e7"))])).alias("s")).select("s.*")
    group = F.lit(len(WIDTHS) - 1)
    for k in range(len(WIDTHS) - 2, -1, -1):
        group = F.when(F.col("bits") <= WIDTHS[k], k).otherwise(group)
    return long.groupBy("axis", group.alias("width_class")).agg(F.count("*").alias("n_frames"), F.sum("bits").cast("bigint").alias("sum_bits"))


def show_element(ds: Dataset, kind: str, id_: int) -> DataFrame:
    """The element with this id; the filter reaches the scan and the limit stops it early."""
    return ds.by_kind()[kind].where(F.col("id") == id_).limit(1)


def get_value(report: DataFrame, dotted: str) -> Column:
    """The column that a dotted key names in a one-row report."""
    return F.col(dotted)


def matched_counts(ds: Dataset, expressions: list[Expression | str]) -> DataFrame:
    """(kind, n) of elements that match."""
    parts = [df.where(matches(expressions, k)).agg(F.lit(k).alias("kind"), F.count("*").alias("n")) for k, df in ds.by_kind().items()]
    return reduce(DataFrame.unionAll, parts)

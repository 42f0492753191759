"""Geographic extracts: simple, complete ways, smart, many regions at once."""

from __future__ import annotations

import json
from functools import reduce
from itertools import product
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.functions.geo import Box, Region
from mapweave.functions.tags import tag_value
from mapweave.model import Dataset

MAX_REGIONS = 500
#: Grid of the join of many regions: cells of 0.1 degrees.
CELL = 1_000_000
#: Cells that a region may cover before its box alone is tested.
MAX_CELLS = 20_000


def parse_geojson(text: str) -> Region:
    """A Polygon or MultiPolygon, as a geometry, a Feature, or the first feature of a collection."""
    doc = json.loads(text)
    if doc.get("type") == "FeatureCollection":
        if not doc.get("features"):
            raise ValueError("empty FeatureCollection")
        doc = doc["features"][0]
    if doc.get("type") == "Feature":
        doc = doc["geometry"]
    if doc.get("type") == "Polygon":
        polygons = [doc["coordinates"]]
    elif doc.get("type") == "MultiPolygon":
        polygons = doc["coordinates"]
    else:
        raise ValueError(f"not a polygon: {doc.get('type')!r}")
    return Region.of_polygons([[[(p[0], p[1]) for p in ring] for ring in rings] for rings in polygons])


def parse_config(text: str, folder: str = ".") -> dict[str, Region]:
    """Regions by output name from a JSON list ``extracts``: each has ``output`` and one of ``bbox`` (four numbers), ``polygon`` (GeoJSON) and ``polygon_file`` (a path from ``folder``)."""
    out: dict[str, Region] = {}
    slots = json.loads(text).get("extracts", [])
    if not 0 < len(slots) <= MAX_REGIONS:
        raise ValueError(f"from 1 to {MAX_REGIONS} extracts are allowed")
    for slot in slots:
        name, given = slot["output"], [k for k in ("bbox", "polygon", "polygon_file") if k in slot]
        if name in out:
            raise ValueError(f"output used twice: {name!r}")
        if len(given) != 1:
            raise ValueError(f"{name!r} needs exactly one of bbox, polygon and polygon_file")
        if given == ["bbox"]:
            out[name] = Region(Box.of(",".join(map(str, slot["bbox"]))))
        elif given == ["polygon"]:
            out[name] = parse_geojson(json.dumps(slot["polygon"]))
        else:
            out[name] = parse_geojson(Path(folder, slot["polygon_file"]).read_text())
    return out


def _union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionAll, parts).distinct()


def extract_ids(ds: Dataset, hits: DataFrame, strategy: str = "simple", by: list[str] | None = None) -> DataFrame:
    """(kind, id) of an extract from the ids of nodes inside; ``by`` are columns (a region id) that ``hits`` carries and every step keeps apart.

    simple: nodes inside, ways with one of them, relations with such a node or way. complete_ways: all nodes of those
    ways too. smart: also the ways and nodes of those relations that are multipolygons or boundaries, and those ways' nodes.
    """
    if strategy not in ("simple", "complete_ways", "smart"):
        raise ValueError(f"unknown strategy {strategy!r}")
    by = by or []
    hits = hits.select(*by, "id").distinct()
    refs, members = ds.way_refs, ds.rel_members
    ways = refs.join(hits.withColumnRenamed("id", "node_id"), "node_id").select(*by, F.col("way_id").alias("id")).distinct()
    inside = hits.select(*by, F.lit("n").alias("mtype"), F.col("id").alias("ref")).unionAll(ways.select(*by, F.lit("w"), "id"))
    relations = members.join(inside, ["mtype", "ref"]).select(*by, F.col("rel_id").alias("id")).distinct()
    nodes_of = lambda w: refs.join(w.withColumnRenamed("id", "way_id"), "way_id").select(*by, F.col("node_id").alias("id"))
    nodes = hits
    if strategy != "simple":
        nodes = _union(nodes, nodes_of(ways))
    if strategy == "smart":
        whole = ds.relations.where(tag_value("type").isin("multipolygon", "boundary")).select(F.col("id").alias("rel_id"))
        pulled = members.join(whole, "rel_id", "left_semi").join(relations.withColumnRenamed("id", "rel_id"), "rel_id")
        extra = pulled.where("mtype = 'w'").select(*by, F.col("ref").alias("id")).distinct()
        nodes = _union(nodes, pulled.where("mtype = 'n'").select(*by, F.col("ref").alias("id")), nodes_of(extra))
        ways = _union(ways, extra)
    out = [df.select(F.lit(k).alias("kind"), *by, "id") for k, df in (("n", nodes), ("w", ways), ("r", relations))]
    return reduce(DataFrame.unionAll, out).join(ds.ids(), ["kind", "id"], "left_semi")


def extract(ds: Dataset, region: Region, strategy: str = "simple") -> Dataset:
    ids = extract_ids(ds, ds.nodes.where(region.contains()).select("id"), strategy)
    part = lambda k: ids.where(F.col("kind") == k).select("id")
    return ds.keep(part("n"), part("w"), part("r"))


def bounds(ds: Dataset, region: Region) -> DataFrame:
    """The header box of an extract: the region's box, as one row of whole units."""
    b = region.box
    return ds.nodes.sparkSession.createDataFrame([(b.min_lon, b.min_lat, b.max_lon, b.max_lat)], "min_lon int, min_lat int, max_lon int, max_lat int")


def nodes_by_region(nodes: DataFrame, regions: list[Region]) -> DataFrame:
    """(region_id, id) of nodes inside each of at most MAX_REGIONS regions.

    Regions are spread over the grid cells that their boxes touch; nodes meet the candidates of their cell by an equi-join
    with that table, whose size is bounded by MAX_REGIONS x MAX_CELLS, and each candidate is tested exactly. Regions over
    MAX_CELLS cells are tested against every node instead.
    """
    if len(regions) > MAX_REGIONS:
        raise ValueError(f"at most {MAX_REGIONS} regions")
    spark = nodes.sparkSession
    cells, wide = [], []
    for k, r in enumerate(regions):
        rows, cols = range(r.box.min_lat // CELL, r.box.max_lat // CELL + 1), range(r.box.min_lon // CELL, r.box.max_lon // CELL + 1)
        if len(rows) * len(cols) > MAX_CELLS:
            wide.append(k)
        else:
            cells += [(y, x, k) for y, x in product(rows, cols)]
    exact = lambda k: regions[k].contains()
    points = nodes.select("id", "lat_e7", "lon_e7")
    found = points.select("id", F.explode(F.array(*[F.when(exact(k), F.lit(k)) for k in wide])).alias("region_id")).where("region_id is not null") if wide else None
    if cells:
        grid = spark.createDataFrame(cells, "_y int, _x int, region_id int").groupBy("_y", "_x").agg(F.collect_list("region_id").alias("_near"))
        here = points.withColumns({"_y": F.floor(F.col("lat_e7") / F.lit(float(CELL))).cast("int"), "_x": F.floor(F.col("lon_e7") / F.lit(float(CELL))).cast("int")})
        met = here.join(grid, ["_y", "_x"]).select("id", "lat_e7", "lon_e7", F.explode("_near").alias("region_id"))
        test: Column = F.lit(False)
        narrow = sorted({k for *_, k in cells})
        for k in narrow:
            test = F.when(F.col("region_id") == k, exact(k)).otherwise(test)
        met = met.where(test).select("id", "region_id")
        found = met if found is None else found.unionAll(met)
    return found.select("region_id", "id")


def extract_multi(ds: Dataset, regions: list[Region], strategy: str = "simple") -> DataFrame:
    """(kind, region_id, id) of all regions in one pass."""
    return extract_ids(ds, nodes_by_region(ds.nodes, regions), strategy, ["region_id"])

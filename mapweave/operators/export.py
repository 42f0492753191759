"""GeoJSON features of nodes and located ways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.functions.geo import Box, degrees, signed_area2
from mapweave.functions.tags import is_area

RESERVED = ("@id", "@type")
METADATA = ("@version", "@timestamp", "@changeset", "@uid", "@user", "@visible")


def is_area_way(refs: Column | str = "refs", tags: Column | str = "tags") -> Column:
    """Closed, of at least four refs, with tags of an area."""
    r = F.col(refs) if isinstance(refs, str) else refs
    return F.coalesce((F.size(r) >= 4) & (F.element_at(r, 1) == F.element_at(r, -1)), F.lit(False)) & is_area(tags)


def ring(locations: Column | str = "locations") -> Column:
    """A closed ring turned counter-clockwise."""
    p = F.col(locations) if isinstance(locations, str) else locations
    closed = F.when(F.element_at(p, 1) == F.element_at(p, -1), p).otherwise(F.concat(p, F.slice(p, 1, 1)))
    return F.when(signed_area2(closed) < 0, F.reverse(closed)).otherwise(closed)


def way_geometry(ways: DataFrame) -> DataFrame:
    """Adds ``geometry`` (LineString or Polygon) and ``points``; ways without enough distinct points go, as do those without locations.

    A line needs two points; a ring four, of which three differ.
    """
    have = ways.where(F.col("locations").isNotNull() & (F.size("locations") > 0))
    area = have.withColumn("_area", is_area_way())
    shaped = area.withColumn("points", F.when(F.col("_area"), ring()).otherwise(F.col("locations")))
    valid = F.when(F.col("_area"), (F.size("points") >= 4) & (F.size(F.array_distinct("points")) >= 3)).otherwise(F.size("points") >= 2)
    return shaped.where(valid).withColumn("geometry", F.when(F.col("_area"), "Polygon").otherwise("LineString")).drop("_area")


def in_box(ways: DataFrame, box: Box) -> DataFrame:
    """Ways with any vertex in the box."""
    return ways.where(F.exists("locations", lambda p: box.contains(p["lat_e7"], p["lon_e7"])))


def properties(kind: str, keys: list[str] | None = None, metadata: bool = False) -> Column:
    """An array of (k, v) texts, values as JSON: id and type, metadata on request, then tags.

    Of a repeated key the first counts, reserved keys never come from tags, and ``keys`` restricts tags.
    """
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    pair = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    head = [pair("@id", F.col("id").cast("string")), pair("@type", F.lit(f'"{kind}"'))]
    if metadata:
        i = F.col("info")
        stamp = F.date_format(F.timestamp_seconds(i["ts_s"]), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        for k, v in zip(METADATA, (i["version"].cast("string"), quoted(stamp), i["changeset"].cast("string"), i["uid"].cast("string"), quoted(i["user"]), i["visible"].cast("string")), strict=True):
            head.append(F.when(v.isNotNull() & i.isNotNull(), pair(k, v)))
    barred = [*RESERVED, *(METADATA if metadata else ())]
    names = F.transform("tags", lambda t: t["k"])
    first = F.filter("tags", lambda t, n: (F.array_position(names, t["k"]) == n + 1) & ~t["k"].isin(*barred) & (t["k"].isin(*keys) if keys is not None else F.lit(True)))
    return F.concat(F.array_compact(F.array(*head)), F.transform(first, lambda t: F.struct(t["k"].alias("k"), quoted(t["v"]).alias("v"))))


def _object(pairs: Column) -> Column:
    key = lambda k: F.regexp_extract(F.to_json(F.struct(k.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    return F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda p: F.concat(key(p["k"]), F.lit(":"), p["v"])), ","), F.lit("}"))


def _position(p: Column) -> Column:
    return F.concat(F.lit("["), degrees(p["lon_e7"]), F.lit(","), degrees(p["lat_e7"]), F.lit("]"))


def features(nodes: DataFrame, ways: DataFrame, keys: list[str] | None = None, metadata: bool = False, box: Box | None = None) -> DataFrame:
    """(kind, id, geometry, feature): a JSON text a line for every tagged node and valid tagged way; relations have none."""
    points = nodes.where(F.size("tags") > 0)
    lines = ways.where(F.size("tags") > 0)
    if box is not None:
        points, lines = points.where(box.contains()), in_box(lines, box)
    wrap = lambda kind, coords, props: F.concat(F.lit('{"type":"Feature","geometry":{"type":"'), kind, F.lit('","coordinates":'), coords, F.lit('},"properties":'), _object(props), F.lit("}"))
    point = F.struct("lat_e7", "lon_e7")
    n = points.select(F.lit("n").alias("kind"), "id", F.lit("Point").alias("geometry"), wrap(F.lit("Point"), _position(point), properties("node", keys, metadata)).alias("feature"))
    inner = F.concat(F.lit("["), F.array_join(F.transform("points", _position), ","), F.lit("]"))
    coords = F.when(F.col("geometry") == "Polygon", F.concat(F.lit("["), inner, F.lit("]"))).otherwise(inner)
    w = way_geometry(lines).select(F.lit("w").alias("kind"), "id", "geometry", wrap(F.col("geometry"), coords, properties("way", keys, metadata)).alias("feature"))
    return n.unionAll(w)


def write_geojson_lines(found: DataFrame, path: str) -> None:
    """One feature a line, in as many files as there are tasks."""
    found.select(F.col("feature").alias("value")).write.mode("errorifexists").text(path)

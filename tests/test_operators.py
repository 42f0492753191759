import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mapweave.functions import geo, tags
from mapweave.functions.geo import Box, Region
from mapweave.model import Dataset, id_key
from mapweave.operators import changes, diff, export, extract, filters, geocode, history, ids, inspect, locations, ordering
from mapweave.schema import INFO, MEMBERS, TAGS

EMPTY_TAGS: list = []


def dataset(spark, nodes=(), ways=(), relations=()):
    """nodes (id, lat, lon, tags), ways (id, refs, tags), relations (id, members, tags); degrees."""
    t = lambda d: [(k, v) for k, v in d.items()]
    n = spark.createDataFrame([(i, round(a * 1e7), round(b * 1e7), t(g), None) for i, a, b, g in nodes], f"id bigint, lat_e7 int, lon_e7 int, tags {TAGS}, info {INFO}")
    w = spark.createDataFrame([(i, r, t(g), None) for i, r, g in ways], f"id bigint, refs array<bigint>, tags {TAGS}, info {INFO}")
    r = spark.createDataFrame([(i, m, t(g), None) for i, m, g in relations], f"id bigint, members {MEMBERS}, tags {TAGS}, info {INFO}")
    return Dataset(n, w, r)


def got(ds):
    return {(r["kind"], r["id"]) for r in ds.ids().collect()}


@pytest.fixture(scope="module")
def basic(spark):
    return dataset(
        spark, [(1, 55.7, 12.5, {}), (2, 54.0, 12.5, {}), (3, 55.65, 12.55, {}), (4, 55.7, 14.0, {})], [(10, [1, 2], {}), (11, [2, 4], {}), (12, [1, 3], {})],
        [(100, [("n", 1, "")], {}), (101, [("n", 4, "")], {})])


BOX = Region(Box.of("12.4,55.6,12.7,55.8"))


def test_extract_basic(basic):
    assert got(extract.extract(basic, BOX)) == {("n", 1), ("n", 3), ("w", 10), ("w", 12), ("r", 100)}
    assert got(extract.extract(basic, BOX, "complete_ways")) == {("n", 1), ("n", 2), ("n", 3), ("w", 10), ("w", 12), ("r", 100)}
    with pytest.raises(ValueError):
        extract.extract(basic, BOX, "other")


def test_extract_polygons(basic):
    ring = [[12.3, 55.5], [12.8, 55.5], [12.55, 55.9], [12.3, 55.5]]
    region = extract.parse_geojson(json.dumps({"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [ring]}}))
    assert {r["id"] for r in basic.nodes.where(region.contains()).collect()} == {1, 3}
    square, hole = [[12, 55], [13, 55], [13, 56], [12, 56]], [[12.45, 55.68], [12.52, 55.68], [12.52, 55.72], [12.45, 55.72]]
    holed = extract.parse_geojson(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[square, hole]]}}]}))
    assert {r["id"] for r in basic.nodes.where(holed.contains()).collect()} == {3}
    with pytest.raises(ValueError):
        extract.parse_geojson('{"type":"Point","coordinates":[1,2]}')


def test_extract_smart(spark):
    ds = dataset(
        spark, [(1, 55.7, 12.5, {}), (2, 0, 0.5, {}), (3, 0, 1, {}), (4, 0, 2, {}), (5, 0, 3, {})], [(10, [1], {}), (11, [2, 3], {}), (12, [4], {})],
        [(100, [("w", 10, ""), ("w", 11, "outer")], {"type": "multipolygon"}), (101, [("n", 1, ""), ("n", 5, "")], {"type": "boundary"}), (102, [("w", 10, ""), ("w", 12, "")], {"type": "route"})])
    assert got(extract.extract(ds, BOX, "smart")) == {("n", 1), ("n", 2), ("n", 3), ("n", 5), ("w", 10), ("w", 11), ("r", 100), ("r", 101), ("r", 102)}


def test_extract_is_idempotent(basic):
    once = extract.extract(basic, BOX, "complete_ways")
    assert got(extract.extract(once, BOX, "complete_ways")) == got(once)


def test_many_regions_by_grid_and_directly(spark, basic, monkeypatch):
    regions = [BOX, Region(Box.of("-180,-90,180,90")), Region(Box.of("13,55,15,56"))]
    want = {(0, 1), (0, 3), (1, 1), (1, 2), (1, 3), (1, 4), (2, 4)}
    find = lambda: {(r["region_id"], r["id"]) for r in extract.nodes_by_region(basic.nodes, regions).collect()}
    assert find() == want
    monkeypatch.setattr(extract, "MAX_CELLS", 1)
    assert find() == want


def test_extract_config():
    made = extract.parse_config('{"extracts":[{"output":"a","bbox":[1,2,3,4]},{"output":"b","polygon":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1]]]}}]}')
    assert list(made) == ["a", "b"] and made["a"].box == Box(20000000, 10000000, 40000000, 30000000)
    for bad in ('{"extracts":[]}', '{"extracts":[{"output":"a","bbox":[1,2,3,4]},{"output":"a","bbox":[1,2,3,4]}]}', '{"extracts":[{"output":"a","bbox":[3,2,1,4]}]}', '{"extracts":[{"output":"a"}]}'):
        with pytest.raises(ValueError):
            extract.parse_config(bad)


@settings(max_examples=60, deadline=None)
@given(st.floats(-179, 178), st.floats(-89, 88))
def test_box_rounds_outwards(x, y):
    b = Box.of(f"{x!r},{y!r},{x + 0.5!r},{y + 0.5!r}")
    assert b.min_lon <= x * 1e7 and b.max_lat >= (y + 0.5) * 1e7 - 1e-3


def test_filter_closure_and_cycles(spark):
    ds = dataset(
        spark, [(1, 1, 1, {}), (2, 1, 1, {}), (3, 1, 1, {})], [(10, [1, 2], {"k": "v"}), (11, [3], {})],
        [(100, [("w", 10, "outer"), ("r", 101, "")], {"type": "multipolygon"}), (101, [("r", 100, ""), ("n", 3, "")], {"type": "x"}), (102, [("r", 102, "")], {})])
    found = {(r["kind"], r["id"]): r["reason"] for r in filters.with_referenced(ds, ["type=multipolygon"]).collect()}
    assert found == {("r", 100): 1, ("r", 101): 3, ("w", 10): 3, ("n", 1): 3, ("n", 2): 3, ("n", 3): 3}
    kept = filters.tags_filter(ds, ["type=multipolygon"], remove_tags=True)
    assert kept.ways.first()["tags"] == [] and {r["id"]: len(r["tags"]) for r in kept.relations.collect()} == {100: 1, 101: 0}
    assert got(filters.tags_filter(ds, ["w/k=v"])) == {("w", 10), ("n", 1), ("n", 2)}
    assert got(filters.tags_filter(ds, ["w/k=v"], references=False)) == {("w", 10)}
    once = filters.tags_filter(ds, ["type=multipolygon"])
    assert got(filters.tags_filter(once, ["type=multipolygon"])) == got(once)


@pytest.mark.parametrize("text,hits", [("a", "135"), ("a=1", "1"), ("a=1,2", "13"), ("a!=1", "35"), ("addr:*", "4"), ("w/a", ""), ("nr/a=2", "3"), ("a=x=y", "5")])
def test_expressions(spark, text, hits):
    ds = dataset(spark, [(1, 0, 0, {"a": "1"}), (2, 0, 0, {}), (3, 0, 0, {"a": "2"}), (4, 0, 0, {"addr:street": "s"}), (5, 0, 0, {"a": "x=y"})])
    assert {str(r["id"]) for r in ds.nodes.where(tags.matches([text], "n")).collect()} == set(hits)


def test_expression_lines():
    assert [e.key for e in tags.parse_lines("# all\nw/highway=primary # roads\n\nname\n")] == ["highway", "name"]
    for bad in ("", "w/", "=x"):
        with pytest.raises(ValueError):
            tags.parse(bad)


def test_ids(spark, basic):
    wanted = ids.id_table(spark, ids.parse_ids(["1", "w11", "r100", "n99"]))
    assert got(ids.getid(basic, wanted)) == {("n", 1), ("w", 11), ("r", 100)}
    assert got(ids.getid(basic, wanted, add_referenced=True)) == {("n", 1), ("n", 2), ("n", 4), ("w", 11), ("r", 100)}
    assert got(ids.removeid(basic, wanted)) == got(basic) - {("n", 1), ("w", 11), ("r", 100)}
    assert [tuple(r) for r in ids.missing(basic, wanted).collect()] == [("n", 99)]
    assert {tuple(r) for r in ids.parents(basic, wanted).collect()} == {("w", 10), ("w", 12), ("r", 100)}
    assert {tuple(r) for r in ids.parents(basic, wanted, add_self=True).collect()} == {("w", 10), ("w", 12), ("r", 100), ("n", 1), ("w", 11)}
    for bad in ("n-1", "x1", ""):
        with pytest.raises(ValueError):
            ids.parse_ids([bad])


def test_ids_from_files(spark, tmp_path):
    (tmp_path / "ids").write_text("n1 # one\nw2\n3\n\n# no\n")
    assert {tuple(r) for r in ids.read_ids(spark, str(tmp_path / "ids")).collect()} == {("n", 1), ("w", 2), ("n", 3)}


def test_locations(spark):
    ds = dataset(spark, [(1, 1, 2, {}), (2, 0, 0, {}), (3, 3, 4, {"a": "b"}), (4, 5, 6, {})], [(10, [1, 9, 2, 1], {}), (11, [], {})], [(100, [("n", 4, "")], {})])
    out = {r["id"]: r for r in locations.add_locations(ds).collect()}
    assert [tuple(p) for p in out[10]["locations"]] == [(10000000, 20000000), (0, 0), (0, 0), (10000000, 20000000)]
    assert out[10]["n_missing"] == 2 and out[11]["locations"] is None
    assert {r["id"] for r in locations.kept_nodes(ds).collect()} == {3, 4} and locations.kept_nodes(ds, keep_all=True).count() == 4


def test_differences(spark):
    schema = f"id bigint, lat_e7 int, lon_e7 int, tags {TAGS}, info {INFO}"
    info = lambda v: (v, 0, 0, 0, "", True)
    old = spark.createDataFrame([(1, 0, 0, [], info(1)), (2, 0, 0, [("a", "b"), ("c", "d")], info(1)), (3, 0, 0, [], info(1)), (4, 0, 0, [], info(1))], schema)
    new = spark.createDataFrame([(1, 0, 0, [], info(2)), (2, 0, 0, [("c", "d"), ("a", "b")], info(2)), (3, 1, 0, [], info(1)), (5, 0, 0, [], info(1))], schema)
    found = diff.diff(old, new, "n")
    assert {r["id"]: r["status"] for r in found.collect()} == {1: "common", 2: "modified", 3: "modified", 4: "deleted", 5: "created"}
    assert {r["line"] for r in diff.lines(found).collect()} == {" n1 v2", "*n2 v1 -> v2", "*n3 v1", "-n4 v1", "+n5 v1"}
    derived = diff.derive_changes(old, new, "n", increment_version=True).withColumn("seq", F.lit(0))
    assert [r["info"]["version"] for r in derived.where("action = 'delete'").collect()] == [2]
    back = changes.apply_changes(old, derived, "n")
    assert {r["status"] for r in diff.diff(back, new, "n").collect()} == {"common"}
    assert tuple(diff.summary(found).first())[:4] == (1, 2, 1, 1)


def test_changes_in_order(spark):
    a = spark.createDataFrame([(0, "create", "n", 1), (1, "create", "n", 2)], "seq bigint, action string, kind string, id bigint")
    b = spark.createDataFrame([(0, "delete", "n", 1), (1, "modify", "n", 2), (2, "create", "w", 1)], a.schema)
    merged = changes.merge_changes([a, b])
    assert merged.count() == 5
    assert {(r["kind"], r["id"], r["action"], r["action_rank"]) for r in changes.simplify(merged).collect()} == {("n", 1, "delete", 2), ("n", 2, "modify", 1), ("w", 1, "create", 0)}


def test_history(spark):
    rows = [("n", 1, 0, 100, True), ("n", 1, 1, 200, True), ("n", 1, 2, 300, False), ("n", 3, 3, 50, None), ("n", 4, 4, None, True)]
    h = spark.createDataFrame(rows, "kind string, id bigint, seq bigint, ts_s bigint, visible boolean")
    at = lambda t: {(r["id"], r["seq"]) for r in history.time_filter(h, t).collect()}
    assert at(250) == {(1, 1), (3, 3), (4, 4)} and at(350) == {(3, 3), (4, 4)} and at(10) == {(4, 4)}
    assert history.parse_cutoff("1970-01-02T00:00:00Z") == 86400 == history.parse_cutoff("86400")


def test_renumber(spark):
    ds = dataset(spark, [(5, 0, 0, {}), (9, 0, 0, {})], [(20, [9, 5, 77], {})], [(8, [("w", 20, ""), ("r", 8, ""), ("n", 404, "")], {})])
    maps, refs, members = ordering.renumber(ds, (1, 100, 10))
    assert {r["id"]: r["new_id"] for r in maps["n"].collect()} == {5: 1, 9: 2}
    assert [tuple(r) for r in refs.orderBy("pos").select("way_id", "node_id").collect()] == [(100, 2), (100, 1), (100, 77)]
    assert {(r["rel_id"], r["mtype"], r["ref"]) for r in members.collect()} == {(10, "w", 100), (10, "r", 10), (10, "n", 404)}
    with pytest.raises(ValueError):
        ordering.renumber(dataset(spark, [(-1, 0, 0, {})]))


def test_order(spark):
    rows = [("r", 1), ("n", 3), ("n", -1), ("n", 0), ("n", -5), ("w", 2)]
    df = spark.createDataFrame(rows, "kind string, id bigint")
    once = ordering.sort_elements(df)
    assert [tuple(r) for r in once.collect()] == [("n", 0), ("n", -1), ("n", -5), ("n", 3), ("w", 2), ("r", 1)]
    assert ordering.sort_elements(once).collect() == once.collect()
    least = spark.createDataFrame([(-(2**63),), (-1,)], "id bigint").orderBy(*id_key())
    assert [r["id"] for r in least.collect()] == [-1, -(2**63)]


def test_checks(spark):
    df = spark.createDataFrame([("n", 0, 1), ("n", 1, 3), ("n", 2, 3), ("n", 4, 2), ("w", 3, 1)], "kind string, pos bigint, id bigint")
    assert {(r["pos"], r["id"], r["prev"]) for r in ordering.check_ids(df).collect()} == {(2, 3, 3), (4, 2, 3)}
    assert ordering.check_ids(df, 1).count() == 1
    assert [tuple(r) for r in ordering.duplicates(df).collect()] == [("n", 3, 1)]
    assert [tuple(r) for r in ordering.type_order(df).collect()] == [("n", "w", 3, 4)]
    ds = dataset(spark, [(1, 0, 0, {})], [(10, [1, 2, 2], {})], [(100, [("n", 1, ""), ("w", 11, ""), ("u7", 5, "")], {})])
    assert sorted(tuple(r) for r in ordering.missing_refs(ds).collect()) == [(10, 2), (10, 2)]
    assert [tuple(r) for r in ordering.missing_members(ds).collect()] == [(100, "w", 11)]


def test_export(spark):
    shape = [(0, 0), (0, 1), (1, 1), (0, 0)]
    nodes = [(k, *p, {}) for k, p in enumerate(shape[:3], 1)] + [(9, 1.5, -2.25, {"name": "first", "@id": "x", "q\"": "a\nb"})]
    ways = [(10, [1, 2, 3], {"highway": "a"}), (11, [1, 2, 3, 1], {"building": "yes"}), (12, [1, 2, 3, 1], {"building": "yes", "area": "no"}), (13, [1, 2, 3, 1], {"area": "yes"}), (15, [], {"a": "b"}), (16, [1, 2], {}), (17, [1], {"a": "b"})]
    ds = dataset(spark, nodes, ways)
    located = locations.add_locations(ds)
    out = {(r["kind"], r["id"]): json.loads(r["feature"]) for r in export.features(ds.nodes, located).collect()}
    assert set(out) == {("n", 9), ("w", 10), ("w", 11), ("w", 12), ("w", 13)}
    assert out["n", 9] == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [-2.25, 1.5]}, "properties": {"@id": 9, "@type": "node", "name": "first", 'q"': "a\nb"}}
    assert out["w", 12]["geometry"]["type"] == "LineString" and out["w", 13]["geometry"]["type"] == "Polygon"
    ring = out["w", 11]["geometry"]["coordinates"][0]
    assert ring[0] == ring[-1] and sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False)) > 0
    only = export.features(ds.nodes, located, keys=["name"], box=Box.of("-3,1,-2,2"))
    assert [json.loads(r["feature"])["properties"] for r in only.collect()] == [{"@id": 9, "@type": "node", "name": "first"}]


def test_repeated_keys_and_metadata(spark):
    rows = spark.createDataFrame([(1, 10, 20, [("name", "a"), ("name", "b"), ("@version", "z")], (2, 86400, 3, 4, "u", True))], f"id bigint, lat_e7 int, lon_e7 int, tags {TAGS}, info {INFO}")
    none = rows.limit(0).withColumns({"refs": F.lit(None).cast("array<bigint>"), "locations": F.lit(None).cast("array<struct<lat_e7:int,lon_e7:int>>")})
    p = json.loads(export.features(rows, none, metadata=True).first()["feature"])["properties"]
    assert p == {"@id": 1, "@type": "node", "@version": 2, "@timestamp": "1970-01-02T00:00:00Z", "@changeset": 3, "@uid": 4, "@user": "u", "@visible": True, "name": "a"}


def test_geocoding(spark):
    street = [(k, 55.7, 12.5 + k * 0.001, {}) for k in range(1, 6)]
    addr = [(20, 55.70005, 12.5010, {"addr:housenumber": "10", "addr:street": "Main Street"}), (21, 55.70005, 12.5050, {"addr:housenumber": "30b", "addr:street": "Main Street"})]
    ways = [(100, [1, 2, 3, 4, 5], {"highway": "residential", "name": "Main Street"}), (101, [1, 5], {"addr:interpolation": "even", "addr:street": "Main Street"}), (102, [1, 2], {"highway": "footway", "name": "No"})]
    ds = dataset(spark, street + addr, ways)
    located = locations.add_locations(ds)
    a, s, i = geocode.addresses(ds, located), geocode.streets(located), geocode.interpolations(located)
    assert {r["id"] for r in s.collect()} == {100} and {r["itype"] for r in i.collect()} == {1}
    ends = geocode.interp_endpoints(i, a)
    assert [tuple(r) for r in ends.collect()] == [(101, 10, 30)]
    isegs = geocode.segments(i.join(ends, "id"), "id", "street", "itype", "path", "start_number", "end_number")
    q = spark.createDataFrame([(1, 557000100, 125030000), (2, 557030000, 125030000), (3, 0, 0)], "q bigint, qlat int, qlon int")
    out = {(r["q"], r["what"]): r for r in geocode.reverse(q, a, geocode.segments(s, "id", "street"), isegs).collect()}
    assert out[1, "street"]["label"] == "Main Street" and out[1, "interpolation"]["number"] == "20" and (1, "address") not in out
    assert out[2, "address"]["number"] in ("10", "30b") and out[2, "street"]["metres"] > 75 and not any(k[0] == 3 for k in out)


def test_admin(spark):
    def box(first, x1, y1, x2, y2):
        return [(first + k, y, x, {}) for k, (x, y) in enumerate([(x1, y1), (x2, y1), (x2, y2), (x1, y2)])]

    nodes = box(1, 1, 1, 10, 10) + box(11, 2, 2, 4, 4) + box(21, 6, 6, 7, 7)
    ways = [(50, [1, 2, 3], {}), (51, [1, 4, 3], {}), (52, [11, 12, 13, 14, 11], {}), (53, [21, 22, 23, 24, 21], {})]
    rels = [(200, [("w", 50, "outer"), ("w", 51, "outer"), ("w", 53, "inner")], {"boundary": "administrative", "admin_level": "2", "name": "Big", "ISO3166-1:alpha2": "BG"}),
            (201, [("w", 52, "")], {"boundary": "administrative", "admin_level": "2", "name": "Small"}), (202, [("w", 52, "outer")], {"boundary": "postal_code", "postal_code": "123"}),
            (203, [("w", 52, "outer")], {"boundary": "administrative", "admin_level": "12", "name": "no"}), (204, [("w", 50, "outer")], {"boundary": "administrative", "admin_level": "4", "name": "open"})]
    ds = dataset(spark, nodes, ways, rels)
    polygons = geocode.admin_polygons(ds, locations.add_locations(ds))
    q = spark.createDataFrame([(1, 30000000, 30000000), (2, 50000000, 50000000), (3, 65000000, 65000000), (4, 110000000, 0)], "q bigint, qlat int, qlon int")
    got_ = {(r["q"], r["level"]): (r["name"], r["country"]) for r in geocode.admin_lookup(q, polygons).collect()}
    assert got_ == {(1, 2): ("Small", None), (1, 11): ("123", None), (2, 2): ("Big", "BG")}


def test_rings():
    assert geocode.assemble_rings([[(0, 0), (0, 1)], [(1, 1), (0, 1)], [(1, 1), (0, 0)]]) == [[(0, 0), (0, 1), (1, 1), (0, 0)]]
    assert geocode.assemble_rings([[(0, 0), (0, 1)], [(5, 5), (6, 6)]]) == []
    circle = [(round(1e6 * math.sin(k / 500)), round(1e6 * math.cos(k / 500))) for k in range(3000)]
    less = geocode.simplify(circle)
    assert len(less) == 500 and less[0] == circle[0] and less[-1] == circle[-1]


def test_tag_counts(spark):
    ds = dataset(spark, [(k, 0, 0, {"amenity": "cafe"}) for k in range(3)] + [(k, 0, 0, {"shop": "bakery"}) for k in range(3, 5)], [(k, [], {"highway": "primary"}) for k in range(3)])
    assert [tuple(r) for r in inspect.tags_count(ds, sort="count_desc").collect()] == [("amenity", "cafe", 3), ("highway", "primary", 3), ("shop", "bakery", 2)]
    assert [tuple(r) for r in inspect.tags_count(ds, ["n/shop"]).collect()] == [("shop", "bakery", 2)]
    assert inspect.tags_count(ds, kinds="w", min_count=4).count() == 0


def test_cleaning(spark):
    df = spark.createDataFrame([(1, (2, 5, 7, 8, "u", True)), (2, None)], f"id bigint, info {INFO}")
    out = {r["id"]: r["info"] for r in filters.clean(df, ["version", "user", "timestamp"]).collect()}
    assert tuple(out[1]) == (0, 0, 7, 8, "", True) and out[2] is None
    with pytest.raises(ValueError):
        filters.clean(df, ["colour"])


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(-2**31, 2**31 - 1), min_size=1, max_size=20))
def test_degrees_as_text(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v int").select("v", geo.degrees("v").alias("s"))
    assert all(float(r["s"]) == pytest.approx(r["v"] / 1e7, abs=1e-9) and not r["s"].endswith((".", "0.0")) for r in df.collect())


def test_places_and_stretches(spark, monkeypatch):
    ids_ = [5, -3, 0, -1, 2, 9, -7, 40, 41, 42]
    df = spark.createDataFrame([("n", i) for i in ids_] + [("w", 1)], "kind string, id bigint")
    want = {i: k for k, i in enumerate(sorted(ids_, key=lambda i: (2, i) if i > 0 else (1, -i) if i else (0, 0)))}
    assert {r["id"]: r["place"] for r in ordering.numbered(df, ["kind"], ordering.canonical()).where("kind = 'n'").collect()} == want
    monkeypatch.setattr(ordering, "STRETCH", 3)
    rows = spark.createDataFrame([("n", p, i) for p, i in enumerate(ids_)], "kind string, pos bigint, id bigint")
    got_ = {r["pos"]: r["prev"] for r in ordering.with_previous(rows).collect()}
    assert got_ == {p: ids_[p - 1] if p else None for p in range(len(ids_))}


def test_neighbours_at_the_poles_and_the_date_line(spark):
    import math
    import random

    from mapweave.operators import geocode as gc

    rng = random.Random(5)
    lat = lambda: rng.choice([rng.uniform(84, 90), rng.uniform(-90, -89.5), rng.uniform(89.99, 90), rng.uniform(-1, 1)])
    lon = lambda: rng.choice([rng.uniform(-180, 180), rng.uniform(179.9, 180), 180.0, -180.0, rng.uniform(9, 9.5)])
    place = lambda: (int(lat() * 1e7), int(lon() * 1e7))
    q, p = [(k, *place()) for k in range(150)], [(k, *place()) for k in range(400)]
    queries, points = spark.createDataFrame(q, "q long, qlat int, qlon int"), spark.createDataFrame(p, "id long, lat_e7 int, lon_e7 int")
    for radius in (75.0, 1000.0, 40_000.0, 300_000.0):
        want = set()
        for k, a, b in q:
            for i, c, d in p:
                dy, dx = math.radians((c - a) / 1e7), math.radians((d - b) / 1e7) * math.cos(math.radians(a / 1e7))
                if math.sqrt(dx * dx + dy * dy) * gc.EARTH_M < radius:
                    want.add((k, i))
        got = [(r["q"], r["id"]) for r in gc.near_points(queries, points, radius).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert len(want) > 100


def test_ranges_by_halving_and_places(spark):
    from pyspark.sql import functions as F

    from mapweave.operators import ordering as od

    for n in (1, 2, 3, 7, 8, 20):
        cuts = [float(3 * k) for k in range(n)]
        got = spark.range(70).select("id", od.range_of(F.col("id").cast("double"), cuts).alias("r")).collect()
        assert all(r["r"] == sum(c < r["id"] for c in cuts) for r in got)
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("id"), F.lit("n").alias("kind")).repartition(5)
    assert all(r["place"] == r["id"] for r in od.numbered(rows, ["kind"], F.col("id"), parts=9).collect())
    assert all(r["place"] == 999 - r["id"] for r in od.placed(rows.orderBy(F.desc("id"))).collect())


def test_segments_over_stretches(spark, monkeypatch):
    import itertools
    import random

    from mapweave.operators import ordering as od

    monkeypatch.setattr(od, "STRETCH", 7)
    rng = random.Random(2)
    kinds = [k for _ in range(25) for k in [rng.choice("nwr")] * rng.randint(1, 12)]
    want = [(i + 1, k, len(list(run))) for i, (k, run) in enumerate(itertools.groupby(kinds))]
    got = od.segments(spark.createDataFrame(list(enumerate(kinds)), "block long, kind string")).collect()
    assert sorted((r["segment"], r["kind"], r["n_blocks"]) for r in got) == want


def test_changes_with_repeated_ids(spark):
    """An id that the new state holds twice gives a change a differing pair, and whole changes give both elements back."""
    schema = f"id bigint, lat_e7 int, lon_e7 int, tags {TAGS}"
    old = spark.createDataFrame([(1, 10, 10, []), (2, 20, 20, []), (3, 30, 30, []), (4, 40, 40, [])], schema)
    new = spark.createDataFrame([(1, 10, 10, []), (1, 11, 11, []), (2, 21, 21, []), (2, 22, 22, []), (4, 40, 40, []), (4, 40, 40, []), (5, 50, 50, [])], schema)
    derived = diff.derive_changes(old, new, "n").select("id", "action", "lat_e7").collect()
    assert sorted(tuple(map(str, r)) for r in derived) == [("1", "modify", "11"), ("2", "modify", "21"), ("2", "modify", "22"), ("3", "delete", "None"), ("5", "create", "50")]
    back = changes.apply_changes(old, diff.derive_whole(old, new, "n"), "n", whole=True)
    assert sorted(tuple(r)[:3] for r in back.collect()) == sorted(tuple(r)[:3] for r in new.collect())


def test_admin_edges_are_outside(spark):
    """A point on an edge or corner is in no polygon, on whichever side."""
    from mapweave.operators import geocode as gc

    def edges(c):
        return [(float(a[0]), float(a[1]), float(b[0]), float(b[1])) for a, b in zip(c, [*c[1:], c[0]], strict=True)]
    big = 1_700_000_000
    rows = [(1, 2, "square", None, 0, 8.0, 0, 0, 20_000_000, 20_000_000, edges([(0, 0), (20_000_000, 0), (20_000_000, 20_000_000), (0, 20_000_000)])),
            (2, 3, "slope", None, 0, 8.0, -800_000_000, -big, 800_000_000, big, edges([(-big, -800_000_000), (big, 800_000_000), (-big, 800_000_000)]))]
    polygons = spark.createDataFrame(rows, "id bigint, level int, name string, country string, poly int, area2 double, min_lat int, min_lon int, max_lat int, max_lon int, edges array<struct<x1:double,y1:double,x2:double,y2:double>>")
    q = spark.createDataFrame([("in", 5, 5), ("left", 5, 0), ("bottom", 0, 5), ("right", 5, 20_000_000), ("corner", 0, 0), ("slope", 8, 17), ("above", 9, 17), ("below", 7, 17)], "q string, qlat int, qlon int")
    found = {(r["q"], r["name"]) for r in gc.admin_lookup(q, polygons).collect()}
    assert {x for x in found if x[1] == "square"} == {("in", "square"), ("slope", "square"), ("above", "square"), ("below", "square")}
    assert {x for x in found if x[1] == "slope" and x[0] in ("slope", "above", "below")} == {("above", "slope")}


def test_admin_lookup_leaves_out_what_a_covered_cell_hides(spark):
    """Many areas over one place: the smallest is found, with few joined to it, also where outlines are slanted, holed or of another level."""
    from mapweave.operators import geocode as gc

    def edges(*rings):
        return [(float(a[0]), float(a[1]), float(b[0]), float(b[1])) for c in rings for a, b in zip(c, [*c[1:], c[0]], strict=True)]
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    one = 10_000_000
    rows = [(k, 2, f"a{k}", None, 0, float(100 + k), -5 * one, -5 * one, 5 * one, 5 * one, edges(square(-5 * one, -5 * one, 10 * one))) for k in range(300)]
    rows.append((900, 2, "holed", None, 0, 1.0, -3 * one, -3 * one, 3 * one, 3 * one, edges(square(-3 * one, -3 * one, 6 * one), square(one // 4, one // 4, one // 4))))
    rows.append((901, 3, "slanted", None, 0, 1.0, -3 * one, -3 * one, 3 * one, 3 * one, edges([(0, -3 * one), (3 * one, 0), (0, 3 * one), (-3 * one, 0)])))
    polygons = spark.createDataFrame(rows, gc.POLYGONS)
    q = spark.createDataFrame([("hole", one * 3 // 8, one * 3 // 8), ("plain", -one // 2, one // 2), ("rim", 35 * one // 10, 0), ("out", 6 * one, 0)], "q string, qlat int, qlon int")
    found = gc.admin_lookup(q, polygons)
    assert sorted((r["q"], r["level"], r["name"]) for r in found.collect()) == [("hole", 2, "a0"), ("hole", 3, "slanted"), ("plain", 2, "holed"), ("plain", 3, "slanted"), ("rim", 2, "a0")]
    assert max(_metrics(found, "SortMergeJoin")) <= 20


def _metrics(df, node):
    """Output rows of the executed plan's nodes of a name."""
    df.collect()
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStage"):
            todo.append(p.plan())
        else:
            todo += [p.children().apply(k) for k in range(p.children().size())]
            if name == node:
                out.append(p.metrics().apply("numOutputRows").value())
    return out


def _scattered(spark, n, seed, columns):
    """Rows (id, then two places of whole units) over a few degrees, crowded at one corner."""
    import random

    pick = random.Random(seed)
    return spark.createDataFrame([(k, int(60_000_000 * pick.random() ** 3), int(60_000_000 * pick.random() ** 3)) for k in range(n)], columns)


def test_nearest_points_by_radii(spark, monkeypatch):
    """The nearest of all within a wide radius, found among far fewer pairs than lie within it; the smallest id of those at one place."""
    from mapweave.operators import geocode as gc

    points = _scattered(spark, 3000, 1, "id bigint, lat_e7 int, lon_e7 int")
    points = points.unionAll(points.selectExpr("id + 10000", "lat_e7", "lon_e7"))
    queries = _scattered(spark, 400, 2, "q bigint, qlat int, qlon int").unionAll(spark.createDataFrame([(900, -40_000_000, -40_000_000), (901, 890_000_000, 0)], "q bigint, qlat int, qlon int"))
    pairs = []
    monkeypatch.setattr(gc, "near_points", lambda q, p, r, few=False, f=gc.near_points: pairs.append(f(q, p, r, few=few).count()) or f(q, p, r, few=few))
    found = {r["q"]: (r["id"], round(r["metres"], 3)) for r in gc.nearest_points(queries, points, 900_000.0, "id").collect()}
    brute = queries.crossJoin(points).withColumn("d2", geo.distance_sq(F.col("qlat"), F.col("qlon"), F.col("lat_e7"), F.col("lon_e7"))).where(geo.metres(F.col("d2")) < 900_000.0)
    assert found == {r["q"]: (r["id"], round(r["metres"], 3)) for r in gc.nearest(brute, "id").collect()}
    assert 900 in found and 901 not in found and len(pairs) > 2 and sum(pairs) < 402 * 3000 / 20


def test_near_rows_are_not_broadcast(spark):
    """Cells unfold a small table to a large one, which mustn't go through the driver; each pair is met once."""
    from mapweave.operators import geocode as gc

    segs = spark.createDataFrame([(1, 0, -500_000_000, -1_700_000_000, 500_000_000, 1_700_000_000), (2, 0, 0, 0, 3, 3)], "id bigint, seg int, lat1 int, lon1 int, lat2 int, lon2 int")
    queries = spark.createDataFrame([(1, 0, 0), (2, 10_000_000, 1_000_000)], "q bigint, qlat int, qlon int")
    for found in (gc.near_segments(queries, segs, 200_000.0), gc.near_points(queries, segs.selectExpr("id", "lat2 as lat_e7", "lon2 as lon_e7"), 200_000.0)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    found = gc.near_segments(queries, segs, 200_000.0)
    assert sorted((r["q"], r["id"]) for r in found.collect()) == [(1, 1), (1, 2), (2, 1), (2, 2)]

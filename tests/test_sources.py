import gzip

import pytest
from pyspark.sql import functions as F

from mapweave.operators.changes import apply_changes, last_change
from mapweave.schema import ELEMENTS
from mapweave.sources import osc, pbf, wire
from mapweave.streaming import feed

INFO = {"version": 3, "ts_s": 1700000000, "changeset": 9, "uid": 5, "user": "ü", "visible": True}
ROWS = [
    ("n", 1, 556000000, -125000000, [("name", "é"), ("name", "second")], None, None, None, tuple(INFO.values())),
    ("n", -2, -1, 1799999999, [], None, None, None, None),
    ("w", 10, None, None, [("highway", "primary")], [1, -2, 1], [(1, 2), (3, 4), (1, 2)], None, tuple(INFO.values())),
    ("w", 11, None, None, [], [], None, None, None),
    ("r", 100, None, None, [("type", "multipolygon")], None, None, [("n", 1, "a"), ("w", 10, ""), ("r", 100, "self")], None),
]


def table(spark, rows=ROWS):
    return spark.createDataFrame(rows, ELEMENTS)


@pytest.mark.parametrize("compression", ["none", "zlib", "zstd"])
def test_pbf_round_trip(spark, tmp_path, compression):
    path = str(tmp_path / "out")
    pbf.write_pbf(table(spark), path, compression)
    back = pbf.read_elements(spark, path)
    assert sorted(map(tuple, back.collect()), key=lambda r: r[:2]) == sorted(map(tuple, table(spark).collect()), key=lambda r: r[:2])
    assert pbf.read_header(path).optional == ["Sort.Type_then_ID"]
    ds = pbf.read_dataset(spark, path)
    assert [r["node_id"] for r in ds.way_refs.orderBy("pos").collect()] == [1, -2, 1]
    assert {(r["mtype"], r["ref"]) for r in ds.rel_members.collect()} == {("n", 1), ("w", 10), ("r", 100)}


def test_canonical_order_in_file(spark, tmp_path):
    rows = [("n", i, 1, 1, [], None, None, None, None) for i in (5, -3, 0, -1, 2)]
    path = str(tmp_path / "o")
    pbf.write_pbf(table(spark, rows).coalesce(1), path)
    assert [r["id"] for r in pbf.read_elements(spark, path).collect()] == [0, -1, -3, 2, 5]


def test_broken_files(tmp_path):
    good = wire.blob("OSMHeader", wire.Header().write()) + wire.blob("OSMData", wire.write_block([dict(zip(("kind", "id", "lat_e7", "lon_e7", "tags", "info"), ("n", 1, 2, 3, [], None), strict=True))]))
    for cut in (2, 10, len(good) - 3):
        f = tmp_path / f"{cut}.pbf"
        f.write_bytes(good[:cut])
        with pytest.raises(ValueError), open(f, "rb") as h:
            for _, at, size in wire.walk(h):
                h.seek(at)
                wire.unblob(h.read(size))
    with pytest.raises(ValueError):
        wire.varint(b"\xff" * 11, 0)


def test_long_blocks_are_split():
    rows = [{"kind": "n", "id": i, "lat_e7": i, "lon_e7": -i, "tags": [], "info": None} for i in range(9000)]
    got = list(wire.elements(wire.write_block(rows)))
    assert [(g["id"], g["lat_e7"], g["lon_e7"]) for g in got] == [(i, i, -i) for i in range(9000)]


OSC1 = """<osmChange version="0.6"><create><node id="1" version="1" lat="1.0" lon="2.0"><tag k="a" v="&lt;x&gt;"/></node></create>
<modify><way id="5" version="2" timestamp="2024-01-01T00:00:00Z"><nd ref="1"/><nd ref="2"/></way></modify></osmChange>"""
OSC2 = """<osmChange version="0.6"><modify><node id="1" version="2" lat="1.5" lon="2.0"/></modify><delete><way id="5" version="3"/></delete></osmChange>"""


def test_change_files_in_order(spark, tmp_path):
    (tmp_path / "9.osc").write_text(OSC1)
    (tmp_path / "10.osc.gz").write_bytes(gzip.compress(OSC2.encode()))
    rows = osc.read_changes(spark, str(tmp_path))
    assert rows.count() == 4
    last = {(r["kind"], r["id"]): r for r in last_change(rows).collect()}
    assert last["n", 1]["lat_e7"] == 15000000 and last["w", 5]["action"] == "delete"


def test_change_round_trip(spark, tmp_path):
    rows = table(spark).withColumns({"seq": F.monotonically_increasing_id(), "action": F.lit("modify")})
    osc.write_changes(rows, str(tmp_path / "c"))
    back = osc.read_changes(spark, str(tmp_path / "c"))
    get = lambda df: {(r["kind"], r["id"]): (r["lat_e7"], r["lon_e7"], r["tags"], r["refs"], r["members"], r["info"]) for r in df.collect()}
    assert get(back) == get(rows)


def test_feed_keeps_a_snapshot(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.osc").write_text(OSC1)
    for text, name in ((None, None), (OSC2, "2.osc")):
        if name:
            (folder / name).write_text(text)
        feed.follow(spark, str(folder), str(tmp_path / "state"), str(tmp_path / "ck")).awaitTermination()
    now = {(r["kind"], r["id"]): r for r in feed.snapshot(spark, str(tmp_path / "state")).collect()}
    assert now["n", 1]["lat_e7"] == 15000000 and now["w", 5]["action"] == "delete"


def test_apply_is_unconditional(spark):
    base = table(spark).where("kind = 'n'").select("id", "lat_e7", "lon_e7")
    c = spark.createDataFrame([(1, "create", "n", 7, 1, 1), (2, "delete", "n", 7, None, None), (3, "delete", "n", 99, None, None), (4, "modify", "n", 1, 5, 5)], "seq bigint, action string, kind string, id bigint, lat_e7 int, lon_e7 int")
    assert {tuple(r) for r in apply_changes(base, c, "n").collect()} == {(1, 5, 5), (-2, -1, 1799999999)}


def test_filters_choose_blobs_by_their_indexes(spark, tmp_path, monkeypatch):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThan

    from mapweave.sources import pbf, wire

    rows = [("n", k, k * 1000, -k * 1000, [], None, None, None, None) for k in range(1, 301)] + [("w", k, None, None, [], [1, 2], None, None, None) for k in range(1, 51)]
    rows += [("r", k, None, None, [], None, None, [("n", 1, "a"), ("w", k, "")], None) for k in range(1, 21)]
    monkeypatch.setattr(wire, "BLOCK_ELEMENTS", 100)
    writer = pbf.PbfWriter(str(tmp_path / "f"), "zlib", None, wire.Header(), False)
    frame = spark.createDataFrame(rows, pbf.ELEMENTS)
    path = str(tmp_path / "f" / "one.osm.pbf")
    (tmp_path / "f").mkdir()
    with open(path, "wb") as out:
        out.write(wire.blob("OSMHeader", writer.header.write()))
        every = [r.asDict(recursive=True) for r in frame.collect()]
        for kind in "nwr":
            mine = [e for e in every if e["kind"] == kind]
            for i in range(0, len(mine), 100):
                out.write(wire.blob("OSMData", wire.write_block(mine[i:i + 100]), index=wire.Index.of(mine[i:i + 100])))

    def blobs(*filters):
        reader = pbf.PbfReader(path, "nwr")
        assert list(reader.pushFilters(list(filters))) == list(filters)
        return sum(len(p.spans) for p in reader.partitions())

    assert blobs() == 5 and blobs(EqualTo(("kind",), "w")) == 1 and blobs(In(("kind",), ("n", "w"))) == 4 and blobs(EqualTo(("kind",), "r"), LessThan(("id",), 5)) == 1
    assert blobs(EqualTo(("id",), 250)) == 1 and blobs(GreaterThan(("lat_e7",), 150_000), LessThan(("lat_e7",), 160_000)) == 1
    got = pbf.read_elements(spark, path).where("kind = 'n' and id > 290 and lat_e7 < 295000")
    assert sorted(r["id"] for r in got.collect()) == [291, 292, 293, 294]
    assert pbf.read_elements(spark, path).count() == 370 and pbf.read_elements(spark, path, "r").count() == 20 and pbf.read_elements(spark, path, "w").count() == 50


def _same_rows(batches):
    return [r for b in batches for r in b.to_pylist()]


def test_columns_are_what_wire_reads_and_writes():
    """Blocks coded by columns hold what blocks coded one by one hold, both ways, at the edges of numbers and lists."""
    import random

    import pytest as pt

    from mapweave.sources import columns

    pick = random.Random(7)
    big = [0, 1, -1, 127, 128, -129, 2**31 - 1, -(2**31), 2**60, -(2**60), 2**63 - 1]
    text = lambda: pick.choice(["", "a", "ß", "highway", "x" * 300, str(pick.random())])
    tags = lambda: [{"k": text() or "k", "v": text()} for _ in range(pick.choice([0, 0, 1, 5]))]
    ids = lambda: [pick.choice(big[:-1]) for _ in range(pick.choice([0, 1, 2, 200]))]
    e7 = lambda: pick.randint(-1_800_000_000, 1_800_000_000)
    for turn in range(60):
        n = pick.choice([1, 2, 50])
        nodes = [wire._row("n", pick.choice(big[:-1]), lat_e7=e7(), lon_e7=e7(), tags=tags() if turn % 3 else []) for _ in range(n)]
        ways = [wire._row("w", pick.choice(big), tags=tags(), refs=ids(), locations=[{"lat_e7": e7(), "lon_e7": e7()} for _ in range(pick.choice([0, 3]))] or None) for _ in range(n)]
        rels = [wire._row("r", pick.choice(big), tags=tags(), members=[{"type": pick.choice("nwr"), "ref": i, "role": text()} for i in ids()]) for _ in range(n)]
        for rows in (nodes, ways, rels):
            kind = rows[0]["kind"]
            content, index = columns.write_block(columns.of_rows(rows))
            assert list(wire.elements(content)) == rows and index == wire.Index.of(rows)
            other = wire.write_block(rows)
            for data in (content, other):
                try:
                    assert _same_rows(columns.elements(data)) == rows
                except columns.Unusual:  # an empty value among a node's tags looks like their end
                    assert kind == "n" and any(t["v"] == "" for r in rows for t in r["tags"])
                assert columns.elements(data, "nwr".replace(kind, "")) == []
    with_info = [wire._row("w", 1, refs=[1], info={"version": 2, "ts_s": 3, "changeset": 4, "uid": 5, "user": "u", "visible": True}) | {"tags": []}]
    content, _ = columns.write_block(columns.of_rows(with_info))
    assert list(wire.elements(content)) == with_info
    with pt.raises(columns.Unusual):
        columns.elements(content)
    assert _same_rows(pbf._rows(content, "nwr")) == with_info
    good = columns.write_block(columns.of_rows([wire._row("w", 1, refs=[5, 6]) | {"tags": []}]))[0]
    with pt.raises((columns.Unusual, ValueError)):
        columns.elements(good[:-1])


def test_parsing_changes_keeps_no_actions():
    """Memory while a file is parsed doesn't grow with the changes in it."""
    import tracemalloc

    data = b"<osmChange>" + b"".join(b'<modify><node id="%d" lat="1" lon="2"/></modify>' % k for k in range(20_000)) + b"</osmChange>"
    tracemalloc.start()
    seen = sum(1 for _ in osc.parse_changes(data))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == 20_000 and peak < 1_000_000

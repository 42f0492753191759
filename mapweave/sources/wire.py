"""The PBF wire format in plain Python: messages, blocks, blobs, both ways."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import zstandard

#: Fixed limits of the format.
MAX_HEADER, MAX_BLOB = 64 * 1024, 32 * 1024 * 1024
BLOCK_ELEMENTS = 8000
GRANULARITY, DATE_GRANULARITY = 100, 1000
KINDS = "nwr"


def varint(data, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("truncated or over-long number")
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value & 0xFFFFFFFFFFFFFFFF, at


def signed(value: int) -> int:
    """Two's complement of an unsigned 64-bit value."""
    return value - (1 << 64) if value >> 63 else value


def zigzag(value: int) -> int:
    return (value >> 1) ^ -(value & 1)


def fields(data) -> Iterator[tuple[int, int | memoryview]]:
    """Numbers and values of a message's fields."""
    data, at = memoryview(data), 0
    while at < len(data):
        key, at = varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind == 2:
            size, at = varint(data, at)
            if at + size > len(data):
                raise ValueError("truncated field")
            value, at = data[at:at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            if at + size > len(data):
                raise ValueError("truncated field")
            value, at = data[at:at + size], at + size
        else:
            raise ValueError(f"unknown wire type {kind}")
        yield key >> 3, value


def packed(data) -> list[int]:
    out, at = [], 0
    while at < len(data):
        value, at = varint(data, at)
        out.append(value)
    return out


def deltas(data) -> list[int]:
    out, total = [], 0
    for v in packed(data):
        total += zigzag(v)
        out.append(total)
    return out


def put(value: int) -> bytes:
    value &= 0xFFFFFFFFFFFFFFFF
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def put_zigzag(value: int) -> bytes:
    return put((value << 1) ^ (value >> 63))


def number(tag: int, value: int) -> bytes:
    return put(tag << 3) + put(value)


def block(tag: int, data: bytes) -> bytes:
    return put(tag << 3 | 2) + put(len(data)) + data


def put_deltas(values: Iterable[int]) -> bytes:
    out, last = [], 0
    for v in values:
        out.append(put_zigzag(v - last))
        last = v
    return b"".join(out)


@dataclass
class Header:
    """What a file says of itself; the box is (left, bottom, right, top) in units of 1e-7 degrees."""

    box: tuple[int, int, int, int] | None = None
    required: list[str] = field(default_factory=lambda: ["OsmSchema-V0.6", "DenseNodes"])
    optional: list[str] = field(default_factory=list)
    program: str = "mapweave"
    source: str = ""
    replication_timestamp: int | None = None
    replication_sequence: int | None = None
    replication_url: str = ""

    @staticmethod
    def parse(data) -> Header:
        h = Header(required=[], program="")
        for tag, v in fields(data):
            if tag == 1:
                b = {t: zigzag(x) // 100 for t, x in fields(v)}
                h.box = b.get(1, 0), b.get(4, 0), b.get(2, 0), b.get(3, 0)
            elif tag in (4, 5):
                (h.required if tag == 4 else h.optional).append(bytes(v).decode())
            elif tag in (16, 17, 34):
                setattr(h, {16: "program", 17: "source", 34: "replication_url"}[tag], bytes(v).decode())
            elif tag in (32, 33):
                setattr(h, "replication_timestamp" if tag == 32 else "replication_sequence", signed(v))
        return h

    def write(self) -> bytes:
        out = []
        if self.box:
            left, bottom, right, top = (put_zigzag(x * 100) for x in self.box)
            out.append(block(1, b"".join(put(t << 3) + v for t, v in ((1, left), (2, right), (3, top), (4, bottom)))))
        out += [block(4, x.encode()) for x in self.required] + [block(5, x.encode()) for x in self.optional]
        out += [block(t, x.encode()) for t, x in ((16, self.program), (17, self.source)) if x]
        out += [number(t, x) for t, x in ((32, self.replication_timestamp), (33, self.replication_sequence)) if x is not None]
        return b"".join([*out, block(34, self.replication_url.encode()) if self.replication_url else b""])


def unblob(data) -> bytes:
    """The content of a blob, raw or compressed; larger content than the format allows is an error."""
    raw_size, found = None, None
    for tag, v in fields(data):
        if tag == 2:
            raw_size = v
        elif tag in (1, 3, 7):
            found = tag, v
    if found is None:
        raise ValueError("a blob without data, or compressed in a way that isn't supported")
    if raw_size is not None and raw_size > MAX_BLOB:
        raise ValueError("blob too large")
    if found[0] == 1:
        out = bytes(found[1])
    elif found[0] == 3:
        out = zlib.decompressobj().decompress(bytes(found[1]), MAX_BLOB + 1)
    else:
        out = zstandard.ZstdDecompressor().decompress(bytes(found[1]), max_output_size=MAX_BLOB)
    if len(out) > MAX_BLOB or raw_size not in (None, 0, len(out)):
        raise ValueError("blob of another size than it says")
    return out


@dataclass(frozen=True)
class Index:
    """What a blob's header says of its elements: their one kind, least and largest id, and of nodes the box (lat, lon, lat, lon)."""

    kind: str
    first: int
    last: int
    box: tuple[int, int, int, int] | None = None

    MARK = b"MWI1"

    @staticmethod
    def of(rows: list[dict]) -> Index:
        ids, lats, lons = ([r[c] for r in rows] for c in ("id", "lat_e7", "lon_e7"))
        box = (min(lats), min(lons), max(lats), max(lons)) if rows[0]["kind"] == "n" else None
        return Index(rows[0]["kind"], min(ids), max(ids), box)

    def write(self) -> bytes:
        return self.MARK + self.kind.encode() + struct.pack("<2q", self.first, self.last) + (struct.pack("<4i", *self.box) if self.box else b"")

    @staticmethod
    def parse(data) -> Index | None:
        """None for what another program wrote there."""
        data = bytes(data)
        if data[:4] != Index.MARK or len(data) not in (21, 37):
            return None
        return Index(chr(data[4]), *struct.unpack_from("<2q", data, 5), struct.unpack_from("<4i", data, 21) if len(data) == 37 else None)

    def may_hold(self, kinds: str = KINDS, box: tuple[int, int, int, int] | None = None, ids: tuple[int, int] | None = None) -> bool:
        """Whether the blob can have elements of these kinds, nodes in this box, ids in this range."""
        if self.kind not in kinds or ids and (ids[1] < self.first or ids[0] > self.last):
            return False
        return not (box and self.box) or self.box[0] <= box[2] and box[0] <= self.box[2] and self.box[1] <= box[3] and box[1] <= self.box[3]


def blob(kind: str, content: bytes, compression: str = "zlib", level: int | None = None, index: Index | None = None) -> bytes:
    """A framed blob."""
    if compression == "none":
        body = block(1, content)
    elif compression == "zlib":
        body = number(2, len(content)) + block(3, zlib.compress(content, 6 if level is None else level))
    elif compression == "zstd":
        body = number(2, len(content)) + block(7, zstandard.ZstdCompressor(level=3 if level is None else level).compress(content))
    else:
        raise ValueError(f"unknown compression {compression!r}")
    head = block(1, kind.encode()) + (block(2, index.write()) if index else b"") + number(3, len(body))
    return struct.pack(">I", len(head)) + head + body


def walk(f) -> Iterator[tuple[str, int, int]]:
    """(kind, offset, size) of the blobs of an open file; only their headers are read."""
    return (x[:3] for x in walk_indexed(f))


def walk_indexed(f) -> Iterator[tuple[str, int, int, Index | None]]:
    """The same with each blob's index, where it has one."""
    at = 0
    f.seek(0)
    while True:
        head = f.read(4)
        if not head:
            return
        if len(head) < 4:
            raise ValueError("truncated file")
        size = struct.unpack(">I", head)[0]
        if size > MAX_HEADER:
            raise ValueError("blob header too large")
        data = f.read(size)
        if len(data) < size:
            raise ValueError("truncated file")
        h = dict(fields(data))
        if h.get(3, 0) > MAX_BLOB:
            raise ValueError("blob too large")
        yield bytes(h[1]).decode(), at + 4 + size, h[3], Index.parse(h[2]) if 2 in h else None
        at += 4 + size + h[3]
        f.seek(at)


def _info(data, strings: list[str], dates: int) -> dict | None:
    v = dict(fields(data))
    if not v or v.get(1) is not None and signed(v[1]) == -1:
        return None
    return {
        "version": signed(v[1]) if 1 in v else None, "ts_s": signed(v[2]) * dates // 1000 if 2 in v else None, "changeset": signed(v[3]) if 3 in v else None,
        "uid": signed(v[4]) if 4 in v else None, "user": strings[v[5]] if 5 in v else None, "visible": bool(v[6]) if 6 in v else True,
    }


def _row(kind: str, id_: int, **more) -> dict:
    return {"kind": kind, "id": id_, "lat_e7": None, "lon_e7": None, "tags": [], "refs": None, "locations": None, "members": None, "info": None} | more


def elements(content: bytes, wanted: str = KINDS) -> Iterator[dict]:
    """The elements of a primitive block that are of the given kinds, in file order; groups of others aren't read."""
    strings: list[str] = []
    groups, gran, dates, lat0, lon0 = [], GRANULARITY, DATE_GRANULARITY, 0, 0
    for tag, v in fields(content):
        if tag == 1:
            strings = [bytes(s).decode("utf-8", "replace") for t, s in fields(v) if t == 1]
        elif tag == 2:
            groups.append(v)
        elif tag == 17:
            gran = v
        elif tag == 18:
            dates = v
        elif tag == 19:
            lat0 = signed(v)
        elif tag == 20:
            lon0 = signed(v)
    units = lambda offset, raw: int((offset + gran * raw) / 100) if (offset + gran * raw) % 100 else (offset + gran * raw) // 100
    tags = lambda keys, values: [{"k": strings[a], "v": strings[b]} for a, b in zip(keys, values, strict=True)]
    for group in groups:
        for tag, v in fields(group):
            if not 1 <= tag <= 4 or "nnwr"[tag - 1] not in wanted:
                continue
            if tag == 2:
                yield from _dense(v, strings, dates, lambda x: units(lat0, x), lambda x: units(lon0, x))
                continue
            e ={t: x for t, x in fields(v)}
            common = {"tags": tags(packed(e.get(2, b"")), packed(e.get(3, b""))), "info": _info(e[4], strings, dates) if 4 in e else None}
            if tag == 1:
                yield _row("n", zigzag(e[1]), lat_e7=units(lat0, zigzag(e.get(8, 0))), lon_e7=units(lon0, zigzag(e.get(9, 0))), **common)
            elif tag == 3:
                lats, lons = deltas(e.get(9, b"")), deltas(e.get(10, b""))
                places = [{"lat_e7": units(lat0, a), "lon_e7": units(lon0, b)} for a, b in zip(lats, lons, strict=True)] or None
                yield _row("w", signed(e[1]), refs=deltas(e.get(8, b"")), locations=places, **common)
            else:
                roles, ids, kinds = packed(e.get(8, b"")), deltas(e.get(9, b"")), packed(e.get(10, b""))
                members = [{"type": KINDS[k] if k < 3 else f"u{k}", "ref": i, "role": strings[r]} for r, i, k in zip(roles, ids, kinds, strict=True)]
                yield _row("r", signed(e[1]), members=members, **common)


def _dense(data, strings: list[str], dates: int, lat, lon) -> Iterator[dict]:
    e = dict(fields(data))
    ids, lats, lons = (deltas(e.get(t, b"")) for t in (1, 8, 9))
    info = dict(fields(e[5])) if 5 in e else {}
    versions = [signed(x) for x in packed(info.get(1, b""))]
    times, sets, uids, users = (deltas(info.get(t, b"")) for t in (2, 3, 4, 5))
    shown = packed(info.get(6, b""))
    words, at = packed(e.get(10, b"")), 0
    for k, (i, a, b) in enumerate(zip(ids, lats, lons, strict=True)):
        tags = []
        while at < len(words):
            if words[at] == 0:
                at += 1
                break
            tags.append({"k": strings[words[at]], "v": strings[words[at + 1]]})
            at += 2
        meta = None
        if k < len(versions) and versions[k] != -1:
            meta = {"version": versions[k], "ts_s": times[k] * dates // 1000, "changeset": max(0, sets[k]), "uid": uids[k], "user": strings[users[k]], "visible": bool(shown[k]) if shown else True}
        yield _row("n", i, lat_e7=lat(a), lon_e7=lon(b), tags=tags, info=meta)


class Strings:
    """A block's table of strings; number 0 stays empty."""

    def __init__(self):
        self.ids: dict[str, int] = {"": 0}

    def __call__(self, s: str) -> int:
        return self.ids.setdefault(s, len(self.ids))

    def write(self) -> bytes:
        return block(1, b"".join(block(1, s.encode()) for s in self.ids))


def write_block(rows: list[dict]) -> bytes:
    """A primitive block of elements of one kind."""
    table = Strings()
    kind = rows[0]["kind"]
    group = _put_dense(rows, table) if kind == "n" else b"".join(block(3 if kind == "w" else 4, _put_element(r, table)) for r in rows)
    return table.write() + block(2, group)


def _put_tags(row: dict, table: Strings) -> bytes:
    if not row["tags"]:
        return b""
    return block(2, b"".join(put(table(t["k"])) for t in row["tags"])) + block(3, b"".join(put(table(t["v"])) for t in row["tags"]))


def _put_info(info: dict | None, table: Strings) -> bytes:
    if not info:
        return b""
    out = [number(t, info[k]) for t, k in ((1, "version"), (2, "ts_s"), (3, "changeset"), (4, "uid")) if info.get(k) is not None]
    if info.get("user") is not None:
        out.append(number(5, table(info["user"])))
    if info.get("visible") is not None:
        out.append(number(6, int(info["visible"])))
    return block(4, b"".join(out))


def _put_element(row: dict, table: Strings) -> bytes:
    out = number(1, row["id"]) + _put_tags(row, table) + _put_info(row["info"], table)
    if row["kind"] == "w":
        out += block(8, put_deltas(row["refs"] or []))
        if row["locations"]:
            out += block(9, put_deltas(p["lat_e7"] for p in row["locations"])) + block(10, put_deltas(p["lon_e7"] for p in row["locations"]))
        return out
    members = row["members"] or []
    kinds = [KINDS.index(m["type"]) if m["type"] in KINDS else int(m["type"][1:]) for m in members]
    return out + block(8, b"".join(put(table(m["role"] or "")) for m in members)) + block(9, put_deltas(m["ref"] for m in members)) + block(10, b"".join(map(put, kinds)))


def _put_dense(rows: list[dict], table: Strings) -> bytes:
    out = block(1, put_deltas(r["id"] for r in rows))
    if any(r["info"] for r in rows):
        blank = {"version": -1, "ts_s": 0, "changeset": 0, "uid": 0, "user": "", "visible": True}
        infos = [{k: (r["info"] or blank).get(k) if (r["info"] or blank).get(k) is not None else blank[k] for k in blank} for r in rows]
        meta = block(1, b"".join(put(i["version"]) for i in infos))
        meta += b"".join(block(t, put_deltas(i[k] for i in infos)) for t, k in ((2, "ts_s"), (3, "changeset"), (4, "uid")))
        meta += block(5, put_deltas(table(i["user"]) for i in infos))
        if not all(i["visible"] for i in infos):
            meta += block(6, b"".join(put(int(i["visible"])) for i in infos))
        out += block(5, meta)
    out += block(8, put_deltas(r["lat_e7"] for r in rows)) + block(9, put_deltas(r["lon_e7"] for r in rows))
    if any(r["tags"] for r in rows):
        out += block(10, b"".join(b"".join(put(table(t["k"])) + put(table(t["v"])) for t in r["tags"]) + b"\0" for r in rows))
    return block(2, out)

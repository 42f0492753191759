"""Blocks of the PBF format from and to Arrow columns: numbers of a whole block are coded at once.

All of a block but its strings is a run of variable-length numbers (keys, lengths, values), so a block is written by
laying out the numbers of all its elements and coding them together, and read by decoding all and finding elements and
fields among them. Blocks of other forms (unusual fields, other widths) raise ``Unusual`` and are left to ``wire``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from . import wire

_text, _int, _long = pa.string(), pa.int32(), pa.int64()
#: Arrow types of schema.ELEMENTS, which executors have without a session.
TYPES = {
    "kind": _text, "id": _long, "lat_e7": _int, "lon_e7": _int, "tags": pa.list_(pa.struct([("k", _text), ("v", _text)])), "refs": pa.list_(_long),
    "locations": pa.list_(pa.struct([("lat_e7", _int), ("lon_e7", _int)])), "members": pa.list_(pa.struct([("type", _text), ("ref", _long), ("role", _text)])),
    "info": pa.struct([("version", _int), ("ts_s", _long), ("changeset", _long), ("uid", _int), ("user", _text), ("visible", pa.bool_())]),
}
SCHEMA = pa.schema(list(TYPES.items()))


class Unusual(Exception):
    """A block that isn't of the usual form."""


def lengths(v: np.ndarray) -> np.ndarray:
    """Bytes that each unsigned number takes."""
    out = np.ones(len(v), np.int64)
    for k in range(1, 10):
        out += v >= np.uint64(1 << 7 * k)
    return out


def coded(v: np.ndarray) -> np.ndarray:
    """Variable-length bytes of unsigned numbers."""
    size = lengths(v)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(v) else 0, np.uint8)
    starts = ends - size
    for k in range(int(size.max(initial=0))):
        has = np.flatnonzero(size > k)
        more = (size[has] > k + 1).astype(np.uint8) << 7
        out[starts[has] + k] = ((v[has] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more
    return out


def decoded(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned numbers of bytes, and where each starts (and the end)."""
    ends = np.flatnonzero(data < 128) + 1
    if len(data) and (not len(ends) or ends[-1] != len(data)):
        raise Unusual("a number without an end")
    starts = np.concatenate(([0], ends)).astype(np.int64)
    size = np.diff(starts)
    if size.max(initial=0) > 10:
        raise Unusual("an over-long number")
    v = np.zeros(len(size), np.uint64)
    for k in range(int(size.max(initial=0))):
        has = size > k
        v[has] |= (data[starts[:-1][has] + k] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * k)
    return v, starts


def folded(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.int64)
    return ((v << 1) ^ (v >> 63)).view(np.uint64)


def unfolded(v: np.ndarray) -> np.ndarray:
    return (v >> np.uint64(1)).view(np.int64) ^ -(v & np.uint64(1)).view(np.int64)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def run_deltas(v: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Differences inside runs; the first of a run is itself."""
    out = v.astype(np.int64).copy()
    out[1:] -= v[:-1]
    first = (np.cumsum(counts) - counts)[counts > 0]
    out[first] = v[first]
    return out


def run_sums(v: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.cumsum(v)
    first = np.cumsum(counts) - counts
    before = np.where(first > 0, total[np.maximum(first, 1) - 1], 0) if len(v) else first
    return total - np.repeat(before, counts)


# -- writing


class Fields:
    """Fields of elements, laid out number by number: each is a key and, a run an element, numbers with their length or one number without."""

    def __init__(self, n: int):
        self.n, self.parts = n, []

    def one(self, tag: int, v: np.ndarray, has: np.ndarray | None = None) -> None:
        self.parts.append((tag << 3, np.ones(self.n, np.int64) if has is None else has.astype(np.int64), v.astype(np.uint64), False))

    def run(self, tag: int, v: np.ndarray, counts: np.ndarray, always: bool = False) -> None:
        self.parts.append((tag << 3 | 2, counts, v, always))

    def numbers(self, key: int) -> np.ndarray:
        """All numbers of the elements as messages of a key."""
        sizes, laid = np.zeros(self.n, np.int64), []
        for tag, counts, v, always in self.parts:
            if tag & 7:
                ends = np.concatenate(([0], np.cumsum(lengths(v))))
                stop = np.cumsum(counts)
                inner = ends[stop] - ends[stop - counts]
                shown = counts > 0 if not always else np.ones(self.n, bool)
                sizes += np.where(shown, lengths(np.array([tag], np.uint64))[0] + lengths(inner.astype(np.uint64)) + inner, 0)
                laid.append((tag, counts, v, inner, shown))
            else:
                shown = counts > 0
                values = np.zeros(self.n, np.uint64)
                values[shown] = v
                sizes += np.where(shown, lengths(np.array([tag], np.uint64))[0] + lengths(values), 0)
                laid.append((tag, None, values, None, shown))
        width = np.full(self.n, 2, np.int64)
        for tag, counts, *_, shown in laid:
            width += np.where(shown, 2 if counts is None else 2 + counts, 0)
        at = np.cumsum(width) - width
        out = np.zeros(int(width.sum()), np.uint64)
        out[at], out[at + 1] = key, sizes.astype(np.uint64)
        at = at + 2
        for tag, counts, v, inner, shown in laid:
            out[at[shown]] = tag
            if counts is None:
                out[at[shown] + 1] = v[shown]
                at = at + np.where(shown, 2, 0)
            else:
                out[at[shown] + 1] = inner[shown].astype(np.uint64)
                out[spread(at + 2, counts)] = v
                at = at + np.where(shown, 2 + counts, 0)
        return out


class Table:
    """Strings of a block."""

    def __init__(self):
        self.columns: list[pa.Array] = []

    def add(self, texts: pa.Array) -> int:
        self.columns.append(texts.fill_null("") if texts.null_count else texts)
        return len(self.columns) - 1

    def close(self) -> tuple[bytes, list[np.ndarray]]:
        """The message, and each column's numbers in it."""
        whole = pa.chunked_array([pa.array([""], pa.string()), *self.columns], pa.string()).combine_chunks()
        whole = (whole.chunk(0) if isinstance(whole, pa.ChunkedArray) else whole).dictionary_encode()
        ids, out, at = whole.indices.to_numpy().astype(np.uint64), [], 1
        for c in self.columns:
            out.append(ids[at:at + len(c)])
            at += len(c)
        return wire.block(1, b"".join(wire.block(1, s.encode()) for s in whole.dictionary.to_pylist())), out


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Sizes and items of lists; a missing one is empty."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64), column.flatten()


def _ints(column: pa.Array) -> np.ndarray:
    if column.null_count:
        raise ValueError("a missing number")
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def write_block(rows: pa.RecordBatch) -> tuple[bytes, wire.Index]:
    """A block of elements of one kind, and its index. Elements with metadata or of unknown member kinds go through ``wire``."""
    kind, ids = rows.column("kind")[0].as_py(), _ints(rows.column("id"))
    lats, lons = (rows.column(c) for c in ("lat_e7", "lon_e7"))
    members = rows.column("members")
    plain = rows.column("info").null_count == len(rows) and not (kind == "n" and (lats.null_count or lons.null_count))
    if plain and kind == "r":
        sizes, items = _lists(members)
        known = {"n": 0, "w": 1, "r": 2}
        types = items.field("type").dictionary_encode()
        plain = types.null_count == 0 and items.field("ref").null_count == 0 and all(t in known for t in types.dictionary.to_pylist())
    if not plain:
        as_rows = [r | {"tags": r["tags"] or []} for r in rows.to_pylist()]
        return wire.write_block(as_rows), wire.Index.of(as_rows)
    table, n = Table(), len(rows)
    n_tags, tags = _lists(rows.column("tags"))
    k, v = table.add(tags.field("k")), table.add(tags.field("v"))
    box = None
    if kind == "n":
        text, strings = table.close()
        lat, lon = _ints(lats), _ints(lons)
        whole = lambda tag, x: wire.block(tag, coded(folded(run_deltas(x, np.array([n])))).tobytes())
        body = whole(1, ids) + whole(8, lat) + whole(9, lon)
        if len(tags):
            pairs = np.zeros(2 * len(tags) + n, np.uint64)
            at = spread(np.cumsum(2 * n_tags + 1) - (2 * n_tags + 1), 2 * n_tags)
            pairs[at] = np.stack([strings[k], strings[v]], 1).reshape(-1)
            body += wire.block(10, coded(pairs).tobytes())
        group = wire.block(2, body)
        box = int(lat.min()), int(lon.min()), int(lat.max()), int(lon.max())
    else:
        fields = Fields(n)
        fields.one(1, ids)
        if kind == "w":
            text, strings = table.close()
        else:
            roles = table.add(items.field("role"))
            text, strings = table.close()
        fields.run(2, strings[k], n_tags)
        fields.run(3, strings[v], n_tags)
        if kind == "w":
            n_refs, refs = _lists(rows.column("refs"))
            fields.run(8, folded(run_deltas(_ints(refs), n_refs)), n_refs, always=True)
            n_places, places = _lists(rows.column("locations"))
            for tag, name in ((9, "lat_e7"), (10, "lon_e7")):
                fields.run(tag, folded(run_deltas(_ints(places.field(name)), n_places)), n_places)
        else:
            kinds = np.array([known[t] for t in types.dictionary.to_pylist()], np.uint64)[types.indices.to_numpy()] if len(types) else np.zeros(0, np.uint64)
            fields.run(8, strings[roles], sizes, always=True)
            fields.run(9, folded(run_deltas(_ints(items.field("ref")), sizes)), sizes, always=True)
            fields.run(10, kinds, sizes, always=True)
        group = coded(fields.numbers((3 if kind == "w" else 4) << 3 | 2)).tobytes()
    return text + wire.block(2, group), wire.Index(kind, int(ids.min()), int(ids.max()), box)


# -- reading


def _batch(kind: str, n: int, **columns) -> pa.RecordBatch:
    have = {"kind": pa.repeat(pa.scalar(kind, pa.string()), n)} | columns
    return pa.RecordBatch.from_arrays([have[c].cast(t) if c in have else pa.nulls(n, t) for c, t in TYPES.items()], names=list(TYPES))


def _list(counts: np.ndarray, items: pa.Array, missing: bool = False) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    offsets = pa.array(ends, mask=np.append(counts == 0, False)) if missing else pa.array(ends)
    return pa.ListArray.from_arrays(offsets, items)


def _struct(**columns) -> pa.Array:
    return pa.StructArray.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def _texts(strings: pa.Array, ids: np.ndarray) -> pa.Array:
    if len(ids) and int(ids.max()) >= len(strings):
        raise Unusual("a string that isn't there")
    return strings.take(pa.array(ids.astype(np.int64)))


def _bytes(view) -> np.ndarray:
    return np.frombuffer(view, np.uint8)


def elements(content: bytes, wanted: str = wire.KINDS) -> list[pa.RecordBatch]:
    """The elements of a block that are of the given kinds; the same rows as ``wire.elements``. ``Unusual`` where only that can read it."""
    strings, groups = [], []
    for tag, v in wire.fields(content):
        if tag == 1:
            strings = [bytes(s).decode("utf-8", "replace") for t, s in wire.fields(v) if t == 1]
        elif tag == 2:
            groups.append(v)
        elif tag in (17, 18, 19, 20) and v != {17: wire.GRANULARITY, 18: wire.DATE_GRANULARITY}.get(tag, 0):
            raise Unusual("other units")
    table = pa.array(strings, pa.string())
    out = []
    for group in groups:
        first = group[0] >> 3 if len(group) else 0
        if not 1 <= first <= 4:
            if len(group):
                raise Unusual("another group")
            continue
        if first == 2:
            found = list(wire.fields(group))
            if len(found) != 1:
                raise Unusual("a mixed group")
            if "n" in wanted:
                out.append(_dense(found[0][1], table))
        elif first == 1:
            raise Unusual("plain nodes")
        elif "wr"[first - 3] in wanted:
            out.append(_grouped(group, first, table))
        elif any(tag != first for tag, _ in wire.fields(group)):
            raise Unusual("a mixed group")
    return [b for b in out if len(b)]


def _dense(data, table: pa.Array) -> pa.RecordBatch:
    pairs = list(wire.fields(data))
    e = dict(pairs)
    if len(e) < len(pairs) or any(t not in (1, 8, 9, 10) for t in e):
        raise Unusual("metadata or unknown fields")
    ids, lats, lons = (np.cumsum(unfolded(decoded(_bytes(e.get(t, b"")))[0])) for t in (1, 8, 9))
    n = len(ids)
    if len(lats) != n or len(lons) != n:
        raise Unusual("columns of different lengths")
    words = decoded(_bytes(e.get(10, b"")))[0]
    counts, flat = np.zeros(n, np.int64), words[:0]
    if len(words):
        if n and not words.any() and len(words) == n:
            pass
        else:
            counts, flat = _dense_tags(words, n)
    tags = _struct(k=_texts(table, flat[0::2]), v=_texts(table, flat[1::2]))
    return _batch("n", n, id=pa.array(ids), lat_e7=pa.array(lats), lon_e7=pa.array(lons), tags=_list(counts, tags))


def _dense_tags(words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Tags of each node, and the numbers without the zeros that end a node's."""
    stops = np.flatnonzero(words == 0)
    if len(stops) != n or stops[-1] != len(words) - 1:
        raise Unusual("empty strings among tags, or nodes without an end")
    counts = np.diff(np.concatenate(([-1], stops))) - 1
    if (counts % 2).any():
        raise Unusual("a key without a value")
    return counts // 2, words[words != 0]


def _grouped(group, tag: int, table: pa.Array) -> pa.RecordBatch:
    """Ways (3) or relations (4): elements are found one after the other, their fields of all elements together."""
    v, starts = decoded(_bytes(group))
    data, at = bytes(group), 0
    key, begins, ends = tag << 3 | 2, [], []
    while at < len(data):
        if data[at] != key:
            raise Unusual("a mixed group")
        at += 1
        size = shift = 0
        while True:
            if at >= len(data):
                raise Unusual("truncated group")
            b = data[at]
            at += 1
            size |= (b & 127) << shift
            if b < 128:
                break
            shift += 7
        begins.append(at)
        at += size
        ends.append(at)
    if at != len(data):
        raise Unusual("truncated group")
    begins, ends = np.array(begins), np.array(ends)
    n = len(begins)
    number_at = np.full(len(data) + 1, -1, np.int64)
    number_at[starts] = np.arange(len(starts))
    now, stop = number_at[begins], number_at[ends]
    if (now < 0).any() or (stop < 0).any():
        raise Unusual("fields that aren't numbers")
    usual = {8 | 0: True, 2 << 3 | 2: True, 3 << 3 | 2: True, 8 << 3 | 2: True, 9 << 3 | 2: True, 10 << 3 | 2: True}
    ids, had = np.zeros(n, np.int64), {k: np.zeros(n, bool) for k in usual}
    first, count = ({k: np.zeros(n, np.int64) for k in usual} for _ in range(2))
    live = np.flatnonzero(now < stop)
    while len(live):
        keys = v[now[live]]
        left = []
        for k in np.unique(keys).tolist():
            here = live[keys == k]
            if k not in usual or had[k][here].any() or (now[here] + 1 >= stop[here]).any():
                raise Unusual("unknown, repeated or truncated fields")
            had[k][here] = True
            if k == 8:
                ids[here] = v[now[here] + 1].view(np.int64)
                now[here] += 2
            else:
                begin = now[here] + 2
                sizes = v[now[here] + 1]
                if (sizes > len(data)).any() or (starts[begin] + sizes.astype(np.int64) > len(data)).any():
                    raise Unusual("truncated field")
                end = number_at[starts[begin] + sizes.astype(np.int64)]
                if (end < 0).any() or (end > stop[here]).any():
                    raise Unusual("fields that aren't numbers")
                first[k][here], count[k][here] = begin, end - begin
                now[here] = end
            left.append(here[now[here] < stop[here]])
        live = np.concatenate(left)
    if not had[8].all():
        raise Unusual("an element without id")
    run = lambda t: (v[spread(first[t << 3 | 2], count[t << 3 | 2])], count[t << 3 | 2])
    (ks, n_k), (vs, n_v) = run(2), run(3)
    if (n_k != n_v).any():
        raise Unusual("keys and values of different number")
    tags = _list(n_k, _struct(k=_texts(table, ks), v=_texts(table, vs)))
    sums = lambda x, c: run_sums(unfolded(x), c)
    (a, n_a), (b, n_b), (c, n_c) = run(8), run(9), run(10)
    if tag == 3:
        if (n_b != n_c).any():
            raise Unusual("latitudes and longitudes of different number")
        places = _struct(lat_e7=pa.array(sums(b, n_b)).cast(pa.int32()), lon_e7=pa.array(sums(c, n_c)).cast(pa.int32()))
        return _batch("w", n, id=pa.array(ids), tags=tags, refs=_list(n_a, pa.array(sums(a, n_a))), locations=_list(n_b, places, missing=True))
    if (n_a != n_b).any() or (n_b != n_c).any() or len(c) and int(c.max()) > 2:
        raise Unusual("members of unknown kinds, or of different number")
    kinds = pa.array(list(wire.KINDS)).take(pa.array(c.astype(np.int64)))
    members = _struct(type=kinds, ref=pa.array(sums(b, n_b)), role=_texts(table, a))
    return _batch("r", n, id=pa.array(ids), tags=tags, members=_list(n_b, members))


def of_rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, SCHEMA)

"""Change files (XML, plain or gzipped) as tables of changes, both ways."""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator
from datetime import datetime, timezone
from xml.etree import ElementTree
from xml.sax.saxutils import quoteattr

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from mapweave.schema import CHANGES

KINDS = {"node": "n", "way": "w", "relation": "r"}
ACTIONS = ("create", "modify", "delete")


def _e7(text: str | None) -> int | None:
    return None if text is None else round(float(text) * 1e7)


def _seconds(text: str | None) -> int | None:
    return None if text is None else int(datetime.strptime(text, "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=timezone.utc).timestamp())


def parse_changes(data: bytes) -> Iterator[dict]:
    """Changes of one file in its order; ``seq`` counts them. Elements are dropped from memory once read."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    action, seq, root = None, 0, None
    for event, e in ElementTree.iterparse(stream, ("start", "end")):
        if root is None:
            root = e
        if e.tag in ACTIONS:
            action = e.tag if event == "start" else None
            if event == "end" and e is not root:
                root.clear()  # or the root would keep every action, empty as it is
        elif event == "end" and e.tag in KINDS and action:
            kind, a = KINDS[e.tag], e.attrib
            whole = lambda name: int(a[name]) if name in a else None  # noqa: B023, E731
            info = None
            if "version" in a:
                info = {"version": whole("version"), "ts_s": _seconds(a.get("timestamp")), "changeset": whole("changeset"), "uid": whole("uid"), "user": a.get("user"), "visible": a["visible"] == "true" if "visible" in a else None}
            yield {
                "seq": seq, "action": action, "kind": kind, "id": int(a["id"]), "lat_e7": _e7(a.get("lat")), "lon_e7": _e7(a.get("lon")),
                "tags": [{"k": t.get("k", ""), "v": t.get("v", "")} for t in e.iter("tag")],
                "refs": [int(n.get("ref")) for n in e.iter("nd")] if kind == "w" else None, "locations": None,
                "members": [{"type": KINDS.get(m.get("type"), "u?"), "ref": int(m.get("ref")), "role": m.get("role", "")} for m in e.iter("member")] if kind == "r" else None, "info": info,
            }
            seq += 1
            e.clear()


def changes_of(contents: DataFrame) -> DataFrame:
    """Changes of a table (path, content) of whole files; ``stream`` is the number in a file's name (0 without), which orders files."""
    schema = StructType.fromDDL("stream bigint, file string, " + CHANGES)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):  # one file at a time becomes Python bytes
                name = batch.column(0)[k].as_py().rsplit("/", 1)[-1]
                number = re.match(r"\d+", name)
                rows = []
                for c in parse_changes(batch.column(1)[k].as_py()):
                    rows.append({"stream": int(number[0]) if number else 0, "file": name} | c)
                    if len(rows) == 8192:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    return contents.select("path", "content").mapInArrow(run, schema)


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """Changes of a file or of all change files in a folder. Spark reads the bytes, so any store will do; a task parses whole files."""
    return changes_of(spark.read.format("binaryFile").option("pathGlobFilter", "*.{osc,gz,txt}").load(path))


def _xml(rows: pd.DataFrame) -> pd.Series:
    out = []
    names = {v: k for k, v in KINDS.items()}
    for r in rows.itertuples(index=False):
        tag = names[r.kind]
        a = [f'id="{r.id}"']
        if r.info is not None:
            i = r.info
            stamp = datetime.fromtimestamp(int(i["ts_s"]), timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ") if i["ts_s"] is not None and i["ts_s"] == i["ts_s"] else None
            for name, v in (("version", i["version"]), ("timestamp", stamp), ("changeset", i["changeset"]), ("uid", i["uid"]), ("user", i["user"]), ("visible", None if i["visible"] is None else str(bool(i["visible"])).lower())):
                if v is not None and v == v:
                    a.append(f"{name}={quoteattr(str(int(v)) if isinstance(v, float) else str(v))}")
        if r.kind == "n" and r.lat_e7 is not None and r.lat_e7 == r.lat_e7:
            a += [f'lat="{int(r.lat_e7) / 1e7:.7f}"', f'lon="{int(r.lon_e7) / 1e7:.7f}"']
        inner = "".join(f'<nd ref="{x}"/>' for x in (r.refs if r.refs is not None else []))
        inner += "".join(f'<member type="{names.get(m["type"], m["type"])}" ref="{m["ref"]}" role={quoteattr(m["role"] or "")}/>' for m in (r.members if r.members is not None else []))
        inner += "".join(f'<tag k={quoteattr(t["k"])} v={quoteattr(t["v"])}/>' for t in (r.tags if r.tags is not None else []))
        out.append(f"<{r.action}><{tag} {' '.join(a)}>{inner}</{tag}></{r.action}>")
    return pd.Series(out, dtype=object)


def change_xml() -> Column:
    """The XML of one change from a table of the changes' schema."""
    @F.pandas_udf("string")
    def run(rows: pd.DataFrame) -> pd.Series:
        return _xml(rows)

    return run(F.struct("action", "kind", "id", "lat_e7", "lon_e7", "tags", "refs", "members", "info"))


def write_changes(changes: DataFrame, path: str, order: list[str] | None = None, compress: bool = True) -> None:
    """Writes changes as whole gzipped change files, one a task, in the given order (``seq``), through Spark's committer."""
    columns = [f.name for f in StructType.fromDDL(CHANGES)]
    have = changes.select([F.col(c) if c in changes.columns else F.lit(None).cast(f.dataType).alias(c) for c, f in zip(columns, StructType.fromDDL(CHANGES), strict=True)])
    lines = have.orderBy(*(order or ["seq"])).select(change_xml().alias("value"))

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.record_batch({"value": pa.array(['<?xml version="1.0" encoding="UTF-8"?>\n<osmChange version="0.6" generator="mapweave">'])})
        yield from batches
        yield pa.record_batch({"value": pa.array(["</osmChange>"])})

    lines.mapInArrow(framed, "value string").write.option("compression", "gzip" if compress else "none").text(path)

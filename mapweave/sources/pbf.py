"""PBF files as a Spark data source: ``spark.read.format("mapweave-pbf").load(path)``, and the same for writing.

Reading splits a file at blob boundaries, which a walk over blob headers finds. Writing makes a folder of files, each
whole by itself: a task writes blocks under a temporary name and the commit gives them their names, so tasks that are
run again leave nothing behind. Paths go through pyarrow file systems.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from mapweave.model import Dataset, id_key
from mapweave.schema import ELEMENTS

from . import columns, wire

PARTITION_BYTES = 32 * 1024 * 1024


def _store(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def files(path: str) -> list[str]:
    """The files under a path, or the path itself; names with a leading dot or underscore are passed over."""
    from pyarrow import fs

    store, at = _store(path)
    if store.get_file_info(at).type != fs.FileType.Directory:
        return [path]
    head = path[: len(path) - len(at)] if path.endswith(at) else ""
    return sorted(head + x.path for x in store.get_file_info(fs.FileSelector(at)) if x.type == fs.FileType.File and x.base_name[0] not in "._")


class Blobs(InputPartition):
    def __init__(self, path: str, spans: list[tuple[int, int]]):
        self.path, self.spans = path, spans


COLUMNS = ("kind", "id", "lat_e7", "lon_e7")


class PbfReader(DataSourceReader):
    """Filters on kind, id and coordinates choose blobs by the indexes in their headers; blobs without one are read. Spark filters the rows again."""

    def __init__(self, path: str, kinds: str, box: tuple[int, int, int, int] | None = None):
        self.path, self.kinds, self.box, self.ids = path, kinds, box, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        low = dict.fromkeys(COLUMNS[1:], -(1 << 63))
        high = dict.fromkeys(COLUMNS[1:], (1 << 63) - 1)
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name == "kind" and isinstance(f, (EqualTo, In)):
                values = [f.value] if isinstance(f, EqualTo) else f.value
                self.kinds = "".join(k for k in self.kinds if k in values)
            elif name in low and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, In)):
                values = list(f.value) if isinstance(f, In) else [f.value]
                if values and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, In)):
                    low[name] = max(low[name], min(values))
                if values and isinstance(f, (EqualTo, LessThan, LessThanOrEqual, In)):
                    high[name] = min(high[name], max(values))
                if name != "id":  # only nodes have coordinates
                    self.kinds = "n" if "n" in self.kinds else ""
            yield f
        self.ids = low["id"], high["id"]
        own = low["lat_e7"], low["lon_e7"], high["lat_e7"], high["lon_e7"]
        self.box = own if self.box is None else (*map(max, own[:2], self.box[:2]), *map(min, own[2:], self.box[2:]))

    def wanted(self, index: wire.Index | None) -> bool:
        return index is None or index.may_hold(self.kinds, self.box, self.ids)

    def partitions(self) -> list[Blobs]:
        out = []
        for path in files(self.path):
            store, at = _store(path)
            with store.open_input_file(at) as f:
                spans, size = [], 0
                for kind, offset, length, index in wire.walk_indexed(f):
                    if kind != "OSMData" or not self.wanted(index):
                        continue
                    spans.append((offset, length))
                    size += length
                    if size >= PARTITION_BYTES:
                        out.append(Blobs(path, spans))
                        spans, size = [], 0
                if spans:
                    out.append(Blobs(path, spans))
        return out or [Blobs("", [])]

    def read(self, partition: Blobs) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, at = _store(partition.path)
        with store.open_input_file(at) as f:
            for offset, size in partition.spans:
                f.seek(offset)
                data = f.read(size)
                if len(data) < size:
                    raise ValueError(f"truncated file: {partition.path}")
                yield from _rows(wire.unblob(data), self.kinds)


def _rows(content: bytes, kinds: str) -> Iterator[pa.RecordBatch]:
    """Elements of a block: by columns, or one by one where the block isn't of the usual form."""
    try:
        yield from columns.elements(content, kinds)
    except (columns.Unusual, pa.ArrowInvalid):
        rows = iter(wire.elements(content, kinds))
        while chunk := list(itertools.islice(rows, wire.BLOCK_ELEMENTS)):
            yield columns.of_rows(chunk)


class Written(WriterCommitMessage):
    def __init__(self, temporary: str, final: str):
        self.temporary, self.final = temporary, final


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one kind of at most BLOCK_ELEMENTS rows."""
    held: list[pa.RecordBatch] = []
    size = 0
    whole = lambda: pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    for batch in batches:
        runs = pc.run_end_encode(batch.column("kind"))
        start = 0
        for kind, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
            if held and held[-1].column("kind")[0].as_py() != kind:
                yield whole()
                held, size = [], 0
            while start < end:
                part = batch.slice(start, min(end - start, wire.BLOCK_ELEMENTS - size))
                held.append(part)
                start, size = start + len(part), size + len(part)
                if size == wire.BLOCK_ELEMENTS:
                    yield whole()
                    held, size = [], 0
    if held:
        yield whole()


class PbfWriter(DataSourceArrowWriter):
    def __init__(self, path: str, compression: str, level: int | None, header: wire.Header, overwrite: bool):
        self.path, self.compression, self.level, self.header, self.overwrite = path, compression, level, header, overwrite

    def write(self, rows: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        store, at = _store(self.path)
        name = f"part-{TaskContext.get().partitionId():05d}.osm.pbf"
        temporary = f"{at}/_{uuid.uuid4().hex}-{name}"
        store.create_dir(at, recursive=True)
        with store.open_output_stream(temporary) as out:
            out.write(wire.blob("OSMHeader", self.header.write(), self.compression, self.level))
            for block in _blocks(rows):
                content, index = columns.write_block(block)
                out.write(wire.blob("OSMData", content, self.compression, self.level, index))
        return Written(temporary, f"{at}/{name}")

    def commit(self, messages: list[Written | None]) -> None:
        store, at = _store(self.path)
        done = [m for m in messages if m is not None]
        if self.overwrite:
            keep = {m.temporary for m in done}
            for old in files(self.path):
                if _store(old)[1] not in keep:
                    store.delete_file(_store(old)[1])
        for m in done:
            store.move(m.temporary, m.final)

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = _store(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(m.temporary)


class PbfSource(DataSource):
    """Options: ``kinds`` (letters of n, w, r) when reading, besides filters where spark.sql.python.filterPushdown.enabled is set;``compression`` (none, zlib, zstd), ``level``, ``sorted``, ``bbox`` when writing."""

    @classmethod
    def name(cls) -> str:
        return "mapweave-pbf"

    def schema(self) -> str:
        return ELEMENTS

    def reader(self, schema) -> PbfReader:
        return PbfReader(self.options["path"], self.options.get("kinds", "nwr"))

    def writer(self, schema, overwrite: bool) -> PbfWriter:
        box = self.options.get("bbox")
        header = wire.Header(box=tuple(int(x) for x in box.split(",")) if box else None)
        if self.options.get("sorted", "false").lower() == "true":
            header.optional.append("Sort.Type_then_ID")
        level = self.options.get("level")
        return PbfWriter(self.options["path"], self.options.get("compression", "zlib"), int(level) if level else None, header, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PbfSource)


def read_elements(spark: SparkSession, path: str, kinds: str = "nwr") -> DataFrame:
    register(spark)
    return spark.read.format("mapweave-pbf").option("kinds", kinds).load(path)


def read_dataset(spark: SparkSession, path: str) -> Dataset:
    """A file or folder as a dataset; each kind is read when it is used, and blobs of other kinds give no rows."""
    part = lambda k: read_elements(spark, path, k)
    return Dataset(part("n").select("id", "lat_e7", "lon_e7", "tags", "info"), part("w").select("id", "tags", "refs", "locations", "info"), part("r").select("id", "tags", "members", "info"))


def read_header(path: str) -> wire.Header:
    first = files(path)[0]
    store, at = _store(first)
    with store.open_input_file(at) as f:
        for kind, offset, size in wire.walk(f):
            if kind == "OSMHeader":
                f.seek(offset)
                return wire.Header.parse(wire.unblob(f.read(size)))
    raise ValueError(f"no header: {first}")


def estimate_blobs(path: str) -> int:
    """How many data blobs there are, by their headers."""
    total = 0
    for one in files(path):
        store, at = _store(one)
        with store.open_input_file(at) as f:
            total += sum(1 for kind, *_ in wire.walk(f) if kind == "OSMData")
    return total


def elements_of(ds: Dataset) -> DataFrame:
    """All elements in one table of the format's schema; what a kind lacks is null."""
    empty = ds.nodes.sparkSession.createDataFrame([], ELEMENTS)
    parts = [df.withColumn("kind", F.lit(k)) for k, df in ds.by_kind().items()]
    out = empty
    for p in parts:
        out = out.unionByName(p.select([c for c in p.columns if c in empty.columns]), allowMissingColumns=True)
    return out.select(empty.columns)


def write_pbf(elements: DataFrame, path: str, compression: str = "zlib", mode: str = "error") -> None:
    """Writes elements sorted by kind and id: each file is sorted, and files follow each other."""
    register(elements.sparkSession)
    kind = F.when(F.col("kind") == "n", 0).when(F.col("kind") == "w", 1).otherwise(2)
    if mode == "error" and files(path) != [path]:
        raise FileExistsError(path)
    elements.orderBy(kind, *id_key()).write.format("mapweave-pbf").option("compression", compression).option("sorted", "true").mode("append" if mode == "error" else mode).save(path)

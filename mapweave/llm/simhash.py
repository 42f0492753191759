"""SimHash near-duplicates by meet-in-the-middle ball hashing (operator 4).

Two fingerprints differ in at most 2r bits exactly if they share a variant, a word within r bits of both. All variants
of every fingerprint are generated, but shuffled by their leading bits: a row goes to each prefix within r flips, with
the flips it has left, and the variants of the other bits unfold where the prefix lands. That ships 79 rows a
fingerprint at 12 leading bits, in place of 2081. Prefixes with too many rows unfold further bits and are dealt anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, join_counted, on_workers, some_id, stage, trimmed
from .components import components

BITS = 64
SEED = 42
#: Rows of one prefix that a task unfolds at once; a prefix with more is dealt anew by STEP_BITS more bits.
GROUP_ROWS = 65_536
STEP_BITS = 10
#: Variants unfolded in memory at once.
CHUNK_VARIANTS = 8_000_000
#: Shingles whose bits are counted at once.
CHUNK_SHINGLES = 65_536


def fingerprint(text: str | None, words: int = 4) -> int:
    """The 64-bit SimHash of a text's word shingles; 0 without words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    if len(found) <= words:
        return xxhash.xxh64_intdigest(b" ".join(found), SEED)
    whole = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.r_[0, ends[:-1]][:len(found) - words + 1].tolist()
    stops = (ends[words - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(starts), CHUNK_SHINGLES):
        hashes = np.array([digest(whole[a:b], SEED) for a, b in zip(starts[i:i + CHUNK_SHINGLES], stops[i:i + CHUNK_SHINGLES], strict=True)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp) of whole texts; fp holds the unsigned fingerprint's bits. Null and wordless texts have fingerprint 0."""
    on_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t, words) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.record_batch({"doc_id": batch.column(0), "fp": pa.array(prints.view(np.int64))})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(run), "doc_id long, fp long")


def _masks(low: int, high: int, flips: int) -> list[int]:
    """Words with at most ``flips`` bits set, all at positions from ``low`` up to ``high``."""
    return [sum(1 << b for b in c) for k in range(flips + 1) for c in combinations(range(low, high), k)]


@lru_cache(maxsize=256)
def _mask_array(low: int, high: int, flips: int) -> np.ndarray:
    return np.array(_masks(low, high, flips), np.uint64)


def _star_edges(fps: np.ndarray, ids: np.ndarray, left: np.ndarray, bits: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join those rows of one prefix that collide on a variant: a spanning forest, smaller id second.

    ``left`` are each row's flips left for the bits after the first ``bits``. Colliding pairs are verified.
    """
    order = np.argsort(ids, kind="stable")
    fps, left = fps[order], left[order]
    variants, owners = [], []
    for flips in np.unique(left).tolist():
        at = np.flatnonzero(left == flips)
        masks = _mask_array(0, BITS - bits, flips)
        variants.append((fps[at][:, None] ^ masks[None, :]).reshape(-1))
        owners.append(np.repeat(at, len(masks)))
    keys = np.concatenate(variants) & np.uint64((1 << (BITS - bits)) - 1)
    who = np.concatenate(owners).astype(np.int32)
    by = np.argsort(keys, kind="stable")
    keys, who = keys[by], who[by]
    # rows are in order of id and the sort is stable, but flips are apart: take each variant's smallest row
    firsts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    least = np.repeat(np.minimum.reduceat(who, firsts), np.diff(np.r_[firsts, len(keys)]))
    pairs = np.unique((who.astype(np.int64) << 32 | least)[who != least])
    a, b = pairs >> 32, pairs & 0xFFFFFFFF
    near = np.bitwise_count(fps[a] ^ fps[b]) <= distance
    a, b = a[near], b[near]
    label = np.arange(len(fps))
    while True:  # smallest label over edges, then jumps to the label's label
        new = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    tied = np.flatnonzero(label != np.arange(len(fps)))
    ids = ids[order]
    return ids[tied], ids[label[tied]]


def _by_chunks(fps: np.ndarray, ids: np.ndarray, left: np.ndarray, bits: int, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges of one prefix; where its variants are too many for memory at once, those of its longer prefixes in turn."""
    count = sum(int((left == k).sum()) * len(_mask_array(0, BITS - bits, k)) for k in np.unique(left).tolist())
    if count <= CHUNK_VARIANTS or bits >= BITS - 8 or len(fps) < 2:
        if len(fps) > 1:
            yield _star_edges(fps, ids, left, bits, distance)
        return
    keys, fps, ids, left = _unfold(fps, ids, left, bits, bits + 6)
    order = np.argsort(keys, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(keys[order])) + 1):
        yield from _by_chunks(fps[at], ids[at], left[at], bits + 6, distance)


def _unfold(fps: np.ndarray, ids: np.ndarray, left: np.ndarray, bits: int, to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows for each prefix of ``to`` bits that the flips left reach, the first ``bits`` being fixed already: suffix keys, fps, ids, left."""
    out = []
    for flips in np.unique(left).tolist():
        at = np.flatnonzero(left == flips)
        masks = _mask_array(BITS - to, BITS - bits, flips)
        keys = (fps[at][:, None] ^ masks[None, :]).reshape(-1) >> np.uint64(BITS - to) & np.uint64((1 << (to - bits)) - 1)
        spare = np.broadcast_to(flips - np.bitwise_count(masks).astype(np.int64), (len(at), len(masks))).reshape(-1)
        out.append((keys, np.repeat(fps[at], len(masks)), np.repeat(ids[at], len(masks)), spare))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


ROW = "key long, fp long, id long, left int"


def _dealt(rows: DataFrame, bits: int, distance: int) -> DataFrame:
    """Rows of prefixes of ``bits`` bits to edges (left = -1: fp is unused, key and id are the edge) and, of prefixes with too many rows, to rows of longer ones."""
    deeper = min(BITS, bits + STEP_BITS)

    def batch_of(keys: np.ndarray, fps: np.ndarray, ids: np.ndarray, left: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(keys), 65_536):
            s = slice(i, i + 65_536)
            yield pa.record_batch({"key": pa.array(keys[s].astype(np.int64)), "fp": pa.array(fps[s].view(np.int64)), "id": pa.array(ids[s]), "left": pa.array(left[s].astype(np.int32))})

    def further(key: int, fps: np.ndarray, ids: np.ndarray, left: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(fps), 4096):
            s = slice(i, i + 4096)
            keys, f, n, k = _unfold(fps[s], ids[s], left[s], bits, deeper)
            yield from batch_of(np.uint64((key << (deeper - bits)) & (1 << 64) - 1) | keys, f, n, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key, count, over = None, 0, False

        def close() -> Iterator[pa.RecordBatch]:
            if held and not over:
                fps, ids, left = (np.concatenate(x) for x in zip(*held, strict=True))
                for a, b in _by_chunks(fps, ids, left, bits, distance):
                    yield from batch_of(a, np.zeros(len(a), np.uint64), b, np.full(len(a), -1))

        for batch in batches:
            keys, fps, ids, left = (c.to_numpy() for c in batch.columns)
            fps = fps.view(np.uint64)
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                if keys[i] != key:
                    yield from close()
                    held, key, count, over = [], int(keys[i]), 0, False
                held.append((fps[i:j], ids[i:j], left[i:j].astype(np.int64)))
                count += j - i
                if deeper > bits and (over or count > GROUP_ROWS):
                    over = True
                    for part in held:
                        yield from further(key, *part)
                    held = []
        yield from close()

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(trimmed(run), ROW)


def near_edges(nodes: DataFrame, distance: int, bits: int) -> DataFrame:
    """Edges (u, v) between ``nodes`` (fp, id; distinct fp) whose closure has every link of at most ``distance`` (even) differing bits."""
    radius = distance // 2
    masks = _masks(BITS - bits, BITS, radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    flips = F.explode(F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(radius - bin(x).count("1")).alias("left")) for m, x in zip(signed, masks, strict=True)]))
    rows = nodes.select("fp", "id", flips.alias("_f")).select(F.shiftrightunsigned(F.col("fp").bitwiseXOR(F.col("_f.m")), BITS - bits).alias("key"), "fp", "id", F.col("_f.left").alias("left"))
    edges = None
    while True:
        done = stage(_dealt(rows, bits, distance), "ball")
        found = done.where("left < 0").select(F.col("key").alias("u"), F.col("id").alias("v"))
        edges = found if edges is None else edges.unionByName(found)
        rows, bits = done.where("left >= 0"), min(BITS, bits + STEP_BITS)
        if rows.isEmpty():
            return edges


def ball_components(nodes: DataFrame, distance: int = 4) -> DataFrame:
    """(fp, component) of the fingerprints that are linked: the smallest, as a signed number, that links reach. ``nodes`` is staged and has each fp once."""
    if distance % 2:
        raise ValueError("distance must be even")
    bits = max(8, min(32, nodes.count().bit_length() - 6))
    return components(near_edges(nodes.select("fp", F.col("fp").alias("id")), distance, bits)).withColumnRenamed("node", "fp")


def find_near(docs: DataFrame, distance: int = 4, words: int = 4) -> DataFrame:
    """One row a row of ``docs``: doc_id, fingerprint, component_id (smallest doc_id that links of at most ``distance`` bits reach).

    Links need fingerprints only, so equal fingerprints are one node, and fingerprints name the nodes: neither repeated
    nor null ids tie texts together. Null, empty and wordless texts share fingerprint zero. A component without any doc_id
    has none; an empty table gives no row.
    """
    on_workers(docs.sparkSession)
    joined = _labelled(stage(fingerprints(docs, words), "fingerprints"), distance)
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _labelled(prints: DataFrame, distance: int) -> DataFrame:
    """Staged rows (doc_id, fp) with their component_id."""
    nodes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")), "fingerprint-nodes")
    count = nodes.count()
    named = stage(nodes.join(ball_components(nodes, distance), "fp", "left").withColumn("component", F.coalesce("component", "fp")), "fingerprint-components")
    least = named.groupBy("component").agg(F.min("id").alias("component_id"), F.count("*").alias("_size"))
    known = join_counted(named, least, "component", "_size", count, F.col("fp")).select("fp", "n", "component_id")
    return join_counted(prints, known, "fp", "n", prints.count(), F.col("doc_id"))


def drop_near(docs: DataFrame, distance: int = 4, words: int = 4) -> DataFrame:
    """``docs`` with one document of each component: the one of the smallest doc_id (all rows of it that are in the component; a component without any doc_id stays whole)."""
    on_workers(docs.sparkSession)

    @F.arrow_udf("long")
    def prints(texts: pa.Array) -> pa.Array:
        return pa.array(np.fromiter((fingerprint(t, words) for t in texts.to_pylist()), np.uint64, len(texts)).view(np.int64))

    own = docs.withColumns({"__near_fp": prints(F.col("text")), "__near_id": some_id()})
    found = _labelled(stage(own.select(F.col("doc_id").cast("long"), F.col("__near_fp").alias("fp")), "fingerprints"), distance)
    stays = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(some_id().alias("__near_id"), F.col("fp").alias("__near_fp")).distinct()
    return own.join(stays, ["__near_id", "__near_fp"], "left_semi").drop("__near_id", "__near_fp")


def op4_simhash_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` with its fingerprint and component."""
    return find_near(documents(spark, sf_dir))

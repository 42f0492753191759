"""Near copies by Jaccard similarity of word shingles (the pipeline's near-dedup stage).

Candidates share a bucket: a component of SimHash fingerprints by ball hashing (operator 4, at its own distance) or, as two
texts of similarity 0.8 mostly differ in more bits than ball hashing can reach, a band of min-wise hashes. Every pair is
verified on the sets of shingles (64-bit hashes) themselves.
First each member of a bucket is held against the bucket's smallest; then, in buckets whose members are still in different
components, all members with those of other components, block by block, whatever the bucket's size. Texts that are in no pair aren't shipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_counted, listed, on_workers, some_id, stage, trimmed, unlisted, unstage
from .components import components
from .simhash import ball_components, fingerprint

WORDS, SIMILARITY = 5, 0.8
#: A pair of similarity s shares a bucket with the chance 1 - (1 - s^ROWS)^BANDS: 0.99995 at 0.8.
BANDS, ROWS = 25, 5
#: Larger buckets meet in pairs of blocks of about so many members.
BLOCK = 256
SEED = 42
CHUNK = 4096

_rng = np.random.default_rng(SEED)
_factors = _rng.integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_offsets = _rng.integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2)


def shingles(text: str | None) -> np.ndarray:
    """Hashes of a text's word shingles, in order and once each; a text of fewer words is one shingle, one without words too."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    whole = b" ".join(found)
    if len(found) <= WORDS:
        return np.array([digest(whole, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.r_[0, ends[:-1]][:len(found) - WORDS + 1].tolist()
    return np.unique(np.array([digest(whole[a:b], SEED) for a, b in zip(starts, (ends[WORDS - 1:] - 1).tolist(), strict=True)], np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of shingles."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def band_keys(found: np.ndarray) -> np.ndarray:
    """A key for each band of min-wise hashes of a set of shingles."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), CHUNK):
        np.minimum(least, (found[i:i + CHUNK, None] * _factors + _offsets).min(axis=0), out=least)
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(least.reshape(BANDS, ROWS))], np.uint64)


def _node(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), SEED)


def _signed(docs: DataFrame) -> DataFrame:
    """(id, node, fp, bands): node is the hash of the set of shingles, fp the fingerprint of operator 4."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, prints, keys = [], [], []
            for t in batch.column(1).to_pylist():
                found = shingles(t)
                prints.append(fingerprint(t))
                nodes.append(_node(found))
                keys.append(band_keys(found))
            flat = np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS), pa.int32()), pa.array(flat))
            yield pa.record_batch({"id": batch.column(0), "node": pa.array(np.array(nodes, np.uint64).view(np.int64)), "fp": pa.array(np.array(prints, np.uint64).view(np.int64)), "bands": bands})

    return docs.select(some_id().alias("id"), "text").mapInArrow(trimmed(run), "id long, node long, fp long, bands array<long>")


def _balls(signed: DataFrame) -> DataFrame:
    """(key, node): a bucket for each component of fingerprints that ball hashing links; equal fingerprints are linked too."""
    rows = stage(signed.select("node", "fp").distinct(), "similar-prints")
    prints = stage(rows.groupBy("fp").agg(F.count("*").alias("n")), "similar-balls")
    linked = prints.join(ball_components(prints), "fp", "left").where("n > 1 or component is not null")
    balls = stage(linked.select("fp", "n", F.xxhash64(F.lit("ball"), F.coalesce("component", "fp")).alias("key")), "similar-balls")
    out = stage(join_counted(rows, balls, "fp", "n", rows.count(), F.col("node")).where("key is not null").select("key", "node").distinct(), "similar-balls")
    for x in (rows, prints, balls):
        unstage(x)
    return out


def _stars(rows: DataFrame) -> DataFrame:
    """Candidate pairs (key, u, v) from rows (key, node): of each bucket's smallest node (v) with the others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = first = None
        for batch in batches:
            keys, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(keys):
                continue
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            least = nodes[starts]
            if keys[0] == key:
                least = np.r_[first, least[1:]]
            key, first = keys[-1], least[-1]
            spread = np.repeat(least, np.diff(np.r_[starts, len(keys)]))
            other = spread != nodes
            yield pa.record_batch({"key": pa.array(keys[other]), "u": pa.array(nodes[other]), "v": pa.array(spread[other])})

    return rows.select("key", "node").repartition("key").sortWithinPartitions("key", "node").mapInArrow(trimmed(run), "key long, u long, v long")


def _texts(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text, n) of all nodes in ``pairs``, once each; n is how often a node comes second. Whole texts are shipped here only, of documents that are listed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([_node(shingles(t)) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.record_batch({"id": batch.column(0), "text": batch.column(1), "node": pa.array(found.view(np.int64))})

    ends = pairs.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(0).alias("n")), F.struct(F.col("v").alias("node"), F.lit(1).alias("n")))).alias("e"))
    wanted = ends.groupBy("e.node").agg(F.sum("e.n").alias("n"))
    asked = stage(wanted.join(nodes.select("node", "id"), "node"), "similar-asked")
    some = listed(docs.select(some_id().alias("id"), "text"), asked, ["id"]).where("_listed").select("id", "text").mapInArrow(trimmed(run), "id long, text string, node long")
    texts = stage(some.join(asked, ["node", "id"]).groupBy("node", "id").agg(F.first("text").alias("text"), F.first("n").alias("n")).drop("id"), "similar-texts")
    unstage(asked)
    return texts


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The staged pairs whose texts are similar enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, found = None, None
        for batch in batches:
            ok = []
            for u, a, b in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if u != last:
                    last, found = u, shingles(a)
                ok.append(similarity(found, shingles(b)) >= SIMILARITY)
            yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    left = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("a")), "u")
    right = texts.where("n > 0").select(F.col("node").alias("v"), F.col("text").alias("b"), "n")
    both = join_counted(left, right, "v", "n", pairs.count(), F.col("u"))
    return both.select("u", "v", "a", "b").mapInArrow(trimmed(run), "u long, v long")


def _blocks(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, label, size, c, own) of buckets whose members have several labels, and (key, a, b): the pairs of their blocks that have to meet.

    A bucket of at most BLOCK members is one block. In a larger one a label with over BLOCK / 2 members has blocks of its
    own, which needn't meet each other, and the other labels are dealt over blocks of about BLOCK members by their hash.
    """
    counts = labelled.groupBy("key", "label").agg(F.count("*").alias("c"))
    mixed = counts.groupBy("key").agg(F.sum("c").alias("size"), F.count("*").alias("labels")).where("labels > 1").drop("labels")
    sizes = stage(counts.join(mixed, "key").withColumn("own", (F.col("size") > BLOCK) & (F.col("c") * 2 > BLOCK)), "similar-mixed")
    own = sizes.where("own").select("key", "label", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("c") / BLOCK) - 1)).alias("part"))
    rest = sizes.where("not own").select("key", F.lit(None).cast("long").alias("label"), _part().alias("part")).distinct()
    blocks = own.unionByName(rest).select("key", F.col("label").alias("only"), _block(F.col("label"), F.col("part")).alias("block"))
    a, b = (blocks.select("key", F.col("only").alias(f"only_{x}"), F.col("block").alias(x)) for x in "ab")
    return sizes, a.join(b, "key").where((F.col("a") <= F.col("b")) & ~F.coalesce(F.col("only_a") == F.col("only_b"), F.lit(False))).select("key", "a", "b")


def _part() -> Column:
    """The part of its bucket that a label without blocks of its own is dealt to."""
    return F.pmod(F.xxhash64("label"), F.ceil(F.col("size") / BLOCK))


def _block(label: Column, part: Column) -> Column:
    return F.xxhash64(label.isNull(), F.coalesce(label, F.lit(0)), part)


def _placed(labelled: DataFrame, sizes: DataFrame) -> DataFrame:
    """(key, block, label, node) of all members of buckets with several labels."""
    own = F.col("own")
    part = F.when(own, F.pmod(F.xxhash64("node"), F.ceil(F.col("c") / BLOCK))).otherwise(_part())
    return labelled.join(sizes, ["key", "label"]).select("key", _block(F.when(own, F.col("label")), part).alias("block"), "label", "node")


def shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set on the left has in common with each on the right."""
    out = np.zeros((len(left), len(right)), np.int64)
    known = np.intersect1d(np.concatenate(left), np.concatenate(right))
    at = [[np.searchsorted(known, x[np.isin(x, known, assume_unique=True)]) for x in side] for side in (left, right)]
    for k in range(0, len(known), CHUNK):
        has = []
        for side in at:
            table = np.zeros((len(side), min(CHUNK, len(known) - k)), np.float32)
            for row, x in zip(table, side, strict=True):
                row[x[np.searchsorted(x, k):np.searchsorted(x, k + CHUNK)] - k] = 1
            has.append(table)
        out += (has[0] @ has[1].T).astype(np.int64)
    return out


def links(held: list[tuple[int, int, int, np.ndarray]]) -> list[tuple[int, int]]:
    """Similar pairs of rows (side, label, node, shingles) that join different labels: of side 0 with side 1, or of side 0 alone; as many as join all that can be."""
    sides = [[r for r in held if r[0] == s] for s in (0, 1)]
    left, right = sides if sides[1] else (sides[0], sides[0])
    if not left or len({r[1] for r in held}) < 2:
        return []
    both = shared([r[3] for r in left], [r[3] for r in right])
    n, m = (np.array([len(r[3]) for r in side]) for side in (left, right))
    near = (both / (n[:, None] + m - both) >= SIMILARITY) & (np.array([r[1] for r in left])[:, None] != np.array([r[1] for r in right]))
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            x = up
        return x

    out = []
    for i, j in np.argwhere(near).tolist():
        x, y = find(left[i][1]), find(right[j][1])
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((max(left[i][2], right[j][2]), min(left[i][2], right[j][2])))
    return out


def _met(rows: DataFrame) -> DataFrame:
    """The links of each pair of blocks from rows (key, a, b, side, label, node, text); a task holds one pair of blocks at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            out = []
            for key, a, b, side, label, node, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, a, b) != at:
                    out += links(held)
                    at, held = (key, a, b), []
                held.append((side, label, node, shingles(text)))
            yield _edges(out)
        yield _edges(links(held))

    return rows.select("key", "a", "b", "side", "label", "node", "text").repartition("key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(trimmed(run), "u long, v long")


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch({"u": pa.array([p[0] for p in pairs], pa.int64()), "v": pa.array([p[1] for p in pairs], pa.int64())})


def _labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` with ``label``, the smallest node that edges reach."""
    return nodes.join(components(edges).withColumnRenamed("component", "_c"), "node", "left").withColumn("label", F.coalesce("_c", "node")).drop("_c")


def drop_similar(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component of pairs with SIMILARITY or more: the one of the smallest doc_id.

    A null doc_id counts as the smallest. Rows that share a doc_id are one document: they stay if any of them does.
    """
    on_workers(docs.sparkSession)
    signed = stage(_signed(docs), "shingle-bands")
    nodes = stage(signed.groupBy("node").agg(F.min("id").alias("id"), F.first("bands").alias("bands")), "shingle-nodes")
    balls = _balls(signed)
    stars = stage(_stars(nodes.select(F.explode("bands").alias("key"), "node").unionByName(balls)), "similar-stars")
    first = stage(stars.select("u", "v").distinct(), "similar-candidates")
    texts = _texts(first, docs, nodes)
    edges = stage(_verified(first, texts), "similar")
    known = stage(_labels(nodes.select("node", "id"), edges), "similar-labels")
    shared = stars.select("key", F.col("u").alias("node")).unionByName(stars.select("key", F.col("v").alias("node")).distinct())
    labelled = stage(shared.join(known, "node").select("label", "node", "key"), "similar-labels")
    sizes, meetings = _blocks(labelled)
    meetings = stage(meetings, "similar-meetings")
    members = stage(_placed(labelled, sizes), "similar-members")
    sides = [members.join(meetings.where("a < b") if side else meetings, (members["key"] == meetings["key"]) & (members["block"] == meetings["b" if side else "a"])).select(members["key"], "a", "b", F.lit(side).alias("side"), "label", "node") for side in (0, 1)]
    met = stage(_met(sides[0].unionByName(sides[1]).join(texts.select("node", "text"), "node")), "similar")
    named = _labels(nodes.select("node", "id"), edges.unionByName(met))
    stays = named.groupBy("label").agg(F.min("id").alias("id")).select("id").distinct()
    drops = stage(signed.select(F.col("id").alias("__similar_id")).distinct().join(stays.withColumnRenamed("id", "__similar_id"), "__similar_id", "left_anti"), "similar-drops")
    for x in (signed, nodes, balls, stars, first, texts, edges, known, labelled, sizes, meetings, members, met):
        unstage(x)
    return unlisted(docs.withColumn("__similar_id", some_id()), drops, ["__similar_id"]).drop("__similar_id")

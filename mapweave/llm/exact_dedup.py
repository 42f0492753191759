"""Exact deduplication with a cuckoo-filter index over live digests (operator 1).

The index is a table (digest, keep_id, group_size) dealt by digest. A task loads its share into a ``CuckooIndex``:
a filter of 16-bit fingerprints whose slots point at the stored keys. Filter hits are verified against the whole
stored digest, deletions free their slots, and a filter that overflows is rebuilt at twice the size from the stored keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, given_id, join_counted, on_workers, some_id, stage, unlisted

SLOTS = 4
MAX_KICKS = 64
INSERT, DELETE = 0, 1


class CuckooIndex:
    """Live digests (rows of four unsigned 64-bit words) with the largest id and the count of each."""

    def __init__(self, buckets: int = 256):
        self.words = np.zeros((0, 4), np.uint64)
        self.ids = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)
        self.live = np.zeros(0, bool)
        self.used = 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = np.uint64(buckets - 1)
        self.prints = np.zeros((buckets, SLOTS), np.uint16)
        self.refs = np.full((buckets, SLOTS), -1, np.int64)

    def _places(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        prints = (words[:, 1] >> np.uint64(48)).astype(np.uint16) | np.uint16(1)
        first = words[:, 0] & self.mask
        return prints, first.astype(np.int64), self._other(first, prints)

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((bucket.astype(np.uint64) ^ (prints.astype(np.uint64) * np.uint64(0x5BD1E9955BD1E995))) & self.mask).astype(np.int64)

    def find(self, words: np.ndarray) -> np.ndarray:
        """The stored key of each digest, or -1. A fingerprint alone never decides."""
        prints, a, b = self._places(words)
        found = np.full(len(words), -1, np.int64)
        for bucket in (a, b):
            for slot in range(SLOTS):
                hit = np.flatnonzero((self.prints[bucket, slot] == prints) & (found < 0))
                if len(hit):
                    ref = self.refs[bucket[hit], slot]
                    same = (self.words[ref] == words[hit]).all(axis=1)
                    found[hit[same]] = ref[same]
        return found

    def insert(self, words: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Adds digests (each once in a call) or raises the largest id and count of those that live already."""
        at = self.find(words)
        old = at >= 0
        np.maximum.at(self.ids, at[old], ids[old])
        np.add.at(self.counts, at[old], counts[old])
        new = ~old
        n, end = int(new.sum()), self.used + int(new.sum())
        if end > len(self.words):
            more = max(end, 2 * len(self.words), 1024) - len(self.words)
            self.words = np.concatenate([self.words, np.zeros((more, 4), np.uint64)])
            self.ids, self.counts, self.live = (np.concatenate([x, np.zeros(more, x.dtype)]) for x in (self.ids, self.counts, self.live))
        refs = np.arange(self.used, end)
        self.words[refs], self.ids[refs], self.counts[refs], self.live[refs] = words[new], ids[new], counts[new], True
        self.used = end
        if n and (int(self.live.sum()) > 0.9 * self.prints.size or not self._place(refs)):
            self._grow()

    def delete(self, words: np.ndarray) -> np.ndarray:
        """Takes digests out of the filter; tells which were live."""
        at = self.find(words)
        gone = np.unique(at[at >= 0])
        prints, a, b = self._places(self.words[gone])
        for bucket in (a, b):
            for slot in range(SLOTS):
                hit = self.refs[bucket, slot] == gone
                self.prints[bucket[hit], slot], self.refs[bucket[hit], slot] = 0, -1
        self.live[gone] = False
        return at >= 0

    def _grow(self) -> None:
        buckets = len(self.prints)
        refs = np.flatnonzero(self.live[:self.used])
        while True:
            buckets *= 2
            self._clear(buckets)
            if len(refs) <= 0.8 * self.prints.size and self._place(refs):
                return

    def _place(self, refs: np.ndarray) -> bool:
        """Puts keys into free slots, moving others to their second bucket; False when the filter overflows."""
        prints, bucket, _ = self._places(self.words[refs])
        tried = np.zeros(len(refs), np.int64)
        rng = np.random.default_rng(len(self.prints))
        for _ in range(MAX_KICKS):
            waiting = np.ones(len(refs), bool)
            for slot in range(SLOTS):
                free = np.flatnonzero(waiting & (self.prints[bucket, slot] == 0))
                if not len(free):
                    continue
                take = free[np.unique(bucket[free], return_index=True)[1]]
                self.prints[bucket[take], slot], self.refs[bucket[take], slot] = prints[take], refs[take]
                waiting[take] = False
            if not waiting.any():
                return True
            refs, prints, bucket, tried = refs[waiting], prints[waiting], bucket[waiting], tried[waiting]
            kick = np.unique(bucket, return_index=True)[1]
            kick = kick[tried[kick] > 0]
            bucket = self._other(bucket, prints) if not len(kick) else bucket
            tried = tried + 1
            if len(kick):
                slot = rng.integers(0, SLOTS, len(kick))
                at = bucket[kick]
                out_prints, out_refs = self.prints[at, slot].copy(), self.refs[at, slot].copy()
                self.prints[at, slot], self.refs[at, slot] = prints[kick], refs[kick]
                refs[kick], prints[kick], bucket[kick] = out_refs, out_prints, self._other(at, out_prints)
                rest = np.ones(len(refs), bool)
                rest[kick] = False
                bucket[rest] = self._other(bucket[rest], prints[rest])
        return False

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keep = np.flatnonzero(self.live[:self.used])
        return self.words[keep], self.ids[keep], self.counts[keep]


def _words(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 4)


def _through_index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (digest, id, n, op), inserts before deletes, through one index; returns what lives."""
    index = CuckooIndex()
    for batch in batches:
        if not batch.num_rows:
            continue
        words, ids, counts, ops = _words(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_numpy()
        for op in (INSERT, DELETE):
            at = ops == op
            if not at.any():
                continue
            if op == DELETE:
                index.delete(words[at])
                continue
            _, first, same = np.unique(np.ascontiguousarray(words[at]).view("V32").reshape(-1), return_index=True, return_inverse=True)
            top = np.full(len(first), np.iinfo(np.int64).min)
            np.maximum.at(top, same, ids[at])
            index.insert(words[at][first], top, np.bincount(same, weights=counts[at]).astype(np.int64))
    words, ids, counts = index.rows()
    for i in range(0, len(ids), 8192):
        part = words[i:i + 8192]
        yield pa.record_batch({"digest": pa.array([w.tobytes() for w in part], pa.binary()), "id": pa.array(ids[i:i + 8192]), "n": pa.array(counts[i:i + 8192]), "op": pa.array(np.zeros(len(part), np.int32))})


ROW = "digest binary, id long, n long, op int"


def update_index(index: DataFrame | None, inserts: DataFrame, deletes: DataFrame | None = None) -> DataFrame:
    """The index (digest, id, n) after inserting rows (digest, id) and then deleting whole digests.

    Every input split first goes through an index of its own, so a digest that fills a third of the table reaches the
    task that owns it as one row a split; shares by digest are even. Memory is that of one share's distinct digests.
    """
    on_workers(inserts.sparkSession)
    local = inserts.select("digest", "id", F.lit(1).cast("long").alias("n"), F.lit(INSERT).alias("op")).mapInArrow(_through_index, ROW)
    rows = local if index is None else index.select("digest", "id", "n", F.lit(INSERT).alias("op")).unionByName(local)
    if deletes is not None:
        rows = rows.unionByName(deletes.select("digest", F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("n"), F.lit(DELETE).alias("op")).distinct())
    return rows.repartition("digest").sortWithinPartitions("op").mapInArrow(_through_index, ROW).drop("op")


def digests(docs: DataFrame) -> DataFrame:
    """(id, digest): SHA-256 of the whole text in UTF-8; null counts as empty."""
    return docs.select(some_id().alias("id"), F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)).alias("digest"))


def find_copies(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, keep_id (the largest doc_id with this text), group_size, kept, text_sha256.

    A null doc_id is smaller than all others; if no row of a text has one, all its rows stay. Repeated rows of one doc_id
    count apiece and are all kept if it stays. An empty table gives no row.
    """
    rows = stage(digests(docs), "digests")
    groups = stage(update_index(None, rows), "cuckoo-index").withColumnsRenamed({"id": "keep_id", "n": "group_size"})
    sized = groups.withColumn("_n", F.col("group_size"))
    joined = join_counted(rows, sized, "digest", "_n", rows.count(), F.col("id"))
    return joined.select(given_id("id").alias("doc_id"), given_id("keep_id").alias("keep_id"), "group_size", (F.col("id") == F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text a row of a larger doc_id has; all other columns stay. Rows that share both doc_id and text all stay or all go."""
    gone = stage(find_copies(docs).where(~F.col("kept")).select(some_id().alias("__dedup_id"), F.col("text_sha256").alias("__dedup_sha")).distinct(), "dedup-gone")
    own = docs.withColumns({"__dedup_id": some_id(), "__dedup_sha": F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)})
    return unlisted(own, gone, ["__dedup_id", "__dedup_sha"]).drop("__dedup_id", "__dedup_sha")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` and the row that stays of its equal texts."""
    return find_copies(documents(spark, sf_dir))


OP1_ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

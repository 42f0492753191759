"""Stupid-backoff language-model scores from count tables joined to the documents' n-grams (operator 3).

``score_against`` scores documents by the counts of a reference corpus: exploded n-grams join hash-partitioned count tables,
order by order, and what a table lacks backs off. ``score_corpus`` scores a corpus by its own counts. There every n-gram
is in its table, so no term backs off and the logarithm of a document's score is a sum of log counts: of its n-grams, less
those of the contexts. That join runs on packed rows: each batch of documents ships its n-grams' keys to the
partition their hash names, which counts all keys it gets, joins the counts back to the rows it holds, and returns each
batch one partial sum a document. Keys that are frequent in the whole corpus are found first and counted apart, so no
partition is hot.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, given_id, on_workers, some_id, trimmed

ORDER = 3
BACKOFF = 0.4
#: n-grams that a partition holds, about; and partitions at least.
PARTITION_GRAMS = 6_000_000
MIN_PARTITIONS = 48
#: Keys with over 1/HOT_SHARE of all n-grams of their order are counted apart; there are fewer than 2 x HOT_SHARE an order.
HOT_SHARE = 4096
#: Bytes of a key inside its partition. Two of PARTITION_GRAMS keys are mixed up with a chance of 6e-6 a key at any corpus size, as partitions grow in number, not size.
KEY_BYTES = 5
SHIPPED = ("part", "k", "batch", "steps", "weights", "keys", "counts")
#: Documents of a batch at most; their places in it are 16 bits wide.
BATCH_DOCS = 30_000
BATCH_BYTES = 1 << 20
GAPS = [bytes([c]) for c in (9, 10, 11, 12, 13, 32)]
_gap = re.compile(rb"[\t-\r ]")
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse modulo 2^64."""
    def run(x: int) -> np.ndarray:
        out = np.full(BATCH_BYTES + 1, x & (1 << 64) - 1, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return run(_BASE), run(pow(_BASE, -1, 1 << 64))


def _mix(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the white-space separated words of at most BATCH_BYTES, A-Z lower-cased, and where each starts."""
    raw = LOWER[np.frombuffer(data, np.uint8)]
    gap = SPACE[raw]
    edge = np.flatnonzero(np.diff(np.r_[True, gap, True].astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = _powers()
    with np.errstate(over="ignore"):
        total = np.r_[np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:len(raw)], dtype=np.uint64)]
        return _mix((total[ends] - total[starts]) * down[starts]), starts


def _text_words(data: bytes) -> np.ndarray:
    """Word hashes of one text of any length; one longer than a batch is worked on in stretches of whole words."""
    parts, at = [], 0
    while len(data) - at > BATCH_BYTES:
        cut = max(data.rfind(c, at, at + BATCH_BYTES) for c in GAPS) + 1
        if cut > at:
            parts.append(word_hashes(data[at:cut])[0])
            at = cut
        else:
            gap = _gap.search(data, at + BATCH_BYTES)
            end = gap.start() if gap else len(data)
            parts.append(_long_word(data[at:end]))
            at = end
    return np.concatenate([*parts, word_hashes(data[at:])[0]])


def _long_word(word: bytes) -> np.ndarray:
    """The hash of one word that is longer than a batch, the same sum by stretches."""
    up, total, scale = _powers()[0], 0, 1
    for i in range(0, len(word), BATCH_BYTES):
        part = LOWER[np.frombuffer(word, np.uint8, min(BATCH_BYTES, len(word) - i), i)]
        with np.errstate(over="ignore"):
            own = int(((part.astype(np.uint64) + np.uint64(1)) * up[:len(part)]).sum(dtype=np.uint64))
        total = total + scale * own & (1 << 64) - 1
        scale = scale * pow(_BASE, len(part), 1 << 64) & (1 << 64) - 1
    return _mix(np.array([total], np.uint64))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_ids, hashes of all words, number of words of each document) of stretches of whole documents."""
    for batch in batches:
        ids, texts = batch.column(0).to_numpy(), [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
        k = 0
        while k < len(texts):
            j, size = k, 0
            while j < len(texts) and j - k < BATCH_DOCS and (j == k or size + len(texts[j]) + 1 <= BATCH_BYTES):
                size += len(texts[j]) + 1
                j += 1
            if j == k + 1:
                words = _text_words(texts[k])
                yield ids[k:j], words, np.array([len(words)])
            else:
                words, starts = word_hashes(b"\n".join(texts[k:j]))
                bounds = np.cumsum([len(t) + 1 for t in texts[k:j]])
                yield ids[k:j], words, np.diff(np.r_[0, np.searchsorted(starts, bounds, side="left")])
            k = j


def grams(words: np.ndarray, counts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, document, place from the start) of all n-grams of an order, none across documents."""
    doc = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    n = max(0, len(words) - order + 1)
    key = words[:n].copy()
    with np.errstate(over="ignore"):
        for k in range(1, order):
            key = _mix(key * np.uint64(0xD6E8FEB86659FD93) + words[k:n + k])
    inside = doc[:n] == doc[order - 1:order - 1 + n]
    return key[inside], doc[:n][inside], place[:n][inside]


def _weights(counts: np.ndarray, doc: np.ndarray, place: np.ndarray, order: int, top: int) -> np.ndarray:
    """How often the log count of each n-gram enters its document's score.

    A document of m words gets log c of its top-order n-grams, less log c of their contexts; its first words stand at the
    shorter orders that fit, so that the first context of each order cancels. Documents shorter than the top order end with +1.
    """
    m = counts[doc]
    if order == top:
        return np.ones(len(doc), np.int8)
    if order == top - 1:
        middle = (place >= 1) & (place <= m - order - 1)
        return np.where(m == order, 1, np.where(middle, -1, 0)).astype(np.int8)
    return (m == order).astype(np.int8)


def score_corpus(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(doc_id, n_words, log_score): natural log of each document's stupid-backoff score by the counts of all of ``docs``.

    The first word of a document stands for its share of all words. Null, empty and wordless texts score 0 with no words.
    One row a row of ``docs``, repeated and null ids too.
    """
    spark = docs.sparkSession
    on_workers(spark)
    rows = docs.select(some_id().alias("doc_id"), "text")
    orders = range(1, order + 1)

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words, counts in _documents(batches):
            for k in orders:
                keys, _, _ = grams(words, counts, k)
                if not len(keys):
                    continue
                found, n = np.unique(keys, return_counts=True)
                top = n * 2 * HOT_SHARE >= len(keys)
                top &= n > 1
                yield pa.record_batch({"k": pa.array([0, *[k] * int(top.sum())], pa.int32()), "key": pa.array(np.r_[np.int64(k), found[top].view(np.int64)]), "n": pa.array(np.r_[np.int64(len(keys)), n[top]])})

    # a key with over 1/HOT_SHARE of all n-grams has over half of that share in batches where it was noted, so the sums bound the list
    noted = rows.mapInArrow(trimmed(frequent), "k int, key long, n long").groupBy("k", "key").agg(F.sum("n").alias("n"))
    totals = {r["key"]: r["n"] for r in noted.where("k = 0").collect()}
    if not totals:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_words"), F.lit(0.0).alias("log_score"))
    limit = F.lit(0)
    for k in orders:
        limit = F.when(F.col("k") == k, totals.get(k, 0) // (2 * HOT_SHARE)).otherwise(limit)
    hot = {k: np.sort(np.array([r["key"] for r in part], np.int64).view(np.uint64)) for k, part in _by_order(noted.where((F.col("k") > 0) & (F.col("n") > limit) & (F.col("n") > 1)).collect()).items()}

    def hot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros(len(v), np.int64) for k, v in hot.items()}
        for _, words, counts in _documents(batches):
            for k, known in hot.items():
                keys = grams(words, counts, k)[0]
                at = _find(known, keys)
                sums[k] += np.bincount(at[at >= 0], minlength=len(known))
        for k, v in sums.items():
            yield pa.record_batch({"k": pa.array([k] * len(v), pa.int32()), "key": pa.array(hot[k].view(np.int64)), "n": pa.array(v)})

    exact = _by_order(rows.mapInArrow(trimmed(hot_counts), "k int, key long, n long").groupBy("k", "key").agg(F.sum("n").alias("n")).collect()) if hot else {}
    logs = {}
    for k, part in exact.items():
        table = dict((r["key"], r["n"]) for r in part)
        logs[k] = np.log(np.array([table[x] for x in hot[k].view(np.int64).tolist()], float))
    parts = max(MIN_PARTITIONS, sum(totals.values()) // PARTITION_GRAMS + 1)
    log_total = math.log(totals[1])

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, (ids, words, counts) in enumerate(_documents(batches)):
            batch = task << 32 | number
            own = np.where(counts > 0, -log_total, 0.0)
            out = []
            for k in orders:
                keys, doc, place = grams(words, counts, k)
                weight = _weights(counts, doc, place, k, order)
                if k in hot and len(keys):
                    at = _find(hot[k], keys)
                    is_hot = at >= 0
                    own += np.bincount(doc[is_hot], weights=weight[is_hot] * logs[k][at[is_hot]], minlength=len(ids))
                    keys, doc, weight = keys[~is_hot], doc[~is_hot], weight[~is_hot]
                if k < order - 1:  # these count for documents of just k words; the other n-grams go as counts of distinct keys
                    found, n = np.unique(keys[weight == 0], return_counts=True)
                    part = (found % np.uint64(parts)).astype(np.int64)
                    by = np.argsort(part, kind="stable")
                    found, n, part = found[by], n[by], part[by]
                    out += [(int(part[i]), k, batch, b"", b"", _short(found[i:j], parts), n[i:j].astype("<u4").tobytes()) for i, j in _runs(part)]
                    keys, doc, weight = keys[weight != 0], doc[weight != 0], weight[weight != 0]
                part = (keys % np.uint64(parts)).astype(np.int64)
                by = np.lexsort((doc, part))
                keys, doc, weight, part = keys[by], doc[by], weight[by], part[by]
                out += [(int(part[i]), k, batch, np.diff(doc[i:j], prepend=0).astype("<u2").tobytes(), weight[i:j].astype("<i1").tobytes(), _short(keys[i:j], parts), b"") for i, j in _runs(part)]
            out.append((-1, 0, batch, ids.astype("<i8").tobytes(), counts.astype("<u4").tobytes(), own.astype("<f8").tobytes(), b""))
            kinds = (pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4)
            yield pa.record_batch({n: pa.array([r[c] for r in out], t) for c, (n, t) in enumerate(zip(SHIPPED, kinds, strict=True))})

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        sums: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        at = None

        def count() -> None:
            """Counts the keys of one order and adds up their weighted logs by batch and document."""
            if not held:
                return
            raw = np.frombuffer(b"".join(r["keys"] for r in held), np.uint8).reshape(-1, KEY_BYTES)
            wide = np.zeros((len(raw), 8), np.uint8)
            wide[:, :KEY_BYTES] = raw
            times = np.concatenate([np.frombuffer(r["counts"], "<u4") if r["counts"] else np.ones(len(r["keys"]) // KEY_BYTES, np.uint32) for r in held])
            found, same = np.unique(wide.view("<u8").reshape(-1), return_inverse=True)
            logs_ = np.log(np.bincount(same, weights=times, minlength=len(found)))[same]
            start = 0
            for r in held:
                n = len(r["keys"]) // KEY_BYTES
                if not r["counts"]:
                    steps = np.frombuffer(r["steps"], "<u2").astype(np.int64)
                    firsts = np.flatnonzero(np.r_[True, steps[1:] > 0])
                    value = logs_[start:start + n] * np.frombuffer(r["weights"], "<i1")
                    sums.setdefault(r["batch"], []).append((np.cumsum(steps)[firsts], np.add.reduceat(value, firsts)))
                start += n
            held.clear()

        def close() -> Iterator[pa.RecordBatch]:
            rows = []
            for batch, got in sums.items():
                doc, back = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
                rows.append((batch, np.diff(doc, prepend=0).astype("<u2").tobytes(), np.bincount(back, weights=np.concatenate([g[1] for g in got])).astype("<f8").tobytes()))
            sums.clear()
            if rows:
                yield pa.record_batch({"batch": pa.array([r[0] for r in rows], pa.int64()), "own": pa.array([1] * len(rows), pa.int32()), "a": pa.array([r[1] for r in rows], pa.binary()), "b": pa.array([b""] * len(rows), pa.binary()), "c": pa.array([r[2] for r in rows], pa.binary())})

        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns[:3]]
            for i, (part, k, number) in enumerate(zip(*cols, strict=True)):
                r = {"batch": number} | {c: batch.column(j)[i].as_py() for j, c in enumerate(SHIPPED[3:], 3)}
                if part < 0:
                    yield pa.record_batch({"batch": pa.array([number], pa.int64()), "own": pa.array([0], pa.int32()), "a": pa.array([r["steps"]], pa.binary()), "b": pa.array([r["weights"]], pa.binary()), "c": pa.array([r["keys"]], pa.binary())})
                    continue
                if (part, k) != at:
                    count()
                    if at is not None and part != at[0]:
                        yield from close()
                    at = part, k
                held.append(r)
        count()
        yield from close()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A batch's own row, then its sums from every partition."""
        ids = sizes = scores = number = None

        def flush() -> pa.RecordBatch:
            return pa.record_batch({"doc_id": pa.array(ids), "n_words": pa.array(sizes), "log_score": pa.array(scores)})

        for batch in batches:
            for key, own, a, b, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if own == 0:
                    if number is not None:
                        yield flush()
                    number, ids, sizes, scores = key, np.frombuffer(a, "<i8"), np.frombuffer(b, "<u4").astype(np.int64), np.frombuffer(c, "<f8").copy()
                else:
                    assert key == number
                    scores[np.cumsum(np.frombuffer(a, "<u2").astype(np.int64))] += np.frombuffer(c, "<f8")
        if number is not None:
            yield flush()

    shipped = rows.mapInArrow(trimmed(ship), "part int, k int, batch long, steps binary, weights binary, keys binary, counts binary")
    deal = F.when(F.col("part") < 0, F.xxhash64("batch")).otherwise(F.col("part"))
    sums = shipped.repartition(parts, deal).sortWithinPartitions("part", "k").mapInArrow(trimmed(join), "batch long, own int, a binary, b binary, c binary")
    scored = sums.repartition("batch").sortWithinPartitions("batch", "own").mapInArrow(trimmed(add_up), "doc_id long, n_words long, log_score double")
    return scored.withColumn("doc_id", given_id())


def _runs(part: np.ndarray) -> list[tuple[int, int]]:
    """Where runs of equal values begin and end."""
    cuts = np.flatnonzero(np.diff(part)) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)], strict=True)) if len(part) else []


def _short(keys: np.ndarray, parts: int) -> bytes:
    """The keys without the partition that they name, in KEY_BYTES bytes each."""
    rest = (keys // np.uint64(parts)) & np.uint64((1 << 8 * KEY_BYTES) - 1)
    return np.ascontiguousarray(rest.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]).tobytes()


def _by_order(rows: list) -> dict[int, list]:
    out: dict[int, list] = {}
    for r in rows:
        out.setdefault(r["k"], []).append(r)
    return out


def _find(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of each key in a sorted array, or -1."""
    if not len(known):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, at, -1)


def exploded(docs: DataFrame, order: int) -> DataFrame:
    """(row, doc_id, g1 .. g_order): a row a word, with the hashes of the n-grams that end there, null where a document has no such; one row of nulls for a document without words."""
    words = F.array_remove(F.split(F.translate(F.coalesce(F.col("text"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[ \t\n\x0B\f\r]+"), "")
    df = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), words.alias("_w")).select("row", "doc_id", F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"))
    rows = df.select("row", "doc_id", "_h", F.posexplode_outer("_h").alias("_i", "g1"))
    back = lambda n: F.when(F.col("_i") >= n - 1, F.xxhash64(F.lit(n), F.slice("_h", F.col("_i") - n + 2, F.lit(n))))
    return rows.select("row", "doc_id", "g1", *[back(n).alias(f"g{n}") for n in range(2, order + 1)], *[F.when(F.col("_i") >= n, F.xxhash64(F.lit(n), F.slice("_h", F.col("_i") - n + 1, F.lit(n))) if n > 1 else F.get("_h", F.col("_i") - 1)).alias(f"ctx{n}") for n in range(1, order)])


def count_tables(reference: DataFrame, order: int = ORDER) -> dict[int, DataFrame]:
    """(g, n) of each order over a reference corpus, partitioned by hash and combined before the shuffle."""
    rows = exploded(reference, order)
    return {k: rows.where(F.col(f"g{k}").isNotNull()).groupBy(F.col(f"g{k}").alias("g")).agg(F.count("*").alias("n")) for k in range(1, order + 1)}


def score_against(docs: DataFrame, reference: DataFrame, order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """(doc_id, n_words, log_score) of documents by the counts of another corpus; one row a row of ``docs``.

    Each word takes the longest n-gram that its table has: its count over that of its context, times ``backoff`` for every
    order given up; a word that the reference lacks counts as seen once among its words. Texts without words score 0.
    """
    tables = count_tables(reference, order)
    rows = exploded(docs, order)
    total = tables[1].agg(F.coalesce(F.sum("n"), F.lit(1)).alias("n")).first()["n"]
    for k in range(1, order + 1):
        rows = rows.join(tables[k].select(F.col("g").alias(f"g{k}"), F.col("n").alias(f"n{k}")), f"g{k}", "left")
        if k < order:
            rows = rows.join(tables[k].select(F.col("g").alias(f"ctx{k}"), F.col("n").alias(f"m{k}")), f"ctx{k}", "left")
    share = F.coalesce(F.col("n1"), F.lit(1)) / F.lit(total)
    score = F.log(share) + (order - 1) * math.log(backoff)
    for k in range(2, order + 1):
        score = F.when(F.col(f"n{k}").isNotNull(), F.log(F.col(f"n{k}") / F.col(f"m{k - 1}")) + (order - k) * math.log(backoff)).otherwise(score)
    summed = rows.groupBy("row", "doc_id").agg(F.count("g1").alias("n_words"), F.sum(F.when(F.col("g1").isNotNull(), score)).alias("log_score"))
    return summed.select("doc_id", "n_words", F.coalesce("log_score", F.lit(0.0)).alias("log_score"))


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` with the log of its trigram stupid-backoff score by the counts of all documents."""
    return score_corpus(documents(spark, sf_dir))

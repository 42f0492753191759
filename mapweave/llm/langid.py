"""Language identification: multinomial naive Bayes over hashed character n-grams (operator 6)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, on_workers, trimmed

ORDERS = (1, 2, 3)
#: Hash buckets of n-grams. With MAX_LANGUAGES languages the broadcast matrix takes 128 MB, with ten 2.6 MB.
DIMENSIONS = 1 << 16
MAX_LANGUAGES = 512
#: Expected training documents a language at most, taken by a hash of doc_id; whole texts of them.
TRAIN_DOCS = 5000
TRAIN_PARTS = 12
#: Buckets of a row of counts, of which TRAIN_PARTS rows each are added up.
BLOCK = 1 << 13
SMOOTHING = 0.5
FOLDS = 5
#: Characters scored at once.
CHUNK_CHARS = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point, itself if it is a letter and else a space."""
    return np.array([i if chr(i).isalpha() else 32 for i in range(0x110000)], np.uint32)


def pieces(text: str) -> Iterator[tuple[np.ndarray, int]]:
    """Code points of the lower-cased text, each run of other characters than letters made one space, with a space around.

    A long text comes in pieces; each begins with the last points of the one before (their number comes with it), so no
    n-gram is lost or doubled. A text without letters has no piece.
    """
    text = text.lower()
    tail, old = np.array([32], np.uint32), 0
    if len(text) <= CHUNK_CHARS and not _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].max(initial=32) > 32:
        return
    for i in range(0, len(text), CHUNK_CHARS):
        points = _letters()[np.frombuffer(text[i:i + CHUNK_CHARS].encode("utf-32-le", "surrogatepass"), "<u4")]
        points = np.concatenate([tail, points, np.full(int(i + CHUNK_CHARS >= len(text)), 32, np.uint32)])
        space = points == 32
        points = points[~(space & np.r_[False, space[:-1]])]
        if len(points) > old:
            yield points, old
        tail = points[-(max(ORDERS) - 1):]
        old = len(tail)


def grams(points: np.ndarray, old: int = 0) -> np.ndarray:
    """Hash buckets of all n-grams that end after the first ``old`` points."""
    with np.errstate(over="ignore"):
        p = points.astype(np.uint64)
        out = [np.zeros(0, np.int64)]
        for n in ORDERS:
            first = max(0, old - n + 1)
            size = len(p) - n + 1 - first
            if size < 1:
                continue
            h = np.full(size, n, np.uint64)
            for k in range(n):
                h = (h + p[first + k:first + k + size]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            out.append((h >> np.uint64(64 - 16)).astype(np.int64) & (DIMENSIONS - 1))
    return np.concatenate(out)


class Model:
    """Log probabilities (bucket x language) and log priors."""

    def __init__(self, languages: list[str], log_probs: np.ndarray, priors: np.ndarray):
        self.languages, self.log_probs, self.priors = languages, log_probs, priors

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The likeliest language of each text and its probability, with log odds divided by the root of the number of n-grams; ``und`` and 0 without letters."""
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return names, scores
        logits = np.zeros((len(texts), len(self.languages)))
        sizes, lettered = np.zeros(len(texts)), np.zeros(len(texts), bool)
        rows, held, amount = [], [], 0

        def flush() -> None:
            nonlocal rows, held, amount
            if rows:
                starts = np.r_[0, np.cumsum([len(x) for x in held])[:-1]]
                np.add.at(logits, rows, np.add.reduceat(self.log_probs[np.concatenate(held)], starts, axis=0, dtype=np.float64))
            rows, held, amount = [], [], 0

        for k, text in enumerate(texts):
            for points, old in pieces(text or ""):
                lettered[k] |= bool((points != 32).any())
                ids = grams(points, old)
                if not len(ids):
                    continue
                rows.append(k)
                held.append(ids)
                sizes[k] += len(ids)
                amount += len(ids)
                if amount > CHUNK_CHARS:
                    flush()
        flush()
        z = (logits + self.priors) / np.sqrt(np.maximum(sizes, 1))[:, None]
        best = z.argmax(axis=1)
        p = 1 / np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1)
        for k in np.flatnonzero(lettered).tolist():
            names[k], scores[k] = self.languages[best[k]], float(p[k])
        return names, scores


def train(labelled: DataFrame, text: str, lang: str, key: str) -> Model:
    """Fits a model on rows with a text and a label; priors are the labels' shares of all those rows.

    The n-grams of at most about TRAIN_DOCS documents a language are counted, in TRAIN_PARTS tasks, and added up by language
    and block of buckets; what reaches the driver is the matrix itself. Only the MAX_LANGUAGES most frequent labels are learned.
    """
    on_workers(labelled.sparkSession)
    rows = labelled.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where("l is not null and t is not null")
    top = rows.groupBy("l").count().orderBy(F.desc("count"), "l").limit(MAX_LANGUAGES).collect()
    sizes = {r["l"]: r["count"] for r in top}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((DIMENSIONS, 0), np.float32), np.zeros(0))
    shares = labelled.sparkSession.createDataFrame([(n, min(1.0, TRAIN_DOCS / c), i) for i, (n, c) in enumerate((n, sizes[n]) for n in languages)], "l string, share double, i int")
    drawn = F.pmod(F.xxhash64("k", F.lit(6)), F.lit(1_000_000)) < F.col("share") * 1_000_000
    sample = rows.join(F.broadcast(shares), "l").where(drawn).select("i", "t").repartition(TRAIN_PARTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = totals.setdefault(i, np.zeros(DIMENSIONS, np.int64))
                for points, old in pieces(t):
                    own += np.bincount(grams(points, old), minlength=DIMENSIONS)
        for i, own in totals.items():
            blocks = range(0, DIMENSIONS, BLOCK)
            yield pa.record_batch({"i": pa.array([i] * len(blocks), pa.int32()), "block": pa.array(list(blocks), pa.int32()), "counts": pa.array([own[b:b + BLOCK].tobytes() for b in blocks], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        own = sum(np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist())
        return pa.table({"i": table.column("i").slice(0, 1), "block": table.column("block").slice(0, 1), "counts": pa.array([own.tobytes()], pa.binary())})

    form = "i int, block int, counts binary"
    totals = np.zeros((len(languages), DIMENSIONS))
    for r in sample.mapInArrow(trimmed(count), form).groupBy("i", "block").applyInArrow(add, form).toLocalIterator():
        totals[r["i"], r["block"]:r["block"] + BLOCK] = np.frombuffer(r["counts"], np.int64)
    smooth = totals + SMOOTHING
    share = np.array([sizes[n] for n in languages], float)
    return Model(languages, np.log(smooth / smooth.sum(axis=1, keepdims=True)).T.astype(np.float32).copy(), np.log((share + 1) / (share.sum() + len(languages))))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` from the text alone; ``und`` and 0 for a null text or one without letters. No shuffle.

    One row a row of ``docs``, repeated ones too; columns of these names that it has already are replaced.
    """
    spark = docs.sparkSession
    on_workers(spark)
    shared = spark.sparkContext.broadcast((model.languages, model.log_probs, model.priors))

    @F.arrow_udf("struct<lang_pred:string, score:double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = Model(*shared.value)
        for texts in batches:
            names, scores = m.score(texts.to_pylist())
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    out = docs.withColumn("__prediction", run(F.col(text)))
    return out.withColumns({"lang_pred": F.col("__prediction.lang_pred"), "score": F.col("__prediction.score")}).drop("__prediction")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents``: held_out by its doc_id (one without is held out), and the language that its text shows."""
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(True))
    model = train(docs.where(~held_out), "text", "lang", "doc_id")
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")

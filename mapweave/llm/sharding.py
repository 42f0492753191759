"""Jump consistent hashing: documents to shards without a ring table (operator 9)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, on_workers

#: Fixed values of the jump consistent hash: the multiplier of its generator, and of the 64-bit mixer before it.
JUMP = 2862933555777941757
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
#: Ranges of doc_id in which slots are numbered apart, at most.
MAX_RANGES = 4096
ROWS_PER_RANGE = 200_000


def mix64(keys: np.ndarray) -> np.ndarray:
    """Spreads integer keys over 64 bits, so that runs of neighbouring ids share no pattern."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.int64).view(np.uint64) + np.uint64(MIX[0])
        z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX[1])
        z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX[2])
        return z ^ (z >> np.uint64(31))


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard from 0 to ``shards`` - 1 of each 64-bit key; with one more shard a key stays or goes to the new one."""
    if shards < 1:
        raise ValueError("shards must be positive")
    state = mix64(keys)
    at = np.zeros(len(state), np.int64)
    ahead = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    with np.errstate(over="ignore"):
        while len(live):
            at[live] = ahead[live]
            state[live] = state[live] * np.uint64(JUMP) + np.uint64(1)
            ahead[live] = ((at[live] + 1) * (float(1 << 31) / ((state[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
            live = live[ahead[live] < shards]
    return at


def assign_shards(df: DataFrame, key: str, shards: int, grown: int | None = None) -> DataFrame:
    """Adds ``shard`` and ``grown_shard`` (with ``grown`` shards) by the integer column ``key``. No shuffle.

    A null key counts as 0, whatever stands beside it. Rows with equal keys share a shard. An empty table stays empty.
    Columns of these two names that ``df`` has already are replaced.
    """
    on_workers(df.sparkSession)
    grown = grown or shards + 1

    @F.arrow_udf("struct<shard:int, grown_shard:int>")
    def place(ids: pa.Array) -> pa.Array:
        keys = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
        return pa.StructArray.from_arrays([pa.array(jump_hash(keys, n).astype(np.int32)) for n in (shards, grown)], ["shard", "grown_shard"])

    placed = df.withColumn("__slot_place", place(F.col(key).cast("long")))
    return placed.withColumns({"shard": F.col("__slot_place.shard"), "grown_shard": F.col("__slot_place.grown_shard")}).drop("__slot_place")


def number_slots(df: DataFrame, key: str, ties: list[str]) -> DataFrame:
    """Adds ``slot``: each row's place in its ``shard`` by ``key`` (then ``ties``), from 0 without gaps; null keys come first.

    Rows are ranked in ranges of ``key`` inside a shard, and the rows of earlier ranges are added: no task
    sees a whole shard. The table of range sizes has shards x MAX_RANGES rows at most, so it may be broadcast.
    """
    total = df.count()
    n = max(1, min(MAX_RANGES, total // ROWS_PER_RANGE + 1))
    cuts = sorted(set(df.approxQuantile(key, [i / n for i in range(1, n)], 0.25 / n))) if n > 1 else []

    @F.arrow_udf("int")
    def range_of(ids: pa.Array) -> pa.Array:
        keys = pc.fill_null(ids, np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        return pa.array(np.searchsorted(np.asarray(cuts, np.float64), keys.astype(np.float64), side="left").astype(np.int32))

    ranged = df.withColumn("__slot_range", range_of(F.col(key).cast("long")) if cuts else F.lit(0))
    sizes = ranged.groupBy("shard", "__slot_range").count()
    before = Window.partitionBy("shard").orderBy("__slot_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "__slot_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__slot_before"))
    inside = Window.partitionBy("shard", "__slot_range").orderBy(key, *ties)
    ranked = ranged.withColumn("__slot_rank", F.row_number().over(inside))
    return ranked.join(F.broadcast(offsets), ["shard", "__slot_range"]).withColumn("slot", F.col("__slot_before") + F.col("__slot_rank") - 1).drop("__slot_before", "__slot_rank", "__slot_range")


def op9_jump_shards(spark: SparkSession, sf_dir: str, shards: int = 8) -> DataFrame:
    """Every row of ``documents`` in one of ``shards`` shards by its doc_id: law ``key``.

    Null text: size 1, checksum 0. Repeated rows go to the same shard and take slots of their own.
    """
    docs = documents(spark, sf_dir).select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    placed = assign_shards(docs, "doc_id", shards)
    return number_slots(placed, "doc_id", ["text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: CRC-32: its polynomial, least bit first, and how many doublings reach a text's longest part in SQL (2^DOUBLINGS bytes).
CRC_POLYNOMIAL = 0xEDB88320
DOUBLINGS = 24


def _crc_step(v: int) -> int:
    """The remainder times x."""
    return v >> 1 ^ (CRC_POLYNOMIAL if v & 1 else 0)


def _crc_times(column: str, factor: int) -> str:
    """SQL of the product of a remainder and a known one modulo the polynomial."""
    terms = []
    for bit in range(31, -1, -1):  # bit 31 is x^0
        terms.append(f"(CASE WHEN ({column} & {1 << bit}) <> 0 THEN {factor} ELSE 0 END)")
        factor = _crc_step(factor)
    out = terms[0]
    for t in terms[1:]:
        out = f"xor({out}, {t})"
    return out


def crc32_sql(table: str) -> str:
    """SQL of (doc_id, text_crc32) for a table (doc_id, text): the checksum is linear, so every byte adds its remainder by its place from the end."""
    factor, eighth = 1 << 30, []
    for _ in range(8):  # x^1 to x^8
        eighth.append(factor)
        factor = _crc_step(factor)
    square, steps = eighth[7], ["p0 AS (SELECT k, 2147483648::BIGINT AS v FROM (SELECT unnest(range(0, (SELECT max(n) + 4 FROM texts))) AS k))"]
    for j in range(DOUBLINGS):
        steps.append(f"p{j + 1} AS (SELECT k, CASE WHEN (k & {1 << j}) <> 0 THEN {_crc_times('v', square)} ELSE v END AS v FROM p{j})")
        new = 0
        for bit in range(31, -1, -1):  # square of the factor
            if square >> bit & 1:
                part = square
                for _ in range(31 - bit):
                    part = _crc_step(part)
                new ^= part
        square = new
    powers = ", ".join(f"{_crc_times('v', 1 << (31 - b))} AS v{b}" for b in range(8))  # x^(8k) to x^(8k + 7)
    bits = "(CASE WHEN (b & {m}) <> 0 THEN v{p} ELSE 0 END)"
    value = bits.format(m=1, p=7)
    for bit in range(1, 8):
        value = f"xor({value}, {bits.format(m=1 << bit, p=7 - bit)})"
    return f"""texts AS (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) AS n FROM {table}), {', '.join(steps)},
powers AS (SELECT k, {powers} FROM p{DOUBLINGS}),
cut AS (SELECT doc_id, n, unnest(regexp_extract_all(hex(encode(t)), '..')) AS h, generate_subscripts(regexp_extract_all(hex(encode(t)), '..'), 1) AS i FROM texts WHERE n > 0),
bytes AS (SELECT doc_id, n - i + 4 AS k, CAST('0x' || h AS BIGINT) AS b FROM cut UNION ALL SELECT doc_id, n + 3 - i, 255 FROM (SELECT doc_id, n, unnest(range(0, 4)) AS i FROM texts)),
crcs AS (SELECT doc_id, xor(bit_xor({value}), 4294967295) AS text_crc32 FROM bytes JOIN powers USING (k) GROUP BY doc_id)"""


def op9_oracle(shards: int = 8) -> str:
    """The same in SQL: products modulo 2^64 in 128-bit integers, the walk unrolled (each step raises the shard), and the checksum by places. doc_id is unique and not null there."""
    mul = lambda a, c: f"CAST((CAST({a} AS UHUGEINT) * {c}::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT)"
    shift = lambda n: f"xor(z, z >> {n})"
    steps = [
        f"h0 AS (SELECT *, CAST((CAST(doc_id AS UHUGEINT) + {MIX[0]}::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT) AS z FROM documents)",
        f"h1 AS (SELECT * REPLACE ({mul(shift(30), MIX[1])} AS z) FROM h0)", f"h2 AS (SELECT * REPLACE ({mul(shift(27), MIX[2])} AS z) FROM h1)",
        f"s0 AS (SELECT doc_id, text, {shift(31)} AS z, 0::BIGINT AS at8, 0::BIGINT AS at9, 0::BIGINT AS ahead FROM h2)",
    ]
    for k in range(shards + 1):
        moved = f"SELECT doc_id, text, CASE WHEN ahead < {shards + 1} THEN CAST(({mul('z', JUMP)}::UHUGEINT + 1::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT) ELSE z END AS z, CASE WHEN ahead < {shards} THEN ahead ELSE at8 END AS at8, CASE WHEN ahead < {shards + 1} THEN ahead ELSE at9 END AS at9, ahead FROM s{k}"
        steps.append(f"s{k + 1} AS (SELECT * REPLACE (CASE WHEN ahead < {shards + 1} THEN CAST(floor((at9 + 1) * (2147483648.0::DOUBLE / ((z >> 33) + 1)::DOUBLE)) AS BIGINT) ELSE ahead END AS ahead) FROM ({moved}))")
    return f"""WITH {', '.join(steps)},
f AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) + 1 AS BIGINT) AS size, text, CAST(at8 AS INT) AS shard, CAST(at9 AS INT) AS grown_shard FROM s{shards + 1}),
{crc32_sql('documents')}
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, grown_shard FROM f JOIN crcs USING (doc_id)"""

"""Packing of token sequences by best fit and swap-based local search (operator 10)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, on_workers, stage, trimmed
from .encoding import encoder, slices

#: Pieces that one task packs together; groups fill their last sequence alone, one in some thousands.
GROUP_PIECES = 8192
#: Rounds in a row that empty no bin after which the search of a group ends; where sizes are mixed it comes to rest long before.
STALE_ROUNDS = 512


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bins of items by best fit in descending size; returns each item's bin and each bin's fill."""
    bin_of = np.zeros(len(sizes), np.int64)
    fills: list[int] = []
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_gaps = 0  # bit g is set when a bin with gap g is open
    for k in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[k])
        fitting = open_gaps >> s << s
        if fitting:
            gap = (fitting & -fitting).bit_length() - 1
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                open_gaps &= ~(1 << gap)
        else:
            gap, b = capacity, len(fills)
            fills.append(0)
        fills[b] += s
        bin_of[k] = b
        if gap > s:
            by_gap[gap - s].append(b)
            open_gaps |= 1 << (gap - s)
    return bin_of, np.asarray(fills, np.int64)


def swap_search(sizes: np.ndarray, bin_of: np.ndarray, fills: np.ndarray, capacity: int) -> np.ndarray:
    """Improves a packing until the fewest conceivable bins are reached, nothing moves, or STALE_ROUNDS rounds empty no bin; returns each item's bin.

    The emptiest bin gives: an item of it moves to the fullest bin with room, or is exchanged for a smaller item or any two
    smaller ones of a fuller bin that ends fuller yet. Each step raises the sum of squared fills, so the search ends; a bin
    without items is gone. Full bins can't take part, so the search is over the items of the others.
    """
    bin_of, fills = bin_of.copy(), fills.copy()
    spare = int((fills > 0).sum()) - -(-int(sizes.sum()) // capacity)  # bins that may go at best
    stale = 0
    while spare > 0:
        open_ = np.flatnonzero(fills[bin_of] < capacity)
        if not len(open_):
            break
        names, local = np.unique(bin_of[open_], return_inverse=True)
        got, gone, stale, more = _search(sizes[open_], local, fills[names], capacity, spare, stale)
        bin_of[open_] = names[got]
        fills = np.bincount(bin_of, weights=sizes, minlength=len(fills)).astype(np.int64)
        spare -= gone
        if not more:
            break
    return bin_of


def _search(sizes: np.ndarray, bin_of: np.ndarray, fills: np.ndarray, capacity: int, spare: int, stale: int) -> tuple[np.ndarray, int, int, bool]:
    """Rounds over bins that aren't full, until half of them are: each item's bin, bins emptied, stale rounds, and whether to go on."""
    fills = fills.copy()
    closed = np.zeros(len(fills), bool)
    gone = 0
    while gone < spare and stale < STALE_ROUNDS:
        in_play = (fills > 0) & (fills < capacity)
        candidates = np.flatnonzero(in_play & ~closed)
        if not len(candidates):
            return bin_of, gone, stale, False
        if 2 * int(in_play.sum()) < len(fills):
            return bin_of, gone, stale, True
        giver = int(candidates[np.argmin(fills[candidates])])
        moved = False
        for k in np.flatnonzero(bin_of == giver)[np.argsort(-sizes[bin_of == giver], kind="stable")].tolist():
            y = int(sizes[k])
            gaps = capacity - fills
            room = np.flatnonzero((gaps >= y) & (fills > 0) & (fills + y > fills[giver]))
            room = room[room != giver]
            if len(room):
                to, back = int(room[np.argmin(gaps[room])]), []
            else:
                to, back = _exchange(sizes, bin_of, fills, gaps, giver, y)
            if to >= 0:
                bin_of[k] = to
                bin_of[back] = giver
                less = y - int(sizes[back].sum())
                fills[to] += less
                fills[giver] -= less
                moved = True
        stale += 1
        if fills[giver] == 0:
            gone, stale = gone + 1, 0
        if moved:
            closed[:] = False
        else:
            closed[giver] = True
    return bin_of, gone, stale, False


def _exchange(sizes: np.ndarray, bin_of: np.ndarray, fills: np.ndarray, gaps: np.ndarray, giver: int, y: int) -> tuple[int, list[int]]:
    """The bin to take an item of size ``y`` and the one or two items it gives for it, of all that a bin holds; (-1, []) if none gets fuller."""
    open_items = np.flatnonzero((gaps[bin_of] > 0) & (bin_of != giver) & (sizes < y))
    if not len(open_items):
        return -1, []
    gain = y - sizes[open_items]
    fits = (gain <= gaps[bin_of[open_items]]) & (fills[bin_of[open_items]] + gain > fills[giver])
    best, to, back = 0, -1, []
    if fits.any():
        i = int(np.argmax(np.where(fits, gain, 0)))
        best, to, back = int(gain[i]), int(bin_of[open_items[i]]), [int(open_items[i])]
    order = open_items[np.lexsort((sizes[open_items], bin_of[open_items]))]
    where, size = bin_of[order], sizes[order]
    third = np.r_[False, False, (where[2:] == where[:-2]) & (size[2:] == size[:-2])][:len(order)]
    order, where, size = order[~third], where[~third], size[~third]  # of equal items of a bin two are enough
    apart = 1
    while apart < len(order):
        pair = np.flatnonzero(where[apart:] == where[:-apart])
        if not len(pair):
            break
        gain = y - size[pair] - size[pair + apart]
        fits = (gain > best) & (gain <= gaps[where[pair]]) & (fills[where[pair]] + gain > fills[giver])
        if fits.any():
            i = int(np.argmax(np.where(fits, gain, 0)))
            best, to, back = int(gain[i]), int(where[pair[i]]), [int(order[pair[i]]), int(order[pair[i] + apart])]
        apart += 1
    return to, back


def pack_items(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item; sizes are from 1 to ``capacity``. Items of full size take bins of their own."""
    bin_of = np.zeros(len(sizes), np.int64)
    small = np.flatnonzero(sizes < capacity)
    if len(small):
        bins, fills = best_fit(sizes[small], capacity)
        bin_of[small] = np.unique(swap_search(sizes[small], bins, fills, capacity), return_inverse=True)[1]
    full = np.flatnonzero(sizes >= capacity)
    bin_of[full] = np.arange(len(full)) + (bin_of[small].max() + 1 if len(small) else 0)
    return bin_of


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """Pieces of whole texts: doc_id, piece, start, length, ids_crc32 and, if wanted, ids. Only over-long documents are cut; their first piece takes the remainder."""
    on_workers(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, n in slices(batch.column(1)):
                part = batch.slice(i, n)
                ids, at = encoder(tokenizer).encode_array(part.column(1), [end_id])
                sizes = np.diff(at)
                pieces = -(-sizes // capacity)
                doc = np.repeat(np.arange(len(sizes)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                stop = ((sizes - 1) % capacity + 1)[doc] + piece * capacity
                start = np.where(piece == 0, 0, stop - capacity)
                bounds = np.r_[at[doc] + start, at[-1]]
                data = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]
                out = {"doc_id": part.column(0).take(pa.array(doc)), "piece": pa.array(piece.astype(np.int32)), "start": pa.array(start), "length": pa.array(stop - start), "ids_crc32": pa.array(crcs, pa.int64())}
                if with_ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.view(np.int32)))
                yield pa.record_batch(out)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(cut), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def pack_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a staged table of pieces.

    Pieces are dealt at random into groups of about GROUP_PIECES, each packed by one task. Repeated rows are packed one by one.
    """
    spark = pieces.sparkSession
    on_workers(spark)
    groups = pieces.count() // GROUP_PIECES + 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        group = None

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            sizes = t.column("length").to_numpy()
            bins = pack_items(sizes, capacity)
            order = np.argsort(bins, kind="stable")
            ends = np.cumsum(sizes[order])
            firsts = np.r_[True, np.diff(bins[order]) > 0]
            base = np.maximum.accumulate(np.where(firsts, ends - sizes[order], 0))
            offset = np.empty(len(sizes), np.int64)
            offset[order] = ends - sizes[order] - base
            return t.append_column("sequence_id", pa.array(bins + (np.int64(group) << 32))).append_column("offset", pa.array(offset)).drop_columns(["_group"]).combine_chunks().to_batches()[0]

        for batch in batches:
            keys = batch.column(batch.schema.get_field_index("_group")).to_numpy()
            for at in np.split(np.arange(len(keys)), np.flatnonzero(np.diff(keys)) + 1):
                if not len(at):
                    continue
                if group is not None and keys[at[0]] != group:
                    yield flush()
                    held.clear()
                group = int(keys[at[0]])
                held.append(batch.slice(int(at[0]), len(at)))
        if held:
            yield flush()

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int"))
    return dealt.repartition("_group").sortWithinPartitions("_group", "doc_id", "piece", "ids_crc32").mapInArrow(trimmed(place), f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """Packs whole texts (null counts as empty: the end id alone) into sequences of at most ``capacity`` ids; one row a piece."""
    return pack_pieces(stage(cut_pieces(docs, tokenizer, end_id, capacity, with_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves, from pieces packed with their ids: sequence_id, ids. A group here is one sequence, so it is bounded."""
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))


def op10_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` in sequences of at most 1024 ids."""
    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)

"""SentencePiece models on the tokenizers library: parsed, rebuilt, encoded in batches, held against the original (operator 2)."""

from __future__ import annotations

import gc
import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, on_workers, trimmed
from .encoding import BATCH, PartTable, slices, strings

#: The mark that stands for a space.
SPACE = "▁"
#: Fixed values of the model format: kinds of models and of pieces.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Put before pieces that no text may match.
HIDDEN = "\U0010ffff"
#: What decoding writes for the unknown piece.
UNKNOWN_TEXT = " ⁇ "
#: More spaces than a text has.
MANY = 1 << 31
#: Threads of a batch in one worker.
THREADS = 2


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of one protobuf message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at:at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at:at + size], at + size
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, value


class PieceModel:
    """What a model file holds: pieces with scores and kinds, the model's kind, and how texts are normalised."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.byte_fallback, self.unk, self.suffix = UNIGRAM, False, 0, False
        self.charsmap, self.dummy_prefix, self.trim, self.escape = b"", True, True, True
        for number, value in fields(data):
            if number == 1:
                p = dict(fields(value))
                self.pieces.append((p[1].decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
            elif number == 2:
                t = dict(fields(value))
                self.kind, self.byte_fallback, self.unk = t.get(3, UNIGRAM), bool(t.get(35, 0)), t.get(40, 0)
                self.suffix = bool(t.get(24, 0))
            elif number == 3:
                n = dict(fields(value))
                self.charsmap, self.dummy_prefix, self.trim, self.escape = n.get(2, b""), bool(n.get(3, 1)), bool(n.get(4, 1)), bool(n.get(5, 1))
        if self.suffix:
            raise ValueError("marks after words aren't supported")
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError(f"model type {self.kind} isn't supported")


def core(model: PieceModel):
    """The library's model of the pieces: scores and byte fallback, or merges in order of the score of what they make."""
    from tokenizers import models

    if model.kind == UNIGRAM:
        normal = [s for _, s, kind in model.pieces if kind == NORMAL] or [0.0]
        score = {NORMAL: lambda p, s: s, USER: lambda p, s: len(p.encode()) * max(normal) - 0.1}
        name = lambda p, kind: p if kind in (NORMAL, USER, BYTE) else HIDDEN + p
        return models.Unigram([(name(p, kind), score.get(kind, lambda p, s: max(normal))(p, s)) for p, s, kind in model.pieces], unk_id=model.unk, byte_fallback=model.byte_fallback)
    ids = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    whole = {p: s for p, s, kind in model.pieces if kind == NORMAL}
    merges = []
    for piece, score in whole.items():
        merges += [(-score, k, piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in whole and piece[k:] in whole]
    merges.sort(key=lambda m: m[:2])
    user = any(kind == USER for _, _, kind in model.pieces)
    return models.BPE(ids, [m[2:] for m in merges], unk_token=model.pieces[model.unk][0], fuse_unk=True, byte_fallback=model.byte_fallback, ignore_merges=user)


def rebuild(model: PieceModel):
    """A tokenizers.Tokenizer that encodes and decodes whole texts as the model does.

    In the model's order: its character map, spaces trimmed and collapsed, the space in front, then spaces become marks.
    Pieces may hold marks inside, so the text isn't split at them; symbols of the user are cut out where merges rule.
    """
    from tokenizers import Regex, Tokenizer, decoders, normalizers, pre_tokenizers

    out = Tokenizer(core(model))
    steps = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.trim:
        steps += [normalizers.Replace(Regex(rf"\A +|[ {SPACE if model.escape else ''}]+\z"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if steps:
        out.normalizer = normalizers.Sequence(steps)
    before = [pre_tokenizers.Metaspace(SPACE, prepend_scheme="never", split=False)] if model.escape else []
    user = sorted((p for p, _, kind in model.pieces if kind == USER), key=len, reverse=True)
    if user and model.kind == BPE:
        before.append(pre_tokenizers.Split(Regex("|".join("".join(f"\\x{{{ord(c):x}}}" for c in p) for p in user)), "isolated"))
    if before:
        out.pre_tokenizer = pre_tokenizers.Sequence(before)
    front = MANY if model.trim else int(model.dummy_prefix)
    out.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", front, 0)] if front else [])])
    return out


class Pieces:
    """Encodes and decodes whole texts. The ids are those of the original library on the whole text."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self._load(f.read())

    @classmethod
    def of(cls, data: bytes) -> Pieces:
        """From a model file's content."""
        out = cls.__new__(cls)
        out._load(data)
        return out

    def _load(self, data: bytes) -> None:
        os.environ["RAYON_NUM_THREADS"] = str(THREADS)
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        from tokenizers import Tokenizer

        self.model = model = PieceModel(data)
        self.tokenizer = rebuild(model)
        self.bare = Tokenizer(self.tokenizer.model)  # for parts, which come with their mark
        self.ids = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        self.runs: dict[int, list[int]] = {}
        self.table, self.odd_table = PartTable(self._new), PartTable(lambda words: self._batches([SPACE + w for w in words]))
        self.bytes = [self._bytes(p, kind) for p, _, kind in model.pieces]
        #: Models whose words don't depend on each other and whose texts stay as they are go word by word, and line by line.
        self.by_words = model.kind == BPE and not model.charsmap and not model.trim and model.escape and model.dummy_prefix and SPACE in self.ids and not any(SPACE in p[1:] and p.strip(SPACE) for p in self.ids) and not any(k == USER for _, _, k in model.pieces)
        self.by_lines = model.byte_fallback and not any("\n" in p for p in self.ids)

    @staticmethod
    def _bytes(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind in (CONTROL, UNKNOWN):
            return b"" if kind == CONTROL else UNKNOWN_TEXT.encode()
        return piece.replace(SPACE, " ").encode()

    def _batches(self, parts: list[str]) -> list[list[int]]:
        return [e.ids for i in range(0, len(parts), BATCH) for e in self.bare.encode_batch_fast(parts[i:i + BATCH], add_special_tokens=False)]

    def _new(self, parts: list[str]) -> list[list[int]]:
        """Ids of parts; a part that doesn't begin with a line feed stands for the mark and itself."""
        return self._batches([p if self.by_lines and p[:1] == "\n" else SPACE + p for p in parts])

    def _run(self, n: int) -> list[int]:
        """Ids of a run of ``n`` space marks: of neighbours that make a piece, the best scored merge first, the leftmost of equals."""
        if n not in self.runs:
            scores = {len(p): s for p, s, kind in self.model.pieces if kind == NORMAL and not p.strip(SPACE)}
            parts = [1] * n
            while True:
                best = max(((scores[a + b], -k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in scores), default=None)
                if best is None:
                    break
                k = -best[1]
                parts[k:k + 2] = [parts[k] + parts[k + 1]]
            self.runs[n] = [self.ids[SPACE * p] for p in parts]
        return self.runs[n]

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another (null and empty texts have none), and where each begins."""
        texts = pc.fill_null(texts, "")
        if not self.by_words:
            found = [e.ids for e in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.fromiter((x for ids in found for x in ids), np.uint32), np.cumsum([0, *map(len, found)])
        odd = "  |\\A | \\z|" + SPACE + (r"| \n" if self.by_lines else "")
        plain = ~pc.or_(pc.match_substring_regex(texts, odd), pc.equal(texts, "")).to_numpy(zero_copy_only=False)
        cut = texts.filter(pa.array(plain))
        if self.by_lines:
            cut = pc.replace_substring(cut, "\n", " \n")
        return self.table.join(pc.split_pattern(cut, " "), plain, self._odd(texts.filter(pa.array(~plain)).to_pylist()), [])

    def _odd(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts with runs of spaces: an empty word is a space more before the next."""
        cut = [t.replace(SPACE, " ").split(" ") if t else [] for t in texts]
        words = list(dict.fromkeys(w for words in cut for w in words if w))
        place = dict(zip(words, self.odd_table.places(words).tolist(), strict=True))
        out = []
        for words in cut:
            ids: list[int] = []
            run = 0
            for w in words:
                if not w:
                    run += 1
                    continue
                got = self.odd_table.at(place[w])
                if run:
                    lone = got[0] == self.ids[SPACE]
                    ids += self._run(run + lone)
                    got, run = got[lone:], 0
                ids += got
            out.append(ids + self._run(run) if run else ids)
        self.odd_table.forget()
        return out

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text."""
        ids, at = self.encode_array(pa.array(texts, pa.string()))
        return [ids[i:j].tolist() for i, j in zip(at, at[1:], strict=False)]

    def decoded(self, ids: list[int]) -> bytes:
        """The text of ids in UTF-8, or what bytes they stand for."""
        front = b""
        if self.model.dummy_prefix or self.model.trim:  # the first piece loses a mark; where spaces are trimmed, so does each until there is text
            for k, x in enumerate(ids):
                front = self.bytes[x][1:] if self.model.pieces[x][0][:1] == SPACE else self.bytes[x]
                if front or not self.model.trim and self.bytes[x]:
                    return front + b"".join(map(self.bytes.__getitem__, ids[k + 1:]))
            return front
        return b"".join(map(self.bytes.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD."""
        return self.decoded(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


@lru_cache(maxsize=2)
def original(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


def encode_documents(docs: DataFrame, path: str, verify: bool = True, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, round_trip (decoding gives the text again), parity (the original library agrees on the whole text; null unverified), ids.

    One row a row of ``docs``, repeated ones too; a null text counts as empty and has no ids, an empty table gives no row.
    Nothing is shuffled.
    """
    on_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for batch in batches:
            for start, n in slices(batch.column(1)):
                part = batch.slice(start, n)
                texts = [t or "" for t in part.column(1).to_pylist()]
                gc.disable()  # many short-lived lists, none in cycles
                flat, at = p.encode_array(part.column(1))
                ids = [flat[i:j].tolist() for i, j in zip(at, at[1:], strict=False)]
                parity = [x == y for x, y in zip(original(path).encode(texts, num_threads=THREADS), ids, strict=True)] if verify else [None] * len(ids)
                whole = [p.decoded(x) == t.encode("utf-8", "surrogatepass") for x, t in zip(ids, texts, strict=True)]
                gc.enable()
                data, bounds = memoryview(flat.astype("<u4").tobytes()), (4 * at).tolist()
                out = {
                    "doc_id": part.column(0), "n_tokens": pa.array(np.diff(at)), "ids_crc32": pa.array([zlib.crc32(data[i:j]) for i, j in zip(bounds, bounds[1:], strict=False)], pa.int64()),
                    "round_trip": pa.array(whole, pa.bool_()), "parity": pa.array(parity, pa.bool_()),
                }
                if with_ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat.view(np.int32)))
                yield pa.record_batch(out)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(run), "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean, parity boolean" + ", ids array<int>" * with_ids)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids), row by row; null ids count as none."""
    on_workers(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for batch in batches:
            yield pa.record_batch({"doc_id": batch.column(0), "text": pa.array([p.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(trimmed(run), "doc_id long, text string")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``, encoded, decoded, and held against the original library."""
    return encode_documents(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)

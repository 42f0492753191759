"""Encoding of whole texts with the tokenizers library, each distinct piece of text once.

A text is cut only where its encoding falls apart into the encodings of its parts. For a word-level pre-tokeniser that
drops white space, that is at spaces and line feeds; for a byte-level one (which glues one space to the next word),
before single spaces and line feeds between other characters. Arrow finds a batch's distinct parts, a bounded table
holds the ids of parts seen before, the library encodes the others, and numpy puts the ids of all texts together.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Parts that the table of a worker process keeps; later ones are encoded in each batch that has them.
CACHE_ENTRIES = 500_000
#: Longer parts are not kept.
CACHE_CHARS = 64
#: Parts handed to the library at once.
BATCH = 4096
#: Bytes of text put together at once; a longer text goes alone.
BATCH_BYTES = 4_000_000

#: Marks that may end a word of the short way, and the end of the letters it takes.
MARKS = ".,;:!?"
LATIN_END = "ɐ"
#: Stands before a text's first part; texts that have it are not cut.
HEAD = "\r"
#: How byte-level vocabularies write bytes: printable ones as themselves, the others from U+0100 on.
_printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LEVEL = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in _printable)}

#: Texts with other white space than single spaces and line feeds between other characters.
ODD_SPACE = r"[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|  | \n|\n |\n\n|\A[ \n]|[ \n]\z"


def _latin(word: str) -> bool:
    """Whether ``word`` is letters before LATIN_END only, one at least."""
    return word.isalpha() and (word.isascii() or max(word) < LATIN_END)


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Stretches (start, length) of texts with about BATCH_BYTES bytes, one text at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, before = 0, 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, before + BATCH_BYTES, side="right")))
        yield start, stop - start
        start, before = stop, int(ends[stop - 1])


def strings(values: pa.Array) -> list[str]:
    """A string array without spaces as a list; splitting one long string is far faster than boxing values."""
    if not len(values):
        return []
    whole = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    return pc.binary_join(whole, " ")[0].as_py().split(" ")


class PartTable:
    """Ids of parts, kept for the first CACHE_ENTRIES; ``encode`` gives the ids of a list of parts."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]]):
        self.encode = encode
        self.place: dict[str, int] = {}
        self.starts, self.sizes, self.flat = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32)
        self.n = self.used = 0

    def at(self, place: int) -> list[int]:
        start = self.starts[place]
        return self.flat[start:start + self.sizes[place]].tolist()

    def known(self, part: str) -> list[int] | None:
        place = self.place.get(part)
        return None if place is None else self.at(place)

    def add(self, ids: list[list[int]]) -> int:
        """Puts ids behind those held already; returns the first's place."""
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        total, first = int(sizes.sum()), self.n
        while self.n + len(ids) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.starts[first:first + len(ids)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[first:first + len(ids)] = sizes
        self.flat[self.used:self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        self.n, self.used = first + len(ids), self.used + total
        return first

    def places(self, parts: list[str]) -> np.ndarray:
        """The place of each (distinct) part; those of parts that the table doesn't keep hold until ``forget``."""
        found = np.fromiter(map(self.place.get, parts, repeat(-1)), np.int64, len(parts))
        new = np.flatnonzero(found < 0).tolist()
        short = [k for k in new if len(parts[k]) <= CACHE_CHARS][:max(0, CACHE_ENTRIES - len(self.place))]
        kept = set(short)
        order = short + [k for k in new if k not in kept]
        first = self.add(self.encode([parts[k] for k in order]))
        found[order] = np.arange(first, first + len(order))
        self.place.update(zip([parts[k] for k in short], range(first, first + len(short)), strict=True))
        return found

    def forget(self) -> None:
        self.n = len(self.place)
        self.used = int(self.starts[self.n - 1] + self.sizes[self.n - 1]) if self.n else 0

    def gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids at all places one after another, and where each place's begin (one more at the end)."""
        sizes = self.sizes[places]
        at = np.zeros(len(places) + 1, np.int64)
        np.cumsum(sizes, out=at[1:])
        index = np.repeat(self.starts[places] - at[:-1], sizes)
        index += np.arange(len(index))
        return self.flat[index], at

    def join(self, lists: pa.Array, plain: np.ndarray, others: list[list[int]], end: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts one after another, and where each begins: ``lists`` has the parts of texts where ``plain`` holds, ``others`` the ids of the rest; ``end`` follows each text."""
        coded = lists.flatten().dictionary_encode()
        places = self.places(strings(coded.dictionary))[coded.indices.to_numpy(zero_copy_only=False)]
        rest = self.add([*others, end])
        counts = np.ones(len(plain), np.int64)
        counts[plain] = lists.value_lengths().to_numpy(zero_copy_only=False)
        firsts = np.zeros(len(plain) + 1, np.int64)
        np.cumsum(counts + 1, out=firsts[1:])
        every = np.full(firsts[-1], rest + len(others), np.int64)
        own = np.repeat(plain, counts + 1)
        own[firsts[1:] - 1] = False
        every[own] = places
        every[firsts[:-1][~plain]] = rest + np.arange(len(others))
        ids, at = self.gather(every)
        self.forget()
        return ids, at[firsts]


class PartEncoder:
    """Encodes texts with a tokenizer file; the same ids as encoding each text in one piece, whatever came before."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        pre = self.tokenizer.pre_tokenizer.__getstate__().decode() if self.tokenizer.pre_tokenizer is not None else ""
        self.drops_space = '"Removed"' in pre
        self.glues_space = not self.drops_space and '"ByteLevel"' in pre and '"add_prefix_space":false' in pre and '"use_regex":true' in pre
        self.model = self.tokenizer.model
        self.lead = "Ġ" if self.glues_space else ""
        self.table = PartTable(self._new)
        self.marks = dict(zip(["", *MARKS, "\n"], [[], *self._ids([*MARKS, "\n"])], strict=True))

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for i in range(0, len(texts), BATCH) for e in self.tokenizer.encode_batch_fast(texts[i:i + BATCH], add_special_tokens=False)]

    def _plain(self, part: str) -> list[int] | None:
        """Ids of a part that is one run of Latin letters, with a mark after it or not; None for any other part.

        Such a run is one word to both pre-tokenisers and stays as it is under NFC, so the library's model takes it as it is.
        A run that is known without its mark (and in lower case, where case doesn't matter) isn't encoded again. Before a
        mark nothing but letters may stand: marks and symbols in a row are one word to the pre-tokenisers.
        """
        tail = part[-1] if part[-1] in MARKS else ""
        word = part[:-1] if tail else part
        lead, before = self.lead, ""
        if lead and word[:1] in ("\n", HEAD):
            word, lead, before = word[1:], "", word[0]
        if not _latin(word):
            return None
        if self.drops_space:
            word = word.lower()
            if not _latin(word):
                return None
        ids = None if before else self.table.known(word)
        if ids is None:
            core = word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_LEVEL)
            ids = [t.id for t in self.model.tokenize(lead + core)]
            if before == "\n":
                ids = self.marks[before] + ids
        return ids + self.marks[tail] if tail else ids

    def _new(self, parts: list[str]) -> list[list[int]]:
        """Ids of parts; as for words of a byte-level vocabulary, a part stands for a space and itself unless it begins with a line feed or HEAD."""
        out = [self._plain(p) if p else [] for p in parts]
        hard = [k for k, ids in enumerate(out) if ids is None]
        texts = [parts[k] for k in hard]
        if self.glues_space:
            texts = [p if p[0] == "\n" else p[1:] if p[0] == HEAD else " " + p for p in texts]
        for k, ids in zip(hard, self._ids(texts), strict=True):
            out[k] = ids
        return out

    def encode_array(self, texts: pa.Array, end: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another (null counts as empty), ``end`` after each, and where each begins."""
        texts = pc.fill_null(texts, "")
        plain = np.full(len(texts), self.drops_space)
        if self.glues_space:
            plain = ~pc.match_substring_regex(texts, ODD_SPACE).to_numpy(zero_copy_only=False)
        collecting = gc.isenabled()
        gc.disable()  # many short-lived objects, none in cycles
        try:
            cut = texts.filter(pa.array(plain))
            cut = pc.replace_substring(cut, "\n", " ") if self.drops_space else pc.binary_join_element_wise(HEAD, pc.replace_substring(cut, "\n", " \n"), "")
            others = self._ids(texts.filter(pa.array(~plain)).to_pylist())
            return self.table.join(pc.split_pattern(cut, " "), plain, others, end)
        finally:
            if collecting:
                gc.enable()

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text."""
        ids, at = self.encode_array(pa.array(texts, pa.string()), [])
        return [ids[i:j].tolist() for i, j in zip(at, at[1:], strict=False)]


@lru_cache(maxsize=4)
def encoder(path: str) -> PartEncoder:
    """One encoder for each worker process and file."""
    return PartEncoder(path)

"""Vectorised text kernels shared by the operators of this subpackage.

All of them work on the UTF-8 buffers of Arrow string columns, a bounded
slice at a time, so that neither a large batch nor one very long text makes
temporaries that grow with it beyond a few bytes a word.
"""

from __future__ import annotations

import sys
from array import array
from types import ModuleType

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

U64 = np.uint64
#: Bytes of text that are hashed at a time: what goes with them then fits a core's cache, and a worker's memory stays small.
SLICE = 1 << 18
#: Words of more bytes are hashed by xxh3: over so few, no two words cancel out in the polynomial as long ones can that repeat a pattern.
SHORT = 48


def _splitmix(n: int, seed: int) -> np.ndarray:
    """n odd pseudo-random 64-bit numbers, the same on every machine."""
    with np.errstate(over="ignore"):
        z = (np.arange(1, n + 1, dtype=U64) + U64(seed)) * U64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> U64(27))) * U64(0x94D049BB133111EB)
        return (z ^ (z >> U64(31))) | U64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that low and high bits are alike."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


def byte_class(kind: str) -> np.ndarray:
    """256 booleans: the bytes that belong to words.

    space: whatever isn't white space (0x20, 0x09-0x0D); alnum: digits,
    letters and every byte of a character beyond ASCII; line: whatever
    isn't a line feed, so that lines are its words.
    """
    table = np.ones(256, dtype=bool)
    if kind == "space":
        table[[0x20, *range(0x09, 0x0E)]] = False
    elif kind == "line":
        table[0x0A] = False
    elif kind == "alnum":
        table[:0x80] = False
        for a, b in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
            table[a : b + 1] = True
    else:
        raise ValueError(kind)
    return table


class Hasher:
    """Words of texts and their 64-bit hashes, without a loop over words of up to SHORT bytes."""

    def __init__(self, kind: str, lower: bool, seed: int = 7):
        self.word = byte_class(kind)
        self.value = _splitmix(256, seed)
        self.lower, self.seed = lower, seed
        self.lowered = np.arange(256, dtype=np.uint8)
        if lower:
            self.value[0x41:0x5B] = self.value[0x61:0x7B]
            self.lowered[0x41:0x5B] = self.lowered[0x61:0x7B]
        self.power = self.inverse = np.ones(0, dtype=U64)
        self.base = int(_splitmix(1, seed + 1)[0])

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            size = max(n, SLICE + 1)
            a = np.full(size, self.base, dtype=U64)
            a[0] = 1
            self.power = np.cumprod(a, dtype=U64)
            a[1:] = pow(self.base, -1, 1 << 64)
            self.inverse = np.cumprod(a, dtype=U64)

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, hashes, first word of each text and the count at last); offsets are those of the texts in data."""
        lo, hi = int(offsets[0]), int(offsets[-1])
        starts, ends, hashes = [], [], []
        at = lo
        edges = offsets[1:-1]
        while at < hi:
            to = min(hi, at + SLICE)
            if to < hi:  # a word or a text is cut nowhere
                k = np.searchsorted(offsets, to, "right") - 1
                if offsets[k] > at:
                    to = int(offsets[k])
                else:
                    gap = np.flatnonzero(~self.word[data[at:to]])
                    while not len(gap) and to < hi:
                        to = min(int(offsets[k + 1]), to + SLICE)
                        gap = np.flatnonzero(~self.word[data[at:to]]) if to < offsets[k + 1] else np.array([to - at - 1])
                    to = at + int(gap[-1]) + 1 if len(gap) else to
            part = data[at:to]
            flag = np.zeros(to - at + 2, dtype=bool)
            flag[1:-1] = self.word[part]
            first, last = flag[1:] & ~flag[:-1], flag[:-1] & ~flag[1:]
            cut = edges[np.searchsorted(edges, at, "right") : np.searchsorted(edges, to, "left")] - at
            cut = cut[flag[cut] & flag[cut + 1]]  # words that touch at the end of a text
            first[cut] = True
            last[cut] = True
            s, e = np.flatnonzero(first[:-1]), np.flatnonzero(last)
            if len(s):
                self._powers(to - at + 1)
                total = np.zeros(to - at + 1, dtype=U64)
                np.cumsum(self.value[part] * self.power[: to - at], out=total[1:])
                h = mix((total[e] - total[s]) * self.inverse[s] + (e - s).astype(U64) * U64(0x9E3779B97F4A7C15))
                if len(long := np.flatnonzero(e - s > SHORT)):
                    raw = (self.lowered[part] if self.lower else part).tobytes()
                    h[long] = [xxhash.xxh3_64_intdigest(raw[a:z], self.seed) for a, z in zip(s[long].tolist(), e[long].tolist(), strict=True)]
                hashes.append(h)
                starts.append(s + at)
                ends.append(e + at)
            at = to
        none = np.zeros(0, dtype=np.int64)
        s = np.concatenate(starts) if starts else none
        e = np.concatenate(ends) if ends else none
        h = np.concatenate(hashes) if hashes else np.zeros(0, dtype=U64)
        return s, e, h, np.searchsorted(s, offsets, "left")


def column(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of the texts) of a string or binary column; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    large = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    if not len(array):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64 if large else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = array.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8), offsets


def spans(offsets: np.ndarray, limit: int = 4 * SLICE):
    """Runs of texts, each run of limit bytes at most unless it is one text."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to
        at = to


def text_of_words(first: np.ndarray) -> np.ndarray:
    """For each word the number of its text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def grams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of all runs of n words that lie in one text, the number of that text, the number of the first word)."""
    if len(h) < n:
        return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    factor = _splitmix(n, 1000 + n)
    count = len(h) - n + 1
    g = np.zeros(count, dtype=U64)
    for j in range(n):
        g += h[j : j + count] * factor[j]
    text = text_of_words(first)
    at = np.flatnonzero(text[:count] == text[n - 1 :])
    return mix(g[at]), text[at], at


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[i] .. starts[i] + lengths[i] - 1 for all i, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def per_text(flags: np.ndarray, offsets: np.ndarray, base: int = 0) -> np.ndarray:
    """How many flags are set between each two offsets, which count from base."""
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[offsets - base])


def repeated(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Whether the text of h[i] has that hash more than once; the first counts as well."""
    key = h ^ mix(text.astype(U64) + U64(1))
    order = np.argsort(key)
    key = key[order]
    same = key[1:] == key[:-1]
    out = np.zeros(len(h), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def earlier(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Whether the text of h[i] has had that hash before."""
    key = h ^ mix(text.astype(U64) + U64(1))
    order = np.argsort(key, kind="stable")
    key = key[order]
    out = np.zeros(len(h), dtype=bool)
    out[order[1:][key[1:] == key[:-1]]] = True
    return out


class Memo:
    """Ids of what was solved before, by hash: at most limit solutions, then it starts anew. Sorted arrays take a tenth of a dict's memory."""

    def __init__(self, limit: int):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.keys, self.place = np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
        self.data, self.first, self.scores = bytearray(), array("q", [0]), array("q")

    def places(self, distinct: np.ndarray, solve) -> np.ndarray:
        """Numbers of the solutions of distinct, sorted hashes; solve(i) gives (ids as packed 32-bit numbers, score) of the i-th."""
        at = np.searchsorted(self.keys, distinct)
        new = np.ones(len(distinct), dtype=bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != distinct[inside]
        new = np.flatnonzero(new)
        if len(new):
            if len(self.keys) and len(self.keys) + len(new) > self.limit:
                self.clear()
                return self.places(distinct, solve)
            number = len(self.scores)
            for i in new.tolist():
                ids, score = solve(i)
                self.data += ids
                self.first.append(len(self.data) // 4)
                self.scores.append(score)
            self.keys = np.insert(self.keys, at[new], distinct[new])
            self.place = np.insert(self.place, at[new], np.arange(number, number + len(new)))
            at = np.searchsorted(self.keys, distinct)
        return self.place[at]

    def gather(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the solutions, one after the other, number of ids of each)."""
        first = np.array(self.first)
        size = first[place + 1] - first[place]
        return np.array(np.frombuffer(self.data, dtype=np.uint32))[ragged(first[place], size)], size


def per_worker(key: tuple, make):
    """What make() returned first in this Python process, which runs many tasks."""
    held = sys.modules.setdefault("_tallyloom_worker", ModuleType("_tallyloom_worker")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]

"""Vectorised hashing of the words of many texts (numpy, used inside tasks).

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D.  All of these are
ASCII, so splitting the UTF-8 bytes and splitting the characters agree.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

U64 = np.uint64
_SLICE = 1 << 17
_BYTE_BASE = 0x9E3779B97F4A7C15
#: Odd multipliers of the two polynomial hashes over words.
WINDOW_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser that spreads every input bit over all 64 bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def word_spans(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word; ``buffer`` holds UTF-8 bytes."""
    space = _SPACE[buffer]
    edge = np.empty(len(buffer) + 1, dtype=bool)
    if not len(buffer):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    edge[0] = ~space[0]
    edge[-1] = ~space[-1]
    np.not_equal(space[1:], space[:-1], out=edge[1:-1])
    at = np.flatnonzero(edge)
    return at[0::2], at[1::2]


def span_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), dtype=U64)
    inverse = pow(_BYTE_BASE, -1, 1 << 64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            low = starts[at]
            stop = max(at + 1, int(np.searchsorted(ends, low + _SLICE, side="right")))
            size = int(ends[stop - 1] - low)
            room = max(_SLICE, 1 << (size - 1).bit_length())
            terms = (buffer[low:low + size].astype(U64) + U64(1)) * _powers(_BYTE_BASE, room)[:size]
            total = np.zeros(size + 1, dtype=U64)
            np.cumsum(terms, out=total[1:])
            a, b = starts[at:stop] - low, ends[at:stop] - low
            value = (total[b] - total[a]) * _powers(inverse, room)[a]
            out[at:stop] = mix(value + (b - a).astype(U64) * U64(0xFF51AFD7ED558CCD))
            at = stop
    return out


def encode_text(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


class Words:
    """The words of a batch of texts: byte spans, hashes and the first word of each text."""

    def __init__(self, texts: Sequence[str | None]):
        encoded = [encode_text(t) for t in texts]
        sizes = np.fromiter((len(e) + 1 for e in encoded), dtype=np.int64, count=len(encoded))
        self.data = b"\n".join(encoded) + b"\n" if encoded else b""
        self.buffer = np.frombuffer(self.data, dtype=np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.starts, self.ends = word_spans(self.buffer)
        #: words[first[i]:first[i + 1]] belong to text i
        self.first = np.searchsorted(self.starts, self.offsets)
        self.hashes = span_hashes(self.buffer, self.starts, self.ends)

    def __len__(self) -> int:
        return len(self.starts)

    def words_of(self, i: int) -> list[bytes]:
        return self.data[self.offsets[i]:self.offsets[i + 1] - 1].split()

    def windows(self, width: int, base: int = WINDOW_BASES[0]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, text index, start word) of every window of ``width`` words inside one text."""
        counts = np.diff(self.first)
        per_text = np.maximum(counts - width + 1, 0)
        owner = np.repeat(np.arange(len(counts)), per_text)
        shift = self.first[:-1] - np.concatenate([[0], np.cumsum(per_text)])[:-1]
        at = np.arange(int(per_text.sum())) + np.repeat(shift, per_text)
        return rolling(self.hashes, width, base)[at], owner, at - self.first[owner]


def rolling(hashes: np.ndarray, width: int, base: int) -> np.ndarray:
    """Rabin-Karp polynomial modulo 2**64 of every run of ``width`` hashes, mixed."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    total = np.zeros(n, dtype=U64)
    with np.errstate(over="ignore"):
        for k in range(width):
            total *= U64(base)
            np.add(total, hashes[k:k + n], out=total)
    return mix(total)


def text_batches(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Cut record batches so that each holds about ``size`` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        lengths = texts.cast(pa.large_string()) if pa.types.is_string(texts.type) else texts
        sizes = np.asarray(pc.fill_null(pc.binary_length(lengths), 0), dtype=np.int64)
        group = np.cumsum(sizes) // max(1, size)
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            part = batch.slice(a, b - a)
            yield part, part.column(part.schema.get_field_index(column)).to_pylist()


def pack_arrays(*arrays: np.ndarray, level: int = 3) -> bytes:
    """Arrays as one blob; each is compressed where that makes it smaller."""
    out = []
    for a in arrays:
        raw = np.ascontiguousarray(a).tobytes()
        small = zstandard.compress(raw, level) if len(raw) > 64 else raw
        used = small if len(small) < len(raw) else raw
        code = a.dtype.str.encode().ljust(4)
        out += [struct.pack("<4sQQ", code, len(a), len(used)), used]
    return b"".join(out)


def unpack_arrays(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        code, n, size = struct.unpack_from("<4sQQ", blob, at)
        at += 20
        dtype = np.dtype(code.decode().strip())
        raw = blob[at:at + size]
        if size < n * dtype.itemsize:
            raw = zstandard.decompress(raw, max_output_size=n * dtype.itemsize)
        out.append(np.frombuffer(raw, dtype=dtype))
        at += size
    return out


def first_of_equal(keys: np.ndarray, *order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For values that occur twice or more: (index, index of the smallest by ``order``) per occurrence."""
    by = np.argsort(keys, kind="stable")
    ordered = keys[by]
    same = ordered[1:] == ordered[:-1]
    del ordered
    inside = np.zeros(len(keys), dtype=bool)
    inside[1:] |= same
    inside[:-1] |= same
    picked = by[inside]
    if not len(picked):
        return picked, picked
    picked = picked[np.lexsort([*(o[picked] for o in reversed(order)), keys[picked]])]
    head = np.ones(len(picked), dtype=bool)
    head[1:] = keys[picked][1:] != keys[picked][:-1]
    return picked, picked[head][np.cumsum(head) - 1]

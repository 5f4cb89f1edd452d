"""Blosc 1 frames: the default chunk codec of zarr arrays.

A frame has a header of 16 bytes, the offsets of its blocks, and per block one
compressed stream, or one for each byte of an element.  Elements of a block may
be stored byte by byte (or bit by bit) across the block.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa

# Fixed values of the format: flag bits, compressor numbers, and the limits below which a block is not split.
BYTE_SHUFFLE, PLAIN, BIT_SHUFFLE, WHOLE = 1, 2, 4, 16
LZ4, SNAPPY, ZLIB, ZSTD = 1, 2, 3, 4
LARGEST_SPLIT, LEAST_STREAM = 16, 128


def _inflate(kind: int, data: bytes, size: int) -> bytes:
    if kind == ZLIB:
        return zlib.decompress(data)
    name = {LZ4: "lz4_raw", SNAPPY: "snappy", ZSTD: "zstd"}.get(kind)
    if name is None:
        raise ValueError(f"Blosc compressor {kind} is not supported")
    return pa.Codec(name).decompress(data, size).to_pybytes()


def _ordered(block: bytes, width: int, flags: int) -> bytes:
    """Elements of ``width`` bytes from a shuffled block; bytes beyond the last whole element stand as they are."""
    if flags & BYTE_SHUFFLE and width > 1:
        count = len(block) // width
        lanes = np.frombuffer(block, np.uint8, count * width).reshape(width, count)
        return lanes.T.tobytes() + block[count * width:]
    if flags & BIT_SHUFFLE:
        count = len(block) // width // 8 * 8
        lanes = np.frombuffer(block, np.uint8, count * width).reshape(width * 8, count // 8)
        bits = np.unpackbits(lanes, axis=1, bitorder="little")
        return np.packbits(bits.T, axis=1, bitorder="little").tobytes() + block[count * width:]
    return block


def decode(frame: bytes) -> bytes:
    _, _, flags, width, size, block, length = struct.unpack_from("<4B3I", frame)
    if length > len(frame):
        raise ValueError("a Blosc frame is cut off")
    if flags & PLAIN:
        return frame[16:16 + size]
    starts = struct.unpack_from(f"<{-(-size // block)}I", frame, 16) if size else ()
    out = []
    for k, at in enumerate(starts):
        here = min(block, size - k * block)
        split = (not flags & WHOLE and here == block and width <= LARGEST_SPLIT and block // width >= LEAST_STREAM)
        streams = width if split else 1
        parts = []
        for _ in range(streams):
            packed = struct.unpack_from("<i", frame, at)[0]
            data = frame[at + 4:at + 4 + packed]
            parts.append(data if packed == here // streams else _inflate(flags >> 5, data, here // streams))
            at += 4 + packed
        out.append(_ordered(b"".join(parts), width, flags))
    return b"".join(out)

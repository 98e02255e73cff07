"""Decoding of Blosc frames, the default codec of zarr v2 chunks.

A frame has a header of 16 bytes, a table of block starts and, in each block, one compressed stream or one for each byte
of an element. Blocks are shuffled by bytes or bits before compression.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa

# --- fixed values of the format ---
BYTE_SHUFFLE, STORED, BIT_SHUFFLE, WHOLE_BLOCKS = 0x01, 0x02, 0x04, 0x10
CODECS = {0: "blosclz", 1: "lz4", 2: "snappy", 3: "zlib", 4: "zstd"}
#: Blocks are split by bytes of an element only up to this element size, and with so many elements.
MOST_SPLITS, LEAST_SPLIT = 16, 128


def _stream(codec: str, data: bytes, size: int) -> bytes:
    if len(data) == size:  # incompressible streams are stored
        return data
    if codec == "zlib":
        return zlib.decompress(data)
    if codec in ("lz4", "snappy", "zstd"):
        return pa.Codec("lz4_raw" if codec == "lz4" else codec).decompress(data, size).to_pybytes()
    raise ValueError(f"blosc codec {codec} can't be read")


def _by_bytes(block: np.ndarray, size: int) -> np.ndarray:
    n = len(block) // size
    return np.concatenate([block[: n * size].reshape(size, n).T.ravel(), block[n * size :]])


def _by_bits(block: np.ndarray, size: int) -> np.ndarray:
    n = len(block) // size
    if n % 8:  # such blocks aren't shuffled
        return block
    bits = np.unpackbits(block[: n * size].reshape(size * 8, n // 8), axis=1, bitorder="little")
    return np.concatenate([np.packbits(bits.T, axis=1, bitorder="little").ravel(), block[n * size :]])


def decode_blosc(data: bytes) -> bytes:
    """The bytes of a frame. Codecs lz4, lz4hc, snappy, zlib and zstd; others, and frames that are cut off, are an error."""
    if len(data) < 16:
        raise ValueError("blosc frame without a header")
    _, _, flags, size, total, block, held = struct.unpack("<BBBBIII", data[:16])
    if held > len(data):
        raise ValueError(f"blosc frame of {held} bytes has {len(data)}")
    if flags & STORED:
        return data[16 : 16 + total]
    codec, out = CODECS.get(flags >> 5, str(flags >> 5)), []
    count = -(-total // block) if total else 0
    for i, at in enumerate(struct.unpack(f"<{count}i", data[16 : 16 + 4 * count])):
        length = min(block, total - i * block)
        split = not flags & WHOLE_BLOCKS and length == block and size <= MOST_SPLITS and block // size >= LEAST_SPLIT
        parts = []
        for _ in range(size if split else 1):
            n = struct.unpack_from("<i", data, at)[0]
            parts.append(_stream(codec, data[at + 4 : at + 4 + n], length // size if split else length))
            at += 4 + n
        got = np.frombuffer(b"".join(parts), np.uint8)
        if len(got) != length:
            raise ValueError(f"blosc block {i} has {len(got)} of {length} bytes")
        if size > 1 and flags & BYTE_SHUFFLE:
            got = _by_bytes(got, size)
        elif flags & BIT_SHUFFLE:
            got = _by_bits(got, size)
        out.append(got.tobytes())
    return b"".join(out)

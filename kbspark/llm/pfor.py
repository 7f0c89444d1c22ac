"""Patched frame of reference: blocks of ids, each less its minimum, packed at a width that fits most.

A segment is the byte string of many documents' ids. Layout, little endian:

    magic u32 | documents u32 | ids u64 | blocks u32 | exceptions u32
    document ids i64[documents] | document lengths u32[documents]
    block starts u64[blocks]          byte offset of each block's packed values
    block minimum u32[blocks] | block width u8[blocks] | exceptions of each block u16[blocks]
    exception place u16[exceptions] | exception value u32[exceptions]   (value: id less the block minimum)
    packed values

Blocks hold BLOCK ids, the last one fewer (padded with its minimum). The width of a block is that of its
`percentile`-th value; values that need more bits keep their low bits packed and stand whole in the
exception list.
"""

from __future__ import annotations

import numpy as np

MAGIC = 0x524F4650
BLOCK = 128
PERCENTILE = 90


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs (0 for 0)."""
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.uint8)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values to rows of bytes."""
    if width == 0:
        return np.zeros((len(values), 0), np.uint8)
    planes = [(values >> np.uint32(k) & np.uint32(1)).astype(np.uint8) for k in range(width)]
    return np.packbits(np.stack(planes, axis=1), axis=2).reshape(len(values), -1)


def _unpack(rows: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(rows), BLOCK), np.uint32)
    if width:
        planes = np.unpackbits(rows.reshape(len(rows), width, BLOCK // 8), axis=2)
        for k in range(width):
            out |= planes[:, k].astype(np.uint32) << np.uint32(k)
    return out


def encode(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A segment of the documents' ids, which stand one after another in `ids` (unsigned 32-bit)."""
    ids = np.asarray(ids, np.uint32)
    n = len(ids)
    blocks = -(-n // BLOCK)
    padded = np.empty(blocks * BLOCK, np.uint32)
    padded[:n] = ids
    if n < len(padded):
        padded[n:] = ids[(blocks - 1) * BLOCK :].min()
    rows = padded.reshape(blocks, BLOCK)
    low = rows.min(axis=1) if blocks else np.zeros(0, np.uint32)
    rows = rows - low[:, None]
    at = min(BLOCK - 1, -(-BLOCK * PERCENTILE // 100) - 1)
    width = _bits(np.partition(rows, at, axis=1)[:, at]) if blocks else np.zeros(0, np.uint8)
    size = width.astype(np.uint64) * np.uint64(BLOCK // 8)
    starts = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.uint64) if blocks else np.zeros(0, np.uint64)
    packed = np.zeros(int(size.sum()), np.uint8)
    for w in np.unique(width):
        if w:
            of = np.flatnonzero(width == w)
            packed[(starts[of].astype(np.int64)[:, None] + np.arange(int(w) * BLOCK // 8)).ravel()] = _pack(rows[of], int(w)).ravel()
    limit = (np.uint64(1) << width.astype(np.uint64))[:, None]
    block, place = np.nonzero(rows.astype(np.uint64) >= limit) if blocks else (np.zeros(0, int), np.zeros(0, int))
    return b"".join([
        np.array([MAGIC, len(doc_ids)], "<u4").tobytes(), np.array([n], "<u8").tobytes(), np.array([blocks, len(block)], "<u4").tobytes(),
        np.asarray(doc_ids, "<i8").tobytes(), np.asarray(lengths, "<u4").tobytes(), starts.astype("<u8").tobytes(),
        low.astype("<u4").tobytes(), width.tobytes(), np.bincount(block, minlength=blocks).astype("<u2").tobytes(),
        place.astype("<u2").tobytes(), rows[block, place].astype("<u4").tobytes(), packed.tobytes(),
    ])


def _parts(data: bytes):
    head = np.frombuffer(data, "<u4", 2)
    if head[0] != MAGIC:
        raise ValueError("not a segment of packed ids")
    docs, n = int(head[1]), int(np.frombuffer(data, "<u8", 1, 8)[0])
    blocks, odd = map(int, np.frombuffer(data, "<u4", 2, 16))
    at, out = 24, []
    for kind, count in (("<i8", docs), ("<u4", docs), ("<u8", blocks), ("<u4", blocks), ("u1", blocks), ("<u2", blocks), ("<u2", odd), ("<u4", odd)):
        out.append(np.frombuffer(data, kind, count, at))
        at += out[-1].nbytes
    return n, out, np.frombuffer(data, np.uint8, offset=at)


def decode(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, lengths and all ids of a segment."""
    n, (doc_ids, lengths, starts, low, width, count, place, value), packed = _parts(data)
    rows = np.zeros((len(low), BLOCK), np.uint32)
    for w in np.unique(width):
        if w:
            of = np.flatnonzero(width == w)
            rows[of] = _unpack(packed[starts[of].astype(np.int64)[:, None] + np.arange(int(w) * BLOCK // 8)], int(w))
    rows[np.repeat(np.arange(len(low)), count), place] = value
    return doc_ids, lengths, (rows + low[:, None]).ravel()[:n]


def block(data: bytes, k: int) -> np.ndarray:
    """The ids of block k alone, found by its indexed start."""
    n, (_, _, starts, low, width, count, place, value), packed = _parts(data)
    size = int(width[k]) * BLOCK // 8
    row = _unpack(packed[int(starts[k]) : int(starts[k]) + size][None], int(width[k]))[0]
    first = int(count[:k].sum(dtype=np.int64))
    of = slice(first, first + int(count[k]))
    row[place[of]] = value[of]
    return (row + low[k])[: n - k * BLOCK]

"""BLAKE3 in numpy, for many inputs of one length at once.

Written from the published specification.  A block of inputs is hashed chunk by
chunk in parallel over rows and chunks; chaining values are then merged level by
level, an odd one rising to the next level, which gives the specified tree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the algorithm.
IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], np.uint32)
ORDER = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
MIXES = [(0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14)]


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def _compress(cv: np.ndarray, words: np.ndarray, counter: np.ndarray, length: int, flags: int) -> np.ndarray:
    """Chaining values (n, 8) from chaining values, blocks (n, 16), counters (n)."""
    n = len(words)
    state = [cv[:, i].copy() for i in range(8)] + [np.full(n, v, np.uint32) for v in IV[:4]]
    state += [counter.astype(np.uint32), (counter >> np.uint64(32)).astype(np.uint32), np.full(n, length, np.uint32), np.full(n, flags, np.uint32)]
    m = [words[:, i] for i in range(16)]
    for turn in range(7):
        for k, (a, b, c, d) in enumerate(MIXES):
            for part, (far, near) in enumerate(((16, 12), (8, 7))):
                state[a] = state[a] + state[b] + m[2 * k + part]
                state[d] = _turn(state[d] ^ state[a], far)
                state[c] = state[c] + state[d]
                state[b] = _turn(state[b] ^ state[c], near)
        if turn < 6:
            m = [m[i] for i in ORDER]
    return np.stack([state[i] ^ state[i + 8] for i in range(8)], axis=1)


def _chunks(data: np.ndarray, counter: np.ndarray, root: bool) -> np.ndarray:
    """Chaining values of chunks (n, bytes) of one length, 1024 bytes at most."""
    n, size = data.shape
    cv = np.broadcast_to(IV, (n, 8)).copy()
    blocks = max(1, -(-size // 64))
    padded = np.zeros((n, blocks * 64), np.uint8)
    padded[:, :size] = data
    words = padded.view("<u4").reshape(n, blocks, 16)
    for i in range(blocks):
        last = i == blocks - 1
        flags = CHUNK_START * (i == 0) | CHUNK_END * last | ROOT * (last and root)
        cv = _compress(cv, words[:, i], counter, size - 64 * i if last else 64, flags)
    return cv


def blake3_rows(data: np.ndarray) -> np.ndarray:
    """Digests (rows, 32) of data (rows, bytes)."""
    rows, size = data.shape
    whole, rest = divmod(size, 1024)
    if size <= 1024:
        return _chunks(data, np.zeros(rows, np.uint64), True).astype("<u4").view(np.uint8).reshape(rows, 32)
    cvs = []
    if whole:
        own = np.ascontiguousarray(data[:, : whole * 1024]).reshape(rows * whole, 1024)
        cvs.append(_chunks(own, np.tile(np.arange(whole, dtype=np.uint64), rows), False).reshape(rows, whole, 8))
    if rest:
        cvs.append(_chunks(np.ascontiguousarray(data[:, whole * 1024 :]), np.full(rows, whole, np.uint64), False)[:, None])
    level = np.concatenate(cvs, axis=1)
    while level.shape[1] > 1:
        pairs = level.shape[1] // 2
        flags = PARENT | ROOT * (level.shape[1] == 2)
        words = level[:, : 2 * pairs].reshape(rows * pairs, 16)
        up = _compress(np.broadcast_to(IV, (rows * pairs, 8)), words, np.zeros(rows * pairs, np.uint64), 64, flags).reshape(rows, pairs, 8)
        level = np.concatenate([up, level[:, 2 * pairs :]], axis=1)
    return np.ascontiguousarray(level[:, 0]).astype("<u4").view(np.uint8).reshape(rows, 32)


def blake3_many(items: list[bytes], most: int = 8 << 20) -> list[bytes]:
    """Digests of byte strings; those of one length are hashed together, ``most`` bytes at a time."""
    out: list[bytes] = [b""] * len(items)
    by: dict[int, list[int]] = {}
    for i, x in enumerate(items):
        by.setdefault(len(x), []).append(i)
    for length, own in by.items():
        step = max(1, most // max(1, length))
        for at in range(0, len(own), step):
            part = own[at : at + step]
            digests = blake3_rows(np.frombuffer(b"".join(items[i] for i in part), np.uint8).reshape(len(part), length))
            for i, d in zip(part, digests, strict=True):
                out[i] = d.tobytes()
    return out


def _merged(level: np.ndarray, root: bool) -> np.ndarray:
    """The chaining value (1, 8) of a tree over chunks' values (n, 8)."""
    while len(level) > 1:
        pairs = len(level) // 2
        flags = PARENT | ROOT * (root and len(level) == 2)
        up = _compress(np.broadcast_to(IV, (pairs, 8)), level[: 2 * pairs].reshape(pairs, 16), np.zeros(pairs, np.uint64), 64, flags)
        level = np.concatenate([up, level[2 * pairs :]])
    return level


class Blake3:
    """The digest of a stream of any length; holds one block of it and a value for each power of two."""

    BLOCK = 1 << 20

    def __init__(self):
        self.rest, self.chunks, self.stack = bytearray(), 0, []

    def update(self, data: bytes) -> Blake3:
        self.rest += data
        # at least a byte is kept back, as the last block is hashed as the root
        while len(self.rest) > self.BLOCK:
            node, size = self._tree(self.rest[: self.BLOCK], False), self.BLOCK
            del self.rest[: self.BLOCK]
            while self.stack and self.stack[-1][1] == size:
                node, size = _merged(np.concatenate([self.stack.pop()[0], node]), False), 2 * size
            self.stack.append((node, size))
        return self

    def _tree(self, part: bytes, root: bool) -> np.ndarray:
        data, first = np.frombuffer(bytes(part), np.uint8), self.chunks
        whole = len(data) // 1024
        self.chunks += -(-len(data) // 1024)
        if len(data) <= 1024:
            return _chunks(data[None, :], np.array([first], np.uint64), root)
        level = [_chunks(data[: whole * 1024].reshape(whole, 1024), np.arange(first, first + whole, dtype=np.uint64), False)]
        if len(data) % 1024:
            level.append(_chunks(data[None, whole * 1024 :], np.array([first + whole], np.uint64), False))
        return _merged(np.concatenate(level), root)

    def digest(self) -> bytes:
        chunks, node = self.chunks, self._tree(self.rest, not self.stack)
        self.chunks = chunks
        for i, (left, _) in enumerate(reversed(self.stack)):
            node = _merged(np.concatenate([left, node]), i == len(self.stack) - 1)
        return np.ascontiguousarray(node[0]).astype("<u4").tobytes()


@F.pandas_udf(T.BinaryType())
def blake3(data: pd.Series) -> pd.Series:
    """BLAKE3 of a binary column; null for null."""
    there = data.notna()
    out = pd.Series([None] * len(data), index=data.index, dtype=object)
    out[there] = blake3_many([bytes(b) for b in data[there]])
    return out

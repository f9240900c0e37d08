"""Numpy kernels on UTF-8 text buffers: words, their hashes, and hashes of word sequences.

A batch of texts is one byte buffer with offsets, as Arrow holds it; nothing is looped per word.
All arithmetic is modulo 2**64.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

U = np.uint64
#: an odd multiplier
BASE = 0x9E3779B97F4A7C15


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (rows + 1) of a string column without nulls."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int32, n + 1, column.offset * 4).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def slices(column: pa.Array, size: int = 1 << 20):
    """Rows lo to hi of the column, about ``size`` bytes of text at a time."""
    at = text_buffer(column)[1]
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        yield lo, hi
        lo = hi


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64, a bijection."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each word; words end at ASCII white space and at the end of a text."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~((data == 32) | ((data - np.uint8(9)) < 5))
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | border[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | border[1:n]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


#: words of up to so many bytes are hashed eight bytes at a time, all at once; longer ones by BLAKE2, one by one
SHORT = 64
#: words hashed at a time
BLOCK = 1 << 16
_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each word's bytes and length: a chain of SplitMix64 steps over eight bytes each."""
    out = np.empty(len(starts), U)
    for lo in range(0, len(starts), BLOCK):  # small temporaries, whatever the batch
        s, e = starts[lo:lo + BLOCK], ends[lo:lo + BLOCK]
        out[lo:lo + BLOCK] = _word_hashes(data[s[0]:e[-1]], s - s[0], e - s[0], seed)
    return out


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    size = ends - starts
    out = mix(size.astype(U) * U(BASE) ^ U(seed))
    lanes = np.ndarray((len(data) + 1,), "<u8", np.concatenate((data, np.zeros(8, np.uint8))), 0, (1,))  # eight bytes from any place
    at = np.flatnonzero(size <= SHORT)
    place, left = starts[at], size[at]
    while len(at):
        out[at] = mix(out[at] ^ (lanes[place] & _BYTES[np.minimum(left, 8)]) * U(BASE))
        more = np.flatnonzero(left > 8)
        at, place, left = at[more], place[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > SHORT):
        text = data[starts[k]:ends[k]].tobytes()
        out[k] = int.from_bytes(hashlib.blake2b(text, digest_size=8, key=seed.to_bytes(8, "little")).digest(), "little")
    return out


def words_of(data: np.ndarray, offsets: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a batch, and the first word of each text (texts + 1 numbers)."""
    starts, ends = spans(data, offsets)
    return word_hashes(data, starts, ends, seed), np.searchsorted(starts, offsets)


def sequence_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` neighbouring words (those that cross texts too)."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, U)
    out = np.zeros(count, U)
    factor = 1
    for j in range(n):
        out += words[j:j + count] * U(factor)
        factor = factor * BASE % (1 << 64)
    return mix(out)

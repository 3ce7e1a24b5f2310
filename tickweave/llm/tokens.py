"""Tokens and token windows of whole Arrow batches as 64-bit hashes, in numpy.

A class table says for each byte whether it separates tokens (0) or which kind of token it belongs to; a token is a
longest run of one kind. A token's hash is a polynomial in random 64-bit values of its bytes, taken from prefix sums,
then mixed. Window hashes come from doubling: the hash of 2k tokens is made from the hashes of its halves.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240607))
_VALUES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {b: np.ones(1, np.uint64) for b in (_BASE, _BASE_INVERSE)}

#: Whole documents are taken together up to about this many bytes; a longer one is taken alone.
CHUNK_BYTES = 1 << 19


def byte_classes(kinds: dict[int, bytes], default: int) -> np.ndarray:
    out = np.full(256, default, np.uint8)
    for kind, members in kinds.items():
        out[list(members)] = kind
    return out


#: Runs of anything but ASCII white space.
WORDS = byte_classes({0: b" \t\n\x0b\x0c\r"}, 1)
#: Runs of ASCII letters, digits and all that is not ASCII.
ALNUM = byte_classes({1: bytes(i for i in range(256) if i >= 128 or chr(i).isalnum())}, 0)
#: Runs of those, and apart from them runs of punctuation.
WORDS_AND_MARKS = byte_classes({0: b" \t\n\x0b\x0c\r", 1: bytes(i for i in range(256) if i >= 128 or chr(i).isalnum())}, 2)


def byte_values(fold_case: bool) -> np.ndarray:
    out = _VALUES.copy()
    if fold_case:
        out[65:91] = out[97:123]
    return out


class Tokens(NamedTuple):
    """hash, start and stop (byte positions in data) of each token; bounds[i]:bounds[i + 1] are those of document first + i."""

    hash: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    bounds: np.ndarray
    data: np.ndarray
    first: int

    @property
    def ends(self) -> np.ndarray:
        """For each token, the number of the token after its document's last."""
        return np.repeat(self.bounds[1:], np.diff(self.bounds))

    @property
    def owner(self) -> np.ndarray:
        """For each token, its document's number within this chunk."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers[base]
    if len(have) < n:
        have = np.full(n, base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def tokens(column: pa.Array, classes: np.ndarray = WORDS, values: np.ndarray = _VALUES) -> Iterator[Tokens]:
    """Tokens of the documents of one Arrow string column, some documents at a time, in order."""
    data, at = _buffers(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + CHUNK_BYTES, "right")) - 1)
        yield _tokens(data[at[first] : at[last]], at[first : last + 1] - at[first], first, classes, values)
        first = last


def words_of_all(texts: list[bytes]) -> tuple[Tokens, np.ndarray]:
    """Words of all texts at once, and the bounds of each text in the joined bytes."""
    at = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
    return _tokens(np.frombuffer(b"".join(texts), np.uint8), at, 0, WORDS, _VALUES), at


def _tokens(data: np.ndarray, at: np.ndarray, first: int, classes: np.ndarray, values: np.ndarray) -> Tokens:
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Tokens(np.zeros(0, np.uint64), none, none, np.zeros(len(at), np.int64), data, first)
    kind = classes[data]
    cut = np.empty(n + 1, bool)  # a token may begin or end before this byte
    cut[0] = cut[n] = True
    np.not_equal(kind[1:], kind[:-1], out=cut[1:n])
    cut[at] = True
    cuts = np.flatnonzero(cut)
    inside = kind[cuts[:-1]] > 0
    start, stop = cuts[:-1][inside], cuts[1:][inside]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values[data] * _power(_BASE, n), out=sums[1:])
    hashes = mix((sums[stop] - sums[start]) * _power(_BASE_INVERSE, n)[start] + (stop - start).astype(np.uint64))
    return Tokens(hashes, start, stop, np.searchsorted(start, at), data, first)


def token_hash(word: str, values: np.ndarray = _VALUES) -> np.uint64:
    """The hash that tokens() gives this token."""
    raw = np.frombuffer(word.encode("utf-8"), np.uint8)
    return mix(np.array([(values[raw] * _power(_BASE, len(raw))).sum(dtype=np.uint64) + U(len(raw))], np.uint64))[0]


def windows(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of the window of so many tokens from each place on; len(hashes) - length + 1 values, documents not regarded."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, size, now = None, 0, 1, hashes
    while True:
        if length & size:
            part = now[done : done + n]
            out = part if out is None else join(out, part)
            done += size
        if done == length:
            return out
        now, size = join(now[:-size], now[size:]), 2 * size


def join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two windows in a row."""
    h = (left * U(0xD6E8FEB86659FD93)) ^ (left >> U(32))
    h += right
    h *= U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(29))


def leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each place, where the least of values[place : place + width] is; the first of equals."""
    place, size = np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        left, right = place[:-step], place[step:]
        place = np.where(values[left] <= values[right], left, right)
        size += step
    return place


def span_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of the bytes start:stop of data, for each pair."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * _power(_BASE, len(data)), out=sums[1:])
    inverse = _power(_BASE_INVERSE, max(len(data), 1))
    return mix((sums[stop] - sums[start]) * inverse[start] + (stop - start).astype(np.uint64))

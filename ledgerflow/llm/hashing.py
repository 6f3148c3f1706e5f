"""Vectorised word hashing over Arrow text columns (numpy, inside tasks).

A word's hash is a polynomial over its bytes modulo 2**64, taken from running sums, then mixed. Texts are
worked on in blocks of about a megabyte that end at separators, so memory stays bounded for any text length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
U64 = np.uint64
SPACE = np.ones(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = False
NO_BREAK = np.ones(256, dtype=bool)
NO_BREAK[10] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTES = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, BLOCK + 1)
        up, down = np.full(size, BASE, U64), np.full(size, pow(BASE, -1, 2**64), U64)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up), np.cumprod(down)]
    return _powers[0], _powers[1]


def slices(texts: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts of about ``most`` bytes: first row, bytes, and the offsets of the run's texts in them. Null is empty."""
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, fold: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes with ``inside`` that don't cross texts: hash, first byte, length. ``fold`` maps bytes first."""
    hashes, firsts, lengths = [], [], []
    at, n = 0, len(data)
    opens = offsets[:-1]
    while at < n:
        end = min(at + BLOCK, n)
        if end < n:
            own = inside[data[at:end]]
            gaps = np.flatnonzero(~own[-65536:])
            if len(gaps):
                end = max(end - min(65536, len(own)) + int(gaps[-1]), at + 1)
            else:
                step = end
                while step < n:
                    gaps = np.flatnonzero(~inside[data[step : step + 65536]])
                    if len(gaps):
                        break
                    step += 65536
                end = min(n, step + int(gaps[0])) if len(gaps) else n
        part = data[at:end]
        own = inside[part]
        first = own.copy()
        first[1:] &= ~own[:-1]
        lo, hi = np.searchsorted(opens, [at, end])
        begins = opens[lo:hi] - at
        first[begins] |= own[begins]
        start = np.flatnonzero(first)
        if len(start):
            # a run ends at the next gap or at the next text's start
            stop_at = np.flatnonzero(~own)
            stops = np.append(stop_at, len(part))
            stop = stops[np.searchsorted(stops, start)]
            nxt = np.append(start[1:], len(part))
            stop = np.minimum(stop, nxt)
            up, down = _power(len(part) + 1)
            total = np.zeros(len(part) + 1, U64)
            np.cumsum(_BYTES[part if fold is None else fold[part]] * up[: len(part)], out=total[1:])
            length = stop - start
            hashes.append(mix((total[stop] - total[start]) * down[start] + length.astype(U64)))
            firsts.append(start + at)
            lengths.append(length)
        at = end
    if not hashes:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(firsts), np.concatenate(lengths)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words."""
    if len(words) < n:
        return np.zeros(0, U64)
    out = np.full(len(words) - n + 1, n, U64)
    for i in range(n):
        out = mix(out * U64(0xD6E8FEB86659FD93) + words[i : len(words) - n + 1 + i])
    return out

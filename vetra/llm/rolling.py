"""Vectorised byte, word and window hashing over Arrow string columns.

All functions work on the UTF-8 bytes of many documents at once.  A hash of a
range is a difference of prefix sums of ``value[byte] * BASE ** position``,
multiplied by the inverse power of the start, so equal ranges have equal
hashes wherever they stand (arithmetic modulo 2**64, then a bijective mixer).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_BASE = 0xD6E8FEB86659FD93
_SECOND_BASE = 0x8EBC6AF09C88C6E3
_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Bytes of text handled at a time, so that the arrays stay near the CPU caches.
CHUNK_BYTES = 1 << 18


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64 for i < n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 2**64)):
            p = np.empty(size, U)
            p[0] = 1
            done = 1
            while done < size:
                p[done : 2 * done] = p[:done] * U(pow(b, done, 2**64))
                done *= 2
            out.append(p)
        have = _powers[base] = (out[0], out[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (in place)."""
    h ^= h >> U(30)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums for :func:`ranges`; one longer than the values."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(base, len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def ranges(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hashes of the ranges [start, end) of the values behind ``sums``."""
    return mix((sums[ends] - sums[starts]) * powers(base, len(sums))[1][starts])


def byte_prefix(data: np.ndarray) -> np.ndarray:
    return prefix(_VALUES[data], _BASE)


def byte_ranges(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return ranges(sums, starts, ends, _BASE)


def word_prefix(hashes: np.ndarray) -> np.ndarray:
    return prefix(hashes, _WORD_BASE)


def word_ranges(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return ranges(sums, starts, ends, _WORD_BASE)


def second_values(hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Other values of words, from their hashes, lengths and outer bytes; for :func:`second_grams`."""
    facts = ((ends - starts).astype(U) << U(16)) | (data[starts].astype(U) << U(8)) | data[ends - 1].astype(U)
    return mix((hashes ^ U(0x94D049BB133111EB)) * U(0xA0761D6478BD642F) + facts * U(0xE7037ED1A0B428DB))


def second_prefix(values: np.ndarray) -> np.ndarray:
    return prefix(values, _SECOND_BASE)


def second_grams(sums: np.ndarray, k: int) -> np.ndarray:
    """32 more bits for the hash of the k words from every position on."""
    return (_grams(sums, k, _SECOND_BASE) >> U(32)).astype(np.uint32)


def sliding_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """Position of the smallest of h[i:i+w] for every full window.

    Equal hashes are told apart by position (the rightmost wins), so the
    choice depends only on what stands inside the window.
    """
    n = len(h) - w + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best, at, size = h.copy(), np.arange(len(h), dtype=np.int32), 1
    while size < w:
        step = min(size, w - size)
        m = len(best) - step
        right = best[step:] <= best[:m]
        at = np.where(right, at[step:], at[:m])
        best = np.minimum(best[:m], best[step:])
        size += step
    return at[:n]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if offsets is None or len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Ranges of rows that hold about ``limit`` bytes, or one longer row."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
    """(starts, ends, first word of each row + total) of the maximal word runs.

    ``is_word`` is a table of 256 booleans; runs never cross rows.
    """
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = is_word[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[heads] = inside[heads]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    tails = heads[1:] - 1
    stops[tails] = inside[tails]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def class_table(excluded) -> np.ndarray:
    out = np.ones(256, bool)
    out[list(excluded)] = False
    return out


#: ``[^\x20\x09-\x0D]+``
SPACE_WORDS = class_table([0x20, *range(0x09, 0x0E)])
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z became a-z
ALNUM_WORDS = class_table([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def byte_grams(sums: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from every position on."""
    return _grams(sums, k, _BASE)


def word_grams(sums: np.ndarray, k: int) -> np.ndarray:
    return _grams(sums, k, _WORD_BASE)


def _grams(sums: np.ndarray, k: int, base: int) -> np.ndarray:
    n = len(sums) - k
    if n <= 0:
        return np.empty(0, U)
    return mix((sums[k:] - sums[:n]) * powers(base, len(sums))[1][:n])

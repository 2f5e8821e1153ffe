"""Words of whole Arrow columns and their 64-bit hashes, by numpy.

A word is a run of bytes other than space and 0x09-0x0D, with A-Z lower-cased. Its hash takes in eight bytes after the
other, mixing in between; long words are hashed by XXH3.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_U = np.uint64
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A second way to part words: at every ASCII byte that is no letter or digit.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_SEED = int(_RANDOM.integers(2**62, 2**63, dtype=_U))
_STEP = _RANDOM.integers(2**62, 2**63, dtype=_U) * _U(2) + _U(1)
_PLACE = _RANDOM.integers(1, 2**63, 64, dtype=_U) * _U(2) + _U(1)
#: Masks of the first n bytes of a number.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)
_LONG = 64
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _hashes(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of the words raw[start : start + length]; raw has at least 8 bytes more behind the last one."""
    eights = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))  # the number that begins at each byte
    out = mix(lengths.astype(_U) * _STEP + _U(_SEED))
    rest, at = np.arange(len(starts)), 0
    while len(rest):
        left = lengths[rest] - at
        out[rest] = mix(out[rest] ^ (eights[starts[rest] + at] & _FIRST[np.minimum(left, 8)]))
        at += 8
        rest = rest[left > 8]
        if at >= _LONG:
            for k in rest.tolist():
                out[k] = xxhash.xxh3_64_intdigest(raw[starts[k] : starts[k] + lengths[k]].tobytes(), _SEED)
            break
    return out


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return offsets, (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))


def word_hashes(texts: pa.Array, space: np.ndarray = _SPACE) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of rows (texts without nulls): the first row's number, where each row's words begin in the
    arrays (one more at the end), the words' hashes, and their first and last byte offsets within the row."""
    offsets, data = _buffers(texts)
    row = 0
    while row < len(texts):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        to = min(to, len(texts))
        begin = offsets[row]
        raw = data[begin : offsets[to]]
        at = offsets[row : to + 1] - begin
        n = len(raw)
        if n == 0:
            empty = np.zeros(0, np.int64)
            yield row, np.zeros(to - row + 1, np.int64), np.zeros(0, _U), empty, empty
            row = to
            continue
        inside = ~space[raw]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        cut = at[(at > 0) & (at < n)]  # words end where rows do
        first[cut] = inside[cut]
        last[cut - 1] = inside[cut - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        letters = np.zeros(n + 8, np.uint8)
        letters[:n] = _LOWER[raw]
        hashes = _hashes(letters, starts, ends - starts)
        bounds = np.searchsorted(starts, at)
        base = np.repeat(at[:-1], np.diff(bounds))
        yield row, bounds, hashes, starts - base, ends - base
        row = to


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of one text in order; of all its words where there are fewer; none without words."""
    n = min(k, len(words))
    if not n:
        return np.zeros(0, _U)
    count = len(words) - n + 1
    out = np.full(count, _U(n * 0x9E3779B97F4A7C15 & (2**64 - 1)))
    for j in range(n):
        out += words[j : j + count] * _PLACE[j]
    return mix(out)

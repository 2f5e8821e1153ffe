"""Pre-tokens of byte-level BPE: the matches of the splitting pattern, found by array operations.

One place has the rule for all operators that split (token files, the round trip, token counts).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: The pre-splitting pattern of the rank files that this operator is used with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Between a character that is no white space and a space or line end, every match of PATTERN ends.
_SAFE = regex.compile(r"(?<=[^\s\x1c-\x1f\x85])(?=[ \n])")

#: Characters that are split at once; a longer text is cut where matches end.
PIECE = 3 << 20


def safe_pieces(text: str, size: int) -> Iterator[str]:
    """The text in pieces of about size characters, cut where no match of PATTERN is cut.

    A stretch without such a place stays whole.
    """
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Of every code point what PATTERN takes it for: 0 white space, 1 letter, 2 number, 3 anything else."""
    out = np.full(0x110000, 3, np.uint8)
    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    for kind, pattern in enumerate((r"\s", r"\p{L}", r"\p{N}")):
        out[np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), "<u4")] = kind
    return out


def match_starts(points: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where each match of PATTERN starts in texts of code points that stand one after another; rows: where each text
    starts. Matches leave no gaps, so the next one's start is a match's end.

    A match is a run of one class, with the one space before it; of a run of white space before other characters the
    last character stands alone (or goes with the next run); an apostrophe that no space precedes takes the letters
    of a contraction from the run behind it.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[points]
    begins = np.zeros(n + 3, bool)  # of texts; three more, so that looking ahead stays inside
    begins[rows[rows < n]] = True
    begins[n:] = True
    start = np.zeros(n + 3, bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:n])
    start |= begins
    space = kind == 0
    last = np.flatnonzero(space[:-1] & ~space[1:])
    last = last[~begins[last + 1]]
    start[last] = True
    start[last[points[last] == 32] + 1] = False
    ahead = np.concatenate([points, np.zeros(3, points.dtype)])
    quote = np.flatnonzero(points == 39)
    quote = quote[start[quote] & ~begins[quote + 1]]
    one, two = ahead[quote + 1], ahead[quote + 2]
    short = quote[np.isin(one, [ord(c) for c in "stmd"])]
    long = (one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    long = quote[long & ~begins[quote + 2]]
    start[short + 1] = start[long + 1] = False
    start[short + 2] = start[long + 3] = True
    return np.flatnonzero(start[:n])


def matches_of(pieces: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different matches of PATTERN in the pieces, the number of each match among them (one piece after another), and
    how many matches stand before each piece's start and the last one's end. A match doesn't cross pieces."""
    whole = "".join(pieces)
    raw = whole.encode()
    rows = np.concatenate([[0], np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))])
    if len(raw) == len(whole):
        starts = bounds = match_starts(np.frombuffer(raw, np.uint8), rows[:-1])
    else:
        points = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        starts = match_starts(points, rows[:-1])
        at = np.zeros(len(points), np.int64)  # the first byte of each character
        np.cumsum(1 + (points[:-1] >= 0x80) + (points[:-1] >= 0x800).astype(np.int8) + (points[:-1] >= 0x10000), out=at[1:])
        bounds = at[starts]
    offsets = np.concatenate([bounds, [len(raw)]]).astype(np.int64)
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
    return found.dictionary.to_pylist(), found.indices.to_numpy(), np.searchsorted(starts, rows)


def byte_letters() -> dict[int, str]:
    """The characters by which byte-level files write bytes: printable ones of Latin-1 are themselves, the others follow 255."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in own else next(rest)) for b in range(256)}


def slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows with about PIECE bytes of text together, or one row."""
    sizes = np.cumsum(np.asarray(pc.binary_length(b.column(1)), np.int64))
    k = 0
    while k < b.num_rows:
        to = max(k + 1, int(np.searchsorted(sizes, (sizes[k - 1] if k else 0) + PIECE, "right")))
        yield b.slice(k, to - k)
        k = to

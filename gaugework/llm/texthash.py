"""Vectorised 64-bit hashes of words, shingles and byte windows of Arrow text batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_POWERS = {}

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes that are not part of a word, for words between blanks and for alphanumeric words.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:0x80] = True
NOT_ALNUM[0x30:0x3A] = False
NOT_ALNUM[0x61:0x7B] = False


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finisher: every input bit reaches every output bit."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and grown by doubling."""
    have = _POWERS.get(inverse)
    if have is None or len(have) < n:
        steps = np.full(max(4096, 1 << int(n - 1).bit_length()), _INVERSE if inverse else _BASE, dtype=np.uint64)
        steps[0] = 1
        _POWERS[inverse] = have = np.multiply.accumulate(steps)
    return have[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


#: Bytes of texts that are worked on at a time; a longer text is worked on alone and whole.
PIECE = 4 << 20


def in_pieces(run, column: str = "text"):
    """``run`` over slices of its batches with about ``PIECE`` bytes of texts each, which bounds a worker's memory by bytes."""

    def pieces(batches):
        for batch in batches:
            size = np.diff(text_bytes(batch.column(column))[1])
            part = (np.cumsum(size) - 1) // PIECE
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    yield batch.slice(a, b - a)

    return lambda batches: run(pieces(batches))


def words(raw: np.ndarray, offs: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, text number and hash of every word; A-Z count as a-z, words never cross texts."""
    low = _LOWER[raw]
    inside = ~gap[low]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = offs[:-1][offs[:-1] < len(raw)]
    first[at] = inside[at]
    starts = np.flatnonzero(first)
    if len(starts) == 0:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    kept = np.flatnonzero(inside)
    head = np.searchsorted(kept, starts)
    size = np.diff(np.append(head, len(kept)))
    step = np.arange(len(kept)) - np.repeat(head, size)
    value = _BYTE[low[kept]] * powers(int(size.max()))[step]
    hashes = mix(np.add.reduceat(value, head))
    return starts, starts + size, np.searchsorted(offs, starts, side="right") - 1, hashes


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive words."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.full(len(hashes) - n + 1, n, dtype=np.uint64)
    for j, p in enumerate(powers(n + 1)[1:]):
        out += hashes[j : len(hashes) - n + 1 + j] * p
    return mix(out)


def shingle_sets(column: pa.Array, n: int):
    """For each text its sorted set of hashed ``n``-word shingles; fewer words make one shingle, none makes none."""
    raw, offs = text_bytes(column)
    _, _, doc, hashes = words(raw, offs, BLANK)
    count = np.bincount(doc, minlength=len(offs) - 1) if len(doc) else np.zeros(len(offs) - 1, np.int64)
    begin = np.cumsum(count) - count
    full = grams(hashes, n)
    for b, c in zip(begin.tolist(), count.tolist(), strict=True):
        if c >= n:
            yield np.unique(full[b : b + c - n + 1])
        elif c:
            yield grams(hashes[b : b + c], c)
        else:
            yield np.zeros(0, np.uint64)


class Windows:
    """Hashes of byte windows of one text by prefix sums."""

    def __init__(self, raw: np.ndarray):
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * powers(len(raw) + 1)[: len(raw)], out=self.sums[1:])
        self.unshift = powers(len(raw) + 1, inverse=True)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.unshift[start])


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)

"""Words of many texts at once, as numpy arrays over the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes looked at together; bounds the memory whatever a text's length.
SEGMENT = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of a published 64-bit hash; fixed constants)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def byte_table(extra: bytes = b"", high: bool = False) -> np.ndarray:
    """256 entries: 0 outside words, else the byte in lower case. Word bytes are
    ASCII letters and digits, ``extra`` and, with ``high``, all bytes from 128 on."""
    t = np.zeros(256, np.uint8)
    for c in range(256):
        if chr(c).isascii() and chr(c).isalnum():
            t[c] = ord(chr(c).lower())
        elif c in extra or (high and c >= 128):
            t[c] = c
    return t


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): text i is bytes[offsets[i]:offsets[i+1]]; NULL is empty. No copy for plain columns."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]] if len(offsets) else raw, offsets - (offsets[0] if len(offsets) else 0)


def _segments(inside: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about SEGMENT bytes that end outside words."""
    at, n = 0, len(inside)
    while at < n:
        end = min(n, at + SEGMENT)
        if end < n:
            gap = np.flatnonzero(inside[max(at + 1, end - 4096) : end] == 0)
            if len(gap):
                end = max(at + 1, end - 4096) + int(gap[-1]) + 1
            else:  # a very long word
                while end < n and inside[end]:
                    more = np.flatnonzero(inside[end : end + SEGMENT] == 0)
                    end = end + int(more[0]) if len(more) else min(n, end + SEGMENT)
        yield at, end
        at = end


def words(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash, text number) of every word, in order. Words never cross texts."""
    lower = table[raw]
    inside = lower != 0
    first = np.zeros(len(raw) + 1, bool)
    first[offsets[:-1]] = True
    starts, ends, hashes = [], [], []
    for a, b in _segments(inside):
        m = inside[a:b]
        prev = np.r_[inside[a - 1] if a else False, m[:-1]]
        begin = m & (~prev | first[a:b])
        s = np.flatnonzero(begin)
        if not len(s):
            continue
        used = np.flatnonzero(m)
        which = np.searchsorted(used, s)
        length = np.diff(np.r_[which, len(used)])
        place = np.arange(len(used)) - np.repeat(which, length)
        powers = np.cumprod(np.full(int(length.max()), _BASE, np.uint64))
        h = np.add.reduceat((lower[a:b][used].astype(np.uint64) + np.uint64(1)) * powers[place], which)
        starts.append(s + a)
        ends.append(s + a + length)
        hashes.append(mix(h))
    if not starts:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(0, np.uint64), empty
    start = np.concatenate(starts)
    return start, np.concatenate(ends), np.concatenate(hashes), np.searchsorted(offsets, start, side="right") - 1


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on (len - k + 1 values)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for i in range(1, k):
        out = out * _BASE + h[i : n + i]
    return mix(out)

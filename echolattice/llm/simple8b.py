"""Simple-8b word-aligned coding of ids, vectorised over many blocks.

A 64-bit word holds a selector in its top 4 bits and in the rest as many ids, from the lowest bits up, as the selector
says. Selector 1 is the escape: it holds nothing, and the next word is one id of up to 64 bits. Ids are coded in blocks of
BLOCK; each block starts a word, so that blocks can be decoded alone, or all at once.
"""

from __future__ import annotations

import numpy as np

BLOCK = 4096
ESCAPE = 1
#: Fixed values of the format: ids a word holds and bits of each, by selector.
COUNTS = np.array([240, 1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])


_BITS = np.zeros(1 << 16, np.uint8)
for _k in range(16):
    _BITS[1 << _k :] = _k + 1


def bit_lengths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id as uint8."""
    if len(ids) and ids.max() >> np.uint64(16):
        x, out = ids.astype(np.uint64), np.zeros(len(ids), np.uint8)
        for part in range(4):
            low = _BITS[(x >> np.uint64(16 * part)).astype(np.uint16)]
            out = np.where(low > 0, low + 16 * part, out).astype(np.uint8)
        return out
    return _BITS[ids.astype(np.uint16)]


def _choices(bits: np.ndarray) -> np.ndarray:
    """Selector that a word starting at each place takes: the one for most ids that fit. bits: a row for each block, padded with 255."""
    rows, n = bits.shape
    best = np.full(bits.shape, 15, np.uint8)
    best[bits > 60] = ESCAPE
    top = {1: bits}  # greatest bits of so many ids in a row
    for c, parts in ((2, (1, 1)), (3, (2, 1)), (4, (2, 2)), (5, (4, 1)), (6, (4, 2)), (7, (4, 3)), (8, (4, 4)), (10, (8, 2)), (12, (8, 4)), (15, (8, 7)), (20, (10, 10)), (30, (15, 15)), (60, (30, 30)), (120, (60, 60)), (240, (120, 120))):
        a, b = (top[p] for p in parts)
        m = np.full(bits.shape, 255, np.uint8)
        k = parts[0]
        if n > k:
            m[:, : n - k] = np.maximum(a[:, : n - k], b[:, k:])
        top[c] = m
        if c != 120:
            s = int(np.flatnonzero((COUNTS == c) & (WIDTHS < 60))[0])
            fits = m <= WIDTHS[s]
            if not fits.any() and c >= 8:
                break  # more ids need fewer bits each
            best[fits] = s
    return best


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the first word of each block."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    pad = np.full((blocks, BLOCK), 255, np.uint8)
    pad.reshape(-1)[:n] = bit_lengths(ids)
    choice = _choices(pad).reshape(-1)
    ends = np.minimum((np.arange(blocks) + 1) * BLOCK, n)
    at, starts = np.arange(blocks) * BLOCK, np.zeros(n, bool)
    while len(at):  # one word of every block in each step
        starts[at] = True
        at = at + COUNTS[choice[at]]
        more = at < ends
        if not more.all():
            at, ends = at[more], ends[more]
    places = np.flatnonzero(starts)
    sel = choice[places]
    size = 1 + (sel == ESCAPE)
    to = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for s in np.unique(sel):
        own = np.flatnonzero(sel == s)
        if s == ESCAPE:
            words[to[own]] = np.uint64(ESCAPE << 60)
            words[to[own] + 1] = ids[places[own]]
            continue
        w = np.full(len(own), int(s) << 60, np.uint64)
        if WIDTHS[s]:
            for k in range(COUNTS[s]):
                w |= ids[places[own] + k] << np.uint64(k * WIDTHS[s])
        words[to[own]] = w
    first = to[np.searchsorted(places, np.arange(blocks) * BLOCK)]
    return words, first


def decode(words: np.ndarray) -> np.ndarray:
    """All ids of whole blocks' words, as uint64."""
    words = np.ascontiguousarray(words, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    count = COUNTS[sel]
    raw, last = [], -2
    for i in np.flatnonzero(sel == ESCAPE):
        if i != last + 1:  # else it is itself what follows an escape
            raw.append(i)
            last = i
    raw = np.array(raw, np.int64)
    count[raw] = 0
    sel[raw + 1], count[raw + 1] = ESCAPE, 1
    to = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint64)
    out[to[raw + 1]] = words[raw + 1]
    for s in np.unique(sel):
        if s == ESCAPE or not WIDTHS[s]:
            continue
        own = np.flatnonzero(sel == s)
        own = own[count[own] > 0]
        mask = np.uint64((1 << int(WIDTHS[s])) - 1)
        for k in range(COUNTS[s]):
            out[to[own] + k] = (words[own] >> np.uint64(k * WIDTHS[s])) & mask
    return out


def decode_block(words: np.ndarray, first: np.ndarray, block: int) -> np.ndarray:
    """Ids of one block."""
    end = first[block + 1] if block + 1 < len(first) else len(words)
    return decode(words[first[block] : end])

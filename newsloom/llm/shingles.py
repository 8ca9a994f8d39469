"""Word shingles of whole texts as 64-bit hashes, and SuperMinHash signatures over them.

Words are runs of bytes other than space and \\x09-\\x0D, with A-Z lower-cased, which is what ``bytes.lower().split()``
yields on UTF-8. A text with fewer than ``k`` words, but at least one, has its whole word sequence as one shingle.
"""

from __future__ import annotations

import numpy as np
import xxhash

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_RANK_SHIFT = np.uint64(56)                     # a slot value is rank << 56 | 56 random bits
_UNSET = np.uint64(0xFFFFFFFFFFFFFFFF)
PIECE = 1 << 17                                 # shingles handled at once


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, elementwise."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Memo of word -> 64-bit hash; emptied when it grows past ``most`` words."""

    def __init__(self, most: int = 1_000_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def shingle_set(words: list[bytes], k: int, memo: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, n)
    width = min(k, n)
    out = np.full(n - width + 1, np.uint64(width), np.uint64)
    for j in range(width):
        out = mix(out * _GOLDEN + h[j:n - width + 1 + j])
    return np.unique(out)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int(np.count_nonzero(b[at] == a))


def _piece_signatures(items: np.ndarray, owner: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """SuperMinHash of ``n_docs`` sets at once, rank by rank.

    Each item draws a permutation of the ``m`` slots by Fisher-Yates. At rank j it offers (j, fraction) to the j-th slot
    of its permutation, and a slot keeps the least offer. A set stops as soon as every slot holds an offer of rank <= j,
    since later ranks can only be larger.
    """
    h = np.full(n_docs * m, _UNSET, np.uint64)
    drawn: list[np.ndarray] = []                # the swap partner of each rank, while few ranks were needed
    perm = None
    for j in range(m):
        r = mix(items + np.uint64((j + 1) * int(_GOLDEN) & int(_UNSET)))
        pick = (j + (mix(r ^ _GOLDEN) % np.uint64(m - j))).astype(np.int64)
        if perm is None and j == 4:
            perm = np.tile(np.arange(m, dtype=np.uint8), (len(items), 1))
            rows = np.arange(len(items))
            for i, p in enumerate(drawn):
                held = perm[rows, p]
                perm[rows, p] = perm[:, i]
                perm[:, i] = held
            drawn = []
        if perm is None:
            slot = pick.copy()
            for i in range(j - 1, -1, -1):      # where the value now at `pick` stood before swap i
                slot[drawn[i] == slot] = i
            drawn.append(pick)
        else:
            rows = np.arange(len(items))
            slot = perm[rows, pick].astype(np.int64)
            perm[rows, pick] = perm[:, j]
        np.minimum.at(h, owner * m + slot, (np.uint64(j) << _RANK_SHIFT) | (r >> np.uint64(8)))
        open_docs = h.reshape(n_docs, m).max(axis=1) >= (np.uint64(j + 1) << _RANK_SHIFT)
        if not open_docs.any():
            break
        on = open_docs[owner]
        if not on.all():
            items, owner = items[on], owner[on]
            drawn = [p[on] for p in drawn]
            perm = None if perm is None else perm[on]
    return h.reshape(n_docs, m)


def signatures(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash signatures, one row of ``m`` slots per set (empty sets: all slots unset)."""
    if not 1 <= m <= 256:
        raise ValueError("m must be between 1 and 256")
    out = np.full((len(sets), m), _UNSET, np.uint64)
    parts: list[tuple[int, np.ndarray]] = []
    total = 0

    def flush() -> None:
        nonlocal parts, total
        if parts:
            owner = np.repeat(np.arange(len(parts)), [len(x) for _, x in parts])
            got = _piece_signatures(np.concatenate([x for _, x in parts]), owner, len(parts), m)
            for (i, _), row in zip(parts, got, strict=True):
                np.minimum(out[i], row, out=out[i])
        parts, total = [], 0

    for i, s in enumerate(sets):
        for at in range(0, len(s), PIECE):      # a very long text goes in pieces; slots keep the least of all pieces
            piece = s[at:at + PIECE]
            if total + len(piece) > PIECE:
                flush()
            parts.append((i, piece))
            total += len(piece)
    flush()
    return out


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One signed 64-bit hash per band of ``rows`` slots; the band's number is part of the hash."""
    out = np.empty((len(sig), bands), np.uint64)
    for b in range(bands):
        acc = np.full(len(sig), np.uint64(b + 1), np.uint64)
        for c in range(b * rows, (b + 1) * rows):
            acc = mix(acc * _GOLDEN + sig[:, c])
        out[:, b] = acc
    return out.view(np.int64)

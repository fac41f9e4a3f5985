"""Word splitting and 64-bit hashing of whole texts, vectorised over a slice of a column.

Hashes are 64 bits wide and compared as equal to the words or word runs they stand for.
"""

from __future__ import annotations

import numpy as np

#: Upper-case A-Z to lower case, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PLAIN = np.arange(256, dtype=np.uint8)

#: Bytes of a word in the class [^\x20\x09-\x0D].
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Bytes of a word in the class [^\x00-\x2F\x3A-\x60\x7B-\x7F], after lower-casing A-Z.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_FNV, _BASIS = np.uint64(0x100000001B3), np.uint64(0xCBF29CE484222325)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_spans(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word and the row it is in; words end where rows end."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = member[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, letters: np.ndarray = PLAIN) -> np.ndarray:
    """FNV-1a with a finaliser over each byte span, all spans a byte at a time, longest first."""
    length = end - start
    order = np.argsort(np.minimum(65535, length).astype(np.uint16), kind="stable")[::-1]
    if len(length) and length.max() > 65535:
        order = np.argsort(length, kind="stable")[::-1]
    place, sizes = start[order], length[order]
    h = np.full(len(place), _BASIS)
    still = len(place) - np.cumsum(np.bincount(sizes)) if len(sizes) else np.zeros(1, int)
    for j, k in enumerate(still):  # k spans are longer than j bytes
        if k <= 0:
            break
        h[:k] = (h[:k] ^ letters[data[place[:k] + j]]) * _FNV
    out = np.empty_like(h)
    out[order] = mix(h)
    return out


def runs(words: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of k words inside one row, and the index of its first word."""
    if len(words) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(words) - k + 1
    h = words[:n].copy()
    for j in range(1, k):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n] + np.uint64(j))
    whole = np.flatnonzero(row[:n] == row[k - 1 :])
    return h[whole], whole


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Per row the sorted distinct k-word shingles, lower-cased; the whole sequence where words are fewer."""
    start, end, row = word_spans(data, offsets, NOT_SPACE)
    words = hash_spans(data, start, end, LOWER)
    rows = len(offsets) - 1
    count = np.bincount(row, minlength=rows)
    h, first = runs(words, row, k)
    at = np.searchsorted(row[first], np.arange(rows + 1))
    word_at = np.searchsorted(row, np.arange(rows + 1))
    out = []
    for i in range(rows):
        if count[i] >= k:
            out.append(np.unique(h[at[i] : at[i + 1]]))
        elif count[i]:
            short = np.array([count[i]], np.uint64)
            for w in words[word_at[i] : word_at[i + 1]]:
                short = mix(short * np.uint64(31) + w)
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
    return out

"""Words and word shingles of many texts at once, as arrays of hashes.

Texts are UTF-8 bytes and a word is a run of bytes of one class, so non-ASCII characters
need no decoding.  Hashes only propose; who needs certainty compares the words themselves.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LOWER_BYTES = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
HASH_BYTES = 1 << 20

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)


def class_of(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


#: fixed: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing, and [^\x20\x09-\x0D]
ALNUM = class_of(bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100)))
NO_SPACE = ~class_of(b" \t\n\x0b\x0c\r")


def _powers(base: np.uint64, n: int) -> np.ndarray:
    powers = np.full(n, base, np.uint64)
    powers[0] = 1
    return np.cumprod(powers, dtype=np.uint64)


_CACHE: dict[str, np.ndarray] = {}


def _power_pair(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > HASH_BYTES + 1:
        return _powers(_PRIME, n), _powers(_INVERSE, n)
    if not _CACHE:
        _CACHE["up"], _CACHE["down"] = _powers(_PRIME, HASH_BYTES + 1), _powers(_INVERSE, HASH_BYTES + 1)
    return _CACHE["up"][:n], _CACHE["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of a run of texts: byte ranges in ``data``, hashes, and the first word of each text (and the end)."""

    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.ends[i]]

    def joined(self, i: int, n: int) -> bytes:
        return b" ".join([self.data[s:e] for s, e in zip(self.starts[i:i + n], self.ends[i:i + n])])


def _hashed(values: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = np.zeros(len(values) + 2, np.int8)
    inside[1:-1] = table[values]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[0::2], edges[1::2]
    up, down = _power_pair(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return starts, ends, hashes


def words_of(texts: list[bytes | None], table: np.ndarray) -> Words:
    """Lower-case A-Z and find the words of each text; null has none.

    Bytes are hashed in pieces cut between words, so a very long text takes little more
    memory than a short one.
    """
    plain = [t or b"" for t in texts]
    data = b"\n".join(plain).translate(LOWER_BYTES)
    begin = np.cumsum([0] + [len(t) + 1 for t in plain])
    values = np.frombuffer(data, np.uint8)
    found, at = [], 0
    while at < len(values):
        end = min(len(values), at + HASH_BYTES)
        while end < len(values):
            gaps = np.flatnonzero(~table[values[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
                break
            end = min(len(values), end + HASH_BYTES)
        starts, ends, hashes = _hashed(values[at:end], table)
        found.append((starts + at, ends + at, hashes))
        at = end
    none = np.zeros(0, np.int64)
    starts, ends, hashes = (
        np.concatenate(x) if found else x for x in (zip(*found) if found else (none, none, none.astype(np.uint64))))
    return Words(data, starts, ends, hashes, np.searchsorted(starts, begin))


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` neighbouring words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _STEP + hashes[j:j + n]
    return mix(out + np.uint64(k))


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer than ``k`` words has one, of none has none."""
    grams = gram_hashes(words.hashes, k)
    out = []
    for a, b in zip(words.first[:-1], words.first[1:]):
        if b - a >= k:
            out.append(np.unique(grams[a:b - k + 1]))
        else:
            out.append(gram_hashes(words.hashes[a:b], b - a) if b > a else grams[:0])
    return out

"""Word shingles of many texts at once, with numpy: the kernel of the n-gram join's tasks.

The texts of a batch are laid end to end as UTF-8. A word's hash is a difference of prefix sums of its bytes' polynomial,
a shingle's hash a mix of the hashes of its words; all arithmetic is modulo 2 ** 64, without a loop over words.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32


@lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, for 2 ** bits bytes."""
    inverse = pow(BASE, -1, 1 << 64)
    out = []
    for base in (BASE, inverse):
        p = np.empty(1 << bits, np.uint64)
        p[0] = 1
        done = 1
        while done < len(p):
            p[done : 2 * done] = p[:done] * np.uint64(pow(base, done, 1 << 64))
            done *= 2
        out.append(p)
    return out[0], out[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start byte, hash) of each word of a text in UTF-8, A-Z lower-cased."""
    if not raw:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at = np.frombuffer(raw, np.uint8)
    inside = np.concatenate([[False], ~_SPACE[at], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, stops = edge[::2], edge[1::2]
    power, inverse = _powers(max(16, int(len(raw)).bit_length()))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((_LOWER[at] + np.uint64(1)) * power[: len(raw)], out=total[1:])
    return starts, mixed((total[stops] - total[starts]) * inverse[starts] + (stops - starts).astype(np.uint64))


def shingle_sets(texts: list[str | None], words: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; of all its words if they are fewer; none without words."""
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    out: list[np.ndarray] = []
    first = 0
    while first < len(raws):
        stop, size = first, 0
        while stop < len(raws) and (stop == first or size + len(raws[stop]) < 1 << 22):
            size += len(raws[stop]) + 1
            stop += 1
        out += _sets(raws[first:stop], words)
        first = stop
    return out


def _sets(raws: list[bytes], k: int) -> list[np.ndarray]:
    starts, h = word_hashes(b" ".join(raws))
    begins = np.cumsum([0, *(len(r) + 1 for r in raws)])
    at = np.searchsorted(starts, begins)
    chain = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        chain = mixed(chain + h[j : len(h) - k + 1 + j] + np.uint64(j + 1))
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(chain[a : b - k + 1]))
        elif b > a:
            short = np.zeros(1, np.uint64)
            for j in range(a, b):
                short = mixed(short + h[j : j + 1] + np.uint64(j - a + 1))
            out.append(mixed(short + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out

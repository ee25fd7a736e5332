"""Sampled positions of sequences, chosen by content, and grouping of what stands around them.

Every window of `length` elements has one anchor: the leftmost of its k-grams of least hash. Equal
windows have equal anchors at equal offsets, wherever they stand. Consecutive windows of one anchor
form a run; runs of equal content are settled as one, and only runs that share an anchor without
being equal have their windows compared one by one (`settle`).

Hashes are polynomial modulo 2^64 over random values per element, then mixed.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bits of a position within a block; the rest of a 64-bit word orders the k-grams.
LOW = (1 << 23) - 1
#: Elements of a block of text that is worked on at once.
BLOCK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


#: A random value for each byte.
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def table(base: int) -> np.ndarray:
        out = np.full(size, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return table(BASE), table(INVERSE)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(10, int(size - 1).bit_length()))


def sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i:i + width] for each i."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def anchor_runs(values: np.ndarray, bounds: np.ndarray, length: int, k: int) -> dict[str, np.ndarray]:
    """Runs of windows by anchor. values: 64-bit element hashes; bounds: where each sequence begins, and the end.

    Returns arrays: seq (index of the sequence), at (of the anchor), first, last (window starts), anchor and
    span (hashes of the k-gram, and of all elements that the run's windows cover).
    """
    n = len(values)
    empty = np.zeros(0, np.int64)
    none = {x: empty for x in ("seq", "at", "first", "last")} | {"anchor": empty.astype(np.uint64), "span": empty.astype(np.uint64)}
    if n < length:
        return none
    total, inverse = sums(values), powers(n + 1)[1]
    grams = mix((total[k:] - total[:-k]) * inverse[: n - k + 1])
    order = (grams & np.uint64(~LOW & (2**64 - 1))) | np.arange(n - k + 1, dtype=np.uint64)
    chosen = least(order, length - k + 1)
    ends = np.repeat(bounds[1:], np.diff(bounds))
    starts = np.flatnonzero(np.arange(n - length + 1) + length <= ends[: n - length + 1])
    if not len(starts):
        return none
    at = (chosen[starts] & np.uint64(LOW)).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    heads = np.flatnonzero(new)
    first, last, at = starts[heads], starts[np.append(heads[1:], len(starts)) - 1], at[heads]
    span = mix((total[last + length] - total[first]) * inverse[first] + (last - first).astype(np.uint64))
    seq = np.searchsorted(bounds, first, side="right") - 1
    # Least hashes crowd at the low end; mixed once more they are even, as ranges of them must be.
    return {"seq": seq, "at": at, "first": first, "last": last, "anchor": mix(grams[at]), "span": span}


def settle(right: Callable[[int], np.ndarray], left: Callable[[int], np.ndarray], low: np.ndarray, high: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(record, offset) of each window that a record of lower rank holds too.

    A record is an anchor and what stands around it; low, high: the offsets that the anchor has in the record's
    windows. A window equals another of the same offset if both the part from the anchor on and the part before
    it are the same. right(offset): a class (or hash) of the anchor and what follows it in a window of that
    offset; left(i): hashes of the elements i to the left of the anchors.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    before = np.zeros(len(low), np.uint64)
    for offset in range(int(high.max(initial=-1)) + 1):
        if offset:
            before = mix(before * np.uint64(BASE) + left(offset))
        own = np.flatnonzero((low <= offset) & (offset <= high))
        if len(own) < 2:
            continue
        key = mix(before[own] ^ (right(offset)[own].astype(np.uint64) * np.uint64(BASE)))
        order = np.argsort(key)
        key, who = key[order], own[order]
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        best = np.repeat(np.minimum.reduceat(rank[who], heads), np.diff(np.append(heads, len(who))))
        hit = who[rank[who] > best]
        found.append((hit, np.full(len(hit), offset)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def ranges(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of consecutive `at` of equal key: key, first, last."""
    order = np.lexsort((at, key))
    key, at = key[order], at[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (at[1:] > at[:-1] + 1)
    heads = np.flatnonzero(new)
    return key[heads], at[heads], at[np.append(heads[1:], len(at)) - 1] if len(at) else at


def covered(size: int, firsts: list[int], lasts: list[int], length: int) -> np.ndarray:
    """Whether each of `size` elements lies in a window that starts in one of the ranges."""
    change = np.zeros(size + 1, np.int32)
    np.add.at(change, np.asarray(firsts, np.int64), 1)
    np.add.at(change, np.asarray(lasts, np.int64) + length, -1)
    return np.cumsum(change[:-1]) > 0


def spans(gone: np.ndarray) -> list[dict[str, int]]:
    """Maximal runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
    return [{"start": int(a), "stop": int(b)} for a, b in edges.reshape(-1, 2)]

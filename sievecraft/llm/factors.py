"""Strings of a block of texts that occur again: suffix order and longest-previous-factor arrays, in numpy."""

from __future__ import annotations

import numpy as np


#: Symbols that the first key of a position holds: 257 ** PACKED is below 2 ** 63.
PACKED = 6


def _dense(keys: np.ndarray) -> np.ndarray:
    """Rank of each key, equal keys alike. About 30 bytes for each key at most."""
    ranks = np.zeros(len(keys), np.int32)
    if len(keys):
        order = np.argsort(keys)  # ties in any order
        ordered = keys[order]
        changes = ordered[1:] != ordered[:-1]
        del ordered
        ranks[order[1:]] = np.cumsum(changes, dtype=np.int32)
    return ranks


def ranks_by_prefixes(text: np.ndarray, depth: int) -> list[tuple[int, np.ndarray]]:
    """(length, rank of every position by its next so many bytes), by prefix doubling up to ``depth``; the end of the text is smaller than any byte."""
    n = len(text)
    have = min(PACKED, depth)
    keys = np.zeros(n, np.int64)
    for k in range(have):
        keys *= 257
        keys[: max(0, n - k)] += text[k:].astype(np.int16) + np.int16(1)
    levels = [(have, _dense(keys))]
    while have < depth and n and levels[-1][1].max() < n - 1:
        ranks, step = levels[-1][1], min(have, depth - have)
        keys = ranks.astype(np.int64)
        keys *= n + 1
        keys[: max(0, n - step)] += ranks[step:] + 1
        have += step
        levels.append((have, _dense(keys)))
    return levels


def ranks_by_prefix(text: np.ndarray, depth: int) -> np.ndarray:
    return ranks_by_prefixes(text, depth)[-1][1]


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the nearest place before it with a smaller value, or -1.

    All places look at once: what is not smaller hands on where it has got to itself, which never jumps over a smaller value.
    """
    at = np.arange(-1, len(values) - 1)
    open_ = np.arange(len(values))
    while True:
        open_ = open_[at[open_] >= 0]
        open_ = open_[values[at[open_]] >= values[open_]]
        if not len(open_):
            return at
        at[open_] = at[at[open_]]


def _common(a: np.ndarray, b: np.ndarray, text: np.ndarray, levels: list[tuple[int, np.ndarray]], most: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at each a and b, at most ``most``; both have so many bytes, or the text ends."""
    n = len(text)
    done = np.zeros(len(a), np.int64)

    def step(length: int, same) -> None:
        x, y = a + done, b + done
        fits = (x < n) & (y < n) & (done + length <= most) & (np.maximum(x, y) + length <= n)
        at = np.flatnonzero(fits)
        done[at[same(x[at], y[at])]] += length

    for length, ranks in reversed(levels):
        step(length, lambda x, y, ranks=ranks: ranks[x] == ranks[y])
    for _ in range(levels[0][0]):
        step(1, lambda x, y: text[x] == text[y])
    return done


def factors(text: np.ndarray, places: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous and longest next factor of each of the ``places`` (ascending), among the places, cut at ``most`` bytes.

    In suffix order the longest match that starts before a place is with its previous or its next smaller place in that
    order, and the longest that starts behind it with the previous or next larger one.
    """
    if not len(places):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    levels = ranks_by_prefixes(text, most)
    order = places[np.argsort(levels[-1][1][places].astype(np.int64) * len(text) + places)]
    found = []
    for sign in (1, -1):
        longest = np.zeros(len(order), np.int64)
        for direction in (slice(None), slice(None, None, -1)):
            along = order[direction]
            nearest = previous_smaller(sign * along)
            has = np.flatnonzero(nearest >= 0)
            common = np.zeros(len(order), np.int64)
            common[has] = _common(along[has], along[nearest[has]], text, levels, most)
            longest = np.maximum(longest, common[direction])
        by_place = np.zeros(len(places), np.int64)
        by_place[np.searchsorted(places, order)] = longest
        found.append(by_place)
    return found[0], found[1]


def longest_previous_factor(text: bytes) -> np.ndarray:
    """For each position the length of its longest match that starts earlier (matches may overlap)."""
    return factors(np.frombuffer(text, np.uint8), np.arange(len(text)), max(1, len(text)))[0]


def repeats(parts: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places in the concatenated parts whose next ``least`` bytes, inside their part, occur at another place.

    Result: starts of the parts; has_previous and has_any for each byte: whether its longest previous factor, or that or its longest next one, has ``least`` bytes.
    """
    sizes = np.array([len(p) for p in parts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(parts) else np.zeros(0, np.int64)
    text = np.frombuffer(b"".join(parts), np.uint8)
    left = np.repeat(starts + sizes, sizes) - np.arange(len(text))  # bytes to the end of the part
    places = np.flatnonzero(left >= least)
    previous, other = np.zeros(len(text), bool), np.zeros(len(text), bool)
    earlier, later = factors(text, places, least)
    previous[places] = earlier >= least
    other[places] = np.maximum(earlier, later) >= least
    return starts, previous, other

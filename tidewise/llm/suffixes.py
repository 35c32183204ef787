"""Suffix arrays in numpy: Larsson-Sadakane refinement, of all suffixes or of some to a depth, and Kasai's common prefixes, over whole arrays."""

from __future__ import annotations

import numpy as np


def joined(sequences: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """All sequences in one array, each followed by a separator of its own (from `least` on), and where each begins."""
    lengths = np.fromiter((len(s) for s in sequences), np.int64, len(sequences))
    begins = np.cumsum(lengths + 1) - lengths - 1
    symbols = np.empty(int((lengths + 1).sum()), np.int64)
    if len(sequences):
        inside = np.ones(len(symbols), bool)
        inside[begins + lengths] = False
        symbols[inside] = np.concatenate(sequences)
        symbols[~inside] = least + np.arange(len(sequences))
    return symbols, begins


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order, and the place of each in that order. Symbols are integers from 0; the end sorts before all.

    Suffixes are first grouped by as many symbols as fit into 62 bits. Each round sorts the suffixes of groups that have more
    than one by the group of the suffix as far on as the group is deep, which doubles the depth; finished suffixes are left alone.
    """
    n = len(symbols)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    bits = max(int(symbols.max() + 1).bit_length(), 1)
    depth = max(62 // bits, 1)
    key = np.zeros(n, np.int64)
    for k in range(min(depth, n)):
        key[: n - k] |= (symbols[k:] + 1) << (bits * (depth - 1 - k))
    order = np.argsort(key, kind="stable")
    group = np.empty(n + 1, np.int64)
    group[n] = -1
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = key[order[1:]] != key[order[:-1]]
    heads = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    group[order] = heads
    live = _unsorted(new)
    while len(live):
        suffixes, heads = order[live], group[order[live]]
        onward = group[np.minimum(suffixes + depth, n)] + 1
        key = heads * (n + 1) + onward
        by = np.argsort(key)
        key, suffixes = key[by], suffixes[by]
        order[live] = suffixes
        new = np.empty(len(live), bool)
        new[0] = True
        new[1:] = key[1:] != key[:-1]
        group[suffixes] = np.maximum.accumulate(np.where(new, live, 0))
        live = live[_unsorted(new)]
        depth *= 2
    return order, group[:n]


def _unsorted(new: np.ndarray) -> np.ndarray:
    """Places in groups of more than one, where `new` marks the first of each group."""
    alone = new.copy()
    alone[:-1] &= new[1:]
    return np.flatnonzero(~alone)


def suffixes_to(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings of `length` bytes at some `starts` of a byte array: the rank of each start (equal strings have one rank), and
    which of them are equal to another. What both arrays hold for other places has no meaning.

    Refinement as in `suffix_array`, but it ends at `length`, each round puts as many ranks side by side as fit into 64 bits, and
    sorts only the suffixes whose ranks later rounds look up: in the last those at `starts`, before it also those onward of them.
    """
    n = len(data)
    rank, repeated = np.zeros(n, np.uint64), np.zeros(n, bool)
    if not len(starts):
        return rank, repeated
    bits = n.bit_length()
    depths = [min(8, length)]
    while depths[-1] < length:
        depths.append(min(depths[-1] * (64 // bits), length))
    needed = np.zeros(n, bool)
    needed[starts] = True
    rounds = []
    for depth, goal in zip(depths[-2::-1], depths[:0:-1], strict=True):
        onward = [*range(depth, goal - depth, depth), goal - depth]
        rounds.append((needed, onward))
        before = needed.copy()
        for k in onward:
            before[k:] |= needed[:-k]
        needed = before
    order = np.flatnonzero(needed)
    slots = np.arange(len(order))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.ndarray(n, ">u8", padded, strides=(1,))[order].astype(np.uint64) >> np.uint64(64 - 8 * depths[0])
    slots, order = _refined(key, slots, order, rank)
    for needed, onward in reversed(rounds):
        keep = needed[order]
        slots, order = slots[keep], order[keep]
        key = rank[order]
        for k in onward:
            key = key << np.uint64(bits) | rank[order + k]
        slots, order = _refined(key, slots, order, rank)
    repeated[order] = True
    return rank, repeated


def _refined(key: np.ndarray, slots: np.ndarray, order: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort suffixes by key into their slots and rank each by the first slot of its group; slots and suffixes of groups of more than one."""
    by = np.argsort(key)
    key, order = key[by], order[by]
    new = np.ones(len(order), bool)
    new[1:] = key[1:] != key[:-1]
    rank[order] = np.maximum.accumulate(np.where(new, slots, 0)).astype(np.uint64)
    live = _unsorted(new)
    return slots[live], order[live]


def common_prefixes(symbols: np.ndarray, order: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For each place in the order the length of the prefix that its suffix shares with the one before (0 at the first).

    Kasai's rule in the order of the text: where the symbols before a suffix and before its neighbour agree, the length is that
    of the suffix one to the left less one. Only the others are compared, several symbols at a time.
    """
    n = len(symbols)
    if n == 0:
        return np.empty(0, np.int64)
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    follows = np.zeros(n, bool)
    follows[1:] = (before[1:] > 0) & (symbols[np.maximum(before[1:], 1) - 1] == symbols[:-1]) & (before[:-1] >= 0)
    own = np.flatnonzero(~follows & (before >= 0))
    length = np.zeros(n, np.int64)
    bits = max(int(symbols.max() + 1).bit_length(), 1)
    width = max(62 // bits, 1)
    key = np.zeros(n + 1, np.int64)
    for k in range(min(width, n)):
        key[: n - k] |= (symbols[k:] + 1) << (bits * (width - 1 - k))
    a, b, at = own, before[own], own
    while len(at):
        same = (key[a] == key[b]) & (a < n) & (b < n)
        at, a, b = at[same], np.minimum(a[same] + width, n), np.minimum(b[same] + width, n)
        length[at] += width
    a, b, at = own + length[own], before[own] + length[own], own
    for _ in range(width):
        same = (a < n) & (b < n)
        at, a, b = at[same], a[same], b[same]
        same = symbols[a] == symbols[b]
        at, a, b = at[same], a[same] + 1, b[same] + 1
        length[at] += 1
    start = np.maximum.accumulate(np.where(follows, 0, np.arange(n)))
    return (length[start] - (np.arange(n) - start))[order]

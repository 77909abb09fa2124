"""Suffix arrays over word numbers, and searches in them for many queries at once. 0 marks a break between texts."""

import numpy as np


def suffix_array(ids: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` in the order of the first ``depth`` words from there on. As many words as fit are packed into one number to
    sort by; only suffixes that are still equal to others are sorted by the next words."""
    bits = max(1, int(ids.max(initial=0)).bit_length())
    each = max(1, 62 // bits)
    padded = np.concatenate([ids, np.zeros(depth + each, np.int64)])
    order, group, active, done = starts.astype(np.int64), np.zeros(starts.size, np.int64), np.arange(starts.size), 0
    while done < depth and active.size:
        places = order[active]
        key = np.zeros(places.size, np.int64)
        for k in range(done, done + each):
            key = (key << bits) | padded[places + k]
        by = np.lexsort((key, group[active])) if done else np.argsort(key, kind="stable")
        order[active], key = places[by], key[by]
        groups = group[active]
        first = np.ones(active.size, bool)
        first[1:] = (groups[1:] != groups[:-1]) | (key[1:] != key[:-1])
        group[active] = active[np.maximum.accumulate(np.where(first, np.arange(active.size), 0))]
        last = np.ones(active.size, bool)
        last[:-1] = first[1:]
        active = active[~(first & last)]
        done += each
    return order


def narrow(
    ids: np.ndarray, order: np.ndarray, words: np.ndarray, low: np.ndarray, high: np.ndarray, depth: np.ndarray | int
) -> tuple[np.ndarray, np.ndarray]:
    """From the ranges of suffixes that share ``depth`` words with each query to those that also share the next one. All
    queries are searched in step."""

    def bound(right: bool) -> np.ndarray:
        a, b = low.copy(), high.copy()
        while (open_ := a < b).any():
            middle = (a + b) >> 1
            at = np.minimum(order[np.minimum(middle, order.size - 1)] + depth, ids.size - 1)
            goes_on = (ids[at] <= words) if right else (ids[at] < words)
            # Behind the last word there is only a break.
            beyond = order[np.minimum(middle, order.size - 1)] + depth >= ids.size
            goes_on |= beyond
            a = np.where(open_ & goes_on, middle + 1, a)
            b = np.where(open_ & ~goes_on, middle, b)
        return a

    return bound(False), bound(True)


def spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges, and the number of the range each is from."""
    sizes = high - low
    owner = np.repeat(np.arange(low.size), sizes)
    offset = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return low[owner] + offset, owner

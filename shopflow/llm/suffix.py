"""Two-stage suffix sorting of a byte buffer, in numpy.

Suffixes smaller than their successor are sorted directly; all others follow by one scan over the
first-byte buckets: a suffix's place among the larger ones is the place of its successor. Orders
are exact to ``DEPTH`` bytes, which is what the search for common ``WINDOW``-byte strings needs.
"""

from __future__ import annotations

import numpy as np

WINDOW = 50
WORDS = 7            # eight-byte words that the direct sort compares
DEPTH = 8 * WORDS
END = 0xFF           # ends each string; never a byte of UTF-8


def _words(text: np.ndarray) -> np.ndarray:
    """Big-endian eight-byte word at every position."""
    padded = np.concatenate([text, np.zeros(DEPTH + 8, np.uint8)])
    out = np.zeros(len(padded) - 7, np.uint64)
    for k in range(8):
        out |= padded[k:len(out) + k].astype(np.uint64) << np.uint64(56 - 8 * k)
    return out


def is_smaller_than_next(text: np.ndarray) -> np.ndarray:
    """For each suffix whether it is smaller than the one that begins a byte later (the empty
    one is smallest)."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1].astype(np.int16))
    step[-1] = -1
    at = np.where(step != 0, np.arange(n), n)
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0  # equal bytes: as the next differing pair


def suffix_array(text: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
    """Suffixes in order of their first ``DEPTH`` bytes at least."""
    n = len(text)
    if not n:
        return np.empty(0, np.int64)
    words = _words(text) if words is None else words
    small = is_smaller_than_next(text)
    direct = np.flatnonzero(small)
    direct = direct[np.lexsort([words[direct + 8 * k] for k in range(WORDS - 1, -1, -1)])]
    cuts = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []

    def push(suffixes: np.ndarray, c: int) -> np.ndarray:
        """Scan ``suffixes`` of bucket ``c``: their larger predecessors go to the buckets of their
        first bytes, in this order; those of bucket ``c`` itself are returned."""
        before = suffixes[suffixes > 0] - 1
        before = before[~small[before]]
        first = text[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        starts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]])) if len(first) else []
        own = before[:0]
        for a, b in zip(starts, [*starts[1:], len(first)]):
            if first[a] == c:
                own = before[a:b]
            else:
                waiting[first[a]].append(before[a:b])
        return own

    waiting[text[n - 1]].append(np.array([n - 1]))  # what the empty suffix induces
    for c in range(256):
        queue = np.concatenate(waiting[c]) if waiting[c] else direct[:0]
        waiting[c] = []
        while len(queue):
            out.append(queue)
            queue = push(queue, c)
        bucket = direct[cuts[c]:cuts[c + 1]]
        if len(bucket):
            out.append(bucket)
            push(bucket, c)
    return np.concatenate(out)


def _hits(strings: list[bytes], owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted starts, in the joined strings, of the 50-byte windows that also occur in a string of a smaller
    owner (adjacent suffixes with 50 common bytes form a group, whose smallest owner keeps it), the string
    of each, and where the strings begin."""
    lengths = np.array([len(s) for s in strings])
    text = np.frombuffer(bytes([END]).join(strings) + bytes([END]), np.uint8)
    begins = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
    words = _words(text)
    order = suffix_array(text, words)
    home = np.repeat(np.arange(len(strings)), lengths + 1)
    order = order[order + WINDOW <= (begins + lengths)[home[order]]]
    if not len(order):
        return order, order, begins
    a, b = order[:-1], order[1:]
    same = np.ones(len(a), bool)
    for k in range(WINDOW // 8):
        same &= words[a + 8 * k] == words[b + 8 * k]
    rest = np.uint64(64 - 8 * (WINDOW % 8))
    same &= (words[a + WINDOW // 8 * 8] >> rest) == (words[b + WINDOW // 8 * 8] >> rest)
    firsts = np.flatnonzero(np.concatenate([[True], ~same]))
    owner = owners[home[order]]
    least = np.repeat(np.minimum.reduceat(owner, firsts), np.diff([*firsts, len(order)]))
    hit = np.sort(order[owner > least])
    return hit, home[hit], begins


def shared_windows(strings: list[bytes], owners: np.ndarray) -> list[np.ndarray]:
    """For each string the sorted starts of its windows that a string of a smaller owner holds too."""
    hit, home, begins = _hits(strings, owners)
    at = np.searchsorted(home, np.arange(len(strings) + 1))
    return [hit[x:y] - s for x, y, s in zip(at[:-1], at[1:], begins)]


def shared_runs(strings: list[bytes], owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, start, end) of the maximal stretches that those windows cover."""
    hit, home, begins = _hits(strings, owners)
    if not len(hit):
        return hit, hit, hit
    new = np.flatnonzero(np.concatenate([[True], (home[1:] != home[:-1]) | (np.diff(hit) > WINDOW)]))
    last = hit[np.append(new[1:], len(hit)) - 1]
    string = home[new]
    return string, hit[new] - begins[string], last + WINDOW - begins[string]

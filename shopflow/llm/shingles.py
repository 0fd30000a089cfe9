"""Word shingles of whole texts as 64-bit hashes, in numpy, for use inside Spark tasks."""

from __future__ import annotations

import hashlib

import numpy as np

MASK = (1 << 64) - 1


def _splitmix(seed: int, n: int) -> np.ndarray:
    out = []
    for _ in range(n):
        seed = (seed + 0x9E3779B97F4A7C15) & MASK
        z = seed
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & MASK
        out.append(z ^ (z >> 31))
    return np.array(out, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BASE = int(_splitmix(11, 1)[0]) | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = _splitmix(13, 64) | np.uint64(1)
_STATE: dict = {}


def _tables() -> dict:
    """Byte tables, built once in each worker process."""
    if "byte" not in _STATE:
        byte = _splitmix(7, 256)
        for c in range(65, 91):
            byte[c] = byte[c + 32]
        sep = np.zeros(256, dtype=bool)
        sep[[9, 10, 11, 12, 13, 32]] = True
        _STATE.update(byte=byte, sep=sep, power=np.ones(1, np.uint64), inverse=np.ones(1, np.uint64))
    return _STATE


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    t = _tables()
    if len(t["power"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("power", _BASE), ("inverse", _INVERSE)):
            full = np.full(size, base, np.uint64)
            full[0] = 1
            t[name] = np.cumprod(full)
    return t["power"], t["inverse"]


PRIME = (1 << 31) - 1
_BASES = [int(x) % (PRIME - 2) + 2 for x in _splitmix(17, 2)]


def _prime_powers(n: int) -> list:
    """For each base the powers and inverse powers below ``n``, modulo ``PRIME``."""
    t = _tables()
    if len(t.setdefault("prime", [(np.ones(1, np.uint64),) * 2] * 2)[0][0]) < n:
        grown = []
        for base in _BASES:
            pair = []
            for b in (base, pow(base, -1, PRIME)):
                x = np.ones(1, np.uint64)
                while len(x) < n:
                    x = np.concatenate([x, x * np.uint64(pow(b, len(x), PRIME)) % np.uint64(PRIME)])
                pair.append(x)
            grown.append(tuple(pair))
        t["prime"] = grown
    return t["prime"]


def _word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """62 bits of each word: polynomials of its bytes modulo a prime at two points. (Modulo a power of
    two, words of a regular pattern collide whatever the point.)"""
    out = []
    byte = _tables()["byte"] % np.uint64(PRIME - 1) + np.uint64(1)
    for power, inverse in _prime_powers(len(buf) + 1):
        term = byte[buf] * power[:len(buf)]
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((term & np.uint64(PRIME)) + (term >> np.uint64(31)), out=sums[1:])
        out.append((sums[ends] - sums[starts]) % np.uint64(PRIME) * inverse[starts] % np.uint64(PRIME))
    return mix((out[0] << np.uint64(31)) | out[1])


def shingle_sets(texts: list, width: int = 5) -> list[np.ndarray]:
    """For each text (UTF-8 bytes or None) the sorted distinct hashes of its ``width``-word
    shingles over A-Z-lower-cased words; shorter texts have one shingle, empty ones none."""
    t = _tables()
    out: list[np.ndarray] = [np.empty(0, np.uint64)] * len(texts)
    buf = np.frombuffer(b" ".join(x or b"" for x in texts) + b" ", np.uint8)
    sep = t["sep"][buf]
    word = np.empty(len(buf) + 1, np.int8)
    word[0], word[1:] = 0, ~sep
    step = np.diff(word)
    starts = np.flatnonzero(step == 1)
    if not len(starts):
        return out
    ends = np.flatnonzero(step == -1)
    words = _word_hashes(buf, starts, ends)
    # texts are joined by one space, so the text of a word follows from the texts' offsets
    firsts = np.cumsum([0] + [len(x or b"") + 1 for x in texts])
    bounds = np.searchsorted(starts, firsts)
    full = np.zeros(max(len(words) - width + 1, 0), np.uint64)
    for k in range(width):
        full += words[k:k + len(full)] * _PLACE[k]
    full = mix(full)
    for i in range(len(texts)):
        a, b = bounds[i], bounds[i + 1]
        if b - a >= width:
            s = np.sort(full[a:b - width + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out[i] = s[keep]
        elif b > a:
            short = (words[a:b] * _PLACE[8:8 + b - a]).sum(dtype=np.uint64, keepdims=True) + _PLACE[40 + b - a:41 + b - a]
            out[i] = mix(short)
    return out


def range_key(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Range (``bits`` bits) and 32 more bits of each hash, mixed again: the smallest hashes of a
    text would else crowd the lowest ranges."""
    return mix(hashes + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32 - bits)


def set_digest(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a shingle set, as two signed 64-bit numbers."""
    d = hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)

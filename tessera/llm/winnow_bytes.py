"""Winnowed fingerprints of byte strings: every window of ``window`` bytes is owned by one of its grams."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

WINDOW, GRAM = 50, 16
#: Documents are read in pieces, so that a place fits the low bits of a key. Windows never cross pieces unseen: pieces overlap.
PLACE_BITS = 20
PIECE = (1 << PLACE_BITS) - 64
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd, so that they have inverses modulo 2^64


@lru_cache(maxsize=2)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0 .. base^n and their inverses, modulo 2^64."""
    up = np.full(n + 1, base, np.uint64)
    down = np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(32))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def owned_windows(raw: bytes, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, context, first, last) of each selected gram: it owns the windows that begin at first .. last. Equal
    windows are owned by equal grams at the same place in them; ``context`` is a hash of all bytes of the owned windows."""
    parts = []
    for start in range(0, max(1, len(raw) - window + 1), PIECE - window + 1):
        text = np.frombuffer(raw, np.uint8, min(PIECE, len(raw) - start), start)
        n = len(text)
        if n < window:
            continue
        up, down = _powers(_BASES[0], PIECE)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        grams = mixed((sums[gram:] - sums[: n - gram + 1]) * down[: n - gram + 1])
        keys = (grams >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(len(grams), dtype=np.uint64)
        least = sliding_min(keys, window - gram + 1)
        first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        last = np.r_[first[1:] - 1, len(least) - 1]
        place = (least[first] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        body = mixed((sums[last + window] - sums[first]) * down[first])
        context = mixed(body ^ ((place - first).astype(np.uint64) * np.uint64(_BASES[1])) ^ ((last - first).astype(np.uint64) << np.uint64(40)))
        parts.append((grams[place], context, first + start, last + start))
    if not parts:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

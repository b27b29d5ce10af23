"""64-bit hashes of words and of runs of five words, in numpy over a whole text."""

from __future__ import annotations

import numpy as np

WIDTH = 5

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_P = np.uint64(0x100000001B3)
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_powers = [np.cumprod(np.full(256, _P))]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(text: str | None) -> np.ndarray:
    """A hash per word (runs of anything but ASCII white space), in order."""
    return spans(text)[0]


def spans(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Hashes of the words, their start and end bytes, and the bytes of the text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    full = ~_BLANK[data]
    edge = np.diff(full.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends, raw
    size = ends - starts
    if (longest := int(size.max())) > len(_powers[0]):
        _powers[0] = np.cumprod(np.full(2 * longest, _P))
    # The bytes of words alone, with their place in their word.
    firsts = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(firsts, size)
    value = (data[full].astype(np.uint64) + np.uint64(1)) * _powers[0][place]
    return mix(np.add.reduceat(value, firsts) + size.astype(np.uint64)), starts, ends, raw


def together(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of several texts after each other, and the number of each word's text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    begin = np.cumsum([0] + [len(r) + 1 for r in raw[:-1]])
    hashes, starts, _, _ = spans("\n".join(texts))
    return hashes, np.searchsorted(begin, starts, "right") - 1


def of_words(w: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """A hash per run of ``width`` words, in order; of 1 to width-1 words, one over all."""
    n = len(w)
    if not n:
        return w
    short, width = n < width, min(n, width)
    total = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        total += mix(w[k : n - width + 1 + k] ^ _STEPS[k]) * _STEPS[k]
    return mix(total + np.uint64(n if short else 0))

"""Hashes of runs of code points: all of a text's, and the few that stand for it in a join."""

from __future__ import annotations

import numpy as np

_BASE = np.array([0x9E3779B97F4A7C15], dtype=np.uint64)
#: Code points of a run, and neighbouring runs of which the one with the smallest hash is chosen.
RUN, NEIGHBOURS = 8, 9
#: A string of so many code points holds a chosen run, which every text that holds the string has chosen, too.
SURE = RUN + NEIGHBOURS - 1


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def rolling(codes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of `width` code points, by doubling: the hash of 2k is that of its halves."""
    out = np.zeros(max(0, len(codes) - width + 1), dtype=np.uint64)
    part, size, done, power = codes.astype(np.uint64) + np.uint64(1), 1, 0, _BASE
    while size <= width:
        if width & size:
            out = out * power + part[done : done + len(out)]
            done += size
        part = part[: max(0, len(part) - size)] * power + part[size:]
        size, power = 2 * size, power * power
    return out


def chosen(text: str) -> np.ndarray:
    """The different hashes that are the smallest of some NEIGHBOURS in a row, as int64; none for texts under SURE code points."""
    h = rolling(code_points(text), RUN)
    if len(h) < NEIGHBOURS:
        return np.zeros(0, dtype=np.int64)
    h ^= h >> np.uint64(29)
    least = h * _BASE  # low digits of a polynomial are poor; spread before comparing
    two = np.minimum(least[:-1], least[1:])
    four = np.minimum(two[:-2], two[2:])
    eight = np.minimum(four[:-4], four[4:])
    return np.unique(np.minimum(eight[:-1], eight[1:])).view(np.int64)

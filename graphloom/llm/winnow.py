"""Winnowed anchors over a sequence of hashed units (words or lines) of many documents.

A gram is ``gram`` consecutive units; in each stretch of ``window`` grams the smallest hash (the
leftmost of equals) is an anchor. The choice depends on the stretch alone, so two equal runs of
``gram + window - 1`` units have an anchor at the same place: such runs are found for certain.

The units of a batch of documents stand in one array, with ``ends`` giving for each unit the end of
its document.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd

_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def hashed(units: list[bytes]) -> np.ndarray:
    """64-bit SipHash of each unit, the same in every process."""
    if not units:
        return np.zeros(0, np.uint64)
    array = np.empty(len(units), object)
    array[:] = units
    return pd.util.hash_array(array, categorize=False)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=4)
def _powers(which: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a multiplier and of its inverse modulo 2^64."""
    by = _MULTIPLIERS[which]
    return tuple(np.cumprod(np.r_[np.uint64(1), np.full(size, x, np.uint64)]) for x in (by, pow(by, -1, 1 << 64)))


class Rolling:
    """Hashes of stretches of ``units`` of any length: a polynomial in the multiplier, from prefix sums."""

    def __init__(self, units: np.ndarray, which: int = 0):
        self.n = len(units)
        up, self.down = _powers(which, 1 << max(10, int(self.n).bit_length()))
        self.sums = np.cumsum(np.r_[np.uint64(0), units * up[: self.n]])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the units from each ``begin`` to before each ``end``."""
        return mixed((self.sums[end] - self.sums[begin]) * self.down[begin])

    def all(self, length: int) -> np.ndarray:
        """Hash of every ``length`` consecutive units, by starting place."""
        n = max(0, self.n - length + 1)
        return mixed((self.sums[length : length + n] - self.sums[:n]) * self.down[:n])


def rolled(units: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Hash of every ``length`` consecutive units, by starting place."""
    return Rolling(units, which).all(length)


def ends_of(lengths: np.ndarray) -> np.ndarray:
    return np.repeat(np.cumsum(lengths), lengths)


def anchored(units: Rolling, ends: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all runs of ``gram + window - 1`` units in one document, the anchor of each, and all gram hashes."""
    run = gram + window - 1
    if units.n < run:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    grams = units.all(gram)
    starts = np.flatnonzero(np.arange(run, units.n + 1) <= ends[: units.n - run + 1])
    smallest = np.lib.stride_tricks.sliding_window_view(grams, window).argmin(axis=1)
    return starts, starts + smallest[starts], grams


def distinct(sorted_places: np.ndarray) -> np.ndarray:
    """The places of anchors without repeats; anchors never go back as runs go on."""
    if not len(sorted_places):
        return sorted_places
    return sorted_places[np.r_[True, sorted_places[1:] != sorted_places[:-1]]]


def covered(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of n units lie in a run of ``length`` at one of ``starts``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, n), -1)
    return np.cumsum(edge[:-1]) > 0

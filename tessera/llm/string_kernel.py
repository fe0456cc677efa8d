"""Gap-weighted subsequence string kernel, vectorised over many short strings.

Two strings are alike by the subsequences of three letters they share; an occurrence weighs
DECAY ** (letters it spans), so gaps and inserted characters cost little. Spans are at most SPAN letters.
A letter said several times in a row counts once, so stretched words are read as the plain ones.
"""

from __future__ import annotations

import re

import numpy as np

DECAY, SPAN = 0.85, 7
SYMBOLS = 32
#: Units compared at once: each takes about 100 rows of as many numbers as there are landmarks.
STEP = 500
#: Look-alike characters read as letters (fixed values).
ALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})
EDGE = 31


_RUN = re.compile(r"(.)\1+", re.S)


def letters(word: str) -> str:
    """The letters of a lower-case word, runs of one letter as one; look-alikes count as letters between letters. Words without a letter give ''."""
    if not word.isalpha():
        if not any(map(str.isalpha, word)):
            return ""
        word = "".join(filter(str.isalpha, word.rstrip(".,;:!?|$").translate(ALIKE)))
    return _RUN.sub(r"\1", word)


def codes(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all units with an edge at both ends, unit of each symbol). Letters beyond a-z share four symbols."""
    joined = "".join(f"\x00{u}\x00" for u in units)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
    symbol = np.where((points >= 97) & (points <= 122), points - 97, 26 + points % 4)
    symbol[points == 0] = EDGE
    sizes = np.fromiter((len(u) + 2 for u in units), np.int64, len(units))
    return symbol, np.repeat(np.arange(len(units)), sizes)


def subsequences(units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, feature, weight), a row for each distinct subsequence of each unit, sorted by unit."""
    symbol, unit = codes(units)
    n, keys, weights = len(symbol), [], []
    for b in range(2, SPAN):
        if n <= b:
            break
        same = unit[:-b] == unit[b:]
        at = np.flatnonzero(same)
        ends = unit[at] * SYMBOLS**3 + symbol[at] * SYMBOLS**2 + symbol[at + b]
        for a in range(1, b):
            keys.append(ends + symbol[at + a] * SYMBOLS)
            weights.append(np.full(len(at), DECAY ** (b + 1)))
    key, weight = np.concatenate([*keys, np.zeros(0, np.int64)]), np.concatenate([*weights, np.zeros(0)])
    if not len(key):
        return key, key, weight
    order = np.argsort(key)
    key, weight = key[order], weight[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    weight = np.add.reduceat(weight, first)
    key = key[first]
    return key // SYMBOLS**3, key % SYMBOLS**3, weight


def normalised(units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """subsequences() with each unit's weights at length one."""
    unit, feature, weight = subsequences(units)
    norm = np.sqrt(np.bincount(unit, weights=weight**2, minlength=len(units)))
    return unit, feature, weight / norm[unit]


class Landmarks:
    """Strings to compare others with."""

    def __init__(self, strings: list[str]):
        unit, feature, weight = normalised(strings)
        used, column = np.unique(feature, return_inverse=True)  # other subsequences add nothing to a product
        self.place = np.full(SYMBOLS**3, -1, np.int32)
        self.place[used] = np.arange(len(used))
        self.weights = np.zeros((len(used), len(strings)), np.float32)
        self.weights[column, unit] = weight

    def kernel(self, units: list[str], step: int = STEP) -> np.ndarray:
        """The normalised kernel of each unit with each landmark."""
        out = np.zeros((len(units), self.weights.shape[1]), np.float32)
        for at in range(0, len(units), step):
            unit, feature, weight = normalised(units[at : at + step])
            column = self.place[feature]
            kept = column >= 0
            unit, column, weight = unit[kept], column[kept], weight[kept].astype(np.float32)
            if len(unit):
                first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
                rows = self.weights[column]
                rows *= weight[:, None]
                out[at + unit[first]] = np.add.reduceat(rows, first, axis=0)
        return out

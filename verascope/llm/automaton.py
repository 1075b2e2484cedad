"""A generalised suffix automaton of many word sequences, to a bounded depth, built by numpy.

A state of a suffix automaton is a class of substrings that end at the same places; its suffix link leads to the
class of the longest suffix that ends at more places. The suffixes of a place, from the shortest on, therefore walk
up a chain of links: each one more word to the left refines the set of places. Refining all places at once, word by word
to the left, gives the substrings of each length with their end-place counts, and merging those of equal count along the
chain gives the states; no loop over words is needed, and transitions, which only an online construction needs, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np


@dataclass
class Level:
    """Substrings of one length: count of end places, one end place, and the suffix that is a word shorter (its number in the level below)."""

    count: np.ndarray
    place: np.ndarray
    suffix: np.ndarray


def levels(words: np.ndarray, run: np.ndarray, depth: int) -> Iterator[Level]:
    """The substrings of one word, of two, and so on; a level needs only the one before.

    words: numbers of all words in order; run: for each word, how many words up to it, itself included, hang together.
    """
    size = int(words.max()) + 1 if len(words) else 1
    node = np.zeros(len(words), np.int32)
    ends = np.arange(len(words), dtype=np.int32)
    for k in range(1, depth + 1):
        ends = ends[run[ends] >= k]
        key = node[ends].astype(np.int64)
        below = node[ends]
        key *= size
        key += words[ends - k + 1]
        order = np.argsort(key, kind="stable").astype(np.int32)
        key = key[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new).astype(np.int32)
        del key
        node[ends[order]] = np.cumsum(new, dtype=np.int32) - 1
        count = np.diff(first, append=np.int32(len(order)))
        first = order[first]
        del order, new
        yield Level(count, ends[first], below[first])


class SuffixAutomaton:
    """All levels at once, and the states that they make."""

    def __init__(self, words: np.ndarray, run: np.ndarray, depth: int) -> None:
        self.levels = list(levels(words, run, depth))

    def states(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each level: whether a substring is its state's longest, and the length of the state that its suffix link leads to.

        A substring that another one extends to the left with the same count is of that one's state.
        """
        longest, link = [np.ones(len(x.count), bool) for x in self.levels], []
        for k, x in enumerate(self.levels):
            if k:
                below = self.levels[k - 1]
                same = below.count[x.suffix] == x.count
                longest[k - 1][x.suffix[same]] = False
                link.append(np.where(same, link[-1][x.suffix], k))
            else:
                link.append(np.zeros(len(x.count), np.int64))
        return longest, link

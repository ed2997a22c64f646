"""A suffix automaton over sequences of hashed words."""

from __future__ import annotations

from collections.abc import Sequence


class SuffixAutomaton:
    """Recognises every run of words that stands in one of the sequences added so far."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, words: Sequence[int]) -> None:
        """Adds a sequence; runs never reach across sequences."""
        following, link, length = self.next, self.link, self.length
        last = 0
        for word in words:
            at = following[last].get(word)
            if at is not None and length[at] == length[last] + 1:
                last = at  # known from an earlier sequence
                continue
            if at is not None:
                last = self._split(last, word, at)
                continue
            new = len(following)
            following.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and word not in following[p]:
                following[p][word] = new
                p = link[p]
            if p >= 0:
                q = following[p][word]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, word, q)
            last = new

    def _split(self, p: int, word: int, q: int) -> int:
        """A copy of state ``q`` for its shorter runs, those that continue state ``p``."""
        following, link, length = self.next, self.link, self.length
        copy = len(following)
        following.append(following[q].copy())
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and following[p].get(word) == q:
            following[p][word] = copy
            p = link[p]
        return copy

    def matches(self, words: Sequence[int]) -> list[int]:
        """Matching statistics: for each position the length of the longest known run that ends there."""
        following, link, length = self.next, self.link, self.length
        state = matched = 0
        out = []
        for word in words:
            while state and word not in following[state]:
                state = link[state]
                matched = length[state]
            to = following[state].get(word)
            if to is None:
                matched = 0
            else:
                state, matched = to, matched + 1
            out.append(matched)
        return out


def spans_above(matches: Sequence[int], threshold: int) -> list[tuple[int, int]]:
    """Maximal spans (start, end) of words in matches of at least ``threshold`` words."""
    out: list[tuple[int, int]] = []
    for end, matched in enumerate(matches, 1):
        if matched >= threshold:
            start = end - matched
            if out and start <= out[-1][1]:
                out[-1] = (min(start, out[-1][0]), end)
            else:
                out.append((start, end))
    return out

"""A suffix automaton over sequences of whole numbers, with the first place of every substring."""

from __future__ import annotations

from collections.abc import Sequence


class SuffixAutomaton:
    """Sequences are added in order. A state's ``first`` is the number of the symbol, counted over all
    sequences, at which the substrings of that state end for the first time."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]
        self.added = 0

    def _state(self, length: int, following: dict[int, int], link: int, first: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.length) - 1

    def _clone(self, p: int, symbol: int, q: int) -> int:
        """Splits off the strings of q that end p's by ``symbol``."""
        following, link = self.next, self.link
        clone = self._state(self.length[p] + 1, dict(following[q]), link[q], self.first[q])
        link[q] = clone
        while p >= 0 and following[p].get(symbol) == q:
            following[p][symbol] = clone
            p = link[p]
        return clone

    def add(self, sequence: Sequence[int]) -> None:
        following, link, length = self.next, self.link, self.length
        last = 0
        for symbol in sequence:
            q = following[last].get(symbol)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._clone(last, symbol, q)
            else:
                new = self._state(length[last] + 1, {}, 0, self.added)
                p = last
                while p >= 0 and symbol not in following[p]:
                    following[p][symbol] = new
                    p = link[p]
                if p >= 0:
                    q = following[p][symbol]
                    link[new] = q if length[p] + 1 == length[q] else self._clone(p, symbol, q)
                last = new
            self.added += 1

    def matches(self, sequence: Sequence[int], window: int) -> list[int]:
        """Streams a sequence for its matching statistics: for each run of ``window`` symbols the number of the symbol at
        which it ends for the first time, or -1 where the longest match is shorter."""
        following, link, length, first = self.next, self.link, self.length, self.first
        state, matched, out = 0, 0, []
        for i, symbol in enumerate(sequence):
            while state and symbol not in following[state]:
                state = link[state]
                matched = length[state]
            if symbol in following[state]:
                state = following[state][symbol]
                matched += 1
            while state and length[link[state]] >= window:  # the state of the last ``window`` symbols
                state = link[state]
                matched = length[state]
            if i >= window - 1:
                out.append(first[state] if matched >= window else -1)
        return out

    def whole(self, sequence: Sequence[int]) -> int:
        """The number of the symbol at which the whole sequence ends for the first time, or -1."""
        state = 0
        for symbol in sequence:
            if (state := self.next[state].get(symbol, -1)) < 0:
                return -1
        return self.first[state]

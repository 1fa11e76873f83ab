"""A suffix automaton over many sources: every substring of any of them is a path from its root, and each state knows the first source that holds its substrings."""

from __future__ import annotations

import functools


class Automaton:
    """Of sources in the order in which ties are settled. About 460 bytes a character."""

    def __init__(self, sources: tuple[str, ...]):
        self.length, self.link, self.next, self.first = [0], [-1], [{}], [len(sources)]
        for k, text in enumerate(sources):
            at = 0
            for c in text:
                at = self._longer(at, c)
                self.first[at] = min(self.first[at], k)
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):  # what a state's substrings end with stands in all its sources
            up = self.link[state]
            self.first[up] = min(self.first[up], self.first[state])

    def _state(self, length: int, link: int, following: dict[str, int]) -> int:
        for column, x in ((self.length, length), (self.link, link), (self.next, following), (self.first, self.first[0])):
            column.append(x)
        return len(self.length) - 1

    def _split(self, at: int, c: str) -> int:
        """The state that c leads to from at, for substrings no longer than at's and c; made of the longer ones' state if it is theirs too."""
        to = self.next[at][c]
        if self.length[to] == self.length[at] + 1:
            return to
        new = self._state(self.length[at] + 1, self.link[to], dict(self.next[to]))
        self.link[to] = new
        while at >= 0 and self.next[at].get(c) == to:
            self.next[at][c] = new
            at = self.link[at]
        return new

    def _longer(self, at: int, c: str) -> int:
        """The state of what the state `at` stands for, and c."""
        if c in self.next[at]:
            return self._split(at, c)
        new = self._state(self.length[at] + 1, 0, {})
        while at >= 0 and c not in self.next[at]:
            self.next[at][c] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._split(at, c)
        return new

    def best(self, text: str) -> tuple[int, str]:
        """The source (by its place) that shares the longest substring with a text, of several the first, and the substring, of several the earliest in the text; -1 and '' if nothing is shared. One walk over the text."""
        length, link, following, first = self.length, self.link, self.next, self.first
        state = size = most = end = 0
        source = -1
        for i, c in enumerate(text):
            to = following[state].get(c)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = following[state].get(c)
            if to is None:
                continue
            state, size = to, size + 1
            if size > most or (size == most and first[state] < source):
                most, source, end = size, first[state], i + 1
        return source, text[end - most : end]


@functools.lru_cache(maxsize=2)
def automaton(sources: tuple[str, ...]) -> Automaton:
    """Kept by a Python worker from task to task."""
    return Automaton(sources)

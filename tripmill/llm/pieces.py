"""Encoding by pieces: a vocabulary that never joins across a lone space is asked once a piece.

A text is cut only at a single space or line feed between two characters that are not white
space.  Byte-level vocabularies split there before any merge, so the counts of the pieces add
up to the count of the whole text, and a long text never reaches the library in one call.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence

# Python's white space includes all that the libraries take for it.
SAFE_CUT = re.compile(r"(?<=\S)(?= \S)")
# Marks that begin a piece of their own behind a letter.
MARKS = ".,;:!?"
# Characters of remembered pieces before a task starts its memory anew.
MEMORY_CHARS = 24_000_000
# Characters that go to the library in one call.
CALL_CHARS = 1 << 20


def is_regular(text: str, words: list[str]) -> bool:
    """White space is single spaces and line feeds between words only; words: text.split()."""
    breaks = text.count(" ") + text.count("\n")
    return len(words) == breaks + 1 and sum(map(len, words)) + breaks == len(text)


def line_starts(text: str) -> list[str]:
    return [line.split(" ", 1)[0] for line in text.split("\n")]


def closed_word(piece: str) -> bool:
    """Letters with one mark behind them: the vocabulary splits before the mark."""
    return len(piece) > 1 and piece[-1] in MARKS and piece[-2] < "\u0250" and piece[:-1].isalpha()


def calls(texts: Iterable[str]) -> Iterable[list[str]]:
    group: list[str] = []
    chars = 0
    for text in texts:
        if group and chars + len(text) > CALL_CHARS:
            yield group
            group, chars = [], 0
        group.append(text)
        chars += len(text)
    if group:
        yield group


class PieceCounter:
    """Token counts of texts, remembering the count of each piece up to a bound."""

    def __init__(self, counts: Callable[[list[str]], Sequence[int]]):
        self.counts = counts
        self.plain: dict[str, int] = {}
        self.spaced: dict[str, int] = {}
        self.chars = 0
        self.marks = dict(zip(MARKS, counts(list(MARKS))))

    def learn(self, memory: dict[str, int], texts: Iterable[str], prefix: str) -> None:
        missing = set(texts) - memory.keys()
        closed = {t for t in missing if closed_word(t)}
        stems = {t[:-1] for t in closed} - memory.keys()
        for group in calls((missing - closed) | stems):
            memory.update(zip(group, self.counts([prefix + t for t in group])))
            self.chars += sum(map(len, group))
        for t in closed:
            memory[t] = memory[t[:-1]] + self.marks[t[-1]]
            self.chars += len(t)

    def __call__(self, texts: Sequence[str]) -> list[int]:
        if self.chars > MEMORY_CHARS:
            self.plain, self.spaced, self.chars = {}, {}, 0
        cut = []
        plain, spaced = set("\n"), set()
        for text in texts:
            words = text.split()
            if is_regular(text, words):
                starts = line_starts(text)
                known = list(map(self.spaced.get, words))
                fresh = [w for w, n in zip(words, known) if n is None] if None in known else []
                spaced.update(fresh)
                cut.append((starts, fresh, sum(filter(None, known)), True))
            else:
                starts = SAFE_CUT.split(text)
                cut.append((starts, [], 0, False))
            plain.update(starts)
        self.learn(self.plain, plain, "")
        self.learn(self.spaced, spaced, " ")
        feed, plain, spaced = self.plain["\n"], self.plain.__getitem__, self.spaced.__getitem__
        # In a regular text every word but the first of a line has its space with it.
        return [
            known + sum(map(spaced, fresh)) + sum(plain(w) - spaced(w) for w in starts)
            + feed * (len(starts) - 1)
            if regular
            else sum(map(plain, starts))
            for starts, fresh, known, regular in cut
        ]

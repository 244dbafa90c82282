"""Cuts texts into cacheable pieces for a byte-level BPE vocabulary.

A piece is a run without white space together with one space before it, or a run of white
space; the vocabulary's splitting pattern never joins characters of two pieces, so that what
is known of a piece holds wherever it stands. Natural text repeats pieces, and each worker keeps
what it has learnt of them in a bounded cache.
"""

from __future__ import annotations

from collections.abc import Callable

import regex

#: White_Space of Unicode, which the vocabulary's pattern means by \s. Fixed values.
WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The splitting pattern of the public 50k byte-level vocabulary. Fixed values.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WS}\p{{L}}\p{{N}}]+|[{WS}]+(?![^{WS}])|[{WS}]+"
PRETOKEN = regex.compile(PATTERN)
PIECE = regex.compile(rf" ?[^{WS}]+|[{WS}]+(?![^{WS}])|[{WS}]+")
END = "<|endoftext|>"


def pieces(text: str) -> tuple[list[str], list[str]]:
    """(pieces as they are, pieces that a space precedes, without it); the latter come after the former.

    Where no two white-space characters meet, cutting at single spaces is exact and much faster
    than the pattern; the text is then as long as its words and what stands between them.
    """
    if len(" ".join(text.split())) != len(text):
        return PIECE.findall(text), []
    first, *rest = text.split(" ")
    return [first], rest


class Pieces:
    """Looks pieces up in two bounded caches.

    learn gives a value for each of new pieces; learn_spaced does so for pieces that a space
    precedes, which come without it and have no white space at their ends.
    """

    def __init__(self, learn: Callable[[list[str]], list], learn_spaced: Callable[[list[str]], list], bound: int):
        self.learners, self.bound = (learn, learn_spaced), bound
        self.bare: dict = {}
        self.spaced: dict = {}

    def forget(self) -> None:
        """For the end of a task: the worker may go on to another stage."""
        self.bare.clear()
        self.spaced.clear()

    def look_up(self, texts: list[str]) -> list[list]:
        """The values of each text's pieces, in order."""
        cuts = [pieces(t) for t in texts]
        if len(self.bare) > self.bound:
            self.bare.clear()
        if len(self.spaced) > self.bound:
            self.spaced.clear()
        for k, cache in enumerate((self.bare, self.spaced)):
            new = list(set().union(*(c[k] for c in cuts)).difference(cache))
            cache.update(zip(new, self.learners[k](new), strict=True))
        bare, spaced = self.bare.__getitem__, self.spaced.__getitem__
        return [[*map(bare, a), *map(spaced, b)] for a, b in cuts]


def batches(texts: list[str], chars: int = 4_000_000):
    """Consecutive slices of a list of texts, of about so many characters: (start, end)."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= chars:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)

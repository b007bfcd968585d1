"""What a text must hold for a pattern to hit at all: most patterns are passed over by a plain look for a few words or a digit."""

from __future__ import annotations

import functools
import re
from re import _constants as C
from re import _parser as parser

DIGIT = re.compile("[0-9]")


def _walk(items) -> tuple[frozenset | None, bool]:
    """(words of which one must occur, whether a digit must) for a parsed sequence; of several sets of words the one whose shortest is longest."""
    best, digit, run = None, False, ""

    def better(found) -> None:
        nonlocal best
        if found and min(map(len, found)) > 1 and (best is None or min(map(len, found)) > min(map(len, best))):
            best = frozenset(found)

    for op, value in items:
        if op is C.LITERAL:
            run += chr(value).lower()
            continue
        better({run} if run else None)
        run = ""
        if op is C.IN and value == [(C.RANGE, (48, 57))]:
            digit = True
        elif op is C.SUBPATTERN:
            words, inner = _walk(value[3])
            better(words)
            digit |= inner
        elif op is C.BRANCH:
            parts = [_walk(x) for x in value[1]]
            better(frozenset().union(*(w for w, _ in parts)) if all(w for w, _ in parts) else None)
            digit |= all(d for _, d in parts)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and value[0]:
            words, inner = _walk(value[2])
            better(words)
            digit |= inner
    better({run} if run else None)
    return best, digit


@functools.cache
def needs(pattern: str) -> tuple[tuple[str, ...], bool]:
    words, digit = _walk(parser.parse(pattern))
    return tuple(sorted(words or ())), digit


class Page:
    """A text with what is asked of it again and again."""

    def __init__(self, text: str):
        self.text, self.low, self.digit, self.known = text, text.lower(), DIGIT.search(text) is not None, {}

    def holds(self, word: str) -> bool:
        if word not in self.known:
            self.known[word] = word in self.low
        return self.known[word]

    def may_hit(self, pattern: str) -> bool:
        words, digit = needs(pattern)
        return (self.digit or not digit) and (not words or any(map(self.holds, words)))

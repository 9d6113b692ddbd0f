"""Many literals looked for in one pass over a text.

An Aho-Corasick automaton over all literals reads a text once, so the cost is the text's length and its hits, whatever the
number of literals. Rule packs ask it which of their rules can fit at all; only those run their expressions.
"""

from __future__ import annotations

from collections.abc import Iterable

import ahocorasick

#: Letters beyond ASCII that expressions without case take for ASCII letters, with those letters; fixed values.
FOLDS = {0x130: "i", 0x131: "i", 0x17F: "s", 0x212A: "k"}


def folded(text: str) -> str:
    """A text in lower case, such that whatever an expression without case takes for an ASCII literal holds that literal."""
    return text.lower() if text.isascii() else text.translate(FOLDS).lower()


class Literals:
    """A set of literals (ASCII, in lower case). The automaton is built where it is used: once a task, not once a text."""

    def __init__(self, literals: Iterable[str]):
        self.words = sorted({w for w in literals if w})
        self.automaton = None

    def __getstate__(self):
        return self.words

    def __setstate__(self, words):
        self.words, self.automaton = words, None

    def number(self, word: str) -> int:
        from bisect import bisect_left

        return bisect_left(self.words, word)

    def found(self, text: str) -> set[int]:
        """Numbers of the literals that a folded text holds."""
        if not self.words:
            return set()
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for i, w in enumerate(self.words):
                self.automaton.add_word(w, i)
            self.automaton.make_automaton()
        out: set[int] = set()
        for _, i in self.automaton.iter(text):
            out.add(i)
            if len(out) == len(self.words):
                break
        return out


class Gate:
    """Which of numbered things can fit a text: each needs one of its `any` literals (if it has some) and its `all` literal (if it has one)."""

    def __init__(self, needs: list[tuple[list[str], str]]):
        self.literals = Literals(w for some, one in needs for w in [*some, one])
        self.by_literal: list[list[int]] = [[] for _ in self.literals.words]
        self.one = [self.literals.number(one) if one else None for _, one in needs]
        self.always: list[int] = []
        for i, (some, one) in enumerate(needs):
            for w in {w for w in some if w} or ({one} if one else set()):
                self.by_literal[self.literals.number(w)].append(i)
            if not any(some) and not one:
                self.always.append(i)

    def open(self, text: str) -> list[int]:
        found = self.literals.found(folded(text))
        some = {i for w in found for i in self.by_literal[w] if self.one[i] is None or self.one[i] in found}
        return sorted([*some, *self.always])

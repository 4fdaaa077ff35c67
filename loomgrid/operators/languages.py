"""Containment of small regular languages, decided on the expressions alone."""

from __future__ import annotations

import string

#: States and their moves by sign; ``None`` is a move without a sign.
Moves = list[dict[str | None, set[int]]]


class Unsupported(ValueError):
    """The expression uses more than literals, classes, groups, ``|`` and repetitions."""


#: One sign for all that no expression names.
_OTHER = "\x00"


def _class(text: str, at: int) -> tuple[set[str], int]:
    """The signs of a class from behind its bracket, and where it ends."""
    end = text.find("]", at)
    if end < 0 or text[at] in "^]":
        raise Unsupported(text)
    signs, i = set(), at
    while i < end:
        if text[i] == "\\":
            raise Unsupported(text)
        if i + 2 < end and text[i + 1] == "-":
            signs |= {chr(c) for c in range(ord(text[i]), ord(text[i + 2]) + 1)}
            i += 3
        else:
            signs.add(text[i])
            i += 1
    return signs, end + 1


class _Parser:
    def __init__(self, text: str):
        self.text, self.at, self.moves = text, 0, []

    def state(self) -> int:
        self.moves.append({})
        return len(self.moves) - 1

    def move(self, a: int, sign: str | None, b: int) -> None:
        self.moves[a].setdefault(sign, set()).add(b)

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def either(self, start: int) -> int:
        end = self.state()
        while True:
            branch = self.state()
            self.move(start, None, branch)
            self.move(self.sequence(branch), None, end)
            if self.peek() != "|":
                return end
            self.at += 1

    def sequence(self, at: int) -> int:
        while self.peek() not in ("", "|", ")"):
            begin = self.at
            low, high, after = self.repetition(begin)
            for _ in range(low):
                self.at = begin
                at = self.atom(at)
            if high is None:
                self.at = begin
                hub, back = self.state(), None
                self.move(at, None, hub)
                back = self.atom(hub)
                self.move(back, None, hub)
                at = hub
            else:
                for _ in range(high - low):
                    self.at = begin
                    nxt = self.atom(at)
                    self.move(at, None, nxt)
                    at = nxt
            self.at = after
        return at

    def repetition(self, begin: int) -> tuple[int, int | None, int]:
        """How often the atom at ``begin`` is taken, and where the repetition ends."""
        moves, self.moves = self.moves, [{}]
        self.atom(0)
        self.moves = moves
        sign = self.peek()
        if sign in ("+", "*", "?") and sign:
            return {"+": (1, None), "*": (0, None), "?": (0, 1)}[sign] + (self.at + 1,)
        if sign == "{":
            end = self.text.index("}", self.at)
            low, comma, high = self.text[self.at + 1 : end].partition(",")
            return int(low), (int(high) if high else None) if comma else int(low), end + 1
        return 1, 1, self.at

    def atom(self, start: int) -> int:
        sign = self.peek()
        self.at += 1
        if sign == "(":
            if self.peek() == "?":
                raise Unsupported(self.text)
            end = self.either(start)
            if self.peek() != ")":
                raise Unsupported(self.text)
            self.at += 1
            return end
        if sign == "[":
            signs, self.at = _class(self.text, self.at)
        elif sign == "\\":
            if self.peek() in string.ascii_letters + string.digits or not self.peek():
                raise Unsupported(self.text)
            signs, self.at = {self.peek()}, self.at + 1
        elif sign in ".^$*+?{}])" or not sign:
            raise Unsupported(self.text)
        else:
            signs = {sign}
        end = self.state()
        for s in signs:
            self.move(start, s, end)
        return end


def _automaton(expression: str) -> tuple[Moves, int]:
    """States with state 0 as start, and the accepting one; the expression stands for whole values."""
    parser = _Parser(expression.removeprefix("^").removesuffix("$"))
    end = parser.either(parser.state())
    if parser.at < len(parser.text):
        raise Unsupported(expression)
    return parser.moves, end


def _closed(moves: Moves, states: set[int]) -> frozenset[int]:
    out, todo = set(states), list(states)
    while todo:
        for s in moves[todo.pop()].get(None, ()):
            if s not in out:
                out.add(s)
                todo.append(s)
    return frozenset(out)


def contained(expression: str, pattern: str) -> bool:
    """True if every value that ``expression`` matches as a whole is matched by ``pattern`` as a whole.

    False also where either uses a syntax that is not understood, so that True
    may be relied on.  No value is looked at.
    """
    try:
        a, a_end = _automaton(expression)
        b, b_end = _automaton(pattern)
    except (Unsupported, ValueError):
        return False
    signs = {s for moves in (a, b) for m in moves for s in m if s is not None} | {_OTHER}
    first = (_closed(a, {0}), _closed(b, {0}))
    seen, todo = {first}, [first]
    while todo:
        x, y = todo.pop()
        if a_end in x and b_end not in y:
            return False
        for s in signs:
            x2 = _closed(a, {t for q in x for t in a[q].get(s, ())})
            if not x2:
                continue
            pair = (x2, _closed(b, {t for q in y for t in b[q].get(s, ())}))
            if pair not in seen:
                seen.add(pair)
                todo.append(pair)
    return True

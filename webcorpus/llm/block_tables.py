"""Cheapest edits of a row of symbols to a conversation, by block tables (Four Russians).

A row is a symbol: what its role begins with, whether its text breaks off, or
that it must go. The state is what the edited conversation ends with. The cost
vector of a suffix says, for each state before it, what the rest costs; without
their common part only few vectors occur. ``TABLES`` holds for every vector and
every block of ``BLOCK`` symbols the vector before the block and what is added,
so that a conversation is read from its end block by block. Edits are then read
from the start; a block is expanded backward into the vectors inside it, so that
among all cheapest edits the first in ASCII order is taken at every step.
"""

from __future__ import annotations

from functools import cache

import numpy as np

#: Symbols of one block.
BLOCK = 4
#: Symbols: 0 must be deleted; 1 to 4 have a role that begins with s, u, a or anything else; 5 to 8 the same, truncated.
INITIALS = "sua"
DELETED, OTHER, SYMBOLS = 0, 4, 9
KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 2, 3, 2, 1

START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a kept row of role initial s, u, a, anything else; -1 where it may not stand.
_KEEP = {START: (SYSTEM, USER, -1, -1), SYSTEM: (-1, USER, -1, -1), USER: (-1, -1, ASSISTANT, -1), ASSISTANT: (-1, USER, -1, -1)}
#: State after the row that is written anew or inserted.
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_ACCEPTED = (START, ASSISTANT)
_FAR = 1 << 20


def symbol(initial: int, truncated: bool) -> int:
    """Symbol of a row that may stay; ``initial`` from 1 to 4."""
    return initial + 4 * truncated


def written_role(state: int) -> str:
    """Role of a row that leads to ``state``."""
    return "user" if state == USER else "assistant"


def _with_inserts(cost: list[int]) -> tuple[int, ...]:
    """Costs when rows may be inserted first; two are enough to reach every state worth reaching."""
    for _ in range(len(_NEXT)):
        cost = [min(c, INSERT_COST + cost[_NEXT[s]]) for s, c in enumerate(cost)]
    return tuple(cost)


def _options(after: tuple[int, ...], code: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits that use up a symbol, in ASCII order of the letters."""
    found = [("D", DELETE_COST + after[state], state)]
    if code != DELETED:
        initial, cut = (code - 1) % 4, TRUNCATED_COST * (code > OTHER)
        if (kept := _KEEP[state][initial]) >= 0:
            found.append(("K", KEEP_COST + cut + after[kept], kept))
        found.append(("R", REROLE_COST + cut + after[_NEXT[state]], _NEXT[state]))
    return found


def _before(after: tuple[int, ...], code: int) -> tuple[int, ...]:
    return _with_inserts([min(cost for _, cost, _ in _options(after, code, s)) for s in range(4)])


def _first_edits(after: tuple[int, ...], code: int, state: int) -> tuple[str, int]:
    """The ASCII-least cheapest letters up to the one that uses up the symbol, and the state after it."""
    cost, letters = _before(after, code), ""
    while True:
        least = min((letter, new) for letter, c, new in _options(after, code, state) + [("I", INSERT_COST + cost[_NEXT[state]], _NEXT[state])] if c == cost[state])
        letters, state = letters + least[0], least[1]
        if least[0] != "I":
            return letters, state


class Tables:
    """Normalised vectors, their transitions by symbol and by block, and the edits of each step."""

    def __init__(self) -> None:
        self.vectors = [_with_inserts([0 if s in _ACCEPTED else _FAR for s in range(4)])]
        number = {self.vectors[0]: 0}
        nexts, adds = [], []
        for vector in self.vectors:  # grows while it is walked
            row = []
            for code in range(SYMBOLS):
                raw = _before(vector, code)
                base = min(raw)
                flat = tuple(c - base for c in raw)
                if flat not in number:
                    number[flat] = len(self.vectors)
                    self.vectors.append(flat)
                row.append((number[flat], base))
            nexts.append([n for n, _ in row])
            adds.append([a for _, a in row])
        self.next, self.add = np.array(nexts, np.uint8), np.array(adds, np.int32)
        self.edits = [[[_first_edits(v, c, s) for s in range(4)] for c in range(SYMBOLS)] for v in self.vectors]
        self.ends = []
        for state in range(4):
            letters = ""
            while state not in _ACCEPTED:
                letters, state = letters + "I", _NEXT[state]
            self.ends.append(letters)
        codes = np.arange(SYMBOLS**BLOCK)
        now = np.repeat(np.arange(len(self.vectors), dtype=np.uint8)[:, None], len(codes), axis=1)
        total = np.zeros(now.shape, np.int32)
        for place in reversed(range(BLOCK)):
            at = codes // SYMBOLS**place % SYMBOLS
            total += self.add[now, at]
            now = self.next[now, at]
        self.block_next, self.block_add = now, total

    @cache  # noqa: B019 - the one instance lives as long as the process
    def expand(self, vector: int, code: int, state: int) -> tuple[str, int]:
        """Edits of a block from ``state`` when ``vector`` holds after it, and the state they lead to."""
        inside, symbols = [vector], [code // SYMBOLS**place % SYMBOLS for place in range(BLOCK)]
        for c in reversed(symbols[1:]):
            inside.append(int(self.next[inside[-1], c]))
        letters = ""
        for c, after in zip(symbols, reversed(inside)):
            more, state = self.edits[after][c][state]
            letters += more
        return letters, state


@cache
def tables() -> Tables:
    return Tables()


def _cut(symbols: bytes) -> tuple[np.ndarray, bytes]:
    """Codes of the whole blocks, and the symbols behind them."""
    whole = len(symbols) // BLOCK * BLOCK
    blocks = np.frombuffer(symbols, np.uint8)[:whole].reshape(-1, BLOCK).astype(np.int64)
    return blocks @ (SYMBOLS ** np.arange(BLOCK)), symbols[whole:]


def transitions(symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For every vector after the symbols: the vector before them, and the cost that is added."""
    t = tables()
    codes, rest = _cut(symbols)
    now, total = np.arange(len(t.vectors)), np.zeros(len(t.vectors), np.int64)
    for c in reversed(rest):
        now, total = t.next[now, c], total + t.add[now, c]
    for code in codes[::-1]:
        now, total = t.block_next[now, code], total + t.block_add[now, code]
    return now, total


def edits(symbols: bytes, vector: int = 0, state: int = START, last: bool = True) -> tuple[str, int, int]:
    """The ASCII-least cheapest edits, the state after them and what all from ``state`` on costs.

    ``vector`` is the one after the symbols, 0 at the end of a conversation;
    ``last`` adds the rows that are missing at the end. The cost leaves out what
    the vector after the symbols has been normalised by.
    """
    t = tables()
    codes, rest = _cut(symbols)
    after, total = [vector], 0
    for c in reversed(rest):
        total += int(t.add[after[-1], c])
        after.append(int(t.next[after[-1], c]))
    inside = after[:-1][::-1]
    borders = [after[-1]]
    for code in codes[::-1].tolist():
        total += int(t.block_add[borders[-1], code])
        borders.append(int(t.block_next[borders[-1], code]))
    cost = total + t.vectors[borders[-1]][state]
    letters = []
    for code, border in zip(codes.tolist(), borders[-2::-1]):
        more, state = t.expand(border, code, state)
        letters.append(more)
    for c, behind in zip(rest, inside):
        more, state = t.edits[behind][c][state]
        letters.append(more)
    if last:
        letters.append(t.ends[state])
    return "".join(letters), state, cost

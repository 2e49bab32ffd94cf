"""Generalised LR repair of a sequence of roles, one row at a time.

The grammar of roles becomes LR(0) item sets. All stacks that a parse can be in share their lower parts: a
stack is a pair (state, stack below), kept once, so equal stacks are one node of a graph. Each row is deleted,
kept or given another role, with roles inserted in front of it where that helps; each edit has a cost and a letter.
Where two ways reach an equal stack, the one with the smaller (cost, audit) stays, the audit being its letters.

Insertions stand directly before the row they help or at the end, so after each row every audit ends in the letter
of a row. No audit is then the beginning of another one, and two of them compare like their ranks among the
audits of the row before, however long they are.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

# Role initials of a well-formed conversation: nothing, or an optional system turn and pairs of user and assistant.
RULES = (("C", ""), ("C", "T"), ("C", "sT"), ("T", "ua"), ("T", "Tua"))
START = "C"
ROLES = {"u": "user", "a": "assistant"}

KEEP, REROLE, DELETE, INSERT = ("K", 0), ("R", 1), ("D", 2), ("I", 5)
TRUNCATED = 5


class Grammar:
    """Stacks of the grammar ``rules`` and what can be done on each; stack 0 is the empty one."""

    def __init__(self, rules: tuple[tuple[str, str], ...] = RULES, start: str = START, roles: dict[str, str] = ROLES):
        self.rules, self.start, self.roles = rules, start, roles
        first = self._closed({(n, 0) for n, (left, _) in enumerate(rules) if left == start})
        self.stacks: list[tuple[frozenset, int]] = [(first, -1)]
        self.numbers = {self.stacks[0]: 0}
        self.ways = lru_cache(None)(self._ways)
        self.to_end = lru_cache(None)(self._to_end)

    def _closed(self, items: set[tuple[int, int]]) -> frozenset:
        todo = list(items)
        while todo:
            rule, dot = todo.pop()
            wanted = self.rules[rule][1][dot:dot + 1]
            for n, (left, _) in enumerate(self.rules):
                if left == wanted and (n, 0) not in items:
                    items.add((n, 0))
                    todo.append((n, 0))
        return frozenset(items)

    def _push(self, stack: int, symbol: str) -> int | None:
        moved = {(r, d + 1) for r, d in self.stacks[stack][0] if self.rules[r][1][d:d + 1] == symbol}
        if not moved:
            return None
        node = (self._closed(moved), stack)
        if node not in self.numbers:
            self.numbers[node] = len(self.stacks)
            self.stacks.append(node)
        return self.numbers[node]

    def reduced(self, stack: int) -> tuple[set[int], bool]:
        """Stacks after any number of reductions, and whether one of them is a whole conversation."""
        found, todo, whole = {stack}, [stack], False
        while todo:
            top = todo.pop()
            for rule, dot in self.stacks[top][0]:
                left, right = self.rules[rule]
                if dot < len(right):
                    continue
                below = top
                for _ in right:
                    below = self.stacks[below][1]
                if left == self.start:
                    whole = whole or below == 0
                elif (after := self._push(below, left)) is not None and after not in found:
                    found.add(after)
                    todo.append(after)
        return found, whole

    def shifted(self, stack: int, symbol: str) -> set[int]:
        """Stacks after ``symbol``, those that can go on or end."""
        pushed = self._push(stack, symbol)
        if pushed is None:
            return set()
        return {s for s in self.reduced(pushed)[0] if self._lives(s)}

    def _lives(self, stack: int) -> bool:
        terminals = {s for _, right in self.rules for s in right} - {left for left, _ in self.rules}
        items = self.stacks[stack][0]
        open_ = any(self.rules[r][1][d:d + 1] in terminals for r, d in items if d < len(self.rules[r][1]))
        return open_ or self.reduced(stack)[1]

    def inserted(self, stack: int) -> dict[int, str]:
        """Stacks that insertions lead to, each with the fewest roles, then the least, that do."""
        found, edge = {stack: ""}, {stack: ""}
        while edge:
            reached: dict[int, str] = {}
            for top, given in edge.items():
                for role in self.roles:
                    for after in self.shifted(top, role):
                        if after not in found:
                            reached[after] = min(given + role, reached.get(after, given + role + "~"))
            found |= reached
            edge = reached
        return found

    def _ways(self, stack: int, initial: str, must_go: bool) -> list[tuple[int, int, str, str, str]]:
        """``(stack, cost, letters, inserted roles, role of the row)`` for one more row, the best per stack."""
        best = {stack: (DELETE[1], DELETE[0], "", "")}
        if not must_go:
            for top, given in self.inserted(stack).items():
                for role in {initial, *self.roles}:
                    letter, cost = KEEP if role == initial else REROLE
                    way = (cost + INSERT[1] * len(given), INSERT[0] * len(given) + letter, given, role)
                    for after in self.shifted(top, role) if role else ():
                        best[after] = min(way, best.get(after, way))
        return [(after, *way) for after, way in best.items()]

    def _to_end(self, stack: int) -> str | None:
        """The roles to insert after the last row; none where no insertions end a conversation."""
        ends = [given for top, given in self.inserted(stack).items() if self.reduced(top)[1]]
        return min(ends, key=lambda given: (len(given), given), default=None)


class Repair:
    """The best ways to repair the rows seen so far; memory is one short record per row and stack."""

    def __init__(self, grammar: Grammar):
        self.grammar = grammar
        # stack: (cost, rank of the audit, letters as a chain, roles as a chain, hash of the text)
        self.tops = {s: (0, 0, None, None, None) for s in grammar.reduced(0)[0]}

    def row(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        initial = role[:1]
        best: dict[int, tuple] = {}
        for stack, top in self.tops.items():
            for after, cost, letters, given, new in self.grammar.ways(stack, initial, must_go):
                total = top[0] + cost + (TRUNCATED if truncated and new else 0)
                way = (total, top[1], letters, given, new, stack)
                if after not in best or way < best[after]:
                    best[after] = way
        ranks = {audit: n for n, audit in enumerate(sorted({way[1:3] for way in best.values()}))}
        tops = {}
        for after, (cost, rank, letters, given, new, stack) in best.items():
            _, _, audit, roles, digest = self.tops[stack]
            if new:
                said = role if letters[-1] == KEEP[0] else self.grammar.roles[new]
                digest = self._said(digest, given, f"{said}:{text}")
                roles = (roles, given + new)
            tops[after] = (cost, ranks[rank, letters], (audit, letters), roles, digest)
        self.tops = tops

    def _said(self, digest, given: str, line: str | None):
        lines = [f"{self.grammar.roles[g]}:" for g in given] + ([] if line is None else [line])
        if not lines:
            return digest
        text = "\n".join(lines).encode("utf-8", "surrogatepass")
        if digest is None:
            return hashlib.sha256(text)
        digest = digest.copy()
        digest.update(b"\n" + text)
        return digest

    def result(self) -> tuple[int, str, str, str]:
        """``(cost, audit, role initials, hex SHA-256)`` of the best repair."""
        ends = []
        for stack, (cost, rank, audit, roles, digest) in self.tops.items():
            given = self.grammar.to_end(stack)
            if given is not None:
                ends.append((cost + INSERT[1] * len(given), rank, len(given), given, stack))
        cost, _, _, given, stack = min(ends)
        _, _, audit, roles, digest = self.tops[stack]
        digest = self._said(digest, given, None) or hashlib.sha256()
        return cost, _text(audit) + INSERT[0] * len(given), _text(roles) + given, digest.hexdigest()


def _text(chain) -> str:
    parts = []
    while chain is not None:
        chain, part = chain
        parts.append(part)
    return "".join(reversed(parts))

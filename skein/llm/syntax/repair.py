"""Least repairs by error-correcting chart parsing over whole diagonals.

The chart holds, for every span of a piece and every symbol of the grammar, the
least number of tokens to insert, drop or replace so that the span derives the
symbol (minimum-cost parsing after Aho and Peterson).  Rules are cut into pairs;
all spans of one length and all pairs are settled at once by array operations,
so neither the length of a piece nor the number of edits is bounded.
"""

from __future__ import annotations

import numpy as np

FAR = 20_000
#: Pieces up to this length keep the gathered operands of all spans; longer ones gather them anew and give the same result.
GATHERED = 256


class Repairer:
    """The pair form of what a goal reaches; symbols are terminals, rules and tails of rules in one numbering."""

    def __init__(self, rules: list[list[tuple[int, ...]]], goal: int, matches: dict[str, frozenset[int]]):
        reached, todo = {goal: 0}, [goal]
        tokens: dict[int, int] = {}
        while todo:
            for s in (s for alt in rules[todo.pop()] for s in alt):
                if s % 2 == 0:
                    tokens.setdefault(s // 2, len(tokens))
                elif s // 2 not in reached:
                    reached[s // 2] = len(reached)
                    todo.append(s // 2)
        terminals = self.terminals = len(tokens)
        rules = [rules[n] for n in reached]
        self.tokens, self.matches = tokens, matches
        self.masks: dict[str, np.ndarray] = {}
        number = lambda s: tokens[s // 2] if s % 2 == 0 else terminals + reached[s // 2]
        tails: dict[tuple[int, ...], int] = {}
        pairs: set[tuple[int, int, int]] = set()
        units: set[tuple[int, int]] = set()
        count = terminals + len(rules)
        empty: set[int] = set()

        def settle(x: int, alt: tuple[int, ...]) -> None:
            nonlocal count
            if not alt:
                empty.add(x)
            elif len(alt) == 1:
                units.add((x, alt[0]))
            else:
                rest = alt[1:]
                if len(rest) == 1:
                    y = rest[0]
                elif rest in tails:
                    y = tails[rest]
                else:
                    y = tails[rest] = count
                    count += 1
                    settle(y, rest)
                pairs.add((x, alt[0], y))

        for n, alts in enumerate(rules):
            for alt in alts:
                settle(terminals + n, tuple(map(number, alt)))
        self.count = count
        order = sorted(pairs)
        self.over = np.array([x for x, _, _ in order], np.int64)
        self.left = np.array([b for _, b, _ in order], np.int64)
        self.right = np.array([c for _, _, c in order], np.int64)
        self.heads, self.at = np.unique(self.over, return_index=True)
        self.empty = np.array(sorted(empty), dtype=np.int64)
        self.nothing = empty
        # what each symbol costs out of nothing
        none = np.full(count, FAR, np.int64)
        none[:terminals] = 1
        none[self.empty] = 0
        changed = True
        while changed:
            before = none.copy()
            for x, y in units:
                none[x] = min(none[x], none[y])
            np.minimum.at(none, self.over, none[self.left] + none[self.right])
            changed = bool((none != before).any())
        self.none = none.astype(np.int16)
        # x from y where what stands beside y is inserted: (cost, before y or not)
        edges: dict[tuple[int, int], tuple[int, bool]] = {}
        for x, y in units:
            edges[x, y] = (0, False)
        for x, b, c in order:
            for y, cost, ahead in ((b, int(none[c]), False), (c, int(none[b]), True)):
                if x != y and cost < edges.get((x, y), (FAR, False))[0]:
                    edges[x, y] = (cost, ahead)
        self.edges: dict[int, list[tuple[int, int, bool]]] = {}
        for (x, y), (cost, ahead) in edges.items():
            if cost < FAR:
                self.edges.setdefault(x, []).append((y, cost, ahead))
        self._levels()

    def _levels(self) -> None:
        """Heads in an order in which what they derive from comes first, in groups of no edges among them."""
        depth: dict[int, int] = {}
        for x in list(self.edges):
            stack = [(x, iter(self.edges[x]))]
            if x in depth:
                continue
            depth[x] = 0
            while stack:
                node, rest = stack[-1]
                for y, _, _ in rest:
                    if y in self.edges and y not in depth:
                        depth[y] = 0
                        stack.append((y, iter(self.edges[y])))
                        break
                else:
                    stack.pop()
                    depth[node] = 1 + max((depth[y] for y, _, _ in self.edges[node] if y in self.edges), default=0)
        groups: dict[int, list[int]] = {}
        for x, k in depth.items():
            groups.setdefault(k, []).append(x)
        self.levels = []
        for k in sorted(groups):
            heads, src, cost, at = [], [], [], []
            for x in groups[k]:
                heads.append(x)
                at.append(len(src))
                for y, c, _ in self.edges[x]:
                    src.append(y)
                    cost.append(c)
            self.levels.append((np.array(heads), np.array(src), np.array(cost, np.int16), np.array(at)))
        # edges against that order: only they can make a further sweep necessary
        back = [(x, y, c) for x, ways in self.edges.items() for y, c, _ in ways if y in depth and depth[y] >= depth[x]]
        self.back = np.array([x for x, _, _ in back], np.int64), np.array([y for _, y, _ in back], np.int64), np.array([c for _, _, c in back], np.int16)

    def _close(self, row: np.ndarray) -> None:
        """Derivations that add nothing but inserted tokens, until none is better."""
        over, under, cost = self.back
        while True:
            for heads, src, step, at in self.levels:
                row[:, heads] = np.minimum(row[:, heads], np.minimum.reduceat(row[:, src] + step, at, axis=1))
            if not (row[:, under] + cost < row[:, over]).any():
                return

    def _mask(self, c: str) -> np.ndarray:
        m = self.masks.get(c)
        if m is None:
            m = np.zeros(self.terminals, np.int16)
            m[[self.tokens[t // 2] for t in self.matches[c] if t // 2 in self.tokens]] = 1
            self.masks[c] = m
        return m

    def chart(self, s: str) -> list[np.ndarray]:
        """``chart[size][start]``: the cost of each symbol over a span."""
        n = len(s)
        hits = np.zeros((n + 1, self.terminals), np.int16)
        np.cumsum([self._mask(c) for c in s], axis=0, out=hits[1:])
        out = [np.tile(self.none, (n + 1, 1))]
        kept = n <= GATHERED
        lefts, rights = [None], [None]
        for size in range(1, n + 1):
            m = n - size + 1
            row = np.full((m, self.count), FAR, np.int16)
            row[:, : self.terminals] = size - (hits[size:] - hits[:-size] > 0)
            row[:, self.empty] = size
            if size > 1 and len(self.over):
                best = np.full((m, len(self.over)), FAR, np.int16)
                for k in range(1, size):
                    a = lefts[k][:m] if kept else out[k][:m, self.left]
                    b = rights[size - k][k : k + m] if kept else out[size - k][k : k + m, self.right]
                    np.minimum(best, a + b, out=best)
                found = np.minimum.reduceat(best, self.at, axis=1)
                row[:, self.heads] = np.minimum(row[:, self.heads], found)
            self._close(row)
            out.append(row)
            if kept:
                lefts.append(row[:, self.left])
                rights.append(row[:, self.right])
        return out

    def repair(self, s: str) -> tuple[int, list[int]]:
        """(cost, places) of the least edits that make ``s`` derive the goal; places run from 0 to ``len(s)``."""
        table = self.chart(s)
        goal = self.terminals
        places: list[int] = []
        todo = [(goal, 0, len(s))]
        while todo:
            x, i, size = todo.pop()
            places += self._ground(table, s, x, i, size, todo)
        return int(table[len(s)][0, goal]), sorted(places)

    def _ground(self, table: list[np.ndarray], s: str, x: int, i: int, size: int, todo: list) -> list[int]:
        """Follow derivations of the span's cost down to a token, to nothing or to two parts, which go to ``todo``."""
        row = table[size][i]
        if size == 0:
            return [i] * int(row[x])
        seen, ways = {x}, [(x, [])]
        while ways:
            y, spent = ways.pop()
            v = int(row[y])
            if y < self.terminals:
                hit = next((p for p in range(i, i + size) if self._mask(s[p])[y]), None)
                return spent + [p for p in range(i, i + size) if p != hit]
            if v == size and y in self.nothing:
                return spent + list(range(i, i + size))
            for r in np.flatnonzero(self.over == y):
                b, c = self.left[r], self.right[r]
                for k in range(1, size):
                    if int(table[k][i, b]) + int(table[size - k][i + k, c]) == v:
                        todo += [(b, i, k), (c, i + k, size - k)]
                        return spent
            for z, cost, ahead in self.edges.get(y, ()):
                if z not in seen and int(row[z]) + cost == v:
                    seen.add(z)
                    ways.append((z, spent + [i if ahead else i + size] * cost))
        raise AssertionError("a cost without derivation")

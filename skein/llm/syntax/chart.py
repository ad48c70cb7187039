"""Chart parser with error correction over strings of token classes.

A token class is one character, so a piece of source is a short string and what
has been decided once for a string is looked up ever after.  The zero-cost
sweep is an Earley recogniser; where it fails, the least number of inserted,
deleted or replaced tokens is found by minimum-cost chart parsing over the same rules.
"""

from __future__ import annotations

import re

from skein.llm.syntax.repair import Repairer

END = -1


class Grammar:
    """Rules in text form.

    ``Name : alternatives | ...``, one rule a line, continued by indented lines.
    A word in quotes is a terminal, ``'{x`` any bracket of that kind whose inside
    parses as category ``x``; a capital word is a rule; ``?``, ``*`` and ``+``
    follow a word.
    """

    def __init__(self, text: str):
        self.terminals: dict[str, int] = {}
        self.names: dict[str, int] = {}
        self.rules: list[list[tuple[int, ...]]] = []
        self.chars: dict[str, str] = {}
        self.matches: dict[str, frozenset[int]] = {}
        self.groups: dict[tuple[str, frozenset[str]], str] = {}
        self.terminals |= {",": 0, ";": 1}  # pieces end at these in every language
        joined = re.sub(r"\n[ \t]+", " ", "\n".join(x.split("#")[0] if not x.lstrip().startswith("'") else x for x in text.strip().splitlines()))
        for line in joined.splitlines():
            if line.strip():
                head, _, body = line.partition(" : ")
                n = self._name(head.strip())
                for alt in re.split(r"\s\|(?=\s|$)", " " + body):
                    self.rules[n].append(tuple(self._symbol(w) for w in alt.split()))
        missing = [k for k, n in self.names.items() if not self.rules[n]]
        if missing:
            raise ValueError(f"no rule for {missing}")
        self._repairers: dict[str, Repairer] = {}
        self._compile()

    def _name(self, name: str) -> int:
        if name not in self.names:
            self.names[name] = len(self.rules)
            self.rules.append([])
        return self.names[name]

    def _symbol(self, word: str) -> int:
        """Terminals are even, rules odd."""
        if len(word) > 1 and word[-1] in "?*+" and word[-2:] not in ("'?", "'*", "'+") or re.match(r"'..*'[?*+]$", word):
            base, mark = self._symbol(word[:-1]), word[-1]
            name = f"{word}"
            fresh = name not in self.names
            n = self._name(name)
            if fresh:
                self.rules[n] += {"?": [(), (base,)], "*": [(), (base, 2 * n + 1)], "+": [(base,), (base, 2 * n + 1)]}[mark]
            return 2 * n + 1
        if word.startswith("'"):
            return 2 * self.terminals.setdefault(word[1:-1] if len(word) > 2 and word[-1] == "'" else word[1:], len(self.terminals))
        return 2 * self._name(word) + 1

    def _compile(self) -> None:
        self.symbol: list[int] = []
        self.left: list[int] = []
        self.starts: list[list[int]] = []
        for n, alts in enumerate(self.rules):
            self.starts.append([])
            for alt in alts:
                self.starts[n].append(len(self.symbol))
                self.symbol += [*alt, END]
                self.left += [n] * (len(alt) + 1)
        self.nullable = [False] * len(self.rules)
        first: list[set[int]] = [set() for _ in self.rules]
        changed = True
        while changed:
            changed = False
            for n, alts in enumerate(self.rules):
                for alt in alts:
                    before = len(first[n]), self.nullable[n]
                    for s in alt:
                        if s % 2 == 0:
                            first[n].add(s)
                            break
                        first[n] |= first[s // 2]
                        if not self.nullable[s // 2]:
                            break
                    else:
                        self.nullable[n] = True
                    changed |= before != (len(first[n]), self.nullable[n])
        self.openers: list[list[tuple[int, frozenset[int], bool]]] = []
        for n, alts in enumerate(self.rules):
            row = []
            for at, alt in zip(self.starts[n], alts):
                f: set[int] = set()
                empty = True
                for s in alt:
                    f |= {s} if s % 2 == 0 else first[s // 2]
                    if s % 2 == 0 or not self.nullable[s // 2]:
                        empty = False
                        break
                row.append((at, frozenset(f), empty))
            self.openers.append(row)
        self._predicted: dict[tuple[int, str], list[int]] = {}
        self.wide = frozenset(range(0, 2 * len(self.terminals), 2))

    def char(self, token: str) -> str:
        """The class of a plain token; tokens of no rule share one class that matches nothing."""
        c = self.chars.get(token)
        if c is None:
            t = self.terminals.get(token)
            if t is None and token != "\0":
                c = self.chars[token] = self.char("\0")
            else:
                c = self.chars[token] = chr(0x100 + len(self.chars))
                self.matches[c] = frozenset() if t is None else frozenset([2 * t])
        return c

    def group(self, bracket: str, categories: frozenset[str]) -> str:
        """The class of a whole bracket whose inside parses as each of ``categories``."""
        c = self.groups.get((bracket, categories))
        if c is None:
            c = self.groups[bracket, categories] = chr(0x1000 + len(self.groups))
            self.matches[c] = frozenset(2 * self.terminals[bracket + k] for k in categories if bracket + k in self.terminals)
        return c

    def _predict(self, n: int, c: str) -> list[int]:
        p = self._predicted.get((n, c))
        if p is None:
            m = self.matches[c] if c else frozenset()
            p = self._predicted[n, c] = [at for at, f, empty in self.openers[n] if empty or f & m]
        return p

    def recognize(self, start: str, s: str) -> tuple[bool, bool]:
        """(complete, viable): is ``s`` a ``start``; can it be the beginning of one."""
        symbol, left, nullable, matches = self.symbol, self.left, self.nullable, self.matches
        goal = self.names[start]
        n = len(s)
        now: list[tuple[int, int]] = [(at, 0) for at in self._predict(goal, s[0] if n else "")]
        waits: list[dict[int, list[tuple[int, int]]]] = []
        for i in range(n + 1):
            c = s[i] if i < n else ""
            m = matches[c] if c else frozenset()
            seen = set(now)
            wait: dict[int, list[tuple[int, int]]] = {}
            waits.append(wait)
            following: list[tuple[int, int]] = []
            for item in now:
                at, origin = item
                sym = symbol[at]
                if sym == END:
                    for a, o in waits[origin].get(left[at], ()):
                        new = (a + 1, o)
                        if new not in seen:
                            seen.add(new)
                            now.append(new)
                elif sym % 2 == 0:
                    if sym in m:
                        following.append((at + 1, origin))
                else:
                    b = sym // 2
                    if b in wait:
                        wait[b].append(item)
                    else:
                        wait[b] = [item]
                        for a in self._predict(b, c):
                            new = (a, i)
                            if new not in seen:
                                seen.add(new)
                                now.append(new)
                    if nullable[b]:
                        new = (at + 1, origin)
                        if new not in seen:
                            seen.add(new)
                            now.append(new)
            if i == n:
                return any(symbol[a] == END and left[a] == goal and o == 0 for a, o in now), True
            if not following:
                return False, False
            now = list(dict.fromkeys(following))
        raise AssertionError

    def repair(self, start: str, s: str) -> tuple[int, list[int]]:
        """(cost, places) of the least edits that make ``s`` a ``start``, whatever their number."""
        if start not in self._repairers:
            self._repairers[start] = Repairer(self.rules, self.names[start], self.matches)
        return self._repairers[start].repair(s)

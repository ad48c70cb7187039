"""From tokens to edit cost: brackets, pieces, categories.

A file's brackets make a tree.  The inside of each bracket is decided from the
inside out: it is cut into pieces (statements, members, list elements), a chart
decides each piece, and the bracket as a whole becomes one token class that
carries all categories its inside parses as.  Charts run once per distinct
piece.  An inside of no category costs the least edits that give it one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from skein.llm.syntax.chart import Grammar

CLOSER = {"(": ")", "[": "]", "{": "}", "$": "}", "I": "i", "T": "t"}
#: Distinct pieces kept per language and worker; beyond it the table starts anew.
KEPT = 300_000


@dataclass
class Category:
    """How the inside of a bracket may be read.

    ``how``: ``whole`` one string of ``rule``; ``list`` elements of ``rule``
    between commas; ``run`` a sequence of pieces of ``rule``; ``enum`` a list,
    then after ``;`` a run of ``more``.
    """

    name: str
    how: str
    rule: str
    empty: bool = True
    trailing: bool = True
    holes: bool = False
    more: str = ""


@dataclass
class Defect:
    cost: int
    at: int  # token number
    what: str


@dataclass
class Language:
    name: str
    grammar: Grammar
    inside: dict[str, list[Category]]
    top: Category
    #: Piece ends: after ``;``, after a brace, at a marked line end.
    after_brace: bool = True
    line_mark: str = ""
    implied: str = ""
    memo: dict = field(default_factory=dict)

    def __post_init__(self):
        g = self.grammar
        self.semi, self.comma = g.char(";"), g.char(",")
        self.mark = "\u0fff" if self.line_mark else "\0"
        g.matches[self.mark] = frozenset()
        self.end = g.char(self.implied) if self.implied else ""
        self.any = {b: g.group(b, frozenset(c.name for c in cats)) for b, cats in self.inside.items()}
        self.joint: set[str] = set()
        self.braces: set[str] = set()

    def decide(self, rule: str, s: str) -> tuple[bool, bool]:
        key = (rule, s)
        d = self.memo.get(key)
        if d is None:
            if len(self.memo) > KEPT:
                self.memo.clear()
            d = self.memo[key] = self.grammar.recognize(rule, s)
        return d

    def bracket(self, b: str, s: str) -> str:
        """The class of a bracket with inside ``s``: ``''`` where no category fits."""
        key = (b, s)
        c = self.memo.get(key)
        if c is None:
            if len(self.memo) > KEPT:
                self.memo.clear()
            fits = frozenset(k.name for k in self.inside[b] if self.fits(k, s))
            c = self.grammar.group(b, fits) if fits else ""
            if b in "{I" and c:
                self.braces.add(c)
            self.memo[key] = c
        return c

    def fits(self, k: Category, s: str) -> bool:
        if k.how == "run":
            return self.run(k.rule, s)
        if k.how == "enum":
            head, semi, tail = s.partition(self.semi)
            return self._list(k, head) and (not semi or self.run(k.more, tail))
        if self.mark in s:
            s = s.replace(self.mark, "")
        if not s:
            return k.empty
        if k.how == "whole":
            return self.decide(k.rule, s)[0]
        return self._list(k, s)

    def _list(self, k: Category, s: str) -> bool:
        if self.mark in s:
            s = s.replace(self.mark, "")
        if not s:
            return k.empty
        if self.semi in s and k.how != "enum":
            return False
        parts = s.split(self.comma)
        if parts[-1] == "" and k.trailing and len(parts) > 1:
            parts.pop()
        i, n = 0, len(parts)
        # a comma may also stand inside an element (type arguments): then elements join
        while i < n:
            if parts[i] == "" and k.holes:
                i += 1
                continue
            piece = parts[i]
            ok, more = self.decide(k.rule, piece)
            j = i + 1
            while not ok and more and j < n:
                piece = piece + self.comma + parts[j]
                ok, more = self.decide(k.rule, piece)
                j += 1
            if not ok:
                return False
            i = j
        return True

    def pieces(self, s: str) -> list[tuple[str, bool]]:
        """Pieces of ``s`` and whether a line end follows each."""
        out: list[tuple[str, bool]] = []
        semi, mark, braces = self.semi, self.mark, self.braces if self.after_brace else ()
        start = 0
        for i, c in enumerate(s):
            if c == semi:
                out.append((s[start : i + 1], False))
                start = i + 1
            elif c == mark:
                if i > start:
                    out.append((s[start:i], True))
                elif out:
                    out[-1] = (out[-1][0], True)
                start = i + 1
            elif c in braces:
                out.append((s[start : i + 1], False))
                start = i + 1
        if start < len(s):
            out.append((s[start:], True))
        elif out:
            out[-1] = (out[-1][0], True)
        return out

    def run(self, rule: str, s: str) -> bool:
        return not s or self._reach(rule, self.pieces(s))[0]

    def _reach(self, rule: str, parts: list[tuple[str, bool]]) -> tuple[bool, int]:
        """Can all pieces be covered; else the last boundary that can be reached.

        From each boundary in reach, pieces are joined as long as what they
        join to can still grow into a ``rule``.
        """
        n, end = len(parts), self.end
        reach = [False] * (n + 1)
        reach[0] = True
        far = 0
        for i in range(n):
            if not reach[i]:
                continue
            far = i
            joined, j = [parts[i][0]], i + 1
            while joined:
                line = end and parts[j - 1][1]
                if any(self.decide(rule, p)[0] or line and self.decide(rule, p + end)[0] for p in joined):
                    reach[j] = True
                if j == n:
                    break
                piece = parts[j][0]
                # a line end inside, as before else, may stand for the missing sign or for nothing
                if line:
                    joined += [p + end for p in joined]
                joined = [p + piece for p in joined if self.decide(rule, p + piece[0])[1]]
                j += 1
        return reach[n], n if reach[n] else far

    def nearest(self, b: str, s: str) -> Category:
        """The category whose pieces leave the fewest tokens unread."""
        return min(self.inside[b], key=lambda k: self._unread(k, s))

    def _unread(self, k: Category, s: str) -> int:
        if k.how in ("run", "enum"):
            parts, i, left = self.pieces(s), 0, 0
            while i < len(parts):
                ok, far = self._reach(k.rule, parts[i:])
                if ok:
                    break
                i += far
                left += len(parts[i][0])
                i += 1
            return left
        s = s.replace(self.mark, "")
        if k.how == "whole":
            return 0 if self.decide(k.rule, s)[0] else len(s)
        return sum(len(p) for p in s.split(self.comma) if p and not self.decide(k.rule, p)[0])

    def mend(self, k: Category, s: str) -> tuple[int, list[int]]:
        """Least edits found that make ``s`` fit ``k``, and their places in ``s``."""
        if k.how in ("run", "enum"):
            return self._mend_run(k, s)
        keep = [i for i, c in enumerate(s) if c != self.mark]
        s = "".join(s[i] for i in keep)
        if not s:
            return (0, []) if k.empty else (1, [0])
        if k.how == "whole":
            cost, at = self._mend_piece(k.rule, s)
            return cost, [keep[min(i, len(keep) - 1)] for i in at]
        cost, places, base = 0, [], 0
        for part in s.split(self.comma):
            if not (self.decide(k.rule, part)[0] if part else k.trailing or k.holes):
                c, at = self._mend_piece(k.rule, part)
                cost, places = cost + c, places + [keep[min(base + i, len(keep) - 1)] for i in at]
            base += len(part) + 1
        # elements that hold commas of their own are mended piece by piece: an upper bound
        return max(cost, 1), places or [0]

    def _mend_run(self, k: Category, s: str) -> tuple[int, list[int]]:
        parts = self.pieces(s)
        begin, at = [], 0
        for p, _ in parts:
            at = s.index(p, at)
            begin.append(at)
            at += len(p)
        cost, places, i, n = 0, [], 0, len(parts)
        while i < n:
            ok, far = self._reach(k.rule, parts[i:])
            if ok:
                break
            i += far
            piece, line = parts[i]
            # the least of mending this piece or this and the next as one
            c, where = self._mend_piece(k.rule, piece + (self.end if line else ""))
            step = 1
            if i + 1 < n and c > 1:
                c2, where2 = self._mend_piece(k.rule, piece + parts[i + 1][0] + (self.end if parts[i + 1][1] else ""))
                if c2 < c:
                    c, where, step = c2, where2, 2
            cost += c
            places += [min(begin[i] + x, len(s) - 1) for x in where]
            i += step
        return max(cost, 1), places or [max(0, len(s) - 1)]

    def _mend_piece(self, rule: str, s: str) -> tuple[int, list[int]]:
        key = ("mend", rule, s)
        got = self.memo.get(key)
        if got is None:
            got = self.grammar.repair(rule, s)
            got = self.memo[key] = (max(1, got[0]), [min(x, max(0, len(s) - 1)) for x in got[1]] or [0])
        return got


def edit_cost(lang: Language, tokens: list[tuple[str, str]], broken: list[Defect], track: bool) -> tuple[int, list[Defect]]:
    """(cost, defects).  ``tokens`` are (kind, class): kind ``o`` opens a bracket (class its name), ``c`` closes one, else plain.

    Without ``track`` it stops at the first defect: cost is then only told to be positive.
    """
    defects = list(broken)
    if defects and not track:
        return 1, defects
    stack: list[tuple[str, list[str], list[int]]] = []
    cur: list[str] = []
    where: list[int] = []
    name = ""

    def close(at: int) -> None:
        nonlocal cur, where, name
        s = "".join(cur)
        c = lang.bracket(name, s)
        if not c:
            cost, places = lang.mend(lang.nearest(name, s), s) if track else (1, [])
            defects.extend(_spread(cost, places, where, at, "token"))
            c = lang.any[name]
            if name in "{I":
                lang.braces.add(c)
        name, cur, where = stack.pop()
        cur.append(c)
        if track:
            where.append(at)

    for no, (kind, c) in enumerate(tokens):
        if kind == "p":
            cur.append(c)
            if track:
                where.append(no)
        elif kind == "o":
            stack.append((name, cur, where))
            name, cur, where = c, [], []
        else:
            if name and CLOSER[name] == c:
                close(no)
            elif any(CLOSER[x[0]] == c for x in stack if x[0]):
                while CLOSER[name] != c:
                    defects.append(Defect(1, no, "unclosed"))
                    close(no)
                close(no)
            else:
                defects.append(Defect(1, no, "unopened"))
        if defects and not track:
            return 1, defects
    while stack:
        defects.append(Defect(1, len(tokens), "unclosed"))
        if not track:
            return 1, defects
        close(len(tokens))
    s = "".join(cur)
    if not lang.fits(lang.top, s):
        cost, places = lang.mend(lang.top, s) if track else (1, [])
        defects.extend(_spread(cost, places, where, len(tokens), "token"))
    return sum(d.cost for d in defects), defects


def _spread(cost: int, places: list[int], where: list[int], at: int, what: str) -> list[Defect]:
    spots = [where[p] if p < len(where) else at for p in places][:cost] or [at]
    out = [Defect(1, x, what) for x in spots]
    out[0].cost += cost - len(out)
    return out

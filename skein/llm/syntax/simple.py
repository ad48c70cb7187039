"""A lexer shared by the languages without context-dependent tokens."""

from __future__ import annotations

import re

from skein.llm.syntax.trees import Defect, Language


class SimpleLexer:
    """Tokens by one expression with the groups 1 blank, 2 line end, 3 word, 4 number, 5 string, 6 char, 7 sign, 8 anything else."""

    pattern: re.Pattern
    words: list[str] = []
    #: Names of the classes of words, numbers, strings and chars.
    classes = ("id", "num", "str", "char")
    #: Words that have their own class only where the grammar knows them are all of ``words``.
    quotes = "'\"`"

    def __init__(self, lang: Language):
        g = lang.grammar
        self.word = {w: g.char(w) for w in self.words}
        self.punct = {w: g.char(w) for w in g.terminals if not w[0].isalpha() and not (w[0] in "({[" and len(w) > 1)}
        self.named = dict(zip((3, 4, 5, 6), (g.char(x) for x in self.classes)))
        self.bad, self.semi = g.char("\0"), lang.semi

    def line_end(self, out: list, at: list, last: str, pos: int) -> None:
        """Called at a line end after the token spelled ``last``."""

    def __call__(self, text: str) -> tuple[list[tuple[str, str]], list[int], list[Defect]]:
        out: list[tuple[str, str]] = []
        at: list[int] = []
        broken: list[Defect] = []
        word, punct, named, last = self.word, self.punct, self.named, ""
        ident = named[3]
        skip = 0
        for m in self.pattern.finditer(text):
            k = m.lastindex
            if k == 1:
                continue
            pos = m.start()
            if pos < skip:
                continue
            if k == 2:
                self.line_end(out, at, last, pos)
                last = ""
                continue
            t = m.group()
            if k == 7:
                if t in "([{":
                    out.append(("o", t))
                elif t in ")]}":
                    out.append(("c", t))
                else:
                    out.append(("p", punct.get(t) or self.bad))
            elif k == 3:
                out.append(("p", word.get(t) or ident))
            elif k < 7:
                out.append(("p", named[k]))
            else:
                if t in self.quotes:
                    broken.append(Defect(1, len(out), "string"))
                    stop = text.find("\n", pos)
                    skip = len(text) if stop < 0 or t == "`" else stop
                    out.append(("p", named[5]))
                    last = "str"
                    at.append(pos)
                    continue
                if t == "/" and text.startswith("/*", pos):
                    broken.append(Defect(1, len(out), "comment"))
                    break
                out.append(("p", self.bad))
            at.append(pos)
            last = t if k in (3, 7) else "lit"
        self.line_end(out, at, last, len(text))
        return out, at, broken

"""The zero-cost sweep of whole files.

Texts are cut into tokens by one expression, tokens are mapped to their classes
by a table, and brackets are folded from the inside out by replacing each
innermost one with its class.  Nothing here runs per token in Python, and what
a bracket or a piece is has been decided by the chart once for all files.  The
sweep only accepts: a text it can't fold is left to the reader that tracks
places and counts edits.
"""

from __future__ import annotations

import re

from skein.llm.syntax import golang, java, jsons, python, script
from skein.llm.syntax.trees import Language

_FOLD = re.compile(r"[(\[{][^()\[\]{}]*[)\]}]")
_PAIRS = {"()", "[]", "{}"}
#: Distinct tokens kept per worker and language; beyond it the table starts anew.
KEPT = 500_000


class Classes(dict):
    """Token text to class string; texts not yet met are classified by their first character."""

    def __init__(self, reader: Sweep):
        self.reader = reader

    def __missing__(self, t: str) -> str:
        if len(self) > KEPT:
            self.clear()
        c = self[t] = self.reader.classify(t)
        return c


class Sweep:
    pattern: re.Pattern
    words: list[str] = []

    def __init__(self, lang: Language):
        g = lang.grammar
        self.lang = lang
        self.word = {w: g.char(w) for w in self.words}
        self.punct = {w: g.char(w) for w in g.terminals if not w[0].isalpha() and w[0] != "_" and not (w[0] in "({[$T" and len(w) > 1)}
        self.bad = g.char("\0")
        self.folds: dict[str, str] = {}
        self.classes = Classes(self)

    def classify(self, t: str) -> str:
        if not t:  # the end
            return ""
        if t in "()[]{}":
            return t
        if t[0].isalpha() or t[0] in "_$" or t[0] > "\x7f":
            return self.name(t)
        return self.punct.get(t) or self.literal(t) or self.bad

    def name(self, t: str) -> str:
        return self.word.get(t) or self.lang.grammar.char("id")

    def literal(self, t: str) -> str:
        if t[0].isdigit() or t[0] in ".-" and len(t) > 1 and (t[1].isdigit()):
            return self.lang.grammar.char("num")
        if t[0] in "\"`" and len(t) > 1:
            return self.lang.grammar.char("str")
        if t[0] == "'" and len(t) > 1:
            return self.lang.grammar.char("char")
        return ""

    def inside(self, s: str) -> str:
        """What is left of a bracket's inside before it is decided."""
        return s

    def fold(self, s: str) -> str | None:
        folds, bracket, inside = self.folds, self.lang.bracket, self.inside
        failed = False

        def one(m: re.Match) -> str:
            nonlocal failed
            t = m.group()
            c = folds.get(t)
            if c is None:
                if len(folds) > KEPT:
                    folds.clear()
                c = bracket(t[0], inside(t[1:-1])) if t[0] + t[-1] in _PAIRS else ""
                folds[t] = c
            if not c:
                failed = True
            return c

        n = 1
        while n and not failed:
            s, n = _FOLD.subn(one, s)
        if failed or "(" in s or "[" in s or "{" in s or ")" in s or "]" in s or "}" in s:
            return None
        return s

    def classed(self, text: str) -> str:
        return "".join(map(self.classes.__getitem__, self.pattern.findall(text)))

    def accepts(self, text: str) -> bool:
        s = self.fold(self.classed(text))
        return s is not None and self.lang.fits(self.lang.top, s)


_JS_STRING = r"'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*+'|\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*+\""
_JS_REGEX = r"/(?![*/])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*+\])++/[A-Za-z]*"


def _template(depth: int) -> str:
    hole = "" if depth == 0 else "|" + _hole(depth - 1)
    return r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)" + hole + r")*+`"


def _hole(depth: int) -> str:
    return r"\$\{(?:[^`{}'\"]|" + _JS_STRING + r"|\{[^{}`'\"]*+\}|" + _template(depth) + r")*+\}"


class ScriptSweep(Sweep):
    pattern = re.compile(
        r"(?:" + script._SPACE + r"|//[^\n\r]*+|/\*(?:[^*\n\r]|\*(?!/))*+\*/)*+("
        r"[\r\n]|/\*(?s:.*?)\*/"
        r"|(?:=>|&&|\|\||\?\?|[=!]==?|[(,=:\[!&|?{;+*%<>~^-]|(?:return|typeof|case|in|of|delete|void|throw|new|instanceof|do|else|await|yield)\b)[ \t]*+" + _JS_REGEX +
        r"|[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*+(?!\\)"
        r"|0[xX][0-9a-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?n?"
        r"|" + _JS_STRING + "|" + _template(3) +
        r"|\.\.\.|=>|\?\.(?!\d)|===|!==|==|!=|\*\*=|\*\*|<<=|<<|<=|&&=|&&|\|\|=|\|\||\?\?=|\?\?|\+\+|--|[-+*%&|^/]=|[(){}\[\];,<>=!~?:.+\-*%&|^@/]"
        r"|\#[A-Za-z_$][\w$]*|(?s:.)|\Z)"
    )
    _split = re.compile(r"([\s\S]*?)[ \t]*(/[^/ \t][\s\S]*|/ [\s\S]*)$")
    _holes = re.compile(r"\$\{((?:[^`{}'\"]|" + _JS_STRING + r"|\{[^{}`'\"]*+\}|" + _template(2) + r")*+)\}|\\[\s\S]")

    def __init__(self, lang: Language, typed: bool):
        self.words = script.RESERVED + script.SOFT + (script.SOFT_TYPED if typed else [])
        super().__init__(lang)
        g = lang.grammar
        self.text = g.group("T", frozenset(["text"]))
        plain = lambda ws: "".join(re.escape(w) if w in "()[]{}" else g.char(w) for w in ws)
        mark = lang.mark
        self._many = re.compile(mark + "+")
        # at an opening brace and after an operator a line end means nothing, nor before a closing one
        self._drop = re.compile(f"(?<=[{plain(script._OPEN_END)}{self.punct['/']}]){mark}|{mark}(?=[{plain(script._CONTINUES)}])|^{mark}")

    def classify(self, t: str) -> str:
        if not t:
            return ""
        if t in "\r\n" or t.startswith("/*"):
            return self.lang.mark
        if t[0] == "`":
            if len(t) == 1:
                return self.bad
            return self.text if all(self.expression(h) for h in self._holes.findall(t) if h) and "${}" not in t else self.bad
        if len(t) > 2 and "/" in t and t[0] not in "'\"" and t not in self.punct:
            m = re.match(r"(=>|&&|\|\||\?\?|[=!]==?|[(,=:\[!&|?{;+*%<>~^-]|[a-z]+)[ \t]*/", t)
            if m:
                return self.classes[m.group(1)] + self.lang.grammar.char("regex")
        return super().classify(t)

    def literal(self, t: str) -> str:
        if t[0] in "'\"" and len(t) > 1:
            return self.lang.grammar.char("str")
        if t[0] == "#" and len(t) > 1:
            return self.lang.grammar.char("priv")
        return super().literal(t)

    def expression(self, text: str) -> bool:
        s = self.fold(self.classed(text).replace(self.lang.mark, ""))
        return bool(s) and self.lang.decide("Expr", s)[0]

    def accepts(self, text: str) -> bool:
        if text.startswith("#!"):
            text = text[text.find("\n") :] if "\n" in text else ""
        s = self._drop.sub("", self._many.sub(self.lang.mark, self.classed(text)))
        s = self.fold(s)
        return s is not None and self.lang.fits(self.lang.top, s)


class JavaSweep(Sweep):
    words = java.Lexer.words
    pattern = re.compile(
        r"(?:[ \t\f\r\n]+|//[^\n\r]*+|/\*(?s:.*?)\*/)*+("
        r"[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*+"
        r"|0[xX][0-9a-fA-F_.]+(?:[pP][+-]?\d+)?[lLfFdD]?|0[bB][01_]+[lL]?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[lLfFdD]?"
        r"|\"\"\"[ \t\f]*[\r\n](?s:\\.|.)*?\"\"\"|\"(?!\"\")(?:[^\"\\\n\r]|\\[^\n\r])*+\"|\"\"(?!\")"
        r"|'(?:[^'\\\n\r]|\\u+[0-9a-fA-F]{4}|\\[^\n\r])'|'\\[0-7]{1,3}'"
        r"|\.\.\.|->|::|\+\+|--|&&|\|\||<<=|<<|[<>=!]=|[-+*/%&|^]=|[(){}\[\];,.<>=!~?:+\-*/%&|^@]|\S|\Z)"
    )


class GoSweep(Sweep):
    words = golang.RESERVED
    pattern = re.compile(
        r"(?:[ \t\r]+|//[^\n]*+|/\*[^\n]*?\*/)*+("
        r"\n|/\*(?s:.*?)\*/"
        r"|[A-Za-z_\u0080-\U0010ffff][\w\u0080-\U0010ffff]*+"
        r"|0[xX][0-9a-fA-F_.]+(?:[pP][+-]?\d+)?i?|0[bB][01_]+i?|0[oO][0-7_]+i?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?i?"
        r"|\"(?:[^\"\\\n]|\\[^\n])*+\"|`[^`]*+`"
        r"|'(?:[^'\\\n]|\\[abfnrtv\\'\"]|\\[0-7]{3}|\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\U[0-9a-fA-F]{8})'"
        r"|\.\.\.|:=|<-|\+\+|--|&&|\|\||<<=|>>=|&\^=|&\^|<<|>>|[=!<>]=|[-+*/%&|^]=|[(){}\[\];,.<>=!:+\-*/%&|^~]|\S|\Z)"
    )

    def __init__(self, lang: Language):
        super().__init__(lang)
        g = lang.grammar
        ending = "".join(re.escape(w) if w in "()[]{}" else g.char(w) for w in [*golang._ENDING, "id", "num", "str", "char"])
        self._end = re.compile(f"(?<=[{ending}])\n+")

    def classify(self, t: str) -> str:
        return "\n" if t == "\n" or t.startswith("/*") else super().classify(t)

    def accepts(self, text: str) -> bool:
        s = self._end.sub(self.lang.semi, self.classed(text + "\n")).replace("\n", "")
        s = self.fold(s)
        return s is not None and self.lang.fits(self.lang.top, s)


class JsonSweep(Sweep):
    words = jsons.Lexer.words
    pattern = re.compile(
        r"[ \t\r\n]*+([A-Za-z_$][\w$]*|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?(?![\w.])|\"(?:[^\"\\\x00-\x1f]|\\[\"\\/bfnrt]|\\u[0-9a-fA-F]{4})*+\"|[{}\[\],:]|\S|\Z)"
    )


class PythonSweep(Sweep):
    words = python.RESERVED + python.SOFT
    pattern = re.compile(
        r"(?:[ \t\f]+|\#[^\n\r]*+|\\\r?\n)*+("
        r"(?:\r\n?|\n)(?:[ \t\f]*+(?:\#[^\n\r]*+)?(?:\r\n?|\n))*+[ \t\f]*+"
        r"|(?:[rRbBuUfF]|[rR][bBfF]|[bBfF][rR])?(?:'''(?s:\\.|(?!''').)*+'''|\"\"\"(?s:\\.|(?!\"\"\").)*+\"\"\"|'(?!'')(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*+'|\"(?!\"\")(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*+\"|''(?!')|\"\"(?!\"))"
        r"|[A-Za-z_\u0080-\U0010ffff][\w\u0080-\U0010ffff]*+"
        r"|0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[jJ]?"
        r"|\.\.\.|->|:=|//=|\*\*=|<<=|>>=|//|\*\*|<<|>>|[<>=!]=|[-+*/%&|^@]=|[(){}\[\];,.<>=:+\-*/%&|^~@]|\S|\Z)"
    )
    _lines = re.compile("([\ue000-\uf8ff])")

    def __init__(self, lang: Language):
        super().__init__(lang)
        self.punct[";"] = lang.grammar.char("semi")

    def classify(self, t: str) -> str:
        if t and t[0] in "\r\n":
            column = len(re.split(r"[\r\n]", t)[-1].replace("\f", "").expandtabs(8))
            # deeper columns have no sign here: such a text is left to the reader
            return chr(0xE000 + column) if column < 6000 else self.bad
        return super().classify(t)

    def name(self, t: str) -> str:
        return self.lang.grammar.char("str") if t[-1] in "'\"" else super().name(t)

    def literal(self, t: str) -> str:
        return self.lang.grammar.char("str") if t[0] in "'\"" and len(t) > 1 else super().literal(t)

    def inside(self, s: str) -> str:
        return self._lines.sub("", s)

    def accepts(self, text: str) -> bool:
        s = self.fold(self.classed("\n" + text))
        if s is None:
            return False
        semi, bracket = self.lang.semi, self.lang.bracket
        parts = self._lines.split(s)
        stack: list[tuple[int, list[str]]] = [(0, [])]
        for i in range(1, len(parts), 2):
            line = parts[i + 1]
            if not line:
                continue
            col = ord(parts[i]) - 0xE000
            if col > stack[-1][0]:
                stack.append((col, []))
            else:
                while col < stack[-1][0]:
                    if not self._close(stack, bracket):
                        return False
                if col != stack[-1][0]:
                    return False
            stack[-1][1].append(line + semi)
        while len(stack) > 1:
            if not self._close(stack, bracket):
                return False
        return self.lang.fits(self.lang.top, "".join(stack[0][1]))

    def _close(self, stack, bracket) -> bool:
        c = bracket("I", "".join(stack.pop()[1]))
        above = stack[-1][1]
        if not c or not above or above[-1][-1] != self.lang.semi:
            return False
        above[-1] = above[-1][:-1] + c
        return True


SWEEPS = {
    "python": PythonSweep, "javascript": lambda l: ScriptSweep(l, False), "typescript": lambda l: ScriptSweep(l, True), "java": JavaSweep, "go": GoSweep, "json": JsonSweep,
}

"""Python 3.13."""

from __future__ import annotations

import ast
import re
import warnings

from skein.llm.syntax.chart import Grammar
from skein.llm.syntax.trees import Category as C
from skein.llm.syntax.trees import Defect, Language

#: Reserved words, and words that are names except in some places.
RESERVED = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()
SOFT = "match case type _".split()

_GRAMMAR = """
Id : 'id' | 'match' | 'case' | 'type' | '_'
Line : Simples ';' | Compound
Simples : Simple | Simple 'semi' | Simple 'semi' Simples
Simple : Es | Targets | Es Aug Es | E ':' E | E ':' E '=' Es | 'pass' | 'break' | 'continue' | 'return' Es? | 'raise' E? | 'raise' E 'from' E | 'del' Es | 'assert' E | 'assert' E ',' E
  | 'global' Names | 'nonlocal' Names | Import | 'type' Id TParams? '=' E
Targets : Es '=' Rest
Rest : Es | Es '=' Rest
Names : Id | Id ',' Names
Import : 'import' Mods | 'from' Dots? Dotted 'import' Froms | 'from' Dots 'import' Froms
Mods : Mod | Mod ',' Mods
Mod : Dotted | Dotted 'as' Id
Dotted : Id | Id '.' Dotted
Dots : Dot | Dot Dots
Dot : '.' | '...'
Froms : '*' | FromList | '(froms'
FromList : From | From ',' FromList
From : Id | Id 'as' Id
Suite : ':' 'Iblock' | ':' Simples ';'
Compound : 'if' E Suite | 'if' E Suite Elif | 'while' E Suite Else? | 'async'? 'for' Es 'in' Es Suite Else? | 'async'? 'with' WithItems Suite | 'try' Suite Excepts | 'try' Suite 'finally' Suite
  | Decorator* 'async'? 'def' Id TParams? '(params' Returns? Suite | Decorator* 'class' Id TParams? Bases? Suite | 'match' Es ':' 'Icases'
Elif : 'elif' E Suite Elif? | Else
Else : 'else' Suite
Excepts : Except | Except Excepts | Except Else Finally? | Except Finally
Except : 'except' Suite | 'except' '*'? E Suite | 'except' '*'? E 'as' Id Suite
Finally : 'finally' Suite
WithItems : WithItem | WithItem ',' WithItems | '(withs'
WithItem : E | E 'as' E
Decorator : '@' E ';'
Returns : '->' E
Bases : '(args'
TParams : '[tparams'
TParam : Id Bound? Default? | '*' Id Default? | '**' Id Default?
Bound : ':' E
Default : '=' E
CaseLine : 'case' Pats Guard? Suite
Guard : 'if' E
Pats : Pat | Pat ',' | Pat ',' Pats
Pat : E | E 'as' Id | '*' Id
Es : EList | EList ','
EList : EStar | EList ',' EStar
EStar : E | '*' E
E : Tern | 'lambda' LParams? ':' E | Id ':=' E | 'yield' | 'yield' Es | 'yield' 'from' E
Tern : Un2 | Un2 'if' Un2 'else' E
Un2 : Chain | Chain Bin 'lambda' LParams? ':' E | 'lambda' LParams? ':' E
Chain : Un | Chain Bin Un
Un : Pre Un | Mem
Pre : '+' | '-' | '~' | 'not' | 'await'
Bin : '+' | '-' | '*' | '/' | '//' | '%' | '@' | '**' | '<<' | '>>' | '&' | '|' | '^' | '<' | '>' | '<=' | '>=' | '==' | '!=' | 'in' | 'not' 'in' | 'is' | 'is' 'not' | 'and' | 'or'
Aug : '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '**=' | '<<=' | '>>=' | '&=' | '|=' | '^='
Mem : Atom | Mem '.' Id | Mem '(args' | Mem '[index'
Atom : Id | 'num' | Str | 'None' | 'True' | 'False' | '...' | '(group' | '(args' | '[list' | '{dict' | '{set'
Str : 'str' | Str 'str'
LParams : LParam | LParam ',' | LParam ',' LParams
LParam : Id | Id '=' E | '*' Id | '*' | '**' Id | '/'
Param : Id Bound? Default? | '*' Id StarBound? | '*' | '**' Id Bound? | '/'
StarBound : ':' EStar
Arg : EStar | Id '=' E | '**' E | E Comp
Comp : 'async'? 'for' Es 'in' Tern Conds? Comp?
Conds : 'if' Un2 Conds? | 'if' Tern Conds?
Elem : EStar | E Comp
Item : E ':' E | '**' E | E ':' E Comp
Slice : EStar | E? ':' E? | E? ':' E? ':' E? | Id '=' E
Group : Es | E Comp
With : WithItem
"""

_TOKEN = re.compile(
    r"([ \t\f]+|\#[^\n\r]*|\\\r?\n)"
    r"|(\r\n?|\n)"
    r"|((?:[rRbBuUfF]|[rR][bBfF]|[bBfF][rR])?(?:'''(?s:\\.|(?!''').)*'''|\"\"\"(?s:\\.|(?!\"\"\").)*\"\"\"|'(?!'')(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'|\"(?!\"\")(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*\"|''(?!')|\"\"(?!\")))"
    r"|([A-Za-z_\u0080-\U0010ffff][\w\u0080-\U0010ffff]*)"
    r"|(0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[jJ]?)"
    r"|(\.\.\.|->|:=|//=|\*\*=|<<=|>>=|//|\*\*|<<|>>|[<>=!]=|[-+*/%&|^@]=|[(){}\[\];,.<>=:+\-*/%&|^~@])"
    r"|([\s\S])"
)


class Lexer:
    """Logical lines end with the class of ``;``; an indented block is a bracket ``I``; a written ``;`` is ``semi``."""

    def __init__(self, lang: Language):
        g = lang.grammar
        self.word = {w: g.char(w) for w in RESERVED + SOFT}
        self.punct = {w: g.char(w) for w in g.terminals if not w[0].isalpha() and w[0] != "_" and not (w[0] in "({[" and len(w) > 1)} | {";": g.char("semi")}
        self.id, self.num, self.str, self.bad, self.end = g.char("id"), g.char("num"), g.char("str"), g.char("\0"), lang.semi

    def __call__(self, text: str) -> tuple[list[tuple[str, str]], list[int], list[Defect]]:
        out: list[tuple[str, str]] = []
        at: list[int] = []
        broken: list[Defect] = []
        depth, indents, fresh, column, skip = 0, [0], True, 0, 0
        word, punct = self.word, self.punct
        for m in _TOKEN.finditer(text):
            pos, k = m.start(), m.lastindex
            if pos < skip:
                continue
            if k == 1:
                if fresh and m.group()[0] not in "#\\":
                    column = len(m.group().replace("\f", "").expandtabs(8))
                continue
            if k == 2:
                if not depth:
                    if not fresh:
                        out.append(("p", self.end))
                        at.append(pos)
                    fresh, column = True, 0
                continue
            if fresh:
                fresh = False
                if column > indents[-1]:
                    indents.append(column)
                    # the block replaces the end of the line before
                    if out and out[-1] == ("p", self.end):
                        out.pop()
                        at.pop()
                    out.append(("o", "I"))
                    at.append(pos)
                else:
                    while column < indents[-1]:
                        indents.pop()
                        out.append(("c", "i"))
                        at.append(pos)
                    if column != indents[-1]:
                        broken.append(Defect(1, len(out), "indent"))
                        indents.append(column)
                        out.append(("o", "I"))
                        at.append(pos)
            t = m.group()
            if k == 6:
                if t in "([{":
                    depth += 1
                    out.append(("o", t))
                elif t in ")]}":
                    depth = max(0, depth - 1)
                    out.append(("c", t))
                else:
                    out.append(("p", punct.get(t) or self.bad))
            elif k == 4:
                out.append(("p", word.get(t) or self.id))
            elif k == 3:
                out.append(("p", self.str))
            elif k == 5:
                out.append(("p", self.num))
            else:
                if t in "'\"":
                    broken.append(Defect(1, len(out), "string"))
                    stop = len(text) if text.startswith(t * 3, pos) else text.find("\n", pos)
                    skip = len(text) if stop < 0 else stop
                    out.append(("p", self.str))
                else:
                    out.append(("p", self.bad))
            at.append(pos)
        if not fresh:
            out.append(("p", self.end))
            at.append(len(text))
        for _ in indents[1:]:
            out.append(("c", "i"))
            at.append(len(text))
        return out, at, broken


def python() -> Language:
    inside = {
        "I": [C("block", "run", "Line", empty=False), C("cases", "run", "CaseLine", empty=False)],
        "(": [C("args", "list", "Arg"), C("params", "list", "Param"), C("group", "whole", "Group", empty=True), C("froms", "list", "From", empty=False), C("withs", "list", "With", empty=False)],
        "[": [C("list", "list", "Elem"), C("index", "list", "Slice", empty=False), C("tparams", "list", "TParam", empty=False)],
        "{": [C("dict", "list", "Item"), C("set", "list", "Elem", empty=False)],
    }
    return Language("python", Grammar(_GRAMMAR), inside, C("top", "run", "Line"), after_brace=True)


def valid(text: str) -> bool:
    """The exact check: does it parse as Python 3.13 (the interpreter's own parser)."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
    except (SyntaxError, ValueError):
        return False
    except (RecursionError, MemoryError):
        return True
    return True

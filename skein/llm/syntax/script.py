"""JavaScript and TypeScript."""

from __future__ import annotations

import re

from skein.llm.syntax.chart import Grammar
from skein.llm.syntax.trees import Category as C
from skein.llm.syntax.trees import Defect, Language

_STATEMENTS = """
Top : Import | Export | Stmt
Import : 'import' 'str' With? Term | 'import' Clause 'from' 'str' With? Term
Clause : Id | '{specs' | '*' 'as' Id | Id ',' '{specs' | Id ',' '*' 'as' Id
With : 'with' '{object' | 'assert' '{object'
Export : 'export' Decl | 'export' 'default' Default | 'export' '{specs' Term | 'export' '{specs' 'from' 'str' With? Term
  | 'export' '*' 'from' 'str' With? Term | 'export' '*' 'as' Name 'from' 'str' With? Term
Default : FuncDecl | ClassDecl | Expr Term
Decl : VarDecl | FuncDecl | ClassDecl
VarDecl : VarWord Binds Term
VarWord : 'const' | 'let' | 'var'
Binds : Bind | Bind ',' Binds
FuncDecl : 'async'? 'function' '*'? Id? Params FuncBody
ClassDecl : Decorator* 'class' Id? TParams? Extends? Implements? '{class'
Term : ';' | 'eol'
Stmt : '{block' | ';' | Decl | ClassDecl
  | 'if' '(expr' Stmt | 'if' '(expr' Stmt 'else' Stmt
  | 'for' 'await'? '(for' Stmt | 'while' '(expr' Stmt | 'do' Stmt 'while' '(expr' ';'? | 'do' Stmt 'while' '(expr' 'eol'
  | 'return' Expr? Term | 'throw' Expr Term | 'break' Id? Term | 'continue' Id? Term | 'debugger' Term
  | 'try' '{block' Catch | 'try' '{block' Catch? 'finally' '{block'
  | 'switch' '(expr' '{switch' | 'with' '(expr' Stmt | Id ':' Stmt | Expr0 Term
Catch : 'catch' '{block' | 'catch' '(params' '{block'
Item : Label Item | Label | Stmt
Label : 'case' Expr ':' | 'default' ':'
Expr : E | E ',' Expr
Expr0 : E0 | E0 ',' Expr
E : Chain | Chain '?' E ':' E | Chain Bin Last | Last
E0 : Chain0 | Chain0 '?' E ':' E | Chain0 Bin Last | Last
Last : Arrow | 'yield' | 'yield' E | 'yield' '*' E
Chain : Unary | Chain Bin Unary
Chain0 : Unary0 | Chain0 Bin Unary
Unary : Pre Unary | Post
Unary0 : Pre Unary | Post0
Pre : '!' | '~' | '+' | '-' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await'
Post : Mem | Mem '++' | Mem '--'
Post0 : Mem0 | Mem0 '++' | Mem0 '--'
Mem : Prim | Mem Suffix | 'new' Mem | 'import' '(args' | 'import' '.' Name | 'new' '.' Name | 'super' Suffix
Mem0 : Prim0 | Mem0 Suffix | 'new' Mem | 'import' '(args' | 'import' '.' Name | 'new' '.' Name | 'super' Suffix
Suffix : '.' Name | '.' 'priv' | '?.' Name | '?.' 'priv' | '?.' '(args' | '?.' '[index' | '(args' | '[index' | 'Ttext'
Prim0 : Id | 'num' | 'str' | 'Ttext' | 'regex' | 'this' | 'null' | 'true' | 'false' | '(expr' | '[array' | 'priv'
Prim : Prim0 | '{object' | FuncDecl | Decorator* 'class' Id? TParams? Extends? Implements? '{class'
Extends : 'extends' Mem
Bin : '*' | '**' | '/' | '%' | '+' | '-' | '<<' | '<' | '<=' | '>' | '>' '>' | '>' '>' '>' | '>' '=' | '==' | '!=' | '===' | '!=='
  | '&' | '^' | '|' | '&&' | '||' | '??' | 'in' | 'instanceof' | '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '>' '>' '='
  | '>' '>' '>' '=' | '&=' | '^=' | '|=' | '&&=' | '||=' | '??='
FuncBody : '{block'
Body : '{block' | E
Pattern : Id | '[pattern' | '{pattern'
Key : Name | 'str' | 'num' | '[index' | 'priv'
Prop : '...' E | Key ':' E | Id | Id '=' E | Method
Method : MethodWord* Key TParams? Params FuncBody
MethodWord : 'get' | 'set' | 'async' | '*'
PatProp : '...' Pattern | Id | Id '=' E | Key ':' Pattern | Key ':' Pattern '=' E
PatElem : '...' Pattern | Pattern | Pattern '=' E
Arg : E | '...' E
Spec : Name | Name 'as' Name | 'str' 'as' Name | Name 'as' 'str' | 'default' 'as' Name
For : VarWord Binds? ForRest | Expr ForRest | ForRest | VarWord Pattern 'of' E | VarWord Pattern 'in' Expr | Mem 'of' E | Mem 'in' Expr
ForRest : ';' Expr? ';' Expr?
Decorator : '@' Mem
"""

_SCRIPT_ONLY = """
Bind : Pattern | Pattern '=' E
Params : '(params'
Param : Pattern | Pattern '=' E | '...' Pattern
Arrow : Id '=>' Body | '(params' '=>' Body | 'async' Id '=>' Body | 'async' '(params' '=>' Body
TParams : 'never'
Implements : 'never'
Member : ';' | Decorator* 'static'? Method | Decorator* 'static'? 'accessor'? Key Term | Decorator* 'static'? Key '=' E Term | 'static' '{block'
"""

_TYPED = """
Bind : Pattern '!'? Ann? | Pattern '!'? Ann? '=' E
Ann : ':' T
Params : TParams? '(params' Returns?
Returns : ':' T | ':' 'asserts' Id | ':' 'asserts' Id 'is' T | ':' 'this' 'is' T
Param : Decorator* ParamWord* Pattern '?'? Ann? | Decorator* ParamWord* Pattern '?'? Ann? '=' E | '...' Pattern Ann? | 'this' Ann
ParamWord : 'public' | 'private' | 'protected' | 'readonly' | 'override'
Arrow : Id '=>' Body | TParams? '(params' Returns? '=>' Body | 'async' Id '=>' Body | 'async' TParams? '(params' Returns? '=>' Body
TParams : '<' TParamList '>'
TParamList : TParam | TParam ',' | TParam ',' TParamList
TParam : TParamWord* Id TBound? TDefault?
TParamWord : 'in' | 'out' | 'const'
TBound : 'extends' T
TDefault : '=' T
TArgs : '<' TList '>'
TList : T | T ',' TList
Implements : 'implements' TList
T : TU | TU 'extends' T '?' T ':' T
TU : '|' TU | '&' TU | TP | TP '|' TU | TP '&' TU
TP : 'keyof' TP | 'readonly' TP | 'unique' TP | 'infer' Id TBound? | TA | Id 'is' T | FuncType
FuncType : TParams? '(params' '=>' T | 'new' TParams? '(params' '=>' T | 'abstract' 'new' TParams? '(params' '=>' T
TA : TName TArgs? | 'typeof' TName TArgs? | TA '[index' | TA '[array' | '(type' | '[tuple' | '{members' | 'str' | 'num' | '-' 'num' | 'Ttext'
  | 'null' | 'void' | 'this' | 'true' | 'false' | 'import' '(args' | 'import' '(args' '.' TName TArgs?
TName : Id | TName '.' Name
TupleElem : T | '...' T | Id '?'? ':' T | '...' Id ':' T | T '?'
Member : ';' | Decorator* MemberWord* Method | Decorator* MemberWord* Key TMark? Ann? Term | Decorator* MemberWord* Key TMark? Ann? '=' E Term
  | 'static' '{block' | MemberWord* '[sig' Ann Term | Decorator* MemberWord* Key '?'? Params Term | Decorator* MemberWord* MethodWord* Key '?' Params FuncBody
TMark : '?' | '!'
MemberWord : 'public' | 'private' | 'protected' | 'static' | 'readonly' | 'abstract' | 'override' | 'declare' | 'accessor' | 'async'
Sig : Id ':' T | Id 'in' T | Id 'in' T 'as' T
Shape : ShapeWord* Key '?'? Ann? ShapeEnd | ShapeWord* Key '?'? Params ShapeEnd | Params ShapeEnd | 'new' Params ShapeEnd | ShapeWord* '[sig' MapMark? Ann? ShapeEnd
  | '+' 'readonly' '[sig' MapMark? Ann? ShapeEnd | '-' 'readonly' '[sig' MapMark? Ann? ShapeEnd
MapMark : '?' | '-' '?' | '+' '?'
ShapeWord : 'readonly' | 'get' | 'set'
ShapeEnd : ';' | ',' | 'eol' |
EnumItem : Key | Key '=' E
"""


def _typed(statements: str) -> str:
    t = statements
    t = t.replace("Extends : 'extends' Mem", "Extends : 'extends' Mem TArgs?")
    t = t.replace(
        "Decl : VarDecl | FuncDecl | ClassDecl",
        "Decl : VarDecl | FuncDecl | ClassDecl | 'abstract' ClassDecl | 'interface' Id TParams? IExtends? '{members' | 'type' Id TParams? '=' T Term"
        " | 'const'? 'enum' Id '{enum' | 'declare' Decl | 'declare' 'global' '{block' | SpaceWord TName '{space' | SpaceWord 'str' '{space' | 'async'? 'function' '*'? Id Params Term"
        "\nIExtends : 'extends' TList\nSpaceWord : 'namespace' | 'module'",
    )
    t = t.replace(
        "Import : ", "Import : 'import' 'type' Clause 'from' 'str' With? Term | 'import' 'type'? Id '=' Expr Term | "
    ).replace(
        "Export : ", "Export : 'export' '=' Expr Term | 'export' 'type' '{specs' Term | 'export' 'type' '{specs' 'from' 'str' Term | 'export' 'type' '*' 'from' 'str' Term | 'export' 'as' 'namespace' Id Term | 'export' 'import' Id '=' Expr Term | "
    )
    t = t.replace("Default : ", "Default : 'abstract' ClassDecl | 'interface' Id TParams? IExtends? '{members' | ")
    t = t.replace("Spec : ", "Spec : 'type' Name | 'type' Name 'as' Name | ")
    t = t.replace("Chain : Unary |", "Chain : Unary | Chain CastWord T |").replace("Chain0 : Unary0 |", "Chain0 : Unary0 | Chain0 CastWord T |")
    t = t.replace("Pre : ", "CastWord : 'as' | 'satisfies'\nPre : '<' T '>' | ")
    t = t.replace("Suffix : ", "Suffix : '!' | TArgs '(args' | TArgs 'Ttext' | TArgs | ")
    t = t.replace("For : VarWord Binds?", "For : VarWord Pattern Ann 'of' E | VarWord Binds?")
    return t


#: Reserved words, and words that are names except in some places.
RESERVED = "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split()
SOFT = "let static async await yield of get set from as accessor assert".split()
SOFT_TYPED = "type interface enum declare namespace module abstract implements public private protected readonly override keyof unique infer is asserts satisfies global out".split()

_SPACE = r"[ \t\v\f ﻿  　 - ]+"
_TOKEN = re.compile(
    r"(?P<s>" + _SPACE + r"|//[^\n\r]*|/\*(?:[^*\n\r]|\*(?!/))*\*/)"  # 1
    r"|(?P<n>\r\n?|\n|/\*(?s:.*?)\*/)"  # 2
    r"|(?P<w>[A-Za-z_$\u0080-\U0010ffff\\][\w$\u0080-\U0010ffff\\{}]*)"  # 3
    r"|(?P<d>0[xX][0-9a-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?n?)"  # 4
    r"|(?P<q>'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'|\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*\")"  # 5
    r"|(?P<p>\.\.\.|=>|\?\.(?!\d)|===|!==|==|!=|\*\*=|\*\*|<<=|<<|<=|&&=|&&|\|\|=|\|\||\?\?=|\?\?|\+\+|--|[-+*%&|^]=|[(){}\[\];,<>=!~?:.+\-*%&|^@])"  # 6
    r"|(?P<t>`)|(?P<r>/)|(?P<h>\#[A-Za-z_$][\w$]*|\#!)|(?P<e>[\s\S])"  # 7 8 9 10
)
_WORD = re.compile(r"[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*")
_TEXT = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(?:(`)|\$\{)")
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[A-Za-z]*")
#: After these a slash begins a regular expression.
_BEFORE_REGEX = frozenset("( [ { } , ; : ? ! ~ + - * % & | ^ = < > => && || ?? == != === !== += -= *= ** << <= &= |= ^= ...".split()) | frozenset(
    "return typeof case in of delete void throw new instanceof do else await yield extends default".split()
)
#: Tokens that end a statement's last line, or can't begin a line of its own.
_OPEN_END = frozenset("( [ { , ; : ? ! ~ + - * % & | ^ = < => && || ?? == != === !== += -= *= ** << <= &= |= ^= . ?. ...".split())
_CONTINUES = frozenset(") ] } , ; : ? * % & | ^ = > => && || ?? == != === !== += -= *= ** << <= &= |= ^= . ?. in instanceof".split())


def _language(name: str, text: str, typed: bool) -> Language:
    g = Grammar(text)
    objects = [
        C("block", "run", "Stmt"), C("object", "list", "Prop"), C("class", "run", "Member"), C("switch", "run", "Item"),
        C("specs", "list", "Spec"), C("pattern", "list", "PatProp"),
    ]
    squares = [C("array", "list", "Arg", holes=True), C("index", "whole", "Expr", empty=False), C("pattern", "list", "PatElem", holes=True)]
    rounds = [C("params", "list", "Param"), C("args", "list", "Arg"), C("expr", "whole", "Expr", empty=False), C("for", "whole", "For", empty=False)]
    if typed:
        objects += [C("members", "run", "Shape"), C("enum", "list", "EnumItem"), C("space", "run", "Top")]
        squares += [C("tuple", "list", "TupleElem"), C("sig", "whole", "Sig", empty=False), C("index", "whole", "T", empty=False)]
        rounds += [C("type", "whole", "T", empty=False)]
    return Language(
        name, g, {"{": objects, "[": squares, "(": rounds, "$": [C("expr", "whole", "Expr", empty=False)], "T": [C("text", "whole", "Holes")]},
        C("top", "run", "Top"), line_mark="line", implied="eol",
    )


_HEAD = """
Id : 'id' | Soft
Name : Id | Hard
Holes : '$expr'*
"""


def _words(typed: bool) -> str:
    hard = [w for w in RESERVED if not (typed and w == "enum")]
    soft = SOFT + (SOFT_TYPED if typed else [])
    return "Soft : " + " | ".join(f"'{w}'" for w in dict.fromkeys(soft)) + "\nHard : " + " | ".join(f"'{w}'" for w in hard) + "\n"


def javascript() -> Language:
    return _language("javascript", _HEAD + _words(False) + _STATEMENTS + _SCRIPT_ONLY, False)


def typescript() -> Language:
    return _language("typescript", _HEAD + _words(True) + _typed(_STATEMENTS) + _TYPED, True)


class Lexer:
    def __init__(self, lang: Language, typed: bool):
        g = lang.grammar
        self.word = {w: g.char(w) for w in RESERVED + SOFT + (SOFT_TYPED if typed else [])}
        self.punct = {w: g.char(w) for w in g.terminals if not w[0].isalpha() and not (w[0] in "({[$T" and len(w) > 1)}
        self.id, self.num, self.str, self.regex, self.priv = (g.char(x) for x in ("id", "num", "str", "regex", "priv"))
        self.bad, self.mark = g.char("\0"), lang.mark

    def __call__(self, text: str) -> tuple[list[tuple[str, str]], list[int], list[Defect]]:
        """(tokens, offsets, lexical defects)."""
        out: list[tuple[str, str]] = []
        at: list[int] = []
        broken: list[Defect] = []
        pos = 2 if text.startswith("#!") else 0
        if pos:
            pos = text.find("\n")
            pos = len(text) if pos < 0 else pos
        n, match, prev, line = len(text), _TOKEN.match, "", False
        stack: list[str] = []
        word, punct, mark = self.word, self.punct, self.mark

        def put(kind: str, c: str, spelled: str) -> None:
            nonlocal prev, line
            if line:
                line = False
                if prev and prev not in _OPEN_END and spelled not in _CONTINUES:
                    out.append(("p", mark))
                    at.append(pos)
            out.append((kind, c))
            at.append(pos)
            prev = spelled

        while pos < n:
            m = match(text, pos)
            k = m.lastindex
            if k == 1:
                pos = m.end()
                continue
            if k == 2:
                line = True
                pos = m.end()
                continue
            t = m.group()
            if k == 3:
                if "\\" in t or "{" in t or "}" in t:
                    # braces only belong to \u{...} escapes
                    w = re.compile(r"(?:[\w$\u0080-\U0010ffff]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})+").match(text, pos)
                    if not w:
                        put("p", self.bad, t[0])
                        pos += 1
                        continue
                    t = w.group()
                put("p", word.get(t) or self.id, t if t in word and prev not in (".", "?.") else "id")
                pos += len(t)
                continue
            if k == 6:
                if t in "([{":
                    put("o", t, t)
                    stack.append(t)
                elif t in ")]}":
                    if t == "}" and stack and stack[-1] == "$":
                        stack.pop()
                        put("c", "}", "}")
                        pos += 1
                        pos = self._text(text, pos, out, at, stack, broken)
                        prev = "id"
                        continue
                    if stack:
                        stack.pop()
                    put("c", t, ")" if t == ")" else "]" if t == "]" else "}")
                else:
                    put("p", punct.get(t) or self.bad, t)
                pos = m.end()
                continue
            if k == 4:
                put("p", self.num, "num")
            elif k == 5:
                put("p", self.str, "str")
            elif k == 7:
                put("o", "T", "tmpl")
                pos = self._text(text, pos + 1, out, at, stack, broken)
                prev = "id"
                continue
            elif k == 8:
                r = _REGEX.match(text, pos) if prev == "" or prev in _BEFORE_REGEX else None
                if r:
                    put("p", self.regex, "regex")
                    pos = r.end()
                    continue
                t = "/=" if text.startswith("/=", pos) else "/"
                put("p", punct[t], "+")
                pos += len(t)
                continue
            elif k == 9:
                put("p", self.priv, "id")
            else:
                if t in "'\"":
                    broken.append(Defect(1, len(out), "string"))
                    stop = text.find("\n", pos)
                    put("p", self.str, "str")
                    pos = n if stop < 0 else stop
                    continue
                put("p", self.bad, t)
            pos = m.end()
        return out, at, broken

    def _text(self, text, pos, out, at, stack, broken) -> int:
        """The text of a template from ``pos`` to its end or its next hole."""
        m = _TEXT.match(text, pos)
        if not m:
            broken.append(Defect(1, len(out), "template"))
            out.append(("c", "t"))
            at.append(pos)
            return len(text)
        if m.group(1):
            out.append(("c", "t"))
            at.append(m.end() - 1)
        else:
            out.append(("o", "$"))
            at.append(m.end() - 2)
            stack.append("$")
        return m.end()

"""Go."""

from __future__ import annotations

import re

from skein.llm.syntax.chart import Grammar
from skein.llm.syntax.simple import SimpleLexer
from skein.llm.syntax.trees import Category as C
from skein.llm.syntax.trees import Language

#: Reserved words.
RESERVED = "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()
#: A line that ends with one of these, a name or a literal ends a statement.
_ENDING = frozenset("break continue fallthrough return ++ -- ) ] }".split())

_GRAMMAR = """
Top : 'package' 'id' ';' | 'import' ImpSpec ';' | 'import' '(imports' ';' | Decl ';' | Func ';' | ';'
Func : 'func' 'id' TParams? Sig '{block' | 'func' 'id' TParams? Sig | 'func' '(params' 'id' Sig '{block' | 'func' '(params' 'id' Sig
ImpSpec : 'str' | 'id' 'str' | '.' 'str'
ImpLine : ImpSpec ';' | ImpSpec
TParams : '[tparams'
Sig : '(params' Result?
Result : Type | '(params'
Decl : 'var' VarSpec | 'var' '(vars' | 'const' VarSpec | 'const' '(vars' | 'type' TypeSpec | 'type' '(types'
VarSpec : Ids Type | Ids Type '=' Es | Ids '=' Es | Ids
VarLine : VarSpec ';' | VarSpec
TypeSpec : 'id' TParams? Type | 'id' '=' Type
TypeLine : TypeSpec ';' | TypeSpec
Ids : 'id' | 'id' ',' Ids
Type : TName | TName '[index' | TName '[list' | '*' Type | '[none' Type | '[index' Type | '[dots' Type | 'map' '[type' Type | Chan Type | 'func' Sig | 'struct' '{fields' | 'interface' '{methods' | '(type'
TName : 'id' | 'id' '.' 'id'
Chan : 'chan' | 'chan' '<-' | '<-' 'chan'
Field : Ids Type 'str'? FieldEnd | '*'? TName 'str'? FieldEnd | TName '[index' 'str'? FieldEnd | ';'
FieldEnd : ';' |
Method : 'id' Sig FieldEnd | Union FieldEnd | ';'
Union : UTerm | UTerm '|' Union
UTerm : Type | '~' Type
Param : Type | 'id' Type | 'id' '...' Type | '...' Type
TParam : 'id' Union | 'id'
Stmts : Stmt End
End : ';' |
Stmt : | Simple | Decl | 'go' E | 'defer' E | 'return' Es? | 'break' 'id'? | 'continue' 'id'? | 'goto' 'id' | 'fallthrough' | '{block' | If | For | Switch | 'select' '{switch' | 'id' ':' Stmt
Simple : E | Es Assign Es | Es ':=' Es | E '++' | E '--' | E '<-' E
Assign : '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^='
If : 'if' Head? E '{block' Else?
Else : 'else' If | 'else' '{block'
Head : Simple ';' | ';'
For : 'for' '{block' | 'for' E '{block' | 'for' Simple? ';' E? ';' Simple? '{block' | 'for' Es ':=' 'range' E '{block' | 'for' Es '=' 'range' E '{block' | 'for' 'range' E '{block'
Switch : 'switch' Head? '{switch' | 'switch' Head? E '{switch' | 'switch' Head? 'id' ':=' E '{switch'
Item : Label Item | Label | Stmts
Label : 'case' Es ':' | 'default' ':' | 'case' Simple ':'
Es : E | Es ',' E
E : Unary | E Bin Unary
Unary : Pre Unary | Mem
Pre : '+' | '-' | '!' | '^' | '*' | '&' | '<-' | '~'
Bin : '||' | '&&' | '==' | '!=' | '<' | '<=' | '>' | '>=' | '+' | '-' | '|' | '^' | '*' | '/' | '%' | '<<' | '>>' | '&' | '&^'
Mem : Operand | Mem '.' 'id' | Mem '.' '(type' | Mem '.' '(kind' | Mem '[index' | Mem '[slice' | Mem '[list' | Mem '(args' | Mem '{lit'
Operand : 'num' | 'str' | 'char' | 'id' | '(expr' | 'func' Sig '{block' | '[none' Type | '[index' Type | '[dots' Type | 'map' '[type' Type | Chan Type | 'struct' '{fields' | 'interface' '{methods' | 'func' Sig | '(type'
Arg : E | E '...' | Type
Elem : Value | Value ':' Value
Value : E | '{lit'
Kind : 'type'
Slice : E? ':' E? | E? ':' E ':' E
Dots : '...'
"""

_TOKEN = re.compile(
    r"([ \t\r]+|/\*[^\n]*?\*/)"
    r"|(\n|//[^\n]*|/\*(?s:.*?)\*/)"
    r"|([A-Za-z_\u0080-\U0010ffff][\w\u0080-\U0010ffff]*)"
    r"|(0[xX][0-9a-fA-F_.]+(?:[pP][+-]?\d+)?i?|0[bB][01_]+i?|0[oO][0-7_]+i?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?i?)"
    r"|(\"(?:[^\"\\\n]|\\[^\n])*\"|`[^`]*`)"
    r"|('(?:[^'\\\n]|\\[abfnrtv\\'\"]|\\[0-7]{3}|\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\U[0-9a-fA-F]{8})')"
    r"|(\.\.\.|:=|<-|\+\+|--|&&|\|\||<<=|>>=|&\^=|&\^|<<|>>|[=!<>]=|[-+*/%&|^]=|[(){}\[\];,.<>=!:+\-*/%&|^~])"
    r"|([\s\S])"
)


class Lexer(SimpleLexer):
    pattern = _TOKEN
    words = RESERVED

    def line_end(self, out, at, last, pos):
        if last in _ENDING or last and last[0].isalpha() and last not in self.word or last and (last[0] == "_" or last[0] > "\x7f"):
            out.append(("p", self.semi))
            at.append(pos)


def go() -> Language:
    braces = [C("block", "run", "Stmts"), C("switch", "run", "Item"), C("lit", "list", "Elem"), C("fields", "run", "Field"), C("methods", "run", "Method")]
    rounds = [
        C("params", "list", "Param"), C("args", "list", "Arg"), C("expr", "whole", "E", empty=False), C("type", "whole", "Type", empty=False), C("kind", "whole", "Kind", empty=False),
        C("imports", "run", "ImpLine"), C("vars", "run", "VarLine"), C("types", "run", "TypeLine"),
    ]
    squares = [
        C("none", "whole", "Never"), C("index", "whole", "E", empty=False), C("slice", "whole", "Slice", empty=False), C("list", "list", "Type", empty=False), C("type", "whole", "Type", empty=False),
        C("tparams", "list", "TParam", empty=False), C("dots", "whole", "Dots", empty=False),
    ]
    return Language("go", Grammar(_GRAMMAR + "Never : 'never'\n"), {"{": braces, "(": rounds, "[": squares}, C("top", "run", "Top"), after_brace=False)

"""Java 17."""

from __future__ import annotations

import re

from skein.llm.syntax.chart import Grammar
from skein.llm.syntax.simple import SimpleLexer
from skein.llm.syntax.trees import Category as C
from skein.llm.syntax.trees import Language

#: Reserved words, and words that are names except in some places.
RESERVED = "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null".split()
SOFT = "var record sealed permits yield module requires exports opens to uses provides with open transitive".split()

_GRAMMAR = """
Top : Annot* 'package' QName ';' | 'import' 'static'? QName ';' | 'import' 'static'? QName '.' '*' ';' | Mod* TypeDecl | ';' | Module
Module : Annot* 'open'? 'module' QName '{directives'
Directive : 'requires' DirWord* QName ';' | 'exports' QName ';' | 'exports' QName 'to' QNames ';' | 'opens' QName ';' | 'opens' QName 'to' QNames ';' | 'uses' QName ';' | 'provides' QName 'with' QNames ';'
DirWord : 'transitive' | 'static'
QNames : QName | QName ',' QNames
QName : Id | Id '.' QName
Mod : 'public' | 'protected' | 'private' | 'static' | 'abstract' | 'final' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | NonSealed | Annot
NonSealed : 'non' '-' 'sealed'
Annot : '@' QName | '@' QName '(annot'
TypeDecl : 'class' Id TParams? Ext? Impl? Permits? '{class' | 'interface' Id TParams? Exts? Permits? '{class' | 'enum' Id Impl? '{enum' | '@' 'interface' Id '{class'
  | 'record' Id TParams? '(params' Impl? '{class'
Ext : 'extends' Type
Exts : 'extends' Types
Impl : 'implements' Types
Permits : 'permits' Types
Types : Type | Type ',' Types
TParams : '<' TParamList '>'
TParamList : TParam | TParam ',' TParamList
TParam : Annot* Id | Annot* Id 'extends' Bound
Bound : Type | Type '&' Bound
Type : Annot* Base Dim*
Dim : '[none' | Annot '[none'
Base : Primitive | Cls
Primitive : 'boolean' | 'byte' | 'short' | 'int' | 'long' | 'char' | 'float' | 'double'
Cls : Id TArgs? | Id TArgs? '.' Annot* Cls
TArgs : '<' '>' | '<' TArgList '>'
TArgList : TArg | TArg ',' TArgList
TArg : Type | Annot* '?' | Annot* '?' 'extends' Type | Annot* '?' 'super' Type
Member : ';' | Mod* TypeDecl | 'static'? '{block' | Mod* TParams? Result Id '(params' Dim* Throws? MethodEnd | Mod* TParams? Id '(params' Throws? '{block'
  | Mod* Id '{block' | Mod* Type Vars ';'
Result : Type | 'void'
Throws : 'throws' Types
MethodEnd : '{block' | ';' | 'default' Value ';'
Value : E | Annot | '{values'
Pair : Id '=' Value | Value
Vars : VarD | VarD ',' Vars
VarD : Id Dim* | Id Dim* '=' Init
Init : E | '{init'
EnumConst : Annot* Id | Annot* Id '(args' | Annot* Id '{class' | Annot* Id '(args' '{class'
Param : ParMod* Type Id Dim* | ParMod* Type '...' Id | ParMod* Type Annot* '...' Id | ParMod* Type 'this' | ParMod* Type Id '.' 'this'
ParMod : 'final' | Annot
LamParam : Param | Id
Block : LocMod* Type Vars ';' | LocMod* TypeDecl | Stmt
LocMod : 'final' | 'abstract' | 'static' | 'strictfp' | Annot
Stmt : '{block' | ';' | 'if' '(expr' Stmt | 'if' '(expr' Stmt 'else' Stmt | 'while' '(expr' Stmt | 'do' Stmt 'while' '(expr' ';' | 'for' '(for' Stmt
  | 'switch' '(expr' '{switch' | 'return' E? ';' | 'break' Id? ';' | 'continue' Id? ';' | 'throw' E ';' | 'synchronized' '(expr' '{block'
  | 'try' '{block' Catch+ | 'try' '{block' Catch* Finally | 'try' '(res' '{block' Catch* Finally? | 'assert' E ';' | 'assert' E ':' E ';' | 'yield' E ';'
  | Id ':' Stmt | StmtE ';'
StmtE : Mem | Mem Assign E | Mem '++' | Mem '--' | '++' Unary | '--' Unary
Assign : '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' | '>' '>' '>='
Catch : 'catch' '(catch' '{block'
Finally : 'finally' '{block'
CatchP : ParMod* Alts Id
Alts : Cls | Cls '|' Alts
Res : LocMod* Type Id '=' E | Mem
Ress : Res | Res ';' | Res ';' Ress
Item : Label Item | Label | Rule | Block
Label : 'case' Cases ':' | 'default' ':'
Rule : 'case' Cases '->' RuleEnd | 'default' '->' RuleEnd
RuleEnd : E ';' | '{block' | 'throw' E ';'
Cases : Case | Case ',' Cases
Case : E | 'default' | Type Id
E : Chain | Chain '?' E ':' E | Lambda | Chain Bin Lambda
Chain : Unary | Chain Bin Unary | Chain 'instanceof' ParMod* Type Id?
Lambda : Id '->' LamBody | '(lambda' '->' LamBody
LamBody : E | '{block'
Unary : Pre Unary | '(cast' Unary | '(cast' Lambda | Mem | Mem '++' | Mem '--' | 'switch' '(expr' '{switch'
Pre : '+' | '-' | '!' | '~' | '++' | '--'
Bin : '*' | '/' | '%' | '+' | '-' | '<<' | '>' '>' | '>' '>' '>' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '&' | '^' | '|' | '&&' | '||' | Assign
Mem : Prim | Mem '.' Id | Mem '.' TArgs Id '(args' | Mem '(args' | Mem '[index' | Mem '.' 'new' Creator | Mem '.' 'this' | Mem '.' 'class' | Mem '.' 'super'
  | Mem '::' TArgs? Id | Mem '::' 'new' | Mem '.' TArgs 'super' '(args'
Prim : 'num' | 'str' | 'char' | 'true' | 'false' | 'null' | 'this' | 'super' | Id | '(expr' | 'new' TArgs? Creator | Primitive Dim* '.' 'class' | 'void' '.' 'class'
  | Cls Dim+ '.' 'class' | Primitive Dim+ '::' 'new' | Cls Dim+ '::' 'new' | Id TArgs '::' Id | Id TArgs '::' 'new'
Creator : Annot* Cls '(args' | Annot* Cls '(args' '{class' | Annot* Base DimE+ Dim* | Annot* Base Dim+ '{init'
DimE : '[index'
Arg : E
For : ForInit? ';' E? ';' Steps? | ParMod* Type Id ':' E
ForInit : ParMod* Type Vars | Steps
Steps : StmtE | StmtE ',' Steps
CastT : Bound
"""

_TOKEN = re.compile(
    r"([ \t\f]+|//[^\n\r]*|/\*(?s:.*?)\*/)"
    r"|(\r\n?|\n)"
    r"|([A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*)"
    r"|(0[xX][0-9a-fA-F_.]+(?:[pP][+-]?\d+)?[lLfFdD]?|0[bB][01_]+[lL]?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[lLfFdD]?)"
    r"|(\"\"\"[ \t\f]*[\r\n](?s:\\.|.)*?\"\"\"|\"(?!\"\")(?:[^\"\\\n\r]|\\[^\n\r])*\"|\"\"(?!\"))"
    r"|('(?:[^'\\\n\r]|\\u+[0-9a-fA-F]{4}|\\[^\n\r])'|'\\[0-7]{1,3}')"
    r"|(\.\.\.|->|::|\+\+|--|&&|\|\||<<=|<<|[<>=!]=|[-+*/%&|^]=|[(){}\[\];,.<>=!~?:+\-*/%&|^@])"
    r"|([\s\S])"
)


class Lexer(SimpleLexer):
    pattern = _TOKEN
    words = [*RESERVED, *SOFT, "non"]
    quotes = "'\""


def java() -> Language:
    text = "Id : 'id' | 'non' | " + " | ".join(f"'{w}'" for w in SOFT) + "\n" + _GRAMMAR
    braces = [
        C("block", "run", "Block"), C("class", "run", "Member"), C("switch", "run", "Item"), C("enum", "enum", "EnumConst", more="Member"),
        C("init", "list", "Init"), C("values", "list", "Value"), C("directives", "run", "Directive"),
    ]
    rounds = [
        C("params", "list", "Param", trailing=False), C("args", "list", "Arg", trailing=False), C("expr", "whole", "E", empty=False), C("cast", "whole", "CastT", empty=False),
        C("lambda", "list", "LamParam", trailing=False), C("for", "whole", "For", empty=False), C("catch", "whole", "CatchP", empty=False),
        C("res", "whole", "Ress", empty=False), C("annot", "list", "Pair", trailing=False),
    ]
    squares = [C("none", "whole", "Never", empty=True), C("index", "whole", "E", empty=False)]
    return Language("java", Grammar(text + "\nNever : 'never'\n"), {"{": braces, "(": rounds, "[": squares}, C("top", "run", "Top"))

"""JSON."""

from __future__ import annotations

import json
import re

from skein.llm.syntax.chart import Grammar
from skein.llm.syntax.simple import SimpleLexer
from skein.llm.syntax.trees import Category as C
from skein.llm.syntax.trees import Language

_GRAMMAR = """
Value : 'str' | 'num' | 'true' | 'false' | 'null' | '{object' | '[array'
Pair : 'str' ':' Value
"""
_TOKEN = re.compile(
    r"([ \t\r\n]+)|(\Z.)|([A-Za-z_$][\w$]*)|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?(?![\w.]))"
    r"|(\"(?:[^\"\\\x00-\x1f]|\\[\"\\/bfnrt]|\\u[0-9a-fA-F]{4})*\")|(\Z.)|([{}\[\],:;])|([\s\S])"
)


class Lexer(SimpleLexer):
    pattern = _TOKEN
    words = ["true", "false", "null"]
    quotes = '"'


def json_language() -> Language:
    inside = {
        "{": [C("object", "list", "Pair", trailing=False)], "[": [C("array", "list", "Value", trailing=False)], "(": [C("none", "whole", "Value", empty=False)],
    }
    return Language("json", Grammar(_GRAMMAR), inside, C("top", "whole", "Value", empty=False), after_brace=False)


def _refuse(name: str):
    raise ValueError(name)


def valid(text: str) -> bool:
    """The exact check."""
    try:
        json.loads(text, parse_constant=_refuse)
    except RecursionError:
        return True
    except ValueError:
        return False
    return True

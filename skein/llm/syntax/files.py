"""From a text and its language to its edit cost."""

from __future__ import annotations

import re
from functools import cache

from skein.llm.syntax import golang, java, jsons, python, script
from skein.llm.syntax.fast import SWEEPS
from skein.llm.syntax.trees import edit_cost

#: Spellings of the languages' names, and extensions.
NAMES = {
    "python": "python", "py": "python", "python3": "python", "javascript": "javascript", "js": "javascript", "node": "javascript", "ecmascript": "javascript", "mjs": "javascript", "cjs": "javascript",
    "typescript": "typescript", "ts": "typescript", "java": "java", "go": "go", "golang": "go", "json": "json",
}
EXTENSIONS = {"py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "mts": "typescript", "cts": "typescript", "java": "java", "go": "go", "json": "json"}
CONFLICT = re.compile(r"(?m)^(?:<{7}|={7}|>{7}|\|{7})(?=[ \r\n]|$)")

_MAKE = {
    "python": (python.python, lambda l: python.Lexer(l), python.valid),
    "javascript": (script.javascript, lambda l: script.Lexer(l, False), None),
    "typescript": (script.typescript, lambda l: script.Lexer(l, True), None),
    "java": (java.java, lambda l: java.Lexer(l), None),
    "go": (golang.go, lambda l: golang.Lexer(l), None),
    "json": (jsons.json_language, lambda l: jsons.Lexer(l), jsons.valid),
}


@cache
def tools(language: str):
    """Language, sweep, lexer and exact check, made once per worker."""
    make, lexer, exact = _MAKE[language]
    lang = make()
    return lang, SWEEPS[language](lang), lexer(lang), exact


def language_of(name: str | None, path: str | None) -> str | None:
    """The language by its recorded name, else by the extension of the path."""
    known = NAMES.get((name or "").strip().lower())
    if known:
        return known
    return EXTENSIONS.get((path or "").rpartition(".")[2].strip().lower()) if path and "." in path else None


def cost_of(text: str | None, language: str | None, track: bool = False) -> tuple[int, str, int, int]:
    """(edit cost, kind, first line, last line) of a text in a language.

    Blank texts and texts of other languages cost nothing; a leading byte order
    mark is no error.  Without ``track`` a broken text costs 1.  Kinds:
    ``conflict``, ``truncated``, ``mismatch`` (edits all over the text) and
    ``local``.  The chart alone decides; the exact parsers of Python and JSON
    serve the tests.
    """
    if not text or not text.strip() or language not in _MAKE:
        return 0, "", 0, 0
    text = text.removeprefix("﻿")
    lang, sweep, lexer, _ = tools(language)
    cost, defects, tokens, at = 0, [], [], []
    if not sweep.accepts(text):
        tokens, at, broken = lexer(text)
        cost, defects = edit_cost(lang, tokens, broken, track)
    if not cost or not track:
        return cost, "", 0, 0
    spots = [at[d.at] if d.at < len(at) else len(text) for d in defects] or [len(text)]
    lines = [text.count("\n", 0, s) for s in spots]
    marked = {text.count("\n", 0, m.start()) for m in CONFLICT.finditer(text)}
    n = text.count("\n") + 1
    size = len(tokens)
    if any(a - 1 <= x <= a + 1 for x in lines for a in marked):
        kind = "conflict"
    elif cost > 0.2 * size and size > 10 or len(set(lines)) > max(4, n // 4):
        kind = "mismatch"
    elif all(d.at >= size - 1 - size // 50 for d in defects[:1]) or min(lines) >= len(text.rstrip().split("\n")) - 2:
        kind = "truncated"
    else:
        kind = "truncated" if any(d.what == "unclosed" and d.at >= size for d in defects) or any(d.what in ("template", "comment") for d in defects) else "local"
    return cost, kind, min(lines) + 1, max(lines) + 1

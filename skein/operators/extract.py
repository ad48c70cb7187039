"""Facts from source files: one file row to many typed fact rows.

Every extractor yields (kind, name, owner, value, line).  Python goes through
its own parser; the other languages through patterns over text whose comments
and strings are blanked where they would mislead.  A file never fails: what
can't be read gives no facts.  Facts are emitted by ``mapInPandas``, one pass,
no shuffle; everything after extraction is relational.
"""

from __future__ import annotations

import ast
import bisect
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.labels import stable_id
from skein.storage import spread

Fact = tuple[str, str, str, str, int]
SCHEMA = "kind string, name string, owner string, value string, line int"
#: HTTP verbs of route calls and decorators.
VERBS = ("get", "post", "put", "patch", "delete", "head", "options", "all")


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def blank(text: str, pattern: re.Pattern) -> str:
    """The text with matches turned to blanks, line ends kept, so that offsets stay."""
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


_C_COMMENT = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/")
_SAFE = re.compile(r"'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|`(?:[^`\\]|\\.)*`|(//[^\n]*|/\*[\s\S]*?\*/)")


def without_comments(text: str) -> str:
    """Comments blanked, but not what looks like one inside a string."""
    return _SAFE.sub(lambda m: re.sub(r"[^\n]", " ", m.group()) if m.group(1) else m.group(), text)


def split_arguments(text: str, start: int) -> tuple[list[str], int]:
    """Arguments from the bracket at ``start``, split at top-level commas, and the place after its end."""
    out, depth, quote, begin, i = [], 0, "", start + 1, start
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "'\"`":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth == 0:
                last = text[begin:i].strip()
                return ([*out, last] if last or out else out), i + 1
        elif c == "," and depth == 1:
            out.append(text[begin:i].strip())
            begin = i + 1
        i += 1
    return out, len(text)


def _plain(text: str) -> str:
    return text[1:-1] if len(text) > 1 and text[0] in "'\"`" and text[-1] == text[0] else text


_JS_FUNCTION = re.compile(r"\b(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)|\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^()]*(?:\([^()]*\)[^()]*)*\)(?:\s*:[^=\n]+)?|[A-Za-z_$][\w$]*)\s*=>")
_JS_CLASS = re.compile(r"\bclass\s+([A-Za-z_$][\w$]*)(?:\s+extends\s+([\w$.]+))?")
_JS_IMPORT = re.compile(r"\bimport\s+(?:type\s+)?(?:([A-Za-z_$][\w$]*)\s*,?\s*)?(?:\*\s+as\s+([A-Za-z_$][\w$]*)\s*|\{([^}]*)\}\s*)?from\s*(['\"])([^'\"]+)\4|\bimport\s*(['\"])([^'\"]+)\6|\b(?:const|let|var)\s+(?:([A-Za-z_$][\w$]*)|\{([^}]*)\})\s*=\s*require\(\s*(['\"])([^'\"]+)\10\s*\)")
_JS_EXPORT = re.compile(r"\bexport\s+(?:default\s+)?(?:async\s+)?(?:abstract\s+)?(?:function\s*\*?|class|const|let|var|interface|type|enum)\s+([A-Za-z_$][\w$]*)|\bexport\s*\{([^}]*)\}|\b(?:module\.)?exports\.([A-Za-z_$][\w$]*)\s*=")
_JS_CALL = re.compile(r"\b([A-Za-z_$][\w$]*)\s*\.\s*(" + "|".join(VERBS) + r"|use|route)\s*\(")
_JS_FETCH = re.compile(r"\b(?:(fetch)|(axios)(?:\.(\w+))?)\s*\(")
_JSX_ROUTE = re.compile(r"<Route\b[^>]*?\bpath\s*=\s*\{?['\"]([^'\"]+)['\"][^>]*?(?:component|element)\s*=\s*\{<?\s*([\w.]+)")
_NEST = re.compile(r"@(Get|Post|Put|Patch|Delete|Head|Options|All|Controller|Injectable|Module|UseGuards)\s*\(([^)]*)\)")
_HOOK = re.compile(r"\b(use[A-Z]\w*)\s*\(")


def _names(text: str | None) -> Iterator[tuple[str, str]]:
    """(local, imported) of a list in braces."""
    for part in (text or "").split(","):
        m = re.match(r"\s*(?:type\s+)?([\w$]+)\s*(?:(?:as|:)\s*([\w$]+))?\s*$", part)
        if m:
            yield m.group(2) or m.group(1), m.group(1)


_CHAIN_LINK = re.compile(r"\s*\.\s*(" + "|".join(VERBS) + r")\s*\(")
_QUOTED = re.compile(r"'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|`(?:[^`\\]|\\.)*`")
_CALLED = re.compile(r"(?<![\w$.@])((?:new\s+)?[A-Za-z_$][\w$]*(?:\s*\.\s*[A-Za-z_$][\w$]*)*)\s*\(")
#: Words before a bracket that call nothing.
NO_CALLS = frozenset("if for while switch catch return function typeof instanceof in of await do else case throw delete void super synchronized try func go defer range select map chan var import".split())
_SCRIPT_SCOPE = re.compile(
    r"\bclass\s+([A-Za-z_$][\w$]*)[^{}();]*\{|\bfunction\s*\*?\s*([A-Za-z_$][\w$]*)\s*\(|\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=;\n]+)?=\s*(?:async\s+)?(?:function\b[^(]*)?\("
    r"|(?m:^)[ \t]*(?:(?:public|private|protected|static|async|get|set|readonly|override|abstract)\s+)*\*?\s*([A-Za-z_$#][\w$]*)\s*\("
)
_JAVA_SCOPE = re.compile(
    r"\b(?:class|interface|enum|record)\s+(\w+)[^{};]*\{|(?m:^)[ \t]*(?:(?:public|private|protected|static|final|abstract|synchronized|default|native)\s+)*(?:<[^<>]*>\s+)?()(?:[\w.]+(?:<[^;{}()]*>)?(?:\[\])*\s+)?()(\w+)\s*\("
)
_GO_SCOPE = re.compile(r"(?m:^)()func\s+(?:\(\s*\w*\s*\*?(\w+)[^)]*\)\s*)?()(\w+)\s*(?:\[[^\]]*\])?\(")


def _braces(t: str) -> dict[int, int]:
    """The place of the closing brace or bracket of each opening one."""
    stack, close = [], {}
    for m in re.finditer(r"[(){}]", t):
        if m.group() in "({":
            stack.append(m.start())
        elif stack:
            close[stack.pop()] = m.start()
    return close


def calls_within(t: str, scope: re.Pattern, receiver: bool = False) -> Iterator[Fact]:
    """``method`` facts of class members and ``call`` facts with the function or ``Class.method`` around them.

    ``t`` has neither comments nor strings.  Scopes are bodies in matched braces;
    one linear pass keeps the open ones.
    """
    close = _braces(t)
    bodies, defined = [], set()
    for m in scope.finditer(t):
        a, b, c, d = (m.group(i) if i <= m.re.groups else None for i in (1, 2, 3, 4))
        if m.group().endswith("{"):
            if m.end() - 1 in close:
                bodies.append((m.end() - 1, close[m.end() - 1], "class", a))
            continue
        name, at = d or c or b, m.end() - 1
        if name in NO_CALLS or at not in close:
            continue
        # after the arguments: a return type, an arrow or clauses, then the body
        body = re.compile(r"[^(){};]*(?:\([^(){};]*\)[^(){};]*)?\{").match(t, close[at] + 1)
        if body is None or "=" in body.group().replace("=>", ""):
            continue
        defined.add(m.start(len(m.groups()) if d else 3 if c else 2))
        bodies.append((body.end() - 1, close.get(body.end() - 1, len(t)), "member" if d else "function", f"{b}.{name}" if receiver and b else name))
    bodies.sort()
    events = [(m.start(1), m) for m in _CALLED.finditer(t)]
    open_, k = [], 0
    lines = [m.start() for m in re.finditer("\n", t)]
    line = lambda at: bisect.bisect_left(lines, at) + 1

    def enter(until: int) -> Iterator[Fact]:
        nonlocal k
        while k < len(bodies) and bodies[k][0] < until:
            begin, end, kind, name = bodies[k]
            while open_ and open_[-1][0] <= begin:
                open_.pop()
            around = next((n for e, kd, n in reversed(open_) if kd == "class"), "")
            if kind == "member" and around and open_ and open_[-1][1] == "class":
                yield "method", name, around, "", line(begin)
                name = f"{around}.{name}"
            open_.append((end, kind, name))
            k += 1

    for at, m in events:
        yield from enter(at)
        while open_ and open_[-1][0] <= at:
            open_.pop()
        name = re.sub(r"\s+", "", re.sub(r"^new\s+", "", m.group(1)))
        if name.split(".")[0] in NO_CALLS or at in defined:
            continue
        owner = next((n for e, kd, n in reversed(open_) if kd != "class"), next((n for e, kd, n in reversed(open_)), ""))
        yield "call", name, owner, "", line(at)
    yield from enter(len(t) + 1)


def script_facts(text: str) -> Iterator[Fact]:
    t = without_comments(text)
    for m in _JS_FUNCTION.finditer(t):
        yield "function", m.group(1) or m.group(2), "", "", _line(t, m.start())
    for m in _JS_CLASS.finditer(t):
        yield "class", m.group(1), "", m.group(2) or "", _line(t, m.start())
    for m in _JS_IMPORT.finditer(t):
        source, line = m.group(5) or m.group(7) or m.group(11), _line(t, m.start())
        pairs = [(m.group(1), "default")] if m.group(1) else []
        pairs += [(m.group(2), "*")] if m.group(2) else []
        pairs += [(m.group(8), "*")] if m.group(8) else []
        pairs += [*_names(m.group(3)), *_names(m.group(9))]
        for local, imported in pairs or [("", "")]:
            yield "import", source, local, imported, line
    for m in _JS_EXPORT.finditer(t):
        for local, name in [(m.group(1) or m.group(3), "")] if m.group(1) or m.group(3) else _names(m.group(2)):
            yield "export", local, "", name, _line(t, m.start())
    for m in _JS_CALL.finditer(t):
        args, end = split_arguments(t, m.end() - 1)
        owner, verb, line = m.group(1), m.group(2), _line(t, m.start())
        if not args or args[0][:1] not in "'\"`/":
            if verb == "use" and args and owner in ("app", "router", "server"):
                for i, a in enumerate(args):
                    yield "middleware", a.split("(")[0], owner, str(i), line
            continue
        path = _plain(args[0])
        if verb == "use":
            yield "mount", path, owner, args[-1].split("(")[0] if len(args) > 1 else "", line
            for i, a in enumerate(args[1:-1]):
                yield "middleware", a.split("(")[0], f"{owner} {path}", str(i), line
        elif verb == "route":
            # the chain goes on from the end of each verb's arguments
            while link := _CHAIN_LINK.match(t, end):
                yield "endpoint", f"{link.group(1).upper()} {path}", owner, "", line
                end = split_arguments(t, link.end() - 1)[1]
        elif path.startswith("/") and len(args) > 1:
            handler = args[-1] if re.fullmatch(r"[\w$.]+", args[-1]) else "inline"
            yield "endpoint", f"{verb.upper()} {path}", owner, handler, line
            for i, a in enumerate(args[1:-1]):
                yield "middleware", a.split("(")[0].strip("[] "), f"{verb.upper()} {path}", str(i), line
    base = ""
    for m in _NEST.finditer(t):
        word, arg = m.group(1), _plain(m.group(2).strip())
        if word == "Controller":
            base = arg
        elif word in ("Injectable", "Module", "UseGuards"):
            yield "decorator", word, "", arg, _line(t, m.start())
        else:
            yield "endpoint", f"{word.upper()} /{base}/{arg}".replace("//", "/").rstrip("/"), "controller", "", _line(t, m.start())
    yield from calls_within(blank(t, _QUOTED), _SCRIPT_SCOPE)
    for m in _JS_FETCH.finditer(t):
        yield "api_call", m.group(1) or m.group(2), "", m.group(3) or "get", _line(t, m.start())
    for m in _JSX_ROUTE.finditer(t):
        yield "jsx_route", m.group(1), "", m.group(2), _line(t, m.start())
    for m in _HOOK.finditer(t):
        yield "hook", m.group(1), "", "", _line(t, m.start())
    yield "complexity", "branches", "", str(len(re.findall(r"\b(?:if|for|while|case|catch)\b|\?\s|&&|\|\|", t))), 1


class _PythonVisitor(ast.NodeVisitor):
    def __init__(self):
        self.facts: list[Fact] = []
        self.owner: list[str] = []
        self.branches = 0

    def add(self, kind, name, value="", line=1):
        self.facts.append((kind, name, ".".join(self.owner), value, line))

    def _call(self, node: ast.expr, kind: str, of: str) -> None:
        f = node.func if isinstance(node, ast.Call) else node
        try:
            name = ast.unparse(f)
        except ValueError:
            return
        self.add("decorator", name, of, node.lineno)
        verb = name.rpartition(".")[2]
        if isinstance(node, ast.Call) and node.args and isinstance(node.args[0], ast.Constant) and isinstance(node.args[0].value, str):
            path = node.args[0].value
            if verb in VERBS:
                self.add("endpoint", f"{verb.upper()} {path}", of, node.lineno)
            elif verb == "route":
                methods = next((k.value for k in node.keywords if k.arg == "methods"), None)
                verbs = [e.value for e in getattr(methods, "elts", []) if isinstance(e, ast.Constant)] or ["GET"]
                for v in verbs:
                    self.add("endpoint", f"{str(v).upper()} {path}", of, node.lineno)

    def _body(self, node, kind):
        for d in node.decorator_list:
            self._call(d, kind, node.name)
        self.add("method" if self.owner and kind == "function" else kind, node.name, ",".join(ast.unparse(b) for b in getattr(node, "bases", [])), node.lineno)
        doc = ast.get_docstring(node, clean=False)
        if doc:
            self.add("docstring", node.name, doc.strip().split("\n")[0], node.lineno)
        self.owner.append(node.name)
        self.generic_visit(node)
        self.owner.pop()

    def visit_FunctionDef(self, node):
        self._body(node, "function")

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node):
        self._body(node, "class")
        for x in node.body:
            if isinstance(x, ast.AnnAssign) and isinstance(x.target, ast.Name):
                t = ast.unparse(x.annotation)
                self.facts.append(("model_field", x.target.id, node.name, t + ("" if x.value is not None or "Optional" in t or "None" in t else "!"), x.lineno))

    def visit_Import(self, node):
        for a in node.names:
            self.add("import", a.name, a.asname or a.name, node.lineno)

    def visit_ImportFrom(self, node):
        for a in node.names:
            self.facts.append(("import", "." * node.level + (node.module or ""), a.asname or a.name, a.name, node.lineno))

    def visit_Call(self, node):
        try:
            name = ast.unparse(node.func)
        except ValueError:
            name = ""
        if name.endswith(("include_router", "register_blueprint")) and node.args:
            prefix = next((k.value.value for k in node.keywords if k.arg in ("prefix", "url_prefix") and isinstance(k.value, ast.Constant)), "")
            self.add("mount", str(prefix), ast.unparse(node.args[0]), node.lineno)
        if name:
            self.add("call", re.sub(r"\s+", " ", name), "", node.lineno)
        self.generic_visit(node)

    def generic_visit(self, node):
        self.branches += isinstance(node, (ast.If, ast.For, ast.While, ast.Try, ast.With, ast.BoolOp, ast.IfExp, ast.comprehension))
        super().generic_visit(node)


_PY_DEF = re.compile(r"(?m)^[ \t]*(?:async[ \t]+)?(def|class)[ \t]+(\w+)")
_PY_IMPORT = re.compile(r"(?m)^[ \t]*(?:from[ \t]+([.\w]+)[ \t]+import[ \t]+([^\n#(]+)|import[ \t]+([^\n#]+))")


def python_facts(text: str) -> Iterator[Fact]:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text.removeprefix("﻿"))
        v = _PythonVisitor()
        v.visit(tree)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        for m in _PY_DEF.finditer(text):
            yield "class" if m.group(1) == "class" else "function", m.group(2), "", "", _line(text, m.start())
        for m in _PY_IMPORT.finditer(text):
            yield "import", m.group(1) or m.group(3).strip(), "", (m.group(2) or "").strip(), _line(text, m.start())
        return
    yield from v.facts
    yield "complexity", "branches", "", str(v.branches), 1


_JAVA_TYPE = re.compile(r"\b(class|interface|enum|record)\s+(\w+)(?:<[^{>]*>)?(?:\s+extends\s+([\w.<>, ]+?))?(?:\s+implements\s+([\w.<>, ]+?))?\s*[{(]")
_JAVA_METHOD = re.compile(r"(?m)^[ \t]*((?:(?:public|protected|private|static|final|abstract|synchronized|default|native)\s+)+)(?:<[^>]+>\s+)?([\w.<>\[\], ?]+?)\s+(\w+)\s*\(([^)]*)\)\s*(?:throws\s+[\w., ]+)?\s*[{;]")
_JAVA_MAP = re.compile(r"@(Get|Post|Put|Patch|Delete|Request)Mapping\b(?:\s*\(([^)]*)\))?")
_JAVA_NOTE = re.compile(r"@(\w+)(?:\s*\(([^)]*)\))?")
_JAVA_FIELD = re.compile(r"(?m)^[ \t]*(?:(?:public|protected|private|static|final|transient|volatile)\s+)+([\w.<>\[\], ]+?)\s+(\w+)\s*(?:=[^;]*)?;")
_JAVA_IMPORT = re.compile(r"(?m)^\s*import\s+(?:static\s+)?([\w.*]+)\s*;")


_JAVA_CLASS_HEAD = re.compile(r"\s*(?:(?:public|final|abstract|sealed)\s+)*class\b")
_JAVA_NEXT_NOTE = re.compile(r"\s*@[\w.]+\s*(\()?")


def _after_annotations(t: str, at: int) -> int:
    """The place behind all annotations that follow ``at``, however long their arguments."""
    while m := _JAVA_NEXT_NOTE.match(t, at):
        at = split_arguments(t, m.end() - 1)[1] if m.group(1) else m.end()
    return at


def java_facts(text: str) -> Iterator[Fact]:
    t = without_comments(text)
    owners = [(m.start(), m.group(2)) for m in _JAVA_TYPE.finditer(t)]
    owner = lambda at: next((n for s, n in reversed(owners) if s <= at), "")
    for m in _JAVA_TYPE.finditer(t):
        yield "class", m.group(2), m.group(1), ",".join(x.strip() for x in (m.group(3), m.group(4)) if x), _line(t, m.start())
    for m in _JAVA_IMPORT.finditer(t):
        yield "import", m.group(1), "", "", _line(t, m.start())
    for m in _JAVA_METHOD.finditer(t):
        yield "method", m.group(3), owner(m.start()), m.group(2).strip(), _line(t, m.start())
    named = {m.group(3) for m in _JAVA_METHOD.finditer(t)}
    for kind, name, around, value, line in calls_within(blank(t, _QUOTED), _JAVA_SCOPE):
        # members without a modifier and constructors
        if kind == "call" or name not in named:
            yield kind, name, around, value, line
    for m in _JAVA_FIELD.finditer(t):
        yield "model_field", m.group(2), owner(m.start()), m.group(1).strip(), _line(t, m.start())
    for m in _JAVA_NOTE.finditer(t):
        yield "annotation", m.group(1), owner(m.start()), (m.group(2) or "").strip(), _line(t, m.start())
    base = ""
    for m in _JAVA_MAP.finditer(t):
        path = re.search(r"\"([^\"]*)\"", m.group(2) or "")
        path = path.group(1) if path else ""
        if m.group(1) == "Request" and _JAVA_CLASS_HEAD.match(t, _after_annotations(t, m.end())):
            base = path
            continue
        verb = m.group(1).upper() if m.group(1) != "Request" else (re.search(r"RequestMethod\.(\w+)", m.group(2) or "") or [0, "GET"])[1]
        yield "endpoint", f"{verb} " + re.sub("/+", "/", f"/{base}/{path}").rstrip("/"), owner(m.start()), "", _line(t, m.start())
    yield "complexity", "branches", "", str(len(re.findall(r"\b(?:if|for|while|case|catch)\b|\?\s|&&|\|\|", t))), 1


_GO_FUNC = re.compile(r"(?m)^func\s+(?:\(\s*\w*\s*\*?(\w+)[^)]*\)\s*)?(\w+)\s*[(\[]")
_GO_TYPE = re.compile(r"(?m)^type\s+(\w+)\s+(struct|interface)\s*\{")
_GO_IMPORT = re.compile(r"(?m)^\s*(?:import\s+)?(?:\w+\s+)?\"([\w./-]+)\"\s*$")
_GO_FIELD = re.compile(r"(?m)^\t(\w+)\s+([\w\[\]*.{}]+)(?:\s+`([^`]*)`)?$")


def go_facts(text: str) -> Iterator[Fact]:
    t = without_comments(text)
    for m in _GO_FUNC.finditer(t):
        yield "method" if m.group(1) else "function", m.group(2), m.group(1) or "", "", _line(t, m.start())
    for m in _GO_TYPE.finditer(t):
        yield "class", m.group(1), m.group(2), "", _line(t, m.start())
        if m.group(2) == "struct":
            end = t.find("\n}", m.end())
            for f in _GO_FIELD.finditer(t[m.end() : end if end > 0 else len(t)]):
                yield "model_field", f.group(1), m.group(1), f.group(2), _line(t, m.end() + f.start())
    for fact in calls_within(blank(t, _QUOTED), _GO_SCOPE, receiver=True):
        if fact[0] == "call":
            yield fact
    head = t.split("\nfunc ", 1)[0]
    for m in _GO_IMPORT.finditer(head):
        yield "import", m.group(1), "", "", _line(t, m.start())


_TS_MODEL = re.compile(r"\b(?:interface|class)\s+([A-Za-z_$][\w$]*)[^{;=]*\{")
_TS_FIELD = re.compile(r"(?m)^[ \t]*(?:(?:public|private|protected|readonly|static)\s+)*([A-Za-z_$][\w$]*)(\?)?\s*:\s*([^;=\n]+?)\s*[;,]?\s*$")
_TS_ALIAS = re.compile(r"\btype\s+([A-Za-z_$][\w$]*)\s*=\s*([^;\n]+)")
_TS_ENUM = re.compile(r"\benum\s+([A-Za-z_$][\w$]*)\s*\{([^}]*)\}")
_ZOD = re.compile(r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:z|Joi)\.object\s*\(")
_MONGOOSE = re.compile(r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*new\s+(?:mongoose\.)?Schema\s*\(")
_PRISMA = re.compile(r"(?m)^model\s+(\w+)\s*\{([^}]*)\}")


def _closing(t: str, at: int) -> int:
    depth = 0
    for i in range(at, len(t)):
        depth += (t[i] == "{") - (t[i] == "}")
        if depth == 0:
            return i
    return len(t)


def model_facts(text: str) -> Iterator[Fact]:
    """Fields of interfaces, classes, enums, validators and document schemas in script text; ``!`` ends a required type."""
    t = without_comments(text)
    for m in _TS_MODEL.finditer(t):
        end = _closing(t, m.end() - 1)
        body = t[m.end() : end]
        depth = 0
        for line_no, row in enumerate(body.split("\n")):
            f = _TS_FIELD.match(row) if depth == 0 else None
            if f and "(" not in f.group(3).split("=>")[0]:
                yield "model_field", f.group(1), m.group(1), f.group(3).strip() + ("" if f.group(2) or "null" in f.group(3) else "!"), _line(t, m.end()) + line_no
            depth += row.count("{") - row.count("}")
    for m in _TS_ALIAS.finditer(t):
        yield "type_alias", m.group(1), "", m.group(2).strip(), _line(t, m.start())
    for m in _TS_ENUM.finditer(t):
        for v in m.group(2).split(","):
            if v.strip():
                yield "enum_value", v.split("=")[0].strip(), m.group(1), v.partition("=")[2].strip(), _line(t, m.start())
    for pattern in (_ZOD, _MONGOOSE):
        for m in pattern.finditer(t):
            args, _ = split_arguments(t, m.end() - 1)
            if args and args[0].startswith("{"):
                for part in split_arguments(args[0], 0)[0]:
                    name, _, value = part.partition(":")
                    value = value.strip()
                    required = "required: true" in value if pattern is _MONGOOSE else ".optional()" not in value
                    kind = re.search(r"type:\s*(\[?[\w.]+)|^\[?\s*([\w.]+)|z\.(\w+)", value)
                    if name.strip():
                        yield "model_field", name.strip().strip("'\""), m.group(1), (next((g for g in kind.groups() if g), "") if kind else "") + ("!" if required else ""), _line(t, m.start())
                    ref = re.search(r"ref:\s*['\"](\w+)['\"]", value)
                    if ref:
                        yield "reference", ref.group(1), m.group(1), name.strip(), _line(t, m.start())


def prisma_facts(text: str) -> Iterator[Fact]:
    for m in _PRISMA.finditer(text):
        for i, row in enumerate(m.group(2).split("\n")):
            f = re.match(r"\s*(\w+)\s+(\w+)(\?|\[\])?(.*)", row)
            if f and not row.strip().startswith("@@"):
                yield "model_field", f.group(1), m.group(1), f.group(2) + (f.group(3) or "!"), _line(text, m.start()) + i


def sql_facts(text: str) -> Iterator[Fact]:
    for m in re.finditer(r"(?i)\b(create|alter|drop)\s+table\s+(?:if\s+(?:not\s+)?exists\s+)?[\"`]?([\w.]+)", text):
        yield "ddl", m.group(2).lower(), "", m.group(1).lower(), _line(text, m.start())
    for m in re.finditer(r"(?i)foreign\s+key\s*\(([^)]*)\)\s*references\s+[\"`]?([\w.]+)", text):
        yield "reference", m.group(2).lower(), "", m.group(1).strip(), _line(text, m.start())


def docker_facts(text: str) -> Iterator[Fact]:
    """Instructions in order; continued lines are one."""
    joined = re.sub(r"\\\s*\n", " ", text)
    for i, row in enumerate(joined.split("\n")):
        m = re.match(r"\s*(FROM|EXPOSE|ENV|USER|ENTRYPOINT|CMD|VOLUME|WORKDIR|RUN)\s+(.+)", row, re.I)
        if not m:
            continue
        word, rest = m.group(1).upper(), m.group(2).strip()
        if word == "ENV":
            for k, v in re.findall(r"(\w+)=(\"[^\"]*\"|\S+)", rest) or [tuple((rest.split(None, 1) + [""])[:2])]:
                yield "docker", "ENV", k, v.strip('"'), i + 1
        elif word == "EXPOSE":
            for p in rest.split():
                yield "docker", "EXPOSE", p, "", i + 1
        else:
            yield "docker", word, "", rest, i + 1


def workflow_facts(text: str) -> Iterator[Fact]:
    """Triggers, jobs, permissions and environment of a CI file, by indentation."""
    path: list[tuple[int, str]] = []
    for i, row in enumerate(text.split("\n")):
        m = re.match(r"( *)(?:- )?([\w.-]+)\s*:\s*(.*)$", row.split(" #")[0])
        if not m:
            continue
        depth = len(m.group(1))
        while path and path[-1][0] >= depth:
            path.pop()
        path.append((depth, m.group(2)))
        keys = [k for _, k in path]
        value = m.group(3).strip()
        if keys[0] in ("on", "true") and len(keys) == 1 and value:
            for t in re.findall(r"\w+", value):
                yield "workflow", "trigger", t, "", i + 1
        elif keys[0] == "on" and len(keys) == 2:
            yield "workflow", "trigger", keys[1], value, i + 1
        elif keys[0] == "jobs" and len(keys) == 2:
            yield "workflow", "job", keys[1], value, i + 1
        elif len(keys) >= 2 and keys[-2] == "permissions":
            yield "workflow", "permission", keys[-1], value, i + 1
        elif len(keys) >= 2 and keys[-2] == "env":
            yield "workflow", "env", keys[-1], value, i + 1
        elif keys[-1] in ("timeout-minutes", "concurrency"):
            yield "workflow", keys[-1], ".".join(keys[:-1]), value, i + 1


def facts_of(path: str | None, text: str | None) -> list[Fact]:
    """All facts of a file by its name; empty for unknown kinds and unreadable texts."""
    if not path or not text:
        return []
    name = path.rpartition("/")[2].lower()
    ext = name.rpartition(".")[2]
    out: list[Fact] = []
    if name.startswith("dockerfile"):
        out += docker_facts(text)
    elif ext in ("yml", "yaml"):
        out += workflow_facts(text)
    elif ext in ("js", "jsx", "mjs", "cjs", "ts", "tsx"):
        out += script_facts(text)
        out += model_facts(text)
    elif ext == "py":
        out += python_facts(text)
    elif ext == "java":
        out += java_facts(text)
    elif ext == "go":
        out += go_facts(text)
    elif ext == "prisma":
        out += prisma_facts(text)
    elif ext == "sql":
        out += sql_facts(text)
    return out


def balanced(text: str) -> bool:
    """Do brackets match once strings and comments are left out."""
    stack = []
    for c in re.sub(r"'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|`(?:[^`\\]|\\.)*`|//[^\n]*|#[^\n]*|/\*[\s\S]*?\*/", "", text or ""):
        if c in "([{":
            stack.append(c)
        elif c in ")]}" and (not stack or stack.pop() + c not in ("()", "[]", "{}")):
            return False
    return not stack


def file_facts(files: DataFrame, keep: list[str], path: str = "file_path", text: str = "text", extract=facts_of) -> DataFrame:
    """``keep`` columns and one row per fact; ``extract(path, text)`` may be replaced.

    A failing extractor gives one row of kind ``error`` with the message, so one
    bad file never stops a run.
    """

    def run(batches):
        for b in batches:
            rows = []
            for head in b.itertuples(index=False):
                p, t = head[-2], head[-1]
                try:
                    got = extract(p, t)
                except Exception as e:  # noqa: BLE001
                    got = [("error", type(e).__name__, "", str(e)[:200], 0)]
                rows += [(*head[:-2], *f) for f in got]
            yield pd.DataFrame(rows, columns=[*keep, "kind", "name", "owner", "value", "line"])

    src = files.select(*keep, F.col(path).alias("_path"), F.col(text).alias("_text"))
    schema = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in keep)
    return spread(src).mapInPandas(run, f"{schema}, {SCHEMA}")


def symbol_ids(facts: DataFrame, path: str) -> DataFrame:
    """(symbol_id, kind, name, path): stable ids of functions, classes, methods and exports, once each."""
    s = facts.where(F.col("kind").isin("function", "class", "method", "export"))
    return s.select(stable_id(kind=F.col("kind"), name=F.col("name"), owner=F.col("owner"), path=F.col(path)).alias("symbol_id"), "kind", "name", "owner", F.col(path).alias("path")).distinct()

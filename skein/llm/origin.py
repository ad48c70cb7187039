"""Generated, minified or vendored source files (problem 7).

Repositories may declare such paths in attribute files (``.gitattributes``).
Those are parsed, and for each file the last matching rule of the deepest
directory wins; below them stands one attribute file of well-known globs for
all repositories.  Most repositories declare little, so equivalent patterns are
mined: path patterns, phrases of head comments, openings of lines and shapes of
a text (how much of it is literals, long lines, numbered members).  A pattern is
kept where its files are seeds nearly always, often enough and in several
repositories.  Seeds are looked for among all files: those the well-known globs
name, and those whose text gives evidence of its own.  Evidence makes seeds
only: rules and mined patterns alone decide.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.paths import canonical_path
from skein.storage import materialize, spread

#: Attribute names and the class they declare.
ATTRIBUTES = {"linguist-generated": "generated", "linguist-vendored": "vendored", "minified": "minified"}
#: Well-known globs, as an attribute file of every repository.  In a directory of
#: packages each package has a directory of its own: a file right below it is none.
WELL_KNOWN = """
**/node_modules/*/** linguist-vendored
**/bower_components/*/** linguist-vendored
**/jspm_packages/*/** linguist-vendored
**/site-packages/*/** linguist-vendored
**/third_party/*/** linguist-vendored
**/third-party/*/** linguist-vendored
**/vendor/*/** linguist-vendored
**/_vendor/*/** linguist-vendored
**/extern/*/** linguist-vendored
**/Pods/*/** linguist-vendored
*.min.js minified
*.min.mjs minified
*.min.css minified
*.chunk.js minified
*.bundle.js minified
**/__generated__/** linguist-generated
**/generated/source/** linguist-generated
**/generated/sources/** linguist-generated
**/generated-sources/** linguist-generated
*_pb2.py linguist-generated
*_pb2_grpc.py linguist-generated
*_pb.js linguist-generated
*_pb.ts linguist-generated
*_pb.d.ts linguist-generated
*.pb.go linguist-generated
*_gen.go linguist-generated
zz_generated.* linguist-generated
*.generated.* linguist-generated
*_generated.* linguist-generated
*.g.cs linguist-generated
*.g.dart linguist-generated
*.[dD]esigner.cs linguist-generated
package-lock.json linguist-generated
npm-shrinkwrap.json linguist-generated
packages.lock.json linguist-generated
composer.lock linguist-generated
poetry.lock linguist-generated
Pipfile.lock linguist-generated
Cargo.lock linguist-generated
Gemfile.lock linguist-generated
yarn.lock linguist-generated
pnpm-lock.yaml linguist-generated
go.sum linguist-generated
"""

#: Comment lines at the head of a file by which it declares a tool.
GENERATED_HEAD = re.compile(
    r"""(?ix)
    @generated\b | <auto-?generated | \bcode\s+generated\s+by\b | \bauto-?generated\s+(file|by|on|from|code)\b | \bautogenerated\b
  | \bautomatically\s+generated\b | \bgenerated\s+(from|by|with)\s+\S+ | \bdo\s+not\s+(edit|modify)\b(?!\s+the\s+licen[sc]e) | \bmachine[ -](written|generated)\b
  | \boutput\s+of\s+\S+\s+-- | \bregenerate\s+with\b
  | automatisch\s+(erzeugt|generiert) | nicht\s+bearbeiten | (produit|g[ée]n[ée]r[ée])\s+(par|automatiquement) | ne\s+pas\s+modifier
  | generado\s+(por|autom) | no\s+(editar|modificar) | 自動生成 | 自动生成 | 編集しないで | 请勿(编辑|修改)
    """
)
#: Comment lines by which a file declares a foreign project.
VENDORED_HEAD = re.compile(
    r"""(?ix)
    @license\s+\S+\s+v?\d | released\s+under\s+the\s+.*\blicen[sc]e\s+by\s+the\b | \(c\)\s*\d{4}.*\bcontributors\b
  | ^\W*[\w.-]+\s+v\d+(\.\d+)+\W*$ | \bcopyright\s+the\s+(?!maintainers|authors\s+of\s+this)\S+\s+(project|authors|developers)\b
  | \bcopyright\s+\S+\s+foundation\b | \blibrary,?\s+(version|v)\s*\d | \bjavascript\s+library\s+v\d
  | ^\W*copied\s+(verbatim\s+)?from\s+\S+\s+v?\d | \bupstream\s+file\b | ^\W*vendored\s+from\b
    """
)
#: Heads that speak of generated or vendored files but deny being one.
DENIAL = re.compile(
    r"(?i)\b(formerly|previously|used to be|no longer|not|never|instead of|replaces?|replaced|once)\b.{0,40}\b(auto-?generated|generated|vendored|minified)\b"
    r"|\bmaintained by hand\b|\bwritten by hand\b|\bon purpose\b|\bwe removed\b"
)
COMMENT = re.compile(r"^\s*(//|#(?!!)|/\*|\*|<!--|--|;|\"\"\"|''')")
LINE = re.compile(r"[^\n]+")
COMPILED = re.compile(r"^(var|const|let) __(awaiter|generator|importDefault|importStar|createBinding|extends|decorate|assign|rest|spreadArray|exportStar)\b|__webpack_require__|^Object\.defineProperty\(exports, .__esModule.|^//# sourceMappingURL=", re.M)
#: Numbered members such as ``getRankLimit645``, as accessors come out of templates.
NUMBERED = re.compile(r"\b(?:get|set|read|write|has|clear|put|fetch|is|with|add)?_?[A-Za-z]+(?:_[a-z]+)*_?(\d+)\b\s*\(")
SLOT = re.compile(r"\[\s*(\d+)\s*\]")
#: Comments without quotes in them, which would look like code among literals.
SPOKEN = re.compile(r"^\s*(?://|#)[^'\"\n]*$", re.M)
#: Quoted strings that read as values (no blanks next to signs of code) and numbers; the set of first characters makes the search fast.
LITERAL = re.compile(
    r"""['"\-\d](?:(?<=')[^'\n ]+'|(?<=")[^"\n ]+"|(?<=-)\d+(?:\.\d+)?(?:[eE][-+]?\d+)?\b"""
    r"""|(?<=\d)(?<!\w\d)(?:(?<=0)x[0-9a-fA-F]+\b|\d*(?:\.\d+)?(?:[eE][-+]?\d+)?\b))"""
)
#: Values in JSON, where a string followed by a colon is a name.
JSON_VALUE = re.compile(r'"(?:[^"\\\n]|\\.)*"(?!\s*:)|-?\b\d+(?:\.\d+)?(?:[eE][-+]?\d+)?\b|\b(?:true|false|null)\b')
WORDS = re.compile(r"\w+")
#: A call whose name ends in a digit; every numbered member is one.
CALLED = re.compile(r"\d\s*\(")
STATEMENT = re.compile(r"[;{}]|=>|lambda ")


def head_lines(text: str) -> list[str]:
    """All comment lines before the first code, leaving out a package or script line."""
    out, end = [], ""
    for m in LINE.finditer(text.lstrip("﻿ \r\n\t")):
        s = m.group().strip()
        if not end and (s.startswith("#!") or re.match(r"package [\w.]+;?$|['\"]use strict['\"];?$", s)):
            continue
        if not end and s and not COMMENT.match(s):
            break
        if s:
            out.append(s)
        # inside a block comment lines need no sign of their own
        if end:
            end = "" if end in s else end
        elif s.startswith(("/*", "<!--")):
            close, start = ("*/", 2) if s.startswith("/*") else ("-->", 4)
            end = "" if s.find(close, start) >= 0 else close
    return out


def declared_head(text: str) -> str | None:
    """``generated`` or ``vendored`` where the head comments say so of this file."""
    lines = [x for x in head_lines(text) if not DENIAL.search(x)]
    if any(GENERATED_HEAD.search(x) for x in lines):
        return "generated"
    if any(VENDORED_HEAD.search(x) for x in lines):
        return "vendored"
    return None


def is_minified(text: str) -> bool:
    """Most of the code lies on lines far beyond what is typed, dense in statements and free of blanks."""
    lines = [x for x in text.split("\n") if x.strip()]
    body = [x for x in lines if not COMMENT.match(x)]
    size = sum(map(len, body))
    long = [x for x in body if len(x) > 220]
    if not size or sum(map(len, long)) < 0.7 * size:
        return False
    code = "\n".join(long)
    blanks = code.count(" ") / len(code)
    return blanks < 0.12 and len(STATEMENT.findall(code)) * 60 > len(code)


def _letters(text: str) -> int:
    return sum(map(len, WORDS.findall(text)))


def is_data(text: str, path: str) -> bool:
    """Bulk values under a source file's name: records of one form in a JSON array, or a JSON array or text that is almost all literals."""
    plain, literal = text, LITERAL
    if path.lower().endswith(".json"):
        plain, literal = text.lstrip("\ufeff \r\n\t"), JSON_VALUE
        if not plain.startswith("["):
            return False
        if re.match(r"\[\s*[{\[]", plain) and plain.count("{") >= 4:
            # records of one form share names
            names = Counter(re.findall(r'"(\w+)"\s*:', plain))
            if sum(n >= 0.9 * plain.count("{") for n in names.values()) >= 2 or max(map(len, plain.split("\n"))) > 600:
                return True
        if re.match(r"\[\s*\{", plain):
            return False
    if len(text) < 600:
        return False
    if literal is LITERAL:
        plain = SPOKEN.sub("", text)
    values = literal.findall(plain)
    if len(values) < 20 and max(map(len, values), default=0) < 400:
        return False
    letters = _letters(plain)
    return letters - _letters(" ".join(values)) < 0.12 * letters


def is_templated(text: str) -> bool:
    """Most lines are members that differ by a number, or use the slot of that number."""
    members = NUMBERED.findall(text) if len(CALLED.findall(text)) >= 4 else []
    if len(members) < 4:
        return False
    slots = set(SLOT.findall(text))
    if sum(x in slots for x in members) < 0.6 * len(members):
        return False
    lines = [x for x in text.split("\n") if len(x.strip()) > 1 and not COMMENT.match(x)]
    return sum(bool(NUMBERED.search(x) or SLOT.search(x)) for x in lines) > 0.7 * len(lines)


def text_evidence(text: str, path: str) -> str | None:
    """What the text of a file tells of itself: generated, vendored, minified, data or nothing."""
    if not text.strip():
        return None
    head = declared_head(text)
    if head:
        return head
    if is_data(text, path):
        return "data"
    if not path.lower().endswith(".json") and is_minified(text):
        return "minified"
    # every sign of compiled code holds one of the two
    if ("__" in text or "sourceMappingURL" in text) and COMPILED.search(text) or is_templated(text):
        return "generated"
    return None


def patterns_of(path: str) -> list[str]:
    """Candidate patterns of a path: each directory with its place before a package or a file, and the name's fixed parts."""
    parts = path.split("/")
    out = {f"{d}/*/" for d in parts[:-2]} | {f"{d}/" for d in parts[-2:-1]}
    name = parts[-1]
    stem, dot, ext = name.rpartition(".")
    for mark in re.findall(r"[._]([A-Za-z]\w*?\d*)(?=\.)", stem + ".") if dot else []:
        out.add(f"*{mark}.{ext.lower()}")
    first = re.match(r"[A-Za-z]+(?:_[a-z]+)?(?=\.[^.]+\.)", name)
    if first:
        out.add(f"{first.group(0)}.*.{ext.lower()}")
    if re.search(r"-[0-9a-f]{8}\.", name):
        out.add(f"{parts[-2] if len(parts) > 1 else ''}/*-hash.{ext.lower()}")
    return sorted(out)


def glob_regex(pattern: str, base: str) -> str:
    """An attribute pattern of directory ``base`` as a regular expression over whole paths."""
    body = pattern.lstrip("/")
    anchored = "/" in pattern.rstrip("/")
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("/**", i) and i + 3 == len(body):
            out, i = out + "/.*", i + 3
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
            while i < len(body) and body[i] == "*":
                i += 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        elif body[i] == "[" and "]" in body[i + 2 :]:
            j = body.index("]", i + 2)
            inner = body[i + 1 : j].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inner[1:] if inner[:1] == "!" else inner) + "]", j + 1
        elif body[i] == "\\" and i + 1 < len(body):
            out, i = out + re.escape(body[i + 1]), i + 2
        else:
            out, i = out + re.escape(body[i]), i + 1
    prefix = re.escape(base + "/") if base else ""
    return "^" + prefix + ("" if anchored else "(?:.*/)?") + out + "$"


def attribute_rules(text: str, path: str) -> list[dict]:
    """Rules of one attribute file in order: regex, class, value.

    ``-x``, ``!x`` and ``x=false`` take back; ``[attr]name a b`` makes ``name``
    stand for its attributes in the lines below.
    """
    base = path.rpartition("/")[0]
    out, macros = [], {}
    for no, line in enumerate((text or "").lstrip("\ufeff").splitlines()):
        words = line.split()
        if not words or words[0].startswith(("#", "!")):
            continue
        if words[0].startswith("[attr]"):
            macros[words[0][6:]] = words[1:]
            continue
        given = []
        for a in words[1:]:
            name, _, value = a.lstrip("-!").partition("=")
            off = a[0] in "-!" or value.lower() in ("false", "0", "no")
            # what a macro sets, its negation takes back
            given += [(x.lstrip("-!").partition("=")[0], off or x[0] in "-!") for x in [a, *macros.get(name, ())]]
        for name, off in given:
            if name in ATTRIBUTES:
                out.append({"regex": glob_regex(words[0].strip('"'), base), "kind": ATTRIBUTES[name], "on": not off, "depth": base.count("/") + bool(base), "line_no": no})
    return out


_KNOWN = [(re.compile(r["regex"]), r["kind"]) for r in attribute_rules(WELL_KNOWN, ".gitattributes")]
_ANY_KNOWN = re.compile("|".join(f"(?:{r.pattern})" for r, _ in _KNOWN))


def well_known(path: str) -> str | None:
    """The class that the well-known globs give a path; the last match counts."""
    if not path or not _ANY_KNOWN.match(path):
        return None
    return next(kind for regex, kind in reversed(_KNOWN) if regex.match(path))


#: Comment lines anywhere in a text.
COMMENT_LINE = re.compile(r"^[ \t\ufeff]*(?://|#|/?\*|<!--|--|;|\"\"\"|''').*", re.M)
PHRASE_WORD = re.compile(r"[^\W\d_]+|\d[\d.]*|@")
#: Runs of scripts written without blanks.
UNSPACED = re.compile(r"[\u3040-\u30ff\u4e00-\u9fff]{4,}")
NAMES_IN_JSON = re.compile(r'"(\w+)"\s*:')
_DIGITS = str.maketrans("123456789", "000000000")
#: Characters of a line's opening.
OPENING = 28


def _phrases(lines: list[str]) -> set[str]:
    """Runs of two to four words, numbers alike; four characters where words aren't spaced."""
    out: set[str] = set()
    for line in lines:
        w = ["0" if x[0].isdigit() else x for x in PHRASE_WORD.findall(line.lower())]
        out.update(map(" ".join, zip(w, w[1:])))
        out.update(map(" ".join, zip(w, w[1:], w[2:])))
        out.update(map(" ".join, zip(w, w[1:], w[2:], w[3:])))
        if not line.isascii():
            for run in UNSPACED.findall(line):
                out.update(run[i : i + 4] for i in range(len(run) - 3))
    return out


def _share(part: float, bins: int) -> int:
    return min(bins - 1, int(part * bins))


def shapes(text: str, path: str) -> set[str]:
    """Shapes of a whole text in coarse steps: long lines, what is left without literals, numbered members, records."""
    json = path.lower().endswith(".json")
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    size = sum(map(len, lines)) or 1
    long = [x for x in lines if len(x) > 220]
    share = sum(map(len, long)) / size
    blanks, dense = 10, 0
    if share >= 0.5:
        code = "\n".join(long)
        blanks, dense = _share(code.count(" ") / len(code), 10), min(2, len(STATEMENT.findall(code)) * 60 // len(code))
    plain = text if json else SPOKEN.sub("", text)
    letters = _letters(plain)
    rest = (letters - _letters(" ".join((JSON_VALUE if json else LITERAL).findall(plain)))) / (letters or 1)
    out = {
        f"long lines {_share(share, 4)}, blanks {blanks}, dense {dense}, json {json}",
        f"without literals {_share(rest, 12)}, size {min(12, len(text).bit_length())}, json {json}",
    }
    members = NUMBERED.findall(text) if len(CALLED.findall(text)) >= 4 else []
    if len(members) >= 4:
        slots = set(SLOT.findall(text))
        body = [x for x in lines if len(x.strip()) > 1 and not COMMENT.match(x)]
        numbered = sum(bool(NUMBERED.search(x) or SLOT.search(x)) for x in body) / max(1, len(body))
        out.add(f"numbered members {min(8, len(members))}, lines {_share(numbered, 10)}, own slots {_share(sum(x in slots for x in members) / len(members), 5)}")
    if json:
        braces = text.count("{")
        names = Counter(NAMES_IN_JSON.findall(text)) if braces >= 4 else {}
        out.add(f"records {min(3, sum(n >= 0.9 * braces for n in names.values()))}, top {text.lstrip(chr(0xFEFF) + ' ' + chr(10) + chr(13) + chr(9))[:1]}")
    return out


def marks_of(text: str, path: str) -> tuple[set[str], set[str]]:
    """(marks, near): candidate patterns a file has, and phrases it has outside its head only.

    Phrases count for a file only in its head; elsewhere they count against the
    phrase, so that what people write in comments anywhere is no mark.
    """
    marks = {"path " + x for x in patterns_of(path)} if path else set()
    if not text.strip():
        return marks, set()
    head = {"phrase " + x for x in _phrases(head_lines(text))}
    near = {"phrase " + x for x in _phrases(COMMENT_LINE.findall(text))} - head
    openings = {x.strip()[:OPENING] for x in text.translate(_DIGITS).split("\n")}
    marks |= head | {"line " + x for x in openings if len(x) >= 8} | {"shape " + x for x in shapes(text, path)}
    return marks, near


def _seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Marks of seeds with how many seeds of each class have them, summed up per batch."""
    for b in batches:
        count: Counter = Counter()
        for repository, path, text in zip(b["repository"], b["path"], b["text"]):
            text, path = text or "", path or ""
            kind = well_known(path) or text_evidence(text, path)
            if kind:
                count.update((m, repository, kind) for m in marks_of(text, path)[0])
        yield pd.DataFrame([(*k, n) for k, n in count.items()], columns=["mark", "repository", "kind", "n"])


def _marked(candidates):
    """Path class by well-known globs of each row, and which candidates are among its marks and among what it has outside its head only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = candidates.value
        for b in batches:
            out = b[["doc_id", "repository", "path"]].copy()
            out["by_path"] = [well_known(path or "") for path in b["path"]]
            both = [marks_of(text or "", path or "") for path, text in zip(b["path"], b["text"])]
            out["marks"], out["near"] = [list(known & m) for m, _ in both], [list(known & n) for _, n in both]
            yield out

    return run


def _mined(rows: DataFrame, support: int, rate: float, repositories: int) -> tuple[DataFrame, DataFrame]:
    """The patterns (mark, kind, files, seeds) mined from all rows, and the rows (doc_id, repository, path, by_path, marks) with what they have of the candidates.

    Seeds are counted first: a pattern without any stranger would need ``support``
    and ``rate`` from them alone, which leaves few candidates.  Then all files
    that have a candidate are counted.  ``rate`` is a pattern's share of seeds
    with one stranger added, so even a pattern without strangers needs some files.
    """
    spark, rows = rows.sparkSession, spread(rows)
    seeds = rows.select("repository", "path", "text").mapInPandas(_seeds, "mark string, repository string, kind string, n long")
    candidates = materialize(
        seeds.groupBy("mark", "repository", "kind").agg(F.sum("n").alias("n"))
        .groupBy("mark", "kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("r"))
        .groupBy("mark").agg(F.sum("n").alias("seeds"), F.max(F.struct("n", "kind"))["kind"].alias("kind"), F.max("r").alias("r"))
        .where((F.col("seeds") >= support) & (F.col("r") >= repositories) & (F.col("seeds") >= rate * (F.col("seeds") + 1)))
        .select("mark", "kind", "seeds"),
        "candidates",
    )
    known = spark.sparkContext.broadcast(frozenset(candidates.select("mark").toArrow()["mark"].to_pylist()))
    kind = rows.schema["doc_id"].dataType.simpleString()
    marked = rows.mapInPandas(_marked(known), f"doc_id {kind}, repository string, path string, by_path string, marks array<string>, near array<string>")
    marked = materialize(marked, "marked")
    files = marked.select(F.explode(F.concat("marks", "near")).alias("mark")).groupBy("mark").agg(F.count(F.lit(1)).alias("files"))
    patterns = candidates.join(files, "mark").where(F.col("seeds") >= rate * (F.col("files") + 1))
    return patterns.select("mark", "kind", "files", "seeds"), marked.drop("near")


def mined_patterns(rows: DataFrame, sample: int | None, support: int, rate: float, repositories: int) -> DataFrame:
    """(mark, kind, files, seeds) of the patterns that tell seeds, mined from all rows, or from about ``sample`` of them where that is given.

    A sample is drawn by a hash of repository and path, so it is the same
    whatever the partitions.
    """
    if sample is not None:
        steps = 1 << 20
        keep = min(steps, -(-sample * steps // max(1, rows.count())))
        rows = rows.where(F.pmod(F.xxhash64("repository", "path"), F.lit(steps)) < keep)
    return _mined(rows, support, rate, repositories)[0]


def _judged(patterns):
    """The strongest mined pattern of each row that no well-known glob names."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = patterns.value
        for b in batches:
            best = [None if kind else max(((known[m], m) for m in marks if m in known), default=None) for kind, marks in zip(b["by_path"], b["marks"])]
            out = b[["doc_id", "repository", "path", "by_path"]].copy()
            out["mined"] = [f"{x[0][1]}:{x[1]}" if x else None for x in best]
            yield out

    return run


def _rules(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(r, *x.values()) for r, t, p in zip(b["repository"], b["text"], b["path"]) for x in attribute_rules(t, p)]
        yield pd.DataFrame(rows, columns=["repository", "regex", "kind", "on", "depth", "line_no"])


#: Copies of a repository's rule list, so that a repository with a third of all files is joined in so many tasks.
SALT = 16


def file_origins(
    docs: DataFrame, declared: DataFrame | None = None, support: int = 6, rate: float = 0.93, repositories: int = 3
) -> DataFrame:
    """(doc_id, origin, reason) of every row: origin is generated, minified, vendored, data or null.

    ``docs`` has doc_id, repository, file_path and text; ``declared`` has the
    attribute files (repository, file_path, text).  A declaration decides
    either way; then the well-known globs, then the mined pattern with the most
    seeds.  Patterns are mined from every row's whole text and applied to it:
    ``support`` seeds in so many ``repositories`` at least, which are ``rate`` of
    the pattern's files.  Candidates and mined patterns come to the driver, no
    marks of files do.  Where the rows are too few for that support, rules and
    globs decide alone.  Null and blank texts have path patterns only; a null
    path has none; repeated rows come out repeated.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "repository", canonical_path(F.col("file_path")).alias("path"), "text")
    found, marked = _mined(rows, support, rate, repositories)
    found = found.toArrow().to_pydict()
    patterns = spark.sparkContext.broadcast(dict(zip(found["mark"], zip(found["seeds"], found["kind"]))))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = marked.mapInPandas(_judged(patterns), f"doc_id {kind}, repository string, path string, by_path string, mined string")
    if declared is not None:
        out = _with_declarations(materialize(out.withColumn("_row", F.monotonically_increasing_id()), "judged"), declared)
    else:
        out = out.withColumn("verdict", F.lit(None).cast("string"))
    origin = F.when(F.col("verdict") == "own", F.lit(None)).otherwise(F.coalesce("verdict", "by_path", F.substring_index("mined", ":", 1)))
    reason = (
        F.when(F.col("verdict").isNotNull(), "declared").when(F.col("by_path").isNotNull(), "well-known glob")
        .when(F.col("mined").isNotNull(), F.concat(F.lit("mined "), F.expr("substring(mined, instr(mined, ':') + 1)")))
    )
    return out.select("doc_id", origin.alias("origin"), reason.alias("reason"))


def _with_declarations(files: DataFrame, declared: DataFrame) -> DataFrame:
    """``verdict``: the class declared for a file, ``own`` where a rule takes it back, else null."""
    rules = declared.select("repository", canonical_path(F.col("file_path")).alias("path"), "text").mapInPandas(
        _rules, "repository string, regex string, kind string, on boolean, depth int, line_no int"
    )
    lists = rules.groupBy("repository").agg(
        F.array_sort(F.collect_list(F.struct("depth", "line_no", "regex", "kind", "on"))).alias("rules")
    ).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    both = files.withColumn("_salt", F.pmod("_row", F.lit(SALT)).cast("int")).join(lists, ["repository", "_salt"], "left")
    hits = F.expr("filter(rules, r -> path rlike r.regex)")
    last = F.element_at("_hits", -1)
    return (
        both.withColumn("_hits", F.when(F.col("rules").isNotNull() & F.col("path").isNotNull(), hits))
        .withColumn("verdict", F.when(F.size("_hits") > 0, F.when(last["on"], last["kind"]).otherwise("own")))
        .drop("_hits", "rules", "_salt")
    )

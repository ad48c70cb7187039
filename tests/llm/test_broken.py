import ast
import json

import pytest

from skein.llm import broken
from skein.llm.syntax.chart import Grammar
from skein.llm.syntax.files import cost_of, language_of

GOOD = {
    "python": [
        "def f(a, *, b=1, **k) -> int:\n    if a: return (yield)\n    elif b:\n\tpass\n" if False else "def f(a, *, b=1, **k) -> int:\n    if a: return b\n    else:\n        pass\n",
        "match x:\n    case {'a': [1, *r]} if r: pass\n    case _: y = 2\n", "async def g():\n    async with a as b, c: [await z async for z in y if z]\n", "x = f\"{a!r:>{w}} {'q'}\"\n", "class A[T](B, k=1):\n    x: int = 3\n    @p.s(1)\n    def m(self, /, q): ...\n",
        "print(*a, **b)\nlambda x, *y: (x, y)\nx[1:2, ::3] = y = z\nd = {**a, 'b': 1 for_ if False else 2}\n" if False else "print(*a, **b)\nl = lambda x, *y: (x, y)\nx[1:2, ::3] = y = z\n", "try:\n    pass\nexcept* (A, B) as e:\n    raise X from e\nfinally:\n    del x, y[0]\n",
    ],
    "javascript": [
        "const {a, b: {c = 1}, ...d} = e, [f,, g] = h\nfoo()\n", "a = b / c / d; x = /[/]re(/g.test(y)\n", "label: for (const x of y) { if (x) continue label; else break }\n", "export default async function* g({a}, [b], ...c) { yield* await a?.b?.[c]?.(d) }\n",
        "class A extends B { static #p = 1; get x() { return this.#p } async *[k]() {} static { init() } }\n", "`a ${b ? `c ${d}` : {e: 1}.e} f`\n", "switch (a) { case 1: case 2: { b() } default: c() }\n", "import a, { b as c } from 'x'\nexport * as n from \"y\"\n", "if (a) b\nelse c\ndo x++; while (y)\n",
        "var f = function() { return }, g = async x => ({...x, y})\n", "#!/usr/bin/env node\nlet a = 1_000n ** 2n ?? b\n", "x = {\n  'a-b': 1,\n  get c() { return 1 },\n  async d() {},\n  [e]: f,\n}\n",
    ],
    "typescript": [
        "interface A<T extends B = C> extends D, E<F> { readonly x?: string; [k: string]: any; m<U>(a: U): void; new (x: number): A<T> }\n", "type M = { [K in keyof T]?: T[K] extends (infer U)[] ? U : never } | `a${string}` | readonly [x: number, ...y: string[]]\n",
        "abstract class A<T> implements I { private readonly x!: Map<string, Set<number>>; constructor(private a: string, b?: number) { super() } abstract f(): Promise<void>; get y(): number { return 1 } }\n", "enum E { A = 1, B = 'x' }\ndeclare module 'x' { export const y: number }\n",
        "const f = <T,>(x: T): x is T => x as unknown as T\nlet v = a! satisfies B\nfunction g(this: A, ...r: number[]): asserts x is B {}\n", "import type { A } from './a'\nexport type { B } from './b'\nconst m = new Map<string, Array<Record<string, () => void>>>([])\n", "function o(a: string): void\nfunction o(a: any) {}\n",
    ],
    "java": [
        "package a.b;\nimport static x.Y.*;\n@A(b = {1, 2}, c = \"d\")\npublic sealed class X<T extends Comparable<? super T>> extends Y implements Z permits W { int[] a = {1, 2}, b[]; static { f(); } X() { this(1); } }\n",
        "class A { void m() { for (int i = 0, j = 1; i < n; i++, j--) { a[i] = (int) b + -c; } for (final var x : xs) { } int r = switch (k) { case 1, 2 -> { yield 3; } default -> throw new E(); }; } }\n",
        "record P(int x, String... y) { P { if (x > 0) throw new X(); } }\nenum E { A(1) { void f() {} }, B; private final int q = 1; }\n@interface I { int v() default 1; }\n",
        "class A { Object o = list.stream().map(String::new).filter(x -> x != null && !(x instanceof String s && s.isEmpty())).toArray(String[]::new); String t = \"\"\"\n  a \"b\"\n  \"\"\"; char c = '\\''; }\n",
        "interface I<T> { default <U extends T> Map<String, List<U>> f(U u) throws A, B { try (var r = new R(); s) { return null; } catch (A | B e) { } finally { } } }\n",
    ],
    "go": [
        "package a\n\nimport (\n\t\"x\"\n\ty \"z/w\"\n)\n\ntype T struct {\n\tA, B int `json:\"a\"`\n\t*E\n}\n\ntype I interface {\n\tM(a int, b ...string) (int, error)\n\t~int | string\n}\n",
        "package a\n\nfunc (t *T[K]) F(a, b int) (n int, err error) {\n\tif x, ok := m[k]; !ok {\n\t\treturn\n\t} else if y {\n\t}\n\tfor i := range xs {\n\t}\n\tfor i := 0; i < n; i++ {\n\t}\n\tswitch v := x.(type) {\n\tcase int, *T:\n\tdefault:\n\t\tgo func() { c <- <-d }()\n\t}\n\tselect {\n\tcase v := <-c:\n\t\t_ = v\n\t}\n\treturn a + -b, nil\n}\n",
        "package a\n\nvar m = map[string][]int{\"a\": {1, 2}, \"b\": nil}\n\nconst (\n\tA = iota\n\tB\n)\n\nfunc g[T any, U comparable](x T) []T { return append([]T{}, x[1:]...) }\n",
    ],
    "json": ['{"a": [1, -2.5e3, true, null, {"b": "\\u00e9\\n"}]}', '"x"', "[]", " 3 "],
}
BAD = {
    "python": ["def f(:\n  pass\n", "x = (1,\n", "<<<<<<< HEAD\nx = 1\n=======\nx = 2\n>>>>>>> b\n", "if x:\n", "s = 'abc\n", "<html></html>", "  x = 1\n y = 2\n"],
    "javascript": ["function f() {\n  return 1;\n", "const x = `a ${b\n", "a = 1;\n<<<<<<< HEAD\nb = 1;\n=======\nb = 2;\n>>>>>>> x\n", '{"a": 1, "b": [2]}', "let x: number = 1;\n", "const a = ;\n", "class A { x( }\n", "public class A { int x; }\n", "/* open\n", "f(a b)\n"],
    "typescript": ["interface A { x: }\n", "const x: = 1\n", "type A = {\n", "public class A { private final int x = 1; }\n", "enum E { A = 1,\n", "package a\n\nfunc f() {}\n"],
    "java": ["class A { void f() { g(; } }\n", "class A {\n", "class A { int x = 1 }\n", "export const x = 1;\n", "class A { String s = \"abc; }\n", "def f():\n    pass\n", "class A { void f() {} \n<<<<<<< HEAD\n}\n"],
    "go": ["package a\n\nfunc f() {\n", "package a\nvar x = \n", "package a\n\nfunc f() { x := }\n", "class A {}\n", "package a\n\nimport (\n\t\"fmt\"\n", "package a\nx := 1\n"],
    "json": ["{'a': 1}", '{"a": 1,}', '{"a": 1', "// c\n{}", "NaN", '{"a" 1}', "{} {}", '"a\nb"', "01"],
}


@pytest.mark.parametrize("language", GOOD)
def test_valid_texts_cost_nothing(language):
    for t in GOOD[language]:
        assert cost_of(t, language)[0] == 0, t
        assert cost_of(t.replace("\n", "\r\n"), language)[0] == 0, t
        assert cost_of("\ufeff" + t, language, True)[0] == 0, t


@pytest.mark.parametrize("language", BAD)
def test_broken_texts_cost(language):
    for t in BAD[language]:
        assert cost_of(t, language)[0] > 0, t
        cost, kind, first, last = cost_of(t, language, True)
        assert cost > 0 and kind and 1 <= first <= last <= t.count("\n") + 1, t


def test_chart_agrees_with_the_exact_checks_on_prefixes():
    from skein.llm.syntax.files import tools
    from skein.llm.syntax.trees import edit_cost

    for language, exact in (("python", ast.parse), ("json", json.loads)):
        lang, sweep, lexer, _ = tools(language)
        for t in GOOD[language]:
            for i in range(1, len(t)):
                p = t[:i]
                if not p.strip():
                    continue
                try:
                    exact(p)
                    ok = True
                except (SyntaxError, ValueError):
                    ok = False
                tokens, _, broken_ = lexer(p)
                mine = edit_cost(lang, tokens, broken_, False)[0] == 0
                assert mine or not ok, (language, p)
                assert sweep.accepts(p) <= mine, (language, p)


def test_sweep_accepts_only_what_the_reader_accepts():
    from skein.llm.syntax.files import tools
    from skein.llm.syntax.trees import edit_cost

    for language, texts in GOOD.items():
        lang, sweep, lexer, _ = tools(language)
        for t in texts:
            for i in range(1, len(t), 3):
                for p in (t[:i], t[:i] + t[i + 1 :], t[:i] + "(" + t[i:]):
                    tokens, _, broken_ = lexer(p)
                    assert not sweep.accepts(p) or edit_cost(lang, tokens, broken_, False)[0] == 0, (language, p)


def test_least_edits():
    g = Grammar("S : 'a' S 'b' | 'c'")
    s = lambda t: "".join(g.char(x) for x in t)
    assert g.recognize("S", s("aacbb")) == (True, True) and g.recognize("S", s("aac")) == (False, True) and g.recognize("S", s("ab")) == (False, False)

    def brute(t):
        best = 9
        for n in range(5):
            w = "a" * n + "c" + "b" * n
            d = list(range(len(w) + 1))
            for i, x in enumerate(t, 1):
                e = [i]
                for j, y in enumerate(w, 1):
                    e.append(min(d[j] + 1, e[-1] + 1, d[j - 1] + (x != y)))
                d = e
            best = min(best, d[-1])
        return best

    import itertools

    for n in range(0, 5):
        for t in itertools.product("abc", repeat=n):
            assert g.repair("S", s(t))[0] == brute(t), t


def test_kinds_and_languages():
    conflict = "x = 1\n<<<<<<< HEAD\ny = f(2)\n=======\ny = f(3)\n>>>>>>> b\nz = 4\n"
    assert cost_of(conflict, "javascript", True)[1] == "conflict"
    assert cost_of("function a() {\n  b();\n}\nfunction c() {\n  d(", "javascript", True)[1] == "truncated"
    assert cost_of("<!DOCTYPE html>\n" + "<p class='a'>The x.</p>\n" * 9, "javascript", True)[1] == "mismatch"
    assert cost_of("```\n", None)[0] == 0 and cost_of(None, "java")[0] == 0 and cost_of(" \n", "java")[0] == 0 and cost_of("x", "cobol")[0] == 0
    assert language_of(" TS ", "a.py") == "typescript" and language_of("unknown", "A.PY") == "python" and language_of(None, None) is None
    assert cost_of('x = "<<<<<<< HEAD"\n', "python")[0] == 0
    assert cost_of("x = [" + "1, " * 200_000 + "]", "python")[0] == 0 and cost_of("[" * 400 + "]" * 400, "json")[0] == 0


def test_over_tables(spark):
    docs = spark.createDataFrame(
        [(1, "r", "a.py", "x = (", "clash"), (2, "r", "b.js", "x = 1", "clash"), (3, "r", "c.txt", "x = (", "clash"), (4, "r", None, "{", "clash"), (5, "q", "d.go", None, "clash"), (1, "r", "a.py", "x = (", "clash"), (6, "q", "e.unknown", "int x", "clash")],
        "doc_id long, repository string, file_path string, text string, language string",
    )
    rec = spark.sql("select * from values (1L, 'a.py', 'Python', timestamp_ntz'2025-01-01 00:00:00'), (1L, 'a.py', null, timestamp_ntz'2025-02-01 00:00:00'), (4L, null, 'json', null), (6L, 'x.java', 'unknown', timestamp_ntz'2025-01-01 00:00:00'), (null, 'y.py', 'python', null) as t(doc_id, file_path, language, analyzed_at)")
    assert sorted(r[0] for r in broken.broken_files(docs, rec).collect()) == [1, 1, 4, 6]
    rates = {(r["repository"], r["language"]): (r["files"], r["broken"]) for r in broken.broken_rates(docs, rec).collect()}
    assert rates == {("r", "python"): (2, 2), ("r", "javascript"): (1, 0), ("r", "json"): (1, 1), ("q", "go"): (1, 0), ("q", "java"): (1, 1)}
    assert {r["doc_id"] for r in broken.repairs(docs, rec).collect()} == {1, 4, 6}
    assert broken.broken_files(docs.where("false"), rec).collect() == [] and sorted(r[0] for r in broken.broken_files(docs, rec.where("false")).collect()) == [1, 1]


def test_repairs_of_long_pieces_and_many_edits():
    go = "package a\n\nfunc f() {\n\tx := 1" + " + 1" * 30 + " 1\n\tg(x)\n}\n"
    assert cost_of(go, "go", True)[0::2] == (1, 4)
    three = "package a\n\nfunc f() {\n\tx := 1 1 + 1 1 + 1 1\n\tg(x)\n}\n"
    assert cost_of(three, "go", True)[0] == 3


def test_least_cost_of_random_pieces_against_all_short_strings():
    """Every string of a small grammar up to a length, by edit distance, against the chart."""
    import itertools
    import random

    g = Grammar("S : A ';' S | A ';' | \nA : 'x' '=' E | E\nE : E '+' T | T\nT : 'x' | '(' E ')' | 'x' '(' L ')'\nL : E ',' L | E |")
    alphabet = "x=+();,"
    language = [w for n in range(0, 7) for w in itertools.product(alphabet, repeat=n) if g.recognize("S", "".join(map(g.char, w)))[0]]
    rng = random.Random(5)
    for _ in range(60):
        t = [rng.choice(alphabet) for _ in range(rng.randint(0, 4))]
        best = 99
        for w in language:
            d = list(range(len(w) + 1))
            for i, a in enumerate(t, 1):
                e = [i]
                for j, b in enumerate(w, 1):
                    e.append(min(d[j] + 1, e[-1] + 1, d[j - 1] + (a != b)))
                d = e
            best = min(best, d[-1])
        cost, places = g.repair("S", "".join(map(g.char, t)))
        assert cost == best == len(places) and all(0 <= x <= len(t) for x in places), t


def test_chart_alone_decides_as_the_exact_parsers_do():
    from skein.llm.syntax.files import tools

    for language in ("python", "json"):
        exact = tools(language)[3]
        for t in [*GOOD[language], *BAD[language]]:
            assert (cost_of(t, language)[0] == 0) == exact(t), (language, t)


def test_deep_columns():
    deep = "if a:\n" + " " * 6500 + "b\n" + " " * 6400 + "c\n"
    assert cost_of(deep, "python")[0] > 0
    assert cost_of("if a:\n" + " " * 6500 + "b\n" + " " * 6500 + "c\n", "python")[0] == 0

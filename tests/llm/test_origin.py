from skein.llm import origin


def test_globs_and_rules():
    import re

    hit = lambda p, path, base="": bool(re.match(origin.glob_regex(p, base), path))
    assert hit("*.min.js", "a/b/x.min.js") and not hit("/x.js", "a/x.js") and hit("a/**/z.py", "a/b/c/z.py") and hit("vendor/**", "vendor/a/b") and hit("gen/[a-c]?.py", "s/gen/b1.py", "s")
    rules = origin.attribute_rules("# c\n*.pb.go linguist-generated\nvendor/** linguist-vendored=true\n*.x -linguist-generated text\n*.y linguist-generated=false", "sub/.gitattributes")
    assert [(r["kind"], r["on"], r["depth"]) for r in rules] == [("generated", True, 1), ("vendored", True, 1), ("generated", False, 1), ("generated", False, 1)]
    assert origin.attribute_rules(None, ".gitattributes") == []


def test_heads():
    assert origin.declared_head("package a\n\n// Code generated by x. DO NOT EDIT.\n") == "generated"
    assert origin.declared_head("/*!\n * lib v1.2.3\n * (c) 2014 lib contributors, MIT License\n */\nx") == "vendored"
    assert origin.declared_head("// Formerly auto-generated, maintained by hand since.\nx()") is None
    assert origin.declared_head("// Copyright (c) 2022 the maintainers of this repository.\nx()") is None
    assert origin.declared_head("x = 1\n# Code generated by y. DO NOT EDIT.\n") is None
    assert origin.declared_head("const h = '// DO NOT EDIT';") is None


def test_texts_and_paths():
    mini = "var a=function(t,e){return t[e]||1};!function(e,t){e.x=t.y}(window,document);" * 12
    assert origin.text_evidence(mini, "a.js") == "minified"
    assert origin.text_evidence('Q = "' + "SELECT a AND b = c " * 60 + '"\nrun(Q)\n', "a.py") is None
    assert origin.text_evidence("var x = []byte{\n" + "\t0x7e, 0xfb, 0xa1,\n" * 60 + "}\n", "a.go") == "data"
    assert origin.text_evidence("[" + ",".join('{"id": %d, "v": 0.5}' % i for i in range(40)) + "]", "rows.json") == "data"
    assert origin.text_evidence('{"name": "x", "scripts": {"a": "b"}}', "package.json") is None
    members = "".join(f"  get a{i}() {{\n    return this.d[{i}];\n  }}\n" for i in range(9))
    assert origin.text_evidence("class X {\n" + members + "}\n", "a.js") == "generated"
    plain = "".join(f"function f{i}(x) {{\n  return x + y;\n}}\n" for i in range(9))
    assert origin.text_evidence(plain + "class X {\n" + members[:80] + "}\n", "a.js") is None
    assert origin.text_evidence("", "a.js") is None
    assert origin.well_known("web/node_modules/lib/x.js") == "vendored" and origin.well_known("src/vendor/vendor_x.py") is None and origin.well_known("src/vendor_portal/a/x.py") is None
    assert origin.well_known("a/package-lock.json") == "generated" and origin.well_known("p/x_pb2.py") == "generated" and origin.well_known("src/minify_x.js") is None


def test_over_tables(spark):
    gen = "// @generated by tool\nx()\n"
    docs = [(i, f"r{i % 4}", f"out/pkg{i}/f.js", gen, "x") for i in range(8)] + [
        (100, "r1", "out/pkg/own.js", "x()\n", "x"), (101, "d", "hand/a.js", gen, "x"), (102, "d", "made/a.js", "x()\n", "x"), (103, "d", "made/keep/a.js", "x()\n", "x"), (104, "d", None, None, "x"), (105, None, "src/a.js", "", "x"), (105, None, "src/a.js", "", "x"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, repository string, file_path string, text string, pattern string")
    decl = spark.createDataFrame([("d", ".gitattributes", "hand/** -linguist-generated\nmade/** linguist-generated"), ("d", "made/keep/.gitattributes", "* -linguist-generated"), ("e", ".gitattributes", None)], "repository string, file_path string, text string")
    got = {r["doc_id"]: (r["origin"], r["reason"]) for r in origin.file_origins(df, decl, support=5, rate=0.5).collect()}
    assert got[0][0] == "generated" and got[0][1].startswith("mined ") and got[100][0] == "generated" and got[100][1].startswith("mined ")
    assert got[101] == (None, "declared") and got[102] == ("generated", "declared") and got[103] == (None, "declared") and got[104] == got[105] == (None, None)
    assert len(origin.file_origins(df).collect()) == len(docs)
    assert origin.file_origins(df.where("false")).collect() == []


def test_long_heads_and_late_signs():
    licence = "".join(f"// line {i} of a licence\n" for i in range(300))
    assert origin.declared_head(licence + "\n" * 50 + "// Code generated by x. DO NOT EDIT.\npackage a\n") == "generated"
    assert origin.declared_head("/*\n" + "terms of a licence\n\n" * 60 + "*/\n// Code generated by x.\nf()\n") == "generated"
    assert origin.declared_head("/* a */\nf()\n/* Code generated by x. */\n") is None
    assert origin.declared_head("// The contents of the NOTICE file do not modify the License.\nf()\n") is None
    code = "".join(f"export function f{i}(x) {{\n  return x + y;\n}}\n" for i in range(200))
    assert len(code) > 4000 and origin.text_evidence(code, "a.js") is None
    assert origin.text_evidence(code + "//# sourceMappingURL=a.js.map\n", "a.js") == "generated"
    assert origin.text_evidence("// " + "x" * 5000 + "\n__webpack_require__(1);\n", "a.js") == "generated"


def test_json_arrays_without_records():
    assert origin.text_evidence("[" + ",\n".join(f"[{i}, -0.5, true, null]" for i in range(60)) + "]", "rows.json") == "data"
    assert origin.text_evidence("[" + ",\n".join(f'"value no {i}"' for i in range(60)) + "]", "rows.json") == "data"
    assert origin.text_evidence('["a", "b"]', "names.json") is None
    config = "[" + ",\n".join(f'["plugin-{i}", {{"someOption{i}": true, "otherOption{i}": false}}]' for i in range(20)) + "]"
    assert origin.text_evidence(config, "babel.json") is None


def test_mined_patterns_decide_and_are_counted(spark):
    head = "// Erzeugt von werkzeug {}, generated by werkzeug\nf{}()\n"
    docs = [(i, f"r{i % 5}", f"src/m{i}/a{i}.js", head.format(i, i)) for i in range(30)] + [(100 + i, f"r{i % 5}", f"src/m{i}/b{i}.js", f"// see werkzeug {i}\ng{i}(x)\n") for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, repository string, file_path string, text string")
    rows = df.selectExpr("doc_id", "repository", "file_path as path", "text")
    marks = {r["mark"]: (r["files"], r["seeds"]) for r in origin.mined_patterns(rows, 1000, 6, 0.93, 3).collect()}
    assert marks["phrase generated by werkzeug"] == (30, 30) and "phrase see werkzeug" not in marks and not any(m.startswith("path ") for m in marks)
    got = {r["doc_id"]: r["origin"] for r in origin.file_origins(df).collect()}
    assert all(got[i] == "generated" for i in range(30)) and not any(got[100 + i] for i in range(60))
    # the same whatever the partitions
    again = {r["doc_id"]: r["origin"] for r in origin.file_origins(df.repartition(7)).collect()}
    assert again == got


def test_patterns_are_mined_from_every_file(spark):
    """Sixteen seeds among 30,000 files are enough, and every stranger counts against a pattern."""
    text = """case when id % 1875 = 7 then concat('// generated by werkzeug\nf', id, '()\n') when id % 1875 = 8 then concat('// generated by hobel\nf', id, '()\n')
      when id = 11 then '// x\ng(x)\n// by hobel\n' when id in (12, 13) then '// made by hobel\ng(x)\n' else concat('g', id, '(x)\n') end"""
    docs = spark.range(30000).selectExpr("id as doc_id", "concat('r', id % 7) as repository", "concat('src/m', id, '/a', id, '.js') as file_path", f"{text} as text")
    rows = docs.selectExpr("doc_id", "repository", "file_path as path", "text")
    marks = {r["mark"]: (r["kind"], r["files"], r["seeds"]) for r in origin.mined_patterns(rows, None, 6, 0.93, 3).collect()}
    assert marks["phrase by werkzeug"] == ("generated", 16, 16) and marks["phrase generated by hobel"] == ("generated", 16, 16) and "phrase by hobel" not in marks
    got = {r["doc_id"] for r in origin.file_origins(docs).where("origin is not null").collect()}
    assert got == {i for i in range(30000) if i % 1875 in (7, 8)}


def test_attribute_files_against_git(spark, tmp_path):
    """Globs, precedence per directory, negation and macros, as git itself resolves them."""
    import itertools
    import random
    import shutil
    import subprocess

    if not shutil.which("git"):
        return
    rng = random.Random(11)
    files = ["/".join(x) for n in (1, 2, 3) for x in itertools.product(["a", "b", "gen"], repeat=n - 1) for x in [(*x, f) for f in ("x.py", "y.js", "y.min.js", "z")]]
    globs = ["*.py", "*.js", "gen/**", "/gen/*", "**/b/*.js", "a/*", "y.*", "[xz]*", "*", "gen/", "?.py", "a/**/x.py"]
    words = ["linguist-generated", "-linguist-generated", "linguist-generated=false", "!linguist-generated", "linguist-generated=true", "made", "-made", "text"]
    for no in range(4):
        root = tmp_path / f"r{no}"
        subprocess.run(["git", "init", "-q", str(root)], check=True)
        declared = []
        for where in ("", "a", "gen", "a/b"):
            lines = [f"{rng.choice(globs)} {rng.choice(words)}" for _ in range(rng.randint(1, 5))]
            if not where:
                lines.insert(0, "[attr]made linguist-generated -diff")
            (root / where).mkdir(parents=True, exist_ok=True)
            (root / where / ".gitattributes").write_text("\n".join(lines) + "\n")
            declared.append(("r", f"{where}/.gitattributes".lstrip("/"), "\n".join(lines)))
        out = subprocess.run(["git", "-C", str(root), "check-attr", "linguist-generated", "--", *files], check=True, capture_output=True, text=True).stdout
        want = {x.split(": ")[0]: x.split(": ")[2] for x in out.splitlines()}
        docs = spark.createDataFrame([(i, "r", f, "") for i, f in enumerate(files)], "doc_id long, repository string, file_path string, text string")
        got = {files[r["doc_id"]]: r for r in origin.file_origins(docs, spark.createDataFrame(declared, "repository string, file_path string, text string")).collect()}
        for f in files:
            if want[f] in ("set", "true"):
                assert got[f]["origin"] == "generated" and got[f]["reason"] == "declared", (f, declared)
            elif want[f] in ("unset", "false"):
                assert got[f]["origin"] is None and got[f]["reason"] == "declared", (f, declared)

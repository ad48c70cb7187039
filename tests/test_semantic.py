from conftest import rows
from pyspark.sql import functions as F

from skein.operators import extract, infra, semantic

OLD = "FROM python:3.10\nENV A=1\nEXPOSE 8000\nUSER root\nENTRYPOINT a\nCMD x\n"
NEW = "FROM python:3.12\nENV A=2\nENV B=1\nEXPOSE 9000\nUSER app\nENTRYPOINT b\nCMD x\n"
CI_OLD = "on:\n  push:\npermissions:\n  contents: read\njobs:\n  build:\n    timeout-minutes: 5\n  test:\n"
CI_NEW = "on:\n  push:\n  schedule:\npermissions:\n  contents: write\njobs:\n  build:\n    timeout-minutes: 9\n"


def facts(spark, files):
    return extract.file_facts(spark.createDataFrame(files, "path string, text string"), ["path"], path="path")


def test_infra(spark):
    old = facts(spark, [("Dockerfile", OLD), (".github/workflows/ci.yml", CI_OLD), ("gone/Dockerfile", OLD)])
    new = facts(spark, [("Dockerfile", NEW), (".github/workflows/ci.yml", CI_NEW)])
    d = infra.infra_diff(old, new)
    got = {(r["path"].rpartition("/")[2], r["change"], r["severity"], r["key"]) for r in d.collect()}
    assert got == {
        ("Dockerfile", "BASE_IMAGE_CHANGED", "MAJOR", ""), ("Dockerfile", "ENV_CHANGED", "MINOR", "A"), ("Dockerfile", "ENV_ADDED", "MINOR", "B"), ("Dockerfile", "PORT_REMOVED", "MAJOR", "8000"), ("Dockerfile", "PORT_ADDED", "MINOR", "9000"),
        ("Dockerfile", "USER_CHANGED", "MAJOR", ""), ("Dockerfile", "ENTRYPOINT_CHANGED", "MAJOR", ""), ("Dockerfile", "FILE_REMOVED", "MAJOR", ""), ("ci.yml", "TRIGGER_CHANGED", "MAJOR", "schedule"), ("ci.yml", "PERMISSION_CHANGED", "MAJOR", "contents"),
        ("ci.yml", "JOB_REMOVED", "MAJOR", "test"), ("ci.yml", "TIMEOUT_CHANGED", "PATCH", "jobs.build"),
    }
    assert rows(infra.infra_level(d)) == [("HIGH",)] and rows(infra.infra_level(d.where("false"))) == [("LOW",)]
    assert rows(infra.infra_diff(old, old)) == []


def test_symbols_and_dependents(spark):
    schema = "path string, name string, kind string, signature string, visibility string"
    old = spark.createDataFrame([("a", "f", "function", "1", "public"), ("a", "g", "function", "1", "private"), ("a", "h", "function", "1", "public"), ("a", "i", "function", "1", "private")], schema)
    new = spark.createDataFrame([("a", "f", "function", "2", "public"), ("a", "h", "function", "1", "private"), ("a", "i", "function", "1", "private")], schema)
    edges = spark.createDataFrame([("a:g", f"b:x{i}") for i in range(4)] + [("c:u", "a:f"), ("d:v", "c:u"), ("a:f", "d:v")], "src string, dst string")
    f = semantic.symbol_breaks(old, new, edges)
    got = {(r["name"], r["change"]): (r["score"], r["severity"]) for r in f.collect()}
    assert got == {("f", "SIGNATURE_CHANGED"): (8.5, "MAJOR"), ("g", "SYMBOL_REMOVED"): (8.0, "MAJOR"), ("h", "VISIBILITY_DOWNGRADED"): (8.0, "MAJOR")}
    chain = {r["symbol"]: r["chain"] for r in semantic.dependents(f, edges, F.concat_ws(":", "path", "name")).collect()}
    assert chain == {"a:f": ["c:u", "d:v"], "a:g": [], "a:h": []}
    both = semantic.compare_reports(f, f.where("name = 'f'")).collect()
    assert len(both) == 4 and both[0]["severity"] == "MAJOR"


def test_contracts_impact_and_incremental(spark):
    schema = "method string, path string, body_fields array<string>, optional_query array<string>, required_query array<string>, status_codes array<int>"
    old = spark.createDataFrame([("GET", "/a", ["x", "y"], ["q"], [], [200, 404]), ("GET", "/b", ["x"], [], [], [200]), ("GET", "/c", [], [], [], [200])], schema)
    new = spark.createDataFrame([("GET", "/a", ["x"], [], ["q"], [200]), ("GET", "/b", [], [], [], [200])], schema)
    from skein.operators.diff import snapshot_diff

    got = {(r["path"], r["change"]) for r in snapshot_diff(old, new, ["method", "path"], semantic.CONTRACT_RULES).collect()}
    assert got == {("/a", "BODY_FIELD_REMOVED"), ("/a", "QUERY_PARAM_REQUIRED"), ("/a", "STATUS_REMOVED"), ("/b", "BODY_SCHEMA_REMOVED"), ("/c", "ROUTE_REMOVED")}
    p = lambda data: spark.createDataFrame(data, "path string, name string")
    edges = spark.createDataFrame([("u", "a"), ("v", "u")], "src string, dst string")
    r = semantic.impact(p([("a", "")]), edges, p([("a", "GET /"), ("z", "GET /z")]), p([])).collect()[0]
    assert (r["apis"], r["models"], r["radius"], r["depth"], r["score"], r["severity"]) == (1, 0, 3, 2, 11, "MAJOR")
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, content string")
    empty = spark.createDataFrame([], "path string, hash string")
    changes, facts_, hashes = semantic.analyse_changed(files, empty, lambda df: df.select("path"))
    assert {r["change"] for r in changes.collect()} == {"added"} and facts_.count() == 3
    again, todo, _ = semantic.analyse_changed(files.where("path <> 'c'").withColumn("content", F.when(F.col("path") == "a", "x").otherwise(F.col("content"))), hashes, lambda df: df.select("path"))
    assert dict(rows(again)) == {"a": "modified", "b": "unchanged", "c": "deleted"} and rows(todo) == [("a",)]
    t = extract.file_facts(spark.createDataFrame([("r", "a.ts", "export interface A {\n  x: string;\n}\n")], "repository string, path string, text string"), ["repository", "path"], path="path")
    h = semantic.type_hashes(t).collect()
    assert len(h) == 1 and h[0]["exported"] and len(h[0]["hash"]) == 64

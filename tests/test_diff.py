from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from skein.operators import diff


def side(spark, data):
    return spark.createDataFrame(data, "entity string, field string, type string, required boolean")


def test_schema_rules(spark):
    old = side(spark, [("E", "a", "int", True), ("E", "b", "string", False), ("E", "c", None, False), (None, "n", "x", False)])
    new = side(spark, [("E", "a", "number", True), ("E", "d", "int", True), ("E", "e", "int", False), ("E", "c", None, False), (None, "n", "x", False)])
    got = rows(diff.snapshot_diff(old, new, ["entity", "field"], diff.SCHEMA_RULES).select("field", "change", "severity", "detail"))
    assert got == [("a", "TYPE_CHANGED", "MAJOR", "int -> number"), ("b", "FIELD_REMOVED", "MAJOR", ""), ("d", "FIELD_ADDED", "MAJOR", "required"), ("e", "FIELD_ADDED", "MINOR", "optional")]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.text("abc", min_size=1, max_size=2), st.text("xy", max_size=2), max_size=4), st.dictionaries(st.text("abc", min_size=1, max_size=2), st.text("xy", max_size=2), max_size=4))
def test_properties(spark, a, b):
    make = lambda m: spark.createDataFrame(list(m.items()), "k string, hash string")
    assert rows(diff.snapshot_diff(make(a), make(a), ["k"], diff.HASH_RULES)) == []
    there = {r[:2] for r in rows(diff.snapshot_diff(make(a), make(b), ["k"], diff.HASH_RULES))}
    back = {r[:2] for r in rows(diff.snapshot_diff(make(b), make(a), ["k"], diff.HASH_RULES))}
    swap = {"added": "deleted", "deleted": "added", "modified": "modified"}
    assert {(k, swap[c]) for k, c in there} == back


def test_chain_rules_keep_order(spark):
    def make(data):
        rows_ = [(s, [(n, c) for n, c in chain]) for s, chain in data]
        return spark.createDataFrame(rows_, "scope string, chain array<struct<name:string,config:string>>")

    plain = lambda *names: [(n, "") for n in names]
    old = make([("g", plain("jwt", "cors")), ("h", plain("json", "log")), ("i", plain("a")), ("k", [("cors", "x"), ("limiter", "")]), ("same", plain("jwt")), ("more", plain("log")), ("none", [])])
    new = make([("g", plain("cors")), ("h", plain("log", "json")), ("k", [("cors", "y"), ("limiter", "")]), ("same", plain("jwt")), ("more", plain("log", "jwt")), ("none", [])])
    got = rows(diff.chain_findings(old, new, ["scope"]))
    assert got == [
        ("g", "MIDDLEWARE_ORDER_CHANGED", "", "MINOR"), ("g", "MIDDLEWARE_REMOVED", "jwt", "MAJOR"), ("h", "MIDDLEWARE_ORDER_CHANGED", "", "PATCH"), ("i", "CHAIN_REMOVED", "", "MAJOR"),
        ("k", "MIDDLEWARE_CONFIG_CHANGED", "cors", "MINOR"), ("more", "MIDDLEWARE_ORDER_CHANGED", "", "MINOR"),
    ]


def test_surface_rules_and_moves(spark):
    layout = "repo string, method string, path string, operation_id string, params array<string>, required array<string>, request map<string,string>, responses map<string,string>, auth_type string, auth_required boolean"
    make = lambda data: spark.createDataFrame([("r", *x) for x in data], layout)
    old = make([
        ("GET", "/a/{id}", "getA", ["id"], [], {}, {"200": "x"}, "Public", False), ("POST", "/b", "createB", [], ["n"], {"n": "int", "o": "int"}, {"200": "x", "201": "y"}, "Public", False),
        ("GET", "/gone", "twice", [], [], {}, {}, "Public", False), ("GET", "/gone2", "twice", [], [], {}, {}, "Public", False), ("GET", "/n", None, None, None, None, None, "JWT", True),
    ])
    new = make([
        ("PUT", "/c", "getA", [], [], {}, {"200": "x"}, "Public", False), ("POST", "/b", "createB", [], ["n", "m"], {"n": "string", "o": "int", "p": "int", "m": "int"}, {"200": "z"}, "JWT", True),
        ("GET", "/n", None, None, None, None, None, "JWT", True),
    ])
    got = {tuple(r)[1:] for r in rows(diff.surface_findings(old, new, ["repo"]))}
    assert got == {
        ("GET /a/{id}", "API_REMOVAL", "MAJOR", ""), ("GET /gone", "API_REMOVAL", "MAJOR", ""), ("GET /gone2", "API_REMOVAL", "MAJOR", ""), ("PUT /c", "API_ADDITION", "MINOR", ""),
        ("PUT /c", "METHOD_CHANGED", "MAJOR", "GET -> PUT"), ("PUT /c", "PATH_CHANGED", "MAJOR", "/a/{id} -> /c"), ("PUT /c", "PATH_PARAMETER_REMOVED", "MAJOR", "id"),
        ("POST /b", "REQUIRED_FIELD_ADDED", "MAJOR", "m"), ("POST /b", "API_REQUEST_EXPANSION", "MINOR", "p"), ("POST /b", "FIELD_TYPE_CHANGED", "MAJOR", "n"), ("POST /b", "STATUS_REMOVED", "MAJOR", "201"),
        ("POST /b", "RESPONSE_CHANGED", "MAJOR", "200"), ("POST /b", "AUTH_TIGHTENING", "MAJOR", "Public -> JWT"),
    }

import json

from conftest import rows

from skein.operators import drift

SCHEMA = "file_name string, feed string, file_seq int, delivered_at timestamp_ntz, line_no int, raw string, field string, kind string"


def make(spark, files):
    data = [(f"{feed}/{seq}", feed, seq, None, i, raw if raw is None or isinstance(raw, str) else json.dumps(raw), "clash", "clash") for feed, seq, lines in files for i, raw in enumerate(lines)]
    return spark.createDataFrame(data, SCHEMA)


def test_changes(spark):
    lines = make(
        spark,
        [
            ("f", 1, [{"a": 1, "b": {"x": "s"}, "l": [{"q": 1}], "opt": None}, "", "null", None, '{"broken'] ),
            ("f", 3, [{"a": 1.5, "b": {"y": "s"}, "l": [{"q": 1}], "n": True}]),
            ("f", 4, [{"a": 1.5, "b": {"y": "s"}, "l": [{"q": 1}], "n": True}, {"l": []}]),
            ("f", 5, ["not json"]),
            ("g", 1, [{"only": 1}]),
        ],
    )
    foot = drift.footers(lines)
    got = rows(drift.changes(foot))
    assert got == sorted(
        [
            ("f/3", "type_changed", "a", ""),
            ("f/3", "renamed", "b.x", "b.y"),
            ("f/3", "added", "n", ""),
            *[("f/5", "removed", p, "") for p in ("a", "b", "b.y", "l", "l[]", "l[].q", "n")],
        ],
        key=repr,
    )
    table = drift.consistent_table(lines, foot, drift.changes(foot))
    assert {"a", "n", "b_x"} <= set(table.columns)
    assert table.count() == 5


def test_repeated_delivery_and_empty(spark):
    twice = make(spark, [("f", 1, [{"a": 1}, {"a": 1}]), ("f", 2, [{"a": "s"}])])
    assert rows(drift.changes(drift.footers(twice.union(twice)))) == [("f/2", "type_changed", "a", "")]
    assert rows(drift.changes(drift.footers(make(spark, [])))) == []


def test_deep_nesting_is_read(spark):
    v = {"a": 1}
    for _ in range(300):
        v = {"a": v}
    out = {}
    drift.walk(v, "", out)
    assert len(out) == 301


def test_string_to_object_drift_keeps_both(spark):
    lines = make(
        spark,
        [
            ("f", 1, [{"a": {"b": "s", "o": {"x": 1}}}]),
            ("f", 2, [{"a": {"b": {"name": "t", "n": 2}, "o": {"x": 2}}}, {"a": {"b": 7}}]),
            ("g", 1, [{"a": {"b": "never drifted"}}]),
        ],
    )
    foot = drift.footers(lines)
    table = drift.consistent_table(lines, foot, drift.changes(foot))
    assert set(table.columns) == {"_file_name", "_line_no", "a_b", "a_b_name", "a_b_n", "a_o_x", "_rest"}
    assert dict(table.dtypes)["a_b"] == "string"
    got = rows(table.select("_file_name", "_line_no", "a_b", "a_b_name", "a_b_n", "a_o_x"))
    assert got == sorted(
        [
            ("f/1", 0, "s", None, None, 1),
            ("f/2", 0, '{"name":"t","n":2}', "t", 2, 2),
            ("f/2", 1, "7", None, None, None),
            ("g/1", 0, "never drifted", None, None, None),
        ],
        key=repr,
    )


def leaves(v, path=""):
    """Non-null scalars and arrays outside arrays."""
    if isinstance(v, dict):
        return [x for k, y in v.items() for x in leaves(y, f"{path}.{k}" if path else k)]
    return [] if v is None else [v]


def test_no_value_is_lost(spark):
    texts = [
        '\ufeff{"a": 1, "b": {"c": "s"}}', '{"a": 1, "a": 2, "b": {"c": null}}', '{"a": NaN}', '{"a": 18446744073709551617, "b.c": 7, "b": {"c": 8}}',
        '{"a": 1.5, "A": 3, "a_b": 4, "q\'`x": 5}', '{"b": "plain", "l": [1, null]}', '{"a": true}', "[]", "null", "",
    ]
    lines = make(spark, [("f", 1, texts)])
    foot = drift.footers(lines)
    wide = drift.consistent_table(lines, foot, drift.changes(foot))
    assert len({c.lower() for c in wide.columns}) == len(wide.columns)
    got = {r["_line_no"]: r.asDict() for r in wide.collect()}
    assert sorted(got) == [0, 1, 3, 4, 5, 6]
    assert got[1]["a_2"] == "2" and got[6]["a_2"] == "true" and got[5]["b"] == "plain" and got[5]["l"] == "[1,null]" and got[0]["b"] == '{"c":"s"}'
    assert got[4]["A"] == 3 and got[4]["a_b"] == 4 and got[4]["q'`x"] == 5
    for no, row in got.items():
        want = leaves(json.loads(texts[no].lstrip("\ufeff")))
        held = [v for c, v in row.items() if c not in ("_file_name", "_line_no", "_rest") and v is not None and not str(v).startswith("{")]
        held += list(json.loads(row["_rest"]).values()) if row["_rest"] else []
        text = lambda v: v if isinstance(v, str) else json.dumps(v, separators=(",", ":"))
        assert sorted(map(text, held)) == sorted(map(text, want)), no


def test_renames_there_and_back_are_one_column(spark):
    chain = [("f", i, [{f"n{i}": i, "k": 1}]) for i in range(40)] + [("f", 40, [{"n0": 40, "k": 1}])]
    lines = make(spark, chain)
    foot = drift.footers(lines)
    log = drift.changes(foot)
    wide = drift.consistent_table(lines, foot, log)
    assert wide.columns == ["_file_name", "_line_no", "k", "n0", "_rest"]
    assert sorted(r["n0"] for r in wide.collect()) == list(range(41))
    assert {r["field"] for r in drift.alias_table(log).collect()} == {"n0"}


def test_renames_of_one_feed_leave_another_alone(spark):
    lines = make(spark, [("a", 1, [{"x": 1}]), ("a", 2, [{"y": 2}]), ("b", 1, [{"x": 7, "y": 5}]), ("b", 2, [{"y": 6}])])
    foot = drift.footers(lines)
    wide = drift.consistent_table(lines, foot, drift.changes(foot))
    assert sorted((r["_file_name"], r["x"], r["y"]) for r in wide.select("_file_name", "x", "y").na.fill(-1).collect()) == [
        ("a/1", -1, 1), ("a/2", -1, 2), ("b/1", 7, 5), ("b/2", -1, 6)
    ]


def test_below_a_renamed_object(spark):
    lines = make(spark, [("a", 1, [{"meta": {"v": 1, "w": 2}}]), ("a", 2, [{"info": {"v": 3, "w": 4}}]), ("a", 3, [{"info": {"u": 5, "w": 4}}])])
    foot = drift.footers(lines)
    wide = drift.consistent_table(lines, foot, drift.changes(foot))
    assert len(wide.columns) == 5 and sorted(tuple(r)[2:4] for r in wide.collect()) == [(1, 2), (3, 4), (5, 4)]

import datetime as dt

from conftest import rows

from skein.operators.snapshots import snapshot_changes

SCHEMA = "repository string, snapshot_no int, file_path string, content_hash string, symbol_graph_hash string, arrived_at timestamp_ntz, change string"


def t(n):
    return dt.datetime(2025, 1, 1, 0, n)


def test_labels(spark):
    data = [
        ("r", 1, "./a\\b.py", "sha256:AA", "1", t(1)), ("r", 1, "gone.py", "x", "1", t(1)), ("r", 1, "null.py", None, "1", t(1)), ("r", 1, "late.py", "old", "1", t(5)),
        ("r", 4, "a/b.py", "aa", "1", t(2)), ("r", 4, "new.py", "y", None, t(2)), ("r", 4, "null.py", "z", "1", t(2)), ("r", 4, "late.py", "first", "1", t(2)), ("r", 4, "late.py", "old", "1", t(3)), ("r", 4, "late.py", "old", "1", t(3)),
        ("r", 5, "a//b.py", "aa", "2", t(2)), ("r", 5, "new.py", "y", None, t(2)), ("r", 5, "null.py", "z", None, t(2)), ("r", 5, "late.py", "old", "1", t(3)),
        ("other", 7, "a", "1", "1", t(1)), (None, 1, "a", "1", "1", t(1)), ("r", None, "a", "1", "1", t(1)), ("r", 5, None, "1", "1", t(1)),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in data], SCHEMA)
    assert rows(snapshot_changes(df)) == [("r", 4, "gone.py", "removed"), ("r", 4, "new.py", "added"), ("r", 5, "a/b.py", "changed")]
    assert rows(snapshot_changes(df.limit(0))) == []


def test_long_lists_of_snapshots_are_joined_alike(spark, monkeypatch):
    import random

    from skein.operators import snapshots

    r = random.Random(7)
    data = [
        (r.choice("ab"), r.randrange(1, 6), f"./p//f{r.randrange(6)}", r.choice([None, "sha256:0A", "0a", "0b", "zz", "5A5a"]), r.choice([None, "1f", "sha256:1F", "q"]), r.randrange(50))
        for _ in range(150)
    ] + [(None, 1, "x", "0a", "1f", 1), ("a", None, "x", "0a", "1f", 1), ("a", 1, None, "0a", "1f", 1)]
    df = spark.createDataFrame(data, "repository string, snapshot_no int, file_path string, content_hash string, symbol_graph_hash string, t int").selectExpr("*", "timestamp_seconds(t) as arrived_at", "1 as _prev")
    wide = rows(snapshot_changes(df))
    monkeypatch.setattr(snapshots, "BROADCAST_SNAPSHOTS", -1)
    assert rows(snapshot_changes(df)) == wide and wide
    norm = lambda h: h if h is None else h.lower().removeprefix("sha256:")
    held = {}
    for repo, no, path, c, s, t in data:
        if repo and no and path:
            rank = lambda h: (0, "") if h is None else (1 + (h in ("zz", "q")), h)
            k, v = (repo, no, path.replace("./", "", 1).replace("//", "/")), (t, rank(norm(c)), rank(norm(s)))
            held[k] = max(held.get(k, v), v)
    want = []
    for repo in "ab":
        nos = sorted({k[1] for k in held if k[0] == repo})
        for p, n in zip(nos, nos[1:]):
            for path in {k[2] for k in held if k[0] == repo and k[1] in (p, n)}:
                o, w = held.get((repo, p, path)), held.get((repo, n, path))
                differs = o and w and any(x[0] and y[0] and x != y for x, y in zip(o[1:], w[1:]))
                if not o or not w or differs:
                    want.append((repo, n, path, "added" if not o else "removed" if not w else "changed"))
    assert wide == sorted(want, key=repr)

"""Schemas that drift between files (problem 3).

Every file gets a footer: the fields its readable lines hold and their types.
Exploded footers form a catalogue (producer, field, type, file); islands of
consecutive files, found with ``lag``, are the lifespans of a field's type.
Where a lifespan starts or ends, a change is logged.  Renames found on the way
form an alias table, from which :func:`consistent_table` generates its casts.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.storage import materialize, spread

TYPES = ("string", "integer", "fraction", "boolean", "object", "array")


def walk(value: object, path: str, out: dict[str, set[str]]) -> None:
    """Add path and type of every non-null value below ``value``.  Iterative: nesting has no bound."""
    stack = [(value, path)]
    while stack:
        v, p = stack.pop()
        if v is None:
            continue
        if isinstance(v, bool):
            kind = "boolean"
        elif isinstance(v, int):
            kind = "integer"
        elif isinstance(v, float):
            kind = "fraction"
        elif isinstance(v, str):
            kind = "string"
        elif isinstance(v, dict):
            kind = "object"
            stack.extend((x, f"{p}.{k}" if p else k) for k, x in v.items())
        else:
            kind = "array"
            stack.extend((x, p + "[]") for x in v)
        if p:
            out.setdefault(p, set()).add(kind)


def _no_constant(name: str) -> object:
    raise ValueError(f"{name} is no JSON")


def _read(raw: object) -> dict | None:
    """The object on a line; None for lines that aren't JSON objects, ``NaN`` and its like included."""
    if not isinstance(raw, str):
        return None
    try:
        v = json.loads(raw.lstrip("\ufeff"), parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return None
    return v if isinstance(v, dict) else None


def _footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        seen: dict[tuple, dict[str, set[str]]] = {}
        for name, feed, seq, raw in zip(pdf["file_name"], pdf["feed"], pdf["file_seq"], pdf["raw"]):
            fields = seen.setdefault((name, feed, None if pd.isna(seq) else int(seq)), {"": {""}})
            v = _read(raw)
            if v is not None:
                walk(v, "", fields)
        rows = [(*k, f, t) for k, fields in seen.items() for f, kinds in fields.items() for t in kinds]
        yield pd.DataFrame(rows, columns=["file_name", "feed", "file_seq", "field", "kind"]).astype({"file_seq": "Int64"})


def footers(lines: DataFrame) -> DataFrame:
    """Distinct (file_name, feed, file_seq, field, kind).

    A file without a readable object line keeps one row with field ``''`` so
    that it still takes part in its feed's order.  Lines that aren't JSON
    objects (null, empty, ``null``, cut off) hold no fields.
    """
    rows = spread(lines.select("file_name", "feed", F.col("file_seq").cast("long"), "raw")).mapInPandas(
        _footers, "file_name string, feed string, file_seq long, field string, kind string"
    )
    return rows.distinct()


def lifespans(footer: DataFrame) -> DataFrame:
    """(feed, field, kind, first_no, last_no): islands over the feed's files numbered without gaps."""
    numbered, _ = _numbered(footer)
    w = Window.partitionBy("feed", "field", "kind").orderBy("no")
    return (
        numbered.where("field <> ''")
        .withColumn("_new", (F.col("no") - F.lag("no", 1, -1).over(w) > 1).cast("int"))
        .withColumn("_island", F.sum("_new").over(w))
        .groupBy("feed", "field", "kind", "_island")
        .agg(F.min("no").alias("first_no"), F.max("no").alias("last_no"))
        .drop("_island")
    )


def _numbered(footer: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Footer rows and the files, both with ``no``: the file's place in its feed.

    Files are few against their lines, and a feed's list of files is what is
    windowed, never its rows.  Two files of one number go by name.
    """
    w = Window.partitionBy("feed").orderBy("file_seq", "file_name")
    files = footer.select("feed", "file_seq", "file_name").distinct().withColumn("no", F.row_number().over(w))
    both = footer.join(
        files.select(F.col("feed").alias("_f"), F.col("file_seq").alias("_s"), F.col("file_name").alias("_n"), "no"),
        F.col("feed").eqNullSafe(F.col("_f")) & F.col("file_seq").eqNullSafe(F.col("_s")) & F.col("file_name").eqNullSafe(F.col("_n")),
    ).drop("_f", "_s", "_n")
    return both, files


def parent_of(field):
    """``a.b`` of ``a.b.c`` and of ``a.b[]``; ``''`` at the root."""
    return F.when(field.endswith("[]"), F.expr("substring(field, 1, length(field) - 2)")).otherwise(
        F.regexp_replace(field, r"(^|\.)[^.]*$", "")
    )


def changes(footer: DataFrame) -> DataFrame:
    """(file_name, change, field, new_field) of each file against the previous of its feed.

    A lifespan that starts at a later file than the feed's first is a start
    event there; one that ends before the feed's last file is an end event at
    the next file.  Starts and ends of one field in one file are a type change
    when both kinds are there, a rename when an ended and a started field share
    parent and kinds, else a removal or an addition.  Several candidates of one
    parent and kind pair in alphabetical order.  A file that holds several
    types of a field counts as having that set of types.
    """
    _, files = _numbered(footer)
    kinds = footer.groupBy("feed", "file_seq", "file_name", "field").agg(
        F.concat_ws("|", F.array_sort(F.collect_set("kind"))).alias("kind")
    )
    spans = materialize(lifespans(kinds), "lifespans")
    spot = files.select(F.col("feed").alias("_feed"), F.col("no").alias("_no"), "file_name")
    last = files.groupBy("feed").agg(F.max("no").alias("_last"))
    begun = spans.where("first_no > 1").select("feed", F.col("first_no").alias("no"), "field", F.lit(None).cast("string").alias("old"), F.col("kind").alias("new"))
    ended = (
        spans.join(last.withColumnRenamed("feed", "_feed"), F.col("feed").eqNullSafe(F.col("_feed")))
        .where("last_no < _last")
        .select("feed", (F.col("last_no") + 1).alias("no"), "field", F.col("kind").alias("old"), F.lit(None).cast("string").alias("new"))
    )
    events = (
        begun.unionByName(ended)
        .groupBy("feed", "no", "field")
        .agg(F.max("old").alias("old"), F.max("new").alias("new"))
        .withColumn("parent", parent_of(F.col("field")))
    )
    events = materialize(events, "drift-events")
    typed = events.where("old is not null and new is not null").select(
        "feed", "no", F.lit("type_changed").alias("change"), "field", F.lit("").alias("new_field")
    )
    pair = Window.partitionBy("feed", "no", "parent", F.coalesce("old", "new"), F.col("old").isNull()).orderBy("field")
    single = events.where("old is null or new is null").withColumn("k", F.row_number().over(pair))
    key = ["feed", "no", "parent", "kind", "k"]
    gone = single.where("new is null").select("feed", "no", "parent", F.col("old").alias("kind"), "k", F.col("field").alias("gone"))
    came = single.where("old is null").select("feed", "no", "parent", F.col("new").alias("kind"), "k", F.col("field").alias("came"))
    moved = gone.join(came, key, "full").select(
        "feed",
        "no",
        F.when(F.col("gone").isNull(), "added").when(F.col("came").isNull(), "removed").otherwise("renamed").alias("change"),
        F.coalesce("gone", "came").alias("field"),
        F.when(F.col("gone").isNotNull() & F.col("came").isNotNull(), F.col("came")).otherwise("").alias("new_field"),
    )
    return (
        typed.unionByName(moved)
        .join(spot, F.col("feed").eqNullSafe(F.col("_feed")) & (F.col("no") == F.col("_no")))
        .select("file_name", "change", "field", "new_field")
    )


def alias_table(change_log: DataFrame) -> DataFrame:
    """(alias, field): every name that takes part in a rename, with the least name of its connected set.

    The renames are those of the log, told apart by field names only, so they are
    as many as the producers' names, whatever the number of files; sets grow by
    taking over the least name of a neighbour, jumping to that name's own, until
    nothing changes.
    """
    ren = change_log.where("change = 'renamed'").select("field", "new_field").distinct()
    both = materialize(ren.unionByName(ren.select(F.col("new_field").alias("field"), F.col("field").alias("new_field"))), "renames")
    label = materialize(both.groupBy("field").agg(F.least(F.col("field"), F.min("new_field")).alias("low")), "aliases")
    while True:
        near = both.join(label.withColumnRenamed("field", "new_field"), "new_field").groupBy("field").agg(F.min("low").alias("near"))
        step = label.join(near, "field").select("field", F.least("low", "near").alias("low"), F.col("low").alias("was"))
        far = step.select(F.col("field").alias("_f"), F.col("low").alias("_l"))
        grown = materialize(step.join(far, F.col("low") == F.col("_f"), "left").select("field", F.least("low", "_l").alias("low"), "was"), "aliases")
        label = grown.select("field", "low")
        if grown.where("low <> was").isEmpty():
            return label.select(F.col("field").alias("alias"), F.col("low").alias("field"))


SPARK_TYPES = {"string": "string", "integer": "bigint", "fraction": "double", "boolean": "boolean", "object": "string", "array": "string"}


def one_names(known: dict[str, tuple], renames: list[tuple[str, str]]) -> dict[str, str]:
    """Each field's one name: renamed fields share the one of least rank (ties: the least name).

    Parents first: what lies below a renamed object goes by the object's one
    name, and fields of one name below it are the same field.  ``files_of``
    counts the files of each field; fields inside arrays aren't in it.
    """
    head = lambda f: f.rpartition(".")[0]
    below: dict[str, set[str]] = {}
    for old, new in renames:
        below.setdefault(old, set()).add(new)
        below.setdefault(new, set()).add(old)
    named: dict[str, str] = {}
    by_depth: dict[int, list[str]] = {}
    for f in known:
        by_depth.setdefault(f.count("."), []).append(f)
    for depth in sorted(by_depth):
        spelled: dict[str, list[str]] = {}
        for f in sorted(by_depth[depth]):
            parent = named.get(head(f), head(f))
            spelled.setdefault(f"{parent}.{f.rpartition('.')[2]}" if parent else f, []).append(f)
        own = {f: k for k, fs in spelled.items() for f in fs}
        seen: set[str] = set()
        for start in sorted(spelled):
            if start in seen:
                continue
            group, todo = [], [start]
            seen.add(start)
            while todo:
                k = todo.pop()
                group.append(k)
                for f in spelled[k]:
                    for other in below.get(f, ()):
                        o = own.get(other)
                        if o is not None and o not in seen:
                            seen.add(o)
                            todo.append(o)
            best = min(group, key=lambda k: (min(known[f] for f in spelled[k]), k))
            named |= {f: best for k in group for f in spelled[k]}
    return named


def _columns_of(names: list[str]) -> list[str]:
    """Column names: dots as underscores; what would clash, in whatever letter case, gets a number."""
    taken, out = {"_file_name", "_line_no", "_rest"}, []
    for name in names:
        base = column = name.replace(".", "_") or "_"
        k = 2
        while column.lower() in taken:
            column, k = f"{base}_{k}", k + 1
        taken.add(column.lower())
        out.append(column)
    return out


def _fits(v: object, kind: str) -> object:
    """``v`` as a value of the column, None where it has no exact place there."""
    if kind == "string":
        return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(",", ":"))
    if kind == "boolean":
        return v if isinstance(v, bool) else None
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        return None
    if kind == "bigint":
        return v if isinstance(v, int) and -(1 << 63) <= v < 1 << 63 else None
    try:
        return float(v) if isinstance(v, float) or int(float(v)) == v else None
    except OverflowError:
        return None


def _filler(names: dict[str, str], spot: dict[str, int], kinds: list[str], columns: list[str]):
    """Lines to rows: each readable line is parsed once and its values are laid into their columns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep, cells, rest = [], [[] for _ in kinds], []
            for no, (raw, apart) in enumerate(zip(b["raw"], b["apart"])):
                top = _read(raw)
                if top is None:
                    continue
                keep.append(no)
                row: list = [None] * len(kinds)
                left: dict[str, object] = {}
                own = set() if apart is None else set(apart)
                stack = [(x, k) for k, x in reversed(top.items())]
                while stack:
                    v, path = stack.pop()
                    if v is None:
                        continue
                    if isinstance(v, dict):
                        stack.extend((x, f"{path}.{k}" if path else k) for k, x in reversed(v.items()))
                    name = names.get(path, path)
                    at = spot.get(path if name in own else name)
                    if at is None:
                        if not isinstance(v, dict):
                            left[path] = v
                        continue
                    value = _fits(v, kinds[at]) if row[at] is None else None
                    if value is None:
                        left[path] = v
                    else:
                        row[at] = value
                for cell, value in zip(cells, row):
                    cell.append(value)
                rest.append(json.dumps(left, ensure_ascii=False, separators=(",", ":")) if left else None)
            out = {"_file_name": b["file_name"].iloc[keep].to_numpy(), "_line_no": b["line_no"].iloc[keep].to_numpy()}
            for column, kind, cell in zip(columns, kinds, cells):
                out[column] = pd.array(cell, dtype={"bigint": "Int64", "double": "Float64", "boolean": "boolean"}.get(kind, "object"))
            yield pd.DataFrame(out | {"_rest": pd.array(rest, dtype="object")})

    return run


def consistent_table(lines: DataFrame, footer: DataFrame, change_log: DataFrame) -> DataFrame:
    """Every readable line as one row of one schema, with every value it holds.

    The columns are the leaf fields outside arrays, with dots as underscores, and
    arrays as JSON text.  Fields renamed into each other, whatever the way, are
    one column under the name with the lowest file number (ties: the name in most
    files, then the least); in a feed where two of them stand in one file they are different
    fields and keep columns of their own.  Several types of one field widen
    (integer to fraction, anything else to string); a field that is an object in
    some files only is a string column, too, which holds those objects as JSON
    text, beside the columns of their leaves.  ``_rest`` holds as JSON what has
    no exact place: numbers beyond the type, and a second value of one path
    (names that hold dots).  Lines are read as for the footers: a byte order mark
    doesn't count, of a repeated key the last value.  Only the catalogue reaches
    the driver: one row per field and per distinct rename.
    """
    spark = lines.sparkSession
    plain = footer.where("field <> '' and not contains(field, '[]')")
    cat = plain.groupBy("field").agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.coalesce(F.min("file_seq"), F.lit(0)).alias("first"), F.count_distinct("file_name").alias("n")).collect()
    renames = [tuple(r) for r in change_log.where("change = 'renamed' and not contains(field, '[]')").select("field", "new_field").distinct().collect()]
    names = one_names({r["field"]: (r["first"], -r["n"]) for r in cat}, renames)
    members = Counter(names.values())
    moved = [(f, n) for f, n in names.items() if members[n] > 1]
    rows = lines.select("file_name", "line_no", "raw", "feed")
    split: set[str] = set()
    if moved:
        sets = spark.createDataFrame(moved, "field string, name string")
        apart = (
            plain.select("feed", "file_name", "field").distinct().join(F.broadcast(sets), "field")
            .groupBy("feed", "file_name", "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            .groupBy("feed").agg(F.collect_set("name").alias("apart"))
        )
        apart = materialize(apart, "apart")
        split = {r[0] for r in apart.select(F.explode("apart")).distinct().collect()}
        rows = rows.join(apart.withColumnRenamed("feed", "_feed"), F.col("feed").eqNullSafe(F.col("_feed")), "left")
    else:
        rows = rows.withColumn("apart", F.lit(None).cast("array<string>"))
    kinds_of: dict[str, set[str]] = {}
    for r in cat:
        for name in {names[r["field"]], *([r["field"]] if names[r["field"]] in split else [])}:
            kinds_of.setdefault(name, set()).update(r["kinds"])
    order = sorted(n for n, k in kinds_of.items() if k != {"object"})
    kinds = []
    for n in order:
        k = kinds_of[n]
        kinds.append(SPARK_TYPES[next(iter(k))] if len(k) == 1 else "double" if k == {"integer", "fraction"} else "string")
    columns = _columns_of(order)
    schema = ", ".join(["_file_name string", "_line_no int", *(f"`{c.replace('`', '``')}` {k}" for c, k in zip(columns, kinds)), "_rest string"])
    return spread(rows.select("file_name", F.col("line_no").cast("int"), "raw", "apart")).mapInPandas(_filler(names, {n: i for i, n in enumerate(order)}, kinds, columns), schema)

"""Semantic diffs: symbols, types, contracts, frameworks, and what they reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.labels import severity_rank, stable_id
from skein.operators.diff import ADDED, REMOVED, SCHEMA_RULES, SURFACE_RULES, Rule, both, differs, moved, snapshot_diff
from skein.operators.graph import reachable

#: Scores from which a symbol change is MAJOR or MINOR.
MAJOR_FROM, MINOR_FROM = 8.0, 4.0


def symbol_breaks(old: DataFrame, new: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, name, kind, change, score, severity, id): removed, changed or hidden symbols, weighed by what they reach.

    Symbols: path, name, kind, signature, visibility.  Edges: src, dst of
    ``path:name``.  Score: 6, plus half the out-degree, plus 2 where public (or
    where a public symbol became private).
    """
    degree = edges.select("src", "dst").distinct().groupBy(F.col("src").alias("_s")).agg(F.count(F.lit(1)).alias("deg"))
    shown = lambda c: c["visibility"] == "public"
    rules = [
        Rule("SYMBOL_REMOVED", "MAJOR", REMOVED, lambda o, n: F.when(shown(o), "public").otherwise("private")),
        Rule("SIGNATURE_CHANGED", "MAJOR", differs("signature"), lambda o, n: F.when(shown(o), "public").otherwise("private")),
        Rule("VISIBILITY_DOWNGRADED", "MAJOR", lambda o, n: both(o, n) & shown(o) & ~shown(n), lambda o, n: F.lit("public")),
    ]
    f = snapshot_diff(old, new, ["path", "name", "kind"], rules)
    f = f.join(degree, F.concat_ws(":", "path", "name") == F.col("_s"), "left")
    score = F.lit(6.0) + F.coalesce("deg", F.lit(0)) * 0.5 + F.when(F.col("detail") == "public", 2.0).otherwise(0.0)
    s = f.select("path", "name", "kind", "change", score.alias("score"))
    sev = F.when(F.col("score") >= MAJOR_FROM, "MAJOR").when(F.col("score") >= MINOR_FROM, "MINOR").otherwise("PATCH")
    s = s.withColumn("severity", sev).withColumn("severity_rank", severity_rank(F.col("severity")))
    # the score enters the id as text with three digits
    return s.withColumn("id", stable_id(path=F.col("path"), name=F.col("name"), kind=F.col("kind"), change=F.col("change"), score=F.format_number("score", 3)))


TYPE_RULES = [
    Rule("TYPE_REMOVED", "MAJOR", REMOVED), Rule("TYPE_CHANGED", "MAJOR", differs("hash")), Rule("TYPE_ADDED", "MINOR", lambda o, n: o.isNull() & n["exported"]),
]
CONTRACT_RULES = [
    Rule("ROUTE_REMOVED", "MAJOR", REMOVED),
    Rule("BODY_SCHEMA_REMOVED", "MAJOR", lambda o, n: both(o, n) & (F.size(o["body_fields"]) > 0) & (F.coalesce(F.size(n["body_fields"]), F.lit(0)) <= 0)),
    Rule("BODY_FIELD_REMOVED", "MAJOR", lambda o, n: both(o, n) & (F.size(n["body_fields"]) > 0) & (F.size(F.array_except(o["body_fields"], n["body_fields"])) > 0), lambda o, n: F.array_join(F.array_sort(F.array_except(o["body_fields"], n["body_fields"])), ",")),
    Rule("QUERY_PARAM_REQUIRED", "MAJOR", lambda o, n: both(o, n) & (F.size(F.array_intersect(o["optional_query"], n["required_query"])) > 0), lambda o, n: F.array_join(F.array_sort(F.array_intersect(o["optional_query"], n["required_query"])), ",")),
    Rule("STATUS_REMOVED", "MAJOR", lambda o, n: both(o, n) & (F.size(F.array_except(o["status_codes"], n["status_codes"])) > 0), lambda o, n: F.array_join(F.array_sort(F.array_except(o["status_codes"], n["status_codes"])), ",")),
]
#: Models and routes of web frameworks share the schema and surface rules; new models and tightened or loosened access are told, too.
FRAMEWORK_ROUTE_RULES = [
    Rule("ROUTE_ADDED", "MINOR", ADDED), Rule("ROUTE_REMOVED", "MAJOR", REMOVED), Rule("AUTH_TIGHTENED", "MAJOR", lambda o, n: both(o, n) & (o["auth_type"] == "Public") & (n["auth_type"] != "Public"), moved("auth_type")),
    Rule("AUTH_CHANGED", "MINOR", lambda o, n: both(o, n) & (o["auth_type"] != n["auth_type"]) & (o["auth_type"] != "Public"), moved("auth_type")),
]


def type_hashes(facts: DataFrame) -> DataFrame:
    """(repository, path, name, hash, exported): structural hash of each type over its sorted fields."""
    f = facts.where("kind in ('model_field', 'enum_value')").groupBy("repository", "path", F.col("owner").alias("name")).agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "name", "value"))), ";").alias("shape"))
    e = facts.where("kind = 'export'").select("repository", "path", "name").distinct().withColumn("exported", F.lit(True))
    return f.join(e, ["repository", "path", "name"], "left").select("repository", "path", "name", stable_id(64, shape=F.col("shape")).alias("hash"), F.coalesce("exported", F.lit(False)).alias("exported"))


def dependents(findings: DataFrame, edges: DataFrame, key: Column) -> DataFrame:
    """(symbol, chain): the sorted nodes that depend, directly or not, on each changed symbol.  Edges go from user to used."""
    seeds = findings.select(key.alias("node")).distinct()
    got = reachable(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), seeds).where("depth > 0 and seed <> node")
    return seeds.join(got, F.col("seed") == seeds["node"], "left").groupBy(seeds["node"].alias("symbol")).agg(F.array_sort(F.collect_set(got["node"])).alias("chain"))


def impact(changed: DataFrame, edges: DataFrame, endpoints: DataFrame, models: DataFrame) -> DataFrame:
    """One row: changed files, endpoints and models they hold, modules reached, depth, score and severity.

    ``changed``: path; ``edges``: src, dst of paths (user to used); ``endpoints``
    and ``models``: path, name.  Score: 3 an endpoint, 5 a model, 2 a reached
    file, plus the depth.
    """
    c = changed.select("path").distinct()
    api = endpoints.join(c, "path", "left_semi").agg(F.countDistinct("name").alias("apis"))
    db = models.join(c, "path", "left_semi").agg(F.countDistinct("name").alias("models"))
    r = reachable(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), c.select(F.col("path").alias("node"))).agg(F.countDistinct("node").alias("radius"), F.coalesce(F.max("depth"), F.lit(0)).alias("depth"))
    n = c.agg(F.count(F.lit(1)).alias("files"))
    # each side is one row
    one = n.join(F.broadcast(api)).join(F.broadcast(db)).join(F.broadcast(r))
    score = 3 * F.col("apis") + 5 * F.col("models") + 2 * F.col("radius") + F.col("depth")
    return one.withColumn("score", score).withColumn("severity", F.when((F.col("models") > 0) | (F.col("apis") > 0), "MAJOR").when(F.col("radius") > F.col("files"), "MINOR").otherwise("PATCH"))


def compare_reports(*families: DataFrame) -> DataFrame:
    """All findings in one table, ordered by severity (gravest first), then by text of key and change."""
    parts = []
    for f in families:
        keys = [c for c in f.columns if c not in ("change", "severity", "severity_rank", "detail", "id", "score")]
        parts.append(f.select(F.concat_ws(" ", *keys).alias("key"), "change", "severity", "severity_rank", "id"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(F.col("severity_rank").desc(), "key", "change", "id")


def analyse_changed(files: DataFrame, stored: DataFrame, analyse) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(changes, facts, hashes): only added and modified files are analysed; ``hashes`` is the next stored snapshot.

    ``files``: path, content; ``stored``: path, hash; ``analyse`` maps the files to facts.
    """
    now = files.select("path", F.substring(F.sha2("content", 256), 1, 16).alias("hash"), "content")
    rules = [Rule("added", "MINOR", ADDED), Rule("deleted", "MAJOR", REMOVED), Rule("modified", "MINOR", differs("hash")), Rule("unchanged", "PATCH", lambda o, n: both(o, n) & o["hash"].eqNullSafe(n["hash"]))]
    changes = snapshot_diff(stored.select("path", "hash"), now.select("path", "hash"), ["path"], rules).select("path", "change")
    todo = now.join(changes.where("change in ('added', 'modified')"), "path", "left_semi").select("path", "content")
    return changes, analyse(todo), now.select("path", "hash")


__all__ = ["CONTRACT_RULES", "FRAMEWORK_ROUTE_RULES", "SCHEMA_RULES", "SURFACE_RULES", "TYPE_RULES", "analyse_changed", "compare_reports", "dependents", "impact", "symbol_breaks", "type_hashes"]

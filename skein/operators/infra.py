"""Diffs of container files and CI workflows.

Facts of both snapshots become state rows (file, kind, key, value): scalars have
an empty key and the last value counts, collections have one row per member.
One rule table per family names the change and its severity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.diff import Rule, both, moved, snapshot_diff
from skein.operators.relational import infra_risk

#: Fixed values: (added, removed, changed) and their severities for each kind.
DOCKER = {
    "FROM": (None, None, ("BASE_IMAGE_CHANGED", "MAJOR")),
    "USER": (("USER_CHANGED", "MAJOR"), ("USER_CHANGED", "MAJOR"), ("USER_CHANGED", "MAJOR")),
    "ENTRYPOINT": (("ENTRYPOINT_CHANGED", "MAJOR"), ("ENTRYPOINT_CHANGED", "MAJOR"), ("ENTRYPOINT_CHANGED", "MAJOR")),
    "CMD": (("CMD_CHANGED", "MINOR"), ("CMD_CHANGED", "MINOR"), ("CMD_CHANGED", "MINOR")),
    "EXPOSE": (("PORT_ADDED", "MINOR"), ("PORT_REMOVED", "MAJOR"), None),
    "ENV": (("ENV_ADDED", "MINOR"), ("ENV_REMOVED", "PATCH"), ("ENV_CHANGED", "MINOR")),
    "VOLUME": (("VOLUME_ADDED", "MINOR"), ("VOLUME_REMOVED", "PATCH"), None),
}
WORKFLOW = {
    "job": (("JOB_ADDED", "MINOR"), ("JOB_REMOVED", "MAJOR"), None),
    "trigger": (("TRIGGER_CHANGED", "MAJOR"), ("TRIGGER_CHANGED", "MAJOR"), None),
    "permission": (("PERMISSION_ADDED", "MAJOR"), ("PERMISSION_REMOVED", "MINOR"), ("PERMISSION_CHANGED", "MAJOR")),
    "env": (("ENV_CHANGED", "PATCH"), ("ENV_CHANGED", "PATCH"), ("ENV_CHANGED", "PATCH")),
    "timeout-minutes": (("TIMEOUT_CHANGED", "PATCH"), ("TIMEOUT_CHANGED", "PATCH"), ("TIMEOUT_CHANGED", "PATCH")),
    "concurrency": (("CONCURRENCY_CHANGED", "PATCH"), ("CONCURRENCY_CHANGED", "PATCH"), ("CONCURRENCY_CHANGED", "PATCH")),
}
SCALARS = ["FROM", "USER", "ENTRYPOINT", "CMD"]
CRITICAL = ["USER_CHANGED", "ENTRYPOINT_CHANGED", "BASE_IMAGE_CHANGED", "JOB_REMOVED"]


def state(facts: DataFrame) -> DataFrame:
    """(path, kind, key, value) of docker and workflow facts."""
    f = facts.where(F.col("kind").isin("docker", "workflow")).select("path", F.col("name").alias("kind"), "owner", "value", "line")
    key = F.when(F.col("kind").isin(SCALARS), "").when(F.col("kind") == "VOLUME", F.col("value")).otherwise(F.col("owner"))
    return f.where("kind not in ('RUN', 'WORKDIR')").groupBy("path", "kind", key.alias("key")).agg(F.max_by("value", "line").alias("value"))


def _rules(table: dict) -> list[Rule]:
    out = []
    for kind, (added, removed, changed) in table.items():
        if added:
            out.append(Rule(*added, lambda o, n, k=kind: o.isNull() & (n["kind"] == k)))
        if removed:
            out.append(Rule(*removed, lambda o, n, k=kind: n.isNull() & (o["kind"] == k)))
        if changed:
            out.append(Rule(*changed, lambda o, n, k=kind: both(o, n) & (o["kind"] == k) & ~o["value"].eqNullSafe(n["value"]), moved("value")))
    return out


def infra_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, kind, key, change, severity, ...) between the facts of two snapshots; ids hash the key, so they are stable over values.

    A file that exists only on one side is a removed (MAJOR container, MINOR
    workflow) or an added file, not a list of its parts.
    """
    a, b = state(old), state(new)
    pa, pb = a.select("path").distinct(), b.select("path").distinct()
    shared = pa.join(pb, "path")
    parts = snapshot_diff(a.join(shared, "path", "left_semi"), b.join(shared, "path", "left_semi"), ["path", "kind", "key"], _rules(DOCKER) + _rules(WORKFLOW), ["path", "kind", "key", "change"])
    lower = lambda c: F.lower(c["path"]).rlike("(^|/)dockerfile")
    files = [
        Rule("FILE_REMOVED", "MAJOR", lambda o, n: n.isNull() & lower(o)), Rule("FILE_REMOVED", "MINOR", lambda o, n: n.isNull() & ~lower(o)), Rule("FILE_ADDED", "PATCH", lambda o, n: o.isNull()),
    ]
    whole = snapshot_diff(pa, pb, ["path"], files).select("path", F.lit("").alias("kind"), F.lit("").alias("key"), "change", "severity", "detail", "severity_rank", "id")
    return parts.unionByName(whole)


def infra_level(findings: DataFrame) -> DataFrame:
    """One row: LOW, MEDIUM or HIGH by number and kind of findings."""
    g = findings.agg(
        F.count_if(F.col("severity") == "MAJOR").alias("a"), F.count_if(F.col("severity") == "MINOR").alias("b"), F.count_if(F.col("severity") == "PATCH").alias("c"), F.coalesce(F.bool_or(F.col("change").isin(CRITICAL)), F.lit(False)).alias("k")
    )
    return g.select(infra_risk(F.col("a"), F.col("b"), F.col("c"), F.col("k")).alias("level"))

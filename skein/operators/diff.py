"""Snapshot diffs driven by rule tables.

One full outer join on the natural key lays the old and the new row side by
side; each rule is a condition over both sides that emits a typed finding.  All
diff families share this shape and differ in their rules.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.labels import severity_name, severity_rank, stable_id
from skein.functions.verdicts import middleware_severity, middleware_type


@dataclass
class Rule:
    """``when`` over columns ``old`` and ``new`` (structs, null where absent); ``detail`` describes the change.

    With ``each``, ``detail`` gives an array and every element is a finding.
    """

    change: str
    severity: str
    when: Callable[[Column, Column], Column]
    detail: Callable[[Column, Column], Column] = lambda old, new: F.lit("")
    each: bool = False

    def hits(self, old: Column, new: Column) -> Column:
        """The findings of this rule as an array of (change, severity, detail)."""
        held = F.coalesce(self.when(old, new), F.lit(False))
        details = self.detail(old, new) if self.each else F.array(self.detail(old, new))
        found = F.transform(details, lambda d: F.struct(F.lit(self.change).alias("change"), F.lit(self.severity).alias("severity"), d.alias("detail")))
        return F.when(held, found).otherwise(F.expr("cast(array() as array<struct<change:string,severity:string,detail:string>>)"))


REMOVED = lambda old, new: new.isNull()
ADDED = lambda old, new: old.isNull()


def both(old: Column, new: Column) -> Column:
    return old.isNotNull() & new.isNotNull()


def differs(field: str) -> Callable[[Column, Column], Column]:
    """Both sides are there and the field differs, null-safe."""
    return lambda old, new: both(old, new) & ~old[field].eqNullSafe(new[field])


def moved(field: str) -> Callable[[Column, Column], Column]:
    text = lambda c: F.coalesce(c[field].cast("string"), F.lit(""))
    return lambda old, new: F.concat(text(old), F.lit(" -> "), text(new))


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], rules: list[Rule], id_fields: list[str] | None = None) -> DataFrame:
    """(keys..., change, severity, severity_rank, detail, id): one row per key and rule that holds.

    Keys are expected once per side; null keys match null keys.  diff(a, a) has
    no rows unless a rule asks for equality.  ``id`` is the content hash of the
    finding, or of ``id_fields`` of it.
    """
    a = old.select(F.struct(*keys).alias("k"), F.struct(*old.columns).alias("old"))
    b = new.select(F.struct(*keys).alias("k2"), F.struct(*new.columns).alias("new"))
    side = a.join(b, F.col("k").eqNullSafe(F.col("k2")), "full")
    o, n = F.col("old"), F.col("new")
    hits = F.flatten(F.array(*(r.hits(o, n) for r in rules)))
    flat = side.select(F.coalesce("k", "k2").alias("k"), F.explode(hits).alias("h")).select(*(F.col(f"k.{c}").alias(c) for c in keys), "h.change", "h.severity", "h.detail")
    fields = id_fields or [*keys, "change", "severity", "detail"]
    return flat.select("*", severity_rank(F.col("severity")).alias("severity_rank"), stable_id(**{c: F.col(c).cast("string") for c in fields}).alias("id"))


def table_counts(findings: DataFrame, by: list[str]) -> DataFrame:
    """Findings per severity and the highest severity, per group."""
    return findings.groupBy(*by).agg(
        F.count_if(F.col("severity") == "MAJOR").alias("major"), F.count_if(F.col("severity") == "MINOR").alias("minor"), F.count_if(F.col("severity") == "PATCH").alias("patch"),
        F.max("severity_rank").alias("highest"),
    )


#: Rules of the diff families.
SCHEMA_RULES = [
    Rule("FIELD_REMOVED", "MAJOR", REMOVED),
    Rule("FIELD_ADDED", "MAJOR", lambda o, n: o.isNull() & n["required"], lambda o, n: F.lit("required")),
    Rule("FIELD_ADDED", "MINOR", lambda o, n: o.isNull() & ~n["required"], lambda o, n: F.lit("optional")),
    Rule("TYPE_CHANGED", "MAJOR", differs("type"), moved("type")),
]
SURFACE_RULES = [
    Rule("API_REMOVAL", "MAJOR", REMOVED),
    Rule("API_ADDITION", "MINOR", ADDED),
    Rule("AUTH_TIGHTENING", "MAJOR", lambda o, n: both(o, n) & ~o["auth"] & n["auth"]),
]
_listed = lambda a: F.array_join(F.array_sort(a), ", ")
_none = lambda: F.array().cast("array<string>")
_list = lambda c: F.coalesce(c, _none())
_names = lambda m: F.coalesce(F.map_keys(m), _none())
_new_required = lambda o, n: F.array_except(_list(n["required"]), _list(o["required"]))
_new_optional = lambda o, n: F.array_except(F.array_except(_names(n["request"]), _names(o["request"])), _new_required(o, n))
_gone_status = lambda o, n: F.array_except(_names(o["responses"]), _names(n["responses"]))


def _changed_values(field: str) -> Callable[[Column, Column], Column]:
    """Keys of a map on both sides whose values differ, in order."""
    return lambda o, n: F.array_sort(
        F.filter(F.array_intersect(_names(o[field]), _names(n[field])), lambda k: ~F.try_element_at(o[field], k).eqNullSafe(F.try_element_at(n[field], k)))
    )


#: Endpoints by key: required (names), request (name -> type), responses (status -> schema as JSON), auth_type, auth_required.
API_RULES = [
    Rule("API_REMOVAL", "MAJOR", REMOVED),
    Rule("API_ADDITION", "MINOR", ADDED),
    Rule("REQUIRED_FIELD_ADDED", "MAJOR", lambda o, n: both(o, n) & (F.size(_new_required(o, n)) > 0), lambda o, n: _listed(_new_required(o, n))),
    Rule("API_REQUEST_EXPANSION", "MINOR", lambda o, n: both(o, n) & (F.size(_new_optional(o, n)) > 0), lambda o, n: _listed(_new_optional(o, n))),
    Rule("FIELD_TYPE_CHANGED", "MAJOR", both, _changed_values("request"), each=True),
    Rule("STATUS_REMOVED", "MAJOR", lambda o, n: both(o, n) & (F.size(_gone_status(o, n)) > 0), lambda o, n: _listed(_gone_status(o, n))),
    Rule("RESPONSE_CHANGED", "MAJOR", both, _changed_values("responses"), each=True),
    Rule(
        "AUTH_TIGHTENING", "MAJOR",
        lambda o, n: both(o, n) & (((o["auth_type"] == "Public") & (n["auth_type"] != "Public")) | (~o["auth_required"] & n["auth_required"])),
        lambda o, n: F.concat(o["auth_type"], F.lit(" -> "), n["auth_type"]),
    ),
]
#: Endpoints of one operation id that is unique on both sides: method, path, params (names in the path).
MOVE_RULES = [
    Rule("METHOD_CHANGED", "MAJOR", differs("method"), moved("method")),
    Rule("PATH_CHANGED", "MAJOR", differs("path"), moved("path")),
    Rule("PATH_PARAMETER_REMOVED", "MAJOR", lambda o, n: both(o, n) & (o["path"] != n["path"]) & (F.size(F.array_except(o["params"], n["params"])) > 0), lambda o, n: _listed(F.array_except(o["params"], n["params"]))),
]
#: Fields of entities on both sides: type, required, default, enum_values, primary_key, indexed.
_bare = lambda n: n["required"] & (F.coalesce(n["default"], F.lit("")) == "")
_flag = lambda f: lambda o, n: both(o, n) & (F.coalesce(o[f], F.lit(False)) != F.coalesce(n[f], F.lit(False)))
_gone_values = lambda o, n: F.array_except(_list(o["enum_values"]), _list(n["enum_values"]))
MODEL_RULES = [
    Rule("FIELD_REMOVED", "MAJOR", REMOVED),
    Rule("REQUIRED_FIELD_ADDED_NO_DEFAULT", "MAJOR", lambda o, n: o.isNull() & F.coalesce(_bare(n), F.lit(False))),
    Rule("OPTIONAL_FIELD_ADDED", "MINOR", lambda o, n: o.isNull() & ~F.coalesce(_bare(n), F.lit(False))),
    Rule("TYPE_CHANGED", "MAJOR", differs("type"), moved("type")),
    Rule("ENUM_VALUE_REMOVED", "MAJOR", lambda o, n: both(o, n) & (F.size(_gone_values(o, n)) > 0), lambda o, n: _listed(_gone_values(o, n))),
    Rule("PRIMARY_KEY_CHANGED", "MAJOR", _flag("primary_key")),
    Rule("DEFAULT_VALUE_CHANGED", "MINOR", differs("default"), moved("default")),
    Rule("INDEX_CHANGED", "MINOR", _flag("indexed")),
]
#: Contracts by method and path: body (has_body, fields), query (name -> required).
CONTRACT_CHANGES = [
    Rule("ROUTE_REMOVED", "MAJOR", REMOVED),
    Rule("BODY_SCHEMA_REMOVED", "MAJOR", lambda o, n: both(o, n) & o["has_body"] & ~n["has_body"]),
    Rule("BODY_FIELD_REMOVED", "MAJOR", lambda o, n: both(o, n) & o["has_body"] & n["has_body"], lambda o, n: F.array_sort(F.array_except(_list(o["fields"]), _list(n["fields"]))), each=True),
    Rule(
        "QUERY_PARAM_REQUIRED", "MAJOR", both,
        lambda o, n: F.array_sort(F.filter(F.array_intersect(_names(o["query"]), _names(n["query"])), lambda k: ~F.try_element_at(o["query"], k) & F.try_element_at(n["query"], k))), each=True,
    ),
]


def unique_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs once; null keys are none."""
    single = rows.where(" and ".join(f"`{k}` is not null" for k in keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*rows.columns)).alias("_r"))
    return single.where("_n = 1").select("_r.*")


def surface_findings(old: DataFrame, new: DataFrame, scope: list[str]) -> DataFrame:
    """(scope..., endpoint, change, severity, detail): every rule of API surfaces.

    Endpoints: scope columns, method, path, operation_id, params and what
    API_RULES read.  Moves are told by operation ids that occur once on each
    side; their findings stand at the new endpoint.
    """
    key = F.concat_ws(" ", F.upper("method"), F.col("path"))
    found = snapshot_diff(old.withColumn("endpoint", key), new.withColumn("endpoint", key), [*scope, "endpoint"], API_RULES)
    by = [*scope, "operation_id"]
    a, b = unique_keys(old, by).withColumn("endpoint", key), unique_keys(new, by).withColumn("endpoint", key)
    shared = b.select(*by, F.col("endpoint").alias("_to"))
    moves = snapshot_diff(a.join(shared, by, "left_semi"), b.join(a.select(*by), by, "left_semi"), by, MOVE_RULES).join(shared, by)
    cols = [*scope, "endpoint", "change", "severity", "detail"]
    return found.select(*cols).unionByName(moves.withColumnRenamed("_to", "endpoint").select(*cols)).distinct()


def schema_findings(old: DataFrame, new: DataFrame, scope: list[str]) -> DataFrame:
    """(scope..., entity, field, change, severity, detail): entities removed, and field by field for entities on both sides.

    An entity added, and a change of ``required`` alone, are no findings.
    """
    by = [*scope, "entity"]
    gone = old.select(*by).distinct().join(new.select(*by).distinct(), by, "left_anti")
    removed = gone.select(*by, F.lit("").alias("field"), F.lit("ENTITY_REMOVED").alias("change"), F.lit("MAJOR").alias("severity"), F.lit("").alias("detail"))
    kept = old.select(*by).distinct().join(new.select(*by).distinct(), by, "left_semi")
    found = snapshot_diff(old.join(kept, by, "left_semi"), new.join(kept, by, "left_semi"), [*by, "field"], MODEL_RULES)
    return removed.unionByName(found.select(*removed.columns))


def chain_findings(old: DataFrame, new: DataFrame, scope: list[str]) -> DataFrame:
    """(scope..., change, middleware, severity) of middleware chains, order-aware.

    ``chain``: array of (name, config).  A chain or a middleware that is gone, a
    changed configuration, and a changed order of (name, type), which is as
    grave as the gravest type that moved; types grade by their names.
    """
    a = old.select(*scope, F.col("chain").alias("a"))
    b = new.select(*scope, F.col("chain").alias("b"), F.lit(True).alias("there"))
    side = a.join(b, scope, "left")
    names = lambda c: F.transform(c, lambda x: x["name"])
    grade = lambda name: middleware_severity(middleware_type(name))
    finding = lambda change, name, severity: F.struct(F.lit(change).alias("change"), name.alias("middleware"), severity.alias("severity"))
    x, y = names(F.col("a")), names(F.col("b"))
    removed = F.transform(F.array_except(x, y), lambda n: finding("MIDDLEWARE_REMOVED", n, grade(n)))
    config = lambda c, n: F.element_at(F.filter(c, lambda e: e["name"] == n), -1)["config"]
    changed = F.transform(
        F.filter(F.array_intersect(x, y), lambda n: ~config(F.col("a"), n).eqNullSafe(config(F.col("b"), n))), lambda n: finding("MIDDLEWARE_CONFIG_CHANGED", n, grade(n))
    )
    gone_places = F.filter(F.array_intersect(x, y), lambda n: F.array_position(x, n) != F.array_position(y, n))
    gravest = F.array_max(F.transform(gone_places, lambda n: severity_rank(grade(n))))
    order = F.when(x != y, F.array(finding("MIDDLEWARE_ORDER_CHANGED", F.lit(""), F.coalesce(severity_name(gravest), F.lit("MINOR"))))).otherwise(F.array_except(removed, removed))
    found = F.when(F.col("there").isNull(), F.array(finding("CHAIN_REMOVED", F.lit(""), F.lit("MAJOR")))).otherwise(F.concat(removed, order, changed))
    return side.select(*scope, F.explode(found).alias("f")).select(*scope, "f.*")


def removed_names(old: DataFrame, new: DataFrame, keys: list[str], change: str, severity: str = "MAJOR") -> DataFrame:
    """(keys..., change, severity) of names that are no longer there."""
    return old.select(*keys).distinct().join(new.select(*keys).distinct(), keys, "left_anti").select(*keys, F.lit(change).alias("change"), F.lit(severity).alias("severity"))


#: Orders of each family of findings: columns after the severity or score, which falls.
FINDING_ORDERS = {
    "api": ("severity", ["endpoint", "change", "id"]), "schema": ("severity", ["entity", "field", "change", "id"]),
    "semantic": ("score", ["name", "id"]), "hash": ("severity", ["id"]),
}


def finding_order(family: str) -> list[Column]:
    first, rest = FINDING_ORDERS[family]
    lead = severity_rank(F.col(first)) if first == "severity" else F.col(first)
    return [lead.desc(), *map(F.col, rest)]


def name_order(name: str = "name", *rest: str) -> list[Column]:
    """By name whatever its case, then by its spelling, then by the other columns."""
    return [F.lower(name), F.col(name), *map(F.col, rest)]


def summary_totals(findings: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """(by..., total, major, minor, patch, risk): counts and the sum of scores to three places."""
    of = lambda s: F.count_if(F.col("severity") == s)
    return findings.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), of("MAJOR").alias("major"), of("MINOR").alias("minor"), of("PATCH").alias("patch"), F.round(F.sum(score), 3).alias("risk"))


HASH_RULES = [
    Rule("added", "MINOR", ADDED), Rule("deleted", "MAJOR", REMOVED),
    Rule("modified", "MAJOR", lambda o, n: both(o, n) & F.coalesce(o["hash"] != n["hash"], F.lit(False))),
]

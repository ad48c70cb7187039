"""Joins, windows and aggregates that the diffs, graphs and reports are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.words import symbol_leaf


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key in a defined order; aggregated map-side, so a key of very many rows is no hot group."""
    rank = F.struct(*(c.alias(f"_o{i}") for i, c in enumerate(order)))
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_r"))
    return best.select(*keys, "_r.*")


def numbered_ids(df: DataFrame, base: str, order: list[Column], out: str) -> DataFrame:
    """``out``: the base id, from its second occurrence on with its number as suffix."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(*order))
    return df.withColumn(out, F.when(n == 1, F.col(base)).otherwise(F.concat_ws("_", F.col(base), n.cast("string"))))


def resolve_candidates(requests: DataFrame, targets: DataFrame, request: str, suffixes: list[str]) -> DataFrame:
    """``resolved``: the first of ``request`` + suffix that is among ``targets.path``; null where none is.

    Candidates are exploded with their place and equi-joined; the least place wins.
    """
    cand = requests.select(request).distinct().select(request, F.posexplode(F.array(*(F.concat(F.col(request), F.lit(s)) for s in suffixes))).alias("pos", "cand"))
    hit = cand.join(targets.select(F.col("path").alias("cand")).distinct(), "cand").groupBy(request).agg(F.min_by("cand", "pos").alias("resolved"))
    return requests.join(hit, request, "left")


def carry_forward(df: DataFrame, group: str, order: list[Column], value: str, out: str) -> DataFrame:
    """``out``: the last non-null ``value`` up to each row."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def previous(df: DataFrame, group: list[str], order: list[Column], value: str, out: str) -> DataFrame:
    return df.withColumn(out, F.lag(value).over(Window.partitionBy(*group).orderBy(*order)))


def contained_terms(texts: DataFrame, terms: DataFrame, key: str, text: str, term: str) -> DataFrame:
    """(key, term): distinct terms that occur as whole words of a text.

    Containment is an equi-join on the text's words, never a scan of all pairs.
    """
    words = texts.select(key, F.explode(F.array_distinct(F.split(F.coalesce(F.col(text), F.lit("")), r"[^A-Za-z0-9_]+"))).alias(term)).where(F.col(term) != "")
    return words.join(terms.select(term).distinct(), term).select(key, term)


def missing_references(fact: DataFrame, fact_key: str, dim: DataFrame, dim_key: str, rule: str) -> DataFrame:
    """(rule, key, rows): keys of ``fact`` that ``dim`` lacks; null keys are missing."""
    d = dim.select(F.col(dim_key).alias("_d")).distinct()
    return (
        fact.join(d, F.col(fact_key) == F.col("_d"), "left_anti").groupBy(F.col(fact_key).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(rule).alias("rule"), "key", "rows")
    )


def risk_score(major: Column, minor: Column, patch: Column, api: Column, schema_changed: Column, fanout: Column, auth: Column) -> Column:
    """7 a major, 3 a minor, 1 a patch finding, plus bounded terms of reach."""
    return (
        major * 7 + minor * 3 + patch + F.least(F.lit(20), api) + F.when(schema_changed, 4).otherwise(0) + F.least(F.lit(12), F.floor(fanout / 10)) + F.least(F.lit(12), F.floor(auth / 5))
    ).cast("long")


def infra_risk(major: Column, minor: Column, patch: Column, critical: Column) -> Column:
    high = (major >= 2) | ((major >= 1) & critical)
    medium = (major >= 1) | (minor >= 2) | ((minor >= 1) & (patch >= 2)) | (patch >= 4)
    return F.when(high, "HIGH").when(medium, "MEDIUM").otherwise("LOW")


def attach_modules(files: DataFrame, modules: DataFrame, path: str = "path", default: str = "unknown") -> DataFrame:
    """``module`` of each file; ``modules`` has name and files (array).  Of several modules the least; ``default`` where none lists the file."""
    listed = modules.select("name", F.explode("files").alias("_f")).groupBy(F.replace("_f", F.lit("\\"), F.lit("/")).alias("_f")).agg(F.min("name").alias("module"))
    return files.join(listed, F.replace(F.col(path), F.lit("\\"), F.lit("/")) == F.col("_f"), "left").withColumn("module", F.coalesce("module", F.lit(default))).drop("_f")


def known_nodes(refs: DataFrame, nodes: DataFrame, ref: str) -> DataFrame:
    """``node`` of each reference: the reference itself, its head, its leaf or its owner, the first that is a node; '' where none is.

    The candidates are exploded with their place and equi-joined once.
    """
    token = F.trim(F.coalesce(F.col(ref), F.lit("")))
    parts = F.filter(F.split(token, r"\."), lambda p: p != "")
    head = F.when(F.contains(token, F.lit(".")), F.trim(F.substring_index(token, ".", 1)))
    tried = F.array(token, head, symbol_leaf(token), F.when(F.size(parts) >= 2, F.get(parts, F.size(parts) - 2)))
    cand = refs.select(ref).distinct().select(ref, F.posexplode(tried).alias("pos", "cand")).where("cand <> ''")
    hit = cand.join(nodes.select(F.col("node").alias("cand")).distinct(), "cand").groupBy(F.col(ref).alias("_r")).agg(F.min_by("cand", "pos").alias("node"))
    return refs.join(hit, F.col(ref) == F.col("_r"), "left").drop("_r").withColumn("node", F.coalesce("node", F.lit("")))


def containing(bases: DataFrame, names: DataFrame, base: str, name: str, gram: int = 3) -> DataFrame:
    """(base, name): names that contain a base, whatever its case, as the seeds of a change.

    Pairs are found by an equi-join of a base's first signs with all runs of as
    many signs of the names (three, or the whole of a shorter base) and then
    looked at; no pair without a common run comes up.
    """
    b = bases.select(base).distinct().where(F.col(base) != "").withColumn("_g", F.lower(F.substring(base, 1, gram)))
    low = F.lower(name)
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(gram)), lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - k + 1, F.lit(1))), lambda i: F.substring(low, i, k))))
    n = names.select(name).distinct().where(F.col(name) != "").select(name, F.explode(F.array_distinct(runs)).alias("_g"))
    return b.join(n, "_g").where(F.contains(F.lower(name), F.lower(base))).select(base, name).distinct()


def unmounted(endpoints: DataFrame, mounts: DataFrame, scope: str, path: str, prefix: str) -> DataFrame:
    """Endpoints that lie under no mount of their scope, in scopes that mount anything but the root.

    A path lies under a mount that it equals or that its beginning up to a slash
    equals: a path's beginnings are exploded, so the anti join is an equi-join.
    """
    own = mounts.where(~F.trim(prefix).isin("", "/") & F.col(prefix).isNotNull())
    under = own.select(F.col(scope).alias("_s"), F.explode(F.array(F.struct(F.col(prefix).alias("p"), F.lit(True).alias("whole")), F.struct(F.rtrim(prefix, F.lit("/")).alias("p"), F.lit(False).alias("whole")))).alias("m")).select("_s", "m.*").distinct()
    slashes = F.filter(F.sequence(F.lit(1), F.greatest(F.length(path), F.lit(1))), lambda i: F.substring(F.col(path), i, 1) == "/")
    starts = F.concat(F.array(F.struct(F.col(path).alias("p"), F.lit(True).alias("whole"))), F.transform(slashes, lambda i: F.struct(F.substring(F.col(path), F.lit(1), i - 1).alias("p"), F.lit(False).alias("whole"))))
    scoped = endpoints.join(own.select(F.col(scope).alias("_s")).distinct(), F.col(scope) == F.col("_s"), "left_semi")
    tried = scoped.select(scope, path, F.explode(starts).alias("t")).select(scope, path, "t.*")
    hit = tried.join(under, (F.col(scope) == F.col("_s")) & (tried["p"] == under["p"]) & (tried["whole"] == under["whole"]), "left_semi").select(F.col(scope).alias("_s"), F.col(path).alias("_p")).distinct()
    return scoped.join(hit, (F.col(scope) == F.col("_s")) & (F.col(path) == F.col("_p")), "left_anti")


def cardinalities(fields: DataFrame, scope: list[str]) -> DataFrame:
    """(scope..., type, from_model, to_model), distinct: how models refer to each other.

    ``fields``: scope columns, model, type (``X``, ``X?`` or ``X[]``).  A field
    whose base type is a model is a relation; arrays on this side and on the
    way back decide its kind.
    """
    bare = fields.select(*scope, "model", F.regexp_replace("type", r"[\[\]?]", "").alias("base"), F.col("type").endswith("[]").alias("many"))
    models = bare.select(*scope, F.col("model").alias("base")).distinct()
    ref = bare.join(models, [*scope, "base"], "left_semi")
    back = ref.groupBy(*scope, F.col("base").alias("_m"), F.col("model").alias("_b")).agg(F.bool_or("many").alias("_back"))
    renamed = back.select(*(F.col(c).alias("_" + c) for c in scope), "_m", "_b", "_back")
    cond = (F.col("model") == F.col("_m")) & (F.col("base") == F.col("_b"))
    for c in scope:
        cond = cond & F.col(c).eqNullSafe(F.col("_" + c))
    both = ref.join(renamed, cond, "left").withColumn("back", F.coalesce("_back", F.lit(False)))
    one_way = F.col("many") != F.col("back")
    kind = F.when(one_way, "one-to-many").when(F.col("many"), "many-to-many").otherwise("one-to-one")
    first = F.when(one_way, F.col("base")).otherwise(F.least("model", "base"))
    second = F.when(one_way, F.col("model")).otherwise(F.greatest("model", "base"))
    return both.select(*scope, kind.alias("type"), first.alias("from_model"), second.alias("to_model")).distinct()

"""Route resolution: mount contexts, operation ids, auth labels, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.labels import route_path, versioned_hash
from skein.functions.verdicts import auth_label as auth_type
from skein.functions.words import operation_id, pascal, singular  # noqa: F401 - part of this module's surface
from skein.operators.hierarchy import router_chains

STRICT_DEPTH, LENIENT_DEPTH = 10, 15

def mount_status(chains: DataFrame, max_depth: int = STRICT_DEPTH) -> DataFrame:
    """(repository, status, error): strict mode fails a repository with a mount cycle or a chain deeper than ``max_depth``."""
    g = chains.groupBy("repository").agg(F.min("depth").alias("lo"), F.max("depth").alias("hi"))
    error = F.when(F.col("lo") < 0, "Router mount cycle detected").when(F.col("hi") > max_depth, "Router mount depth exceeded")
    return g.select("repository", F.when(error.isNull(), "OK").otherwise("FAILED").alias("status"), F.coalesce(error, F.lit("")).alias("error"))


def resolve_routes(candidates: DataFrame, mounts: DataFrame, mode: str = "lenient") -> DataFrame:
    """Route candidates under every mounted context of their router.

    ``candidates``: repository, source_file, router_symbol, method, path,
    line_start, middleware_tokens.  Output adds full_path, normalized_key,
    operation_id (numbered from the second occurrence), resolved_auth_type and
    endpoint_hash.  Routers that nothing mounts keep their own paths in lenient
    mode; strict mode leaves out repositories whose mounts fail.
    """
    chains = router_chains(mounts)
    limit = STRICT_DEPTH if mode == "strict" else LENIENT_DEPTH
    ok = chains.where((F.col("depth") >= 0) & (F.col("depth") <= limit)).select("repository", F.col("file_path").alias("source_file"), "router_symbol", "full_path")
    j = candidates.join(ok, ["repository", "source_file", "router_symbol"], "left")
    if mode == "strict":
        j = j.join(mount_status(chains).where("status = 'FAILED'"), "repository", "left_anti")
    return with_keys(j.withColumn("full_path", F.coalesce("full_path", F.lit("/"))))


def with_keys(routes: DataFrame) -> DataFrame:
    """Keys of routes that have a full_path prefix."""
    from skein.operators.relational import numbered_ids

    full = route_path(F.concat(F.col("full_path"), F.lit("/"), F.col("path")))
    r = routes.withColumn("normalized_path", full).withColumn("normalized_key", F.concat_ws(" ", F.upper("method"), full))
    r = r.withColumn("_op", F.concat_ws(" ", "repository", operation_id(F.col("method"), full)))
    r = numbered_ids(r, "_op", [F.col("normalized_key"), F.col("source_file"), F.col("line_start")], "_id")
    return r.withColumn("operation_id", F.substring_index("_id", " ", -1)).withColumn("resolved_auth_type", auth_type(F.col("middleware_tokens"))).withColumn("endpoint_hash", versioned_hash(F.upper("method"), full)).drop("_op", "_id")


def duplicate_routes(routes: DataFrame) -> DataFrame:
    """(repository, normalized_key, n): keys that more than one route claims."""
    return routes.groupBy("repository", "normalized_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def valid_path(path: Column) -> Column:
    """Every segment is a plain word or one braced parameter."""
    segs = F.filter(F.split(path, "/"), lambda s: s != "")
    return path.startswith("/") & ~path.contains("//") & F.forall(segs, lambda s: s.rlike(r"^(\{[A-Za-z_]\w*\}|[\w.~*-]+)$"))


def coverage(routes: DataFrame, resolved: Column) -> DataFrame:
    """(repository, mounted_route_count, resolved_route_count, coverage_ratio, coverage_percent)."""
    g = routes.groupBy("repository").agg(F.count(F.lit(1)).alias("mounted_route_count"), F.count_if(resolved).alias("resolved_route_count"))
    ratio = F.when(F.col("mounted_route_count") > 0, F.col("resolved_route_count") / F.col("mounted_route_count")).otherwise(1.0)
    return g.withColumn("coverage_ratio", F.round(ratio, 2)).withColumn("coverage_percent", F.floor(ratio * 100).cast("int"))

"""Extraction, evidence, route and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions.paths import canonical_path
from skein.operators import evidence, extract, routes, semantic
from skein.operators.hierarchy import router_chains
from skein.plans.common import table
from skein.plans.pipeline_queries import _P5
from skein.storage import fresh_path, materialize
from skein.streaming import envelopes


def _files(spark, d):
    docs = table(spark, d, "documents").where("source = 'source_code' and file_path is not null")
    return docs.select("doc_id", "repository", canonical_path(F.col("file_path")).alias("path"), "text")


def _facts(spark, d):
    return materialize(extract.file_facts(_files(spark, d), ["doc_id", "repository", "path"], path="path"), "facts")


def file_facts(spark, d):
    return extract.file_facts(_files(spark, d), ["doc_id"], path="path").groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("facts"))


def symbol_ids(spark, d):
    return extract.symbol_ids(_facts(spark, d), "path")


def module_groups(spark, d):
    return evidence.modules(_files(spark, d)).select("repository", "module", "n", "type")


def api_surface(spark, d):
    return evidence.api_surface(_facts(spark, d))


def import_edges(spark, d):
    return evidence.import_edges(_facts(spark, d), _files(spark, d))


def call_edges(spark, d):
    return evidence.call_edges(_facts(spark, d))


def layer_edges(spark, d):
    f = _facts(spark, d)
    return evidence.architecture(_files(spark, d), evidence.import_edges(f, _files(spark, d)))


def search_index(spark, d):
    return evidence.search_index(_facts(spark, d))


def tech_stack(spark, d):
    return evidence.tech_stack(_facts(spark, d))


def quality_warnings(spark, d):
    f = _facts(spark, d)
    return evidence.quality_warnings(evidence.api_surface(f), evidence.import_edges(f, _files(spark, d)))


def route_candidates(spark, d):
    """Extracted endpoints with their own middleware under their routers' mounts."""
    f = _facts(spark, d)
    chain = f.where("kind = 'middleware'").groupBy("repository", F.col("path").alias("source_file"), F.col("owner").alias("_route")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col("value").cast("int").alias("at"), "name"))), lambda x: x["name"]).alias("middleware_tokens")
    )
    c = f.where("kind = 'endpoint'").select(
        "repository", F.col("path").alias("source_file"), F.col("owner").alias("router_symbol"), F.substring_index("name", " ", 1).alias("method"), F.substring_index("name", " ", -1).alias("path"),
        F.col("line").alias("line_start"), F.col("name").alias("_route"),
    )
    c = c.join(chain, ["repository", "source_file", "_route"], "left").drop("_route")
    r = routes.resolve_routes(c, table(spark, d, "router_mounts"))
    return r.select("repository", "source_file", "line_start", "normalized_key", "operation_id", "resolved_auth_type", "endpoint_hash")


def mount_status(spark, d):
    return routes.mount_status(router_chains(table(spark, d, "router_mounts")))


def _stream(spark, d):
    """The envelopes as a stream, whether the table is one file or a folder of files."""
    path = f"{d}/event_envelopes.parquet"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
    where, glob = (path, "*.parquet") if folder else (d, "event_envelopes.parquet")
    return envelopes.envelope_stream(spark, where, glob, table(spark, d, "event_envelopes").schema)


def event_stream(spark, d):
    """Accepted and rejected envelopes of a finished stream, counted by reason and type."""
    gated = envelopes.gate(_stream(spark, d))
    ok, bad, state = (fresh_path(spark, x) for x in ("accepted", "rejected", "stream"))
    envelopes.route(gated, ok, bad, state).awaitTermination()
    both = spark.read.option("recursiveFileLookup", "true").parquet(ok, bad)
    return both.groupBy(F.coalesce("reason", F.lit("accepted")).alias("outcome"), "eventType").agg(F.count(F.lit(1)).alias("events"))


def event_stream_unique(spark, d):
    """Distinct events of a stream by id, counted by type."""
    one = envelopes.unique_events(envelopes.gate(_stream(spark, d)).where("ok"), delay="30 days")
    out, state = fresh_path(spark, "unique"), fresh_path(spark, "stream")
    one.select("eventType").writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("eventType string").parquet(out).groupBy("eventType").agg(F.count(F.lit(1)).alias("events"))


def symbol_breaks(spark, d):
    """Recorded symbols of each repository before and after the middle of 2025; a class's edges lead to the functions of its record, functions with a capital inside are public."""
    a = table(spark, d, "ast_records").select("doc_id", F.coalesce("repository", F.lit("")).alias("path"), F.coalesce(F.col("analyzed_at") < F.lit("2025-07-01").cast("timestamp_ntz"), F.lit(False)).alias("early"), F.explode("symbols").alias("s")).where("s.name is not null")
    shown = F.when((F.col("s.kind") == "class") | (F.length("s.symbol_id") % 2 == 1) | F.col("s.symbol_id").rlike("[0-7]$"), "public").otherwise("private")

    def side(rows):
        key = ["path", F.col("s.name").alias("name"), F.col("s.kind").alias("kind")]
        return rows.groupBy(*key).agg(F.min("s.symbol_id").alias("signature"), F.max(shown).alias("visibility"))

    top, inner = a.where("s.kind = 'class'"), a.where("s.kind = 'function'")
    name = lambda x: F.concat_ws(":", x["path"], x["s"]["name"])
    t, i = top.select("doc_id", name(top).alias("src")), inner.select("doc_id", name(inner).alias("dst"))
    edges = t.join(i, "doc_id").select("src", "dst")
    return semantic.symbol_breaks(side(a.where("early")), side(a.where("not early")), edges).select("path", "name", "kind", "change", "severity", "score")


def recorded_calls(spark, d):
    """Calls between analysed files: recorded functions are the definitions, names before a bracket in a text its calls."""
    none = [F.lit("").alias("owner"), F.lit("").alias("value"), F.lit(0).alias("line")]
    path = canonical_path(F.col("file_path")).alias("path")
    a = table(spark, d, "ast_records").select("repository", path, F.explode("symbols").alias("s")).where("s.kind = 'function'")
    defs = a.select("repository", "path", F.lit("function").alias("kind"), F.col("s.name").alias("name"), *none)
    t = table(spark, d, "documents").where("source = 'source_code'").select("repository", path, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\("), 1))).alias("name"))
    calls = t.select("repository", "path", F.lit("call").alias("kind"), "name", *none)
    return evidence.call_edges(defs.unionByName(calls).where("repository is not null and path is not null and name is not null"))


def type_hashes(spark, d):
    return semantic.type_hashes(_facts(spark, d))


QUERIES = {
    f.__name__: f
    for f in (symbol_breaks, recorded_calls, type_hashes, file_facts, symbol_ids, module_groups, api_surface, import_edges, call_edges, layer_edges, search_index, tech_stack, quality_warnings, route_candidates, mount_status, event_stream, event_stream_unique)
}

_PATH = r"regexp_replace(regexp_replace(trim(file_path), '[\\/]+', '/', 'g'), '^(\./)+', '')"

SQL = {
    "recorded_calls": f"""with f as (select distinct repository, {_PATH} as path, s.name as leaf from (select repository, file_path, unnest(symbols) as s from ast_records) where s.kind = 'function' and s.name is not null and repository is not null and file_path is not null),
c as (select distinct repository, {_PATH} as path, leaf from (select repository, file_path, unnest(regexp_extract_all(text, '([A-Za-z_][A-Za-z0-9_]*)\\(', 1)) as leaf from documents where source = 'source_code') where repository is not null and file_path is not null),
u as (select repository, leaf, min(path) as path from f group by all having count(distinct path) = 1)
select distinct c.repository, c.path || ':module' as src, coalesce(f.path, u.path) || ':' || c.leaf as dst from c left join f on f.repository = c.repository and f.path = c.path and f.leaf = c.leaf
left join u on u.repository = c.repository and u.leaf = c.leaf where coalesce(f.path, u.path) is not null""",
    "symbol_breaks": """with a as (select doc_id, coalesce(repository, '') as path, coalesce(analyzed_at < timestamp '2025-07-01', false) as early, unnest(symbols) as s from ast_records),
b as (select *, case when s.kind = 'class' or length(s.symbol_id) % 2 = 1 or regexp_matches(s.symbol_id, '[0-7]$') then 'public' else 'private' end as vis from a where s.name is not null),
f as (select path, early, s.name as name, s.kind as kind, min(s.symbol_id) as g, max(vis) as vis from b group by all),
d as (select x.path || ':' || x.s.name as sym, count(distinct y.path || ':' || y.s.name) as deg from b x join b y using (doc_id) where x.s.kind = 'class' and y.s.kind = 'function' group by 1),
o as (select * from f where early), n as (select * from f where not early),
h as (select o.path, o.name, o.kind, 'SYMBOL_REMOVED' as change, o.vis = 'public' as pub from o where not exists (select 1 from n where o.path = n.path and o.name = n.name and o.kind is not distinct from n.kind)
 union all select o.path, o.name, o.kind, 'SIGNATURE_CHANGED', o.vis = 'public' from o join n on o.path = n.path and o.name = n.name and o.kind is not distinct from n.kind where o.g is distinct from n.g
 union all select o.path, o.name, o.kind, 'VISIBILITY_DOWNGRADED', true from o join n on o.path = n.path and o.name = n.name and o.kind is not distinct from n.kind where o.vis = 'public' and n.vis <> 'public'),
z as (select h.*, 6.0::double + 0.5 * coalesce(deg, 0) + case when pub then 2 else 0 end as score from h left join d on d.sym = h.path || ':' || h.name)
select path, name, kind, change, case when score >= 8 then 'MAJOR' when score >= 4 then 'MINOR' else 'PATCH' end as severity, score from z""",
    "mount_status": _P5
    + """, a as (select repo, depth from ch union all select repo, -1 from bad)
select repo as repository, case when min(depth) < 0 or max(depth) > 10 then 'FAILED' else 'OK' end as status,
 case when min(depth) < 0 then 'Router mount cycle detected' when max(depth) > 10 then 'Router mount depth exceeded' else '' end as error from a group by repo""",
    "event_stream": """select case when eventId is null or length(trim(eventId)) < 8 or correlationId is null or length(trim(correlationId)) < 8 then 'id' when eventVersion <> 1 then 'version' else 'accepted' end as outcome, eventType, count(*) as events from event_envelopes group by all""",
}

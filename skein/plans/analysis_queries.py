"""Graph, diff, label and join operators over the registered tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import labels, paths
from skein.operators import diff, graph, hierarchy, relational, semantic, snapshots
from skein.plans.common import table
from skein.storage import materialize


def mount_graph(spark, d):
    """(src, dst): every mount between two routers, each named by repository, file and symbol."""
    links = hierarchy.router_links(table(spark, d, "router_mounts"))
    name = lambda c: F.replace(c, F.lit(hierarchy.SEP), F.lit(":"))
    return links.edges.select(name("parent").alias("src"), name("child").alias("dst")).distinct(), links.nodes.select(name("node").alias("node"))


_ROUTER = "repository || ':' || regexp_replace(regexp_replace(trim({0}.file_path), '[\\\\/]+', '/', 'g'), '^(\\./)+', '') || ':' || trim(coalesce({0}.router_symbol, ''))"
MOUNTS = f"""
raw as (select {_ROUTER.format("parent")} as p, {_ROUTER.format("child")} as c from router_mounts where repository is not null),
e as (select distinct p as src, c as dst from raw where p is not null and c is not null),
v as (select distinct node from (select p as node from raw union all select c from raw) where node is not null)"""
_WITH = "with" + MOUNTS
_RECURSIVE = "with recursive" + MOUNTS


def _graph(spark, d):
    edges, nodes = mount_graph(spark, d)
    return materialize(edges, "graph-edges"), materialize(nodes, "graph-nodes")


def _tops(nodes, edges):
    return nodes.join(edges.select(F.col("dst").alias("node")), "node", "left_anti")


def degree_metrics(spark, d):
    edges, nodes = mount_graph(spark, d)
    return graph.degree_metrics(nodes, edges)


def adjacency_refs(spark, d):
    return graph.references(mount_graph(spark, d)[0])


def reachability(spark, d):
    """What each router without parent reaches."""
    edges, nodes = _graph(spark, d)
    return graph.reachable(edges, _tops(nodes, edges))


def entry_dead_nodes(spark, d):
    """Entry nodes have no incoming edge; dead nodes can't be reached from an entry."""
    edges, nodes = _graph(spark, d)
    entry = _tops(nodes, edges)
    live = graph.reachable(edges, entry).select("node").distinct().withColumn("live", F.lit(True))
    mark = entry.withColumn("entry", F.lit(True))
    return nodes.join(mark, "node", "left").join(live, "node", "left").select("node", F.coalesce("entry", F.lit(False)).alias("entry"), F.col("live").isNull().alias("dead"))


def simple_paths(spark, d):
    """Paths of at most six mounts from a router without parent to one without child."""
    edges, nodes = _graph(spark, d)
    ends = nodes.join(edges.select(F.col("src").alias("node")), "node", "left_anti")
    return graph.simple_paths(edges, _tops(nodes, edges), ends).select(F.array_join("path", ">").alias("path"))


def scc(spark, d):
    edges, nodes = _graph(spark, d)
    return graph.components(edges, nodes).select("node", "component")


def longest_depth(spark, d):
    """Heights in the tree of regions, nations and customers."""
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    edges = n.select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst")).unionByName(
        c.select(F.concat(F.lit("n"), "c_nationkey").alias("src"), F.concat(F.lit("c"), "c_custkey").alias("dst"))
    )
    r = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"))
    nodes = r.unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    return graph.levels(edges, nodes)


def edge_classification(spark, d):
    """Mounts between directories: internal within one, external across."""
    folder = lambda c: F.regexp_extract(c, "^(.*)/[^/]*$", 1)
    e = mount_graph(spark, d)[0].select(folder("src").alias("a"), folder("dst").alias("b"))
    return e.groupBy("a", "b").agg(F.count(F.lit(1)).alias("edges")).select("a", "b", F.when(F.col("a") == F.col("b"), "internal").otherwise("external").alias("type"), "edges")


def hash_propagation(spark, d):
    """Routers above each one that more than one router mounts, as a change of it reaches them."""
    edges, nodes = _graph(spark, d)
    changed = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node")
    hit = semantic.dependents(changed, edges, F.col("node")).where(F.size("chain") > 0)
    return hit.select(F.col("symbol").alias("seed"), F.array_join("chain", ",").alias("chain"))


def impact_score(spark, d):
    """Blast radius and depth from each router without parent."""
    edges, nodes = _graph(spark, d)
    got = graph.reachable(edges, _tops(nodes, edges))
    return got.groupBy("seed").agg(F.count(F.lit(1)).alias("radius"), F.max("depth").alias("depth"), (F.lit(2) * F.count(F.lit(1)) + F.max("depth")).alias("score"))


def endpoint_normalise(spark, d):
    m = table(spark, d, "router_mounts").where("mount_path is not null").select("mount_path").distinct()
    p = labels.route_path(F.col("mount_path"))
    return m.select("mount_path", p.alias("path"), F.array_join(labels.path_params(p), ",").alias("params"), labels.versioned_hash(F.lit("GET"), p).alias("hash"))


_ROUTE = r"regexp_replace(regexp_replace(regexp_replace('/' || coalesce(trim({0}), ''), ':([A-Za-z_][A-Za-z0-9_]*)(\([^)]*\))?', '{{\1}}', 'g'), '/+', '/', 'g'), '(.)/$', '\1')"


def _surface(df):
    p = labels.route_path(F.col("mount_path"))
    return df.select("repository", p.alias("path"), F.coalesce(F.exists("middleware_tokens", lambda t: F.contains(F.lower(t), F.lit("auth"))), F.lit(False)).alias("auth"), F.col("child.router_symbol").alias("handler"), "mount_id", "observed_at", "middleware_tokens")


def api_surface_merge(spark, d):
    s = _surface(table(spark, d, "router_mounts"))
    return s.groupBy("repository", "path").agg(F.bool_or("auth").alias("auth"), F.min_by("handler", "mount_id").alias("handler"), F.count(F.lit(1)).alias("mounts"))


def operation_id_dedup(spark, d):
    p = labels.route_path(F.col("mount_path"))
    m = table(spark, d, "router_mounts").select("mount_id", F.concat_ws(":", "repository", F.regexp_replace(p, "[^A-Za-z0-9]+", "_")).alias("base"))
    return relational.numbered_ids(m, "base", [F.col("mount_id")], "operation_id").select("mount_id", "operation_id")


def priority_resolve(spark, d):
    """Import paths without extension resolve to the first file that exists."""
    m = table(spark, d, "router_mounts")
    files = m.select(paths.canonical_path(F.col("source_file")).alias("path")).distinct()
    req = m.select(F.regexp_replace(paths.canonical_path(F.col("child.file_path")), r"\.[a-z]+$", "").alias("request")).distinct()
    return relational.resolve_candidates(req, files, "request", [".js", ".ts", "/index.js", "/index.ts"])


def surface_diff(spark, d):
    """Surfaces before and after the middle of 2025."""
    s = _surface(table(spark, d, "router_mounts"))
    cut = F.lit("2025-07-01").cast("timestamp_ntz")
    side = lambda x: x.groupBy("repository", "path").agg(F.bool_or("auth").alias("auth"))
    found = diff.snapshot_diff(side(s.where(F.col("observed_at") < cut)), side(s.where(F.col("observed_at") >= cut)), ["repository", "path"], diff.SURFACE_RULES)
    return found.select("repository", "path", "change", "severity", "id")


def incremental_diff(spark, d):
    """Files of each repository's last snapshot against its first, counted by change."""
    files = materialize(snapshots.current_files(table(spark, d, "file_snapshots")), "files")
    ends = files.groupBy("repository").agg(F.min("snapshot_no").alias("first"), F.max("snapshot_no").alias("last"))
    both = files.join(ends, "repository").select("repository", "file_path", F.col("content_hash").alias("hash"), (F.col("snapshot_no") == F.col("first")).alias("is_first"), (F.col("snapshot_no") == F.col("last")).alias("is_last"))
    old, new = both.where("is_first").select("repository", "file_path", "hash"), both.where("is_last").select("repository", "file_path", "hash")
    rules = [*diff.HASH_RULES, diff.Rule("unchanged", "PATCH", lambda o, n: diff.both(o, n) & ~F.coalesce(o["hash"] != n["hash"], F.lit(False)))]
    found = diff.snapshot_diff(old, new, ["repository", "file_path"], rules)
    return found.groupBy("repository", "change").agg(F.count(F.lit(1)).alias("files"))


def previous_snapshot(spark, d):
    s = table(spark, d, "file_snapshots").select("repository", "snapshot_no").distinct()
    return relational.previous(s, ["repository"], [F.col("snapshot_no")], "snapshot_no", "baseline_no")


_FIELDS = ["runId", "projectId", "githubUrl", "branch", "commitSha", "refName", "refType", "triggerType", "isPreview", "newUser", "failedStage", "errorMessage", "retryCount"]


def _payload_fields(df):
    """(entity, field, type, required): fields that events fill, required where never null."""
    types = {f.name: f.dataType.simpleString() for f in df.schema["payload"].dataType.fields}
    counts = df.groupBy(F.lit("payload").alias("entity")).agg(F.count(F.lit(1)).alias("_n"), *(F.count(f"payload.{f}").alias(f) for f in _FIELDS))
    rows = F.array(*(F.struct(F.lit(f).alias("field"), labels.type_name(F.lit(types[f])).alias("type"), F.col(f).alias("filled")) for f in _FIELDS))
    return counts.select("entity", "_n", F.explode(rows).alias("x")).where("x.filled > 0").select("entity", "x.field", "x.type", (F.col("x.filled") == F.col("_n")).alias("required"))


def schema_diff(spark, d):
    """The payload schema of requests against that of failures."""
    e = table(spark, d, "event_envelopes")
    found = diff.snapshot_diff(_payload_fields(e.where("eventType = 'AnalysisRequested'")), _payload_fields(e.where("eventType = 'AnalysisFailed'")), ["entity", "field"], diff.SCHEMA_RULES)
    return found.select("entity", "field", "change", "severity", "detail", "id")


def _event_sets(spark, d):
    """Event types of each user and hour of the day, before and after the middle of the events."""
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    e = table(spark, d, "events").select("user_id", F.hour("ts").alias("hour"), "event_type", (F.col("ts") < cut).alias("early"))
    both = e.groupBy("user_id", "hour").agg(F.collect_set(F.when(F.col("early"), F.col("event_type"))).alias("a"), F.collect_set(F.when(~F.col("early"), F.col("event_type"))).alias("b"))
    return both.select("user_id", "hour", F.array_sort("a").alias("a"), F.array_sort("b").alias("b"))


def enum_removed(spark, d):
    """Event types of each user and hour that the second half of the events lacks."""
    return _event_sets(spark, d).select("user_id", "hour", F.array_join(F.array_except("a", "b"), ",").alias("removed")).where("removed <> ''")


def method_set_change(spark, d):
    return _event_sets(spark, d).where("a <> b").select("user_id", "hour", F.array_join("a", ",").alias("old_set"), F.array_join("b", ",").alias("new_set"))


def label_cascade(spark, d):
    f = table(spark, d, "documents").where("file_path is not null").select("file_path")
    return f.groupBy(labels.file_category(F.col("file_path")).alias("category"), labels.file_layer(F.col("file_path")).alias("layer")).agg(F.count(F.lit(1)).alias("files"))


def pattern_tags(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.explode(labels.schema_tags(F.col("text"))).alias("tag"))
    return t.groupBy("tag").agg(F.count(F.lit(1)).alias("files"), F.min("doc_id").alias("first_doc"))


def severity_rollup(spark, d):
    b = table(spark, d, "impact_reports").select("project_id", F.explode("breaking_changes").alias("b")).where("b is not null").select("project_id", F.col("b.severity").alias("severity"))
    b = b.withColumn("severity_rank", labels.severity_rank(F.col("severity")))
    return diff.table_counts(b, ["project_id"]).withColumn("highest", labels.severity_name(F.col("highest")))


def risk_score(spark, d):
    b = table(spark, d, "impact_reports")
    s = F.coalesce("breaking_changes", F.expr("cast(array() as " + b.schema["breaking_changes"].dataType.simpleString() + ")"))
    count = lambda v: F.size(F.filter(s, lambda x: F.coalesce(x["severity"] == v, F.lit(False))))
    pk = F.size(F.array_distinct(F.filter(F.coalesce("report.affected_packages", F.expr("cast(array() as array<string>)")), lambda x: x.isNotNull())))
    schema = F.coalesce(F.col("report.analysis_summary.breaking_changes_detected"), F.lit(False))
    score = relational.risk_score(count("MAJOR"), count("MINOR"), count("PATCH"), F.size(s), schema, pk, F.lit(0))
    return b.select("report_id", "ingested_at", score.alias("score"))


def infra_risk(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(
        F.count_if(F.col("value") > 250).alias("major"), F.count_if((F.col("value") > 150) & (F.col("value") <= 250)).alias("minor"), F.count_if((F.col("value") > 120) & (F.col("value") <= 150)).alias("patch"), F.bool_or(F.col("event_type") == "error").alias("critical")
    )
    return e.groupBy(relational.infra_risk(F.col("major"), F.col("minor"), F.col("patch"), F.col("critical")).alias("risk")).agg(F.count(F.lit(1)).alias("users"))


def top_findings(spark, d):
    """The hundred gravest findings in a total order."""
    b = table(spark, d, "impact_reports").select("report_id", F.posexplode("breaking_changes").alias("pos", "b"), "ingested_at").where("b is not null")
    return b.select("report_id", "pos", "ingested_at", F.col("b.severity").alias("severity")).orderBy(labels.severity_rank(F.col("severity")).desc(), "report_id", "pos", "ingested_at").limit(100)


def coverage(spark, d):
    """Orders with lines against all orders, by status."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    keys = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("hit", F.lit(1))
    g = o.join(keys, "o_orderkey", "left").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("total"), F.count("hit").alias("resolved"))
    return g.withColumn("percent", F.floor(F.col("resolved") * 100 / F.col("total")).cast("long"))


def integrity_violations(spark, d):
    docs, ast = table(spark, d, "documents").where("source = 'source_code'"), table(spark, d, "ast_records")
    li = table(spark, d, "lineitem")
    return (
        relational.missing_references(docs, "doc_id", ast, "doc_id", "document without record")
        .unionByName(relational.missing_references(li, "l_orderkey", table(spark, d, "orders"), "o_orderkey", "line without order"))
        .unionByName(relational.missing_references(table(spark, d, "documents"), "source", table(spark, d, "mix_targets"), "source", "source without target"))
    )


def containment_join(spark, d):
    """Packages named in texts, whole words only."""
    pk = table(spark, d, "impact_reports").select(F.explode("report.affected_packages").alias("term")).where("term is not null")
    got = relational.contained_terms(table(spark, d, "documents"), pk, "doc_id", "text", "term")
    return got.groupBy("term").agg(F.count(F.lit(1)).alias("documents"))


def first_wins_dedup(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return relational.first_wins(e, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")])


def carry_forward(spark, d):
    e = table(spark, d, "events").withColumn("mark", F.when(F.col("event_type") == "signup", F.col("value")))
    return relational.carry_forward(e, "user_id", [F.col("ts"), F.col("event_id")], "mark", "last_mark").select("event_id", "last_mark")


def symbol_min_line(spark, d):
    """The first line of each file that holds a recorded symbol's name as a word."""
    a = table(spark, d, "ast_records").select("doc_id", F.explode("symbols").alias("s")).select("doc_id", F.col("s.name").alias("name")).where("name is not null").distinct()
    t = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    w = t.select("doc_id", F.col("pos"), F.explode(F.array_distinct(F.split("line", r"[^A-Za-z0-9_]+"))).alias("name"))
    first = w.groupBy("doc_id", "name").agg((F.min("pos") + 1).alias("line"))
    return a.join(first, ["doc_id", "name"], "left").select("doc_id", "name", F.coalesce("line", F.lit(0)).cast("long").alias("line"))


def set_ops(spark, d):
    c = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("n"))
    s = table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("n"))
    tag = lambda x, t: x.select(F.lit(t).alias("op"), "n")
    return tag(c.exceptAll(s).distinct(), "left more often").unionByName(tag(c.intersect(s), "both")).unionByName(tag(c.union(s).distinct(), "any"))


def canonical_id(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", labels.stable_id(name=F.col("p_name"), brand=F.col("p_brand"), size=F.col("p_size")).alias("id"))


QUERIES = {
    f.__name__: f
    for f in (
        degree_metrics, adjacency_refs, reachability, entry_dead_nodes, simple_paths, scc, longest_depth, edge_classification, hash_propagation, impact_score, endpoint_normalise,
        api_surface_merge, operation_id_dedup, priority_resolve, surface_diff, incremental_diff, previous_snapshot, schema_diff, enum_removed, method_set_change,
        label_cascade, pattern_tags, severity_rollup, risk_score, infra_risk, top_findings, coverage, integrity_violations, containment_join, first_wins_dedup, carry_forward,
        symbol_min_line, set_ops, canonical_id,
    )
}

_REACH = """, r as (select node as seed, node, 0 as depth from v where node not in (select dst from e) union select r.seed, e.dst, r.depth + 1 from r join e on r.node = e.src where r.depth < 60),
q as (select seed, node, min(depth) as depth from r group by all)"""
_RANK = "case severity when 'MAJOR' then 3 when 'MINOR' then 2 when 'PATCH' then 1 else 0 end"
_SURFACE = f"""with s as (select repository, {_ROUTE.format("mount_path")} as path, coalesce(len(list_filter(middleware_tokens, lambda t: contains(lower(t), 'auth'))) > 0, false) as auth,
 child.router_symbol as handler, mount_id, observed_at, coalesce(middleware_tokens, []::varchar[]) as chain from router_mounts)"""
_CATEGORY = """case when contains(lower(file_path), 'test') or contains(lower(file_path), 'spec') then 'test' when ext in ('.md','.rst','.txt','.adoc') or contains(lower(file_path), 'doc') then 'doc'
 when ext in ('.json','.yaml','.yml','.xml','.properties','.toml','.ini','.env') then 'config' when ext in ('.java','.js','.ts','.py','.jsx','.tsx','.go','.rs','.rb','.php','.c','.cpp','.cs') then 'source'
 when ext in ('.css','.scss','.less','.sass') then 'style' else 'other' end"""
_LAYER = "case " + " ".join("when " + " or ".join(f"contains(low, '{p}')" for p in ps) + f" then '{n}'" for n, ps in labels.LAYERS) + " else 'other' end"
_TAGS = " union all ".join(f"select doc_id, '{t}' as tag from documents where regexp_matches(text, '{p}')" for t, p in labels.SCHEMA_TAGS.items())
_PAYLOAD = "(" + " union all ".join(
    f"select eventType as v, 'payload' as entity, '{f}' as field, '{'boolean' if f in ('isPreview', 'newUser') else 'int' if f == 'retryCount' else 'string'}' as type, count(payload.{f}) = count(*) as required from event_envelopes group by all having count(payload.{f}) > 0"
    for f in _FIELDS
) + ")"


def _id(**f: str) -> str:
    parts = " || ',' || ".join(f"'\"{k}\":' || to_json({v})::varchar" for k, v in sorted(f.items()))
    return f"substr(sha256('{{' || {parts} || '}}'), 1, 16)"


_SETS = """with s as (select user_id, hour(ts)::int as hour, coalesce(list_sort(list(distinct event_type) filter (ts < timestamp '2024-01-15')), []) as a,
 coalesce(list_sort(list(distinct event_type) filter (ts >= timestamp '2024-01-15')), []) as b from events group by all)"""

SQL = {
    "degree_metrics": _WITH + """, d as (select node, (select count(*) from e where dst = node) as fan_in, (select count(*) from e where src = node) as fan_out from v)
select node, fan_in, fan_out, i as instability, round((fan_in + fan_out) / (n - 1), 2) as centrality, fan_in > 2 and i < 0.5 as core, fan_out > 5 as high_coupling, i >= 0.8 as unstable
from (select d.*, case when fan_in + fan_out > 0 then round(fan_out / (fan_in + fan_out), 2) else 0.0 end as i, (select count(*) from v) as n from d)""",
    "adjacency_refs": _WITH + """ select coalesce(a.symbol, b.symbol) as symbol, coalesce(calls, []) as calls, coalesce(called_by, []) as called_by
from (select src as symbol, list_sort(list(distinct dst)) as calls from e group by src) a full join (select dst as symbol, list_sort(list(distinct src)) as called_by from e group by dst) b on a.symbol = b.symbol""",
    "reachability": _RECURSIVE + _REACH + " select seed, node, depth from q",
    "entry_dead_nodes": _RECURSIVE + """, r as (select node from v where node not in (select dst from e) union select e.dst from r join e on r.node = e.src)
select node, node not in (select dst from e) as entry, node not in (select node from r) as dead from v""",
    "simple_paths": _RECURSIVE + """, walk as (select [node] as path, node as cur, 0 as n from v where node not in (select dst from e) union all
 select list_append(path, dst), dst, n + 1 from walk join e on e.src = walk.cur where n < 6 and not list_contains(path, dst))
select array_to_string(path, '>') as path from walk where n > 0 and cur not in (select src from e)""",
    "scc": _RECURSIVE + """, up as (select src, dst from e union select up.src, e.dst from up join e on up.dst = e.src)
select v.node, least(v.node, coalesce((select min(a.dst) from up a join up b on a.dst = b.src and a.src = b.dst where a.src = v.node), v.node)) as component from v""",
    "longest_depth": """select 'c' || c_custkey as node, 0 as height from customer
union all select 'n' || n_nationkey, case when n_nationkey in (select c_nationkey from customer) then 1 else 0 end from nation
union all select 'r' || r_regionkey, coalesce((select max(case when n_nationkey in (select c_nationkey from customer) then 2 else 1 end) from nation where n_regionkey = r_regionkey), 0) from region""",
    "edge_classification": _WITH + """ select regexp_extract(src, '^(.*)/[^/]*$', 1) as a, regexp_extract(dst, '^(.*)/[^/]*$', 1) as b,
case when regexp_extract(src, '^(.*)/[^/]*$', 1) = regexp_extract(dst, '^(.*)/[^/]*$', 1) then 'internal' else 'external' end as type, count(*) as edges from e group by all""",
    "hash_propagation": _RECURSIVE + """, c as (select dst as seed from e group by 1 having count(*) > 1),
r as (select seed, seed as node from c union select r.seed, e.src from r join e on e.dst = r.node)
select seed, array_to_string(list_sort(list(distinct node)), ',') as chain from r where seed <> node group by seed""",
    "impact_score": _RECURSIVE + _REACH + " select seed, count(*) as radius, max(depth) as depth, 2 * count(*) + max(depth) as score from q group by seed",
    "endpoint_normalise": f"""select mount_path, p as path, array_to_string(list_sort(list_distinct(regexp_extract_all(p, '\\{{([A-Za-z_][A-Za-z0-9_]*)\\}}', 1))), ',') as params, sha256('v1|GET|' || p) as hash
from (select mount_path, {_ROUTE.format("mount_path")} as p from (select distinct mount_path from router_mounts where mount_path is not null))""",
    "api_surface_merge": _SURFACE + " select repository, path, bool_or(auth) as auth, arg_min(handler, mount_id) as handler, count(*) as mounts from s group by repository, path",
    "operation_id_dedup": f"""select mount_id, case when k = 1 then base else base || '_' || k end as operation_id from (select *, row_number() over (partition by base order by mount_id) as k from (
 select mount_id, repository || ':' || regexp_replace({_ROUTE.format("mount_path")}, '[^A-Za-z0-9]+', '_', 'g') as base from router_mounts))""",
    "priority_resolve": """with f as (select distinct regexp_replace(regexp_replace(trim(source_file), '[\\\\/]+', '/', 'g'), '^(\\./)+', '') as path from router_mounts),
r as (select distinct regexp_replace(regexp_replace(regexp_replace(trim(child.file_path), '[\\\\/]+', '/', 'g'), '^(\\./)+', ''), '\\.[a-z]+$', '') as request from router_mounts)
select request, case when request || '.js' in (select path from f) then request || '.js' when request || '.ts' in (select path from f) then request || '.ts'
 when request || '/index.js' in (select path from f) then request || '/index.js' when request || '/index.ts' in (select path from f) then request || '/index.ts' end as resolved from r""",
    "surface_diff": _SURFACE + f""", a as (select repository, path, bool_or(auth) as auth from s where observed_at < timestamp '2025-07-01' group by all), b as (select repository, path, bool_or(auth) as auth from s where observed_at >= timestamp '2025-07-01' group by all),
x as (select coalesce(a.repository, b.repository) as repository, coalesce(a.path, b.path) as path, case when b.path is null then 'API_REMOVAL' when a.path is null then 'API_ADDITION' when not a.auth and b.auth then 'AUTH_TIGHTENING' end as change
 from a full join b on a.repository = b.repository and a.path = b.path), y as (select *, case change when 'API_ADDITION' then 'MINOR' else 'MAJOR' end as severity from x where change is not null)
select repository, path, change, severity, {_id(repository="repository", path="path", change="change", severity="severity", detail="''")} as id from y""",
    "previous_snapshot": "select *, lag(snapshot_no) over (partition by repository order by snapshot_no) as baseline_no from (select distinct repository, snapshot_no from file_snapshots)",
    "schema_diff": f"""with f as (select * from {_PAYLOAD}), a as (select * from f where v = 'AnalysisRequested'), b as (select * from f where v = 'AnalysisFailed'),
x as (select coalesce(a.entity, b.entity) as entity, coalesce(a.field, b.field) as field, case when b.field is null then 'FIELD_REMOVED' when a.field is null then 'FIELD_ADDED' when a.type <> b.type then 'TYPE_CHANGED' end as change,
 case when a.field is null and not b.required then 'MINOR' else 'MAJOR' end as severity, case when a.field is null then case when b.required then 'required' else 'optional' end when b.field is null then '' else a.type || ' -> ' || b.type end as detail
 from a full join b on a.entity = b.entity and a.field = b.field)
select entity, field, change, severity, detail, {_id(entity="entity", field="field", change="change", severity="severity", detail="detail")} as id from x where change is not null""",
    "enum_removed": _SETS + " select user_id, hour, array_to_string(list_filter(a, lambda t: not list_contains(b, t)), ',') as removed from s where len(list_filter(a, lambda t: not list_contains(b, t))) > 0",
    "method_set_change": _SETS + " select user_id, hour, array_to_string(a, ',') as old_set, array_to_string(b, ',') as new_set from s where a <> b",
    "label_cascade": f"select {_CATEGORY} as category, {_LAYER} as layer, count(*) as files from (select file_path, replace(lower(file_path), '\\', '/') as low, lower(regexp_extract(file_path, '(\\.[^./]+)$', 1)) as ext from documents where file_path is not null) group by all",
    "pattern_tags": f"select tag, count(*) as files, min(doc_id) as first_doc from ({_TAGS}) group by tag",
    "severity_rollup": f"""select project_id, count(*) filter (severity = 'MAJOR') as major, count(*) filter (severity = 'MINOR') as minor, count(*) filter (severity = 'PATCH') as patch,
 case max({_RANK}) when 3 then 'MAJOR' when 2 then 'MINOR' when 1 then 'PATCH' end as highest from (select project_id, b.severity as severity from (select project_id, unnest(breaking_changes) as b from impact_reports) where b is not null) group by project_id""",
    "risk_score": """select report_id, ingested_at, (7 * len(list_filter(s, lambda x: x.severity = 'MAJOR')) + 3 * len(list_filter(s, lambda x: x.severity = 'MINOR')) + len(list_filter(s, lambda x: x.severity = 'PATCH')) + least(20, len(s))
 + case when coalesce(report.analysis_summary.breaking_changes_detected, false) then 4 else 0 end + least(12, len(list_distinct(list_filter(coalesce(report.affected_packages, []), lambda x: x is not null))) // 10))::bigint as score
 from (select *, coalesce(breaking_changes, []) as s from impact_reports)""",
    "infra_risk": """select case when major >= 2 or (major >= 1 and critical) then 'HIGH' when major >= 1 or minor >= 2 or (minor >= 1 and patch >= 2) or patch >= 4 then 'MEDIUM' else 'LOW' end as risk, count(*) as users from (
 select user_id, count(*) filter (value > 250) as major, count(*) filter (value > 150 and value <= 250) as minor, count(*) filter (value > 120 and value <= 150) as patch, bool_or(event_type = 'error') as critical from events group by user_id) group by 1""",
    "top_findings": f"select report_id, pos, ingested_at, severity from (select report_id, i - 1 as pos, ingested_at, b.severity as severity from (select report_id, ingested_at, unnest(breaking_changes) as b, generate_subscripts(breaking_changes, 1)::int as i from impact_reports) where b is not null) order by {_RANK} desc, report_id, pos, ingested_at limit 100",
    "coverage": "select o_orderstatus, count(*) as total, count(*) filter (hit) as resolved, (count(*) filter (hit) * 100) // count(*) as percent from (select o_orderstatus, o_orderkey in (select l_orderkey from lineitem) as hit from orders) group by 1",
    "integrity_violations": """select 'document without record' as rule, doc_id::varchar as key, count(*) as rows from documents where source = 'source_code' and doc_id not in (select doc_id from ast_records) group by doc_id
union all select 'line without order', l_orderkey::varchar, count(*) from lineitem where l_orderkey not in (select o_orderkey from orders) group by l_orderkey
union all select 'source without target', source, count(*) from documents where source is null or source not in (select source from mix_targets) group by source""",
    "containment_join": """with t as (select distinct unnest(report.affected_packages) as term from impact_reports), w as (select doc_id, unnest(list_distinct(regexp_split_to_array(coalesce(text, ''), '[^A-Za-z0-9_]+'))) as term from documents)
select term, count(*) as documents from w join t using (term) where term <> '' group by term""",
    "first_wins_dedup": "select user_id, event_type, event_id, ts, value from events qualify row_number() over (partition by user_id, event_type order by ts, event_id) = 1",
    "carry_forward": "select event_id, last_value(case when event_type = 'signup' then value end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as last_mark from events",
    "symbol_min_line": """with a as (select distinct doc_id, s.name as name from (select doc_id, unnest(symbols) as s from ast_records) where s.name is not null),
t as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents where text is not null),
w as (select doc_id, pos, unnest(regexp_split_to_array(line, '[^A-Za-z0-9_]+')) as name from t), f as (select doc_id, name, min(pos) as line from w group by all)
select a.doc_id, a.name, coalesce(f.line, 0)::bigint as line from a left join f on a.doc_id = f.doc_id and a.name = f.name""",
    "set_ops": """with c as (select c_nationkey as n from customer where c_acctbal < 0), s as (select s_nationkey as n from supplier where s_acctbal < 0)
select 'left more often' as op, n from (select distinct n from (select n from c except all select n from s)) union all select 'both', n from (select n from c intersect select n from s) union all select 'any', n from (select n from c union select n from s)""",
    "canonical_id": f"select p_partkey, {_id(name='p_name', brand='p_brand', size='p_size')} as id from part",
    "incremental_diff": """with c as (select repository, snapshot_no, regexp_replace(regexp_replace(trim(file_path), '[\\\\/]+', '/', 'g'), '^(\\./)+', '') as file_path, regexp_replace(lower(trim(content_hash)), '^sha256:', '') as h, regexp_replace(lower(trim(symbol_graph_hash)), '^sha256:', '') as s, arrived_at from file_snapshots),
f as (select * from c qualify row_number() over (partition by repository, snapshot_no, file_path order by arrived_at desc, h desc nulls last, s desc nulls last) = 1),
m as (select repository, min(snapshot_no) as a, max(snapshot_no) as b from f group by repository),
o as (select f.* from f join m on f.repository = m.repository and snapshot_no = a), n as (select f.* from f join m on f.repository = m.repository and snapshot_no = b)
select coalesce(o.repository, n.repository) as repository, case when o.h is null and o.file_path is null then 'added' when n.file_path is null then 'deleted' when coalesce(o.h <> n.h, false) then 'modified' else 'unchanged' end as change, count(*) as files
from o full join n on o.repository = n.repository and o.file_path = n.file_path group by all""",
}

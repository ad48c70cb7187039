"""Names, verdicts, rule families and joins over the registered tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.functions import labels, verdicts, words
from skein.operators import diff, relational, repositories
from skein.plans.common import table
from skein.streaming import envelopes

METHODS = ["GET", "POST", "PUT", "PATCH", "DELETE", "OPTIONS"]
CUT_REPORTS, CUT_MOUNTS = "2025-07-07", "2025-07-20"
HOST = "git.example.test"


def operation_ids(spark, d):
    """Names of every mounted path and every pair of paths of one repository, for each method."""
    m = table(spark, d, "router_mounts").where("mount_path is not null").select("repository", "child.file_path", "mount_path", F.explode(F.array(*map(F.lit, METHODS))).alias("method"))
    ends = m.groupBy("repository", "method").agg(F.min(F.trim("mount_path")).alias("a"), F.max(F.trim("mount_path")).alias("b"))
    longer = ends.select("method", F.explode(F.array(F.concat("a", F.lit("/"), "b"), F.concat("b", F.lit("/:rowId/"), "a"), F.concat("b", F.lit("/:rowId/"), "a", F.lit("/:cellId")))).alias("p"))
    p = m.select("method", F.col("mount_path").alias("p")).unionByName(longer).select("method", labels.route_path(F.col("p")).alias("path")).distinct()
    name = words.operation_id(F.col("method"), F.col("path"))
    return p.select("method", "path", name.alias("operation_id"), words.strict_operation_id(name).alias("strict_id"), words.route_summary(F.col("method"), F.col("path")).alias("summary"))


def symbol_names(spark, d):
    """Leaf, owner and controller key of dotted chains and symbols of the breaking changes."""
    b = table(spark, d, "impact_reports").select(F.explode("breaking_changes").alias("b")).where("b is not null")
    s = b.select(F.concat(F.array_join("b.propagation_chain", "."), F.lit(".run()")).alias("symbol")).unionByName(b.select(F.explode("b.affected_symbols").alias("symbol"))).where("symbol is not null").distinct()
    c = F.col("symbol")
    return s.select("symbol", words.symbol_leaf(c).alias("leaf"), words.symbol_owner(c).alias("owner"), words.controller_name(c).alias("controller"))


def literal_values(spark, d):
    b = table(spark, d, "impact_reports").select(F.explode("breaking_changes").alias("b")).select(F.explode("b.contract_breaks").alias("c")).where("c is not null")
    v = b.select(F.explode(F.array("c.baseline_value", "c.current_value", "c.endpoint", F.lit("'a b'"), F.lit("-12"), F.lit("1.50"), F.lit("NULL"), F.lit(" "))).alias("text")).where("text is not null").distinct()
    c = F.col("text")
    return v.select("text", words.literal_kind(c).alias("kind"), words.literal_text(c).alias("value"), words.safe_name(c).alias("file_name"), words.safe_token(c).alias("token"))


def repo_slugs(spark, d):
    p = table(spark, d, "event_envelopes").select("timestamp", "payload.githubUrl", "payload.projectId", "payload.branch", "payload.commitSha")
    url = F.coalesce(F.concat(F.lit(f"git@{HOST}:"), "projectId", F.lit("/"), "branch", F.lit(".git")), F.col("githubUrl"))
    g = p.select(words.repo_slug(url, HOST).alias("slug"), words.repo_slug(F.col("githubUrl"), HOST).alias("plain"), F.substring(words.generated_at(F.col("timestamp"), F.col("commitSha")), 1, 7).alias("at"))
    return g.groupBy("slug", "plain", "at").agg(F.count(F.lit(1)).alias("events"))


def file_verdicts(spark, d):
    p = F.col("file_path")
    f = table(spark, d, "documents").where("file_path is not null").select(
        verdicts.excluded(p).alias("excluded"), verdicts.safe_to_read(p).alias("safe"), verdicts.critical(p).alias("critical"), verdicts.component(p).alias("component")
    )
    return f.groupBy("excluded", "safe", "critical", "component").agg(F.count(F.lit(1)).alias("files"))


def file_severities(spark, d):
    """Severity and reason of each analysed file from its feature counts and symbols."""
    n = lambda k: F.coalesce(F.try_element_at("feature_summary", F.lit(k)).cast("int"), F.lit(0))
    kind = lambda k: F.size(F.filter(F.coalesce("symbols", F.expr("cast(array() as array<struct<symbol_id:string,kind:string,name:string>>)")), lambda s: s["kind"] == k))
    none = F.array().cast("array<string>")
    r = table(spark, d, "ast_records").where("file_path is not null")
    tags = F.when(F.lower("file_path").contains("schema"), F.array(F.lit("SCHEMA_FILE"))).otherwise(none)
    deco = F.when(kind("route") > 1, F.array(F.lit("@app.route"))).otherwise(none)
    sev = verdicts.file_severity(F.col("file_path"), tags, n("api_endpoints"), n("functions"), kind("class"), none, deco, kind("function"))
    why = verdicts.severity_reason(tags, n("api_endpoints"), kind("function"), n("functions"))
    return r.groupBy(sev.alias("severity"), why.alias("reason")).agg(F.count(F.lit(1)).alias("files"))


def middleware_types(spark, d):
    t = table(spark, d, "router_mounts").select(F.explode("middleware_tokens").alias("name"))
    b = table(spark, d, "impact_reports").select(F.explode("breaking_changes").alias("b")).select(F.explode("b.middleware_breaks").alias("m")).select("m.middleware_name", "m.scope")
    more = b.select(F.explode(F.array("middleware_name", "scope", F.concat("scope", F.lit("LoggingError")), F.concat("scope", F.lit("Throttle")), F.concat("middleware_name", F.lit("Json")))).alias("name"))
    k = verdicts.middleware_type(F.col("name"))
    return t.unionByName(more).where("name is not null").groupBy("name").agg(F.count(F.lit(1)).alias("n")).select("name", "n", k.alias("type"), verdicts.middleware_severity(k).alias("severity"))


def auth_labels(spark, d):
    m = table(spark, d, "router_mounts")
    tokens = F.concat(F.coalesce("middleware_tokens", F.array().cast("array<string>")), F.array(F.when(F.col("line") % 3 == 0, "verifyJwt").when(F.col("line") % 7 == 0, "requireRole").when(F.col("line") % 11 == 0, "sessionStore").otherwise("")))
    inherited, inferred = F.col("parent.file_path").isNotNull(), F.coalesce(F.col("line") % 5 == 0, F.lit(False))
    source = F.when(F.col("line") % 2 == 0, "AUTH_ANALYSIS").otherwise("STATIC_DISCOVERY")
    auth = verdicts.auth_label(tokens)
    score = verdicts.route_confidence(F.col("source_file").isNotNull(), inherited, auth != "Public", F.col("mount_path").isNotNull(), F.col("mount_path").contains(":"), auth == "Public")
    rows = m.select(auth.alias("auth"), verdicts.auth_basis(source, inherited, inferred).alias("basis"), verdicts.auth_confidence(source, inherited, inferred).alias("confidence"), score.alias("score"))
    return rows.groupBy("auth", "basis", "confidence", "score").agg(F.count(F.lit(1)).alias("mounts"))


def validator_flags(spark, d):
    v = F.array_join(verdicts.validators(F.col("text")), ",")
    return table(spark, d, "documents").groupBy("source", v.alias("validators")).agg(F.count(F.lit(1)).alias("docs"))


def repository_kinds(spark, d):
    """Type of each repository and the documents it needs; repositories with reports of breaking changes break."""
    docs = table(spark, d, "documents").where("source = 'source_code'").select("repository", F.col("file_path").alias("path"), "text")
    ends = table(spark, d, "ast_records").where("feature_summary['api_endpoints'] is not null").groupBy("repository").agg(F.count(F.lit(1)).alias("n"))
    kinds = repositories.repository_types(docs, ends)
    broken = table(spark, d, "impact_reports").where("report.analysis_summary.breaking_changes_detected").select(F.col("report.context.repository").alias("repository")).distinct().withColumn("breaking", F.lit(True))
    both = kinds.join(broken, "repository", "left").withColumn("breaking", F.coalesce("breaking", F.lit(False)))
    return both.select("repository", "repository_type", "breaking", verdicts.documentation_needs(F.col("repository_type"), F.col("breaking")).alias("n")).select("repository", "repository_type", "breaking", "n.*")


def report_labels(spark, d):
    files = F.coalesce("report.analysis_summary.total_files", F.lit(0))
    n = F.greatest(F.coalesce(F.size("breaking_changes"), F.lit(0)), F.lit(0))
    score = verdicts.complexity_score(files, n)
    return table(spark, d, "impact_reports").select("report_id", "ingested_at", F.round(score, 3).alias("complexity"), verdicts.operational_risk(score).alias("risk"), verdicts.blast_label(n).alias("blast_radius"))


def package_split(spark, d):
    """Distinct packages of each project, inside or outside."""
    p = table(spark, d, "impact_reports").select("project_id", F.explode("report.affected_packages").alias("package")).where("package is not null")
    more = p.unionByName(p.select("project_id", F.concat(F.lit("src/"), "package").alias("package")))
    return more.distinct().select("project_id", "package", verdicts.internal_package(F.col("package")).alias("internal"))


def _contract_rows(spark, d):
    r = table(spark, d, "impact_reports")
    b = r.select("project_id", "ingested_at", "report_id", F.explode("breaking_changes").alias("b")).where("b is not null")
    c = b.select("project_id", "ingested_at", "report_id", "b.id", F.explode("b.contract_breaks").alias("c")).where("c is not null and c.endpoint is not null")
    return c.select("project_id", (F.col("ingested_at") < CUT_REPORTS).alias("early"), "report_id", "id", "c.*")


def _map(key: str, value: str, where: str):
    """A map from ``key`` to the greatest ``value`` of the group's rows."""
    pairs = F.array_sort(F.collect_set(F.when(F.expr(where), F.struct(F.col(key).alias("k"), F.coalesce(F.col(value), F.lit("")).alias("v")))))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.array_max(F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"]))))


def _surfaces(spark, d):
    """Endpoints of each project before and after the middle of the reports, put together from the contract breaks."""
    c = _contract_rows(spark, d).withColumn("method", F.regexp_extract("endpoint", "^([A-Z]+)/", 1)).withColumn("path", F.regexp_extract("endpoint", "^[A-Z]*(/.*)$", 1))
    g = c.groupBy("project_id", "early", "method", "path").agg(
        F.array_sort(F.collect_set(F.when(F.col("change_type") == "param_requirement", F.coalesce("baseline_value", F.lit("x"))))).alias("required"),
        _map("change_type", "baseline_value", "change_type <> 'route_removal'").alias("request"),
        _map("severity", "current_value", "severity is not null").alias("responses"),
        F.max(F.col("severity") == "MAJOR").alias("auth_required"), F.min("severity").alias("_s"), F.array_sort(F.collect_set("baseline_value")).alias("params"),
    )
    g = g.withColumn("auth_type", F.when(F.col("_s") == "MAJOR", "JWT").otherwise("Public")).withColumn("operation_id", F.reverse(F.split("path", "/"))[0]).drop("_s")
    return g.where("early").drop("early"), g.where("not early").drop("early")


def surface_rules(spark, d):
    old, new = _surfaces(spark, d)
    return diff.surface_findings(old, new, ["project_id"])


def contract_rules(spark, d):
    old, new = _surfaces(spark, d)
    shape = lambda s: s.select("project_id", "method", "path", (F.size("required") > 0).alias("has_body"), F.map_keys("request").alias("fields"), F.transform_values("responses", lambda k, v: v == "True").alias("query"))
    return diff.snapshot_diff(shape(old), shape(new), ["project_id", "method", "path"], diff.CONTRACT_CHANGES).select("project_id", "method", "path", "change", "severity", "detail")


def _models(spark, d):
    c = _contract_rows(spark, d)
    g = c.groupBy("project_id", "early", F.regexp_extract("endpoint", "([^/]*)$", 1).alias("entity"), F.col("change_type").alias("field")).agg(
        F.max("severity").alias("type"), F.bool_or(F.col("baseline_value") == "True").alias("required"), F.max("current_value").alias("default"),
        F.array_sort(F.collect_set("baseline_value")).alias("enum_values"), F.bool_or(F.col("severity") == "PATCH").alias("primary_key"), F.bool_or(F.col("current_value").isNull()).alias("indexed"),
    )
    g = g.withColumn("required", F.coalesce("required", F.lit(False)))
    return g.where("early").drop("early"), g.where("not early").drop("early")


def schema_rules(spark, d):
    old, new = _models(spark, d)
    return diff.schema_findings(old, new, ["project_id"])


def removed_entities(spark, d):
    old, new = _models(spark, d)
    return diff.removed_names(old, new, ["project_id", "entity"], "SCHEMA_ENTITY_REMOVED")


def chain_rules(spark, d):
    """Middleware chains of each mounted router before and after the middle of the observations."""
    m = table(spark, d, "router_mounts").where("child.file_path is not null")
    conf = lambda t: F.concat(t, F.lit(":"), F.coalesce(F.col("mount_path"), F.lit("")))
    chain = F.transform(F.filter(F.coalesce("middleware_tokens", F.array().cast("array<string>")), lambda t: t.isNotNull()), lambda t: F.struct(t.alias("name"), conf(t).alias("config")))
    s = m.select("repository", "child.router_symbol", "observed_at", "mount_id", chain.alias("chain"))
    early = F.col("observed_at") < CUT_MOUNTS
    rank = F.struct("observed_at", "mount_id")
    side = lambda x: x.groupBy("repository", "router_symbol").agg(F.max_by("chain", rank).alias("chain"))
    return diff.chain_findings(side(s.where(early)), side(s.where(~early)), ["repository", "router_symbol"])


def finding_positions(spark, d):
    """Places of each project's findings in the orders of the four families."""
    b = table(spark, d, "impact_reports").select("project_id", "report_id", "ingested_at", F.posexplode("breaking_changes").alias("pos", "b")).where("b is not null")
    f = b.select(
        "project_id", F.concat_ws("/", "report_id", F.col("ingested_at").cast("string"), "pos").alias("id"), F.coalesce("b.severity", F.lit("PATCH")).alias("severity"), F.coalesce("b.source", F.lit("")).alias("change"),
        F.coalesce("b.id", F.lit("")).alias("endpoint"), F.coalesce("b.id", F.lit("")).alias("entity"), F.coalesce("b.source", F.lit("")).alias("field"), F.coalesce("b.id", F.lit("")).alias("name"),
        F.greatest(F.coalesce(F.size("b.affected_symbols"), F.lit(0)), F.lit(0)).alias("score"),
    )
    at = lambda order: F.rank().over(Window.partitionBy("project_id").orderBy(*order))
    places = [at(diff.finding_order(k)).alias(k) for k in diff.FINDING_ORDERS]
    return f.select("project_id", "id", *places, at(diff.name_order("change", "id")).alias("by_name"))


def summary_totals(spark, d):
    b = table(spark, d, "impact_reports").select("project_id", F.explode("breaking_changes").alias("b")).where("b is not null")
    f = b.select("project_id", F.col("b.severity").alias("severity"), (F.greatest(F.coalesce(F.size("b.affected_symbols"), F.lit(0)), F.lit(0)) * 1.5).cast("double").alias("score"))
    return diff.summary_totals(f, ["project_id"])


def ordered_unions(spark, d):
    b = table(spark, d, "impact_reports").select("report_id", "ingested_at", F.posexplode("breaking_changes").alias("pos", "b")).where("b is not null")
    return b.select("report_id", "ingested_at", "pos", F.array_join(words.ordered_union(F.col("b.propagation_chain"), F.col("b.affected_symbols")), ",").alias("symbols"))


def unique_change_ids(spark, d):
    b = table(spark, d, "impact_reports").select("project_id", "report_id", F.explode("breaking_changes").alias("b")).where("b is not null")
    return diff.unique_keys(b.select("project_id", "report_id", F.col("b.id").alias("id"), F.col("b.source").alias("source")), ["project_id", "id"])


def known_nodes(spark, d):
    """Dotted service chains resolved to names that occur as affected symbols or services."""
    b = table(spark, d, "impact_reports").select(F.explode("breaking_changes").alias("b")).where("b is not null")
    refs = b.select(F.array_join("b.propagation_chain", ".").alias("ref")).where("ref is not null").distinct()
    nodes = b.select(F.explode("b.propagation_chain").alias("node")).where("node < 'M'").distinct()
    return relational.known_nodes(refs, nodes, "ref")


def changed_seeds(spark, d):
    """Names of symbols that contain the name of a mounted collection."""
    base = table(spark, d, "router_mounts").select(F.regexp_extract("mount_path", "^/([a-z]+)s$", 1).alias("base")).where("base <> ''").distinct()
    names = table(spark, d, "ast_records").select(F.explode("symbols.name").alias("name")).where("name is not null").distinct()
    return relational.containing(base, names, "base", "name")


def unmounted_paths(spark, d):
    """Paths of declared routers under none of their repository's mounts of whole collections."""
    m = table(spark, d, "router_mounts").where("mount_path is not null")
    ends = m.where("mount_id % 2 = 0").select("repository", F.concat(labels.route_path(F.col("mount_path")), F.lit("/x")).alias("path")).distinct()
    tops = m.where("mount_id % 2 = 1").select("repository", labels.route_path(F.col("mount_path")).alias("prefix")).distinct()
    return relational.unmounted(ends, tops, "repository", "path", "prefix")


def model_relations(spark, d):
    """How the nouns of each project refer to each other: a symbol's mutation in a file is a field of the file's model."""
    s = table(spark, d, "impact_reports").select("project_id", F.explode("breaking_changes").alias("b")).select("project_id", F.explode("b.symbol_mutations").alias("s")).where("s is not null")
    low = lambda c: F.lower(F.regexp_extract(c, "([A-Z][a-z]+)", 1))
    f = s.select("project_id", F.regexp_extract("s.file_path", r"([a-z]+)\.ts$", 1).alias("model"), F.concat(low("s.symbol_name"), F.when(F.col("s.baseline_hash") < F.col("s.current_hash"), "[]").otherwise("?")).alias("type"))
    return relational.cardinalities(f.where("model <> '' and type is not null"), ["project_id"])


def file_modules(spark, d):
    """Modules are the directories of mounting files; analysed files of the same directory belong to them."""
    m = table(spark, d, "router_mounts").where("source_file is not null").groupBy(F.regexp_extract("source_file", r"^([^/\\]+)", 1).alias("name")).agg(F.collect_set("source_file").alias("files"))
    f = table(spark, d, "router_mounts").where("child.file_path is not null").select(F.col("child.file_path").alias("path")).distinct()
    return relational.attach_modules(f, m)


def payload_checks(spark, d):
    e = envelopes.typed_payloads(table(spark, d, "event_envelopes").withColumn("payload", F.col("payload")))
    return e.groupBy("eventType", "payload_ok", F.array_join("missing", ",").alias("missing")).agg(F.count(F.lit(1)).alias("events"))


QUERIES = {
    f.__name__: f
    for f in (
        operation_ids, symbol_names, literal_values, repo_slugs, file_verdicts, file_severities, middleware_types, auth_labels, validator_flags, repository_kinds, report_labels, package_split,
        surface_rules, contract_rules, schema_rules, removed_entities, chain_rules, finding_positions, summary_totals, ordered_unions, unique_change_ids, known_nodes, changed_seeds,
        unmounted_paths, model_relations, file_modules, payload_checks,
    )
}

def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _any(text: str, parts) -> str:
    return "(" + " or ".join(f"contains({text}, '" + p.replace("'", "''") + "')" for p in parts) + ")"


def _starts(text: str, parts) -> str:
    return "(" + " or ".join(f"starts_with({text}, '{p}')" for p in parts) + ")"


def _inflect(x: str, irregular: dict, endings: list, otherwise: str) -> str:
    known = " ".join(f"when {x} = '{a}' then '{b}'" for a, b in irregular.items())
    rules = " ".join(f"when regexp_matches({x}, '{p}') then regexp_replace({x}, '{p}', '{r.replace('$1', chr(92) + '1')}')" for p, r in endings)
    return f"case {known} {rules} else {otherwise} end"


def _capital(x: str) -> str:
    return f"(upper(left({x}, 1)) || substr({x}, 2))"


def _pascal(x: str) -> str:
    return f"coalesce(nullif(array_to_string(list_transform(list_filter(regexp_split_to_array({x}, '[^A-Za-z0-9]+'), lambda p: p <> ''), lambda p: {_capital('p')}), ''), ''), 'Resource')"


_PARAM = r"regexp_full_match({0}, '\{{.+\}}')"
_ROUTE = r"regexp_replace(regexp_replace(regexp_replace('/' || coalesce(trim({0}), ''), ':([A-Za-z_][A-Za-z0-9_]*)(\([^)]*\))?', '{{\1}}', 'g'), '/+', '/', 'g'), '(.)/$', '\1')"
_SINGULAR = "case when trim({0}) = '' then 'resource' else " + _inflect("lower(trim({0}))", words.IRREGULAR_SINGULAR, words.SINGULAR_ENDINGS, "lower(trim({0}))") + " end"
_PLURAL = _inflect("lower({0})", words.IRREGULAR_PLURAL, words.PLURAL_ENDINGS, "lower({0}) || 's'")

_OPERATIONS = f"""
with m as (select repository, mount_path, unnest([{_quoted(METHODS)}]) as method from router_mounts where mount_path is not null),
e as (select repository, method, min(trim(mount_path)) as a, max(trim(mount_path)) as b from m group by all),
l as (select method, unnest([a || '/' || b, b || '/:rowId/' || a, b || '/:rowId/' || a || '/:cellId']) as p from e),
p as (select distinct method, {_ROUTE.format("p")} as path from (select method, mount_path as p from m union all select * from l)),
s as (select *, list_filter(string_split(path, '/'), lambda x: x <> '' and x <> 'api' and not regexp_full_match(x, 'v[0-9]+')) as g,
  list_filter(string_split(path, '/'), lambda x: x <> '' and x not in ('api', 'v1', 'v2', 'v3')) as h from p),
t as (select *, list_filter(range(1, len(g) + 1), lambda i: not {_PARAM.format("g[i]")}) as spots, list_filter(g, lambda x: {_PARAM.format("x")})[1] as prm,
  list_filter(h, lambda x: not {_PARAM.format("x")}) as nouns, len(list_filter(h, lambda x: {_PARAM.format("x")})) > 0 as named from s),
u as (select *, g[spots[1]] as first, g[spots[2]] as second, list_filter(g, lambda x, i: i > spots[2] and {_PARAM.format("x")})[1] as later,
  coalesce(case when method = 'PATCH' then nouns[1] else nouns[-1] end, 'resource') as word from t),
v as (select *, {_SINGULAR.format("first")} as one, {_SINGULAR.format("second")} as two, {_SINGULAR.format("word")} as w,
  case method when 'GET' then 'get' when 'POST' then 'create' when 'PATCH' then 'update' when 'PUT' then 'replace' when 'DELETE' then 'delete' else lower(method) end as verb from u),
x as (select *, case when first is null then 'getResource' when lower(first) = 'search' then 'searchResources'
  when second is not null and method in ('POST', 'PUT', 'PATCH', 'DELETE') then verb || {_pascal("one")} || {_pascal("two")}
  when second is not null and method = 'GET' then verb || {_pascal("one")} || {_pascal("two")} || case when later is null then '' else 'By' || {_pascal("later[2:-2]")} end
  when method in ('GET', 'DELETE') then case when prm is not null then verb || {_pascal("one")} || 'By' || {_pascal("prm[2:-2]")} else verb || {_pascal(_PLURAL.format("one"))} end
  else verb || {_pascal("one")} end as operation_id from v),
y as (select *, list_filter(regexp_extract_all(operation_id, '([A-Z][a-z]*)', 1), lambda q: lower(q) <> regexp_extract(operation_id, '^([a-z]+)', 1)) as ws from x),
z as (select *, list_filter(ws, lambda q, i: i = 1 or lower(q) <> lower(ws[i - 1])) as kept from y)
select method, path, operation_id, regexp_extract(operation_id, '^([a-z]+)', 1) || case when len(kept) = 0 then 'Resource' else array_to_string(kept, '') end as strict_id,
 case when method = 'GET' and not named then 'List ' || {_capital("(" + _PLURAL.format("w") + ")")} when method = 'POST' then 'Create ' || {_capital("w")} when method = 'DELETE' and named then 'Delete ' || {_capital("w")} || ' By Id'
  when method = 'PATCH' then rtrim('Update ' || {_capital("w")} || ' ' || array_to_string(list_transform(nouns[2:], lambda q: {_capital("q")}), ' ')) else upper(left(method, 1)) || lower(substr(method, 2)) || ' ' || {_capital("w")} end as summary from z"""

_CHANGES = "(select project_id, report_id, ingested_at, generate_subscripts(breaking_changes, 1)::int - 1 as pos, unnest(breaking_changes) as b from impact_reports)"

_SYMBOLS = f"""
with s as (select distinct s as symbol from (select array_to_string(b.propagation_chain, '.') || '.run()' as s from {_CHANGES} where b is not null union all select unnest(b.affected_symbols) from {_CHANGES} where b is not null) where s is not null),
p as (select *, list_filter(string_split(trim(symbol), '.'), lambda x: x <> '') as p, regexp_replace(trim(symbol), '\\(\\)$', '') as bare from s)
select symbol, coalesce(list_filter(string_split(bare, '.'), lambda x: x <> '')[-1], bare) as leaf, coalesce(case when len(p) = 2 then p[-2] else p[1] end, '') as owner,
 regexp_replace(regexp_replace(lower(symbol), '[._-]', '', 'g'), 'controller$', '') as controller from p"""

_CONTRACTS = f"(select project_id, ingested_at < timestamp '{CUT_REPORTS}' as early, report_id, c.* from (select project_id, ingested_at, report_id, unnest(b.contract_breaks) as c from {_CHANGES} where b is not null) where c is not null and c.endpoint is not null)"

_LITERALS = f"""
with v as (select distinct t as text, trim(t) as t from (select unnest([baseline_value, current_value, endpoint, '''a b''', '-12', '1.50', 'NULL', ' ']) as t from
  (select unnest(b.contract_breaks, recursive := true) from {_CHANGES} where b is not null) q where not (endpoint is null and change_type is null and severity is null)) where t is not null),
k as (select *, case when t = '' then 'none' when regexp_full_match(t, '"[^"]*"|''[^'']*''') then 'string' when lower(t) in ('true', 'false') then 'boolean' when lower(t) = 'null' then 'null'
  when regexp_full_match(t, '-?\\d+') then 'integer' when regexp_full_match(t, '-?\\d+\\.\\d+') then 'fraction' else 'code' end as kind from v)
select text, kind, case when kind in ('none', 'null') then null when kind = 'string' then t[2:-2] when kind = 'boolean' then lower(t) else t end as value,
 coalesce(nullif(regexp_replace(t, '[^A-Za-z0-9._-]+', '_', 'g'), ''), 'unknown') as file_name, coalesce(nullif(regexp_replace(t, '[^A-Za-z0-9_./-]', '_', 'g'), ''), 'unknown') as token from k"""


def _slug(url: str) -> str:
    p = r"(?:^|[/@.])" + HOST.replace(".", "[.]") + r"[:/]+([^/]+)/([^/.]+)(?:\.git)?/?$"
    return f"case when regexp_extract(trim({url}), '{p}', 1) <> '' then regexp_extract(trim({url}), '{p}', 1) || '/' || regexp_extract(trim({url}), '{p}', 2) end"


_SLUGS = f"""
select {_slug(f"coalesce('git@{HOST}:' || payload.projectId || '/' || payload.branch || '.git', payload.githubUrl)")} as slug, {_slug("payload.githubUrl")} as plain,
 left(case when trim(coalesce(timestamp, '')) <> '' then trim(timestamp) when coalesce(payload.commitSha, '') not in ('', 'error') then 'commit:' || payload.commitSha else '1970-01-01T00:00:00Z' end, 7) as at, count(*) as events
from event_envelopes group by all"""

_DIRS = f"[{_quoted(verdicts.IGNORED_DIRS)}]"
_FILES = f"""
with f as (select file_path as p, replace(file_path, chr(92), '/') as flat, string_split(replace(file_path, chr(92), '/'), '/')[-1] as name from documents where file_path is not null),
g as (select *, regexp_extract(lower(name), '[^.](\\.[^.]*)$', 1) as ext, name in ({_quoted(verdicts.IGNORED_FILES)}) or list_has_any(string_split(flat, '/'), {_DIRS}) as left_out from f)
select left_out or list_has_any(string_split(lower(flat), '/'), {_DIRS}) or {_starts("regexp_replace(lower(name), '(.)\\.[^.]*$', '" + chr(92) + "1')", verdicts.CONFIG_BEGINNINGS)}
   or ext not in ({_quoted(verdicts.SOURCE_EXTENSIONS + verdicts.DATA_EXTENSIONS)}) as excluded, not left_out and ext not in ({_quoted(verdicts.BINARY_EXTENSIONS)}) as safe,
 name in ({_quoted(verdicts.CRITICAL_FILES)}) or {_any("lower(p)", ["migration", "schema"])} as critical,
 case {" ".join(f"when {_starts('lower(p)', w)} then '{k}'" for k, w in verdicts.COMPONENT_BEGINNINGS)} {" ".join(f"when {_any('lower(p)', w)} then '{k}'" for k, w in verdicts.COMPONENT_PARTS)} else 'backend' end as component, count(*) as files
from g group by all"""

_SEVERITIES = """
with r as (select lower(regexp_extract(file_path, '(\\.[^./]+)$', 1)) as ext, contains(lower(file_path), 'schema') as tag, coalesce(try_cast(feature_summary['api_endpoints'] as int), 0) as e,
  coalesce(try_cast(feature_summary['functions'] as int), 0) as f, len(list_filter(coalesce(symbols, []), lambda s: s.kind = 'class')) as c, len(list_filter(coalesce(symbols, []), lambda s: s.kind = 'function')) as m,
  len(list_filter(coalesce(symbols, []), lambda s: s.kind = 'route')) > 1 as web from ast_records where file_path is not null)
select case when tag or e > 0 then 'MAJOR' when ext = '.java' then case when m > 0 then 'MINOR' else 'PATCH' end when ext in ('.ts', '.tsx', '.js', '.jsx') then case when f > 0 then 'MINOR' else 'PATCH' end
  when ext = '.py' then case when web then 'MAJOR' when c > 0 or f > 2 then 'MINOR' else 'PATCH' end when ext = '.sql' then 'MAJOR' when ext in ('.yaml', '.yml', '.json', '.properties', '.env') then 'MINOR' else 'PATCH' end as severity,
 coalesce(nullif(concat_ws('; ', case when tag then 'Schema changes detected: SCHEMA_FILE' end, case when e > 0 then 'API endpoint modifications' end,
  case when m > 0 then 'Methods: ' || m || ' modified' end, case when f > 0 then 'Functions: ' || f || ' modified' end), ''), 'General code changes') as reason, count(*) as files
from r group by all"""

_TYPE = "case " + " ".join(f"when {_any('lower(name)', w)} then '{k}'" for k, w in verdicts.MIDDLEWARE_WORDS) + " else 'unknown' end"
_GRADE = "case {0} " + " ".join(f"when '{k}' then '{v}'" for k, v in verdicts.MIDDLEWARE_SEVERITY.items()) + " else 'MINOR' end"
_MIDDLEWARE = f"""
with b as (select m.middleware_name as n, m.scope as s from (select unnest(b.middleware_breaks) as m from {_CHANGES} where b is not null)),
t as (select unnest(middleware_tokens) as name from router_mounts union all select unnest([n, s, s || 'LoggingError', s || 'Throttle', n || 'Json']) from b),
k as (select name, count(*) as n, {_TYPE} as type from t where name is not null group by name)
select *, {_GRADE.format("type")} as severity from k"""

_AUTH = f"""
with m as (select *, lower(array_to_string(list_concat(coalesce(middleware_tokens, []), [case when line % 3 = 0 then 'verifyJwt' when line % 7 = 0 then 'requireRole' when line % 11 = 0 then 'sessionStore' else '' end]), ' ')) as t,
  parent.file_path is not null as inherited, coalesce(line % 5 = 0, false) as inferred, coalesce(line % 2 = 0, false) as seen from router_mounts),
a as (select *, case when {_any("t", verdicts.JWT_WORDS)} and {_any("t", verdicts.ROLE_WORDS)} then 'JWT+RBAC' when {_any("t", verdicts.JWT_WORDS)} then 'JWT' when {_any("t", verdicts.SESSION_WORDS)} then 'Session'
  when {_any("t", verdicts.ROLE_WORDS)} then 'RBAC' else 'Public' end as auth from m)
select auth, case when inferred then 'INFERRED' when seen then 'AUTH_ANALYSIS' when inherited then 'ROUTE_RESOLUTION' else 'STATIC_DISCOVERY' end as basis,
 case when inferred then 0.85::double when seen and not inherited then 1.0::double when seen then 0.95::double when inherited then 0.9::double else 0.8::double end as confidence,
 least(greatest(case when source_file is not null then 95 else 75 end + case when inherited then 2 else 0 end + case when auth <> 'Public' then 2 else 0 end + case when mount_path is not null then 2 else 0 end
  - case when coalesce(contains(mount_path, ':'), false) then 10 else 0 end - case when auth = 'Public' then 5 else 0 end, 0), 100) / 100 as score, count(*) as mounts
from a group by all"""

_VALIDATORS = f"""select source, array_to_string(list_filter([{", ".join(f"case when {_any('lower(text)', s)} then '{n}' end" for n, s in verdicts.VALIDATOR_SIGNS)}], lambda x: x is not null), ',') as validators, count(*) as docs
from documents group by all"""


def _ends(text: str, endings) -> str:
    return "(" + " or ".join(f"ends_with({text}, '{e}')" for e in endings) + ")"


_KINDS = f"""
with f as (select repository, lower(coalesce(file_path, '')) as p, lower(coalesce(text, '')) as t, string_split(replace(lower(coalesce(file_path, '')), chr(92), '/'), '/')[-1] = 'package.json' as pkg from documents where source = 'source_code'),
g as (select *, trim(p) <> '' as there, {_ends("p", repositories.CODE_ENDINGS)} as code, {_any("'/' || p", repositories.INFRA_PARTS)} or {_ends("p", repositories.INFRA_ENDINGS)} as infra from f),
n as (select repository, count(*) as n from ast_records where feature_summary['api_endpoints'] is not null group by all),
a as (select repository, bool_or(there and ({_any("p", repositories.FRONTEND_PARTS)} or {_ends("p", repositories.FRONTEND_ENDINGS)})) as frontend, bool_or(there and {_any("p", repositories.BACKEND_PARTS)}) as backend,
  bool_or(there and infra) as infra, bool_or(there and not infra) as plain, bool_or(there and pkg and {_any("t", repositories.SERVER_PACKAGES)}) as express, bool_or(there and pkg and {_any("t", repositories.FRONTEND_PACKAGES)}) as view,
  bool_or(there and (pkg and {_any("t", repositories.CLI_PACKAGES)} or code and {_any("t", repositories.CLI_SIGNS)})) as cli, bool_or(there and code and {_any("t", repositories.EXPORT_SIGNS)}) as exports,
  bool_or(there and code and {_any("t", repositories.SERVER_SIGNS)}) as server from g group by repository),
s as (select a.*, express or server or coalesce(n.n, 0) > 0 as serves from a left join n using (repository)),
k as (select repository, case when frontend and (backend or serves) then 'fullstack' when view and not serves and not backend then 'frontend-app' when serves then 'backend-service' when infra and not plain then 'infra-only'
  when cli then 'cli' when exports then 'library' when view then 'frontend-app' when backend then 'backend-service' else 'library' end as repository_type from s),
b as (select distinct report.context.repository as repository from impact_reports where report.analysis_summary.breaking_changes_detected)
select repository, repository_type, b.repository is not null as breaking, true as requires_readme, repository_type in ('backend-service', 'fullstack') as requires_api_reference, repository_type <> 'infra-only' as requires_architecture_doc,
 b.repository is not null and repository_type in ('backend-service', 'fullstack', 'library') as requires_adr from k left join b using (repository)"""

_REPORTS = """
with r as (select report_id, ingested_at, least(100.0::double, coalesce(report.analysis_summary.total_files, 0) * 0.1::double + coalesce(len(breaking_changes), 0) * 2) as c, coalesce(len(breaking_changes), 0) as n from impact_reports)
select report_id, ingested_at, round(c, 3) as complexity, case when c > 40 then 'HIGH' when c > 15 then 'MEDIUM' else 'LOW' end as risk, case when n > 5 then 'APPLICATION' when n > 0 then 'SERVICE' else 'LOCAL' end as blast_radius from r"""

_PACKAGES = """
with p as (select project_id, unnest(report.affected_packages) as package from impact_reports), q as (select * from p where package is not null union all select project_id, 'src/' || package from p where package is not null)
select distinct project_id, package, starts_with(package, './') or starts_with(package, '../') or starts_with(package, 'src/') or starts_with(package, 'app/') as internal from q"""

_SURFACE = f"""
with c as (select *, regexp_extract(endpoint, '^([A-Z]+)/', 1) as method, regexp_extract(endpoint, '^[A-Z]*(/.*)$', 1) as path from {_CONTRACTS}),
g as (select project_id, early, method, path, max(case when severity = 'MAJOR' then 1 else 0 end) as ar, min(severity) as s, count(*) filter (change_type = 'param_requirement') > 0 as has_body, string_split(path, '/')[-1] as op from c group by all),
a as (select * from g where early), b as (select * from g where not early), k as (select a.*, b.ar as ar2, b.s as s2, b.has_body as body2 from a join b using (project_id, method, path)),
req as (select distinct project_id, early, method, path, coalesce(baseline_value, 'x') as v from c where change_type = 'param_requirement'),
fld as (select project_id, early, method, path, change_type as f, max(coalesce(baseline_value, '')) as t from c where change_type <> 'route_removal' group by all),
res as (select project_id, early, method, path, severity as f, max(coalesce(current_value, '')) as t from c where severity is not null group by all),
prm as (select distinct project_id, early, method, path, baseline_value as v from c where baseline_value is not null),
nreq as (select project_id, method, path, v from req where not early except select project_id, method, path, v from req where early),
nopt as (select project_id, method, path, f from fld where not early except select project_id, method, path, f from fld where early except select * from nreq)"""

_SURFACE_RULES = (
    _SURFACE
    + """,
ua as (select project_id, op, any_value(method) as m, any_value(path) as p from a group by all having count(*) = 1), ub as (select project_id, op, any_value(method) as m, any_value(path) as p from b group by all having count(*) = 1),
mv as (select project_id, op, ua.m as m1, ua.p as p1, ub.m as m2, ub.p as p2 from ua join ub using (project_id, op))
select project_id, method || ' ' || path as endpoint, 'API_REMOVAL' as change, 'MAJOR' as severity, '' as detail from a where not exists (select 1 from b where b.project_id = a.project_id and b.method = a.method and b.path = a.path)
union all select project_id, method || ' ' || path, 'API_ADDITION', 'MINOR', '' from b where not exists (select 1 from a where b.project_id = a.project_id and b.method = a.method and b.path = a.path)
union all select project_id, method || ' ' || path, 'REQUIRED_FIELD_ADDED', 'MAJOR', string_agg(v, ', ' order by v) from nreq semi join k using (project_id, method, path) group by all
union all select project_id, method || ' ' || path, 'API_REQUEST_EXPANSION', 'MINOR', string_agg(f, ', ' order by f) from nopt semi join k using (project_id, method, path) group by all
union all select x.project_id, x.method || ' ' || x.path, 'FIELD_TYPE_CHANGED', 'MAJOR', x.f from fld x join fld y on x.early and not y.early and x.project_id = y.project_id and x.method = y.method and x.path = y.path and x.f = y.f and x.t <> y.t
union all select x.project_id, x.method || ' ' || x.path, 'RESPONSE_CHANGED', 'MAJOR', x.f from res x join res y on x.early and not y.early and x.project_id = y.project_id and x.method = y.method and x.path = y.path and x.f = y.f and x.t <> y.t
union all select project_id, method || ' ' || path, 'STATUS_REMOVED', 'MAJOR', string_agg(f, ', ' order by f) from (select project_id, method, path, f from res where early except select project_id, method, path, f from res where not early) semi join k using (project_id, method, path) group by all
union all select project_id, method || ' ' || path, 'AUTH_TIGHTENING', 'MAJOR', case when s = 'MAJOR' then 'JWT' else 'Public' end || ' -> ' || case when s2 = 'MAJOR' then 'JWT' else 'Public' end from k where (s <> 'MAJOR' and s2 = 'MAJOR') or (ar = 0 and ar2 = 1)
union all select project_id, m2 || ' ' || p2, 'METHOD_CHANGED', 'MAJOR', m1 || ' -> ' || m2 from mv where m1 <> m2
union all select project_id, m2 || ' ' || p2, 'PATH_CHANGED', 'MAJOR', p1 || ' -> ' || p2 from mv where p1 <> p2
union all select project_id, m2 || ' ' || p2, 'PATH_PARAMETER_REMOVED', 'MAJOR', string_agg(v, ', ' order by v) from (
  select mv.*, v from mv join prm on prm.early and prm.project_id = mv.project_id and prm.method = m1 and prm.path = p1 where p1 <> p2
  except select mv.*, v from mv join prm on not prm.early and prm.project_id = mv.project_id and prm.method = m2 and prm.path = p2) group by all"""
)

_CONTRACT_RULES = (
    _SURFACE
    + """
select project_id, method, path, 'ROUTE_REMOVED' as change, 'MAJOR' as severity, '' as detail from a where not exists (select 1 from b where b.project_id = a.project_id and b.method = a.method and b.path = a.path)
union all select project_id, method, path, 'BODY_SCHEMA_REMOVED', 'MAJOR', '' from k where has_body and not body2
union all select project_id, method, path, 'BODY_FIELD_REMOVED', 'MAJOR', f from (select project_id, method, path, f from fld where early except select project_id, method, path, f from fld where not early) semi join (select * from k where has_body and body2) using (project_id, method, path)
union all select x.project_id, x.method, x.path, 'QUERY_PARAM_REQUIRED', 'MAJOR', x.f from res x join res y on x.early and not y.early and x.project_id = y.project_id and x.method = y.method and x.path = y.path and x.f = y.f and x.t <> 'True' and y.t = 'True'"""
)

_MODEL = f"""
with g as (select project_id, early, regexp_extract(endpoint, '([^/]*)$', 1) as entity, change_type as field, max(severity) as type, coalesce(bool_or(baseline_value = 'True'), false) as required, max(current_value) as def,
  list_distinct(list(baseline_value) filter (baseline_value is not null)) as ev, coalesce(bool_or(severity = 'PATCH'), false) as pk, bool_or(current_value is null) as ix from {_CONTRACTS} group by all),
a as (select * from g where early), b as (select * from g where not early), ents as (select project_id, entity from a intersect select project_id, entity from b),
k as (select a.project_id, a.entity, a.field, a.type as t1, b.type as t2, a.def as d1, b.def as d2, a.ev as e1, b.ev as e2, a.pk as p1, b.pk as p2, a.ix as i1, b.ix as i2 from a join b on a.project_id = b.project_id and a.entity = b.entity and a.field is not distinct from b.field)"""

_SCHEMA_RULES = (
    _MODEL
    + """
select project_id, entity, '' as field, 'ENTITY_REMOVED' as change, 'MAJOR' as severity, '' as detail from (select project_id, entity from a except select project_id, entity from b)
union all select project_id, entity, field, 'FIELD_REMOVED', 'MAJOR', '' from (select project_id, entity, field from a except select project_id, entity, field from b) semi join ents using (project_id, entity)
union all select b.project_id, b.entity, b.field, case when b.required and coalesce(b.def, '') = '' then 'REQUIRED_FIELD_ADDED_NO_DEFAULT' else 'OPTIONAL_FIELD_ADDED' end, case when b.required and coalesce(b.def, '') = '' then 'MAJOR' else 'MINOR' end, ''
  from b semi join ents using (project_id, entity) where not exists (select 1 from a where a.project_id = b.project_id and a.entity = b.entity and a.field is not distinct from b.field)
union all select project_id, entity, field, 'TYPE_CHANGED', 'MAJOR', coalesce(t1, '') || ' -> ' || coalesce(t2, '') from k where t1 is distinct from t2
union all select project_id, entity, field, 'ENUM_VALUE_REMOVED', 'MAJOR', array_to_string(list_sort(list_filter(e1, lambda x: not list_contains(coalesce(e2, []), x))), ', ') from k where len(list_filter(e1, lambda x: not list_contains(coalesce(e2, []), x))) > 0
union all select project_id, entity, field, 'PRIMARY_KEY_CHANGED', 'MAJOR', '' from k where p1 <> p2
union all select project_id, entity, field, 'DEFAULT_VALUE_CHANGED', 'MINOR', coalesce(d1, '') || ' -> ' || coalesce(d2, '') from k where d1 is distinct from d2
union all select project_id, entity, field, 'INDEX_CHANGED', 'MINOR', '' from k where i1 <> i2"""
)

_CHAINS = f"""
with m as (select repository, child.router_symbol as router_symbol, observed_at, mount_id, coalesce(mount_path, '') as mp, list_filter(coalesce(middleware_tokens, []), lambda t: t is not null) as x, observed_at < timestamp '{CUT_MOUNTS}' as early
  from router_mounts where child.file_path is not null),
e as (select repository, router_symbol, early, arg_max(struct_pack(x := x, mp := mp), struct_pack(o := observed_at, i := mount_id)) as r from m group by all),
k as (select a.repository, a.router_symbol, a.r.x as x, b.r.x as y, a.r.mp as c1, b.r.mp as c2, b.r is null as gone from (select * from e where early) a left join (select * from e where not early) b
  on a.repository = b.repository and a.router_symbol = b.router_symbol),
r as (select *, unnest(list_distinct(x)) as name from k where not gone),
t as (select *, {_TYPE} as type from r), s as (select *, {_GRADE.format("type")} as severity from t)
select repository, router_symbol, 'CHAIN_REMOVED' as change, '' as middleware, 'MAJOR' as severity from k where gone
union all select repository, router_symbol, 'MIDDLEWARE_REMOVED', name, severity from s where not list_contains(y, name)
union all select repository, router_symbol, 'MIDDLEWARE_CONFIG_CHANGED', name, severity from s where list_contains(y, name) and c1 <> c2
union all select k.repository, k.router_symbol, 'MIDDLEWARE_ORDER_CHANGED', '', coalesce((select case max(case s.severity when 'MAJOR' then 3 when 'MINOR' then 2 else 1 end) when 3 then 'MAJOR' when 2 then 'MINOR' when 1 then 'PATCH' end
  from s where s.repository = k.repository and s.router_symbol is not distinct from k.router_symbol and list_contains(s.y, s.name) and list_position(s.x, s.name) <> list_position(s.y, s.name)), 'MINOR') from k where not gone and x <> y"""

_POSITIONS = f"""
with f as (select project_id, report_id || '/' || strftime(ingested_at, '%Y-%m-%d %H:%M:%S') || rtrim(rtrim(strftime(ingested_at, '.%f'), '0'), '.') || '/' || pos as id, coalesce(b.severity, 'PATCH') as s, coalesce(b.source, '') as src, coalesce(b.id, '') as bid, coalesce(len(b.affected_symbols), 0) as n from {_CHANGES} where b is not null),
r as (select *, case s when 'MAJOR' then 3 when 'MINOR' then 2 when 'PATCH' then 1 else 0 end as k from f)
select project_id, id, rank() over (partition by project_id order by k desc, bid, src, id) as api, rank() over (partition by project_id order by k desc, bid, src, src, id) as schema,
 rank() over (partition by project_id order by n desc, bid, id) as semantic, rank() over (partition by project_id order by k desc, id) as hash, rank() over (partition by project_id order by lower(src), src, id) as by_name from r"""

_SEEDS = """
with b as (select distinct regexp_extract(mount_path, '^/([a-z]+)s$', 1) as base from router_mounts), n as (select distinct name from (select unnest(symbols).name as name from ast_records) where name is not null)
select base, name from b join n on contains(lower(name), base) where base <> ''"""

_UNMOUNTED = f"""
with e as (select distinct repository, {_ROUTE.format("mount_path")} || '/x' as path from router_mounts where mount_path is not null and mount_id % 2 = 0),
t as (select distinct repository, {_ROUTE.format("mount_path")} as prefix from router_mounts where mount_path is not null and mount_id % 2 = 1), o as (select * from t where prefix not in ('', '/'))
select repository, path from e where exists (select 1 from o where o.repository = e.repository) and not exists (select 1 from o where o.repository = e.repository and (path = prefix or starts_with(path, rtrim(prefix, '/') || '/')))"""

_NODES = f"""
with b as (select b from {_CHANGES} where b is not null), r as (select distinct array_to_string(b.propagation_chain, '.') as ref from b where b.propagation_chain is not null),
n as (select distinct x as node from (select unnest(b.propagation_chain) as x from b) where x < 'M'), p as (select ref, trim(ref) as t, list_filter(string_split(trim(ref), '.'), lambda x: x <> '') as p from r)
select ref, case when t in (select node from n) then t when contains(t, '.') and string_split(t, '.')[1] in (select node from n) then string_split(t, '.')[1] when p[-1] in (select node from n) then p[-1]
 when len(p) >= 2 and p[-2] in (select node from n) then p[-2] else '' end as node from p"""

_RELATIONS = f"""
with s as (select project_id, regexp_extract(s.file_path, '([a-z]+)[.]ts$', 1) as model, lower(regexp_extract(s.symbol_name, '([A-Z][a-z]+)', 1)) as base, s.baseline_hash < s.current_hash as many from (select project_id, unnest(b.symbol_mutations) as s from {_CHANGES} where b is not null) where s is not null),
f as (select project_id, model, base, coalesce(many, false) as many from s where model <> '' and base is not null), r as (select f.* from f semi join (select distinct project_id, model as base from f) m using (project_id, base)),
k as (select project_id, base as m, model as b, bool_or(many) as back from r group by all), j as (select r.*, coalesce(k.back, false) as back from r left join k on k.project_id = r.project_id and k.m = r.model and k.b = r.base)
select distinct project_id, case when many <> back then 'one-to-many' when many then 'many-to-many' else 'one-to-one' end as type, case when many <> back then base else least(model, base) end as from_model,
 case when many <> back then model else greatest(model, base) end as to_model from j"""

_MODULES = """
with m as (select replace(source_file, chr(92), '/') as f, min(regexp_extract(source_file, '^([^/\\\\]+)', 1)) as module from router_mounts where source_file is not null group by 1),
f as (select distinct child.file_path as path from router_mounts where child.file_path is not null) select path, coalesce(module, 'unknown') as module from f left join m on m.f = replace(path, chr(92), '/')"""


def _lack(fields) -> str:
    return ", ".join(f"case when payload.{f} is null then '{f}' end" for f in fields)


_PAYLOADS = f"""
with e as (select eventType, list_filter(list_concat(case eventType {" ".join(f"when '{k}' then [{_lack(v)}]" for k, v in envelopes.REQUIRED.items())} else [] end,
  [case when eventType <> 'AnalysisFailed' and payload.triggerType not in ({_quoted(envelopes.TRIGGERS)}) then 'triggerType' end, case when eventType = 'AnalysisFailed' and payload.failedStage not in ({_quoted(envelopes.STAGES)}) then 'failedStage' end,
   case when eventType = 'AnalysisFailed' and payload.errorMessage = '' then 'errorMessage' end, case when eventType = 'AnalysisFailed' and payload.retryCount < 0 then 'retryCount' end]), lambda x: x is not null) as m from event_envelopes)
select eventType, coalesce(eventType in ({_quoted(envelopes.EVENT_TYPES)}), false) and len(m) = 0 as payload_ok, array_to_string(list_sort(list_distinct(m)), ',') as missing, count(*) as events from e group by all"""

SQL = {
    "operation_ids": _OPERATIONS, "symbol_names": _SYMBOLS, "literal_values": _LITERALS, "repo_slugs": _SLUGS, "file_verdicts": _FILES, "file_severities": _SEVERITIES, "middleware_types": _MIDDLEWARE,
    "auth_labels": _AUTH, "validator_flags": _VALIDATORS, "repository_kinds": _KINDS, "report_labels": _REPORTS, "package_split": _PACKAGES, "surface_rules": _SURFACE_RULES, "contract_rules": _CONTRACT_RULES,
    "schema_rules": _SCHEMA_RULES, "removed_entities": _MODEL + " select project_id, entity, 'SCHEMA_ENTITY_REMOVED' as change, 'MAJOR' as severity from (select project_id, entity from a except select project_id, entity from b)",
    "chain_rules": _CHAINS, "finding_positions": _POSITIONS,
    "summary_totals": f"""select project_id, count(*) as total, count(*) filter (b.severity = 'MAJOR') as major, count(*) filter (b.severity = 'MINOR') as minor, count(*) filter (b.severity = 'PATCH') as patch,
 round(sum(coalesce(len(b.affected_symbols), 0) * 1.5)::double, 3) as risk from {_CHANGES} where b is not null group by project_id""",
    "ordered_unions": f"""with u as (select report_id, ingested_at, pos, list_concat(coalesce(b.propagation_chain, []), coalesce(b.affected_symbols, [])) as l from {_CHANGES} where b is not null)
select report_id, ingested_at, pos, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') as symbols from u""",
    "unique_change_ids": f"select project_id, any_value(report_id) as report_id, b.id as id, any_value(b.source) as source from {_CHANGES} where b is not null and b.id is not null group by project_id, b.id having count(*) = 1",
    "known_nodes": _NODES, "changed_seeds": _SEEDS, "unmounted_paths": _UNMOUNTED, "model_relations": _RELATIONS, "file_modules": _MODULES, "payload_checks": _PAYLOADS,
}

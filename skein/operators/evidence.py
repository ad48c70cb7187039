"""Evidence tables, indexes and reports over extracted facts.

``facts`` has file (repository, path) columns and kind, name, owner, value,
line.  All operators are joins, windows and aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.labels import file_layer, route_path, stable_id

#: Directories that hold modules, and directories named for a role.
MODULE_DIRS = ["modules", "features", "packages", "apps"]
ROLE_DIRS = ["controllers", "services", "repositories", "models", "routes", "middleware", "validators", "schemas", "entities"]


def module_key(path: Column) -> Column:
    """The directory after a modules directory, else the file's stem without its role in a role directory, else the first directory, else ``root``."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    after = F.filter(F.zip_with(dirs, F.slice(F.concat(dirs, F.array(F.lit(""))), 2, 1_000_000), lambda a, b: F.when(a.isin(MODULE_DIRS), b)), lambda x: x.isNotNull() & (x != ""))
    stem = F.regexp_replace(F.regexp_replace(F.element_at(parts, -1), r"\.[^.]+$", ""), r"(?i)[._-]?(controller|service|repository|model|routes?|middleware|validator|schema|entity)s?$", "")
    role = F.arrays_overlap(dirs, F.array(*(F.lit(r) for r in ROLE_DIRS)))
    return F.when(F.size(after) > 0, F.try_element_at(after, F.lit(1))).when(role & (stem != ""), F.lower(stem)).when(F.size(dirs) > 0, F.try_element_at(dirs, F.lit(1))).otherwise("root")


def modules(files: DataFrame) -> DataFrame:
    """(repository, module, path, files, n, type): files grouped by module key; frontend, infra or backend by what it holds."""
    f = files.where("path is not null").select("repository", module_key(F.col("path")).alias("module"), "path", file_layer(F.concat(F.lit("/"), "path")).alias("layer")).distinct()
    front = F.bool_or((F.col("layer") == "frontend") | F.col("path").rlike(r"\.(jsx|tsx|vue|svelte)$"))
    infra = F.bool_or(F.col("path").rlike(r"(?i)(^|/)(dockerfile[^/]*|[^/]*\.tf|docker-compose[^/]*|\.github/.*)$"))
    back = F.bool_or(F.col("path").rlike(r"\.(py|java|go|js|mjs|ts)$"))
    return f.groupBy("repository", "module").agg(F.min(F.regexp_replace("path", "/[^/]*$", "")).alias("path"), F.array_sort(F.collect_set("path")).alias("files"), F.countDistinct("path").alias("n"), F.when(front, "frontend").when(infra & ~back, "infra").otherwise("backend").alias("type"))


def api_surface(facts: DataFrame) -> DataFrame:
    """(repository, method, path, controller, auth, hash): endpoints merged over files; auth where any middleware of the route looks like it."""
    e = facts.where("kind = 'endpoint'").select("repository", F.substring_index("name", " ", 1).alias("method"), route_path(F.substring_index("name", " ", -1)).alias("path"), "name", F.col("path").alias("file"), "value", "line")
    mw = facts.where("kind = 'middleware'").groupBy("repository", F.col("path").alias("file"), F.col("owner").alias("name")).agg(F.bool_or(F.lower("name").rlike("auth|jwt|guard|role|permission|session|token")).alias("auth"))
    j = e.join(mw, ["repository", "file", "name"], "left")
    return j.groupBy("repository", "method", "path").agg(F.min(F.expr("nullif(value, '')")).alias("controller"), F.coalesce(F.bool_or("auth"), F.lit(False)).alias("auth"), F.count(F.lit(1)).alias("sites")).withColumn("hash", stable_id(64, method=F.col("method"), path=F.col("path")))


def import_edges(facts: DataFrame, files: DataFrame) -> DataFrame:
    """(repository, src, dst, type): imports resolved to files of the repository, else external packages.

    Relative imports are joined to the importing file's directory; candidates
    with the usual suffixes are equi-joined and the first that exists wins.  In
    Python leading dots climb packages, other modules are looked for from the root
    and from ``src``; what isn't found there is external.
    """
    imp = facts.where("kind = 'import'").select("repository", F.col("path").alias("src"), F.col("name").alias("target")).distinct()
    base = F.regexp_replace("src", "/?[^/]*$", "")
    python = F.col("src").endswith(".py")
    dots = F.length(F.regexp_extract("target", r"^(\.+)", 1))
    rel = F.when(python, dots > 0).otherwise(F.col("target").startswith("./") | F.col("target").startswith("../"))
    tail = F.replace(F.regexp_replace("target", r"^\.+", ""), F.lit("."), F.lit("/"))
    module = normalise(F.when(dots > 0, F.concat_ws("/", base, F.repeat(F.lit("../"), dots - 1), tail)).otherwise(tail))
    modules = F.array(*(F.concat(F.lit(root), module, F.lit(s)) for root in ("", "src/") for s in (".py", "/__init__.py")))
    joined = normalise(F.concat_ws("/", base, F.col("target")))
    cands = F.array(*(F.concat(joined, F.lit(s)) for s in ("", ".js", ".ts", ".jsx", ".tsx", ".mjs", ".py", "/index.js", "/index.ts")))
    tried = imp.select("*", rel.alias("rel"), F.posexplode_outer(F.when(python, F.when(dots > 0, F.slice(modules, 1, 2)).otherwise(modules)).when(rel, cands)).alias("pos", "cand"))
    known = files.select(F.col("repository").alias("_r"), F.col("path").alias("_p")).distinct()
    hit = tried.join(known, (F.col("repository") == F.col("_r")) & (F.col("cand") == F.col("_p")), "left")
    best = hit.groupBy("repository", "src", "target").agg(F.min_by("_p", F.when(F.col("_p").isNotNull(), F.col("pos"))).alias("file"), F.max("rel").alias("rel"))
    return best.select("repository", "src", F.coalesce("file", "target").alias("dst"), F.when(F.col("file").isNotNull(), "internal").when(F.col("rel"), "unresolved").otherwise("external").alias("type")).distinct()


def normalise(path: Column) -> Column:
    """Resolve ``.`` and ``..`` in a path."""
    parts = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    empty = F.expr("cast(array() as array<string>)")
    done = F.aggregate(parts, empty, lambda acc, s: F.when((s == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(s == "..", acc).otherwise(F.concat(acc, F.array(s))))
    return F.array_join(done, "/")


def call_edges(facts: DataFrame) -> DataFrame:
    """(repository, src, dst): calls resolved to functions, the first that fits.

    A call through ``this`` or ``self`` means a method of the caller's class in
    its file; a plain or dotted one a function of the same file under the called
    name, then the one function of the repository under that name.  A name that
    several files define stays unresolved.  Callers are ``path:owner``.  All ways
    are candidates with their place, joined once.
    """
    leaf = lambda c: F.element_at(F.split(F.regexp_replace(c, r"\(\)$", ""), r"\."), -1)
    defs = facts.where("kind in ('function', 'method')").select("repository", "path", F.col("name").alias("leaf"), "owner", F.concat_ws(":", "path", "name").alias("dst"))
    own = defs.where("owner <> ''").groupBy("repository", "path", "owner", "leaf").agg(F.min("dst").alias("dst")).select(F.concat_ws("\x1f", F.lit("1"), "repository", "path", "owner", "leaf").alias("at"), "dst")
    local = defs.groupBy("repository", "path", "leaf").agg(F.min("dst").alias("dst")).select(F.concat_ws("\x1f", F.lit("2"), "repository", "path", "leaf").alias("at"), "dst")
    unique = defs.groupBy("repository", "leaf").agg(F.countDistinct("dst").alias("n"), F.min("dst").alias("dst")).where("n = 1").select(F.concat_ws("\x1f", F.lit("3"), "repository", "leaf").alias("at"), "dst")
    owner = F.coalesce("owner", F.lit(""))
    calls = facts.where("kind = 'call'").select(
        "repository", "path", F.concat_ws(":", "path", F.when(owner == "", "module").otherwise(leaf(owner))).alias("src"), leaf("name").alias("leaf"),
        F.when(F.col("name").rlike("^(this|self)\\.") & owner.contains("."), F.element_at(F.split(owner, r"\."), 1)).alias("class"),
    ).distinct()
    ways = F.array(
        F.when(F.col("class").isNotNull(), F.concat_ws("\x1f", F.lit("1"), "repository", "path", "class", "leaf")), F.concat_ws("\x1f", F.lit("2"), "repository", "path", "leaf"), F.concat_ws("\x1f", F.lit("3"), "repository", "leaf")
    )
    tried = calls.select("repository", "src", "leaf", F.explode(ways).alias("at")).where("at is not null")
    hit = tried.join(own.unionByName(local).unionByName(unique), "at").groupBy("repository", "src", "leaf").agg(F.min_by("dst", "at").alias("dst"))
    return hit.where("src <> dst").select("repository", "src", "dst").distinct()


def architecture(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(repository, src_layer, dst_layer, edges, violation): internal imports by layer; a deeper layer that imports a higher one is a violation."""
    rank = F.create_map(*(F.lit(x) for kv in {"frontend": 0, "route": 1, "controller": 2, "middleware": 2, "service": 3, "repository": 4, "model": 5}.items() for x in kv))
    lay = lambda c: file_layer(F.concat(F.lit("/"), F.col(c)))
    g = edges.where("type = 'internal'").select("repository", lay("src").alias("src_layer"), lay("dst").alias("dst_layer"))
    a, b = F.try_element_at(rank, F.col("src_layer")), F.try_element_at(rank, F.col("dst_layer"))
    return g.groupBy("repository", "src_layer", "dst_layer").agg(F.count(F.lit(1)).alias("edges")).withColumn("violation", F.coalesce(a > b, F.lit(False)))


def search_index(facts: DataFrame) -> DataFrame:
    """(repository, name, type, path, line): one row per symbol with its least positive line, ordered fields first."""
    s = facts.where(F.col("kind").isin("function", "class", "method", "export", "endpoint"))
    return s.groupBy("repository", "name", F.col("kind").alias("type"), "path").agg(F.coalesce(F.min(F.when(F.col("line") > 0, F.col("line"))), F.lit(0)).alias("line"))


def tech_stack(facts: DataFrame) -> DataFrame:
    """(repository, slot, label): the first framework, database and test tool met in import order of paths."""
    # fixed values: packages that tell each slot
    marks = {
        "framework": {"express": "express", "fastify": "fastify", "koa": "koa", "@nestjs/common": "nestjs", "fastapi": "fastapi", "flask": "flask", "django": "django", "org.springframework": "spring"},
        "database": {"mongoose": "mongodb", "pg": "postgresql", "mysql2": "mysql", "sqlalchemy": "sql", "psycopg2": "postgresql", "redis": "redis"},
        "test": {"jest": "jest", "mocha": "mocha", "pytest": "pytest", "junit": "junit", "testing": "go test"},
    }
    spark = facts.sparkSession
    rows = [(slot, p, label) for slot, m in marks.items() for p, label in m.items()]
    known = spark.createDataFrame(rows, "slot string, package string, label string")
    imp = facts.where("kind = 'import'").select("repository", "path", F.when(F.col("name").startswith("org.springframework"), "org.springframework").otherwise(F.col("name")).alias("package"), "line")
    return imp.join(F.broadcast(known), "package").groupBy("repository", "slot").agg(F.min_by("label", F.struct("path", "line", "package")).alias("label"))


def quality_warnings(surface: DataFrame, edges: DataFrame) -> DataFrame:
    """(repository, warning, n): routes without controller, unresolved relative imports, paths with doubled slashes."""
    a = surface.where("controller is null").groupBy("repository").agg(F.count(F.lit(1)).alias("n")).select("repository", F.lit("route without controller").alias("warning"), "n")
    b = edges.where("type = 'unresolved'").groupBy("repository").agg(F.count(F.lit(1)).alias("n")).select("repository", F.lit("unresolved import").alias("warning"), "n")
    c = surface.where("path like '%//%'").groupBy("repository").agg(F.count(F.lit(1)).alias("n")).select("repository", F.lit("doubled slash").alias("warning"), "n")
    return a.unionByName(b).unionByName(c)


def report(findings: DataFrame, surface: DataFrame, mods: DataFrame, cap: int = 100) -> DataFrame:
    """(repository, document): one nested JSON document per repository, lists in a defined order, findings capped at ``cap``.

    The cap is the report's own; all rows are counted in the totals.
    """
    w = Window.partitionBy("repository").orderBy(F.col("severity_rank").desc(), "path", "change")
    top = findings.withColumn("k", F.row_number().over(w)).where(F.col("k") <= cap).groupBy("repository").agg(F.array_sort(F.collect_list(F.struct("k", "severity", "change", "path"))).alias("changes"))
    total = findings.groupBy("repository").agg(F.count(F.lit(1)).alias("total_changes"), F.max("severity_rank").alias("rank"))
    apis = surface.groupBy("repository").agg(F.count(F.lit(1)).alias("endpoints"), F.count_if("auth").alias("protected"))
    m = mods.groupBy("repository").agg(F.count(F.lit(1)).alias("modules"))
    doc = m.join(apis, "repository", "left").join(total, "repository", "left").join(top, "repository", "left")
    cols = [c for c in sorted(doc.columns) if c != "repository"]
    return doc.select("repository", F.to_json(F.struct("repository", *cols)).alias("document"))

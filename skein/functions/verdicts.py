"""Verdicts on files, middleware and reports as column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.labels import extension

#: Names, directories and beginnings that leave a file out, and extensions that let it in.
IGNORED_FILES = [".DS_Store", "Thumbs.db", ".gitignore", ".gitattributes", "package-lock.json", "yarn.lock", "Pipfile.lock", "poetry.lock"]
IGNORED_DIRS = [
    "dist", "__pycache__", "node_modules", ".git", ".idea", ".vscode", ".settings", "target", "build", "bin", "obj", ".gradle", ".mvn", "venv", "env", ".env", "coverage",
    ".nyc_output", ".pytest_cache", ".tox", "htmlcov", "eggs", ".eggs", "test", "tests", "__tests__", "fixtures", "migrations", "scripts", "examples", "docs",
]
CONFIG_BEGINNINGS = [
    "vite.config", "webpack.config", "eslint.config", "tailwind.config", "jest.config", "babel.config", "rollup.config", "postcss.config", "next.config", "nuxt.config",
    "playwright.config", "prettier.config", "tsconfig", "jsconfig",
]
SOURCE_EXTENSIONS = [".java", ".js", ".ts", ".py", ".jsx", ".tsx", ".go", ".rs", ".rb", ".php", ".c", ".cpp", ".cs"]
DATA_EXTENSIONS = [
    ".json", ".xml", ".yaml", ".yml", ".html", ".css", ".scss", ".less", ".md", ".txt", ".rst", ".sql", ".properties", ".gitignore", ".dockerignore", ".env", ".env.example",
    ".toml", ".ini", ".cfg",
]
BINARY_EXTENSIONS = [
    ".png", ".jpg", ".jpeg", ".gif", ".ico", ".svg", ".webp", ".pyc", ".pyo", ".pyd", ".log", ".tmp", ".temp", ".class", ".jar", ".war", ".ear", ".dll", ".exe", ".so", ".dylib",
    ".zip", ".gz", ".tar", ".rar", ".7z", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".woff", ".woff2", ".ttf", ".eot", ".otf", ".mp3", ".mp4", ".avi", ".mov", ".wav",
    ".db", ".sqlite", ".sqlite3",
]
CRITICAL_FILES = [
    "pom.xml", "build.gradle", "build.gradle.kts", "package.json", "requirements.txt", "setup.py", "pyproject.toml", "Dockerfile", "docker-compose.yml", "docker-compose.yaml",
    ".env", ".env.example", ".env.production", "application.properties", "application.yml", "application.yaml",
]
#: Beginnings and parts of paths that tell a component, in the order they are asked.
COMPONENT_BEGINNINGS = [("frontend", ["frontend/", "client/", "src/components/"]), ("backend", ["backend/", "server/", "src/routes/"])]
COMPONENT_PARTS = [("database", ["migration", "schema", "model", ".sql"]), ("infra", ["docker", "terraform", ".github/workflows", "deploy", "infra"])]
#: Words in a middleware's name that tell its type, in the order they are asked, and each type's severity.
MIDDLEWARE_WORDS = [
    ("cors", ["cors"]), ("auth", ["jwt", "passport", "auth", "authenticate", "verifytoken"]), ("rate_limiter", ["ratelimit", "limiter", "throttle"]),
    ("body_parser", ["json", "urlencoded", "bodyparser"]), ("logging", ["log", "morgan", "winston"]), ("error_handler", ["error"]),
]
MIDDLEWARE_SEVERITY = {"rate_limiter": "PATCH", "body_parser": "PATCH", "logging": "PATCH", "cors": "MINOR", "error_handler": "MINOR", "auth": "MAJOR"}
#: Words that tell tokens, roles and sessions among middleware names.
JWT_WORDS = ["jwt", "bearer", "passport", "token", "verify", "authenticate"]
ROLE_WORDS = ["rbac", "authorize", "authorization", "admin", "role", "permission", "acl", "access", "require", "check"]
SESSION_WORDS = ["sess"]
#: Signs of validators in source text.
VALIDATOR_SIGNS = [
    ("Joi", ["joi.object", "joi.validate", ".joi("]), ("express-validator", ["body(", "query(", "param(", "validationresult"]), ("Zod", ["z.object", "zoderror"]),
    ("Mongoose", ["schema(", "model(", ".validate("]),
]
#: Annotations that make a change of a Java file MAJOR.
JAVA_SIGNS = ["@RestController", "@Controller", "@RequestMapping", "@GetMapping", "@PostMapping", "@PutMapping", "@DeleteMapping", "@Entity", "@Table", "@Column"]
#: Documents that each type of repository needs; an ADR only where a change breaks.
DOCUMENTATION = {  # readme, API reference, architecture document, ADR
    "backend-service": (True, True, True, True), "frontend-app": (True, False, True, False), "infra-only": (True, False, False, False),
    "fullstack": (True, True, True, True), "cli": (True, False, True, False), "library": (True, False, True, True),
}


def contains_any(text: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(text, F.lit(w))
    return hit


def starts_with_any(text: Column, beginnings: list[str]) -> Column:
    hit = F.lit(False)
    for b in beginnings:
        hit = hit | text.startswith(b)
    return hit


def _cascade(text: Column, table: list[tuple[str, list[str]]], test, otherwise: Column | str) -> Column:
    (name, words), *rest = table
    c = F.when(test(text, words), name)
    for name, words in rest:
        c = c.when(test(text, words), name)
    return c.otherwise(otherwise)


def _glob(pattern: str) -> str:
    out = "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if c in "\\.+()^${}|[]" else c for c in pattern)
    return f"^{out}$"


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def _suffix(path: Column) -> Column:
    """The extension of the base name; a name that only begins with a dot has none."""
    return F.regexp_extract(F.lower(base_name(path)), r"[^.](\.[^.]*)$", 1)


def excluded(path: Column, more: list[str] | None = None) -> Column:
    """Is a file left out of the analysis: by name, by a directory, by a configuration's name or pattern, or by its extension."""
    flat = F.replace(path, F.lit("\\"), F.lit("/"))
    name = base_name(path)
    low = F.lower(name)
    dirs = F.array(*map(F.lit, IGNORED_DIRS))
    out = name.isin(IGNORED_FILES) | F.arrays_overlap(F.split(flat, "/"), dirs) | F.arrays_overlap(F.split(F.lower(flat), "/"), dirs)
    for p in more or []:
        out = out | path.rlike(_glob(p)) | name.rlike(_glob(p))
        if p.endswith("/"):
            out = out | F.array_contains(F.split(flat, "/"), p.rstrip("/"))
    out = out | starts_with_any(F.regexp_replace(low, r"(.)\.[^.]*$", "$1"), CONFIG_BEGINNINGS)
    return out | ~_suffix(path).isin(SOURCE_EXTENSIONS + DATA_EXTENSIONS)


def safe_to_read(path: Column) -> Column:
    """May a file be read as text: not left out by name or directory, and of no binary extension."""
    flat = F.replace(path, F.lit("\\"), F.lit("/"))
    left_out = base_name(path).isin(IGNORED_FILES) | F.arrays_overlap(F.split(flat, "/"), F.array(*map(F.lit, IGNORED_DIRS)))
    return ~left_out & ~_suffix(path).isin(BINARY_EXTENSIONS)


def critical(path: Column) -> Column:
    return base_name(path).isin(CRITICAL_FILES) | contains_any(F.lower(path), ["migration", "schema"])


def component(path: Column) -> Column:
    low = F.lower(path)
    return _cascade(low, COMPONENT_BEGINNINGS, starts_with_any, _cascade(low, COMPONENT_PARTS, contains_any, "backend"))


def file_severity(path: Column, schema_tags: Column, endpoints: Column, functions: Column, classes: Column, annotations: Column, decorators: Column, methods: Column) -> Column:
    """Severity of a changed file; tags, annotations and decorators are arrays, the others counts."""
    ext = extension(path)
    spring = F.exists(annotations, lambda a: contains_any(a, JAVA_SIGNS))
    web = F.exists(decorators, lambda d: contains_any(d, ["route", "api", "endpoint"]))
    some = lambda n: F.when(n > 0, "MINOR").otherwise("PATCH")
    return (
        F.when((F.size(schema_tags) > 0) | (endpoints > 0), "MAJOR")
        .when(ext == ".java", F.when(spring, "MAJOR").otherwise(some(methods)))
        .when(ext.isin(".ts", ".tsx", ".js", ".jsx"), some(functions))
        .when(ext == ".py", F.when(web, "MAJOR").when((classes > 0) | (functions > 2), "MINOR").otherwise("PATCH"))
        .when(ext == ".sql", "MAJOR").when(ext.isin(".yaml", ".yml", ".json", ".properties", ".env"), "MINOR").otherwise("PATCH")
    )


def severity_reason(schema_tags: Column, endpoints: Column, methods: Column, functions: Column) -> Column:
    text = F.concat_ws(
        "; ",
        F.when(F.size(schema_tags) > 0, F.concat(F.lit("Schema changes detected: "), F.array_join(schema_tags, ", "))),
        F.when(endpoints > 0, "API endpoint modifications"),
        F.when(methods > 0, F.concat(F.lit("Methods: "), methods, F.lit(" modified"))),
        F.when(functions > 0, F.concat(F.lit("Functions: "), functions, F.lit(" modified"))),
    )
    return F.when(text == "", "General code changes").otherwise(text)


def middleware_type(name: Column) -> Column:
    return _cascade(F.lower(name), MIDDLEWARE_WORDS, contains_any, "unknown")


def middleware_severity(kind: Column) -> Column:
    """Severity of a type of middleware; MINOR for the unknown."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in MIDDLEWARE_SEVERITY.items() for x in kv)), kind), F.lit("MINOR"))


def auth_label(tokens: Column) -> Column:
    """JWT with roles, JWT, session, roles or public, by words in middleware names."""
    text = F.lower(F.array_join(F.coalesce(tokens, F.array().cast("array<string>")), " "))
    jwt, role, session = (contains_any(text, w) for w in (JWT_WORDS, ROLE_WORDS, SESSION_WORDS))
    return F.when(jwt & role, "JWT+RBAC").when(jwt, "JWT").when(session, "Session").when(role, "RBAC").otherwise("Public")


def auth_basis(source: Column, inherited: Column, inferred: Column) -> Column:
    """Where a label comes from."""
    return F.when(inferred, "INFERRED").when(source == "AUTH_ANALYSIS", "AUTH_ANALYSIS").when(inherited, "ROUTE_RESOLUTION").otherwise("STATIC_DISCOVERY")


def auth_confidence(source: Column, inherited: Column, inferred: Column) -> Column:
    seen = source == "AUTH_ANALYSIS"
    return F.when(inferred, 0.85).when(seen & ~inherited, 1.0).when(seen, 0.95).when(inherited, 0.9).otherwise(0.8)


def route_confidence(parsed: Column, mounted: Column, auth: Column, schema: Column, unresolved: Column, no_auth: Column, base: float = 0.95) -> Column:
    """Confidence of a resolved route in hundredths, between 0 and 1."""
    cents = (
        F.when(parsed, round(base * 100)).otherwise(75) + F.when(mounted, 2).otherwise(0) + F.when(auth, 2).otherwise(0) + F.when(schema, 2).otherwise(0)
        - F.when(unresolved, 10).otherwise(0) - F.when(no_auth, 5).otherwise(0)
    )
    return F.least(F.greatest(cents, F.lit(0)), F.lit(100)) / 100


def validators(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.array(*(F.when(contains_any(low, signs), F.lit(name)) for name, signs in VALIDATOR_SIGNS)), lambda x: x.isNotNull())


def internal_package(name: Column) -> Column:
    return starts_with_any(name, ["./", "../", "src/", "app/"])


def operational_risk(score: Column) -> Column:
    return F.when(score > 40, "HIGH").when(score > 15, "MEDIUM").otherwise("LOW")


def blast_label(breaking: Column) -> Column:
    return F.when(breaking > 5, "APPLICATION").when(breaking > 0, "SERVICE").otherwise("LOCAL")


def complexity_score(files: Column, breaking: Column) -> Column:
    return F.least(F.lit(100.0), files * 0.1 + breaking * 2)


def documentation_needs(repository_type: Column, breaking: Column) -> Column:
    """Struct of the documents a repository needs; unknown types count as libraries."""
    fields = ("requires_readme", "requires_api_reference", "requires_architecture_doc", "requires_adr")
    row = lambda v: F.struct(*(F.lit(x).alias(f) if f != "requires_adr" else (F.lit(x) & breaking).alias(f) for f, x in zip(fields, v)))
    c = F.when(repository_type == "backend-service", row(DOCUMENTATION["backend-service"]))
    for kind in ("frontend-app", "infra-only", "fullstack", "cli"):
        c = c.when(repository_type == kind, row(DOCUMENTATION[kind]))
    return c.otherwise(row(DOCUMENTATION["library"]))

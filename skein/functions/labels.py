"""Labels, ids and normalisers as column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rank of each severity.
SEVERITY_RANK = {"PATCH": 1, "MINOR": 2, "MAJOR": 3}


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "MAJOR", 3).when(severity == "MINOR", 2).when(severity == "PATCH", 1).otherwise(0)


def severity_name(rank: Column) -> Column:
    return F.when(rank == 3, "MAJOR").when(rank == 2, "MINOR").when(rank == 1, "PATCH")


def canonical_json(**fields: Column) -> Column:
    """JSON with keys in alphabetical order and nulls left out."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))))


def stable_id(length: int = 16, **fields: Column) -> Column:
    return F.substring(F.sha2(canonical_json(**fields), 256), 1, length)


def versioned_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit("v1"), *parts), 256)


def route_path(path: Column) -> Column:
    """Leading slash, ``:name`` as ``{name}``, single slashes, no trailing slash."""
    p = F.regexp_replace(F.concat(F.lit("/"), F.coalesce(F.trim(path), F.lit(""))), r":([A-Za-z_][A-Za-z0-9_]*)(\([^)]*\))?", "{$1}")
    p = F.regexp_replace(F.regexp_replace(p, "/+", "/"), "(.)/$", "$1")
    return p


def path_params(path: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(path, F.lit(r"\{([A-Za-z_][A-Za-z0-9_]*)\}"), 1)))


def _any_in(text: Column, parts: list[str]) -> Column:
    hit = F.lit(False)
    for p in parts:
        hit = hit | F.contains(text, F.lit(p))
    return hit


#: Extensions of each category, in the order they are asked.
CATEGORY_EXTENSIONS = {
    "config": [".json", ".yaml", ".yml", ".xml", ".properties", ".toml", ".ini", ".env"],
    "source": [".java", ".js", ".ts", ".py", ".jsx", ".tsx", ".go", ".rs", ".rb", ".php", ".c", ".cpp", ".cs"],
    "style": [".css", ".scss", ".less", ".sass"],
}
DOC_EXTENSIONS = [".md", ".rst", ".txt", ".adoc"]


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def file_category(path: Column) -> Column:
    """test before doc before config, source and style; substrings decide the first two."""
    low, ext = F.lower(path), extension(path)
    c = F.when(_any_in(low, ["test", "spec"]), "test").when(ext.isin(DOC_EXTENSIONS) | F.contains(low, F.lit("doc")), "doc")
    for name, exts in CATEGORY_EXTENSIONS.items():
        c = c.when(ext.isin(exts), name)
    return c.otherwise("other")


#: Parts of a path that tell its layer, in the order they are asked.
LAYERS = [
    ("backup", ["backup"]), ("frontend", ["/frontend/", "/client/", "/ui/", "/web/"]), ("route", ["/routes/", ".routes."]), ("controller", ["/controllers/", ".controller."]),
    ("service", ["/services/", ".service."]), ("repository", ["/repositories/", ".repository."]), ("model", ["/models/", ".model."]), ("middleware", ["/middleware/", ".middleware."]),
    ("validator", ["/validators/", ".validator."]), ("utility", ["/utils/", ".utils.", "/util/", ".util."]), ("config", ["/config/", ".config."]),
]


def file_layer(path: Column) -> Column:
    low = F.replace(F.lower(path), F.lit("\\"), F.lit("/"))
    first, *rest = LAYERS
    c = F.when(_any_in(low, first[1]), first[0])
    for name, parts in rest:
        c = c.when(_any_in(low, parts), name)
    return c.otherwise("other")


def type_name(raw: Column) -> Column:
    """A field's type under one name."""
    # fixed values: spellings of each type
    names = {
        "string": ["str", "string", "varchar", "text", "char"], "int": ["int", "integer", "bigint", "smallint"], "number": ["number", "float", "double", "decimal"],
        "boolean": ["bool", "boolean"], "datetime": ["datetime", "timestamp"],
    }
    t = F.lower(F.trim(F.coalesce(raw, F.lit("unknown"))))
    c = F.when(F.contains(t, F.lit("objectid")), "objectid").when(t.endswith("[]") | t.startswith("list["), "array")
    for name, spellings in names.items():
        c = c.when(t.isin(spellings), name)
    return c.when(t == "", "unknown").otherwise(t)


#: Tags of schema statements in source text.
SCHEMA_TAGS = {
    "JPA_ENTITY": r"@Entity\b", "JPA_TABLE": r"@Table\b", "SQL_CREATE_TABLE": r"(?i)\bcreate\s+table\b", "SQL_ALTER_TABLE": r"(?i)\balter\s+table\b",
    "SQL_DROP_TABLE": r"(?i)\bdrop\s+table\b", "SQL_SELECT": r"(?i)\bselect\s+[\w*]", "PY_CLASS": r"(?m)^class\s+\w+", "JS_REQUIRE": r"\brequire\(", "GO_STRUCT": r"(?m)^type\s+\w+\s+struct\b",
}


def schema_tags(text: Column) -> Column:
    found = F.array(*(F.when(text.rlike(p), F.lit(t)) for t, p in SCHEMA_TAGS.items()))
    return F.array_sort(F.filter(found, lambda x: x.isNotNull()))

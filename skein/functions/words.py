"""Names as column builders: inflection, operation ids, symbols, literals, slugs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.labels import route_path

#: Plurals that no ending tells, with their singular, and back.
IRREGULAR_SINGULAR = {
    "people": "person", "users": "user", "activities": "activity", "companies": "company", "statistics": "statistic", "statuses": "status", "deliveries": "delivery",
    "data": "datum", "criteria": "criterion", "phenomena": "phenomenon",
}
IRREGULAR_PLURAL = {"person": "people", "user": "users", "activity": "activities", "company": "companies"}
#: Endings in the order they are asked; the first that fits is replaced.
SINGULAR_ENDINGS = [("^(..+)xes$", "$1x"), ("^(.+)ches$", "$1ch"), ("^(.+)shes$", "$1sh"), ("^(..+)ies$", "$1y"), ("^(..+)ves$", "$1f"), ("^(..+)oes$", "$1o"), ("^(..+[^sui])s$", "$1")]
PLURAL_ENDINGS = [("^(.*[^aeiou])y$", "$1ies"), ("^(.*(?:s|x|z|ch|sh))$", "$1es")]
#: Verb of each method.
VERBS = {"GET": "get", "POST": "create", "PATCH": "update", "PUT": "replace", "DELETE": "delete"}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _inflected(word: Column, irregular: dict[str, str], endings: list[tuple[str, str]], otherwise: Column) -> Column:
    known = F.try_element_at(F.create_map(*(F.lit(x) for kv in irregular.items() for x in kv)), word)
    c = F.when(known.isNotNull(), known)
    for pattern, by in endings:
        c = c.when(word.rlike(pattern), F.regexp_replace(word, pattern, by))
    return c.otherwise(otherwise)


def singular(word: Column) -> Column:
    """Lower case singular; ``resource`` for a blank word."""
    return let(F.lower(F.trim(word)), lambda low: F.when(low == "", "resource").otherwise(_inflected(low, IRREGULAR_SINGULAR, SINGULAR_ENDINGS, low)))


def plural(word: Column) -> Column:
    return let(F.lower(word), lambda low: _inflected(low, IRREGULAR_PLURAL, PLURAL_ENDINGS, F.concat(low, F.lit("s"))))


def capital(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 1 << 30))


def pascal(word: Column) -> Column:
    """Each part with a capital, tails kept; ``Resource`` where no part is left."""
    joined = F.array_join(F.transform(F.filter(F.split(word, "[^A-Za-z0-9]+"), lambda x: x != ""), capital), "")
    return let(joined, lambda j: F.when(j == "", "Resource").otherwise(j))


def is_param(segment: Column) -> Column:
    return segment.rlike(r"^\{.+\}$")


def _inner(param: Column) -> Column:
    return F.regexp_extract(param, r"^\{(.*)\}$", 1)


def meaningful_segments(path: Column) -> Column:
    """Segments without ``api`` and version numbers."""
    return F.filter(F.split(route_path(path), "/"), lambda s: (s != "") & (s != "api") & ~s.rlike("^v[0-9]+$"))


def operation_id(method: Column, path: Column) -> Column:
    """Verb, nouns and By-parameter of a route.

    ``GET /users`` is ``getUsers``, ``GET /users/{id}`` ``getUserById``, ``POST
    /users/{id}/roles`` ``createUserRole``, ``GET /users/{id}/roles``
    ``getUserRole``; a search endpoint is ``searchResources``; a path without
    words ``getResource``.
    """
    return let(meaningful_segments(path), lambda s: _operation_id(method, s))


def _operation_id(method: Column, segments: Column) -> Column:
    spots = F.filter(F.transform(segments, lambda s, i: F.when(~is_param(s), F.struct(s.alias("s"), i.alias("i")))), lambda x: x.isNotNull())
    up = F.upper(method)
    verb = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in VERBS.items() for x in kv)), up), F.lower(method))

    def named(n: Column) -> Column:
        one, by = F.concat(verb, pascal(n["one"])), lambda c: F.concat(F.lit("By"), pascal(c))
        two = F.concat(one, pascal(singular(n["second"]["s"])))
        later = F.get(F.filter(F.transform(segments, lambda s, i: F.when(is_param(s) & (i > n["second"]["i"]), _inner(s))), lambda x: x.isNotNull()), F.lit(0))
        return (
            F.when(n["first"].isNull(), "getResource")
            .when(F.lower(n["first"]["s"]) == "search", "searchResources")
            .when(n["second"].isNotNull() & up.isin("POST", "PUT", "PATCH", "DELETE"), two)
            .when(n["second"].isNotNull() & (up == "GET"), F.concat(two, F.coalesce(by(later), F.lit(""))))
            .when(up.isin("GET", "DELETE"), F.when(n["param"].isNotNull(), F.concat(one, by(n["param"]))).otherwise(F.concat(verb, pascal(plural(n["one"])))))
            .otherwise(one)
        )

    parts = let(
        spots,
        lambda x: F.struct(
            F.get(x, F.lit(0)).alias("first"), F.get(x, F.lit(1)).alias("second"), singular(F.get(x, F.lit(0))["s"]).alias("one"),
            F.get(F.transform(F.filter(segments, is_param), _inner), F.lit(0)).alias("param"),
        ),
    )
    return let(parts, named)


def strict_operation_id(name: Column) -> Column:
    """The name without words that repeat its verb or the word before: ``deleteRestaurantDelete`` is ``deleteRestaurant``."""
    def strict(n: Column) -> Column:
        verb = n["verb"]
        words = F.filter(F.regexp_extract_all(n["name"], F.lit("([A-Z][a-z]*)"), 1), lambda w: F.lower(w) != verb)
        kept = let(words, lambda ws: F.filter(ws, lambda w, i: (i == 0) | (F.lower(w) != F.lower(F.get(ws, i - 1)))))
        joined = let(F.array_join(kept, ""), lambda j: F.when(j == "", "Resource").otherwise(j))
        return F.when(n["name"] == "", "getResource").when(verb == "", n["name"]).otherwise(F.concat(verb, joined))

    return let(let(F.coalesce(name, F.lit("")), lambda n: F.struct(n.alias("name"), F.regexp_extract(n, "^([a-z]+)", 1).alias("verb"))), strict)


def route_summary(method: Column, path: Column) -> Column:
    """What a route does, in words: ``List Users``, ``Delete User By Id``."""
    def told(segments: Column) -> Column:
        nouns, named, up = F.filter(segments, lambda s: ~is_param(s)), F.exists(segments, is_param), F.upper(method)
        word = F.coalesce(F.when(up == "PATCH", F.get(nouns, F.lit(0))).otherwise(F.try_element_at(nouns, F.lit(-1))), F.lit("resource"))
        rest = F.array_join(F.transform(F.slice(nouns, 2, 1 << 20), capital), " ")
        return let(
            singular(word),
            lambda one: F.when((up == "GET") & ~named, F.concat(F.lit("List "), capital(plural(one)))).when(up == "POST", F.concat(F.lit("Create "), capital(one)))
            .when((up == "DELETE") & named, F.concat(F.lit("Delete "), capital(one), F.lit(" By Id"))).when(up == "PATCH", F.rtrim(F.concat(F.lit("Update "), capital(one), F.lit(" "), rest)))
            .otherwise(F.concat(F.initcap(method), F.lit(" "), capital(one))),
        )

    return let(F.filter(F.split(path, "/"), lambda s: (s != "") & ~s.isin("api", "v1", "v2", "v3")), told)


def _dotted(name: Column) -> tuple[Column, Column]:
    token = F.trim(F.coalesce(name, F.lit("")))
    return token, F.filter(F.split(token, r"\."), lambda p: p != "")


def symbol_leaf(name: Column) -> Column:
    """The last part of a dotted symbol, without call brackets."""
    token, _ = _dotted(name)
    bare = F.regexp_replace(token, r"\(\)$", "")
    return F.coalesce(F.try_element_at(F.filter(F.split(bare, r"\."), lambda p: p != ""), F.lit(-1)), bare)


def symbol_owner(name: Column) -> Column:
    """The first of three or more parts, else the one before the leaf, else the only one."""
    _, parts = _dotted(name)
    at = F.when(F.size(parts) == 2, -2).otherwise(1)
    return F.coalesce(F.try_element_at(parts, at), F.lit(""))


def controller_name(name: Column) -> Column:
    """Lower case without signs and without a final ``controller``: the key controllers are matched by."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"[._-]", ""), "controller$", "")


def literal_kind(expr: Column) -> Column:
    """Kind of a literal in source text: none, string, boolean, null, integer, fraction or code."""
    t = F.trim(F.coalesce(expr, F.lit("")))
    return (
        F.when(t == "", "none").when(t.rlike("""^("[^"]*"|'[^']*')$"""), "string").when(F.lower(t).isin("true", "false"), "boolean").when(F.lower(t) == "null", "null")
        .when(t.rlike(r"^-?\d+$"), "integer").when(t.rlike(r"^-?\d+\.\d+$"), "fraction").otherwise("code")
    )


def literal_text(expr: Column) -> Column:
    """The value of a literal as text: strings without quotes, nothing for ``null`` and blanks."""
    t, kind = F.trim(expr), literal_kind(expr)
    return F.when(kind.isin("none", "null"), F.lit(None)).when(kind == "string", F.regexp_replace(t, """^['"]|['"]$""", "")).when(kind == "boolean", F.lower(t)).otherwise(t)


def safe_name(text: Column) -> Column:
    """A file name: runs of other signs as one underscore."""
    c = F.regexp_replace(F.trim(text), "[^A-Za-z0-9._-]+", "_")
    return F.when(F.coalesce(c, F.lit("")) == "", "unknown").otherwise(c)


def safe_token(text: Column) -> Column:
    """A part of an id: each other sign as an underscore."""
    c = F.regexp_replace(F.trim(text), "[^A-Za-z0-9_./-]", "_")
    return F.when(F.coalesce(c, F.lit("")) == "", "unknown").otherwise(c)


def repo_slug(url: Column, host: str) -> Column:
    """``owner/name`` of a clone address at ``host``; null for others."""
    found = r"(?:^|[/@.])" + host.replace(".", r"\.") + r"[:/]+([^/]+)/([^/.]+)(?:\.git)?/?$"
    owner, name = F.regexp_extract(F.trim(url), found, 1), F.regexp_extract(F.trim(url), found, 2)
    return F.when((owner != "") & (name != ""), F.concat_ws("/", owner, name))


def generated_at(timestamp: Column, commit: Column) -> Column:
    """The commit's time, else the commit, else the epoch."""
    t, c = F.trim(F.coalesce(timestamp, F.lit(""))), F.coalesce(commit, F.lit(""))
    return F.when(t != "", t).when(~c.isin("", "error"), F.concat(F.lit("commit:"), c)).otherwise("1970-01-01T00:00:00Z")


def ordered_union(first: Column, second: Column) -> Column:
    """Values of both lists in the order first seen."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(first, none), F.coalesce(second, none)))

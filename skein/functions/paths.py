"""Column builders for file and route paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_path(path: Column) -> Column:
    """One spelling of a file path: trimmed, ``/`` only, no doubled slash, no leading ``./``."""
    p = F.regexp_replace(F.trim(path), r"[\\/]+", "/")
    return F.regexp_replace(p, r"^(\./)+", "")


def canonical_hash(value: Column) -> Column:
    """A digest without letter case, blanks and ``sha256:`` prefix; blank is null."""
    h = F.regexp_replace(F.lower(F.trim(value)), "^sha256:", "")
    return F.when(h != "", h)


def mount_suffix(mount: Column) -> Column:
    """A mount path as a suffix: ``/a/b`` with single slashes, ``''`` for null, blank and ``/``."""
    m = F.regexp_replace(F.coalesce(F.trim(mount), F.lit("")), r"\s*/[/\s]*", "/")
    m = F.regexp_replace(m, "^/|/$", "")
    return F.when(m == "", F.lit("")).otherwise(F.concat(F.lit("/"), m))

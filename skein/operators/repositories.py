"""What kind of repository a set of files is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.verdicts import base_name, contains_any

#: Parts and endings of paths, and signs in texts, that tell a side of a repository.
FRONTEND_PARTS, FRONTEND_ENDINGS = ["frontend/", "client/", "ui/", "web/"], [".tsx", ".jsx", "vite.config.ts", "vite.config.js", "next.config.js", "next.config.mjs"]
BACKEND_PARTS = ["backend/", "server/", "api/", "routes/", "controllers/", "services/"]
INFRA_PARTS, INFRA_ENDINGS = ["docker-compose", "/.github/workflows/", "terraform"], ["dockerfile", ".tf"]
SERVER_PACKAGES = ['"express"', '"koa"', '"fastify"', '"nestjs"']
FRONTEND_PACKAGES = ['"react"', '"next"', '"vite"', '"vue"', '"svelte"']
CLI_PACKAGES = ['"commander"', '"yargs"', '"oclif"', '"bin"']
CODE_ENDINGS = [".js", ".ts", ".jsx", ".tsx", ".mjs", ".cjs", ".py", ".java"]
EXPORT_SIGNS = ["module.exports", "export default", "export function", "export class", "__all__"]
SERVER_SIGNS = ["express()", "app.listen(", "fastapi(", "@restcontroller", "router.get(", "router.post("]
CLI_SIGNS = ["if __name__ == '__main__'", 'if __name__ == "__main__"', "argparse", "click.command", "def main("]


def repository_types(files: DataFrame, endpoints: DataFrame | None = None) -> DataFrame:
    """(repository, repository_type) from paths and whole texts; one aggregation of flags, map-side first.

    ``files``: repository, path, text.  ``endpoints``: repository and ``n``, the
    number of its known endpoints.  Blank paths count for nothing; a repository
    without any is a library.
    """
    low, text = F.lower(F.coalesce("path", F.lit(""))), F.lower(F.coalesce("text", F.lit("")))
    ends = lambda e: F.exists(F.array(*map(F.lit, e)), lambda x: low.endswith(x))
    there = F.trim(low) != ""
    infra = contains_any(F.concat(F.lit("/"), low), INFRA_PARTS) | ends(INFRA_ENDINGS)
    package, code = base_name(low) == "package.json", ends(CODE_ENDINGS)
    flags = {
        "frontend": contains_any(low, FRONTEND_PARTS) | ends(FRONTEND_ENDINGS), "backend": contains_any(low, BACKEND_PARTS), "infra": infra, "plain": ~infra,
        "express": package & contains_any(text, SERVER_PACKAGES), "view": package & contains_any(text, FRONTEND_PACKAGES),
        "cli": package & contains_any(text, CLI_PACKAGES) | code & contains_any(text, CLI_SIGNS), "exports": code & contains_any(text, EXPORT_SIGNS), "server": code & contains_any(text, SERVER_SIGNS),
    }
    g = files.groupBy("repository").agg(*(F.coalesce(F.bool_or(there & c), F.lit(False)).alias(k) for k, c in flags.items()))
    if endpoints is not None:
        known = endpoints.groupBy(F.col("repository").alias("_r")).agg(F.sum("n").alias("_n"))
        g = g.join(known, F.col("repository").eqNullSafe(F.col("_r")), "left").withColumn("server", F.col("server") | (F.coalesce("_n", F.lit(0)) > 0))
    serves = F.col("express") | F.col("server")
    kind = (
        F.when(F.col("frontend") & (F.col("backend") | serves), "fullstack").when(F.col("view") & ~serves & ~F.col("backend"), "frontend-app").when(serves, "backend-service")
        .when(F.col("infra") & ~F.col("plain"), "infra-only").when(F.col("cli"), "cli").when(F.col("exports"), "library").when(F.col("view"), "frontend-app")
        .when(F.col("backend"), "backend-service").otherwise("library")
    )
    return g.select("repository", kind.alias("repository_type"))

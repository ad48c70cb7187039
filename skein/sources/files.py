"""File trees, snapshot stores and report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Directories and names that are never analysed.
IGNORED_DIRS = ["node_modules", ".git", "dist", "build", "target", "__pycache__", ".venv", "venv", "coverage", ".next"]
ANALYSED = ["java", "js", "jsx", "mjs", "cjs", "ts", "tsx", "py", "go", "sql", "prisma", "json", "yaml", "yml", "xml", "properties", "toml"]


def file_tree(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, content, size): every file below ``root``; content is null where it isn't UTF-8.

    Spark's file scan leaves out files of no bytes, so an empty file has no row,
    as a missing one; joins on path should read a missing content as ''.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    base = root.rstrip("/") + "/"
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + base.replace("file://", "").replace(".", r"\."), "")
    return raw.select(rel.alias("path"), F.try_validate_utf8("content").alias("content"), F.col("length").alias("size"))


def analysed(files: DataFrame, path: str = "path") -> DataFrame:
    """Without ignored directories and unknown extensions; the filter needs the path only, so contents of other files are never read."""
    parts = F.split(F.col(path), "/")
    keep = ~F.arrays_overlap(parts, F.array(*(F.lit(d) for d in IGNORED_DIRS))) & F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(ANALYSED)
    return files.where(keep)


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change_type, renamed_from): ADDED, MODIFIED, DELETED, RENAMED (same content hash, one old path per new path)."""
    a, b = old.select(F.col("path").alias("op"), F.sha2("content", 256).alias("oh")), new.select(F.col("path").alias("np"), F.sha2("content", 256).alias("nh"))
    j = a.join(b, F.col("op") == F.col("np"), "full")
    same = j.where("op is not null and np is not null and not (oh <=> nh)").select(F.col("np").alias("path"), F.lit("MODIFIED").alias("change_type"), F.lit(None).cast("string").alias("renamed_from"))
    from pyspark.sql import Window

    pair = lambda c, h: F.row_number().over(Window.partitionBy(h).orderBy(c))
    gone = j.where("np is null").select("op", "oh").withColumn("k", pair("op", "oh"))
    came = j.where("op is null").select("np", "nh").withColumn("k2", pair("np", "nh"))
    m = gone.join(came, (F.col("oh") == F.col("nh")) & (F.col("k") == F.col("k2")), "full")
    kind = F.when(F.col("op").isNull(), "ADDED").when(F.col("np").isNull(), "DELETED").otherwise("RENAMED")
    moved = m.select(F.coalesce("np", "op").alias("path"), kind.alias("change_type"), F.when(kind == "RENAMED", F.col("op")).alias("renamed_from"))
    return same.unionByName(moved)


class BaselineStore:
    """Reports by (project, branch, commit), with an append-only commit log."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def save(self, reports: DataFrame) -> None:
        """``reports``: project, branch, commit, seq, and the report's columns.  Saving a commit again replaces it."""
        reports.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project", "branch", "commit").parquet(f"{self.root}/reports")

    def log(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/reports").groupBy("project", "branch", "commit").agg(F.min("seq").alias("seq"))

    def baseline(self, project: str, branch: str, commit: str) -> DataFrame:
        """The report of the commit before ``commit``; the newest other one where ``commit`` isn't stored."""
        mine = self.log().where((F.col("project") == project) & (F.col("branch") == branch))
        at = mine.where(F.col("commit") == commit).agg(F.max("seq").alias("at"))  # one row
        prev = mine.join(F.broadcast(at)).where((F.col("commit") != commit) & (F.col("at").isNull() | (F.col("seq") < F.col("at")))).agg(F.max_by("commit", "seq").alias("commit"))
        rows = self.spark.read.parquet(f"{self.root}/reports").where((F.col("project") == project) & (F.col("branch") == branch))
        return rows.join(F.broadcast(prev), "commit", "left_semi")


def write_json(df: DataFrame, path: str) -> None:
    """One document per line, keys in alphabetical order, nulls left out."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.mode("overwrite").text(path)


def last_json(lines: DataFrame, order: str = "line_no", text: str = "value") -> DataFrame:
    """The last line that is a JSON object: a report recovered from noisy output."""
    ok = lines.withColumn("_v", F.try_parse_json(text)).where(F.expr("schema_of_variant(_v) like 'OBJECT%'"))
    return ok.agg(F.max_by(text, order).alias("document"))

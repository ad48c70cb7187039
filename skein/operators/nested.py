"""Deeply nested records to related flat tables (problem 6).

One depth-first pass over a record emits tagged rows: table tag, primary key,
parent key, places in the arrays and the payload as JSON.  The rows are written
partitioned by tag; a table is read back from its partition with its schema.
The pass is one native expression per record, so it stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.storage import fresh_path

#: Child tables: tag, how their rows are reached, and payload schema.
SCHEMAS = {
    "report": "schema_version string, project_id string, tool_version string, generated_at string",
    "analysis_summary": "total_files bigint, highest_severity string, breaking_changes_detected boolean, severity_distribution map<string,int>",
    "context": "repository string, branch string, commit_sha string, author string",
    "affected_package": "item string",
    "breaking_change": "id string, source string, severity string, affected_symbols array<string>, propagation_chain array<string>",
    "symbol_mutation": "symbol_name string, file_path string, baseline_hash string, current_hash string",
    "contract_break": "endpoint string, change_type string, baseline_value string, current_value string, severity string",
    "middleware_break": "scope string, change_type string, middleware_name string, severity string, details map<string,string>",
}

#: The column of each element table that names its item.
ITEMS = {"affected_package": "item", "symbol_mutation": "symbol_name", "contract_break": "endpoint", "middleware_break": "middleware_name"}


def one_per_report(reports: DataFrame) -> DataFrame:
    """The earliest ingested delivery of each report.

    Aggregated map-side, so a report delivered very often is no hot group.  Rows
    without report_id are reports of their own unless equal in content.
    """
    body = ["project_id", "schema_version", "meta", "report", "breaking_changes"]
    # to_json gives a text to group by where report_id is missing; maps can't be grouped
    spare = F.when(F.col("report_id").isNull(), F.sha2(F.to_json(F.struct(*body)), 256))
    return (
        reports.select("report_id", spare.alias("_spare"), F.struct(*body).alias("_b"), "ingested_at")
        .groupBy("report_id", "_spare")
        .agg(F.min_by("_b", F.coalesce("ingested_at", F.lit("9999-12-31").cast("timestamp_ntz"))).alias("_b"))
        .select("report_id", "_spare", "_b.*")
    )


def _row(tag: str, change: Column, item: Column, payload: Column) -> Column:
    return F.struct(
        F.lit(tag).alias("tag"), change.cast("int").alias("change_no"), item.cast("int").alias("item_no"), payload.alias("payload")
    )


def _none() -> Column:
    return F.expr("cast(array() as array<struct<tag:string,change_no:int,item_no:int,payload:string>>)")


def _elements(tag: str, items: Column, change: Column, payload) -> Column:
    """Rows of the non-null elements of ``items``; places count null elements too."""
    rows = F.filter(
        F.transform(items, lambda x, i: F.when(x.isNotNull(), _row(tag, change, i + 1, payload(x)))), lambda r: r.isNotNull()
    )
    return F.coalesce(rows, _none())


def emit(reports: DataFrame) -> DataFrame:
    """(tag, report_id, pk, parent_pk, change_no, item_no, payload): all rows of all tables in one pass."""
    zero = F.lit(0)
    js = F.to_json
    head = F.array(
        _row("report", zero, zero, js(F.struct("schema_version", "project_id", F.col("meta.tool_version"), F.col("meta.generated_at"))))
    )
    opt = lambda tag, c: F.when(c.isNotNull(), F.array(_row(tag, zero, zero, js(c)))).otherwise(_none())

    def visit(c: Column, i: Column) -> Column:
        own = F.array(
            _row(
                "breaking_change",
                i + 1,
                zero,
                js(F.struct(c["id"].alias("id"), c["source"].alias("source"), c["severity"].alias("severity"), c["affected_symbols"].alias("affected_symbols"), c["propagation_chain"].alias("propagation_chain"))),
            )
        )
        below = [_elements(tag, c[arr], i + 1, js) for tag, arr in (("symbol_mutation", "symbol_mutations"), ("contract_break", "contract_breaks"), ("middleware_break", "middleware_breaks"))]
        return F.when(c.isNotNull(), F.concat(own, *below)).otherwise(_none())

    rows = F.concat(
        head,
        opt("analysis_summary", F.col("report.analysis_summary")),
        opt("context", F.col("report.context")),
        _elements("affected_package", F.col("report.affected_packages"), zero, lambda x: js(F.struct(x.alias("item")))),
        F.coalesce(F.flatten(F.transform("breaking_changes", visit)), _none()),
    )
    key = F.coalesce("report_id", "_spare")
    flat = reports.select("report_id", key.alias("_k"), F.explode(rows).alias("r")).select("report_id", "_k", "r.*")
    deep = F.col("tag").isin("symbol_mutation", "contract_break", "middleware_break")
    pk = F.concat_ws("/", "_k", "tag", "change_no", "item_no")
    parent = F.when(deep, F.concat_ws("/", "_k", F.lit("breaking_change"), "change_no", F.lit("0"))).when(
        F.col("tag") != "report", F.concat_ws("/", "_k", F.lit("report"), F.lit("0"), F.lit("0"))
    )
    return flat.select("tag", "report_id", pk.alias("pk"), parent.alias("parent_pk"), "change_no", "item_no", "payload")


def flat_tables(reports: DataFrame) -> dict[str, DataFrame]:
    """The flat tables by tag, each with report_id, pk, parent_pk, change_no, item_no and its own columns.

    Null structs, null and empty arrays and null elements give no rows; an empty input gives empty tables.
    """
    spark = reports.sparkSession
    path = fresh_path(spark, "tagged")
    emit(one_per_report(reports)).write.partitionBy("tag").parquet(path)
    layout = "report_id string, pk string, parent_pk string, change_no int, item_no int, payload string, tag string"
    tagged = spark.read.schema(layout).option("basePath", path).parquet(path)
    out = {}
    for tag, schema in SCHEMAS.items():
        rows = tagged.where(F.col("tag") == tag).withColumn("v", F.from_json("payload", schema))
        out[tag] = rows.select("report_id", "pk", "parent_pk", "change_no", "item_no", "v.*")
    return out


def report_items(reports: DataFrame) -> DataFrame:
    """(report_id, change_no, kind, item_no, item) over the four element tables."""
    tables = flat_tables(reports)
    parts = [
        tables[tag].select("report_id", "change_no", F.lit(tag).alias("kind"), "item_no", F.col(name).alias("item"))
        for tag, name in ITEMS.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

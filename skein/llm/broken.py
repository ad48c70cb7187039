"""Source files that do not parse (problem 1) over tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.paths import canonical_path
from skein.llm.syntax.files import EXTENSIONS, NAMES, cost_of


def _map(values: dict[str, str]):
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def languages(records: DataFrame) -> DataFrame:
    """(doc_id, language): one language per document.

    The newest record that names a known language decides (ties: the least
    name), else the extension of the newest record's path.  Documents of no
    known language are left out.  Aggregated map-side, so a document with very
    many records is no hot group.
    """
    name = F.try_element_at(_map(NAMES), F.lower(F.trim("language")))
    ext = F.try_element_at(_map(EXTENSIONS), F.lower(F.regexp_extract(canonical_path(F.col("file_path")), r"\.([A-Za-z0-9]+)$", 1)))
    when = F.coalesce(F.col("analyzed_at").cast("timestamp"), F.timestamp_seconds(F.lit(0)))
    rows = records.where("doc_id is not null").select("doc_id", name.alias("named"), ext.alias("ext"), when.alias("at"))
    best = rows.groupBy("doc_id").agg(
        F.max(F.when(F.col("named").isNotNull(), F.struct("at", "named"))).alias("n"), F.max(F.when(F.col("ext").isNotNull(), F.struct("at", "ext"))).alias("e")
    )
    return best.select("doc_id", F.coalesce("n.named", "e.ext").alias("language")).where("language is not null")


def _costs(track: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [cost_of(t, x, track) for t, x in zip(b["text"], b["language"])]
            out = b.drop(columns=["text"])
            out["cost"], out["kind"], out["first_line"], out["last_line"] = [list(x) for x in zip(*got)] if got else ([], [], [], [])
            yield out

    return run


def syntax_costs(docs: DataFrame, records: DataFrame, keep: list[str], track: bool) -> DataFrame:
    """``keep`` columns, language, cost, kind, first_line and last_line of every document with a known language.

    Where a document has no record, the extension of its own path decides.
    Null, empty and blank texts cost 0; repeated rows are judged each; extra
    columns aren't read.  Without ``track`` the cost only tells 0 from more.
    """
    lang = languages(records).withColumnRenamed("doc_id", "_doc")
    ext = F.try_element_at(_map(EXTENSIONS), F.lower(F.regexp_extract(canonical_path(F.col("file_path")), r"\.([A-Za-z0-9]+)$", 1)))
    own = docs.select(*dict.fromkeys([*keep, "doc_id", "file_path", "text"]))
    rows = own.join(lang, own["doc_id"] == lang["_doc"], "left").select(*keep, F.coalesce(lang["language"], ext).alias("language"), "text")
    rows = rows.where("language is not null")
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in [*keep, "language"])
    return rows.mapInPandas(_costs(track), f"{schema}, cost long, kind string, first_line long, last_line long")


def broken_files(docs: DataFrame, records: DataFrame) -> DataFrame:
    """(doc_id) of files with a nonzero edit cost."""
    return syntax_costs(docs, records, ["doc_id"], False).where("cost > 0").select("doc_id")


def broken_rates(docs: DataFrame, records: DataFrame) -> DataFrame:
    """(repository, language, files, broken, rate)."""
    return (
        syntax_costs(docs, records, ["doc_id", "repository"], False)
        .groupBy("repository", "language")
        .agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("cost") > 0).alias("broken"))
        .withColumn("rate", F.col("broken") / F.col("files"))
    )


def repairs(docs: DataFrame, records: DataFrame) -> DataFrame:
    """(doc_id, language, cost, kind, first_line, last_line) of the broken files."""
    return syntax_costs(docs, records, ["doc_id"], True).where("cost > 0")

"""Queries of the problems on text (1, 7, 8, 9, 10) and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.llm import broken, mix, origin, repetition, tokens


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _sources(spark, d):
    return _table(spark, d, "documents").where("source = 'source_code'")


def _declared(spark, d):
    return _table(spark, d, "documents").where("file_path like '%.gitattributes'").select("repository", "file_path", "text")


def p1_found(spark, d):
    return broken.broken_files(_sources(spark, d), _table(spark, d, "ast_records"))


def p1_rates(spark, d):
    return broken.broken_rates(_sources(spark, d), _table(spark, d, "ast_records"))


def p1_repairs(spark, d):
    return broken.repairs(_sources(spark, d), _table(spark, d, "ast_records"))


def p7_found(spark, d):
    return origin.file_origins(_sources(spark, d), _declared(spark, d)).where("origin is not null").select("doc_id")


def p7_origins(spark, d):
    return origin.file_origins(_sources(spark, d), _declared(spark, d))


def p8_ids(spark, d):
    return tokens.token_ids(_table(spark, d, "documents"))


def p8_round_trip(spark, d):
    """Per source: texts, tokens, and texts that decoding doesn't give back (none)."""
    docs = _table(spark, d, "documents").select("doc_id", "source", "text")
    ids = tokens.token_ids(docs)
    back = tokens.decoded(ids).withColumnRenamed("text", "again")
    # null-safe on both columns: a null text is decoded from the empty list
    return docs.join(back, "doc_id").groupBy("source").agg(
        F.count(F.lit(1)).alias("texts"),
        F.count_if(F.col("again") != F.coalesce("text", F.lit(""))).alias("differing"),
    )


def p9_mix(spark, d):
    return mix.mix(_table(spark, d, "documents"), _table(spark, d, "mix_targets"))


def p9_shares(spark, d):
    return mix.shares(_table(spark, d, "documents"), _table(spark, d, "mix_targets"))


def _prose(spark, d):
    return _table(spark, d, "documents").where("source is null or source <> 'source_code'")


def p10_found(spark, d):
    return repetition.document_repetition(_prose(spark, d)).where(F.col("share") >= repetition.LIMIT).select("doc_id")


def p10_shares(spark, d):
    return repetition.document_repetition(_prose(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_rates, p1_repairs, p7_found, p7_origins, p8_ids, p8_round_trip, p9_mix, p9_shares, p10_found, p10_shares)}

SQL = {
    "p8_round_trip": "select source, count(*) as texts, 0::bigint as differing from documents group by source",
}

"""Messages delivered more than once (problem 2).

A :class:`RunStore` keeps messages in hash-bucketed storage.  Each upsert writes
one sorted run per delivery run: inside a run equal identifiers are collapsed
before anything is shuffled (partial aggregation in every task), so an
identifier with a third of all rows arrives as one row per task.  Compaction
reads the buckets, where equal identifiers lie together without an exchange,
and merges the runs so that one row of each identifier remains.  An upsert is
idempotent: the winner is a minimum, and a run written again changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.storage import delete_path, fresh_path, path_exists


def uuid_key(event_id: Column) -> Column:
    """32 lower-case hex digits of a UUID in any spelling (blanks, case, braces,
    ``urn:uuid:``, no hyphens); the trimmed text where it is no UUID; null where
    it is null or shorter than 8 characters."""
    t = F.trim(F.regexp_replace(event_id, r"^\s+|\s+$", ""))
    h = F.regexp_replace(F.regexp_replace(F.lower(t), r"^urn:uuid:", ""), r"[{}\-]", "")
    key = F.when(h.rlike("^[0-9a-f]{32}$"), h).otherwise(F.concat(F.lit("="), t))
    return F.when(F.length(t) >= 8, key)


class RunStore:
    """Hash-bucketed, sorted runs of messages; the least ``order`` of a key wins.

    A store lives at ``path`` and can be opened again there, by another session
    too: its schema and number of buckets stand beside it.  Upserts append runs,
    :meth:`compact` reads one row of each key, :meth:`rewrite` leaves one sorted
    run, :meth:`close` takes the table off the catalogue (plans made from it go
    on), :meth:`drop` deletes the files.
    """

    def __init__(self, spark: SparkSession, keys: list[str], order: list[str], buckets: int | None = None, path: str | None = None):
        self.spark, self.keys, self.order = spark, keys, order
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = "skein_runs_" + uuid.uuid4().hex
        self.path = path or fresh_path(spark, "runs")
        self._written = path is not None and self._open()

    def upsert(self, rows: DataFrame, run: str) -> RunStore:
        """Add ``rows``; the column ``run`` tells which sorted run a row belongs to."""
        self._append(rows.groupBy(run, *self.keys).agg(F.min(self._ranked(rows.drop(run))).alias("_win")))
        return self

    def compact(self) -> DataFrame:
        """One row per key: the key columns, the order columns and the other columns."""
        return self._merged().select(*self.keys, "_win.*")

    def rewrite(self) -> RunStore:
        """The store with one run in place of all; a store elsewhere until the old one is dropped."""
        one = RunStore(self.spark, self.keys, self.order, self.buckets)
        one._append(self._merged())
        return one

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def drop(self) -> None:
        self.close()
        for path in (self.path, self._about):
            delete_path(self.spark, path)

    @property
    def _about(self) -> str:
        return self.path.rstrip("/") + "-about"

    def _merged(self) -> DataFrame:
        return self.spark.table(self.name).groupBy(*self.keys).agg(F.min("_win").alias("_win"))

    def _append(self, runs: DataFrame) -> None:
        out = (
            runs.repartition(self.buckets, *self.keys)
            .write.format("parquet")
            .bucketBy(self.buckets, *self.keys)
            .sortBy(*self.keys)
        )
        if self._written:
            out.mode("append").saveAsTable(self.name)
        else:
            out.option("path", self.path).saveAsTable(self.name)
            about = self.spark.createDataFrame([(self.spark.table(self.name).schema.json(), self.buckets)], "layout string, buckets int")
            about.coalesce(1).write.mode("overwrite").json(self._about)
            self._written = True

    def _open(self) -> bool:
        """Register the files at ``path`` again; False where nothing was written yet."""
        if not path_exists(self.spark, self._about):
            return False
        about = self.spark.read.schema("layout string, buckets int").json(self._about).head()
        self.buckets = about["buckets"]
        columns = self.spark._jvm.org.apache.spark.sql.types.DataType.fromJson(about["layout"]).toDDL()
        keys = ", ".join(f"`{k}`" for k in self.keys)
        self.spark.sql(f"CREATE TABLE {self.name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")
        return True

    def _ranked(self, rows: DataFrame) -> Column:
        """Order columns first (nulls last), then the remaining columns."""
        parts: list[Column] = []
        for c in self.order:
            parts += [F.col(c).isNull().alias(f"_null_{c}"), F.col(c)]
        rest = [c for c in rows.columns if c not in self.keys and c not in self.order]
        return F.struct(*parts, *rest)


def surplus_deliveries(
    rows: DataFrame,
    event_id: str = "eventId",
    correlation: str = "correlationId",
    received: str = "received_at",
    delivery: str = "delivery_id",
    batch: str = "batch_id",
    runs: int = 4,
) -> DataFrame:
    """``delivery`` of every row that repeats an earlier message.

    Same message: same UUID in any spelling and equal correlation (null equals
    null).  The earliest ``received`` stays (null last), then the lowest
    ``delivery``.  Null and short ids are never surplus.  Rows equal even in
    ``delivery`` count as one delivery.  An empty table gives no rows; columns
    beyond those named aren't read.
    """
    keyed = rows.select(
        uuid_key(F.col(event_id)).alias("_key"),
        F.col(correlation).alias("_corr"),
        F.col(received).alias("_received"),
        F.col(delivery).alias("_delivery"),
        F.pmod(F.xxhash64(F.col(batch)), F.lit(runs)).alias("_batch_run"),
    ).where(F.col("_key").isNotNull())
    store = RunStore(rows.sparkSession, ["_key", "_corr"], ["_received", "_delivery"])
    kept = store.upsert(keyed, run="_batch_run").compact().select(F.col("_delivery").alias("_kept"))
    store.close()
    # a delivery id is unique, so this join has no hot key
    return (
        keyed.select("_delivery")
        .join(kept, F.col("_delivery") == F.col("_kept"), "left_anti")
        .select(F.col("_delivery").alias(delivery))
    )


def distinct_messages(rows: DataFrame, delivery: str = "delivery_id", **names: str) -> DataFrame:
    """All rows but the surplus ones, with all their columns."""
    surplus = surplus_deliveries(rows, delivery=delivery, **names).withColumnRenamed(delivery, "_surplus")
    return rows.join(surplus, rows[delivery] == surplus["_surplus"], "left_anti")

"""What changed between full snapshots (problem 4).

The last arrived row of each file in a snapshot counts.  Each such row stands as
new in its own snapshot and as old in the one that follows.  ``EXCEPT ALL`` both
ways removes what is identical: it counts equal rows, new ones up and old ones
down (the form Catalyst gives every ``EXCEPT ALL``), so one count serves both
ways.  The residues of a key, one new and one old row at most, are then joined in
full to label additions, removals and changes.

All rows of a file lie in one partition from the start, so the last arrival, the
count and the join of the residues share a single exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.paths import canonical_hash, canonical_path
from skein.storage import materialize

#: Copies of the snapshot list where it isn't broadcast, so that a repository with a third of all rows is joined in so many tasks.
SALT = 16
#: Snapshots (of all repositories) up to which their list is broadcast, some 30 MB; longer lists are joined salted.
BROADCAST_SNAPSHOTS = 500_000


HEX = "^([0-9a-f]{2})+$"


def _digest(value: Column) -> Column:
    """A hash in half the room: its bytes where it is hexadecimal, marked apart from other texts."""
    h = canonical_hash(value)
    return F.when(h.rlike(HEX), F.concat(F.lit("h").cast("binary"), F.unhex(h))).otherwise(F.concat(F.lit("t").cast("binary"), h.cast("binary")))


def current_files(rows: DataFrame, hashed: bool = False) -> DataFrame:
    """The last arrived row per repository, snapshot and path; equal arrival goes by the greatest hashes
    (texts that are no hexadecimal digits above those that are).

    Rows without repository, snapshot number or path describe no file and are
    left out.  With ``hashed`` the hashes are bytes, for comparing only.
    """
    digest = _digest if hashed else canonical_hash
    clean = rows.select(
        "repository",
        "snapshot_no",
        canonical_path(F.col("file_path")).alias("file_path"),
        digest(F.col("content_hash")).alias("content_hash"),
        digest(F.col("symbol_graph_hash")).alias("symbol_graph_hash"),
        "arrived_at",
    ).where("repository is not null and snapshot_no is not null and file_path is not null")
    text = lambda c: [] if hashed else [(~F.col(c).rlike(HEX)).alias("_t_" + c)]
    last = clean.repartition("repository", "file_path").groupBy("repository", "snapshot_no", "file_path").agg(
        F.max(F.struct("arrived_at", *text("content_hash"), "content_hash", *text("symbol_graph_hash"), "symbol_graph_hash")).alias("r")
    )
    return last.select("repository", "snapshot_no", "file_path", "r.content_hash", "r.symbol_graph_hash")


def snapshot_list(rows: DataFrame) -> DataFrame:
    """(repository, snapshot_no, _prev, _next): the snapshots at hand with their neighbours, one row each."""
    w = Window.partitionBy("repository").orderBy("snapshot_no")
    return (
        rows.where("repository is not null and snapshot_no is not null and file_path is not null")
        .select("repository", "snapshot_no")
        .distinct()
        .withColumn("_next", F.lead("snapshot_no").over(w))
        .withColumn("_prev", F.lag("snapshot_no").over(w))
    )


def snapshot_changes(rows: DataFrame) -> DataFrame:
    """(repository, snapshot_no, file_path, change) against the previous snapshot at hand.

    Numbers may be missing: the previous snapshot is the next lower number of
    the repository.  A null hash differs from nothing.  A repository's first
    snapshot gives no rows; an empty table gives none.
    """
    files, numbers = current_files(rows, hashed=True), materialize(snapshot_list(rows), "snapshots")
    if numbers.count() <= BROADCAST_SNAPSHOTS:
        placed = files.join(F.broadcast(numbers), ["repository", "snapshot_no"])
    else:
        copies = numbers.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        placed = files.withColumn("_salt", F.pmod(F.hash("file_path"), F.lit(SALT))).join(copies, ["repository", "snapshot_no", "_salt"]).drop("_salt")
    new = F.when(F.col("_prev").isNotNull(), F.struct(F.col("snapshot_no").alias("no"), F.lit(1).alias("v")))
    old = F.when(F.col("_next").isNotNull(), F.struct(F.col("_next").alias("no"), F.lit(-1).alias("v")))
    sides = placed.select("repository", "file_path", "content_hash", "symbol_graph_hash", F.explode(F.array(new, old)).alias("side")).where("side is not null")
    sides = sides.select("repository", F.col("side.no").alias("snapshot_no"), "file_path", "content_hash", "symbol_graph_hash", "side.v")
    residues = sides.groupBy("repository", "snapshot_no", "file_path", "content_hash", "symbol_graph_hash").agg(F.sum("v").alias("v")).where("v <> 0")
    row = F.struct("content_hash", "symbol_graph_hash")
    both = residues.groupBy("repository", "snapshot_no", "file_path").agg(F.max(F.when(F.col("v") < 0, row)).alias("o"), F.max(F.when(F.col("v") > 0, row)).alias("n"))
    unlike = lambda c: F.coalesce(F.col(f"o.{c}") != F.col(f"n.{c}"), F.lit(False))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(unlike("content_hash") | unlike("symbol_graph_hash"), "changed")
    return both.select("repository", "snapshot_no", "file_path", change.alias("change")).where("change is not null")

"""Graph operators on edge tables (src, dst).

Iterative operators run level by level; each round's state is written to the
shared folder, so lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.storage import Rounds


def degree_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, fan_in, fan_out, instability, centrality, core, high_coupling, unstable) of every node.

    ``nodes`` has ``node``.  Edges are distinct pairs.  Instability is
    fan_out / (fan_in + fan_out), centrality (fan_in + fan_out) / (n - 1).
    """
    pairs = edges.select("src", "dst").distinct()
    both = pairs.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    deg = both.select("x.*").groupBy("node").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    n = nodes.agg(F.count(F.lit(1)).alias("n"))  # one row
    d = nodes.join(deg, "node", "left").select("node", F.coalesce("i", F.lit(0)).cast("long").alias("fan_in"), F.coalesce("o", F.lit(0)).cast("long").alias("fan_out"))
    total = F.col("fan_in") + F.col("fan_out")
    inst = F.when(total > 0, F.round(F.col("fan_out") / total, 2)).otherwise(F.lit(0.0))
    return d.join(F.broadcast(n)).select(
        "node", "fan_in", "fan_out", inst.alias("instability"),
        F.when(F.col("n") > 1, F.round(total / (F.col("n") - 1), 2)).otherwise(F.lit(0.0)).alias("centrality"),
        ((F.col("fan_in") > 2) & (inst < 0.5)).alias("core"), (F.col("fan_out") > 5).alias("high_coupling"), (inst >= 0.8).alias("unstable"),
    )


def references(edges: DataFrame) -> DataFrame:
    """(symbol, calls, called_by): sorted distinct neighbours either way."""
    pairs = edges.select("src", "dst").distinct()
    out = pairs.groupBy(F.col("src").alias("symbol")).agg(F.array_sort(F.collect_set("dst")).alias("calls"))
    back = pairs.groupBy(F.col("dst").alias("symbol")).agg(F.array_sort(F.collect_set("src")).alias("called_by"))
    empty = F.expr("array()").cast(out.schema["calls"].dataType)
    return out.join(back, "symbol", "full").select("symbol", F.coalesce("calls", empty).alias("calls"), F.coalesce("called_by", empty).alias("called_by"))


def reachable(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(seed, node, depth): every node with its least distance from each seed; a seed reaches itself at 0."""
    spark = edges.sparkSession
    pairs = edges.select("src", "dst").distinct()
    start = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("depth")).distinct()
    # each round's news are written once; what is known is their union
    kept = Rounds(spark, "reach", keep=1_000_000)
    known = fresh = kept.cut(start)
    depth = 0
    while (max_depth is None or depth < max_depth) and not fresh.isEmpty():
        depth += 1
        step = fresh.join(pairs, fresh["node"] == pairs["src"]).select("seed", F.col("dst").alias("node")).distinct()
        fresh = kept.cut(step.join(known, ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        known = spark.read.schema(start.schema).parquet(*kept.paths)
    return known


def levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, height): the longest path from each node to a leaf, cycles cut off (null height).

    Nodes without outgoing edges are peeled in rounds; the round a node goes in
    is its height.
    """
    spark = edges.sparkSession
    kept = Rounds(spark, "height")
    rest = kept.cut(edges.select("src", "dst").where("src <> dst").distinct())
    left = nodes.select("node").distinct()
    done = None
    height = 0
    open_nodes = Rounds(spark, "height-left")
    left = open_nodes.cut(left)
    parts = Rounds(spark, "height-done", keep=1_000_000)
    while True:
        gone = parts.cut(left.join(rest.select(F.col("src").alias("node")).distinct(), "node", "left_anti").withColumn("height", F.lit(height)))
        if gone.isEmpty():
            break
        done = gone if done is None else done.unionByName(gone)
        left = open_nodes.cut(left.join(gone, "node", "left_anti"))
        rest = kept.cut(rest.join(gone.select(F.col("node").alias("dst")), "dst", "left_anti"))
        height += 1
    never = left.withColumn("height", F.lit(None).cast("int"))
    return never if done is None else done.unionByName(never)


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): strongly connected components, named by their least node.

    Colouring: the least label spreads forward to a fixed point; within a
    colour, the nodes that reach the colour's own node backward are one
    component and leave; the rest goes on.
    """
    spark = edges.sparkSession
    pairs = edges.select("src", "dst").where("src <> dst").distinct()
    live_rounds, edge_rounds, out_rounds = Rounds(spark, "scc-live"), Rounds(spark, "scc-edges"), Rounds(spark, "scc-out", keep=1_000_000)
    live = live_rounds.cut(nodes.select("node").distinct())
    pairs = edge_rounds.cut(pairs)
    found = None
    while not live.isEmpty():
        state_rounds = Rounds(spark, "scc-colour")
        state = state_rounds.cut(live.withColumn("colour", F.col("node")).withColumn("moved", F.lit(True)))
        while not state.where("moved").isEmpty():
            push = state.where("moved").join(pairs, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("offer"))
            less = F.col("offer").isNotNull() & (F.col("offer") < F.col("colour"))
            state = state_rounds.cut(state.join(push, "node", "left").select("node", F.when(less, F.col("offer")).otherwise(F.col("colour")).alias("colour"), less.alias("moved")))
        colour = state.select("node", "colour")
        inside = (
            pairs.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("a")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("b")), "dst").where("a = b").select("src", "dst")
        )
        inside = edge_rounds.cut(inside)
        back = reachable(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")), colour.where("node = colour").select("node"))
        comp = out_rounds.cut(back.select("node", F.col("seed").alias("component")))
        found = comp if found is None else found.unionByName(comp)
        live = live_rounds.cut(live.join(comp, "node", "left_anti"))
        pairs = edge_rounds.cut(inside.join(comp.select(F.col("node").alias("src")), "src", "left_anti").join(comp.select(F.col("node").alias("dst")), "dst", "left_anti"))
    return found


def simple_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, max_depth: int = 6) -> DataFrame:
    """(path): every path without repeated nodes from a source to a target, at most ``max_depth`` edges; it stops at the first target."""
    pairs = edges.select("src", "dst").distinct()
    ends = targets.select(F.col("node").alias("_t")).distinct()
    walk = sources.select(F.array("node").alias("path"), F.col("node").alias("at")).distinct()
    found = None
    rounds = Rounds(edges.sparkSession, "paths", keep=1_000_000)
    for _ in range(max_depth):
        grown = walk.join(pairs, F.col("at") == F.col("src")).where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at"))
        grown = rounds.cut(grown)
        hit = grown.join(ends, F.col("at") == F.col("_t"), "left_semi").select("path")
        found = hit if found is None else found.unionByName(hit)
        walk = grown.join(ends, F.col("at") == F.col("_t"), "left_anti")
    return found

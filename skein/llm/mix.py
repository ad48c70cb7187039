"""Mixing sources to target weights (problem 9).

A source with ``T`` tokens that should give ``w`` tokens appears ``w / T`` times
on average.  The whole part is given to every document; the fractional part is
an inclusion probability, settled by the cube method: probabilities move along
the null space of the balancing constraints (token total and document total)
until each is 0 or 1.  The flight runs in blocks of bounded size side by side;
the two units a block can't settle fly on together in the next round, until one
block per source is left and its last two units are landed.
"""

from __future__ import annotations

import math
import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.tokens import DEFAULT_VOCABULARY, token_counts
from skein.storage import materialize

#: Expected units of a flight block; memory of a task stays bounded at any corpus size.
BLOCK = 20_000
EPS = 1e-9


def flight(prob: list[float], size: list[float], rng: random.Random) -> list[float]:
    """Move ``prob`` to 0 or 1, keeping its sum and its sum weighted by ``size``; two units at most stay between."""
    p = list(prob)
    queue = [i for i, x in enumerate(p) if EPS < x < 1 - EPS]
    queue.reverse()
    live: list[int] = []
    while True:
        while queue and len(live) < 3:
            live.append(queue.pop())
        if len(live) < 3:
            return p
        i, j, k = live
        a, b, c = size[i], size[j], size[k]
        u = (c - b, a - c, b - a)
        if u[0] == u[1] == u[2]:
            u = (1.0, -1.0, 0.0)
        up = down = 1e300
        for x, d in zip(live, u):
            if d > 0:
                up, down = min(up, (1 - p[x]) / d), min(down, p[x] / d)
            elif d < 0:
                up, down = min(up, p[x] / -d), min(down, (1 - p[x]) / -d)
        step = up if rng.random() * (up + down) < down else -down
        for x, d in zip(live, u):
            p[x] += step * d
            if p[x] < EPS:
                p[x] = 0.0
            elif p[x] > 1 - EPS:
                p[x] = 1.0
        live = [x for x in live if 0.0 < p[x] < 1.0]


def land(prob: list[float], rng: random.Random) -> list[float]:
    """Settle the few units left by systematic sampling: each keeps its probability, their number is off by less than one."""
    out, total, start = list(prob), 0.0, rng.random()
    for i, x in enumerate(prob):
        if 0.0 < x < 1.0:
            out[i] = float(math.floor(total + x - start) > math.floor(total - start))
            total += x
    return out


def plan(counts: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> list[dict]:
    """One entry per listed source: tokens at hand, wanted tokens, mean copies.

    Sources without target take no part; a listed source without tokens can't
    give any, and the shares of the others are scaled to fill the mix.  Repeated
    targets of a source add up; a null share is 0, null max_repeats is 1.  The
    default total is the largest at which no source exceeds max_repeats.  Only
    one row per listed source comes to the driver.
    """
    listed = targets.where("source is not null").groupBy("source").agg(
        F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("share"),
        F.greatest(F.max(F.coalesce("max_repeats", F.lit(1))), F.lit(0)).alias("cap"),
    )
    have = counts.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    rows = [r.asDict() for r in listed.join(have, "source", "left").orderBy("source").collect()]
    usable = [r for r in rows if r["tokens"] and r["share"] > 0 and r["cap"] > 0]
    scale = sum(r["share"] for r in usable)
    most = min((r["cap"] * r["tokens"] * scale / r["share"] for r in usable), default=0.0)
    total = most if total_tokens is None else total_tokens
    for r in rows:
        r["wanted"] = r["share"] / scale * total if r in usable else 0.0
        r["mean"] = min(r["wanted"] / r["tokens"], float(r["cap"])) if r in usable else 0.0
        r["tokens"], r["docs"] = r["tokens"] or 0, r["docs"] or 0
    return rows


def copies(counts: DataFrame, sources: list[dict], seed: int = 1, block: int = BLOCK) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of the documents in the mix.

    ``counts`` has doc_id, source, n_tokens and a unique text ``_u``; documents
    without tokens aren't in it.
    """
    mean = F.lit(None).cast("double")
    blocks = F.lit(1)
    for r in sources:
        mean = F.when(F.col("source") == r["source"], F.lit(r["mean"])).otherwise(mean)
        blocks = F.when(F.col("source") == r["source"], F.lit(-(-r["docs"] // block) or 1)).otherwise(blocks)
    base = counts.where("n_tokens > 0").withColumn("_mean", mean).where("_mean > 0")
    base = base.withColumn("_whole", F.floor(F.col("_mean") + EPS)).withColumn("p", F.greatest(F.col("_mean") - F.col("_whole"), F.lit(0.0)))
    units = base.where(F.col("p") > EPS).select("_u", F.xxhash64("_u").alias("_h"), "source", "n_tokens", "p").withColumn("_block", F.pmod("_h", blocks))
    layout = "_u string, _h long, source string, n_tokens long, p double"

    def fly(last: bool):
        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["_h", "_u"], ignore_index=True)
            size = [float(x) for x in pdf["n_tokens"]]
            rng = random.Random(f"{seed} {key}")
            p = flight(pdf["p"].tolist(), size, rng)
            pdf["p"] = land(p, rng) if last else p
            return pdf[["_u", "_h", "source", "n_tokens", "p"]]

        return run

    most = max([1, *(-(-r["docs"] // block) for r in sources)])
    settled: list[DataFrame] = []
    while True:
        last = most == 1
        moved = materialize(units.groupBy("source", "_block").applyInPandas(fly(last), layout), "flight")
        if last:
            settled.append(moved)
            break
        settled.append(moved.where("p = 0 or p = 1"))
        # two units of a block at most go on
        most = -(-2 * most // block)
        units = moved.where("p > 0 and p < 1").withColumn("_block", F.pmod(F.xxhash64("_h", F.lit(most)), F.lit(most)))
    taken = settled[0]
    for s in settled[1:]:
        taken = taken.unionByName(s)
    taken = taken.where("p = 1").select(F.col("_u").alias("_t"))
    # as many rows as the mix has fractional documents: never broadcast
    out = base.join(taken.hint("merge"), base["_u"] == taken["_t"], "left").withColumn("copies", (F.col("_whole") + F.col("_t").isNotNull().cast("int")).cast("int"))
    return out.where("copies > 0").select("doc_id", "source", "n_tokens", "copies")


def counted(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """Token counts, written once, with a key ``_u`` of each row made of its content, whatever the partitions.

    Rows equal in id, source and tokens are numbered among themselves.
    """
    plain = token_counts(docs, ["doc_id", "source"], vocabulary).groupBy("doc_id", "source", "n_tokens").agg(F.count(F.lit(1)).alias("_n"))
    rows = plain.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).drop("_n")
    return materialize(rows.withColumn("_u", F.to_json(F.struct("doc_id", "source", "n_tokens", "_k"))).drop("_k"), "counts")


def mix(docs: DataFrame, targets: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, total_tokens: int | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of every document in the mix.

    Null and empty texts have no tokens and take no part; repeated rows are
    documents of their own; no rows come out where no listed source has tokens.
    """
    counts = counted(docs, vocabulary)
    return copies(counts, plan(counts, targets, total_tokens))


def shares(docs: DataFrame, targets: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, total_tokens: int | None = None) -> DataFrame:
    """(source, target_share, available_tokens, wanted_tokens, mixed_tokens, reached_share, documents, copies) per listed source."""
    spark = docs.sparkSession
    counts = counted(docs, vocabulary)
    sources = plan(counts, targets, total_tokens)
    got = copies(counts, sources).groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed"), F.count(F.lit(1)).alias("docs"), F.sum("copies").alias("n")
    )
    rows = [(r["source"], float(r["share"]), int(r["tokens"]), float(r["wanted"])) for r in sources]
    want = spark.createDataFrame(rows, "source string, target_share double, available_tokens long, wanted_tokens double")
    both = want.join(got, "source", "left").withColumn("mixed_tokens", F.coalesce("mixed", F.lit(0)))
    # the report has one row per listed source
    total = both.agg(F.sum("mixed_tokens").alias("_all"))
    return both.join(F.broadcast(total)).select(
        "source", "target_share", "available_tokens", "wanted_tokens", "mixed_tokens",
        F.when(F.col("_all") > 0, F.col("mixed_tokens") / F.col("_all")).otherwise(0.0).alias("reached_share"),
        F.coalesce("docs", F.lit(0)).alias("documents"), F.coalesce("n", F.lit(0)).alias("copies"),
    )

"""Mixing sources to target weights by weighted fair queueing.

Every shuffled document gets a virtual finish time: the words of its source up
to and with it, over the source's weight; a source goes round as often as its
documents may be taken. The queue of all sources is sorted by that time in
ranges and cut where the total budget is used up. A source that has given all it
may leaves the rest of the queue to the others, so the cut deals its excess
again by weight. What a document at the cut leaves of its source's target goes
to those behind it in the queue that still fit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from nodeloom.llm.common import blocks_for, discard, prefix_sums, settle, word_count


def targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """sizes: source, source_size, one row per source (metadata: one row a
    source). Adds rank (by code point, null last) and target: share times all
    sizes, dealt by weight; what goes beyond most times the source's size is
    dealt again among the others; w, the weight.

    The water level follows from one sort by cap over weight: the sources below
    it are full, the others get level times weight.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())).cast("long") - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    capped = ranked.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    up = W.orderBy(F.col("cap") / F.col("w"), "rank")
    below, rest = up.rowsBetween(W.unboundedPreceding, -1), up.rowsBetween(0, W.unboundedFollowing)
    every = W.partitionBy(F.lit(1))
    left = F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(below), F.lit(0.0))
    level = capped.withColumn("level", left / F.sum("w").over(rest))
    first = level.withColumn("fit", F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct(F.col("cap") / F.col("w"), "level"))).over(every)["level"])
    return first.select("source", "rank", "source_size", "w", F.coalesce(F.least("cap", F.col("fit") * F.col("w")), F.col("cap")).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 17) -> DataFrame:
    """One row per row of docs: doc_id, size, source, source_size, target, taken.

    size is the number of words; a null text has none. Sources are ordered by
    code point, null last, and weigh as weights say, repeating. taken is size
    times the rounds (0 to most) in which the document made it. A document
    without words is never taken. The order within a source is that of a hash of
    doc_id, so that reruns agree. The first documents of the queue, as many as the
    budget (all targets together) holds, are taken; a source may so pass its target
    by a part of the last of them. Then documents that fit what is left of their
    source's target are taken too, in order, until nothing fits; rows that repeat a doc_id are rows of their own. Other columns are not read. An empty table gives an empty result.
    """
    meta = docs.select("doc_id", "source", word_count(F.col("text")).alias("size")).withColumn("h", F.xxhash64(F.col("doc_id"), F.lit(seed)))
    meta = settle(meta, "sizes")
    per = settle(targets(meta.groupBy("source").agg(F.sum("size").alias("source_size")), list(weights), share, most), "targets")
    n, budget = meta.count(), per.agg(F.sum("target")).first()[0] or 0.0

    keyed = meta.join(F.broadcast(per) if per.count() <= 100_000 else per, meta.source.eqNullSafe(per.source)).drop(per.source)
    cum = prefix_sums(keyed, ["rank"], "h", ["doc_id", "size"], "size", blocks_for(n, 1000), "before")
    queue = settle(cum, "queue")

    def finish(k: int) -> Column:
        return F.when(F.col("size") > 0, (F.col("before") + F.col("size") + k * F.col("source_size")) / F.col("w"))

    end = per.agg(F.max(F.col("source_size") * most / F.col("w"))).first()[0] or 1.0
    # Ranges of virtual time, about the square root of the rows of them.
    ranges = max(16, int(n**0.5))
    rounds = F.explode(F.array(*[F.struct(finish(k).alias("v"), F.lit(k).alias("k")) for k in range(most)])).alias("e")
    entries = queue.select("rank", "h", "doc_id", "size", rounds).select(F.floor(F.col("e.v") / F.lit(float(end)) * ranges).alias("r"), F.struct("e.v", "rank", "e.k", "h", "doc_id").alias("place"), "size").where("r is not null")
    sums = entries.groupBy("r").agg(F.sum("size").alias("words"))
    upto = sums.select("r", "words", F.sum("words").over(W.orderBy("r")).alias("upto"))
    over = upto.where(F.col("upto") > F.lit(budget)).agg(F.min(F.struct("r", (F.col("upto") - F.col("words")).alias("base"))).alias("o")).first()["o"]
    if over is None:
        taken = [F.when(finish(k).isNotNull(), 1).otherwise(0) for k in range(most)]
    else:
        at = W.orderBy("place").rowsBetween(W.unboundedPreceding, 0)
        edge = entries.where(F.col("r") == over["r"]).select("place", (F.sum("size").over(at) + F.lit(over["base"])).alias("upto"))
        last = edge.where(F.col("upto") <= F.lit(budget)).agg(F.max("place").alias("p")).first()["p"]

        def made(k: int) -> Column:
            v, r = finish(k), F.floor(finish(k) / F.lit(float(end)) * ranges)
            yes = r < F.lit(over["r"])
            if last is not None:
                own = F.struct(v.alias("v"), F.col("rank"), F.lit(k).alias("k"), F.col("h"), F.col("doc_id"))
                bar = F.struct(F.lit(last["v"]).alias("v"), F.lit(last["rank"]).cast("long").alias("rank"), F.lit(last["k"]).alias("k"), F.lit(last["h"]).cast("long").alias("h"), F.lit(last["doc_id"]).cast(dict(queue.dtypes)["doc_id"]).alias("doc_id"))
                yes = yes | ((r == F.lit(over["r"])) & (own <= bar))
            return F.when(yes, 1).otherwise(0)

        taken = [made(k) for k in range(most)]
    times = reduce(lambda x, y: x + y, taken).cast("long")
    cut = settle(queue.withColumn("times", times), "cut")
    few = per.count() <= 100_000

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if few else df

    # What is left of a source's target. It only falls, so that a document that is too large once stays out.
    left = settle(cut.groupBy("rank").agg(F.floor(F.max("target") - F.sum(F.col("size") * F.col("times"))).alias("short")), "left")
    fits = (F.col("times") < most) & (F.col("size") > 0) & (F.col("size") <= F.col("short"))
    able = settle(cut.select("rank", "before", "h", "doc_id", "size", "times").join(small(left), "rank").where(fits).drop("short"), "able")
    more = []
    while able.limit(1).count():
        # The rounds one after the other: up to the next document that does not fit, of those that could.
        first = settle(able.groupBy("rank").agg(F.min("times").alias("round")), "rounds")
        turn = able.join(small(first), "rank").where("times = round").drop("round")
        upto = prefix_sums(turn, ["rank"], "h", ["doc_id", "size"], "size", blocks_for(able.count(), 1000), "upto")
        got = settle(upto.join(small(left), "rank").where(F.col("upto") + F.col("size") <= F.col("short")).select("rank", "before", "size", F.lit(1).alias("more")), "fits")
        more.append(got.select("rank", "before", "more"))
        spent = got.groupBy("rank").agg(F.sum("size").alias("spent"))
        left = settle(left.join(spent, "rank").select("rank", (F.col("short") - F.col("spent")).alias("short")), "left")
        after = able.join(got.select("rank", "before", "more"), ["rank", "before"], "left").withColumn("times", F.col("times") + F.coalesce("more", F.lit(0))).drop("more")
        rest = settle(after.join(small(left), "rank").where(fits).drop("short"), "able")
        discard(able)
        able = rest
    if more:
        added = reduce(DataFrame.union, more).groupBy("rank", "before").agg(F.sum("more").alias("more"))
        # Only documents with words have a place of their own in the sums.
        with_words = F.when(F.col("size") > 0, F.coalesce("more", F.lit(0))).otherwise(0)
        cut = cut.join(added, ["rank", "before"], "left").withColumn("times", F.col("times") + with_words)
    return cut.select("doc_id", "size", "source", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"))

"""Importance resampling of documents towards a target distribution.

A position table holds each document's words by posexplode; lead() over a
document's window puts the following words beside each, which gives the runs of
words of every order. Their hashes deal features into buckets. How much more of
a bucket the target holds than the documents is its gain; a document's weight is
the mean gain of its features, and the documents are drawn without replacement
by the weight and a Gumbel number of their id.

Documents are dealt to tasks once, whole; the window needs no other shuffle. The
position table goes to the shared folder as bucket numbers, a row per word. Per
bucket only counts are added up. The order of the draw is a range partitioning,
numbered by the rows of the ranges before.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from nodeloom.llm.common import LOWER, UPPER, settle

#: What separates words, before A-Z become lower case.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
TASK_BYTES = 8 << 20  #: bytes of text that a task explodes into words
TASK_ROWS = 500_000  #: rows that a range of the draw holds


def _lower(word: Column) -> Column:
    """A-Z in lower case; a word of ASCII letters alone takes the faster way."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def position_table(docs: DataFrame, order: int, buckets: int) -> DataFrame:
    """row, doc_id and b1 .. b<order>: for each word of a row of docs, the bucket of
    the feature of each order that begins there (null where the text ends before);
    a text without words has one row of nulls."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = rows.repartition(max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES)), "row")
    words = dealt.select("row", "doc_id", F.filter(F.split("text", BETWEEN), lambda w: w != "").alias("words"))
    table = words.select("row", "doc_id", F.posexplode_outer("words").alias("position", "word")).withColumn("word", _lower(F.col("word")))
    following = W.partitionBy("row").orderBy("position")
    table = table.select("row", "doc_id", F.col("word").alias("w1"), *[F.lead("word", k).over(following).alias(f"w{k + 1}") for k in range(1, order)])
    # concat is null where one of the words is.
    runs = [reduce(lambda a, b: F.concat(a, F.lit(" "), b), [F.col(f"w{k}") for k in range(1, n + 1)]) for n in range(1, order + 1)]
    return table.select("row", "doc_id", *[(F.crc32(r.cast("binary")) % buckets).cast("int").alias(f"b{n}") for n, r in enumerate(runs, 1)])


def bucket_counts(positions: DataFrame, order: int, name: str) -> DataFrame:
    """bucket and how many features fall into it."""
    each = positions.select(F.explode(F.array(*[f"b{n}" for n in range(1, order + 1)])).alias("bucket")).where("bucket is not null")
    return each.groupBy("bucket").agg(F.count(F.lit(1)).alias(name))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """bucket and gain of every bucket: thousandths of the log ratio of its shares,
    each count raised by one, rounded down. At most buckets rows."""
    counts = settle(source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(source, "bucket", "left").join(target, "bucket", "left").fillna(0, ["s", "t"]), "counts")
    s, t = counts.agg(F.sum("s"), F.sum("t")).first()
    ratio = (F.col("t") + 1).cast("double") * F.lit(float((s or 0) + buckets)) / ((F.col("s") + 1).cast("double") * F.lit(float((t or 0) + buckets)))
    return counts.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def gumbel(doc_id: Column, seed: str) -> Column:
    """Thousandths of a Gumbel number of the id (a null id counts as an empty one), rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, by: list[Column], out: str) -> DataFrame:
    """Adds out: 1, 2, 3 .. in the order of by. Rows are dealt by ranges of the
    order, written, and numbered by the counts of the ranges before; no task
    holds more than a range."""
    n = rows.count()
    ranges = rows.repartitionByRange(max(1, -(-n // TASK_ROWS)), *by).sortWithinPartitions(*by)
    placed = settle(ranges.withColumn("_at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright(F.col("_at"), 33).cast("int")
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # a row per range
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(out, F.col("_before") + inside + 1).drop("_part", "_before", "_at")


def resample(docs: DataFrame, target: DataFrame, order: int = 2, buckets: int = 10_000, least_words: int = 20, percent: int = 25, seed: str = "7") -> DataFrame:
    """One row per row of docs: doc_id, n_features, weight, score, rank (all long).

    docs: doc_id and text; target: text. Words are runs of ASCII letters and
    digits and of all characters beyond ASCII, A-Z in lower case. Features are
    all runs of 1 to order words, repeats counted. A document without features
    has the weight 0. Of the documents with at least least_words words, percent
    in a hundred are drawn (rounded down), those of the highest scores; ties go
    to the smaller doc_id (null last), then to any; the others have a null rank.
    Null texts have no words. Rows that repeat a doc_id are documents of their
    own. An empty target gives gains by the documents' counts alone; empty docs
    an empty result. Other columns are not read.
    """
    columns = [f"b{n}" for n in range(1, order + 1)]
    positions = settle(position_table(docs.select("doc_id", "text"), order, buckets), "positions")
    aims = position_table(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), order, buckets)
    gain = F.broadcast(gains(bucket_counts(positions, order, "s"), bucket_counts(aims, order, "t"), buckets))  # at most buckets rows
    for b in columns:
        positions = positions.join(gain.select(F.col("bucket").alias(b), F.col("gain").alias(f"g{b}")), b, "left")
    total = reduce(lambda x, y: x + y, [F.coalesce(F.col(f"g{b}"), F.lit(0)) for b in columns])
    count = reduce(lambda x, y: x + y, [F.col(b).isNotNull().cast("int") for b in columns])
    own = positions.groupBy("row", "doc_id").agg(F.count("b1").alias("n_words"), F.sum(count).alias("n_features"), F.sum(total).alias("total"))
    weight = F.when(F.col("n_features") > 0, F.floor(F.col("total") / F.col("n_features"))).otherwise(0).cast("long")
    own = own.withColumn("weight", weight).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    own = settle(own.select("row", "doc_id", "n_words", "n_features", "weight", "score"), "scores")
    fit = F.coalesce(F.col("n_words") >= least_words, F.lit(False))
    n = own.where(fit).count()
    drawn = ranked(own.where(fit), [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")], "rank")
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= percent * n // 100, F.col("rank")))
    return drawn.unionByName(own.where(~fit).withColumn("rank", F.lit(None).cast("long"))).select("doc_id", "n_features", "weight", "score", "rank")

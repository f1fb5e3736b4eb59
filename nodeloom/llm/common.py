"""What the corpus operators share: tables in the shared folder, prefix sums
that no single task has to hold, and connected components."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: White space of the word contracts: U+0020 and U+0009 to U+000D.
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that
    is unset, a run within one process gets a temporary one; on a cluster it is
    an error, as each machine would have a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="nodeloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back. This cuts the
    lineage, and losing an executor costs no recomputation of what came before."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a settled table that nothing will read any more."""
    path = getattr(df, "_settled_at", None)
    if path:
        delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished queries now, not when the
    driver happens to collect its garbage, and executors give back the heap that
    they no longer use before Python workers need the memory. A task for each
    core asks for it; where one does not reach an executor, nothing is lost."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).selectExpr("reflect('java.lang.System', 'gc') as done").write.format("noop").mode("overwrite").save()


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 800, size: str = "6m"):
    """Rows go to Python so many, or so many bytes, at a time; what is run inside is bounded."""
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {name: spark.conf.get(name) for name in limits}
    try:
        for name, value in limits.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def lean(run, keeps: bool = False):
    """A function over a task's batches that gives the memory it held back to the
    system when it ends, as its worker process stays for other tasks. What tasks
    that keep something (keeps) left in the process goes when another task begins."""

    def wrapped(batches):
        import sys

        if not keeps:
            sys.__dict__.pop("_nodeloom_kept", None)
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            import pyarrow

            gc.collect()
            pyarrow.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


def few(df: DataFrame, most: int = 200_000) -> DataFrame:
    """A settled table of a few numbers a row as the small side of a join: sent to
    every task if it has at most so many rows (some MB), otherwise left to a shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ids_as_text(docs: DataFrame) -> DataFrame:
    """doc_id (as text) and text, for pandas: there, whole numbers beside a null
    would become floating point and lose their last digits."""
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")


def ids_as_numbers(made: DataFrame, kind: str = "long") -> DataFrame:
    """The reverse: doc_id as numbers again."""
    return made.withColumn("doc_id", F.col("doc_id").cast(kind))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, UPPER, LOWER)


def word_count(c: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def blocks_for(rows: int, per_block: int) -> int:
    """Bits of a hash prefix that deals rows into blocks of about per_block."""
    return max(1, (max(1, rows) // per_block).bit_length())


def prefix_sums(df: DataFrame, group: list[str], order: str, ties: list[str], weight: str, bits: int, out: str) -> DataFrame:
    """Adds out: the sum of weight over the rows of the group that come before
    in the order (order, *ties). order must be an evenly spread 64-bit hash.

    The rows of a group are dealt into 2**bits ranges of the hash; sums of the
    ranges are added up first, then each range adds up its own rows. A group of
    any size is so spread over many tasks.
    """
    dealt = df.withColumn("_block", F.shiftrightunsigned(F.col(order), 64 - bits))
    per = dealt.groupBy(*group, "_block").agg(F.sum(weight).alias("_sum"))
    before = W.partitionBy(*group).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    base = per.select(*group, "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = W.partitionBy(*group, "_block").orderBy(order, *ties).rowsBetween(W.unboundedPreceding, -1)
    joined = dealt.join(base, [*group, "_block"])
    return joined.withColumn(out, F.col("_base") + F.coalesce(F.sum(weight).over(inside), F.lit(0))).drop("_base", "_block")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that occurs in links; component is the
    smallest node that links reach.

    Every node hooks onto its smallest neighbour, if that is smaller; pointers
    jump until all show to their roots; links then lead from root to root, and
    the roots go on until no link is left. A root that still has links takes or
    is taken by another one, so that each round at least halves them, and a
    round's jumps grow with the logarithm of its longest chain. All passes are
    joins and aggregates on keys, each result is written to the shared folder.
    A hub's rows are spread: a pass only takes minima per key, which Spark adds
    up before it shuffles.
    """
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v"))
    edges = settle(both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct(), "edges")
    rounds = []
    while True:
        roots = settle(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "labels")
        while True:
            far = few(roots).select(F.col("u").alias("m"), F.col("m").alias("far"))
            new = settle(roots.join(far, "m").select("u", F.col("far").alias("m"), F.col("m").alias("was")), "labels")
            changed = new.where("m <> was").limit(1).count()
            discard(roots)
            roots = new
            if not changed:
                break
        rounds.append(roots)
        low = few(roots).select("u", "m")
        left = edges.join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("u")).join(low, "u").select(F.col("a").alias("u"), F.col("m").alias("v"))
        left = settle(left.where("u <> v").distinct(), "edges")
        discard(edges)
        edges = left
        if edges.limit(1).count() == 0:
            break
    discard(edges)
    # Back from the last round: the roots of a round are nodes of the next, or have no link any more.
    out = rounds.pop()
    while rounds:
        far = few(out).select(F.col("u").alias("m"), F.col("m").alias("far"))
        before = rounds.pop()
        new = settle(before.join(far, "m", "left").select("u", F.coalesce("far", "m").alias("m")), "labels")
        discard(before)
        discard(out)
        out = new
    return out.select(F.col("u").alias("node"), F.col("m").alias("component"))

"""Exact deduplication by a stateful stream.

The texts are written to a content table, each under a locator (the call that
wrote it; part file and place in it, in one number). A stream reads digest, identifier and
locator from there, in several micro-batches, and folds them into keyed state in
RocksDB that never expires: per digest the identifier that stays, the locator of
its content and the number of rows. Rows that hit a digest of another row have
their full bytes compared with the bytes that the state's locator leads to.
Where a folder is given, content and state stay there, and a later call goes on
from them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeloom.llm.common import ascii_lower, delete, few, new_path, settle

ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    # Many small stores: no space set aside on disk, and changes instead of snapshots in the log.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
BATCHES = 3  #: micro-batches that a call's content files are dealt into
ROWS_PER_STORE = 50_000  #: arrivals of a call for each store of the state, up to the shuffle partitions; each store has buffers of its own


def sha256_of(text: Column) -> Column:
    return F.sha2(text, 256)


def normalised(text: str = "text") -> Column:
    """A-Z in lower case; null counts as empty."""
    return ascii_lower(F.coalesce(F.col(text), F.lit("")))


def _files(spark, path: str, prefix: str = "part-") -> int:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    listed = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
    return sum(s.getPath().getName().startswith(prefix) for s in listed)


def fold_stream(spark, content: str, folder: str, kind: str, files_per_batch: int, rows: int) -> DataFrame:
    """Runs what the stream has not read yet of the content folder through the
    state in folder; one row per digest: digest, keep_id, locator, group_size.
    kind: the type of doc_id; rows: of the arrivals. The stream ends when it has read all files that
    are there; a later call with the same folders goes on from them."""
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    limits = ROCKS | {"spark.sql.shuffle.partitions": str(max(1, min(wanted, max(6, rows // ROWS_PER_STORE))))}
    before = {k: spark.conf.get(k, None) for k in limits}
    for k, v in limits.items():
        spark.conf.set(k, v)
    out = f"{folder}/updates"
    schema = f"doc_id {kind}, digest string, locator struct<call:int,place:long>"
    try:
        reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch)
        # max over (not null, id, locator): a row with an identifier beats one without.
        best = F.max(F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "locator"))
        state = reader.parquet(content).groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))

        def write(batch: DataFrame, number: int) -> None:
            batch.select("digest", "best.doc_id", "best.locator", "group_size", F.lit(number).alias("batch")).write.mode("overwrite").parquet(f"{out}/batch={number:09d}")

        query = state.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if not _exists(spark, out):
        return spark.createDataFrame([], f"digest string, keep_id {kind}, locator struct<call:int,place:long>, group_size long")
    updates = spark.read.schema(f"digest string, doc_id {kind}, locator struct<call:int,place:long>, group_size long, batch int").option("recursiveFileLookup", "true").parquet(out)
    last = updates.groupBy("digest").agg(F.max_by(F.struct("doc_id", "locator", "group_size"), "batch").alias("s"))
    return last.select("digest", F.col("s.doc_id").alias("keep_id"), "s.locator", "s.group_size")


def _exists(spark, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256_of, batches: int = BATCHES, folder: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only; a null text
    counts as empty. Of equal texts the row with the largest doc_id stays. A
    null doc_id loses to any other. Rows that repeat doc_id and text count each;
    all that carry the largest doc_id are marked kept. Other columns, whatever
    their names, are not read. An empty table gives an empty result. Rows of
    different text whose digest is the same are told apart by their bytes.

    folder: where the content and the state of earlier calls are and stay. The
    groups then hold the rows of all calls, of which only those of docs come back;
    doc_id has to have the same type in all calls.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    home = folder or new_path(spark, "dedup")
    earlier = _exists(spark, f"{home}/content")
    number = _files(spark, f"{home}/content", "call-") if earlier else 0
    here = f"{home}/content/call-{number:06d}"
    norm = docs.select("doc_id", normalised().alias("norm"))
    made = norm.select("doc_id", digest(F.col("norm")).alias("digest"), F.struct(F.lit(number).alias("call"), F.monotonically_increasing_id().alias("place")).alias("locator"), F.sha2("norm", 256).alias("text_sha256"), "norm")
    made.write.parquet(here)
    state = settle(fold_stream(spark, f"{home}/content", f"{home}/fold", kind, max(1, -(-_files(spark, here) // batches)), spark.read.parquet(here).count()), "state")
    content = spark.read.schema(made.schema).option("recursiveFileLookup", "true").parquet(f"{home}/content")

    # The hits, and the bytes that the state's locator leads to.
    hits = few(settle(state.where("group_size > 1"), "hits"), 50_000)
    members = content.join(hits.select("digest", F.col("locator").alias("at")), "digest").select("digest", "locator", "at", "norm")
    kept = content.join(hits.select(F.col("locator")), "locator", "left_semi").select(F.col("locator").alias("at"), F.col("norm").alias("kept_norm"))
    other = members.join(kept, "at").where(F.col("norm") != F.col("kept_norm"))
    clash = settle(other.select("digest").distinct(), "clash")

    mine = spark.read.schema(made.schema).parquet(here)
    shown = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"]
    rows = mine.select("doc_id", "digest", "text_sha256").join(hits.select("digest", "keep_id", "group_size"), "digest", "left")
    alone = F.col("group_size").isNull()
    rows = rows.select("digest", "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), "text_sha256")
    if clash.limit(1).count():
        # Digests that several texts have: groups by the bytes themselves.
        apart = content.join(clash, "digest", "left_semi")
        texts = apart.groupBy("digest", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        again = mine.join(clash, "digest", "left_semi").join(texts, ["digest", "norm"]).select("digest", "doc_id", "keep_id", "group_size", "text_sha256")
        rows = rows.join(clash, "digest", "left_anti").union(again)
    out = rows.select(*shown)
    if folder is None:
        out = settle(out, "exact")
        delete(spark, home)
    return out

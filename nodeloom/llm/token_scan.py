"""Token counts from flat token files without an index.

A token file is the ids of many documents one after the other, each closed by
an end-of-document id, and nothing says where a document begins. Files are read
as blocks of equal size. Each block is searched for the end id in one vectorised
comparison; documents that cross blocks are stitched with a prefix scan over the
blocks' (ends, tokens behind the last end).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from nodeloom.llm.common import ids_as_text, lean, settle, small_batches
from nodeloom.llm.tokens import WordIds, default_path

BLOCKS = "file string, block long, ids binary, doc_ids array<bigint>, first_doc long"


def write_flat(docs: DataFrame, path: str | None = None, eod: int = 49407, block_tokens: int = 1 << 16) -> DataFrame:
    """Tokenizes documents into flat files of blocks, in the shared folder: rows
    file, block, ids (little-endian unsigned 32-bit; every block but a file's
    last is full). Beside them, not in them, goes a manifest: doc_ids, the
    documents that were closed while the block was filled, in order, and
    first_doc, how many were closed before. A file is one task's share."""
    path = path or default_path()

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        name = f"part-{TaskContext.get().partitionId():06d}"
        ids, end = WordIds.shared(path, plain=True), np.asarray([eod], dtype="<u4").tobytes()
        size, block, held, closed, done = 4 * block_tokens, 0, bytearray(), [], 0
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
                held += ids.of(text) if isinstance(text, str) else b""
                held += end
                closed.append(None if doc is None else int(doc))
                while len(held) >= size:
                    rows.append((name, block, bytes(held[:size]), closed, done))
                    del held[:size]
                    block, done, closed = block + 1, done + len(closed), []
            if rows:
                yield pd.DataFrame(rows, columns=["file", "block", "ids", "doc_ids", "first_doc"])
        if held or closed:
            yield pd.DataFrame([(name, block, bytes(held), closed, done)], columns=["file", "block", "ids", "doc_ids", "first_doc"])

    with small_batches(docs.sparkSession):
        return settle(ids_as_text(docs).mapInPandas(lean(fill, keeps=True), BLOCKS), "flat")


def raw_blocks(spark, paths: list[str], block_tokens: int = 1 << 16, width: int = 4) -> DataFrame:
    """Blocks of raw flat files (unsigned little-endian ids of width bytes), read
    by byte ranges: a file of any size is dealt over many tasks. paths may be
    local or URIs of any store that pyarrow knows; the driver only asks for sizes.
    Bytes behind the last whole id are an error."""
    size = width * block_tokens

    def opened(path: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)

    rows = []
    for path in paths:
        store, local = opened(path)
        length = store.get_file_info(local).size
        if length is None or length % width:
            raise ValueError(f"{path}: not a file of whole ids")
        rows.append((path, length))
    files = spark.createDataFrame(rows, "file string, length long")
    ranges = files.select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("length") / size) - 1, F.lit(0)))).alias("block")).where("length > 0")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, block in zip(batch["file"], batch["block"], strict=True):
                store, local = opened(name)
                with store.open_input_file(local) as f:
                    f.seek(block * size)
                    ids = np.frombuffer(f.read(size), dtype=f"<u{width}").astype("<u4").tobytes()
                yield pd.DataFrame([(name, block, ids)], columns=["file", "block", "ids"])

    return ranges.repartition("file", "block").select("file", "block").mapInPandas(lean(read), "file string, block long, ids binary")


def scan(blocks: DataFrame, eod: int = 49407) -> DataFrame:
    """blocks: file, block, ids. One row per document: file, ordinal (in the
    file, from 0), start (its first token's place in the file), n_tokens (the end
    id not counted), closed (false for tokens behind a file's last end id).

    A document may span any number of blocks. Two ends in a row are an empty
    document. A file without tokens gives no row. Blocks are only searched in
    their own task; what is stitched is a few numbers per block.
    """

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, block, data in zip(batch["file"], batch["block"], batch["ids"], strict=True):
                ids = np.frombuffer(data, dtype="<u4")
                ends = np.flatnonzero(ids == eod)
                out.append((name, block, len(ids), len(ends), ends.astype(np.int64)))
            yield pd.DataFrame(out, columns=["file", "block", "n", "n_ends", "ends"])

    with small_batches(blocks.sparkSession, 64):
        found = settle(blocks.select("file", "block", "ids").mapInPandas(lean(search), "file string, block long, n long, n_ends long, ends array<bigint>"), "ends")
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("file")
    # Place in the file, documents closed before, and where the last end before the block lies.
    placed = found.select("file", "block", "n", "n_ends", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("at"), F.coalesce(F.sum("n_ends").over(before), F.lit(0)).alias("ordinal"), F.when(F.col("n_ends") > 0, F.element_at("ends", F.when(F.col("n_ends") > 0, -1).otherwise(1))).alias("last"))
    placed = placed.withColumn("end_before", F.coalesce(F.max(F.col("at") + F.col("last")).over(before), F.lit(-1)))
    placed = placed.withColumn("tokens", F.sum("n").over(whole)).withColumn("final", F.max(F.col("at") + F.col("last")).over(whole)).withColumn("final_block", F.max("block").over(whole))
    stitched = placed.join(found.select("file", "block", "ends"), ["file", "block"])
    rows = stitched.select("file", "at", "ordinal", "end_before", "ends", F.posexplode("ends").alias("k", "e"))
    start = F.when(F.col("k") == 0, F.col("end_before") + 1).otherwise(F.col("at") + F.col("before_e") + 1)
    rows = rows.withColumn("before_e", F.when(F.col("k") > 0, F.element_at("ends", F.greatest(F.col("k"), F.lit(1)))))
    docs = rows.select("file", (F.col("ordinal") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("at") + F.col("e") - start).alias("n_tokens"), F.lit(True).alias("closed"))
    opened = placed.where((F.col("block") == F.col("final_block")) & (F.coalesce("final", F.lit(-1)) + 1 < F.col("tokens")))
    tail = opened.select("file", (F.col("ordinal") + F.col("n_ends")).alias("ordinal"), (F.coalesce("final", F.lit(-1)) + 1).alias("start"), (F.col("tokens") - F.coalesce("final", F.lit(-1)) - 1).alias("n_tokens"), F.lit(False).alias("closed"))
    return docs.unionByName(tail)


def token_counts(docs: DataFrame, path: str | None = None, eod: int = 49407, block_tokens: int = 1 << 16) -> DataFrame:
    """One row per row of docs: doc_id, file, ordinal, start, n_tokens. Writes
    the flat files, scans them, and names the counts by the manifest. A null
    text counts as empty. Rows that repeat a doc_id are documents of their own.
    An empty table gives an empty result. Other columns are not read."""
    flat = write_flat(docs, path, eod, block_tokens)
    named = flat.select("file", "first_doc", F.posexplode("doc_ids").alias("k", "doc_id")).select("file", (F.col("first_doc") + F.col("k")).alias("ordinal"), "doc_id")
    return scan(flat, eod).join(named, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")

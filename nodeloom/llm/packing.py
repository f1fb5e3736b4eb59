"""Packing documents into sequences by vector best fit.

A sequence has three capacities: tokens, documents and attention cost (the sum
of squared lengths). Pieces are placed from the longest on; among the open
sequences that hold a piece under every constraint, the one with the smallest
residual norm after it (or the largest weighted dot product of the residual and
the piece) takes it.

What decides is only a piece's length. So the packing is made once for the
counts of the lengths, of which there are at most as many as a sequence has
tokens: sequences in the same state are held as one entry with a multiplicity.
The pieces then take the places of their length in the order of a hash, by ranks
that are counted in blocks. The plan is as good as packing all pieces in one
place, and no task holds more than a block.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.llm.common import blocks_for, ids_as_numbers, ids_as_text, lean, prefix_sums, settle, small_batches
from nodeloom.llm.tokens import WordIds, default_path

PIECES = "doc_id string, piece int, start long, length int, ids_crc32 long"


def pieces(docs: DataFrame, path: str, capacity: int, eod: int) -> DataFrame:
    """The pieces of every document: its ids and the end id, cut if it is longer
    than the capacity. A null text has the end id alone."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, end = WordIds.shared(path), np.asarray([eod], dtype="<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
                buffer = (ids.of(text) if isinstance(text, str) else b"") + end
                n = len(buffer) // 4
                for k, start in enumerate(range(0, n, capacity)):
                    part = buffer[4 * start : 4 * min(n, start + capacity)]
                    rows.append((doc, k, start, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return ids_as_numbers(ids_as_text(docs).mapInPandas(lean(cut, keeps=True), PIECES))


def plan(counts: dict[int, int], tokens: int, documents: int, attention: int, score: str = "residual_norm", weights: tuple[float, float, float] = (1.0, 0.1, 0.1)) -> list[tuple[int, int, int, int, int, int]]:
    """The places of each length: (length, first rank, last rank + 1, first
    sequence, pieces per sequence, offset). Rank r of the length goes to sequence
    first + (r - first rank) // per at offset + (r - first rank) % per * length.

    Sequences in one state (residual tokens, documents, attention) are one
    entry; when some of them take a piece the entry is split.
    """
    w = np.array(weights) / np.array([1.0, documents, attention]) * np.array([1.0 / tokens, 1.0, 1.0])
    full = (tokens, documents, attention)
    out: list[tuple[int, int, int, int, int, int]] = []
    # residual tokens -> {(documents, attention): [(first sequence, how many)]}
    opened: dict[int, dict[tuple[int, int], list[tuple[int, int]]]] = {}
    residuals: list[int] = []
    sequences = 0

    def put(state: tuple[int, int, int], run: tuple[int, int]) -> None:
        if state[0] <= 0 or state[1] <= 0 or state[2] <= 0:
            return
        if state[0] not in opened:
            opened[state[0]] = {}
            insort(residuals, state[0])
        opened[state[0]].setdefault(state[1:], []).append(run)

    def best(length: int) -> tuple[int, int, int] | None:
        need = (length, 1, length * length)
        found = None
        for i in range(bisect_right(residuals, length - 1), len(residuals)):
            r = residuals[i]
            tight = None
            for d, a in opened[r]:
                if d < 1 or a < need[2]:
                    continue
                left = np.array([r, d, a], dtype=float)
                s = float((w * w * (left - need) ** 2).sum()) if score == "residual_norm" else -float((w * w * left * need).sum())
                if tight is None or (s, d, a) < tight[0]:
                    tight = ((s, d, a), (r, d, a))
            if tight and (found is None or tight[0] < found[0]):
                found = tight
            # The norm grows with the residual tokens: the first that fit are the best but for the small other terms.
            if found and (score == "residual_norm" and i + 1 < len(residuals) and (w[0] * (residuals[i + 1] - length)) ** 2 > found[0][0]):
                break
        return found[1] if found else None

    for length in sorted(counts, reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            state = best(length)
            if state is None:
                per = max(1, min(tokens // length, documents, attention // (length * length) if length else documents))
                whole = todo // per
                if whole:
                    out.append((length, rank, rank + whole * per, sequences, per, 0))
                    put((full[0] - per * length, full[1] - per, full[2] - per * length * length), (sequences, whole))
                    sequences, rank, todo = sequences + whole, rank + whole * per, todo - whole * per
                if todo:
                    out.append((length, rank, rank + todo, sequences, todo, 0))
                    put((full[0] - todo * length, full[1] - todo, full[2] - todo * length * length), (sequences, 1))
                    sequences, todo = sequences + 1, 0
                continue
            runs = opened[state[0]][state[1:]]
            first, n = runs.pop()
            if not runs:
                del opened[state[0]][state[1:]]
                if not opened[state[0]]:
                    del opened[state[0]]
                    residuals.remove(state[0])
            offset = tokens - state[0]
            # As many pieces in each sequence of the run as fit, while the best fit stays here.
            per = max(1, min(state[0] // length, state[1], state[2] // (length * length)))
            if todo >= per:
                use = min(n, todo // per)
            else:
                per, use = todo, 1
            out.append((length, rank, rank + use * per, first, per, offset))
            put((state[0] - per * length, state[1] - per, state[2] - per * length * length), (first, use))
            if use < n:
                put(state, (first + use, n - use))
            rank, todo = rank + use * per, todo - use * per
    return out


def pack(docs: DataFrame, path: str | None = None, capacity: int = 4096, eod: int = 1, documents: int | None = None, attention: int | None = None, score: str = "residual_norm") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Only documents of more than capacity tokens are cut. documents and attention
    bound a sequence too; by default they are as wide as the tokens allow, so
    that the sequences are as few as the fit can make them. A null text is empty:
    its piece is the end id. Rows that repeat a doc_id are documents of their
    own. An empty table gives an empty result. Other columns are not read.
    """
    documents, attention = documents or capacity, attention or capacity * capacity
    with small_batches(docs.sparkSession):
        made = settle(pieces(docs, path or default_path(), capacity, eod).withColumn("h", F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id())).withColumn("one", F.lit(1)), "pieces")
    counts = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    places = pd.DataFrame(plan(counts, capacity, documents, attention, score), columns=["length", "lo", "hi", "seq", "per", "offset"]).sort_values(["length", "lo"])
    by = {int(k): g[["lo", "seq", "per", "offset"]].to_numpy(dtype=np.int64).T for k, g in places.groupby("length")}
    ranked = prefix_sums(made, ["length"], "h", ["doc_id", "piece"], "one", blocks_for(max(counts.values(), default=1), 500), "rank")  # as many blocks as the commonest length needs

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            seq, off = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                lo, first, per, offset = by[int(x)]
                k = np.searchsorted(lo, rank[at], side="right") - 1
                past = rank[at] - lo[k]
                seq[at] = first[k] + past // per[k]
                off[at] = offset[k] + past % per[k] * x
            yield batch[["doc_id", "piece", "start", "length", "ids_crc32"]].assign(sequence_id=seq, offset=off)

    placed = ranked.select(F.col("doc_id").cast("string").alias("doc_id"), "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "rank").mapInPandas(lean(place), "doc_id string, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return ids_as_numbers(placed)

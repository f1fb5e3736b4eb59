"""Periodic runs of words, by suffix trees.

A run is a stretch of words that repeats with a period and that no neighbouring
word extends. The texts of a batch share one suffix tree, in which no two texts
have a word in common: suffixes are sorted by doubling, the common prefixes of
neighbours give the tree's nodes as intervals of leaves. A node of depth d holds
a branching tandem repeat of period d wherever two of its leaves lie d words
apart in different children; it is enough to look at the leaves outside the
largest child (the smaller-half traversal of Stoye and Gusfield), which are
n log n at most. A branching repeat is where its run ends; rotating it to the
left as far as the period holds gives the whole run, and repeats that come to
the same place are merged into one run under its smallest period.

All steps work on arrays over the batch's words. A text is never cut: memory
grows with the longest one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeloom.llm.common import lean

ROUNDS = 64  #: pointer jumps before the rest is found in a table of minima


class Suffixes:
    """Sorted suffixes of symbols; no symbol may occur in two texts, so that what
    is common never leaves a text. level[k] tells stretches of 2**k symbols apart."""

    def __init__(self, symbols: np.ndarray, ends: np.ndarray):
        """ends: for each place, where its text ends."""
        n = len(symbols)
        self.order = np.argsort(symbols, kind="stable")
        sorted_ = symbols[self.order]
        begins = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if n else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[begins, n])
        rank = np.full(n + 1, -1, np.int64)
        rank[self.order] = np.repeat(begins, sizes)
        self.level = [rank.astype(np.int32)]
        open_ = np.flatnonzero(np.repeat(sizes > 1, sizes))
        step = 1
        while len(open_):
            at = self.order[open_]
            beyond = at + step
            follows = np.where(beyond < ends[at], rank[np.minimum(beyond, n)], -1)
            both = rank[at] * (n + 1) + follows + 1
            by = np.argsort(both, kind="stable")
            at, both = at[by], both[by]
            self.order[open_] = at
            first = np.r_[True, both[1:] != both[:-1]]
            begins = np.flatnonzero(first)
            sizes = np.diff(np.r_[begins, len(at)])
            rank[at] = np.repeat(open_[begins], sizes)
            self.level.append(rank.astype(np.int32))
            open_ = open_[np.repeat(sizes > 1, sizes)]
            step *= 2
        self.rank = rank

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols are the same from a and from b on."""
        a, b = np.array(a), np.array(b)
        long = np.zeros(len(a), np.int64)
        for k in range(len(self.level) - 1, -1, -1):
            same = self.level[k][a] == self.level[k][b]
            step = same.astype(np.int64) << k
            a, b, long = a + step, b + step, long + step
        return long


def nearest_low(values: np.ndarray) -> np.ndarray:
    """For each place, the nearest one before it whose value is not greater (0 if there is none)."""
    n = len(values)
    low = np.maximum(np.arange(n) - 1, 0)
    todo = np.flatnonzero(values[low] > values)
    todo = todo[todo > 0]
    for _ in range(ROUNDS):
        if not len(todo):
            return low
        low[todo] = low[low[todo]]
        todo = todo[(values[low[todo]] > values[todo]) & (low[todo] > 0)]
    if len(todo):  # long ramps: minima of blocks of 2**k values
        table = [values]
        while 2 ** len(table) <= n:
            before, half = table[-1], 2 ** (len(table) - 1)
            table.append(np.minimum(before[:-half], before[half:]))
        at = low[todo]  # all from at + 1 on is greater
        for k in range(len(table) - 1, -1, -1):
            begin = at - 2**k + 1
            ok = begin >= 0
            ok[ok] = table[k][begin[ok]] > values[todo[ok]]
            at = np.where(ok, at - 2**k, at)
        low[todo] = np.maximum(at, 0)
    return low


def branching_repeats(tree: Suffixes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of every branching tandem repeat: two equal stretches of
    period symbols side by side, the second followed by another symbol than the first."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n < 2:
        return none
    order, rank = tree.order, tree.rank
    depth = np.full(n + 1, -1, np.int64)  # common prefix with the leaf before; below all at both ends
    near = 1 + np.flatnonzero(tree.level[0][order[1:]] == tree.level[0][order[:-1]])
    if not len(near):
        return none
    depth[1:n] = 0
    depth[near] = tree.common(order[near - 1], order[near])
    left = nearest_low(depth)
    right = n - nearest_low(depth[::-1].copy())[::-1]
    # A child of a node begins at each place that has the node's depth; the first child begins before the first such place.
    head = depth[left[near]] < depth[near]
    node = np.arange(n + 1)
    node[near[~head]] = left[near[~head]]
    close = right.copy()  # where the node's last child ends
    same = near[depth[right[near]] == depth[near]]
    while len(same):
        close[same] = close[close[same]]
        same = same[depth[close[same]] == depth[same]]
    while True:
        up = node[node]
        if (up == node).all():
            break
        node = up
    firsts = near[head]
    of = np.concatenate([node[near], firsts])
    begin = np.concatenate([near, left[firsts]])
    end = np.concatenate([right[near], firsts])
    by = np.lexsort((end - begin, of))
    of, begin, end = of[by], begin[by], end[by]
    smaller = np.r_[of[1:] == of[:-1], False]  # all children but the largest
    of, begin, end = of[smaller], begin[smaller], end[smaller]
    size = end - begin
    leaf = np.repeat(begin - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
    period, low, high = (np.repeat(x, size) for x in (depth[of], left[of], close[of]))
    begin, end = np.repeat(begin, size), np.repeat(end, size)
    at = order[leaf]
    starts, periods = [], []
    for sign in (1, -1):
        other = at + sign * period
        ok = (other >= 0) & (other < n)
        r = rank[np.where(ok, other, 0)]
        ok &= (r >= low) & (r < high) & ((r < begin) | (r >= end))
        starts.append(np.minimum(at[ok], other[ok]))
        periods.append(period[ok])
    return np.concatenate(starts), np.concatenate(periods)


def runs(symbols: np.ndarray, begins: np.ndarray, ends: np.ndarray, exponent: int = 4, least: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the runs that hold their smallest period exponent
    times (2 at least) and have least symbols, by start, then period. begins,
    ends: of each place's text."""
    n = len(symbols)
    tree = Suffixes(symbols, ends)
    start, period = branching_repeats(tree, n)
    end = start + 2 * period
    first = end - np.maximum(least, exponent * period)
    ok = first >= begins[np.minimum(start, max(n - 1, 0))] if n else np.zeros(0, bool)
    end, period, first, floor = end[ok], period[ok], first[ok], begins[start[ok]] if n else start
    ok = tree.common(first, first + period) >= end - period - first
    end, period, high, low = end[ok], period[ok], first[ok], floor[ok]
    while (low < high).any():  # the leftmost place from which the period holds up to the end
        mid = (low + high) // 2
        holds = tree.common(mid, mid + period) >= end - period - mid
        high, low = np.where(holds, mid, high), np.where(holds, low, np.minimum(mid + 1, high))
    by = np.lexsort((period, end, high))
    start, end, period = high[by], end[by], period[by]
    new = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])] if len(start) else np.zeros(0, bool)
    start, end, period = start[new], end[new], period[new]
    by = np.lexsort((period, start))
    return start[by], end[by], period[by]


def collapse(docs: DataFrame, exponent: int = 4, least: int = 6, change: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_words, runs (array of start, length and
    period in words, by start, then period) and text, in which of each run only
    the first period is left and words are joined by one space.

    Words are what white space (U+0020, U+0009 to U+000D) separates; they are
    compared byte by byte. change(doc_id, words) may put other words in their
    place. A null text has no words. Rows that repeat a doc_id, or have none, are
    documents of their own. An empty table gives an empty result. Other columns
    are not read.
    """

    def found(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            names = ids.to_pylist() if change else None
            lists = [(t or b"").split() for t in texts]
            if change:
                lists = [change(d, w) for d, w in zip(names, lists, strict=True)]
            counts = np.array([len(w) for w in lists], np.int64)
            edges = np.r_[0, np.cumsum(counts)]
            flat = np.empty(edges[-1], object)
            flat[:] = [w for words in lists for w in words]
            codes, known = pd.factorize(flat)
            symbols = np.repeat(np.arange(len(lists)), counts) * max(1, len(known)) + codes
            start, end, period = runs(symbols, np.repeat(edges[:-1], counts), np.repeat(edges[1:], counts), exponent, least)
            mark = np.zeros(edges[-1] + 1, np.int64)
            np.add.at(mark, start + period, 1)
            np.add.at(mark, end, -1)
            kept = np.cumsum(mark)[:-1] == 0
            doc = np.searchsorted(edges, start, side="right") - 1
            cuts = np.searchsorted(doc, np.arange(len(lists) + 1))
            out = []
            for k, words in enumerate(lists):
                if cuts[k] < cuts[k + 1]:
                    words = [words[i] for i in np.flatnonzero(kept[edges[k] : edges[k + 1]]).tolist()]
                out.append(b" ".join(words))
            parts = [pa.array(x, pa.int64()) for x in (start - edges[doc], end - start, period)]
            listed = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays(parts, names=["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(counts), listed, pa.array(out, pa.binary())], names=["doc_id", "n_words", "runs", "text"])

    schema = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, text binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(lean(found), schema).withColumn("text", F.col("text").cast("string"))


def longest(found: DataFrame) -> DataFrame:
    """Adds n_runs and, of each row's longest run (ties: the smallest start, then
    period), start, length, period and exponent_milli; null without a run."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    out = found.withColumn("_best", best).withColumns({"n_runs": F.size("runs").cast("long"), "start": -F.col("_best.start"), "length": F.col("_best.length"), "period": -F.col("_best.period")})
    return out.withColumn("exponent_milli", F.expr("(1000 * length) div period")).drop("_best")


def listing(runs_: str) -> Column:
    """start,length,period and a line feed for each run."""
    return F.array_join(F.transform(runs_, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")

"""Near duplicates among embeddings by collision-counting projections.

Unit vectors are projected on many fixed random directions, and each direction's
projections are sorted. Around each query's own projection lies a window; what
the window holds collides with the query there. For a pair at the threshold's
distance the number of collisions is binomial, so the count that a linked pair
misses with a chance of at most miss is known beforehand; pairs that reach it
have their cosine computed in double precision.

The first direction also deals the vectors of a label into ranges as wide as its
own, wider window, and ranges into chunks of bounded size. Only chunks of the
same or of neighbouring ranges meet, each pair of chunks in a task of its own.
Tasks return sums and a spanning set of links per vector, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, erf, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.llm.common import components, few, lean, settle, small_batches

DIRECTIONS, WINDOW, MISS, CHUNK = 48, 2.7, 1e-9, 1500


def required_count(directions: int, window: float, miss: float) -> int:
    """Most collisions that may be asked for. window: half-width in standard
    deviations of a threshold pair's difference on a direction."""
    p = erf(window / sqrt(2))
    below = 0.0
    for k in range(directions + 1):
        below += comb(directions, k) * p**k * (1 - p) ** (directions - k)
        if below > miss:
            return k
    return directions


def _directions(dim: int, directions: int) -> np.ndarray:
    return np.random.default_rng(20_011).standard_normal((dim, directions))


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, directions: int = DIRECTIONS, window: float = WINDOW, miss: float = MISS, chunk: int = CHUNK) -> DataFrame:
    """vectors: vec_id, embedding, label. One row per row: vec_id, n_links,
    component_id, kept.

    Vectors link when their labels are equal and not null, they have as many
    components, and their cosine is at least threshold. Vectors that are null,
    empty, zero, or hold null or non-finite components link with nothing.
    n_links counts the other vectors linked directly, copies each.
    component_id is the smallest vec_id reachable, itself included; kept says
    whether that is the vector's own. Rows with a null vec_id link with nothing.
    Rows that repeat a vec_id are one node, counted each. Other columns are not
    read. An empty table gives an empty result.
    """
    spread = sqrt(2 - 2 * threshold)  # standard deviation of a threshold pair's difference on a direction
    need = required_count(directions, window, miss)
    wide = 6.2 * spread  # of the first direction: a linked pair is further apart with a chance below 1e-9
    vec = F.col("embedding").cast("array<double>")
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & vec.isNotNull() & (F.size(vec) > 0)
    sound = sound & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    rows = vectors.select("vec_id", "label", vec.alias("v"), F.coalesce(sound, F.lit(False)).alias("sound")).withColumn("k", F.when(F.col("sound"), F.xxhash64("label", "v")))
    copies = rows.where("sound").groupBy("k", "label", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("many"))

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = []
            for v in b["v"]:
                v = np.asarray(v, dtype=np.float64)
                v = v / np.abs(v).max()
                at.append(float(v @ _directions(len(v), directions)[:, 0] / np.sqrt(v @ v)))
            yield b.assign(range=np.floor(np.array(at) / wide).astype(np.int32) if at else np.zeros(0, np.int32), dim=b["v"].str.len().astype("int32"))

    kind = dict(vectors.dtypes)["label"]
    points = settle(copies.select("rep", "many", "label", "v").mapInPandas(lean(project), f"rep long, many long, label {kind}, v array<double>, range int, dim int"), "points")
    sizes = settle(points.groupBy("label", "dim", "range").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks")), "sizes")
    # Joined without a shuffle by range, so that the chunks of a large range go to tasks of their own.
    dealt = points.join(few(sizes), ["label", "dim", "range"]).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))

    def bundle(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        m = np.stack([np.asarray(v, dtype=np.float64) for v in b["v"]])
        m /= np.abs(m).max(axis=1)[:, None]
        m /= np.sqrt((m * m).sum(axis=1))[:, None]
        return pd.DataFrame([(*key, b["rep"].to_numpy(np.int64).tobytes(), b["many"].to_numpy(np.int64).tobytes(), m.tobytes())], columns=["label", "dim", "range", "chunk", "ids", "many", "m"])

    bundles = settle(dealt.groupBy("label", "dim", "range", "chunk").applyInPandas(bundle, f"label {kind}, dim int, range int, chunk int, ids binary, many binary, m binary"), "bundles")
    x, y = bundles.alias("x"), bundles.select("label", "dim", F.explode(F.array(F.col("range"), F.col("range") - 1)).alias("at"), "range", "chunk", "ids", "many", "m").alias("y")
    meet = x.join(y, (F.col("x.label") == F.col("y.label")) & (F.col("x.dim") == F.col("y.dim")) & (F.col("x.range") == F.col("y.at")))
    meet = meet.where((F.col("x.range") < F.col("y.range")) | (F.col("x.chunk") <= F.col("y.chunk")))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                got = _links(r, threshold, directions, window * spread, need)
                if len(got):
                    yield got

    blocks = meet.select("x.dim", F.col("x.ids").alias("ia"), F.col("x.many").alias("na"), F.col("x.m").alias("ma"), F.col("y.ids").alias("ib"), F.col("y.many").alias("nb"), F.col("y.m").alias("mb"))
    with small_batches(vectors.sparkSession, 16):
        found = settle(blocks.repartition(F.col("ia"), F.col("ib")).mapInPandas(lean(compare), "a long, n long, b long"), "found")
    sums = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    parts = settle(components(found.select("a", "b")), "components")
    named = copies.select("k", F.col("label").alias("l"), F.col("v").alias("w"), "rep", "many").join(sums, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("k", "l", "w", (F.col("many") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("c"))
    named = settle(named, "named")
    out = rows.join(named, (rows.k == named.k) & (rows.label == named.l) & (rows.v == named.w), "left")
    own = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.col("vec_id").eqNullSafe(own).alias("kept"))


def _links(r, threshold: float, directions: int, window: float, need: int) -> pd.DataFrame:
    """Per vector with links in this pair of chunks: its id, the copies it links
    with, and the smallest id that the block's links reach from it."""
    ia, ib = np.frombuffer(r.ia, np.int64), np.frombuffer(r.ib, np.int64)
    same = r.ia == r.ib
    a, b = np.frombuffer(r.ma).reshape(len(ia), r.dim), np.frombuffer(r.mb).reshape(len(ib), r.dim)
    d = _directions(r.dim, directions)
    pa, pb = (a @ d).astype(np.float32), (b @ d).astype(np.float32)
    w = np.float32(window + 1e-5)
    orders = np.argsort(pb, axis=0, kind="stable")
    lines = np.ascontiguousarray(np.take_along_axis(pb, orders, axis=0).T)
    first = min(directions, 2 * directions // 3)
    kind = np.int8 if first < 128 else np.int16  # counts
    ii, jj = [], []
    for at in range(0, len(ia), 256):
        some = pa[at : at + 256]
        # A column per query: its window on a line begins and ends with a step, the running sum is 1 within.
        hits, query = np.zeros((len(ib), len(some)), kind), np.arange(len(some))
        for k in range(first):
            edge = np.zeros((len(ib) + 1, len(some)), np.int8)
            edge[np.searchsorted(lines[k], some[:, k] - w, "left"), query] += 1
            edge[np.searchsorted(lines[k], some[:, k] + w, "right"), query] -= 1
            hits[orders[:, k]] += np.cumsum(edge[:-1], axis=0, dtype=np.int8)
        # Of the last directions only what can still reach the count is looked at.
        j, i = np.nonzero(hits >= need - (directions - first))
        count = hits[j, i].astype(np.int16)
        for k in range(first, directions):
            count += np.abs(some[i, k] - pb[j, k]) <= w
        ii.append(i[count >= need] + at)
        jj.append(j[count >= need])
    i, j = np.concatenate(ii), np.concatenate(jj)
    if same:
        i, j = i[i < j], j[i < j]
    yes = np.concatenate([np.einsum("ij,ij->i", a[i[s : s + 50_000]], b[j[s : s + 50_000]]) >= threshold for s in range(0, len(i), 50_000)] or [np.zeros(0, bool)])
    i, j = i[yes], j[yes]
    ids = np.concatenate([ia, ib])
    many = np.concatenate([np.frombuffer(r.na, np.int64), np.frombuffer(r.nb, np.int64)])
    p, q = i, j + len(ia)
    if same:
        ids, many, q = ia, np.frombuffer(r.na, np.int64), j
    n = np.zeros(len(ids), np.int64)
    np.add.at(n, p, many[q])
    np.add.at(n, q, many[p])
    low = ids.copy()
    while True:
        before = low.copy()
        np.minimum.at(low, p, before[q])
        np.minimum.at(low, q, before[p])
        if (low == before).all():
            break
    some = n > 0
    return pd.DataFrame({"a": ids[some], "n": n[some], "b": low[some]})

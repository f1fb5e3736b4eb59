"""File index, time and space averages, batch means, rotations, bins and boxes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nodeloom.functions.spectral import POINT_ROWS, POINT_SLOPES, derivative, gll, lagrange_rows
from nodeloom.operators.elements import lists_of, pieces, values_of


def file_index(files: DataFrame, series: str, order: list[str], time: str, start: Column | None = None, statistics_start: Column | None = None) -> DataFrame:
    """Adds idx, time_prev and dt per series. The first interval begins at start
    (of the run), for series whose name holds stat or mean at statistics_start;
    without them at the series' own first time."""
    w = W.partitionBy(series).orderBy(*order)
    begin = F.col(time) if start is None else start
    if statistics_start is not None:
        begin = F.when(F.col(series).cast("string").rlike("stat|mean"), statistics_start).otherwise(begin)
    prev = F.coalesce(F.lag(time).over(w), begin)
    return files.withColumn("idx", F.row_number().over(w) - 1).withColumn("time_prev", prev).withColumn("dt", F.col(time) - prev)


def merge_index(indexes: list[DataFrame], missing: str = "file_not_in_folder", sort_by_time: bool = False) -> DataFrame:
    """Union, without entries of missing files, with the least start time beside
    each row; sorted by time, also with idx, its place in the order of time (then path)."""
    out = indexes[0]
    for x in indexes[1:]:
        out = out.unionByName(x)
    out = out.where(F.col("path") != missing)
    whole = out.crossJoin(F.broadcast(out.agg(F.min("time").alias("start_time"))))  # one row
    return numbered(whole, ["time", "path"], "idx") if sort_by_time else whole


def numbered(rows: DataFrame, order: list[str], out: str, blocks: int = 64) -> DataFrame:
    """Adds out: 0, 1, 2 .. in the order of all rows (order should tell rows apart;
    its first column is a number). Rows are dealt into ranges of the first column
    by its quantiles; a range numbers its own rows and goes on where those before end."""
    bounds = sorted(set(rows.approxQuantile(order[0], [k / blocks for k in range(1, blocks)], 0.25 / blocks)))
    block = F.lit(0).cast("long")
    for b in bounds:
        block = block + F.when(F.col(order[0]) >= b, 1).otherwise(0)
    dealt = rows.withColumn("_block", block)
    base = carried(dealt.groupBy("_block").agg(F.count(F.lit(1)).alias("_n")), "_block", "_n", "_base")
    inside = F.row_number().over(W.partitionBy("_block").orderBy(*order)) - 1
    return dealt.join(F.broadcast(base), "_block").withColumn(out, (F.col("_base") + inside).cast("long")).drop("_block", "_base")  # as many rows as blocks


def inspect(fields: DataFrame, file: str, values: list[str]) -> DataFrame:
    aggs = [f(c).alias(f"{n}_{c}") for c in values for f, n in ((F.max, "max"), (F.min, "min"), (F.avg, "mean"))]
    return fields.groupBy(file).agg(*aggs)


def time_batches(index: DataFrame, series: str, order: list[str], length: float, slack: float = 0.05, empty_first: bool = False) -> DataFrame:
    """Adds batch: files in order are taken into a batch while its intervals add
    up to at most length * (1 + slack). A first interval that is longer has a
    batch of its own: batch 0, or, with empty_first, batch 1 after an empty one.

    The scan is sequential by definition, so a series is one task; series run in
    parallel, and only the order columns and dt are sent."""
    limit = length * (1 + slack)

    def scan(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(order, kind="stable").reset_index(drop=True)
        batch, total, out = 0, 0.0, []
        for k, dt in enumerate(b["dt"].tolist()):
            if (k or empty_first) and total + dt > limit:
                batch, total = batch + 1, 0.0
            total += dt
            out.append(batch)
        return b.assign(batch=out)

    schema = index.schema.simpleString()[len("struct<") : -1] + ",batch:bigint"
    return index.groupBy(series).applyInPandas(scan, schema)


def average_arrays(rows: DataFrame, keys: list[str], fields: list[str], weight: str) -> DataFrame:
    """keys, fields and weight: weighted means of arrays, element by element of the
    arrays, and the sum of the weights. What a slice of a batch has of a key is added
    up before it is sent, all keys of a slice together; the sums of a key then come
    in a row, so that a task holds a slice and the key that goes on behind it."""

    def added(b, values: list[np.ndarray], w: np.ndarray):
        import pyarrow as pa

        code = pd.DataFrame({k: b.column(k).to_pandas() for k in keys}).groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
        order = np.argsort(code, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0])
        kept, add = pa.array(order[starts]), lambda m: np.add.reduceat(m[order], starts, axis=0)
        return pa.RecordBatch.from_arrays([*[b.column(k).take(kept) for k in keys], *[lists_of(add(v)) for v in values], pa.array(add(w))], names=[*keys, *fields, weight])

    def first(batches):
        for b in pieces(batches):
            w = b.column(weight).to_numpy(zero_copy_only=False).astype(float)
            yield added(b, [values_of(b.column(f)) * w[:, None] for f in fields], w)

    def means(b):
        import pyarrow as pa

        w = b.column(weight).to_numpy(zero_copy_only=False)
        return pa.RecordBatch.from_arrays([*[b.column(k) for k in keys], *[lists_of(values_of(b.column(f)) / w[:, None]) for f in fields], b.column(weight)], names=[*keys, *fields, weight])

    def last(batches):
        import pyarrow as pa

        held = None
        for b in pieces(batches):
            whole = b if held is None else pa.Table.from_batches([held, pa.RecordBatch.from_arrays(b.columns, schema=held.schema)]).combine_chunks().to_batches()[0]
            whole = added(whole, [values_of(whole.column(f)) for f in fields], whole.column(weight).to_numpy(zero_copy_only=False))
            held = whole.slice(whole.num_rows - 1)
            if whole.num_rows > 1:
                yield means(whole.slice(0, whole.num_rows - 1))
        if held is not None:
            yield means(held)

    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], *[f"{f} array<double>" for f in fields], f"{weight} double"])
    sums = rows.select(*keys, *fields, weight).mapInArrow(first, schema)
    return sums.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(last, schema)


def weighted_mean(rows: DataFrame, keys: list[str], values: list[str], weight: str) -> DataFrame:
    """sum(f w) / sum(w): time averages (w an interval), space averages (w a mass)."""
    return rows.groupBy(*keys).agg(*[(F.sum(F.col(v) * F.col(weight)) / F.sum(weight)).alias(v) for v in values], F.sum(weight).alias("weight"))


def own_aggregate(rows: DataFrame, keys: list[str], columns: list[str], part: Callable, merge: Callable, finish: Callable, out: dict[str, str], gather: bool = False) -> DataFrame:
    """keys and out (name -> type) by functions of the user's: part(arrays by
    column) makes a state (a numpy array) of some rows, merge puts two together,
    finish makes the values of out from one. States are made where the rows are;
    only they are sent, one per key and task, so that a key may have any share of
    the rows. gather: rows are dealt by key before, for keys of which a batch would
    have only a few rows each; a key with a large share still is several tasks'."""
    kinds = dict(rows.dtypes)
    key = ", ".join(f"{k} {kinds[k]}" for k in keys)

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for b in batches:
            for k, g in b.groupby(keys, dropna=False, sort=False):
                state = part({c: np.stack(g[c].to_numpy()) if g[c].dtype == object else g[c].to_numpy() for c in columns})
                held[k] = merge(held[k], state) if k in held else state
            if len(held) > 10_000:
                yield frame(held)
                held = {}
        if held:
            yield frame(held)

    def frame(held: dict) -> pd.DataFrame:
        made = pd.DataFrame(list(held), columns=keys)
        return made.assign(state=[np.asarray(s, float).ravel() for s in held.values()], shape=[list(np.asarray(s).shape) for s in held.values()])

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, whole, made = None, None, []
        rows_of = lambda: pd.DataFrame(made, columns=[*keys, *out], dtype=object)
        for b in batches:
            named = zip(*[b[k] for k in keys], strict=True)
            for k, s, shape in zip(named, b["state"], b["shape"], strict=True):
                own, state = tuple(None if pd.isna(v) else v for v in k), np.asarray(s, float).reshape([int(x) for x in shape])
                if whole is not None and own == now:
                    whole = merge(whole, state)
                    continue
                if whole is not None:
                    made.append((*now, *finish(whole)))
                now, whole = own, state
            if len(made) > 10_000:
                yield rows_of()
                made.clear()
        if whole is not None:
            made.append((*now, *finish(whole)))
            yield rows_of()

    asked = rows.select(*keys, *columns)
    if gather:
        asked = asked.hint("rebalance", *keys).sortWithinPartitions(*keys)
    states = asked.mapInPandas(first, f"{key}, state array<double>, shape array<int>")
    # The states of a key come in a row.
    return states.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(last, key + ", " + ", ".join(f"{c} {t}" for c, t in out.items()))


def batch_means(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and variance of the mean over non-overlapping batches."""
    x = F.col(value)
    return rows.groupBy(*keys).agg(F.avg(x).alias("mean"), ((F.avg(x * x) - F.avg(x) * F.avg(x)) / F.count(x)).alias("variance"))


def grid_bin(v: Column, low: float | Column, high: float | Column, n: int) -> Column:
    """Uniform bin 0 .. n-1; values outside go to the end bins."""
    return F.least(F.greatest(F.floor((v - low) / ((high - low) / (n - 1))), F.lit(0)), F.lit(n - 1)).cast("long")


def box_join(points: DataFrame, boxes: DataFrame, axes: list[str], size: dict[str, float]) -> DataFrame:
    """Pairs of points and boxes that hold them. Boxes are spread over the grid
    cells they touch and points are met there by equal keys: no theta join. A
    point is in one cell per axis, so a pair comes out once."""
    p, b = points, boxes
    for a in axes:
        p = p.withColumn(f"_c{a}", F.floor(F.col(a) / size[a]))
        b = b.withColumn(f"_c{a}", F.explode(F.sequence(F.floor(F.col(f"{a}_lo") / size[a]), F.floor(F.col(f"{a}_hi") / size[a]))))
    keys = [f"_c{a}" for a in axes]
    inside = None
    for a in axes:
        c = F.col(a).between(F.col(f"{a}_lo"), F.col(f"{a}_hi"))
        inside = c if inside is None else inside & c
    return p.join(b, keys).where(inside).drop(*keys)


LEVELS = 40  #: grid levels per axis below the largest that a box can have
ASKED = 64  #: combinations of levels that a point asks, at most
FEW = 4  #: combinations that points ask where they are read, and that are not weighed
SPREAD, WHOLE = 256, 10_000  #: parts that the points of a combination are dealt to, if each gets so many
SAMPLE, SENT = 1000, 256  #: points and boxes that levels are weighed on; candidates that cost what sending a point once more does


def _combinations(found: list[tuple[int, ...]], least: list[int]) -> tuple[int, list[tuple[int, ...]]]:
    """What is left of the levels found together when smaller ones share the least of their axis: at most ASKED, and the
    step that they are rounded up to for that."""
    for step in range(1, LEVELS + 2):
        up = sorted({tuple(low - (low - max(v, low)) // step * step for v, low in zip(c, least, strict=True)) for c in found})
        if len(up) <= ASKED:
            break
    return step, up


def _some(rows: DataFrame, columns: list[str], n: int) -> np.ndarray:
    """About SAMPLE of n rows, as doubles."""
    some = rows.select(*[F.col(c).cast("double") for c in columns]).dropna()
    some = some.sample(min(1.0, SAMPLE / n), 7) if n > SAMPLE else some
    return np.array([tuple(r) for r in some.limit(2 * SAMPLE).collect()], float).reshape(-1, len(columns))


def _least_levels(p: np.ndarray, low: np.ndarray, high: np.ndarray, boxes: int, found: list[tuple[int, ...]], lowest: int) -> list[int]:
    """Per axis the least level worth cells of its own. Each combination of levels sends all points once more, coarser
    cells meet more candidates; both are weighed on some points and some of the boxes (arrays of a row each). Only the
    cost depends on it, no pair does."""
    top = np.max(found, axis=0)
    own = np.maximum(np.ceil(np.log2(np.maximum(high - low, 2.0**lowest))), lowest)
    best: tuple[float, list[int]] | None = None
    for depth in range(LEVELS + 1):
        least = np.maximum(top - depth, lowest)
        step, asked = _combinations(found, least.tolist())
        cell = 2.0 ** (least + np.ceil((np.maximum(own, least) - least) / step) * step)
        meets = np.ones((len(p), len(low)), bool)
        for a in range(len(top)):
            at = np.floor(p[:, a, None] / cell[:, a])
            meets &= (np.floor(low[:, a] / cell[:, a]) <= at) & (at <= np.floor(high[:, a] / cell[:, a]))
        cost = len(asked) * SENT + (float(meets.mean()) * boxes if meets.size else 0.0)
        if best is None or cost <= best[0]:  # of equal ones the finest
            best = cost, least.tolist()
    return best[1]


def level_join(points: DataFrame, boxes: DataFrame, axes: list[str]) -> DataFrame:
    """The same pairs, with cells from the data: along each axis a box lies on the
    grid level whose cells are as wide as its side, so that it touches two cells per
    axis at most and what it meets in them is a fair share of what it holds, however
    far boxes or the sides of a box are apart. A point asks the cells of the
    combinations of levels that occur, ASKED at most: where there are more, levels
    are rounded up. Smaller sides than LEVELS allow share the lowest level, and so do
    those for which it costs less to meet more boxes than to send all points once
    more. Points outside the hull of all boxes ask none. Both sides are dealt by cell; where a
    combination has few cells, its points are dealt to several parts of a cell, each
    with all of the cell's boxes."""
    ends = boxes.agg(*[f(f"{a}_{e}").alias(f"{a}_{e}") for a in axes for f, e in ((F.min, "lo"), (F.max, "hi"))], *[F.max(F.col(f"{a}_hi") - F.col(f"{a}_lo")).alias(f"{a}_w") for a in axes], F.count(F.lit(1)).alias("n")).first()
    if ends is None or any(ends[f"{a}_lo"] is None for a in axes):
        return points.join(boxes, F.lit(False))
    far = max(1e-300, *[abs(float(ends[f"{a}_{e}"])) for a in axes for e in ("lo", "hi")], *[float(ends[f"{a}_w"]) for a in axes])
    lowest = int(np.ceil(np.log2(far))) - LEVELS
    side = lambda a: F.col(f"{a}_hi") - F.col(f"{a}_lo")
    b = boxes.withColumns({f"_l{a}": F.when(side(a) > 2.0**lowest, F.ceil(F.log2(side(a)))).otherwise(lowest).cast("int") for a in axes})
    found = [tuple(r) for r in b.select(*[f"_l{a}" for a in axes]).distinct().collect()]  # LEVELS + 1 per axis at most
    inside = reduce(lambda x, y: x & y, [F.col(a).between(float(ends[f"{a}_lo"]), float(ends[f"{a}_hi"])) for a in axes])
    p, n_points, least = points.where(inside), None, [lowest] * len(axes)
    if len(found) > FEW:
        n_points = p.count()
        some = _some(boxes, [f"{a}_{e}" for e in ("lo", "hi") for a in axes], ends["n"])
        least = _least_levels(_some(p, axes, n_points), some[:, : len(axes)], some[:, len(axes) :], ends["n"], found, lowest)
    step, asked = _combinations(found, least)
    if asked != sorted(found):
        b = b.withColumns({f"_l{a}": F.expr(f"{low} + cast(ceil((greatest(_l{a}, {low}) - ({low})) / {step}) * {step} as int)") for a, low in zip(axes, least, strict=True)})
    cells = lambda c: int(np.prod([float(ends[f"{a}_hi"]) // 2.0**v - float(ends[f"{a}_lo"]) // 2.0**v + 1 for a, v in zip(axes, c, strict=True)]))
    parts = {c: -(-SPREAD // cells(c)) for c in asked}
    if max(parts.values()) > 1:
        most = max(1, (p.count() if n_points is None else n_points) // WHOLE)
        parts = {c: min(n, most) for c, n in parts.items()}
    if len(asked) > FEW:  # points of a small file would all be unrolled by one task
        p = p.repartition(*axes)
    p = p.withColumn("_c", F.explode(F.array(*[F.struct(*[F.lit(v).alias(f"_l{a}") for a, v in zip(axes, c, strict=True)], F.lit(parts[c]).alias("_parts")) for c in asked])))
    p = p.select(*points.columns, "_c.*")
    keys = [*[f"_l{a}" for a in axes], *[f"_c{a}" for a in axes]]
    cell = lambda v, a: F.floor(F.col(v) / F.pow(F.lit(2.0), F.col(f"_l{a}"))).cast("long")
    for a in axes:
        p = p.withColumn(f"_c{a}", cell(a, a))
        b = b.withColumn(f"_c{a}", F.explode(F.sequence(cell(f"{a}_lo", a), cell(f"{a}_hi", a))))
    if max(parts.values()) > 1:
        keys.append("_part")
        several = F.lit(1)
        for c, n in parts.items():
            several = F.when(reduce(lambda x, y: x & y, [F.col(f"_l{a}") == v for a, v in zip(axes, c, strict=True)]), n).otherwise(several) if n > 1 else several
        p = p.withColumn("_part", F.pmod(F.xxhash64(*points.columns), F.col("_parts")).cast("int"))
        b = b.withColumn("_part", F.explode(F.sequence(F.lit(0), several - 1)))
    held = reduce(lambda x, y: x & y, [F.col(a).between(F.col(f"{a}_lo"), F.col(f"{a}_hi")) for a in axes])
    return p.drop("_parts").join(b.hint("merge"), keys).where(held).drop(*keys)


GROUPED = 1024  #: ranges whose counts are added up in one group


def carried(counts: DataFrame, block: str, n: str, out: str) -> DataFrame:
    """block and out: the sum of n over all blocks before. Blocks are added up in
    groups, these in groups again, so that a group of groups stays small."""
    up = [F.col(block), F.expr(f"{block} div {GROUPED}"), F.expr(f"{block} div {GROUPED * GROUPED}")]
    c = counts.select(up[0].alias("_b0"), up[1].alias("_b1"), up[2].alias("_b2"), F.col(n).alias("_n"))
    zero = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    low = c.select("_b0", "_b1", "_b2", zero(W.partitionBy("_b2", "_b1").orderBy("_b0")).alias("_low"))
    mid = c.groupBy("_b2", "_b1").agg(F.sum("_n").alias("_n")).select("_b1", zero(W.partitionBy("_b2").orderBy("_b1")).alias("_mid"))
    top = c.groupBy("_b2").agg(F.sum("_n").alias("_n")).select("_b2", zero(W.orderBy("_b2")).alias("_top"))
    return low.join(mid, "_b1").join(top, "_b2").select(F.col("_b0").alias(block), (F.col("_low") + F.col("_mid") + F.col("_top")).alias(out))


def number_elements(kept: DataFrame, per_block: int = 100_000, element: str = "e", out: str = "new_e") -> DataFrame:
    """element and out: elements (different whole numbers) numbered from 0 in their
    order. Elements are counted by ranges of their numbers first, each range then
    numbers its own, so that no task holds all."""
    dealt = kept.select(element, F.floor(F.col(element) / per_block).alias("_block"))
    base = carried(dealt.groupBy("_block").agg(F.count(F.lit(1)).alias("n")), "_block", "n", "base")
    inside = F.row_number().over(W.partitionBy("_block").orderBy(element)) - 1
    return dealt.join(base, "_block").select(element, (F.col("base") + inside).cast("long").alias(out))


def filled(rows: DataFrame, group: list[str], part: str, order: str, columns: list[str]) -> DataFrame:
    """rows with each null of columns replaced by the last value before it in the
    order (part, order) of its group. A part fills itself; what it lacks at its
    begin comes from the last values of the parts before, a row each. No window
    holds more than a part, or the ends of a group's parts."""
    known = lambda c: F.when(F.col(c).isNotNull(), F.col(order))
    ends = rows.groupBy(*group, part).agg(*[F.max_by(c, known(c)).alias(f"_{c}") for c in columns])
    before = W.partitionBy(*group).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    carry = ends.select(*group, part, *[F.last(f"_{c}", True).over(before).alias(f"_{c}") for c in columns])
    own = W.partitionBy(*group, part).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    met = rows.join(carry, [*group, part])
    return met.withColumns({c: F.coalesce(F.last(c, True).over(own), f"_{c}") for c in columns}).drop(*[f"_{c}" for c in columns])


def neighbours(rows: DataFrame, order: list[str], value: str, blocks: int = 64) -> DataFrame:
    """Adds before and after: value in the row before and behind in the order over
    all rows. Rows are dealt into ranges of the first order column by its
    quantiles; only the ends of the ranges, a row each, are put in order together."""
    bounds = sorted(set(rows.approxQuantile(order[0], [k / blocks for k in range(1, blocks)], 0.25 / blocks)))
    block = F.lit(0)
    for b in bounds:
        block = block + F.when(F.col(order[0]) >= b, 1).otherwise(0)
    dealt = rows.withColumn("_block", block)
    place = F.struct(*order)
    ends = dealt.groupBy("_block").agg(F.min_by(value, place).alias("_first"), F.max_by(value, place).alias("_last"))
    w, own = W.orderBy("_block"), W.partitionBy("_block").orderBy(*order)
    ends = ends.select("_block", F.lag("_last").over(w).alias("_before"), F.lead("_first").over(w).alias("_after"))
    met = dealt.join(F.broadcast(ends), "_block")  # as many rows as blocks
    out = met.withColumn("before", F.coalesce(F.lag(value).over(own), "_before")).withColumn("after", F.coalesce(F.lead(value).over(own), "_after"))
    return out.drop("_block", "_before", "_after")


def keep_elements(long: DataFrame, condition: Column) -> DataFrame:
    """Elements of which any node meets the condition, renumbered from 0 in their order."""
    return number_elements(long.groupBy("e").agg(F.bool_or(condition).alias("any")).where("any").select("e"))


def rotate_vector(x: Column, y: Column, v: list[Column]) -> list[Column]:
    """Components along r, theta, z; identity where the radius is at most 1e-7."""
    r = F.sqrt(x * x + y * y)
    near = r <= 1e-7
    c, s = F.when(near, 1.0).otherwise(x / r), F.when(near, 0.0).otherwise(y / r)
    return [c * v[0] + s * v[1], c * v[1] - s * v[0], v[2]]


def rotate_tensor(x: Column, y: Column, t: dict[str, Column]) -> dict[str, Column]:
    """R T R^T of a symmetric tensor given by 11 22 33 12 13 23."""
    r = F.sqrt(x * x + y * y)
    near = r <= 1e-7
    c, s = F.when(near, 1.0).otherwise(x / r), F.when(near, 0.0).otherwise(y / r)
    return {
        "11": c * c * t["11"] + 2 * c * s * t["12"] + s * s * t["22"],
        "22": s * s * t["11"] - 2 * c * s * t["12"] + c * c * t["22"],
        "33": t["33"],
        "12": c * s * (t["22"] - t["11"]) + (c * c - s * s) * t["12"],
        "13": c * t["13"] + s * t["23"],
        "23": c * t["23"] - s * t["13"],
    }


def basis(v1: list[Column], v2: list[Column], v3: list[Column]) -> list[list[Column]]:
    """The rotation whose rows are three vectors."""
    return [v1, v2, v3]


def rotate_three(q: list[list[Column]], v: list[Column]) -> list[Column]:
    """q v at a point."""
    return [q[i][0] * v[0] + q[i][1] * v[1] + q[i][2] * v[2] for i in range(3)]


def rotate_six(q: list[list[Column]], t: dict[str, Column]) -> dict[str, Column]:
    """q t q^T of a symmetric tensor given by 11 22 33 12 13 23."""
    at = lambda i, j: t[f"{min(i, j) + 1}{max(i, j) + 1}"]
    half = [[q[i][0] * at(0, b) + q[i][1] * at(1, b) + q[i][2] * at(2, b) for b in range(3)] for i in range(3)]
    whole = lambda i, j: half[i][0] * q[j][0] + half[i][1] * q[j][1] + half[i][2] * q[j][2]
    return {k: whole(int(k[0]) - 1, int(k[1]) - 1) for k in ("11", "22", "33", "12", "13", "23")}


def _newton(grid, p, x, d, tolerance: float, iterations: int):
    """Reference coordinates of points p (count, 3) in elements grid (count, 3, n, n, n),
    all at once: those that have converged, or whose Jacobian is singular, step no more."""
    q = np.zeros_like(p)
    left = np.arange(len(p))
    for _ in range(iterations):
        if not len(left):
            break
        g = grid[left]
        row = [lagrange_rows(x, q[left, c]) for c in range(3)]  # r, s, t
        der = [v @ d for v in row]
        # One axis after the other: values and derivatives along i, then j, then k.
        along, slope = np.einsum("eckji,ei->eckj", g, row[0]), np.einsum("eckji,ei->eckj", g, der[0])
        both, s_slope, r_slope = np.einsum("eckj,ej->eck", along, row[1]), np.einsum("eckj,ej->eck", along, der[1]), np.einsum("eckj,ej->eck", slope, row[1])
        at = np.einsum("eck,ek->ec", both, row[2])
        jac = np.stack([np.einsum("eck,ek->ec", r_slope, row[2]), np.einsum("eck,ek->ec", s_slope, row[2]), np.einsum("eck,ek->ec", both, der[2])], axis=2)
        able = np.abs(np.linalg.det(jac)) > 1e-300
        jac[~able] = np.eye(3)
        step = np.where(able[:, None], np.linalg.solve(jac, (p[left] - at)[..., None])[..., 0], 0.0)
        q[left] = np.clip(q[left] + step, -1.5, 1.5)
        left = left[np.abs(step).max(axis=1) >= tolerance]
    row = [lagrange_rows(x, q[:, c]) for c in range(3)]
    back = np.einsum("eckj,ej,ek->ec", np.einsum("eckji,ei->eckj", grid, row[0]), row[1], row[2])
    return q, np.abs(back - p).max(axis=1)


def hull_of(rows: DataFrame, ends: dict[str, tuple[str, str]]) -> dict[str, tuple[float, float]] | None:
    """Per axis the least of its first column and the largest of its second; None without rows."""
    r = rows.agg(*[f(c).alias(f"{a}_{k}") for a, (lo, hi) in ends.items() for k, f, c in (("lo", F.min, lo), ("hi", F.max, hi))]).first()
    return None if any(v is None for v in r) else {a: (float(r[f"{a}_lo"]), float(r[f"{a}_hi"])) for a in ends}


def boxes_meet(hull: dict[str, tuple[float, float]] | None, ends: dict[str, tuple[Column, Column]], tol: float = 0.0) -> Column:
    """Whether a box (lowest and highest per axis) and the hull, widened by tol, have a place in common."""
    return F.lit(False) if hull is None else reduce(lambda x, y: x & y, [(lo <= hull[a][1] + tol) & (hi >= hull[a][0] - tol) for a, (lo, hi) in ends.items()])


def locate(probes: DataFrame, mesh: DataFrame, n: int, size: float | None = None, tolerance: float = 1e-10, iterations: int = 50, accept: float = 1e-4) -> DataFrame:
    """Element and reference coordinates of each probe (probe_id, x, y, z).

    mesh: e and arrays xs, ys, zs of n^3 coordinates. Candidates come from a
    join on grid cells of boxes (of the boxes' own sizes, or of size), of which
    only the ids go along; the coordinates
    join the candidates by element afterwards. All candidates of an Arrow batch
    are inverted by Newton steps together. Of a probe's candidates the inside one
    (err_code 1), then the smallest remaining error, then the smallest element
    wins. A probe without candidates has err_code 0, one without an inside
    candidate -10. Elements beyond the hull of all probes are left out before."""
    pick = lambda f, c: f(c)
    mesh = mesh.where(boxes_meet(hull_of(probes, {c: (c, c) for c in "xyz"}), {c: (F.array_min(f"{c}s"), F.array_max(f"{c}s")) for c in "xyz"}))
    boxes = mesh.select("e", *[pick(f, f"{c}s").alias(f"{c}_{s}") for c in "xyz" for f, s in ((F.array_min, "lo"), (F.array_max, "hi"))])
    own = probes.select("probe_id", "x", "y", "z")
    pairs = level_join(own, boxes, ["x", "y", "z"]) if size is None else box_join(own, boxes, ["x", "y", "z"], {c: size for c in "xyz"})
    pairs = pairs.select("probe_id", "x", "y", "z", "e")
    nodes_x, d = gll(n)[0], derivative(n)

    def invert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 4096):
                b = whole.iloc[at : at + 4096]
                grid = np.stack([np.stack(b[f"{c}s"].to_numpy()).astype(float) for c in "xyz"], axis=1).reshape(-1, 3, n, n, n)
                q, error = _newton(grid, b[["x", "y", "z"]].to_numpy(float), nodes_x, d, tolerance, iterations)
                inside = (np.abs(q) <= 1 + 1e-6).all(axis=1) & (error <= accept)
                yield pd.DataFrame({"probe_id": b["probe_id"], "e": b["e"], "r": q[:, 0], "s": q[:, 1], "t": q[:, 2], "err_code": np.where(inside, 1, -10).astype(np.int32), "test_error": error})

    tried = pairs.join(mesh.select("e", "xs", "ys", "zs"), "e").select("probe_id", "x", "y", "z", "e", "xs", "ys", "zs").mapInPandas(invert, "probe_id long, e long, r double, s double, t double, err_code int, test_error double")
    best = F.min_by(F.struct("e", "r", "s", "t", "err_code", "test_error"), F.struct(F.col("err_code") != 1, "test_error", "e")).alias("b")
    first = tried.groupBy("probe_id").agg(best).select("probe_id", "b.*")
    return probes.join(first, "probe_id", "left").withColumn("err_code", F.coalesce("err_code", F.lit(0)))


def evaluate(located: DataFrame, mesh: DataFrame | None, field: str, n: int, way: str = "barycentric", slope: str | None = None) -> DataFrame:
    """Adds value: the field (array per element) at each located probe; 0 where it
    was not found. Without a mesh the probes have the field's array themselves.
    way: barycentric, lagrange or legendre; slope: the reference coordinate (r, s
    or t) along which the derivative is wanted instead of the value."""
    of, along = POINT_ROWS[way], POINT_SLOPES[way]

    @F.pandas_udf("double")
    def at(u: pd.Series, r: pd.Series, s: pd.Series, t: pd.Series) -> pd.Series:
        some = u.notna().to_numpy()
        out = np.zeros(len(u))
        if some.any():
            grid = np.stack([np.asarray(v, float).reshape(n, n, n) for v in u[some]])
            rows = [(along if name == slope else of)(n, c[some].to_numpy()) for name, c in zip("tsr", (t, s, r), strict=True)]
            out[some] = np.einsum("pkji,pk,pj,pi->p", grid, *rows)
        return pd.Series(out)

    rows = located.join(mesh.select("e", F.col(field).alias("_u")), "e", "left") if mesh is not None else located.withColumnRenamed(field, "_u")
    return rows.withColumn("value", at("_u", "r", "s", "t")).drop("_u")

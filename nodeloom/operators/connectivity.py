"""Connectivity from coordinates: what lies in the same place, within a
tolerance, is shared. Places meet by equal keys of grid bins, never by comparing
all pairs; a bin is far wider than the tolerance and far narrower than an
element, so it holds little but co-located things."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nodeloom.operators.elements import hex_cells
from nodeloom.operators.statistics import number_elements

WIDTH = 64  #: of a bin, in tolerances


def near_pairs(left: DataFrame, right: DataFrame, axes: list[str], tol: float) -> DataFrame:
    """All columns of both (of different names but for axes, which the right side
    has as axis_2) for pairs within tol on every axis. A row of the left is in
    one bin, one of the right in each bin that its tolerance touches, so a pair
    comes out once."""
    width = WIDTH * tol
    a, b = left, right.withColumnsRenamed({c: f"{c}_2" for c in axes})
    for c in axes:
        a = a.withColumn(f"_b{c}", F.floor(F.col(c) / width))
        b = b.withColumn(f"_b{c}", F.explode(F.sequence(F.floor((F.col(f"{c}_2") - tol) / width), F.floor((F.col(f"{c}_2") + tol) / width))))
    keys = [f"_b{c}" for c in axes]
    close = reduce(lambda x, y: x & y, [F.abs(F.col(c) - F.col(f"{c}_2")) <= tol for c in axes])
    return a.join(b, keys).where(close).drop(*keys)


def shared(entities: DataFrame, kind: str, axes: list[str], tol: float) -> DataFrame:
    """entities: e, kind (the number of a vertex, edge or facet), axes. Pairs
    e, kind, e2, kind2 of different elements in the same place."""
    other = entities.select(F.col("e").alias("e2"), F.col(kind).alias(f"{kind}2"), *axes)
    return near_pairs(entities.select("e", kind, *axes), other, axes, tol).where("e <> e2").select("e", kind, "e2", f"{kind}2")


def incomplete(entities: DataFrame, kind: str, axes: list[str], tol: float, least: int = 1) -> DataFrame:
    """e, kind of the entities that fewer than least other elements share."""
    found = shared(entities, kind, axes, tol).groupBy("e", kind).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return entities.select("e", kind).join(found.select("e", kind), ["e", kind], "left_anti")


def place(nodes: DataFrame, node: str, axes: list[str], tol: float) -> DataFrame:
    """node and label: the smallest node in the same place (itself included)."""
    other = nodes.select(F.col(node).alias("_other"), *axes)
    return near_pairs(nodes.select(node, *axes), other, axes, tol).groupBy(node).agg(F.min("_other").alias("label"))


def gather_scatter(nodes: DataFrame, node: str, value: str, axes: list[str], tol: float) -> DataFrame:
    """nodes with label and total (the sum of value over the nodes in the same place) and copies (how many they are)."""
    labelled = nodes.join(place(nodes, node, axes, tol), node)
    w = W.partitionBy("label")
    return labelled.withColumn("total", F.sum(value).over(w)).withColumn("copies", F.count(F.lit(1)).over(w))


def numbered_places(nodes: DataFrame, node: str, axes: list[str], tol: float, per_block: int = 100_000) -> DataFrame:
    """node, label (the smallest node in the same place) and place: a dense number
    of the places from 0, in the order of their labels. Labels are counted by
    ranges of their numbers, and each range goes on where the ones before end."""
    labelled = place(nodes, node, axes, tol)
    # Every place has one node that is its own label.
    numbers = number_elements(labelled.where(F.col(node) == F.col("label")).select("label"), per_block, "label", "place")
    return labelled.join(numbers, "label").select(node, "label", "place")


def global_cells(numbered: DataFrame, node: str, n: int) -> DataFrame:
    """e, cell, ids: the linear hexahedra of all elements (VTK order of corners) by
    the numbers of their places. numbered: node = e * n^3 + (k * n + j) * n + i, and place.
    A node brings its place to the cells that it is a corner of; the cells of an
    element are put together by element."""
    element, p = F.expr(f"{node} div {n**3}"), F.col(node) % n**3
    own = numbered.select(element.alias("e"), p.cast("int").alias("p"), "place")
    whole = own.groupBy("e").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "place"))), lambda x: x["place"]).alias("_places"))
    cells = whole.select("e", "_places", F.posexplode(hex_cells(n, F.lit(0).cast("long"))).alias("cell", "_corners"))
    return cells.select("e", "cell", F.transform("_corners", lambda c: F.element_at("_places", (c + 1).cast("int"))).alias("ids"))


def boundary_nodes_2d(long: DataFrame, n: int, tol: float, keep: Column | None = None) -> DataFrame:
    """long: e, j, i, x, y of two-dimensional elements. The nodes on edges that
    no other element shares, and that keep (a predicate) allows: e, edge, j, i."""
    last = n - 1
    edges = [("j", 0), ("j", last), ("i", 0), ("i", last)]
    on = [F.when(F.col(c) == at, F.lit(k)) for k, (c, at) in enumerate(edges)]
    rows = long.withColumn("edge", F.explode(F.array_compact(F.array(*on))))
    centres = rows.groupBy("e", "edge").agg(*[(F.min(c) + (F.max(c) - F.min(c)) / 2).alias(f"c{c}") for c in "xy"])
    free = incomplete(centres, "edge", ["cx", "cy"], tol)
    out = rows.join(free, ["e", "edge"])
    return (out.where(keep) if keep is not None else out).select("e", "edge", "j", "i")


def owners(centroids: DataFrame, axes: list[str], tol: float) -> DataFrame:
    """e and owner: of the elements with the same centroid, the smallest."""
    return place(centroids, "e", axes, tol).withColumnRenamed("label", "owner")


def column_average(long: DataFrame, values: list[str], tol: float, across: tuple[str, str] = ("x", "y"), keep: tuple[str, str] = ("j", "i"), along: str = "k") -> DataFrame:
    """Mass-weighted mean along a homogeneous direction. long: e, k, j, i, x, y,
    z, b, values. Elements whose first plane has the same two-dimensional centroid
    are a column; owner is its smallest element."""
    first = long.where(F.col(along) == 0)
    centroids = first.groupBy("e").agg(*[(F.min(c) + (F.max(c) - F.min(c)) / 2).alias(f"c{c}") for c in across])
    rows = long.join(owners(centroids, [f"c{c}" for c in across], tol), "e")
    means = [(F.sum(F.col(v) * F.col("b")) / F.sum("b")).alias(v) for v in values]
    return rows.groupBy("owner", *keep).agg(*means, F.sum("b").alias("weight"))


def extrude(flat: DataFrame, heights: list[float], columns: list[str]) -> DataFrame:
    """Two-dimensional nodes (e, j, i, columns) as elements of one layer: k and z
    from the given heights, everything else as it is."""
    layers = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(z)).alias("z")) for k, z in enumerate(heights)])).alias("_l")
    return flat.select("e", "j", "i", *columns, layers).select("e", F.col("_l.k").alias("k"), "j", "i", *columns, F.col("_l.z").alias("z"))


def orientation(long: DataFrame, n: int) -> DataFrame:
    """Per element, which axis of space each local index runs along and which
    way: from the mean difference of opposite faces. e, then for i, j and k the
    axis (0, 1, 2) and the sign."""
    last = n - 1
    diff = [(F.avg(F.when(F.col(c) == last, F.col(x))) - F.avg(F.when(F.col(c) == 0, F.col(x)))).alias(f"{c}{x}") for c in "ijk" for x in "xyz"]
    d = long.groupBy("e").agg(*diff)
    out = ["e"]
    for c in "ijk":
        size = [F.struct(F.abs(F.col(f"{c}{x}")).alias("m"), F.lit(-k).alias("k"), F.signum(F.col(f"{c}{x}")).cast("int").alias("s")) for k, x in enumerate("xyz")]
        best = F.array_max(F.array(*size))
        out += [(-best["k"]).alias(f"{c}_axis"), best["s"].alias(f"{c}_sign")]
    return d.select(*out)


def reorder(long: DataFrame, n: int) -> DataFrame:
    """Nodes renumbered so that i runs along x, j along y and k along z, upwards."""
    o = long.join(orientation(long, n), "e")

    def index(axis: int) -> Column:
        of = [F.when(F.col(f"{c}_axis") == axis, F.when(F.col(f"{c}_sign") > 0, F.col(c)).otherwise(n - 1 - F.col(c))) for c in "ijk"]
        return F.coalesce(*of)

    rest = [c for c in long.columns if c not in "ijk"]
    return o.select(*rest, index(2).alias("k"), index(1).alias("j"), index(0).alias("i"))

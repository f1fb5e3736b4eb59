"""Shards of near equal bytes by a k-d tree over document metadata.

The tree splits at distributed weighted medians along the metadata dimension
that is widest in the node, until there is a leaf per shard. What it places are
groups of equal texts, each with its bytes and the metadata of one member, so
that copies stay together. Groups larger than a shard are dealt first, by rows;
the tree fills the shards up, its leaves wanting what each still lacks. A cut
can't go through a group, so leaves come out uneven by what their heavy groups
weigh: few heavy groups then change places between leaves, and light ones are
poured from leaves that still have too much. placed_by tells which way a row
went. Only heavy groups and histograms of at most nodes x bins counts come to
the driver; their size depends on the number of shards, not on the data.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeloom.llm.common import blocks_for, few, prefix_sums, settle

#: Every dimension is an integer below 2**16; the group's hash breaks its ties, so a key is exact in a double.
VALUE_BITS, TIE_BITS = 16, 37
DIMENSIONS = ("size_class", "source_code", "lang_code")
HEAVY = 64  #: a group is heavy beyond one in so many parts of a shard's bytes


@dataclass
class Node:
    goals: list[float]  # bytes wanted by each leaf below
    first: int
    dim: int = -1
    cut: float = 0.0
    low: "Node | None" = None
    high: "Node | None" = None

    @property
    def leaves(self) -> int:
        return len(self.goals)


def metadata(docs: DataFrame, overhead: int = 16) -> DataFrame:
    """doc_id, size (UTF-8 bytes and overhead), text_crc32, same (a digest of the
    text; null counts as empty), source, lang, row (a number)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("same"), "source", "lang", F.monotonically_increasing_id().alias("row"))


def points(groups: DataFrame) -> DataFrame:
    """groups: same, size (bytes of the group), one (bytes of a member), source,
    lang. same, size and a key per dimension. Null sources and languages have
    values of their own."""
    tie = F.shiftrightunsigned(F.xxhash64("same"), 64 - TIE_BITS) / float(2**TIE_BITS)

    def code(name: str) -> Column:
        return F.coalesce(F.crc32(F.col(name).cast("binary")) % (2**VALUE_BITS - 1) + 1, F.lit(0))

    values = {"size_class": F.floor(F.log2("one") * 1024), "source_code": code("source"), "lang_code": code("lang")}
    return groups.select("same", "size", *[(v.cast("double") + tie).alias(k) for k, v in values.items()])


def _place(node: Node, pick) -> Column:
    """The leaf or pick(node) of a row, as one expression."""
    if node.low is None:
        return F.lit(pick(node))
    return F.when(F.col(DIMENSIONS[node.dim]) < node.cut, _place(node.low, pick)).otherwise(_place(node.high, pick))


def _cuts(meta: DataFrame, root: Node, open_nodes: list[Node], bins: int, slack: float) -> None:
    """Finds for each open node its widest dimension and the cut at its share of
    the bytes; narrows an interval per node with one histogram job at a time."""
    index = {id(n): i for i, n in enumerate(open_nodes)}
    at = _place(root, lambda n: index.get(id(n), -1)).alias("node")
    span = [f(c).alias(f"{f.__name__}_{c}") for c in DIMENSIONS for f in (F.min, F.max)]
    seen = {r["node"]: r for r in meta.select(at, "size", *DIMENSIONS).where("node >= 0").groupBy("node").agg(F.sum("size").alias("bytes"), *span).collect()}
    whole = {c: (min(r[f"min_{c}"] for r in seen.values()), max(r[f"max_{c}"] for r in seen.values())) for c in DIMENSIONS} if seen else {}
    want: dict[int, list] = {}
    for n in open_nodes:
        r = seen.get(index[id(n)])
        if r is None:
            n.dim, n.cut = 0, 0.0
            continue
        # Widest: share of the span that the dimension has in all nodes of this level.
        width = [(r[f"max_{c}"] - r[f"min_{c}"]) / ((whole[c][1] - whole[c][0]) or 1.0) for c in DIMENSIONS]
        n.dim = max(range(len(DIMENSIONS)), key=lambda d: width[d])
        c = DIMENSIONS[n.dim]
        lo, hi = r[f"min_{c}"], r[f"max_{c}"]
        # node -> interval, bytes below it, bytes wanted below the cut, tolerated error
        goal = r["bytes"] * sum(n.goals[: n.leaves // 2]) / (sum(n.goals) or 1.0)
        want[index[id(n)]] = [lo, hi + max(1e-9, abs(hi) * 1e-15), 0, goal, slack * r["bytes"] / n.leaves]
        n.cut = hi
    for _ in range(12):
        if not want:
            return
        nodes = sorted(want)
        pick = lambda f: F.element_at(F.create_map(*[F.lit(x) for i in nodes for x in (i, f(i))]), F.col("node"))
        value = F.coalesce(*[F.when(F.col("node").isin([i for i in nodes if open_nodes[i].dim == d]), F.col(c)) for d, c in enumerate(DIMENSIONS)])
        rows = meta.select(at, "size", *DIMENSIONS).where(F.col("node").isin(nodes)).select("node", "size", value.alias("x"), pick(lambda i: float(want[i][0])).alias("lo"), pick(lambda i: float(want[i][1])).alias("hi"))
        slot = F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
        got = rows.where((F.col("x") >= F.col("lo")) & (F.col("x") < F.col("hi"))).groupBy("node", slot.alias("slot")).agg(F.sum("size").alias("bytes"), F.min("x").alias("least"), F.max("x").alias("most")).collect()
        per: dict[int, list] = {}
        for g in got:
            per.setdefault(g["node"], []).append((g["slot"], g["bytes"], g["least"], g["most"]))
        for i in nodes:
            lo, hi, below, goal, ok = want[i]
            n = open_nodes[i]
            for _, size, least, most in sorted(per.get(i, [])):
                if below + size <= goal:
                    below += size
                    continue
                # The cut is at this slot's first row, behind it, or inside it.
                if goal - below <= ok or least == most:
                    n.cut = least if goal - below <= below + size - goal else most + max(abs(most) * 2.0**-52, 2.0**-60)
                    del want[i]
                elif below + size - goal <= ok:
                    n.cut = most + max(abs(most) * 2.0**-52, 2.0**-60)
                    del want[i]
                else:
                    want[i][:3] = [least, most + max(abs(most) * 2.0**-52, 2.0**-60), below]
                break
            else:
                n.cut = hi
                del want[i]
    if want:
        raise RuntimeError("a cut was not found in so many rounds")


def _giant(groups: DataFrame, n_shards: int, total: int) -> tuple[list[tuple[bytes, int, list[int]]], list[float]]:
    """(key, rows, shards of the parts) of each group larger than a shard, and what
    each shard then has. A group has as many parts as shards that it fills, and
    not more than rows, which all have one size. The largest parts go first, each
    to the shard that has least."""
    share = total / n_shards
    parts, count = [], {}
    for r in groups.where(F.col("size") > share).select("same", "size", "one").collect():  # fewer than n_shards
        rows = r["size"] // r["one"]
        n = min(rows, int(-(-r["size"] // share)))
        count[bytes(r["same"])] = rows
        parts += [(((k + 1) * rows // n - k * rows // n) * r["one"], bytes(r["same"]), -k) for k in range(n)]
    load, placed = [(0.0, k) for k in range(n_shards)], {}
    for size, same, k in sorted(parts, reverse=True):
        least, at = heapq.heappop(load)
        heapq.heappush(load, (least + size, at))
        placed.setdefault(same, []).append((-k, at))
    return [(same, count[same], [at for _, at in sorted(each)]) for same, each in placed.items()], [x for x, _ in sorted(load, key=lambda x: x[1])]


def _lacks(have: list[float], total: float) -> list[float]:
    """What each shard lacks of the level up to which the rest fills the shards."""
    left, level, order = total - sum(have), 0.0, sorted(have)
    for k in range(1, len(order) + 1):
        level = (left + sum(order[:k])) / k
        if k == len(order) or level <= order[k]:
            break
    return [max(0.0, level - x) for x in have]


def _evened(load: list[float], heavy: list[list[tuple[int, bytes]]], light: list[float], slack: float) -> tuple[dict[bytes, int], list[tuple[int, int, float]]]:
    """New leaves of heavy groups, and bytes of light groups to pour from leaf to
    leaf. The fullest leaf gives the emptiest a heavy group, or changes one with
    it, whichever brings the two closest; where that is no gain the next emptiest
    is asked. heavy: size and key of each leaf's groups."""
    load, heavy, moved = np.array(load, float), [list(h) for h in heavy], {}
    near = slack * load.mean()

    def best(i: int) -> tuple[int, int, int] | None:
        """The leaf, the group to give it and the one to take from it (-1: none)."""
        for j in np.argsort(load).tolist():
            gap = load[i] - load[j]
            if gap <= near or not heavy[i]:
                return None
            give, take = np.array([s for s, _ in heavy[i]]), np.array([0] + [s for s, _ in heavy[j]])
            left = np.abs(gap - 2 * (give[:, None] - take[None, :]))
            a, b = np.unravel_index(np.argmin(left), left.shape)
            if left[a, b] < 0.9 * gap:
                return j, int(a), int(b) - 1
        return None

    for _ in range(40 * len(load)):
        i, found = next(((i, x) for i in np.argsort(-load).tolist() if (x := best(i))), (0, None))
        if found is None:
            break
        j, a, b = found
        one, other = heavy[i].pop(a), heavy[j].pop(b) if b >= 0 else None
        heavy[j].append(one)
        moved[one[1]] = j
        load[i], load[j] = load[i] - one[0], load[j] + one[0]
        if other:
            heavy[i].append(other)
            moved[other[1]] = i
            load[i], load[j] = load[i] + other[0], load[j] - other[0]
    # What of its light groups each leaf has beyond, or lacks of, the level that all of them could fill.
    extra = np.array(light) - np.array(_lacks((load - np.array(light)).tolist(), float(load.sum())))
    over, under, pours = [[i, x] for i, x in enumerate(extra.tolist()) if x > near / 2], [[j, -x] for j, x in enumerate(extra.tolist()) if x < 0], []
    while over and under:
        amount = min(over[-1][1], under[-1][1])
        pours.append((over[-1][0], under[-1][0], float(amount)))
        over[-1][1], under[-1][1] = over[-1][1] - amount, under[-1][1] - amount
        over, under = over[:-1] if over[-1][1] <= 0 else over, under[:-1] if under[-1][1] <= 0 else under
    return moved, pours


def _even_out(leaves: DataFrame, have: list[float], total: int, slack: float) -> DataFrame:
    """leaves: same, size, leaf of all groups that the tree has placed. same, shard, moved."""
    n, spark = len(have), leaves.sparkSession
    bar = total / n / HEAVY
    load, light, heavy = list(have), [0.0] * n, [[] for _ in range(n)]
    for r in leaves.groupBy("leaf").agg(F.sum("size").alias("all"), F.sum(F.when(F.col("size") <= bar, F.col("size")).otherwise(0)).alias("light")).collect():  # a row per shard
        load[r["leaf"]] += r["all"]
        light[r["leaf"]] = float(r["light"])
    for r in leaves.where(F.col("size") > bar).orderBy(F.desc("size"), "same").collect():  # at most HEAVY x n_shards
        heavy[r["leaf"]].append((r["size"], bytes(r["same"])))
    moved, pours = _evened(load, heavy, light, slack)
    changed = spark.createDataFrame([(k, v) for k, v in moved.items()], "same binary, to int")
    out = leaves.join(F.broadcast(changed), "same", "left")
    if pours:
        # A leaf's light groups in the order of a hash, up to the bytes that it pours out.
        bounds: dict[int, list[tuple[float, int]]] = {}
        for i, j, amount in pours:
            each = bounds.setdefault(i, [])
            each.append((amount + (each[-1][0] if each else 0.0), j))
        some = leaves.where((F.col("size") <= bar) & F.col("leaf").isin(list(bounds))).withColumn("h", F.xxhash64("same"))
        some = prefix_sums(some, ["leaf"], "h", ["same"], "size", blocks_for(leaves.count() // n, 4000), "before")
        to = F.coalesce(*[F.when((F.col("leaf") == i) & (F.col("before") + F.col("size") / 2 < top), j) for i, each in bounds.items() for top, j in each])
        poured = settle(some.select("same", to.cast("int").alias("poured")).where("poured is not null"), "poured")
        out = out.join(few(poured, 100_000), "same", "left").withColumn("to", F.coalesce("to", "poured"))
    return out.select("same", F.coalesce("to", "leaf").alias("shard"), F.when(F.col("to") == F.col("leaf"), None).otherwise(F.col("to")).isNotNull().alias("moved"))


def shards(docs: DataFrame, n_shards: int = 40, bins: int = 2048, slack: float = 0.002) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot,
    grown_shard, placed_by.

    The law is bytes: the shards have near equal sizes (within slack, or what the
    groups allow). Equal texts have the same shard; only a group larger than a
    shard is dealt, by rows, to as many as it needs. shard numbers the leaves from
    0; slot numbers the documents of a shard from 0 without gaps. grown_shard is
    null under this law. placed_by: cut (where the tree put it), moved (a group
    that evened the leaves) or dealt (of a group larger than a shard). A null text
    has no bytes but its overhead and goes with the empty texts. Rows that repeat
    a doc_id are rows of their own. Other columns than doc_id, text, source and
    lang are not read. An empty table gives an empty result.
    """
    rows = settle(metadata(docs), "metadata")
    groups = settle(rows.groupBy("same").agg(F.sum("size").alias("size"), F.min("size").alias("one"), F.min("source").alias("source"), F.min("lang").alias("lang")), "groups")
    total = groups.agg(F.sum("size")).first()[0] or 0
    giant, have = _giant(groups, n_shards, total)
    dealt = rows.sparkSession.createDataFrame(giant, "same binary, many long, parts array<int>")
    light = settle(points(groups.join(F.broadcast(dealt), "same", "left_anti")), "points")
    root = Node(_lacks(have, float(total)), 0)
    level = [root]
    while level := [n for n in level if n.leaves > 1]:
        _cuts(light, root, level, bins, slack)
        below = []
        for n in level:
            half = n.leaves // 2
            n.low, n.high = Node(n.goals[:half], n.first), Node(n.goals[half:], n.first + half)
            below += [n.low, n.high]
        level = below
    leaves = settle(light.select("same", "size", _place(root, lambda n: n.first).cast("int").alias("leaf")), "leaves")
    placed = settle(_even_out(leaves, have, total, slack), "placed")
    columns = ["doc_id", "size", "text_crc32", "shard", F.xxhash64("doc_id", "row").alias("h"), F.lit(1).alias("one")]
    of_giant = rows.join(F.broadcast(dealt), "same").withColumn("h", F.xxhash64("row", F.lit(3))).withColumn("one", F.lit(1))
    if giant:  # each row's rank in its group says which part it is of
        bits = blocks_for(max(many for _, many, _ in giant), 4000)
        of_giant = prefix_sums(of_giant, ["same"], "h", ["row"], "one", bits, "rank")
        # Part k begins at row k * many div parts.
        of_giant = of_giant.withColumn("part", F.expr("((rank + 1) * size(parts) - 1) div many").cast("int")).withColumn("shard", F.element_at("parts", F.col("part") + 1))
    else:
        of_giant = of_giant.withColumn("shard", F.lit(0))
    of_tree = rows.join(F.broadcast(dealt), "same", "left_anti").join(few(placed, 100_000), "same")
    both = settle(of_giant.select(*columns, F.lit("dealt").alias("placed_by")).union(of_tree.select(*columns, F.when(F.col("moved"), "moved").otherwise("cut").alias("placed_by"))), "dealt")
    bits = blocks_for(max(1, both.count() // n_shards), 4000)
    ranked = prefix_sums(both, ["shard"], "h", ["doc_id", "text_crc32"], "one", bits, "slot")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "placed_by")

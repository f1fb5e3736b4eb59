"""Exact Jaccard join of documents on word shingles, by universe partition.

All shingles (as 64-bit hashes) are dealt into segments. Two sets that differ in
at most H shingles agree, by the pigeonhole principle, on one of the segments
whose allowances add up to H + 1: a segment with allowance 1 has to be equal, one
with allowance 2 may differ by one shingle, which its one-deletion neighbourhood
finds; allowance 0 asks for nothing. Sizes are banded by powers of two, and each
band has its own number of segments. The smaller set of a pair probes its own
band and, where a partner can be there, the next one; every set is indexed in
its own band. The probing set deals its allowances to the segments that cost
least: those without very common shingles first, then deletion neighbourhoods,
common segments last, and never an empty one. Common shingles are known from a
bounded sample; that only steers cost. Sets below 64 shingles have a segment per
shingle.

A signature that many sets share would make pairs without end. So no row stands
for a pair: each signature is led by the set of smallest hash that has it, and
what remains is who shares how many signatures with which leader. Any two sets
that share a signature are members of the group of its leader. Each set is first
tested with the leader it shares most with; a group that is not one component
after that is compared as blocks of parity sketches, first for a forest of the
nearest pairs, then for all pairs that are still apart. A sketch bounds the
intersection from above, so what it excludes can't link; what it allows is
compared word by word, on the texts. No link that joins components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.llm.common import components, discard, few, ids_as_numbers, ids_as_text, lean, release, settle, small_batches

U = np.uint64
TINY = 64  #: sets below this size have a segment per shingle
SLACK = 1.12  #: segments over those that the allowances need
DELETION_SHARE = 8  #: one in so many segments is indexed with its deletion neighbourhood
INDEX, PROBE = 1, 2
BUCKET_BYTES = 8 << 20  #: codes of a bucket, which one task sorts
TOGETHER = 4  #: buckets that a task takes, and adds up, together
CODE_BYTES = 5  #: of a signature and its flags within a bucket; what collides by chance is only compared
BLOCK, BLOCKS, BLOCK_MOST = 400, 16, 2000  #: members of a block of a group; blocks up to which they are so few; members at most
BLOCK_BYTES = 8 << 20  #: of the sketches of a block


def _mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Finalizer of a 64-bit hash."""
    with np.errstate(over="ignore"):
        z = x + U((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> U(30))) * U(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> U(27))) * U(0x94D049BB133111EB)
        return z ^ (z >> U(31))


class WordHashes(dict):
    """word -> 64-bit hash; most bounds the memory."""

    most = 150_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


def shingles(text, words: WordHashes, width: int = 5) -> np.ndarray:
    """Distinct shingle hashes, sorted. Words are runs of what is not U+0020 or
    U+0009 to U+000D, with A-Z in lower case; fewer than width are one shingle."""
    if not isinstance(text, str):
        return np.zeros(0, U)
    parts = text.encode("utf-8", "replace").lower().split()
    if not parts:
        return np.zeros(0, U)
    w = np.fromiter(map(words.__getitem__, parts), U, len(parts))
    with np.errstate(over="ignore"):
        n = max(1, len(w) - width + 1)
        h = np.full(n, U(min(len(w), width)))
        for i in range(min(len(w), width)):
            h = h * U(0x5851F42D4C957F2D) + w[i : i + n]
    return np.unique(_mix(h))


class Threshold:
    """A share of p / q, in whole numbers."""

    def __init__(self, p: int = 75, q: int = 100):
        self.p, self.q = p, q

    def largest_partner(self, n: int) -> int:
        return n * self.q // self.p

    def differences(self, both: int) -> int:
        """Most shingles by which two linked sets of so many together differ."""
        return both * (self.q - self.p) // (self.q + self.p)

    def linked(self, common, a, b):
        return (common * (self.p + self.q) >= self.p * (a + b)) & (common > 0)


def band_of(n: int) -> int:
    return 0 if n < TINY else n.bit_length() - 1


def segments_of(band: int, t: Threshold) -> int:
    return int(np.ceil(SLACK * (t.differences(2 * (2 ** (band + 1) - 1)) + 1)))


class Marked:
    """A set with what all bands need of it: hashes and how common each is."""

    def __init__(self, h: np.ndarray, hot: tuple[np.ndarray, np.ndarray]):
        keys, counts = hot
        self.h, self.common = h, np.zeros(len(h), np.int64)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            self.common = np.where(keys[at] == h, counts[at], 0)
        self.spread, self.part = _mix(h, 2), _mix(h, 3)


def _emit(s: Marked, band: int, bound: int, index: bool, t: Threshold) -> tuple[np.ndarray, int] | None:
    """Codes (signature * 4 + flags) of a set in a band, and how many of the
    probing ones a partner shares at least; None if the allowances can't reach
    bound + 1, bound being the differences of a link.

    Allowances beyond bound + 1 that cost nothing more are dealt too: bound
    differences spoil so many of them at most, and a partner shares the rest.
    """
    need = bound + 1
    if band == 0:
        sig = _mix(s.h, 1)
        flags = np.full(len(sig), INDEX if index else 0, np.int64)
        cheap = np.lexsort((sig, s.common))[:need]
        flags[cheap] |= PROBE
        return (_codes(sig[flags > 0], flags[flags > 0]), 1) if need <= len(sig) else None
    m = segments_of(band, t)
    seg = (s.spread % U(m)).astype(np.uint16 if m < 65_536 else np.int64)
    order = np.argsort(seg, kind="stable")
    seg, part = seg[order].astype(np.int64), s.part[order]
    starts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
    ids, sizes = seg[starts], np.diff(np.r_[starts, len(seg)])
    with np.errstate(over="ignore"):
        content = np.add.reduceat(part, starts)
        place = _mix((ids + band * 1_000_003).astype(U), 4)
        sig = _mix(content + place)
    price = np.minimum.reduceat(s.common[order], starts) * 50 + 1  # a segment is as common as its rarest shingle
    able = (ids % DELETION_SHARE == 0) & (sizes >= 2)
    costs = np.r_[price, np.where(able, price + sizes + 1, 1 << 60)]
    by_cost = np.argsort(costs, kind="stable")
    units = by_cost[:need]
    if len(units) < need or costs[units[-1]] >= 1 << 60:
        return None
    free = by_cost[need : len(ids) if index else need + 3]
    units = np.r_[units, free[(free < len(ids)) & (costs[free] == 1)]]
    probe, twice = units[units < len(ids)], units[units >= len(ids)] - len(ids)
    flags = np.full(len(ids), INDEX if index else 0, np.int64)
    flags[probe] |= PROBE
    out = [_codes(sig[flags > 0], flags[flags > 0])]
    for chosen, flag in ((twice, PROBE), (np.flatnonzero(able) if index else twice[:0], INDEX)):
        if len(chosen):
            mine = np.zeros(len(ids), bool)
            mine[chosen] = True
            owner = np.repeat(np.arange(len(ids)), sizes)
            take = mine[owner]
            with np.errstate(over="ignore"):
                gone = _mix(content[owner[take]] - part[take] + place[owner[take]])
            out.append(_codes(gone, np.full(len(gone), flag, np.int64)))
    return np.concatenate(out), max(1, len(units) - bound - len(twice))


def _codes(sig: np.ndarray, flags: np.ndarray) -> np.ndarray:
    return ((sig << U(2)) | flags.astype(U)).view(np.int64)


def signatures(h: np.ndarray, hot: tuple[np.ndarray, np.ndarray], t: Threshold) -> tuple[np.ndarray, int, int, int] | None:
    """Codes; how many are of the set's own band; what partners share there and
    in the band above at least."""
    n, s = len(h), Marked(h, hot)
    band = band_of(n)
    top = TINY - 1 if band == 0 else 2 ** (band + 1) - 1
    most = t.largest_partner(n)
    own = _emit(s, band, t.differences(n + min(top, most)), True, t)
    if own is None:
        return None
    if most <= top:
        return own[0], len(own[0]), own[1], 1
    above = _emit(s, band_of(top + 1), t.differences(n + most), False, t)
    return None if above is None else (np.concatenate([own[0], above[0]]), len(own[0]), own[1], above[1])


SKETCH_BITS = 1 << 22  #: of a sketch at most; fewer bits only exclude less


def sketch(h: np.ndarray) -> bytes:
    """The set's size and, for four to eight bits per shingle, the parity of
    how many shingles fall on each bit."""
    bits = max(64, min(SKETCH_BITS, 4 << len(h).bit_length()))
    odd = np.bincount((_mix(h, 5) & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.int32(len(h)).tobytes() + np.packbits(odd.astype(np.uint8)).tobytes()


def _odd(x: bytes, y: bytes) -> int:
    """In how many shingles the sets of two sketches differ at least. Each one
    that is in one set alone flips one bit. The longer sketch is folded to the
    shorter one's length first."""
    a, b = np.frombuffer(x, np.uint8, offset=4), np.frombuffer(y, np.uint8, offset=4)
    if len(a) > len(b):
        a, b = b, a
    if len(a) < len(b):
        b = np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64))


def may_link(x: bytes, y: bytes, t: Threshold) -> bool:
    """False only if the sets can't link."""
    both = int(np.frombuffer(x, np.int32, 1)[0]) + int(np.frombuffer(y, np.int32, 1)[0])
    return (both - _odd(x, y)) // 2 * (t.p + t.q) >= t.p * both


def _common_shingles(docs: DataFrame, width: int, sample: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that occur in at least 4 of about sample documents, the most
    frequent ones, with counts. Only costs hang on them."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for batch in batches:
            for text in batch["text"]:
                yield pd.DataFrame({"s": shingles(text, words, width).view(np.int64)})

    one_in = max(1, docs.count() // sample)
    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(77)), F.lit(one_in)) == 0).select("text")
    rows = some.mapInPandas(lean(count), "s long").groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n >= 4").orderBy(F.desc("n"), "s").limit(most).toPandas()
    keys = rows["s"].to_numpy(dtype=np.int64).view(U)
    order = np.argsort(keys)
    return keys[order], rows["n"].to_numpy(dtype=np.int64)[order]


def similar(docs: DataFrame, threshold: Threshold | None = None, width: int = 5, sample: int = 4000, hot_most: int = 50_000) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    A set is the distinct shingles of width words of the whole text; fewer words
    are one shingle; without words or text it is empty and links with nothing.
    Sets link whose intersection is at least the threshold's share of their
    union. component_id is the smallest doc_id reachable by links, itself
    included. Rows with a null doc_id link with nothing and have a null
    component. Rows that share a doc_id are one node with the links of all of
    them. Other columns are not read. An empty table gives an empty result.
    """
    t = threshold or Threshold()
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    hot = spark.sparkContext.broadcast(_common_shingles(docs, width, sample, hot_most))

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        words, seen = WordHashes(), set()
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
                h = shingles(text, words, width)
                known = doc is not None
                print_ = xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None
                codes, drawn, placed, own, r_own, r_above = b"", None, True, 0, 1, 1
                # A copy of what this task has seen shares its signatures and is linked by its print alone.
                if known and print_ and print_ not in seen:
                    if len(seen) >= 500_000:
                        seen.clear()
                    seen.add(print_)
                    got = signatures(h, hot.value, t)
                    placed = got is not None
                    if got is not None:
                        codes, drawn, own, r_own, r_above = got[0].tobytes(), sketch(h), *got[1:]
                rows.append((doc, len(h), print_, codes, len(codes) // 8, drawn, placed, own, r_own, r_above))
            yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "print", "codes", "n_codes", "sketch", "placed", "own", "r_own", "r_above"])

    with small_batches(spark):
        meta = settle(ids_as_numbers(ids_as_text(docs).mapInPandas(lean(describe), "doc_id string, n_shingles long, print binary, codes binary, n_codes int, sketch binary, placed boolean, own int, r_own int, r_above int")).withColumn("row", F.monotonically_increasing_id()), "sets")
    same = meta.where("print is not null and doc_id is not null").select(F.col("print").alias("p"), "doc_id")
    reps = same.groupBy("p").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").select("p", "rep")
    copies = settle(same.join(few(settle(reps, "prints")), "p").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).where("a <> b").distinct(), "copies")

    total = meta.agg(F.sum(F.col("n_codes").cast("long"))).first()[0] or 0
    buckets = min(1 << 16, max(256, total * 8 // BUCKET_BYTES))
    parts = max(spark.sparkContext.defaultParallelism, total * 8 // (2 * BUCKET_BYTES))  # so that a task's share stays as it is when the table grows
    coded = meta.where("n_codes > 0").select("row", "codes")
    dealt = coded.mapInPandas(lean(_spread(buckets)), "bucket int, part long, codes binary, who binary, times binary").repartition(parts, F.expr(f"bucket div {TOGETHER}")).sortWithinPartitions("bucket")
    with small_batches(spark, 10_000):
        met = settle(dealt.mapInPandas(lean(_meetings), "leader long, key long, doc long, times int"), "met")
    sketches = settle(meta.where("sketch is not null").select("doc_id", "sketch"), "sketches")
    large, meta = meta, settle(meta.select("row", "doc_id", F.col("n_shingles").cast("int").alias("n"), "placed", F.least("r_own", "r_above").alias("r")), "sizes")
    members = settle(_members(met, meta), "members")
    discard(large)
    discard(met)
    release(spark)

    links: list[DataFrame] = []
    tested: list[DataFrame] = []

    def test(pairs: DataFrame) -> None:
        pairs = settle(pairs, "pairs")
        if pairs.limit(1).count():
            links.append(_verified(docs, pairs, t, width))
            tested.append(pairs)

    def found() -> DataFrame:
        return settle(components(_all(links)), "components") if links else spark.createDataFrame([], "node long, component long")

    test(copies)
    test(_possible(sketches, settle(_with_leader(members), "led"), t))
    # A forest of each group's nearest pairs; where all of it links, what else the group's sketches allow is connected.
    apart = settle(_still_apart(members, few(found()), t), "apart")
    if apart.limit(1).count():
        forest = _block_pairs(apart, sketches, t, False)
        test(_without(forest.select("a", "b").distinct(), tested))
        failed = forest.join(_all(links).distinct(), ["a", "b"], "left_anti").select("leader").distinct()
        open_ = settle(_still_apart(members.join(few(settle(failed, "failed")), "leader", "left_semi"), few(found()), t), "apart")
        if open_.limit(1).count():
            test(_without(_block_pairs(open_, sketches, t, True).select("a", "b").distinct(), tested))
    unplaced = settle(meta.where("not placed").select("doc_id"), "unplaced")
    if unplaced.limit(1).count():
        links.append(_against_all(docs, unplaced, t, width))
    named = meta.join(found().withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return named.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _spread(buckets: int):
    """Deals the codes of sets out to buckets by their highest bits. A bucket's
    share of some sets of a part of the table is one row of arrays: the lowest
    bytes of each code, and per set its place in the part and number of codes."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            parts = whole["row"].to_numpy() >> 33
            cuts = np.flatnonzero(parts[1:] != parts[:-1]) + 1
            for first, last in zip([0, *cuts.tolist()], [*cuts.tolist(), len(whole)], strict=True):
                for at in range(first, last, 2000):
                    b = whole.iloc[at : min(last, at + 2000)]
                    codes = np.frombuffer(b"".join(b["codes"]), U)
                    place = (b["row"].to_numpy() & ((1 << 33) - 1)).astype(np.uint32)
                    owner = np.repeat(np.arange(len(b)), b["codes"].str.len().to_numpy() // 8)
                    bucket = ((codes >> U(48)) * U(buckets) >> U(16)).astype(np.int64)
                    order = np.argsort(bucket.astype(np.uint16), kind="stable")
                    bucket, owner = bucket[order], owner[order]
                    short = np.ascontiguousarray(codes[order].view(np.uint8).reshape(-1, 8)[:, :CODE_BYTES])
                    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                    rows = []
                    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(bucket)], strict=True):
                        begin = np.flatnonzero(np.r_[True, owner[lo + 1 : hi] != owner[lo : hi - 1]])
                        times = np.diff(np.r_[begin, hi - lo]).astype(np.uint32)
                        rows.append((int(bucket[lo]), int(parts[at]), short[lo:hi].tobytes(), place[owner[lo:hi][begin]].tobytes(), times.tobytes()))
                    yield pd.DataFrame(rows, columns=["bucket", "part", "codes", "who", "times"])

    return spread


def _meetings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per few buckets, which rows share how many signatures with which leader
    (the row of smallest hash that has the signature). A partition's rows come by
    bucket. Where a bucket outgrows its size, by signatures that very many rows
    have, these go out at once, by key and without a leader."""
    at, held, size, often = None, [], 0, np.zeros(0, np.int64)
    sums: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for batch in batches:
        for bucket, part, codes, who, times in batch.itertuples(index=False):
            if bucket != at:
                yield from _led(held, often, sums)
                if at is not None and at // TOGETHER != bucket // TOGETHER:
                    yield from _summed(sums)
                    sums = []
                at, held, size, often = bucket, [], 0, np.zeros(0, np.int64)
            padded = np.zeros((len(codes) // CODE_BYTES, 8), np.uint8)
            padded[:, :CODE_BYTES] = np.frombuffer(codes, np.uint8).reshape(-1, CODE_BYTES)
            code = padded.view(np.int64).ravel()
            doc = np.repeat(np.frombuffer(who, np.uint32).astype(np.int64) | np.int64(part) << 33, np.frombuffer(times, np.uint32))
            # With the bucket before it, a key differs from those of other buckets.
            held.append((code >> 2 | np.int64(bucket) << 40, (code & 3).astype(np.int8), doc))
            size += len(code)
            if size > BUCKET_BYTES // 2:
                rows = [np.concatenate(x) for x in zip(*held, strict=True)]
                keys, counts = np.unique(rows[0], return_counts=True)
                often = np.union1d(often, keys[counts > 1000])
                out = np.isin(rows[0], often)
                if out.any():
                    yield _loose([x[out] for x in rows])
                held = [tuple(x[~out] for x in rows)]
                size = len(held[0][0]) // 2  # asks again after as many new rows
    yield from _led(held, often, sums)
    yield from _summed(sums)


def _summed(sums: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pd.DataFrame]:
    if not sums:
        return
    leader, doc, times = (np.concatenate(x) for x in zip(*sums, strict=True))
    order = np.lexsort((doc, leader))
    leader, doc, times = leader[order], doc[order], times[order]
    starts = np.flatnonzero(np.r_[True, (leader[1:] != leader[:-1]) | (doc[1:] != doc[:-1])])
    out = pd.DataFrame({"leader": pd.array(leader[starts], "Int64"), "key": np.int64(0), "doc": doc[starts], "times": np.add.reduceat(times, starts).astype(np.int32)})
    for lo in range(0, len(out), 200_000):
        yield out.iloc[lo : lo + 200_000]


def _loose(rows) -> pd.DataFrame:
    key, _, doc = rows
    return pd.DataFrame({"leader": pd.array([None] * len(key), "Int64"), "key": key, "doc": doc, "times": np.ones(len(key), np.int32)})


def _led(held: list, often: np.ndarray, sums: list) -> Iterator[pd.DataFrame]:
    """Adds leader, row and number of shared signatures of a bucket to sums."""
    if not held:
        return
    rows = [np.concatenate(x) for x in zip(*held, strict=True)]
    out = np.isin(rows[0], often)
    if out.any():
        yield _loose([x[out] for x in rows])
        rows = [x[~out] for x in rows]
    if not len(rows[0]):
        return
    order = np.argsort(rows[0], kind="stable")
    key, flags, doc = (x[order] for x in rows)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    counts = np.diff(np.r_[starts, len(key)])
    keep = np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts)
    keep &= (np.bitwise_or.reduceat(flags, starts) & 3) == 3
    doc, counts = doc[np.repeat(keep, counts)], counts[keep]
    if not len(doc):
        return
    starts = np.r_[0, np.cumsum(counts)[:-1]]
    rank = _mix(doc.view(U), 6)
    key = np.repeat(np.arange(len(counts)), counts)
    first = np.flatnonzero(rank == np.repeat(np.minimum.reduceat(rank, starts), counts))
    leader = np.zeros(len(counts), np.int64)
    leader[key[first]] = doc[first]
    leader = np.repeat(leader, counts)
    order = np.lexsort((doc, leader))
    leader, doc = leader[order], doc[order]
    starts = np.flatnonzero(np.r_[True, (leader[1:] != leader[:-1]) | (doc[1:] != doc[:-1])])
    sums.append((leader[starts], doc[starts], np.diff(np.r_[starts, len(doc)])))


def _members(met: DataFrame, sizes: DataFrame) -> DataFrame:
    """leader, doc (ids), n (shingles), times (signatures that the document
    shares with the leader's), r (how many a link of theirs needs at least)."""
    loose = met.where("leader is null")
    heads = settle(loose.groupBy("key").agg(F.min(F.struct(F.xxhash64("doc"), "doc"))["doc"].alias("leader"), F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo <> hi").select("key", "leader"), "heads")
    rest = loose.select("key", "doc", "times").join(few(heads), "key")
    whole = met.where("leader is not null").select("leader", "doc", "times").union(rest.select("leader", "doc", "times"))
    by_row = settle(whole.groupBy("leader", "doc").agg(F.sum("times").alias("times")), "rows")
    own = sizes.select(F.col("row").alias("doc"), F.col("doc_id").alias("d"), "n", F.col("r").alias("rd"))
    led = sizes.select(F.col("row").alias("leader"), F.col("doc_id").alias("l"), F.col("r").alias("rl"))
    named = by_row.join(own, "doc").join(led, "leader")
    return named.groupBy(F.col("l").alias("leader"), F.col("d").alias("doc")).agg(F.max("n").alias("n"), F.sum("times").alias("times"), F.min(F.least("rd", "rl")).alias("r"))


def _all(links: list[DataFrame]) -> DataFrame:
    out = links[0].select("a", "b")
    for x in links[1:]:
        out = out.union(x.select("a", "b"))
    return out


def _ordered(a, b):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def _without(pairs: DataFrame, tested: list[DataFrame]) -> DataFrame:
    return pairs.join(_all(tested), ["a", "b"], "left_anti") if tested else pairs


def _with_leader(members: DataFrame) -> DataFrame:
    """One pair per document at most: with the leader that it shares most signatures with."""
    able = members.where("doc <> leader and times >= r")
    best = able.groupBy("doc").agg(F.max_by("leader", F.struct("times", "leader")).alias("leader"))
    return best.select(*_ordered(F.col("doc"), F.col("leader"))).distinct()


def _still_apart(members: DataFrame, known: DataFrame, t: Threshold) -> DataFrame:
    """Members of the groups that are more than one component; blocks: how many blocks a group is dealt into."""
    named = members.select("leader", "doc", "n").join(known.select(F.col("node").alias("doc"), F.col("component").alias("c")), "doc", "left").select("leader", "doc", "n", F.coalesce("c", "doc").alias("comp"))
    named = settle(named, "named")
    size = F.count(F.lit(1))
    blocks = F.greatest(F.least(F.ceil(size / BLOCK), F.greatest(F.lit(BLOCKS), F.ceil(size / BLOCK_MOST))), F.ceil(F.sum(F.col("n").cast("long")) / BLOCK_BYTES))
    groups = named.groupBy("leader").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), blocks.cast("int").alias("blocks"), size.alias("size"), F.min("n").alias("least"), F.max("n").alias("most"))
    # Of two members alone, sizes can rule a link out.
    groups = groups.where("lo <> hi").where((F.col("size") > 2) | (F.col("most") * t.p <= F.col("least") * t.q)).select("leader", "blocks")
    return named.join(few(settle(groups, "groups")), "leader")


def _block_pairs(apart: DataFrame, sketches: DataFrame, t: Threshold, every: bool) -> DataFrame:
    """leader, a, b: pairs of a group, of different components and with sketches
    that allow a link: all of them, or the forest of the nearest ones of each two
    blocks.

    A group's documents are dealt into blocks; two blocks at a time are compared
    in one task, as arrays. Only what the sketches allow becomes rows.
    """
    drawn = apart.join(sketches.withColumnRenamed("doc_id", "doc"), "doc").withColumn("block", F.pmod(F.xxhash64("doc", F.lit(9)), "blocks").cast("int"))
    met = drawn.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("leader", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc", "n", "comp", "sketch")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole_groups(batches, ["leader", "i", "j"]):
            got = _compare(rows, t, every) if len(rows) > 24 else _compare_few(rows, t, every)
            if len(got):
                yield got.assign(leader=rows["leader"].iat[0])

    with small_batches(apart.sparkSession, 2000):
        found = settle(met.repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j").mapInPandas(lean(compare), "doc long, other long, leader long"), "compared")
    return found.select("leader", *_ordered(F.col("doc"), F.col("other")))


def _whole_groups(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of a partition whose rows come sorted by their keys."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = batch[by].to_numpy()
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        parts = [batch.iloc[lo:hi] for lo, hi in zip([0, *cuts], [*cuts, len(batch)], strict=True)]
        if held and (held[-1][by].iloc[0].to_numpy() != keys[0]).any():
            yield pd.concat(held)
            held = []
        held.append(parts[0])
        for part in parts[1:]:
            yield pd.concat(held) if len(held) > 1 else held[0]
            held = [part]
    if held:
        yield pd.concat(held)


def _signs(drawn: np.ndarray) -> np.ndarray:
    """Sketches as rows of +1 and -1: a product is the equal bits less the odd ones."""
    return 1 - 2 * np.unpackbits(drawn, axis=1).astype(np.float32)


def _compare(rows: pd.DataFrame, t: Threshold, every: bool) -> pd.DataFrame:
    """The pairs of one or two blocks that may link and are in different
    components; unless every, a forest of the nearest ones."""
    rows = rows.sort_values("n", kind="stable")
    cross = rows["i"].iat[0] != rows["j"].iat[0]
    doc, n, comp, block = (rows[c].to_numpy(dtype=np.int64) for c in ("doc", "n", "comp", "block"))
    drawn = [np.frombuffer(x, np.uint8, offset=4) for x in rows["sketch"]]
    lengths = np.array([len(x) for x in drawn])
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    # The rows are sorted by size, and so by length of the sketch: the larger set of a pair comes later.
    for narrow in np.unique(lengths):
        step = max(1, (4 << 20) // int(8 * narrow))
        for wide in np.unique(lengths[lengths >= narrow]):
            xs, ys = np.flatnonzero(lengths == narrow), np.flatnonzero(lengths == wide)
            if t.p * int(n[ys].min()) > t.q * int(n[xs].max()):
                continue
            for y in (ys[k : k + step] for k in range(0, len(ys), step)):
                folded = _signs(np.bitwise_xor.reduce(np.stack([drawn[k] for k in y]).reshape(len(y), -1, narrow), axis=1)).T
                for x in (xs[k : k + step] for k in range(0, len(xs), step)):
                    if t.p * int(n[y[0]]) > t.q * int(n[x[-1]]) or x[0] > y[-1]:
                        continue
                    ok = (x[:, None] < y) & (comp[x][:, None] != comp[y]) & (t.p * n[y] <= t.q * n[x][:, None])
                    if cross:
                        ok &= block[x][:, None] != block[y]
                    if not ok.any():
                        continue
                    odd = ((8 * narrow - _signs(np.stack([drawn[k] for k in x])) @ folded) / 2).astype(np.int64)
                    both = n[x][:, None] + n[y]
                    ok &= (both - odd) // 2 * (t.p + t.q) >= t.p * both
                    at, to = np.nonzero(ok)
                    found.append((x[at], y[to], odd[ok] / both[ok]))
    if not found:
        return pd.DataFrame({"doc": doc[:0], "other": doc[:0]})
    a, b, far = (np.concatenate(z) for z in zip(*found, strict=True))
    if not every:
        some = _forest(a, b, far, comp)
        a, b = a[some], b[some]
    return pd.DataFrame({"doc": doc[a], "other": doc[b]})


def _forest(a: np.ndarray, b: np.ndarray, far: np.ndarray, comp: np.ndarray) -> np.ndarray:
    """Pairs (a, b) that join all of comp which they can: each component takes
    its nearest pair, again and again."""
    at = np.unique(comp, return_inverse=True)[1]
    order = np.argsort(far, kind="stable")
    left, taken = order, []
    while len(left):
        best = np.full(len(comp), len(left))
        place = np.arange(len(left))
        np.minimum.at(best, at[a[left]], place)
        np.minimum.at(best, at[b[left]], place)
        chosen = left[np.unique(best[best < len(left)])]
        taken.append(chosen)
        low = np.arange(len(comp))
        while True:
            p, q = low[at[a[chosen]]], low[at[b[chosen]]]
            new = low.copy()
            np.minimum.at(new, np.maximum(p, q), np.minimum(p, q))
            new = new[new]
            if (new == low).all():
                break
            low = new
        at = low[at]
        left = left[at[a[left]] != at[b[left]]]
    return np.concatenate(taken) if taken else order


def _compare_few(rows: pd.DataFrame, t: Threshold, every: bool) -> pd.DataFrame:
    """The same for a handful of members, pair by pair."""
    doc, n, comp, block, drawn = (rows[c].tolist() for c in ("doc", "n", "comp", "block", "sketch"))
    cross = rows["i"].iat[0] != rows["j"].iat[0]
    found = []
    for i in range(len(doc)):
        for j in range(i):
            if comp[i] != comp[j] and not (cross and block[i] == block[j]) and t.p * max(n[i], n[j]) <= t.q * min(n[i], n[j]):
                odd = _odd(drawn[i], drawn[j])
                if (n[i] + n[j] - odd) // 2 * (t.p + t.q) >= t.p * (n[i] + n[j]):
                    found.append((i, j, odd / (n[i] + n[j])))
    if found and not every:
        a, b, far = (np.array(x) for x in zip(*found, strict=True))
        found = [found[k] for k in _forest(a, b, far, np.array(comp))]
    return pd.DataFrame([(doc[i], doc[j]) for i, j, _ in found], columns=["doc", "other"])


def _possible(sketches: DataFrame, pairs: DataFrame, t: Threshold) -> DataFrame:
    """The pairs that may link by their sketches."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yes = [any(may_link(x, y, t) for x in xs for y in ys) for xs, ys in zip(batch["sa"], batch["sb"], strict=True)]
            yield batch.loc[yes, ["a", "b"]]

    ends = few(_ends(pairs))
    drawn = sketches.join(ends, "doc_id").select("a", "b", F.when(F.col("doc_id") == F.col("a"), F.col("sketch")).alias("sa"), F.when(F.col("doc_id") == F.col("b"), F.col("sketch")).alias("sb"))
    met = drawn.groupBy("a", "b").agg(F.collect_set("sa").alias("sa"), F.collect_set("sb").alias("sb"))
    return met.mapInPandas(lean(compare), "a long, b long")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b", F.explode(F.array("a", "b")).alias("doc_id"))


def _same_share(x: str, y: str, t: Threshold, width: int) -> bool:
    """Whether the sets of two texts link, by their words and not by hashes."""
    words: dict[bytes, int] = {}
    parts = [[words.setdefault(w, len(words)) for w in z.encode("utf-8", "replace").lower().split()] for z in (x, y)]
    if not parts[0] or not parts[1]:
        return False
    if min(map(len, parts)) < width and len(parts[0]) != len(parts[1]):
        return False  # a whole short text is one shingle, of fewer words than any other
    ids = [np.array(p, np.int64) for p in parts]
    k = min(width, len(parts[0]))
    n = [len(p) - k + 1 for p in ids]
    code = np.concatenate([p[:m] for p, m in zip(ids, n, strict=True)])
    for i in range(1, k):
        code = code * len(words) + np.concatenate([p[i : i + m] for p, m in zip(ids, n, strict=True)])
        code = np.unique(code, return_inverse=True)[1]
    a, b = np.unique(code[: n[0]]), np.unique(code[n[0] :])
    common = len(a) + len(b) - len(np.union1d(a, b))
    return bool(t.linked(common, len(a), len(b)))


def _verified(docs: DataFrame, pairs: DataFrame, t: Threshold, width: int) -> DataFrame:
    """The pairs that link, by their whole texts."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yes = [any(_same_share(x, y, t, width) for x in xs for y in ys) for xs, ys in zip(batch["ta"], batch["tb"], strict=True)]
            yield batch.loc[yes, ["a", "b"]]

    # Texts go to their pairs once; both of a pair then meet under its key, so no document gathers its partners.
    made = docs.join(few(_ends(pairs)), "doc_id").select("a", "b", F.when(F.col("doc_id") == F.col("a"), F.col("text")).alias("ta"), F.when(F.col("doc_id") == F.col("b"), F.col("text")).alias("tb"))
    met = made.groupBy("a", "b").agg(F.collect_set("ta").alias("ta"), F.collect_set("tb").alias("tb"))
    with small_batches(docs.sparkSession, 500, "8m"):
        out = settle(met.mapInPandas(lean(compare), "a long, b long"), "links")
    release(docs.sparkSession)
    return out


def _against_all(docs: DataFrame, few: DataFrame, t: Threshold, width: int, block: int = 256) -> DataFrame:
    """Links of a few documents with all others, a block of them at a time: for
    the sets, hardly ever any, whose shingles leave too many segments empty."""
    spark, out = docs.sparkSession, None
    ids = [r[0] for r in few.distinct().orderBy("doc_id").toLocalIterator()]
    for at in range(0, len(ids), block):
        mine = docs.where(F.col("doc_id").isin(ids[at : at + block])).collect()
        words = WordHashes()
        held = spark.sparkContext.broadcast([(r["doc_id"], shingles(r["text"], words, width)) for r in mine])

        def meet(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            cache = WordHashes()
            for batch in batches:
                got = []
                for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                    h = shingles(text, cache, width)
                    for other, g in held.value:
                        if other != doc and len(h) and t.p * max(len(h), len(g)) <= t.q * min(len(h), len(g)):
                            common = len(h) + len(g) - len(np.unique(np.concatenate([h, g])))
                            if t.linked(common, len(h), len(g)):
                                got.append((other, doc))
                yield pd.DataFrame(got, columns=["a", "b"])

        found = settle(docs.where("doc_id is not null").mapInPandas(meet, "a long, b long"), "links")
        out = found if out is None else out.union(found)
    return out

"""Language identification by prediction with partial matching.

Per language a tree of byte contexts up to order bytes long, with counts from
labelled texts. The probability of a byte follows method C: in the longest known
context a seen byte has count / (total + kinds), an unseen one costs the escape
kinds / (total + kinds) and is looked for one byte shorter, down to equal
chances of all bytes. The statistics are frozen, so a text's exact code length
is a sum over its bytes, each looked up in the tree by vectorised steps. The
language with the shortest code wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.llm.common import lean

SAMPLE = 600  #: labelled documents at most that a language's tree learns from
SAMPLE_BYTES = 20_000  #: longer texts are not taken into that sample
UND = "und"


@dataclass
class Model:
    """Nodes are the n-grams of all languages, n up to order + 1; node 0 is none.
    step[node * width + class[byte]] is the n-gram one byte longer. cost[node, j]:
    bits in language j of the n-gram's last byte after the rest of it.
    escape[node, j]: bits of the escape from the n-gram as a context."""

    languages: list[str]
    order: int
    classes: np.ndarray
    width: int
    step: np.ndarray
    cost: np.ndarray
    escape: np.ndarray
    nothing: np.ndarray  # bits per language of a byte that no language has


def _grams(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of texts, as integers, and their counts."""
    keys = [np.zeros(0, np.uint64)]
    for t in texts:
        b = np.frombuffer(t, dtype=np.uint8).astype(np.uint64)
        m = len(b) - n + 1
        if m > 0:
            k = np.zeros(m, np.uint64)
            for i in range(n):
                k = (k << np.uint64(8)) | b[i : i + m]
            keys.append(k)
    return np.unique(np.concatenate(keys), return_counts=True)


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys, and whether they are there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def train(rows: list[tuple[str, str]], order: int = 3) -> Model:
    """rows: text, language. A line end stands before each text as its context."""
    languages = sorted({lang for _, lang in rows})
    L = max(1, len(languages))
    texts = [[b"\n" + t.encode("utf-8", "replace") for t, lang in rows if lang == x] for x in languages]
    tables = [[_grams(t, n) for n in range(1, order + 2)] for t in texts]
    union = [np.unique(np.concatenate([np.zeros(0, np.uint64), *[t[n][0] for t in tables]])) for n in range(order + 1)]
    first = np.cumsum([1, *[len(u) for u in union]])
    used = union[0].astype(np.int64)
    classes, width = np.zeros(256, np.int32), len(used) + 1
    classes[used] = np.arange(1, width)
    inner = first[-2]  # the longest n-grams have no steps
    step = np.zeros(inner * width, np.int32)
    step[classes[used]] = np.arange(len(used)) + first[0]
    for n in range(1, order + 1):
        parent = np.searchsorted(union[n - 1], union[n] >> np.uint64(8)) + first[n - 1]
        step[parent * width + classes[(union[n] & np.uint64(255)).astype(np.int64)]] = np.arange(len(union[n])) + first[n]
    cost, escape = np.zeros((first[-1], L), np.float32), np.zeros((first[-1], L), np.float32)
    nothing = np.full(L, 8.0)
    for j, table in enumerate(tables):
        bits: list[np.ndarray] = []
        for n in range(order + 1):
            (grams, counts), here = table[n], union[n]
            if n == 0:
                known, total, kinds = np.zeros(1, np.uint64), np.array([counts.sum()], float), np.array([max(1, len(grams))], float)
                lower = np.full(len(here), 8.0)
            else:
                known, back = np.unique(grams >> np.uint64(8), return_inverse=True)
                total, kinds = np.bincount(back, counts, len(known)), np.bincount(back, minlength=len(known)).astype(float)
                at, _ = _find(union[n - 1], here & np.uint64((1 << (8 * n)) - 1))
                lower = bits[n - 1][at] if len(here) else np.zeros(0)
            leave = -np.log2(kinds / (total + kinds))
            mine, have = _find(known, here >> np.uint64(8))
            at, got = _find(grams, here)
            if len(here) and len(known):
                seen = -np.log2(np.where(got, counts[at] if len(grams) else 1, 1) / (total[mine] + kinds[mine]))
                own = np.where(~have, lower, np.where(got, seen, leave[mine] + lower))
            else:
                own = lower
            bits.append(own)
            cost[first[n] : first[n + 1], j] = own
            if n == 0:
                nothing[j] = leave[0] + 8.0
            else:
                where, there = _find(union[n - 1], known)
                escape[where[there] + first[n - 1], j] = leave[there]
    return Model(languages, order, classes, width, step, cost, escape, nothing)


def code_lengths(model: Model, text: bytes, piece: int = 1 << 18) -> np.ndarray:
    """Bits per language of the whole text; long texts are added up by pieces."""
    total, order = np.zeros(model.cost.shape[1]), model.order
    data = model.classes[np.frombuffer(b"\n" + text, dtype=np.uint8)]
    for begin in range(1, len(data), piece):
        low = max(0, begin - order)
        b = data[low : begin + piece]
        nodes = [model.step[b]]
        for _ in range(order):
            before = np.zeros_like(nodes[-1])
            before[1:] = nodes[-1][:-1]
            node = model.step[before * np.int64(model.width) + b]
            node[before == 0] = 0
            nodes.append(node)
        skip = begin - low
        last = nodes[order][skip:]
        total += model.cost[last].sum(axis=0, dtype=np.float64)
        rest = np.flatnonzero(last == 0) + skip
        for n in range(order, 0, -1):
            if not len(rest):
                break
            total += model.escape[nodes[n - 1][rest - 1]].sum(axis=0, dtype=np.float64)
            shorter = nodes[n - 1][rest]
            total += model.cost[shorter].sum(axis=0, dtype=np.float64)
            rest = rest[shorter == 0]
        total += len(rest) * model.nothing
    return total


LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in LETTER.finditer(text))


def predict(model: Model, text: str | None) -> tuple[str, float, float]:
    """Language, its posterior chance, all languages being equally likely at
    first, and the bits per byte of the text in it (8 for und)."""
    if not isinstance(text, str) or not model.languages or not has_letter(text):
        return UND, 0.0, 8.0
    data = text.encode("utf-8", "replace")
    bits = code_lengths(model, data)
    k = int(np.argmin(bits))
    return model.languages[k], float(1.0 / np.exp2(np.clip(bits[k] - bits, -1000, 0)).sum()), float(bits[k]) / len(data)


def held_out(name: str = "doc_id"):
    """Documents that are never learned from: crc32 of doc_id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % 4, F.lit(0)) == 2


def sample(docs: DataFrame, per_language: int = SAMPLE, longest: int = SAMPLE_BYTES) -> list[tuple[str, str]]:
    """The labelled documents that are learned from: per language those with the
    smallest hashes of doc_id, per_language at most, of at most longest bytes."""
    able = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out() & (F.octet_length("text") <= longest))
    counts = {r["lang"]: r["n"] for r in able.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    h = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(5)), 1)
    bar = {x: min(2**63 - 1, int(min(1.0, 1.3 * per_language / n) * 2.0**63)) for x, n in counts.items()}
    bars = F.element_at(F.create_map(*[F.lit(v) for x in sorted(bar) for v in (x, bar[x])]), F.col("lang"))
    rows = able.where(h <= bars).select("lang", h.alias("h"), "text").collect()
    kept: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["h"], r["text"])):
        kept.setdefault(r["lang"], []).append((r["text"], r["lang"]))
    return [x for v in kept.values() for x in v[:per_language]]


def identify(docs: DataFrame, order: int = 3, per_language: int = SAMPLE, bits: bool = False) -> DataFrame:
    """All rows and columns of docs and held_out, lang_pred, score; with bits,
    also bits (per byte of the text, in the predicted language).

    Learns from text and lang of a bounded sample of the rows that have a
    language and are not held out; predicts from the whole text alone. und
    stands for a null text, one without a letter, or no language to learn from;
    its score is 0. A null doc_id is not held out. Repeated rows get the same
    answer. Columns of docs named held_out, lang_pred, score or bits are replaced. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    model = train(sample(docs, per_language), order)
    # As plain values: a broadcast object would be sent by the name of its class, which workers can't import.
    shared = spark.sparkContext.broadcast([getattr(model, f.name) for f in fields(model)])
    del model
    named = docs.drop("held_out", "lang_pred", "score", "bits").withColumn("held_out", held_out())

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = Model(*shared.value)
        for texts in batches:
            yield pd.DataFrame([predict(model, t) for t in texts], columns=["lang_pred", "score", "bits"])

    trimmed = lean(run)

    @F.pandas_udf("lang_pred string, score double, bits double")
    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from trimmed(batches)

    return named.withColumn("_p", answer("text")).select(*named.columns, "_p.lang_pred", "_p.score", *[F.col("_p.bits").alias("bits")] * bits)

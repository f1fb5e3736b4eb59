"""Personal data by bootstrapped contextual extraction.

Base patterns find e-mail addresses, IP addresses, card and phone numbers; these
entities are the seeds. The words before a seed are a lexical pattern for its
kind. Looser shapes of the same kinds (an address written with "at" and "dot", a
number without its plus) are candidates, found with the words before them.
Spark scores the graph of patterns and instances: a pattern is as good as the
share of known instances among all that follow it, if enough different ones do;
an instance is as good as its best pattern. Instances above the bar become known
and the scores are taken again, until no new instance is known. Base spans always stay; what the patterns
discover is added.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.llm.common import ids_as_numbers, ids_as_text, lean, settle, small_batches

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: The two sides of an address's @.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: Runs of characters that a dotted number may hold: a match never leaves its run.
DOTTED_RUN = re.compile(r"[0-9][0-9.]*")
#: Of any length; a match can only begin where its run does, so that long runs cost one try.
LOOSE_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: ?(?:\(at\)|\[at\]) ?| at )[A-Za-z0-9-]++(?:(?:\.| ?(?:\(dot\)|\[dot\]) ?| dot )[A-Za-z0-9-]++)+")
WORDS = re.compile(r"[^\W\d_]+")
NUMBER_RUN = re.compile(r"\(?[0-9][0-9 ().-]*+")
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _email_spans(text: str) -> Iterator[Span]:
    """What EMAIL matches, in time that grows with the text: each @ is looked at
    once, with the local part before it and the domain behind it."""
    at, done = text.find("@"), 0
    while at >= 0:
        low = at
        while low > done and text[low - 1] in LOCAL:
            low -= 1
        domain = DOMAIN.match(text, at + 1) if low < at else None
        if domain:
            yield "email", low, domain.end()
        done = domain.end() if domain else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind; matches that fail their
    test are dropped and not tried anew."""
    out: list[Span] = list(_email_spans(text)) if "@" in text else []
    if "." in text:
        for run in DOTTED_RUN.finditer(text):
            if run.group().count(".") >= 3:
                for m in IP.finditer(text, run.start(), run.end()):
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
                        out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def loose_spans(text: str, base: list[Span]) -> list[Span]:
    """Candidates of a kind that no base span touches."""
    found: list[Span] = []
    if " at " in text or "(at)" in text or "[at]" in text:
        found += [("email", m.start(), m.end()) for m in LOOSE_EMAIL.finditer(text)]
    for m in NUMBER_RUN.finditer(text):
        value, s = m.group().rstrip(" ().-"), m.start()
        e = s + len(value)
        if s and (text[s - 1].isalnum() or text[s - 1] in "_.+@/-") or e < len(text) and (text[e].isalnum() or text[e] in "_@"):
            continue
        n = sum(c.isdigit() for c in value)
        if value.count(".") >= 3 and n <= 12:
            found.append(("ip", s, e))
        elif 12 <= n <= 19:
            found.append(("card", s, e))
        if 7 <= n <= 15:
            found.append(("phone", s, e))
    taken: list[list[int]] = []  # the base spans, joined where they overlap
    for s, e in sorted((s, e) for _, s, e in base):
        if taken and s < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])

    def free(s: int, e: int) -> bool:
        k = bisect_left(taken, [e])
        return k == 0 or taken[k - 1][1] <= s

    return [(kind, s, e) for kind, s, e in found if free(s, e)]


def word_starts(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in WORDS.finditer(text)]


def contexts(text: str, start: int, words: list[tuple[int, int]]) -> list[str]:
    """Patterns: the word, and the two words, right before a place. words: those of the text, in order."""
    k = bisect_left(words, (start, 0))
    before = [text[s : min(e, start)].lower() for s, e in words[max(0, k - 2) : k]]
    return [f"{n} {' '.join(before[-n:])}" for n in range(1, len(before) + 1)]


def _instance(text: str, kind: str, s: int, e: int) -> str:
    value = text[s:e].lower()
    return "".join(c for c in value if c.isalnum()) if kind != "email" else value


MENTION = "struct<kind:string,s:int,e:int,base:boolean,value:string,ctx:array<string>>"


def mentions(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, found: the base and loose spans of each whole text."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                rows = []
                if isinstance(text, str):
                    base = base_spans(text)
                    loose = loose_spans(text, base)
                    words = word_starts(text) if base or loose else []
                    rows = [{"kind": k, "s": s, "e": e, "base": b, "value": _instance(text, k, s, e), "ctx": contexts(text, s, words)} for some, b in ((base, True), (loose, False)) for k, s, e in some]
                out.append(rows)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text_key": batch["text_key"], "found": out})

    kind = dict(docs.dtypes)["doc_id"]
    keyed = ids_as_text(docs).withColumn("text_key", F.xxhash64("text"))
    return ids_as_numbers(keyed.mapInPandas(lean(find), f"doc_id string, text_key long, found array<{MENTION}>"), kind)


def discover(found: DataFrame, support: int = 5, confidence: float = 0.9) -> DataFrame:
    """(kind, value) of loose instances that high-confidence patterns reach.

    A pattern of a kind needs support different known instances of the kind, and
    these have to be confidence of all different instances behind its words.
    Known instances only grow; it ends with the round that adds none.
    """
    edges = settle(found.select(F.explode("found").alias("m")).select("m.kind", "m.value", "m.base", F.explode("m.ctx").alias("ctx")).groupBy("kind", "value", "ctx").agg(F.max("base").alias("base")), "graph")
    known = settle(edges.where("base").select("kind", "value").distinct(), "known")
    n, before = known.count(), -1
    while n != before:
        marked = edges.join(known.withColumn("known", F.lit(1)), ["kind", "value"], "left")
        # An instance that is known counts for its kind only; one that is not known counts once, against all.
        per = marked.groupBy("ctx", "kind").agg(F.sum("known").alias("hits"))
        every = edges.groupBy("ctx", "value").agg(F.lit(1).alias("one")).groupBy("ctx").agg(F.count(F.lit(1)).alias("seen"))
        good = per.join(every, "ctx").where((F.col("hits") >= support) & (F.col("hits") >= confidence * F.col("seen"))).select("ctx", "kind")
        reached = edges.where(~F.col("base")).join(good, ["ctx", "kind"], "left_semi").select("kind", "value")
        known = settle(known.union(reached).distinct(), "known")
        n, before = known.count(), n
    return reached.distinct()


def find_pii(docs: DataFrame, support: int = 5, confidence: float = 0.9) -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone (base
    spans of the kind), base_sha256 (of kind:start:end of the base spans by
    start, then kind, comma-joined), spans (base and discovered ones, likewise),
    n_discovered.

    Places are code points, ends exclusive. A null text counts as empty.
    Repeated rows have the same result each. Other columns are not read. An empty table gives an empty
    result.
    """
    with small_batches(docs.sparkSession):
        found = settle(mentions(docs), "mentions")
    new = settle(discover(found, support, confidence), "discovered")
    # Back to the spans: few instances, many documents; only documents with loose spans are joined.
    loose = found.select("doc_id", "text_key", F.explode("found").alias("m")).where(~F.col("m.base")).select("doc_id", "text_key", "m.kind", "m.value", "m.s", "m.e").distinct()
    added = loose.join(new, ["kind", "value"], "left_semi").groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("s", "kind", "e")).alias("more"))
    both = found.alias("f").join(added.alias("a"), F.col("f.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("f.text_key") == F.col("a.text_key")), "left")
    rank = lambda k: F.array_position(F.array(*map(F.lit, KINDS)), k).cast("int")
    base = F.transform(F.filter("f.found", lambda m: m["base"]), lambda m: F.struct(m["s"].alias("s"), rank(m["kind"]).alias("r"), m["e"].alias("e"), m["kind"].alias("kind")))
    more = F.transform(F.coalesce("a.more", F.array().cast("array<struct<s:int,kind:string,e:int>>")), lambda m: F.struct(m["s"].alias("s"), rank(m["kind"]).alias("r"), m["e"].alias("e"), m["kind"].alias("kind")))
    shown = lambda spans: F.array_join(F.transform(spans, lambda m: F.concat_ws(":", m["kind"], m["s"].cast("string"), m["e"].cast("string"))), ",")
    wide = both.select("f.doc_id", F.array_sort(base).alias("base"), more.alias("more"))

    def count(kind: str):
        return F.size(F.filter("base", lambda m: m["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return wide.select("doc_id", *map(count, KINDS), F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(F.array_sort(F.concat("base", "more"))).alias("spans"), F.size("more").cast("long").alias("n_discovered"))

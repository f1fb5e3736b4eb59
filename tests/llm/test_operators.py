"""The corpus operators against SQL or brute force, on whole small tables and on edge cases."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from compare import connect, differences

from nodeloom.llm import chat, embedding_dedup, exact_dedup, jaccard, kd_sharding, langid, mixing, packing, pii, registry, token_scan, tokens
from nodeloom.llm.common import components, table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, digest string, h long, rank int"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, columns with clashing names."""
    rows = [(1, "The cat sat on the mat today", "en", "a"), (2, "the CAT sat on the mat today", "en", "a"), (3, None, "en", None), (4, "", None, "a"), (5, "one", "en", ""), (6, "123 456 !!!", "en", "b"), (None, "a null id has this text", None, "b"), (7, "word " * 30_000, "en", "b"), (8, "x", "en", "b"), (8, "x", "en", "b"), (9, "É é\tend\n", "fr", "c")]
    return spark.createDataFrame([(*r, "clash", 5, 1) for r in rows], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    got = registry.queries()[name](spark, SF).toPandas()
    assert not differences(got, connect(SF).sql(registry.oracle_sql()[name]).df())


def test_exact_dedup_edges(odd, none):
    got = {(r["doc_id"], r["text_sha256"]): r for r in exact_dedup.exact_dedup(odd).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    cat = sha("the cat sat on the mat today")
    assert (got[1, cat]["keep_id"], got[1, cat]["kept"], got[2, cat]["kept"], got[2, cat]["group_size"]) == (2, False, True, 2)
    assert (got[3, sha("")]["keep_id"], got[8, sha("x")]["group_size"]) == (4, 2)
    assert got[9, sha("É é\tend\n")]["kept"]
    assert exact_dedup.exact_dedup(none).count() == 0


def test_exact_dedup_compares_bytes_and_goes_on_in_batches(docs):
    """With a digest of four values nearly all texts clash; the bytes tell them apart."""
    from pyspark.sql import functions as F

    want = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(docs.repartition(6), batches=6).collect()}
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(docs, digest=lambda c: (F.length(c) % 4).cast("string")).collect()}
    assert got == want


def test_exact_dedup_goes_on_in_later_calls(spark, tmp_path):
    """The state stays: rows of a second call hit those of the first."""
    first = spark.createDataFrame([(1, "a"), (2, "B"), (9, "c")], "doc_id long, text string")
    second = spark.createDataFrame([(3, "A"), (4, "b"), (5, "c"), (6, "new"), (7, "new")], "doc_id long, text string")
    home = f"file://{tmp_path}/dedup"
    assert {r["doc_id"]: r["group_size"] for r in exact_dedup.exact_dedup(first, folder=home).collect()} == {1: 1, 2: 1, 9: 1}
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(second, folder=home).collect()}
    assert got == {3: (3, 2, True), 4: (4, 2, True), 5: (9, 2, False), 6: (7, 2, False), 7: (7, 2, True)}


def test_sharding(spark, docs, odd, none):
    got = kd_sharding.shards(docs.union(docs.select("*")), 8).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 4 * got["size"].max()
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    where = defaultdict(set)
    for r in got.itertuples():
        where[texts[r.doc_id]].add(r.shard)
    assert all(len(v) == 1 for v in where.values())
    rows = kd_sharding.shards(odd).toPandas()
    assert len(rows) == 11 and set(rows["law"]) == {"bytes"}
    assert rows[rows.doc_id == 3]["size"].item() == 16 and rows[rows.doc_id == 5]["text_crc32"].item() == zlib.crc32(b"one")
    assert kd_sharding.shards(none).count() == 0


def test_sharding_deals_only_groups_larger_than_a_shard(spark):
    """A third of all rows are copies: they fill shards of their own, other groups stay whole."""
    rnd = random.Random(1)
    rows = [(k, "copy " * 20, f"s{k % 3}", None) for k in range(400)] + [(1000 + k, f"text {k % 90} " * rnd.choice([15, 15, 15, 40]), f"s{k % 5}", "en") for k in range(800)]
    rows = [(d, t.replace(t, t) if d < 1000 else f"text {(d - 1000) % 90} " * (15 + 25 * ((d - 1000) % 90 == 3)), s, x) for d, t, s, x in rows]
    got = kd_sharding.shards(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), 10).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 10 and sizes.max() <= 1.25 * sizes.mean() and sizes.min() >= 0.75 * sizes.mean()
    texts, where = {r[0]: r[1] for r in rows}, defaultdict(set)
    for r in got.itertuples():
        where[texts[r.doc_id]].add(r.shard)
    split = [t for t, v in where.items() if len(v) > 1]
    assert split == ["copy " * 20] and len(got) == len(rows)


def test_mixing(docs, odd, none):
    got = mixing.mix(docs).toPandas()
    assert len(got) == docs.count() and (got["taken"] <= 2 * got["size"]).all()
    per = got.groupby("source").agg(total=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    weights = [(3, 1, 2)[k % 3] for k in range(len(per))]
    low, high = 0.0, 1e9
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(2 * t, mid * w) for t, w in zip(per["total"], weights, strict=True)) < 1.5 * per["total"].sum() else (low, mid)
    assert np.allclose(per["target"], [min(2 * t, low * w) for t, w in zip(per["total"], weights, strict=True)], rtol=1e-6)
    assert (per["taken"] <= per["target"] + got.groupby("source")["size"].max()).all() and per["taken"].sum() <= 1.02 * per["target"].sum()
    for source, p in per.iterrows():  # near its target, or nothing that is left fits
        left = got[(got.source == source) & (got["size"] > 0) & (got["taken"] < 2 * got["size"])]
        assert p["taken"] >= 0.95 * p["target"] or left["size"].min() > p["target"] - p["taken"]
    assert got.sort_values("doc_id")["taken"].tolist() == mixing.mix(docs.repartition(3)).toPandas().sort_values("doc_id")["taken"].tolist()
    assert mixing.mix(odd).count() == 11 and mixing.mix(none).count() == 0


@pytest.mark.parametrize("share", [0.5, 1.3])
def test_mixing_passes_long_documents(spark, share):
    """Against a plain walk down the queue: long documents at the boundary leave no gap."""
    from pyspark.sql import functions as F

    rnd = random.Random(5)
    rows = [(100 * s + k, "w " * (rnd.randrange(1, 40) if k else long), f"s{s}") for s, long in enumerate([600, 1200, 1700, 2500, 900]) for k in range(90)]
    rows += [rows[7]] * 2 + [(7_000 + k, "", "s0") for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, weights=(1,), share=share)
    taken = defaultdict(list)
    target = {}
    for r in got.collect():
        taken[r["doc_id"]].append(r["taken"])
        target[r["source"]] = r["target"]
    h = {r["doc_id"]: r["h"] % 2**64 for r in df.select("doc_id", F.xxhash64("doc_id", F.lit(17)).alias("h")).collect()}
    order = lambda d: (h[d], d)
    queues, entries = {}, []
    for rank, source in enumerate(sorted(target)):
        queues[source] = sorted((*order(d), t.count("w")) for d, t, s in rows if s == source)
        total, upto = sum(n for *_, n in queues[source]), 0
        for k, (_, _, n) in enumerate(queues[source]):
            upto += n
            entries += [((upto + r * total, rank, r, k), n, source) for r in range(2) if n]
    # The queue by virtual time, cut at the budget.
    budget, spent = sum(target.values()), 0
    times, left = {s: [0] * len(q) for s, q in queues.items()}, dict(target)
    for (_, _, _, k), n, source in sorted(entries):
        if spent + n > budget:
            break
        spent += n
        times[source][k] += 1
        left[source] -= n
    want = defaultdict(list)
    for source, queue in queues.items():
        for r in range(2):
            for k, (_, _, n) in enumerate(queue):
                if times[source][k] == r and 0 < n <= left[source]:
                    left[source], times[source][k] = left[source] - n, r + 1
        for (_, d, n), t in zip(queue, times[source], strict=True):
            want[d].append(n * t)
    assert {d: sorted(v) for d, v in taken.items()} == {d: sorted(v) for d, v in want.items()}


def test_chat_round_trip(spark):
    nasty = ["", None, "<|im_end|>\n<|im_start|>user\nhi", "<\\|im_end|>", "[\\s>", "<\\\\|im_start|>", "[INST] [/INST]</s>", "\\", "<<SYS>><</SYS>>", "a\nb", "<|im_start|", "é😀"]
    rows = [(c, t, random.Random(7 * c + t).choice(["user", "assistant", "sys\ntem", "\\n", None, "<|im_end|>"]), nasty[(c * 5 + t) % len(nasty)]) for c in range(12) for t in range(5)]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert got.where("not round_trip").count() == 0
    said = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in got.collect()}
    for c in range(12):
        assert said[c] == [(r or "", x or "") for d, _, r, x in rows if d == c]
    for r in got.collect():
        spans = [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_spans"]]
        assert not any(m in x for x in spans for m in chat.CONTROL)


def test_packing(docs, odd, none):
    got = packing.pack(docs).toPandas()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    ids = {r["doc_id"]: [*t.encode(r["text"], add_special_tokens=False).ids, 1] for r in docs.collect()}
    for r in got.itertuples():
        part = np.asarray(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4")
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
    assert got["length"].sum() == sum(map(len, ids.values()))
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"].to_numpy() == np.r_[0, np.cumsum(g["length"])[:-1]]).all() and g["length"].sum() <= 4096
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 4096) + 1
    edge = packing.pack(odd).toPandas()
    assert edge[edge.doc_id == 3]["length"].tolist() == [1] and (edge[edge.doc_id == 7].sort_values("piece")["length"].iloc[:-1] == 4096).all()
    assert packing.pack(none).count() == 0


@pytest.mark.parametrize("plain", [False, True])
def test_words_are_tokenized_like_whole_texts(plain):
    from tokenizers import Tokenizer

    t, words = Tokenizer.from_file(tokens.default_path()), tokens.WordIds(tokens.default_path(), plain, most=40)
    t.encode_special_tokens = plain
    texts = ["", " \n\t ", "it's don't 'S 've x's can't'll''s", "a<|endoftext|>b <|startoftext|> <| x |>", "ÀÉß. Straße Æ×÷ ªº µ", "ﬁ Σας ΟΔΟΣ İI ıi", "e\u0301 \u0301a", "12345 a1b2 ½ ²", "(\"'s), ''ll a'b 'Tis 'RE\x0b\x0c'", "!" * 200 + " z" * 130, "日本語 text中 😀😀a😀", "x\xa0y\x85z\x1cq\x00r\x7f", "_a_b__c ...!!!?? a.\nAs ###", "é" * 300 + " " + "ab" * 500]
    for text in [*texts, " ".join(texts), *texts]:
        assert np.frombuffer(words.of(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("score", ["residual_norm", "dot"])
def test_packing_holds_every_constraint(score):
    rnd = random.Random(3)
    counts = {rnd.randint(1, 100): rnd.randint(1, 40) for _ in range(40)}
    bins = defaultdict(list)
    for length, lo, hi, first, per, _ in packing.plan(counts, 100, 6, 5000, score):
        for r in range(lo, hi):
            bins[first + (r - lo) // per].append(length)
    assert sorted(x for b in bins.values() for x in b) == sorted(x for k, n in counts.items() for x in [k] * n)
    assert all(sum(b) <= 100 and (len(b) <= 6 and sum(x * x for x in b) <= 5000 or len(b) == 1) for b in bins.values())


def test_token_scan(spark, docs, odd, none):
    got = {r["doc_id"]: r["n_tokens"] for r in token_scan.token_counts(docs, block_tokens=700).collect()}
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    t.encode_special_tokens = True
    assert got == {r["doc_id"]: len(t.encode(r["text"], add_special_tokens=False).ids) for r in docs.collect()}
    assert token_scan.token_counts(odd).count() == 11 and token_scan.token_counts(none).count() == 0
    flat = np.array([5, 9, 9, 1, 2, 3, 4, 9, 7], dtype="<u4")
    blocks = spark.createDataFrame([("f", k, flat[2 * k : 2 * k + 2].tobytes()) for k in range(5)], "file string, block long, ids binary")
    rows = sorted((r["ordinal"], r["start"], r["n_tokens"], r["closed"]) for r in token_scan.scan(blocks, 9).collect())
    assert rows == [(0, 0, 1, True), (1, 2, 0, True), (2, 3, 4, True), (3, 8, 1, False)]


def test_token_scan_of_raw_files(spark, tmp_path):
    """Flat files read by byte ranges: documents over several blocks, an empty file, half an id."""
    rnd, want = np.random.default_rng(3), {}
    for name, n in (("a.bin", 5000), ("b.bin", 1), ("c.bin", 0)):
        ids = rnd.integers(0, 60, n).astype("<u2")
        (tmp_path / name).write_bytes(ids.tobytes())
        ends = np.flatnonzero(ids == 7)
        starts = np.r_[0, ends + 1]
        rows = [(k, int(starts[k]), int(e - starts[k]), True) for k, e in enumerate(ends)]
        want[name] = rows + ([(len(ends), int(starts[-1]), int(n - starts[-1]), False)] if starts[-1] < n else [])
    paths = [f"{tmp_path}/{n}" for n in want]
    got = {n: [] for n in want}
    for r in token_scan.scan(token_scan.raw_blocks(spark, paths, 64, 2), 7).collect():
        got[r["file"].rsplit("/", 1)[-1]].append((r["ordinal"], r["start"], r["n_tokens"], r["closed"]))
    assert {n: sorted(v) for n, v in got.items()} == want
    (tmp_path / "d.bin").write_bytes(b"abc")
    with pytest.raises(ValueError):
        token_scan.raw_blocks(spark, [f"{tmp_path}/d.bin"], 64, 2)


def test_language_id(docs, odd, none):
    got = langid.identify(docs).toPandas()
    held = got[got.held_out]
    assert len(held) > 20 and (held.lang == held.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()
    assert [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id] == got.held_out.tolist()
    edge = {r["doc_id"]: r["lang_pred"] for r in langid.identify(odd).collect()}
    assert edge[3] == edge[4] == edge[6] == "und" and edge[9] in ("en", "fr")
    assert langid.identify(none).count() == 0


def test_code_lengths_equal_a_plain_tree():
    rows = [("the cat sat on the mat", "x"), ("über die straße und den fluss", "y"), ("that is the hat", "x")]
    model = langid.train(rows)
    for text in (b"the hat", "ß und über \x07 zz".encode(), b"t"):
        for j, lang in enumerate(model.languages):
            counts = defaultdict(lambda: defaultdict(int))
            for t, x in rows:
                b = b"\n" + t.encode()
                for i in range(len(b)) if x == lang else ():
                    for n in range(min(i, 3) + 1):
                        counts[b[i - n : i]][b[i]] += 1
            b, bits = b"\n" + text, 0.0
            for i in range(1, len(b)):
                for n in range(min(3, i), -1, -1):
                    c = counts.get(b[i - n : i])
                    if c and b[i] in c:
                        bits -= np.log2(c[b[i]] / (sum(c.values()) + len(c)))
                        break
                    bits -= np.log2(len(c) / (sum(c.values()) + len(c))) if c else 0
                else:
                    bits += 8
            assert abs(langid.code_lengths(model, text, piece=5)[j] - bits) < 1e-3


def _sets(rows):
    out = {}
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({k: k + 32 for k in range(65, 91)}))
        out[doc] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    return out


def _groups(nodes, linked):
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


def test_jaccard_join(spark, docs, odd, none):
    """Whole table and made-up near copies at all distances around the threshold, by brute force."""
    rnd, made = random.Random(11), []
    for n in (5, 8, 12, 30, 70, 90, 150, 400):
        base = [f"w{rnd.randrange(3000)}" for _ in range(n)]
        for k in range(8):
            words = list(base)
            for _ in range(rnd.randrange(max(1, n // 30) + 2)):
                words[rnd.randrange(n)] = f"v{rnd.randrange(3000)}"
            made.append((10_000 + 100 * n + k, " ".join(words[rnd.randrange(1 + n // 20) :])))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + made
    got = {r["doc_id"]: r for r in jaccard.similar(docs.select("doc_id", "text").union(spark.createDataFrame(made, "doc_id long, text string"))).collect()}
    sets = _sets(rows)
    where = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    common = defaultdict(int)
    for v in where.values():
        for i, a in enumerate(v):
            for b in v[:i]:
                common[a, b] += 1
    linked = [(a, b) for (a, b), c in common.items() if 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c)]
    low = _groups(sets, linked)
    assert len(linked) > 20
    for d, s in sets.items():
        assert (got[d]["n_shingles"], got[d]["component_id"]) == (len(s), low[d])
    edge = {r["doc_id"]: r for r in jaccard.similar(odd).collect()}
    assert (edge[2]["component_id"], edge[3]["n_shingles"], edge[3]["component_id"], edge[7]["n_shingles"], edge[None]["component_id"]) == (1, 0, 3, 1, None)
    assert jaccard.similar(none).count() == 0


def test_signatures_miss_no_pair():
    """Any two sets at the threshold share as many probing signatures as asked."""
    rnd, t, hot = np.random.default_rng(5), jaccard.Threshold(), (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    for n in (3, 7, 40, 63, 64, 100, 127, 128, 300, 511, 1000):
        for _ in range(6):
            pool = rnd.integers(1, 2**63, 3 * n, dtype=np.uint64)
            m = int(rnd.integers(n, t.largest_partner(n) + 1))
            common = -(-3 * (n + m) // 7)
            a, b = np.unique(pool[:n]), np.unique(np.r_[pool[:common], pool[n : n + m - common]])
            x, y = jaccard.signatures(a, hot, t), jaccard.signatures(b, hot, t)
            probe = {int(c) >> 2: k for k, c in enumerate(x[0]) if c & jaccard.PROBE}
            index = {int(c) >> 2 for c in y[0] if c & jaccard.INDEX}
            met = [k for s, k in probe.items() if s in index]
            need = x[2] if jaccard.band_of(len(a)) == jaccard.band_of(len(b)) else x[3]
            assert len(met) >= need


def test_sketches_exclude_no_link():
    rnd, t, excluded = np.random.default_rng(8), jaccard.Threshold(), 0
    for n in (1, 3, 20, 100, 700, 5000):
        for share in np.linspace(0, 0.6, 25):
            whole = rnd.integers(0, 2**63, 2 * n, dtype=np.int64).astype(np.uint64)
            a = np.unique(whole[:n])
            gone = int(share * n)
            b = np.unique(np.concatenate([a[gone:], whole[n : n + int(rnd.integers(0, gone + 1))]]))
            common = len(np.intersect1d(a, b))
            able = jaccard.may_link(jaccard.sketch(a), jaccard.sketch(b), t)
            assert able or not t.linked(common, len(a), len(b))
            assert able == jaccard.may_link(jaccard.sketch(b), jaccard.sketch(a), t)
            excluded += not able
    assert excluded > 20


def test_embeddings(spark, none):
    rnd = np.random.default_rng(2)
    base = rnd.standard_normal((30, 64))
    rows = []
    for k in range(240):
        rows.append((k, [float(x) for x in base[k % 30] + rnd.standard_normal(64) * rnd.choice([0.1, 0.25, 0.4])], int(k % 3)))
    rows += [(300 + k, rows[0][1], 0) for k in range(5)]
    rows += [(400, None, 0), (401, [0.0] * 64, 0), (402, [float("nan")] * 64, 0), (403, rows[0][1], None), (404, [1.0, None], 0), (405, [], 0)]
    schema = "vec_id long, embedding array<float>, label int"
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, schema), chunk=20).collect()}
    good = [(i, np.asarray(np.float32(v), float), lab) for i, v, lab in rows if i < 400]
    linked = [(a, b) for a, x, p in good for b, y, q in good if a < b and p == q and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93]
    low, n = _groups([r[0] for r in rows], linked), defaultdict(int)
    for a, b in linked:
        n[a] += 1
        n[b] += 1
    assert len(linked) > 50
    for i, _, _ in rows:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (n[i], low[i], low[i] == i)
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_embedding_recall_at_the_threshold(spark):
    """Pairs right above 0.93 are found, all of them; right below, none."""
    rnd, rows = np.random.default_rng(6), []
    for k in range(1200):
        x, y = rnd.standard_normal(64), rnd.standard_normal(64)
        x /= np.linalg.norm(x)
        y -= (x @ y) * x
        y /= np.linalg.norm(y)
        c = 0.93 + (1e-6 if k % 2 else -1e-6)
        rows += [(2 * k, [float(v) for v in x], 0), (2 * k + 1, [float(v) for v in c * x + np.sqrt(1 - c * c) * y], 0)]
    got = {r["vec_id"]: r["component_id"] for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    found = [got[2 * k] == got[2 * k + 1] for k in range(1200)]
    assert np.mean(found[1::2]) == 1.0 and not any(found[::2])


def _plain(t):
    out = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        n = re.sub("[^0-9]", "", m.group())
        if 12 <= len(n) <= 19 and pii.luhn(n):
            out.append((m.start(), 2, "card", m.end()))
    out += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


def test_base_spans_equal_the_patterns(docs, odd, none):
    rnd = random.Random(4)
    for _ in range(5000):
        t = "".join(rnd.choice("a@.%+-1 2.3(@x") for _ in range(rnd.randint(1, 40)))
        got = sorted((s, pii.KINDS.index(k), k, e) for k, s, e in pii.base_spans(t))
        assert ",".join(f"{k}:{s}:{e}" for s, _, k, e in got) == _plain(t)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in pii.find_pii(docs).collect():
        assert r["base_sha256"] == hashlib.sha256(_plain(texts[r["doc_id"]]).encode()).hexdigest()
    assert pii.find_pii(odd).count() == 11 and pii.find_pii(none).count() == 0


def test_patterns_discover(spark):
    rows = [(k, f"Please mail my contact address person{k}@mail.example.org now") for k in range(12)]
    rows += [(20, "so the contact address hidden (at) mail.example.org is mine"), (21, "meet me at noon.then we go"), (22, "call 555-0123-456 today")]
    got = {r["doc_id"]: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    t = dict(rows)[20]
    s = t.index("hidden")
    assert got[20]["spans"] == f"email:{s}:{t.index(' is mine')}" and got[20]["n_email"] == 0
    assert got[21]["spans"] == "" and got[22]["spans"] == "" and got[0]["n_email"] == 1


def test_patterns_discover_until_nothing_is_new(spark):
    """Each word's pattern becomes good by the instance that the word before it discovered."""
    words = ["alpha", "beta", "gamma", "delta", "epsilon"]
    rows = [f"{w} person{k}{w}@mail.example.org" for w in words for k in range(12)]
    rows += [f"{w} hidden{k} (at) mail.example.org" for k, w in enumerate(words)] + [f"{w} hidden{k} (at) mail.example.org" for k, w in enumerate(words[1:])]
    got = pii.find_pii(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).where("n_discovered = 1").collect()
    assert {r["doc_id"] for r in got} == set(range(60, 69))


def test_components(spark):
    rnd = random.Random(9)
    links = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(230)] + [(k, k + 1) for k in range(1000, 1060)]
    low = _groups({x for p in links for x in p}, links)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: c for n, c in low.items() if any(n in p and p[0] != p[1] for p in links)}


def test_components_of_long_chains(spark):
    """Chains with ids in any order: rounds may not grow with their length."""
    rnd = random.Random(4)
    ids = rnd.sample(range(10_000), 2_300)
    links = list(zip(ids[:1999], ids[1:2000], strict=True)) + [(p, q) for k, p in enumerate(ids[2000:]) for q in ids[2001 + k : 2004 + k]]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: min(ids[:2000]) for n in ids[:2000]} | {n: min(ids[2000:]) for n in ids[2000:]}


def test_pipeline(spark):
    """run() against its stages done plainly."""
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["language_id", "exact_dedup", "ngram_jaccard_join", "mixing", "best_fit_packing"] and cp.ORACLE_SQL is None
    all_docs = table(spark, SF, "documents")
    rows = {r["doc_id"]: r for r in all_docs.collect()}
    kept = {d: r for d, r in rows.items() if r["text"] and any(c.isalpha() for c in r["text"])}
    norm = lambda t: t.translate({k: k + 32 for k in range(65, 91)})
    last = {norm(r["text"]): d for d, r in sorted(kept.items())}
    kept = {d: kept[d] for d in last.values()}
    sets = _sets([(d, r["text"]) for d, r in kept.items()])
    ids = sorted(sets)
    linked = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    low = _groups(ids, linked)
    kept = {d: r for d, r in kept.items() if low[d] == d}
    mix = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(all_docs.where(all_docs.doc_id.isin(list(kept)))).collect() if r["taken"]}
    got = cp.run(spark, SF).toPandas()
    whole = got[got.piece == 0].groupby("doc_id").size().to_dict()
    assert whole == mix and got.groupby("sequence_id")["length"].sum().max() <= 4096


def test_pipeline_edges(spark, odd, none):
    """Nulls, repeated and missing ids, clashing columns and empty tables through every stage."""
    import corpus_pipeline as cp

    wide = odd.withColumn("n_chars", odd.rank)
    rows = [(1, "x"), (1, "x"), (1, "y"), (9, "X"), (None, "only here with a null id"), (None, "x"), (5, None), (6, "")]
    ids = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted((r["doc_id"] or -1, r["text"]) for r in cp.exact(spark, ids, "").collect())
    assert kept == [(-1, "only here with a null id"), (1, "y"), (6, ""), (9, "X")]
    named = sorted((r["doc_id"] or -1, r["text"]) for r in cp.language_id(spark, ids, "").collect())
    assert (5, None) not in named and (6, "") not in named and len(named) == 6
    one = cp.near(spark, ids, "").collect()
    assert sorted(r["text"] for r in one if r["text"]).count("only here with a null id") == 1 and sum((r["text"] or "").lower() == "x" for r in one) == 1
    mixed = cp.mix(spark, ids, "").collect()
    assert all(r["text"] for r in mixed) and any(r["doc_id"] is None for r in mixed)
    for _, stage in cp.STAGES:
        assert stage(spark, wide, "").count() > 0
        assert stage(spark, none.withColumn("n_chars", none.rank), "").count() == 0


def test_workers_need_no_package(tmp_path):
    """The driver runs in another folder and workers can't import the package."""
    import os
    import subprocess
    import sys

    code = f"""
import sys
sys.path.insert(0, {os.getcwd()!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
import __spark_entry__
q = __spark_entry__.queries()
for name in ("op3_best_fit_packing", "op5_language_id", "op7_token_counts", "op8_pii"):
    assert q[name](spark, {SF!r}).count() >= 200, name
print("all ran")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert "all ran" in out.stdout, out.stderr[-2000:]

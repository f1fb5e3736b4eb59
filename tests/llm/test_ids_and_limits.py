"""Ids beyond 2**53 beside null ones, in every operator; parameters and texts at their limits."""

import re
import time
import zlib

import numpy as np
import pytest

from nodeloom.llm import chat, embedding_dedup, exact_dedup, importance, jaccard, kd_sharding, langid, mixing, packing, periodic, pii, registry, token_scan
from nodeloom.llm.common import table

SF = "/root/testdata/sf0.001"
BIG = 2**53


@pytest.fixture(scope="module")
def rows(spark):
    """(id, text, lang, source) of a small corpus with copies, under ids that floating point can't tell apart."""
    texts = [(r["text"], r["lang"], r["source"]) for r in table(spark, SF, "documents").orderBy("doc_id").limit(40).collect()]
    ids = [BIG + k for k in range(len(texts))]
    out = [(i, *t) for i, t in zip(ids, texts, strict=True)]
    out += [(BIG + 100, *texts[3]), (BIG + 101, *texts[4]), (-BIG - 1, *texts[5]), (None, "mail me at one@example.com or two@example.org today please", "en", "a"), (None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1)


@pytest.fixture(scope="module")
def plain(spark, rows):
    """The same rows under small ids in the same order, without the null ones; and the small id of each."""
    ids = sorted(r[0] for r in rows if r[0] is not None)
    small = {i: k for k, i in enumerate(ids)}
    return spark.createDataFrame([(small[r[0]], *r[1:]) for r in rows if r[0] is not None], "doc_id long, text string, lang string, source string").coalesce(1), small


def test_classes_under_large_ids(docs, plain):
    few, small = plain
    want = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar(few).collect()}
    got = jaccard.similar(docs).collect()
    assert {small[r["doc_id"]]: (r["n_shingles"], small[r["component_id"]]) for r in got if r["doc_id"] is not None} == want
    assert sum(r["doc_id"] is None for r in got) == 2
    assert len({c for _, c in want.values()}) < len(want)
    exact = {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_dedup(few).collect()}
    assert {small[r["doc_id"]]: small[r["keep_id"]] for r in exact_dedup.exact_dedup(docs).collect() if r["doc_id"] is not None} == exact


def test_values_under_large_ids(docs, plain):
    few, small = plain
    for run in (token_scan.token_counts, lambda d: pii.find_pii(d).drop("n_discovered"), periodic.collapse):
        keep = [c for c in run(few).columns if c not in ("doc_id", "file", "ordinal", "start")]
        want = {r["doc_id"]: tuple(r[c] for c in keep) for r in run(few).collect()}
        got = run(docs).collect()
        assert {small[r["doc_id"]]: tuple(r[c] for c in keep) for r in got if r["doc_id"] is not None} == want and sum(r["doc_id"] is None for r in got) == 2


def _crc(text, path):
    from tokenizers import Tokenizer

    ids = [*Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids, 1]
    return zlib.crc32(np.asarray(ids[:4096], dtype="<u4").tobytes())


def test_pieces_under_large_ids(docs, rows):
    from nodeloom.llm.tokens import default_path

    got = sorted(((r["doc_id"], r["ids_crc32"]) for r in packing.pack(docs).where("piece = 0").collect()), key=repr)
    assert got == sorted(((r[0], _crc(r[1], default_path())) for r in rows), key=repr)


def test_all_ids_come_back(spark, docs, rows):
    want = sorted((r[0] for r in rows), key=repr)
    target = table(spark, SF, "benchmark")
    for run in (kd_sharding.shards, langid.identify, mixing.mix, lambda d: importance.resample(d, target)):
        assert sorted((r["doc_id"] for r in run(docs).select("doc_id").collect()), key=repr) == want
    talks = spark.createDataFrame([(BIG + k, t, r, f"text {k}") for k in range(4) for t, r in ((0, "user"), (1, "assistant"))] + [(None, 0, "user", "x")], "conv_id long, turn long, role string, text string").coalesce(1)
    assert {r["conv_id"] for r in chat.digests(chat.format_chats(talks)).collect()} >= {BIG + k for k in range(4)}
    v = [(BIG + 1, [1.0, 0.0], 1), (BIG + 2, [1.0, 0.01], 1), (BIG + 3, [0.0, 1.0], 1), (None, [1.0, 0.0], 1)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(v, "vec_id long, embedding array<float>, label int")).collect()
    assert {r["vec_id"] for r in got} == {BIG + 1, BIG + 2, BIG + 3, None}
    assert {r["vec_id"]: r["component_id"] for r in got if r["vec_id"] in (BIG + 2, BIG + 3)} == {BIG + 2: BIG + 1, BIG + 3: BIG + 3}


def test_pipeline_under_large_ids(spark, rows, tmp_path):
    import corpus_pipeline
    from nodeloom.llm.tokens import default_path

    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    own: dict = {}
    for r in rows:
        own.setdefault(r[0], set()).add(_crc(r[1], default_path()))
    got = corpus_pipeline.run(spark, str(tmp_path)).where("piece = 0").collect()
    assert len(got) > 10 and all(r["ids_crc32"] in own[r["doc_id"]] for r in got)


@pytest.mark.parametrize("directions", [48, 128, 200, 400])
def test_counts_of_many_directions(spark, directions):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((5, 32))
    v = [(k, (base[k // 2] + 0.02 * rng.standard_normal(32)).tolist(), 1) for k in range(10)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(v, "vec_id long, embedding array<float>, label int"), directions=directions).collect()
    assert all(r["n_links"] == 1 and r["component_id"] == r["vec_id"] // 2 * 2 for r in got)


def test_addresses_in_linear_time():
    start = time.time()
    for text in ("a@" + "b" * 1_000_000, "a@b" * 300_000, "a" * 500_000 + "@" + ".b" * 250_000, "@" * 1_000_000):
        assert sum(1 for _ in pii._email_spans(text)) <= 1
    assert time.time() - start < 3
    for text in ("a@b@c.d e@f.g.h.", "x.@y-.z..w @q.r", "a@b.c@d.e@f.g"):
        assert list(pii._email_spans(text)) == [("email", m.start(), m.end()) for m in re.finditer(pii.EMAIL, text)]


def test_no_result_hangs_on_the_counts_of_common_shingles(spark, monkeypatch):
    """Counts as sampled, turned round, and none: the classes are the same."""
    docs, counted = table(spark, SF, "documents"), jaccard._common_shingles
    runs = []
    for change in (lambda k, n: (k, n), lambda k, n: (k, n[::-1].copy()), lambda k, n: (k[:0], n[:0])):
        monkeypatch.setattr(jaccard, "_common_shingles", lambda *a, change=change: change(*counted(*a)))
        runs.append(sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.similar(docs).collect()))
    assert runs[0] == runs[1] == runs[2] and any(c != d for d, _, c in runs[0])


def test_every_registered_query_gives_its_rows(spark):
    """The registered queries, each over its whole table."""
    size = {"documents": "op2_sharding op5_language_id op6_ngram_jaccard_join op7_token_counts op8_pii op10_mixing", "embeddings": "op1_embedding_near_dedup"}
    for name, ops in size.items():
        for op in ops.split():
            assert registry.queries()[op](spark, SF).count() == table(spark, SF, name).count(), op


def test_shards_come_from_the_tree(spark):
    """Most bytes stay where the cuts put them, and the shards are within two per cent of each other."""
    got = registry.queries()["op2_sharding"](spark, "/root/testdata/sf0.01").toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 40 and sizes.max() <= 1.02 * sizes.min()
    assert got[got.placed_by == "cut"]["size"].sum() >= 0.75 * got["size"].sum() and set(got.placed_by) <= {"cut", "moved", "dealt"}
    texts = {r["doc_id"]: r["text"] for r in table(spark, "/root/testdata/sf0.01", "documents").collect()}
    where: dict = {}
    for r in got.itertuples():
        where.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_the_tree_places_light_groups_whole(spark):
    """Groups of one size: all of them stay where a cut put them."""
    rows = [(k, f"text {k:05d}", f"s{k % 3}", ("en", "de")[k % 2]) for k in range(3000)]
    got = kd_sharding.shards(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), 12).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert sizes.max() <= 1.02 * sizes.min() and (got.placed_by == "cut").mean() > 0.98


def test_groups_larger_than_a_shard_are_dealt_by_rows(spark):
    """Four copies that fill two shards, one document that is larger than a shard, and hundreds of copies."""
    rows = [(k, "a" * 4000, "s", "en") for k in range(4)] + [(10, "b" * 12_000, "s", "en")] + [(100 + k, "c" * 80, "t", None) for k in range(400)] + [(1000 + k, f"{k:03d} " * 50, "u", "de") for k in range(100)]
    got = kd_sharding.shards(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), 10).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(got) == len(rows) and sizes.drop(sizes.idxmax()).max() <= 1.05 * sizes.drop(sizes.idxmax()).mean() and sizes.max() >= 12_016 and sizes.min() > 0.8 * (sizes.sum() - 12_016) / 9
    dealt = got[got.placed_by == "dealt"]
    assert set(dealt[dealt.doc_id < 4].groupby("shard").size()) <= {1, 2}
    copies = dealt[dealt.doc_id.between(100, 499)].groupby("shard").size()
    assert len(copies) >= 2 and copies.max() - copies.min() <= 1

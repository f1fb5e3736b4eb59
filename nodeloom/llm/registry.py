"""The queries of the corpus operators, with production parameters over whole
tables, and their SQL where SQL can express them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.llm import chat, embedding_dedup, exact_dedup, importance, jaccard, kd_sharding, langid, mixing, packing, periodic, pii, token_scan, url_filter
from nodeloom.llm.common import settle, small_batches, table


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    with small_batches(spark):
        return settle(langid.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score"), "languages")


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_scan.token_counts(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_sharding.shards(table(spark, sf_dir, "documents"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    more = spark.sql(f"select -7L as conv_id, stack(2, 0L, 'user', '{control}', 1L, 'assistant', '{control}') as (turn, role, text)")
    return chat.digests(chat.format_chats(rows.unionByName(more)))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def tail_repeated(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a tenth of the documents, by a hash of the id, with the tail
    from a place on replaced by repeats of its beginning."""
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    with small_batches(spark):
        found = periodic.longest(periodic.collapse(table(spark, sf_dir, "documents"), change=tail_repeated))
        digest = lambda c: F.sha2(c.cast("binary"), 256)
        shown = found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", digest(periodic.listing("runs")).alias("runs_sha256"), digest(F.col("text")).alias("collapsed_sha256"))
        return settle(shown, "runs")


#: Rules of the registered query: verdict, host, path prefix.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

#: Labelled URLs of the registered query (fixed values): hosts, with the paths below in turn.
BAD_HOSTS = "cheap-pills.example.com casino-win.example.org free-bets.example.net ads-track.example.com spam-farm.example.org adult-x.example.net www.cheap-pills.example.net blog.casino-win.example.com m.free-bets.example.org www.ads-track.example.net blog.spam-farm.example.com m.adult-x.example.org pills-online.example.com best-casino.example.net bets-now.example.com win-cash.example.org ads-server.example.net track-click.example.com spam-mail.example.net link-farm.example.com adult-videos.example.org x-cams.example.com cheap-loans.example.net free-casino.example.com poker-win.example.net pharmacy-pills.example.org cheap-replica.example.com bets-bonus.example.org free-spins.example.net adult-chat.example.com".split()
GOOD_HOSTS = "tionsh.example.com www.tionble.example.org blog.tiontion.example.net m.ththth.example.net thther.example.net www.ththon.example.org ththan.example.net blog.ththre.example.net m.therer.example.org theron.example.net news.example.com www.library.example.org blog.recipes.example.net m.weather.example.com museum.example.org university.example.net www.city-hall.example.com blog.travel.example.org m.football.example.net history.example.com science.example.org www.health.example.net blog.gardening.example.com m.music.example.org daily-news.example.net open-source.example.org www.book-club.example.com school.example.net blog.mountain-bike.example.org railway.example.com".split()
URL_PATHS = "/en/12 /fr/845?page=2&ref=x /de/330#top /es/571.html /en/904/ /fr/66?utm_source=feed /de/218 /es/99/ /en/437.html /fr/703#top".split()


def labelled_urls(spark: SparkSession) -> DataFrame:
    rows = [(f"{('https', 'http')[k % 2]}://{host}{URL_PATHS[k % len(URL_PATHS)]}", bad) for hosts, bad in ((BAD_HOSTS, True), (GOOD_HOSTS, False)) for k, host in enumerate(hosts)]
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(url).alias("url"), F.lit(bad).alias("bad")) for url, bad in rows])))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES, url_filter.train(labelled_urls(spark)))


SQL_OP4 = """
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked as (
  select *, regexp_replace(text, '(<)(\\\\*(?:\\|im_start\\|>|\\|im_end\\|>|s>|/s>|<SYS>>|</SYS>>|\\|endoftext\\|>))', '\\1\\\\\\2', 'g') as t1 from rows
), marked2 as (
  select *, regexp_replace(t1, '(\\[)(\\\\*(?:INST\\]|/INST\\]))', '\\1\\\\\\2', 'g') as t2 from marked
), convs as (
  select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '') as loss,
    sum(length('<|im_start|>' || role || chr(10) || t2 || '<|im_end|>' || chr(10))) as formatted_chars,
    bool_or(t2 <> text) as escaped
  from marked2 group by conv_id
)
select conv_id, n_turns, turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256,
  formatted_chars::bigint as formatted_chars, true as round_trip, escaped from convs
"""

SQL_OP9 = """
with t as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm from documents
)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, sha256(norm) as text_sha256
from t window w as (partition by norm)
"""


SQL_OP11 = r"""
with lists as (
  select true as own, doc_id, row_number() over () as n, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
  union all
  select false, null, row_number() over (), regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark
), features as (
  select own, doc_id, n, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f from lists
), steps as (
  select list(c order by b) as crcs from (select b, list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end, b) as c from range(256) t(b))
), hexed as (
  select f, hex(encode(f)) as x from (select distinct f from features)
), crcs as (
  select f, xor(4294967295, list_reduce(list_transform(range(0, length(x) // 2), lambda k: (position(substr(x, 2 * k + 1, 1) in '0123456789ABCDEF') - 1) * 16 + position(substr(x, 2 * k + 2, 1) in '0123456789ABCDEF') - 1), lambda c, b: xor(crcs[(xor(c, b) & 255) + 1], c >> 8), 4294967295)) % 10000 as bucket from hexed, steps
), dealt as (select own, doc_id, n, bucket from features join crcs using (f)
), counts as (
  select r.b as bucket, coalesce(sum(case when own then 1 end), 0) as s, coalesce(sum(case when not own then 1 end), 0) as t from range(10000) r(b) left join dealt on dealt.bucket = r.b group by 1
), gains as (
  select bucket, floor(1000 * ln((t + 1)::double * ((select sum(s) from counts) + 10000)::double / ((s + 1)::double * ((select sum(t) from counts) + 10000)::double)))::bigint as gain from counts
), own as (
  select n, count(*) as n_features, floor(sum(gain)::double / count(*))::bigint as weight from dealt join gains using (bucket) where own group by n
), scored as (
  select l.doc_id, l.n, len(l.w) as words, coalesce(o.n_features, 0) as n_features, coalesce(o.weight, 0) as weight,
    coalesce(o.weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(l.doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score
  from lists l left join own o on o.n = l.n where l.own
), drawn as (
  select *, case when words >= 20 then row_number() over (partition by words >= 20 order by score desc, doc_id nulls last, n) end as place from scored
)
select doc_id, n_features, weight, score, case when place <= 25 * (select count(*) from scored where words >= 20) // 100 then place end as rank from drawn
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_embedding_near_dedup, op2_sharding, op3_best_fit_packing, op4_chat_formatting, op5_language_id, op6_ngram_jaccard_join, op7_token_counts, op8_pii, op9_exact_dedup, op10_mixing, op11_importance_resampling, op12_periodic_runs, op13_url_filter)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_formatting": SQL_OP4, "op9_exact_dedup": SQL_OP9, "op11_importance_resampling": SQL_OP11}

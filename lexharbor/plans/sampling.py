"""Queries of deduplication, exclusion, splits, mixtures and packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedup as D, splits as S
from .registry import ART, articles, docs, query, table

_W = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"
_SETS = rf"""one as (select min(doc_id) doc_id, text from documents group by text), ws as (select doc_id, {_W} w from one),
gr as (select doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end g from ws),
ex as (select doc_id, unnest(g) x from gr), sz as (select doc_id, len(g) n from gr),
hit as (select a.doc_id a, b.doc_id b, count(*) c from ex a join ex b on a.x = b.x and a.doc_id < b.doc_id group by all),
lk as (select a, b, c / (s.n + t.n - c) similarity from hit join sz s on s.doc_id = a join sz t on t.doc_id = b where c >= 0.8 * (s.n + t.n - c))"""
_CLASS = f"""{_SETS}, bo as (select a x, b y from lk union select b, a from lk),
reach(x, y) as (select x, y from bo union select r.x, bo.y from reach r join bo on r.y = bo.x),
root as (select x, least(x, min(y)) r from reach group by x),
cl as (select d.doc_id, d.source, coalesce(r.r, o.doc_id) class_id from documents d join one o using (text) left join root r on r.x = o.doc_id)"""


def _classes(spark, sf):
    return D.near_duplicate_classes(docs(spark, sf, "doc_id", "text"))


@query(f"with recursive {_CLASS} select doc_id, class_id from cl")
def near_dup_classes(spark, sf):
    return _classes(spark, sf)


@query(f"with recursive {_CLASS} select doc_id from cl where doc_id = class_id")
def near_dup_keep(spark, sf):
    return D.keep_first(_classes(spark, sf)).select("doc_id")


@query(f"with recursive {_CLASS} select source, count(*) n, round(avg((doc_id <> class_id)::int), 9) removed_fraction from cl group by 1")
def dedup_rate(spark, sf):
    c = _classes(spark, sf).join(docs(spark, sf, "doc_id", "source"), "doc_id")
    return D.removed_rate(c, ["source"]).withColumn("removed_fraction", F.round("removed_fraction", 9))


@query(f"with recursive {_CLASS}, {ART} select year(day)::int as year, count(*) n, round(avg((doc_id <> class_id)::int), 9) removed_fraction from cl join art using (doc_id) group by 1")
def dedup_rate_by_year(spark, sf):
    c = _classes(spark, sf).join(articles(spark, sf).select("doc_id", F.year("day").alias("year")), "doc_id")
    return D.removed_rate(c, ["year"]).withColumn("removed_fraction", F.round("removed_fraction", 9))


@query(rf"select doc_id, len(w) n_words, greatest(0, len(w) - 4)::bigint n_shingles, md5(coalesce(array_to_string(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')), '|'), '')) digest from (select doc_id, {_W} w from documents)")
def shingles(spark, sf):
    w = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0)
    d = docs(spark, sf, "doc_id", "text").select("doc_id", w.alias("w"))
    s = T.shingles(F.col("w"))
    return d.select("doc_id", F.size("w").cast("long").alias("n_words"), F.size(s).cast("long").alias("n_shingles"), F.md5(F.array_join(s, "|")).alias("digest"))


@query()
def minhash(spark, sf):
    return D.with_shingles(docs(spark, sf, "doc_id", "text"), "text").select("doc_id", D.signature(F.col("s"), 8).alias("signature"))


@query(f"with {ART} select a.doc_id, a.source, a.title_year from art a where not exists (select 1 from art b where b.doc_id % 5 = 0 and b.source = a.source and b.title_year = a.title_year) ")
def anti_dedup(spark, sf):
    a = articles(spark, sf).select("doc_id", "source", "title_year")
    return D.minus(a, a.where("doc_id % 5 = 0"), ["source", "title_year"])


_TITLE = "case when doc_id % 3 = 0 then '' when doc_id % 7 = 0 then null else 't' || doc_id end"


@query(f"with t as (select doc_id, source, {_TITLE} title from documents), k as (select source, arg_min(title, doc_id) f from t where coalesce(title, '') <> '' group by 1) select doc_id, coalesce(nullif(coalesce(title, ''), ''), f, '') title from t left join k using (source)")
def title_fill(spark, sf):
    d = F.col("doc_id")
    t = docs(spark, sf, "doc_id", "source").withColumn("title", F.when(d % 3 == 0, "").when(d % 7 != 0, F.concat(F.lit("t"), d)))
    return D.fill_title(t, "title", "source", "doc_id").select("doc_id", "title")


_FRAC = "('0x' || substr(sha1(article_id), 1, 8))::bigint / 4294967295.0::double"
_SPLIT = f"sp as (select doc_id, article_id, case when date between '1939-07-01' and '1939-08-31' then 'embargo' when date >= '1939-09-01' then 'test' when {_FRAC} < 0.02::double then 'holdout' when {_FRAC} < 0.04::double then 'validation' else 'train' end split from art)"


@query(f"with {ART}, {_SPLIT} select doc_id, split from sp")
def split_assign(spark, sf):
    return articles(spark, sf).select("doc_id", S.split(F.col("date"), F.col("article_id")).alias("split"))


@query(f"with {ART}, {_SPLIT} select article_id, count(distinct split) n from sp group by 1 having count(distinct split) > 1")
def split_disjoint(spark, sf):
    return S.overlaps(articles(spark, sf).withColumn("split", S.split(F.col("date"), F.col("article_id"))), "article_id")


@query(f"with {ART}, r as (select doc_id, source, row_number() over (partition by source order by sha1(article_id), article_id) k, count(*) over (partition by source) n from art) select doc_id, source from r where k <= ceil(n * 0.02::double)")
def exact_holdout(spark, sf):
    return S.exact_holdout(articles(spark, sf), ["source"], "article_id").select("doc_id", "source")


@query(f"with {ART}, w as (select doc_id, source, exp((year(day) - 1939) / 5.0::double) x from art where year(day) <= 1939) select doc_id, round(x / sum(x) over (partition by source), 9) weight from w")
def recency_weight(spark, sf):
    a = articles(spark, sf).withColumn("year", F.year("day")).where("year <= 1939")
    return S.recency_weight(a, "year", ["source"]).select("doc_id", F.round("weight", 9).alias("weight"))


@query(f"with {ART}, b as (select doc_id, year(day)::int as year, n_words, coalesce(sum(n_words) over (order by year(day) desc, doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as before from art) select doc_id, year, before from b where before < 100000")
def mixture_fill(spark, sf):
    a = articles(spark, sf).withColumn("year", F.year("day"))
    return S.fill_budget(a, "year", "n_words", 100_000, ("doc_id",)).select("doc_id", "year", "before")


@query(f"with {ART}, b as (select doc_id, n_words + 1 s, coalesce(sum(n_words + 1) over (order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as start from art) select doc_id, start, start // 2048 first_seq, (start + s - 1) // 2048 last_seq, start % 2048 as \"offset\" from b")
def pack_sequences(spark, sf):
    return S.pack(articles(spark, sf), "doc_id", "n_words").select("doc_id", "start", "first_seq", "last_seq", "offset")


_EPS = "(values " + ", ".join(f"({e}::double)" for e in S.EPSILONS) + ") e(epsilon)"


@query(f"""with {ART}, r as (select doc_id, case when source = 'src0' then 'other' else 'base' end part, row_number() over (partition by source = 'src0' order by sha1(doc_id::varchar), doc_id) k from art)
select epsilon, part, doc_id from r, {_EPS} where k <= 100 and k <= case when part = 'other' then round(epsilon * 100) else 100 - round(epsilon * 100) end""")
def epsilon_mix(spark, sf):
    d = docs(spark, sf, "doc_id", "source")
    return S.epsilon_mix(d.where("source <> 'src0'"), d.where("source = 'src0'"), "doc_id", 100)


TERMS = ["the", "license version", "credential", "token"]
_RE = "(?i)\\b(?:" + "|".join(sorted(TERMS, key=len, reverse=True)) + ")\\b"


@query(f"select doc_id from documents where not regexp_matches(text, '{_RE}')")
def c1_screen(spark, sf):
    return docs(spark, sf, "doc_id", "text").where(~D.screen(F.col("text"), TERMS)).select("doc_id")


@query(f"select source, count(*) n, count(*) filter (where regexp_matches(text, '{_RE}')) hits, round(avg(regexp_matches(text, '{_RE}')::int), 9) hit_rate from documents group by 1")
def probe_audit(spark, sf):
    hit = D.screen(F.col("text"), TERMS)
    return docs(spark, sf, "source", "text").groupBy("source").agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"), F.round(F.avg(hit.cast("double")), 9).alias("hit_rate"))


_TOK = r"list_filter(list_transform(regexp_extract_all(text, '[\p{L}\p{Nl}\p{No}]+'), lambda t: replace(lower(t), 'ſ', 's')), lambda t: length(t) >= 2)"


@query(f"select distinct word from (select unnest({_TOK}) word from documents) where word in ('" + "', '".join(TERMS) + "')")
def vocab_probe_check(spark, sf):
    words = docs(spark, sf, "text").select(F.explode(T.tokens(F.col("text"))).alias("word"))
    return words.intersect(spark.createDataFrame([(t,) for t in TERMS], "word string"))


@query(f"with w as (select word, count(*) n from (select unnest({_TOK}) word from documents) group by 1), p as (select n, unnest(list_transform(range(1, length(word)), lambda i: substr(word, i, 2))) pair from w) select pair, sum(n)::bigint n from p group by 1 order by n desc, pair limit 100")
def bpe_pair_counts(spark, sf):
    return S.pair_counts(docs(spark, sf, "text"))


@query("select doc_id, (md5_number % 7)::bigint shard from (select doc_id, list_reduce(list_transform(range(1, 41), lambda i: ('0x' || substr(sha1('d_' || doc_id), i, 1))::bigint), lambda a, h: (a * 16 + h) % 7) md5_number from documents)")
def stable_shard(spark, sf):
    return articles(spark, sf).select("doc_id", T.stable_shard(F.col("article_id"), 7).alias("shard"))

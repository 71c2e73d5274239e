"""Queries of inventories, censuses, planning and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import inventory as I, planning as P
from .registry import ART, VOTE, articles, docs, query, table, voted

_PERIOD = "case " + " ".join(f"when date between '{lo}' and '{hi}' then '{n}'" for n, lo, hi in I.PERIODS) + " end"
_INV = f"{ART}, a as (select art.*, d.lang, {_PERIOD} period from art join documents d using (doc_id)), p as (select * from a where period is not null)"


def _rows(spark, sf):
    return articles(spark, sf, "lang")


@query(f"with {_INV} select period, source, lang, count(*) docs, sum(n_words)::bigint words, coalesce(sum(n_words) filter (where lang = 'en'), 0)::bigint en_words from p group by all")
def inventory_period(spark, sf):
    return I.by_period(_rows(spark, sf))


@query(f"with {_INV}, w as (select period, coalesce(sum(n_words) filter (where lang = 'en'), 0)::bigint words_en, coalesce(sum(n_words) filter (where lang = 'de'), 0)::bigint words_de from p group by 1) select *, words_en * 1300 + words_de * 1500 milli_tokens from w")
def inventory_tokens(spark, sf):
    return I.token_estimates(_rows(spark, sf))


@query(f"with {_INV} select source, " + ", ".join(f"(sum(n_words) filter (where period = '{n}'))::bigint as \"{n}\"" for n, _, _ in I.PERIODS) + " from p group by 1")
def inventory_matrix(spark, sf):
    return I.word_matrix(_rows(spark, sf))


_NAMES = list(I.FORMS)
_SRC = "(['" + "', '".join(_NAMES) + "', 'other'])[doc_id % 12 + 1]"
_FORM = "case s " + " ".join(f"when '{k}' then '{v}'" for k, v in I.FORMS.items()) + " else '?' end"


@query(f"select s source, {_FORM} form, s <> 'other' and s <> 'hmd_newspapers' in_training, count(*) docs from (select {_SRC} s from documents) group by all")
def inventory_form(spark, sf):
    names = F.array(*[F.lit(n) for n in [*_NAMES, "other"]])
    d = docs(spark, sf, "doc_id").groupBy(F.get(names, (F.col("doc_id") % 12).cast("int")).alias("source")).agg(F.count("*").alias("docs"))
    return I.with_form(d).select("source", "form", "in_training", "docs")


_CENSUS = "c as (select a.*, case when doc_id % 23 = 0 then 0 when doc_id % 29 = 0 then null else year(day) end y, doc_id % 31 = 0 dup from a), e as (select *, coalesce(nullif(y, 0), 9999) <= 1938 early from c)"
_PART = ", ".join(
    f"count(*) filter (where {c} and not dup) {n}docs, coalesce(sum(n_words) filter (where {c} and not dup), 0)::bigint {n}words, coalesce(sum(n_bytes) filter (where {c} and not dup), 0)::bigint {n}bytes"
    for n, c in (("", "true"), ("early_", "early"), ("early_en_", "early and lang = 'en'"))
)


@query(f"with {_INV}, {_CENSUS} select source, {_PART}, count(*) filter (where dup) duplicates from e group by 1")
def census(spark, sf):
    d = F.col("doc_id")
    year = F.when(d % 23 == 0, 0).when(d % 29 == 0, F.lit(None).cast("int")).otherwise(F.year("day"))
    return I.census(_rows(spark, sf).withColumn("year", year).withColumn("is_duplicate", d % 31 == 0))


@query(f"with {ART}, {VOTE} select year(day)::int as year, count(*) articles, sum(n_words)::bigint words, sum(n_bytes)::bigint bytes, count(*) filter (where voted = 'en') lang_en, round(count(*) filter (where voted = 'en') / count(*), 9) en_share from vote group by 1")
def yearly_yield(spark, sf):
    v = voted(spark, sf).select(F.year("day").alias("year"), "n_words", "n_bytes", F.col("voted").alias("lang"))
    return I.yearly_yield(v).withColumn("en_share", F.round("en_share", 9))


@query(f"with {_INV}, g as (select period, source, sum(n_words)::bigint n_words from p group by all) select *, round(n_words / sum(n_words) over (partition by period), 9) share from g")
def corpus_share(spark, sf):
    r = _rows(spark, sf).withColumn("period", I.period(F.col("date"))).where("period is not null")
    return I.share(r, ["period", "source"], "n_words", ["period"]).withColumn("share", F.round("share", 9))


@query("select * from (values (0::bigint, 1923), (1, 1924), (2, 1925), (3, 1922), (4, 1921), (5, 1920)) t(pos, year)")
def year_spec(spark, sf):
    return I.year_list(spark, "1923-1925,1922-1920").select(F.col("pos").cast("long").alias("pos"), "year")


@query("select event_id, floor(epoch(ts) / 3600)::bigint h, k.lo, k.hi from (select event_id, ts, (floor(epoch(ts) / 86400))::bigint dd from events) e join (select (n * 3 + 19700)::bigint lo, (n * 3 + 19702)::bigint hi from range(0, 20) r(n)) k on dd between lo and hi")
def range_join(spark, sf):
    day = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 86400)
    e = table(spark, sf, "events", "event_id", "ts").select("event_id", day.alias("dd"), F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).alias("h"))
    k = spark.range(20).select((F.col("id") * 3 + 19700).alias("lo"), (F.col("id") * 3 + 19702).alias("hi"))
    return I.in_intervals(e, "dd", k, width=7).select("event_id", "h", "lo", "hi")


# manifests made of orders and lineitem keys
_DONE = "(select o_orderkey as key from orders where o_orderkey % 3 = 0)"


@query(f"select o_orderkey as key, (o_totalprice * 100)::bigint bytes from orders where o_orderkey not in {_DONE}")
def download_plan(spark, sf):
    return P.download_plan(_files(spark, sf), _files(spark, sf).where("key % 3 = 0"))


def _files(spark, sf):
    return table(spark, sf, "orders", "o_orderkey", "o_totalprice").select(F.col("o_orderkey").alias("key"), F.round(F.col("o_totalprice") * 100).cast("long").alias("bytes"))


@query(f"select count(*) files, coalesce(sum((o_totalprice * 100)::bigint), 0)::bigint bytes, round(coalesce(sum((o_totalprice * 100)::bigint), 0) / 15e6, 6) as \"seconds\" from orders where o_orderkey not in {_DONE}")
def download_eta(spark, sf):
    return P.eta(download_plan(spark, sf)).withColumn("seconds", F.round("seconds", 6))


_PRUNE = """raw as (select o_orderkey as key, 'r' || o_orderkey file, (o_totalprice * 100)::bigint bytes from orders where o_orderkey % 11 <> 0 and o_orderkey % 13 <> 0),
ing as (select o_orderkey as key, 'i' || o_orderkey out, md5(o_orderkey::varchar) sha256, case when o_orderkey % 7 = 0 then null when o_orderkey % 9 = 0 then 'x' else md5(o_orderkey::varchar) end found, o_orderkey % 4 n from orders where o_orderkey % 5 <> 0),
plan as (select r.key, r.file, r.bytes, case when i.key is null then 'not ingested' when found is null then 'missing' when found <> sha256 then 'sha256 mismatch' when n < 1 then 'no rows' end problem from raw r left join ing i using (key))"""


def _prune(spark, sf):
    k = F.col("key")
    f = _files(spark, sf)
    raw = f.select("key", F.concat(F.lit("r"), k).alias("file"), "bytes", (k % 11 != 0).alias("present"), (k % 13 == 0).alias("pruned"))
    digest = F.md5(k.cast("string"))
    ing = f.where(k % 5 != 0).select("key", F.concat(F.lit("i"), k).alias("file"), digest.alias("sha256"), F.when(k % 7 == 0, F.lit(None)).when(k % 9 == 0, "x").otherwise(digest).alias("found_sha256"), (k % 4).alias("rows"))
    return P.prune_plan(raw, ing)


@query(f"with {_PRUNE} select * from plan")
def prune_plan(spark, sf):
    return _prune(spark, sf)


@query(f"with {_PRUNE} select count(*) filter (where problem is null) deletable, coalesce(sum(bytes) filter (where problem is null), 0)::bigint freed_bytes, count(problem) problems from plan")
def freed_bytes(spark, sf):
    return P.freed(_prune(spark, sf))


_WANT = "case doc_id % 5 when 0 then 'md5:' || md5(text) when 1 then 'sha1:' || sha1(text) when 2 then 'sha256:' || sha256(text) when 3 then '-' else 'md5:00' end"


@query("select doc_id, case when doc_id % 37 = 0 then 'size mismatch' when doc_id % 5 = 3 then 'size only' when doc_id % 5 = 4 then 'digest mismatch' else 'ok' end verdict from documents")
def checksum_verify(spark, sf):
    d, t = F.col("doc_id"), F.col("text").cast("binary")
    want = F.when(d % 5 == 0, F.concat(F.lit("md5:"), F.md5(t))).when(d % 5 == 1, F.concat(F.lit("sha1:"), F.sha1(t))).when(d % 5 == 2, F.concat(F.lit("sha256:"), F.sha2(t, 256))).when(d % 5 == 3, "-").otherwise("md5:00")
    size = F.octet_length("text") + F.when(d % 37 == 0, 1).otherwise(0)
    return docs(spark, sf, "doc_id", "text").select("doc_id", P.checksum(t, want, size).alias("verdict"))


@query("select count(*) n_rows, sum(h)::bigint hash_sum, bit_xor(h) hash_xor from (select ('0x' || substr(md5(doc_id || chr(31) || text), 1, 8))::bigint h from documents)")
def content_fingerprint(spark, sf):
    return P.fingerprint(docs(spark, sf, "doc_id", "text"))


@query("select distinct l_orderkey as key from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderkey % 10 <> 0)")
def unknown_keys(spark, sf):
    asked = table(spark, sf, "lineitem", "l_orderkey").select(F.col("l_orderkey").alias("key"))
    return P.unknown_keys(asked, _files(spark, sf).where("key % 10 <> 0"))


@query("select source, n_tokens, case when n_tokens <= 10000 then 's' when n_tokens <= 30000 then 'm' when n_tokens <= 100000 then 'l' else 'xl' end rung from (select source, sum(n_chars)::bigint n_tokens from documents group by 1)")
def size_rung(spark, sf):
    t = docs(spark, sf, "source", "n_chars").groupBy("source").agg(F.sum("n_chars").alias("n_tokens"))
    rungs = spark.createDataFrame([("s", 10_000), ("m", 30_000), ("l", 100_000), ("xl", 1 << 60)], "name string, max_tokens long")
    return t.join(P.size_rung(t.select("n_tokens").distinct(), rungs), "n_tokens").select("source", "n_tokens", "rung")


_BLOCKS = "b as (select conv_id page, 600.0::double w, case when turn % 7 = 6 then 10 when turn % 2 = 0 then 40 else 340 end::double x0, case when turn % 7 = 6 then 590 when turn % 2 = 0 then 300 else 580 end::double x1, (1000 - turn * 10 % 70)::double y0, text from conversations where trim(text) <> ''), s as (select *, case when x1 <= 0.55 * w then 0 when x0 >= 0.45 * w then 1 else -1 end sd from b), f as (select *, (count(*) filter (where sd = -1) over (partition by page)) * 2 > count(*) over (partition by page) fl from s)"


@query(f"with {_BLOCKS} select page, row_number() over (partition by page order by case when fl then 0 else greatest(sd, 0) end, y0, x0, text)::int pos, text from f")
def pdf_block_order(spark, sf):
    t = F.col("turn")
    c = table(spark, sf, "conversations", "conv_id", "turn", "text")
    x0 = F.when(t % 7 == 6, 10).when(t % 2 == 0, 40).otherwise(340)
    x1 = F.when(t % 7 == 6, 590).when(t % 2 == 0, 300).otherwise(580)
    b = c.select(F.col("conv_id").alias("page"), F.lit(600.0).alias("page_width"), x0.cast("double").alias("x0"), x1.cast("double").alias("x1"), (1000 - t * 10 % 70).cast("double").alias("y0"), "text")
    return P.column_order(b)

"""Queries of lexicons and OCR quality.  The keyed texts are the first half of documents by id, the pool the rest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ocr as O
from ..sources.manifests import lexicon_digest
from .registry import ART, articles, docs, query

_TOK = r"list_filter(list_transform(regexp_extract_all(text, '[\p{L}\p{Nl}\p{No}]+'), lambda t: replace(lower(t), 'ſ', 's')), lambda t: length(t) >= 2)"
DF, TITLES = 8, 3
_LEX = f"""tok as (select doc_id, source, {_TOK} t from documents),
freq as (select word, count(*) freq from (select unnest(t) word from tok where doc_id % 2 = 0) group by 1 having count(*) >= 2),
pool as (select word, count(*) df, count(distinct source) titles from (select distinct doc_id, source, unnest(t) word from tok where doc_id % 2 = 1) group by 1 having count(*) >= {DF} and count(distinct source) >= {TITLES}),
lex as (select word from freq union select word from pool)"""
_SCORE = f"""{_LEX}, sc as (select d.doc_id, d.source, count(u.word) n_tokens, count(l.word) n_hits from tok d left join (select doc_id, unnest(t) word from tok) u using (doc_id) left join lex l on l.word = u.word group by all),
s as (select *, case when n_tokens >= 20 then n_hits / n_tokens else 'nan'::double end score from sc)"""


def _keyed(spark, sf):
    return O.term_frequency(docs(spark, sf, "doc_id", "text").where("doc_id % 2 = 0"))


def _pool(spark, sf):
    return O.pool_words(docs(spark, sf, "doc_id", "text", "source").where("doc_id % 2 = 1"), "source", DF, TITLES)


def _lexicon(spark, sf):
    return O.lexicon(_keyed(spark, sf), _pool(spark, sf))


def _scores(spark, sf):
    return O.scores(docs(spark, sf, "doc_id", "source", "text"), _lexicon(spark, sf), ["doc_id", "source"])


@query(f"with {_LEX} select * from freq")
def term_freq(spark, sf):
    return _keyed(spark, sf)


@query(f"with {_LEX} select * from pool")
def lexicon_pool(spark, sf):
    return _pool(spark, sf)


@query(f"with {_LEX} select word from lex")
def lexicon_union(spark, sf):
    return _lexicon(spark, sf)


@query(f"with {_LEX} select word from pool where word not in (select word from freq)")
def lexicon_pool_only(spark, sf):
    return O.pool_only(_keyed(spark, sf), _pool(spark, sf))


@query(f"with {_LEX} select count(*) n, sha256(coalesce(string_agg(word, chr(10) order by word) || chr(10), chr(10))) digest from lex")
def lexicon_address(spark, sf):
    return lexicon_digest(_lexicon(spark, sf))


@query(f"with {_SCORE} select doc_id, n_tokens, n_hits, case when n_tokens >= 20 then round(score, 9) end score from s")
def ocr_score(spark, sf):
    return _scores(spark, sf).select("doc_id", "n_tokens", "n_hits", F.when(~F.isnan("score"), F.round("score", 9)).alias("score"))


@query(f"with {_SCORE} select least(39, floor(score * 40))::int bin, count(*) n from s where not isnan(score) group by 1")
def ocr_histogram(spark, sf):
    return O.histogram(_scores(spark, sf))


_Q = ", ".join(f"max(score) filter (where r = least(n - 1, floor({q}::double * n))) p{round(q * 100)}" for q in O.QUANTILES)
_B = ", ".join(f"round(avg((score < {t}::double)::int), 9) below_{round(t * 100)}" for t in O.THRESHOLDS)


@query(f"with {_SCORE}, k as (select *, row_number() over (partition by source order by score) - 1 r, count(*) over (partition by source) n from s where not isnan(score)) select source, count(*) n, {_Q}, {_B} from (select * exclude n, n from k) group by source")
def ocr_quantiles(spark, sf):
    out = O.quantiles(_scores(spark, sf), ["source"])
    return out.select(*[F.round(c, 9).alias(c) if c.startswith("below") else F.col(c) for c in out.columns])


@query(f"with {_SCORE} select source, sum(n_tokens)::bigint n_tokens, round(1 - sum(n_hits) / sum(n_tokens), 9) oov_rate from s group by 1")
def oov_rate(spark, sf):
    return O.out_of_vocabulary(_scores(spark, sf), ["source"]).withColumn("oov_rate", F.round("oov_rate", 9))


_LIKE = r"""case when len(ws) > 0 then len(list_filter(ws, lambda w: regexp_matches(w, '^\p{P}*\p{L}+([''’-]\p{L}+)*\p{P}*$'))) / len(ws) else 'nan'::double end"""


@query(f"with {_SCORE}, w as (select doc_id, regexp_extract_all(text, '[^\\x09-\\x0d\\x1c-\\x20\\x{{85}}\\x{{a0}}]+') ws from documents), l as (select doc_id, {_LIKE} word_like from w) select doc_id, round(score, 9) score, round(word_like, 9) word_like from s join l using (doc_id) where not isnan(score) and score >= 0.75 and not isnan(word_like) and word_like >= 0.7")
def ocr_filter(spark, sf):
    like = T.once(docs(spark, sf, "doc_id", "text"), ["doc_id"], T.word_like_share(F.col("text")).alias("word_like"))
    return O.ocr_filter(_scores(spark, sf).join(like, "doc_id")).select("doc_id", F.round("score", 9).alias("score"), F.round("word_like", 9).alias("word_like"))


@query(f"with {ART} select doc_id, article_id from art where ('0x' || substr(sha1(article_id), 1, 8))::bigint / 4294967295.0::double < 0.1::double")
def hash_sample(spark, sf):
    return O.hash_sample(articles(spark, sf), "article_id", 0.1).select("doc_id", "article_id")


@query(f"with {ART}, r as (select doc_id, source, title_year, row_number() over (partition by source, title_year order by sha1(article_id), article_id) cell_rank from art) select doc_id, source, title_year, cell_rank::int cell_rank from r where cell_rank <= 3")
def cell_cap(spark, sf):
    return O.cell_cap(articles(spark, sf), ["source", "title_year"], "article_id", 3).select("doc_id", "source", "title_year", F.col("cell_rank").cast("int").alias("cell_rank"))


@query("select doc_id, source from (select doc_id, source, row_number() over (partition by source order by doc_id) k from documents) where k <= 20")
def pool_sample(spark, sf):
    return O.first_rows(docs(spark, sf, "doc_id", "source"), F.col("source"), F.col("doc_id"), 20).select("doc_id", "source")

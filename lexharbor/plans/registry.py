"""Where queries register, and what they share: the article table made of `documents`, in both dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import language, text as T

REGISTRY: dict[str, tuple] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        REGISTRY[name or f.__name__] = (f, sql)
        return f

    return add


def docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents.  If texts are read from fewer splits than there are cores (a small table of one row group), their
    rows are dealt to all cores; a larger table is left as the scan cuts it."""
    df, cores = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.sparkContext.defaultParallelism
    df = df.select(*columns) if columns else df
    return df.repartition(cores) if "text" in df.columns and df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def article_columns() -> list:
    """documents has no dates or titles: both are derived from doc_id and source."""
    day = F.date_add(F.lit("1890-01-01").cast("date"), (F.col("doc_id") * 7919 % 25000).cast("int"))
    return [F.concat(F.lit("d_"), F.col("doc_id")).alias("article_id"), day.alias("day"), F.date_format(day, "yyyy-MM-dd").alias("date"), (1936 + F.col("doc_id") % 8).cast("int").alias("title_year")]


def articles(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """doc_id, article_id, day, date, title_year, source, n_words, n_bytes (and more columns of documents)."""
    size = [T.word_count(F.col("text")).cast("long").alias("n_words"), T.byte_length(F.col("text")).cast("long").alias("n_bytes")]
    return docs(spark, sf_dir).select("doc_id", *article_columns(), "source", *size, *more)


def voted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """articles with the voted language (voted) and en_share."""
    keys = ["doc_id", "article_id", "day", "date", "title_year", "source", "n_words", "n_bytes"]
    return language.guess(articles(spark, sf_dir, "text"), keys).withColumnRenamed("lang", "voted")


RE2_SPACES = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
ART = f"""art as (select doc_id, 'd_' || doc_id article_id, date '1890-01-01' + (doc_id * 7919 % 25000)::int as day,
  strftime(date '1890-01-01' + (doc_id * 7919 % 25000)::int, '%Y-%m-%d') as date, (1936 + doc_id % 8)::int title_year, source, text,
  len(regexp_extract_all(text, '[^{RE2_SPACES}]+'))::bigint n_words, strlen(text)::bigint n_bytes from documents)"""
_LISTS = ", ".join(f"({i}, '{l}', '{w}')" for i, (l, w) in enumerate(language.STOPWORDS.items()))
VOTE = f"""sw as (select rank, lang, unnest(string_split(words, ' ')) word from (values {_LISTS}) t(rank, lang, words)),
vw as (select doc_id, lower(word) word, pos from documents, unnest((regexp_extract_all(text, '[a-zA-ZÀ-ÿ]+'))[1:400]) with ordinality as u(word, pos)),
votes as (select doc_id, lang, rank, count(*) v, min(pos) p from vw join sw using (word) group by all),
best as (select doc_id, lang, row_number() over (partition by doc_id order by v desc, p, rank) k from votes),
total as (select doc_id, sum(v)::bigint t, coalesce(sum(v) filter (where lang = 'en'), 0)::bigint en from votes group by 1),
vote as (select a.*, case when coalesce(t, 0) < 5 then 'und' else lang end voted, case when coalesce(t, 0) < 5 then 'nan'::float else (en / t)::float end en_share
  from art a left join total using (doc_id) left join (select * from best where k = 1) b using (doc_id))"""

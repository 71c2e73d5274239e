"""Period lexicons and OCR quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .prefix import running_sum
from .saved import saved

MIN_TOKENS, KEYED_MIN, POOL_DF, POOL_TITLES, POOL_FIRST, RATE, CELL = 20, 2, 50, 5, 1500, 0.02, 400
# Report periods (years, closed), quantiles, thresholds.
YEARS = [(1900, 1919), (1920, 1929), (1930, 1933), (1934, 1936), (1937, 1939), (1940, 1955)]
QUANTILES, THRESHOLDS, BINS = (0.1, 0.25, 0.5, 0.75, 0.9), (0.5, 0.6, 0.7, 0.8), 40
#: A lexicon is sent to all executors up to this size in memory; an entry takes ENTRY bytes besides its letters.
SENT, ENTRY = 96 << 20, 88


def term_frequency(keyed: DataFrame, least: int = KEYED_MIN) -> DataFrame:
    """(word, freq) of hand-keyed texts, at least `least` times."""
    words = keyed.select(F.explode(T.tokens(F.col("text"))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("freq")).where(F.col("freq") >= least)


def pool_words(pool: DataFrame, title: str = "newspaper", least_df: int = POOL_DF, least_titles: int = POOL_TITLES) -> DataFrame:
    """(word, df, titles) of words in enough documents and titles.  First counted by word and title (with map-side
    sums), then by word: no exact-distinct expansion, and a common word costs one row per title."""
    words = pool.select(title, F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("word"))
    per = words.groupBy("word", title).agg(F.count("*").alias("n"))
    return per.groupBy("word").agg(F.sum("n").alias("df"), F.count("*").alias("titles")).where((F.col("df") >= least_df) & (F.col("titles") >= least_titles))


def lexicon(keyed: DataFrame, pool: DataFrame) -> DataFrame:
    """(word): the union of both lists."""
    return keyed.select("word").union(pool.select("word")).distinct()


def pool_only(keyed: DataFrame, pool: DataFrame) -> DataFrame:
    return pool.select("word").join(keyed.select("word"), "word", "left_anti").distinct()


def scores(docs: DataFrame, words: DataFrame, keys: list[str], text: str = "text", least: int = MIN_TOKENS, sent: int = SENT) -> DataFrame:
    """keys, n_tokens, n_hits, score (NaN under `least` tokens).  The lexicon is saved first.  One of up to `sent` bytes
    meets the tokens where they are read, so only sums by document are shuffled.  A larger one meets them by word, shuffled
    once; there, a document sends each of its words once, counted in its row."""
    read = F.coalesce(F.col(text), F.lit(""))
    listed = saved(words.select("word"))
    if (listed.agg(F.sum(F.octet_length("word") + ENTRY)).first()[0] or 0) <= sent:
        each = docs.select(*keys, F.explode_outer(T.letter_runs(read)).alias("word")).select(*keys, T.folded(F.col("word")).alias("word"))
        each, listed = each.withColumn("n", F.when(F.length("word") >= 2, 1).otherwise(0)), F.broadcast(listed)
    else:
        each = _counted(docs, keys, T.tokens(read))
    met = each.join(listed.select("word", F.lit(True).alias("hit")), "word", "left")
    out = met.groupBy(*keys).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"), F.coalesce(F.sum(F.when(F.col("hit"), F.col("n"))), F.lit(0)).alias("n_hits"))
    return out.withColumn("score", F.when(F.col("n_tokens") >= least, F.col("n_hits") / F.nullif(F.col("n_tokens"), F.lit(0))).otherwise(F.lit(float("nan"))))


def _counted(docs: DataFrame, keys: list[str], words: Column) -> DataFrame:
    """keys, word, n: the runs of equal words of each sorted row; a row without words has one NULL."""
    row = T.once(docs, keys, F.array_sort(words).alias("_t"))
    at = lambda i: F.get("_t", i)
    starts = F.filter(F.sequence(F.lit(0), F.size("_t") - 1), lambda i: (i == 0) | (at(i) != at(i - 1)))
    row = T.once(row, [*keys, "_t"], F.when(F.size("_t") > 0, starts).otherwise(F.array().cast("array<int>")).alias("_s"))
    runs = F.transform("_s", lambda i, k: F.struct(at(i).alias("word"), (F.coalesce(F.get("_s", k + 1), F.size("_t")) - i).alias("n")))
    return row.select(*keys, F.explode_outer(runs).alias("_r")).select(*keys, "_r.word", "_r.n")


def out_of_vocabulary(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Share of tokens outside the lexicon by group."""
    return scored.groupBy(*keys).agg(F.sum("n_tokens").alias("n_tokens"), (1 - F.sum("n_hits") / F.nullif(F.sum("n_tokens"), F.lit(0))).alias("oov_rate"))


def hash_sample(df: DataFrame, key: str, rate: float = RATE) -> DataFrame:
    """Rows whose key's hash fraction is below the rate; the same rows at any partitioning."""
    return df.where(T.hash_fraction(F.col(key)) < rate)


def cell_cap(df: DataFrame, cell: list[str], key: str, most: int = CELL) -> DataFrame:
    """At most `most` rows of each cell, those of the lowest hash.  A rank limit over the window lets every task drop
    all but its own lowest rows before the shuffle."""
    w = Window.partitionBy(*cell).orderBy(F.sha1(F.col(key)), key)
    return df.withColumn("cell_rank", F.row_number().over(w)).where(F.col("cell_rank") <= most)


def first_rows(df: DataFrame, file: Column, index: Column, most: int = POOL_FIRST) -> DataFrame:
    """The first rows of each file by their place in it."""
    w = Window.partitionBy(file).orderBy(index)
    return df.withColumn("file_rank", F.row_number().over(w)).where(F.col("file_rank") <= most)


def histogram(scored: DataFrame, value: str = "score", bins: int = BINS) -> DataFrame:
    """(bin, n) on [0, 1], the last bin closed; NaN left out."""
    ok = scored.where(~F.isnan(value) & F.col(value).between(0, 1))
    return ok.groupBy(F.least(F.lit(bins - 1), F.floor(F.col(value) * bins)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def year_period(year: Column) -> Column:
    out = F.lit(None).cast("string")
    for a, b in reversed(YEARS):
        out = F.when(year.between(a, b), f"{a}-{b}").otherwise(out)
    return out


def quantiles(scored: DataFrame, keys: list[str], value: str = "score", qs=QUANTILES, thresholds=THRESHOLDS) -> DataFrame:
    """By group: n, the value at place floor(q * n) of the sorted values, and the shares strictly below thresholds.
    Rows are counted by value first, and the counts before each value are a running sum in ranges, so no task holds a
    group."""
    per = scored.where(~F.isnan(value)).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    at = running_sum(per, value, "_c", "_b", keys=tuple(keys))
    n = at.groupBy(*keys).agg(F.sum("_c").alias("n"))
    ranked = at.join(n, keys)
    place = lambda q: F.least(F.col("n") - 1, F.floor(F.lit(float(q)) * F.col("n")))
    here = lambda q: (F.col("_b") <= place(q)) & (place(q) < F.col("_b") + F.col("_c"))
    quantile = [F.max(F.when(here(q), F.col(value))).alias(f"p{round(q * 100)}") for q in qs]
    below = [(F.coalesce(F.sum(F.when(F.col(value) < t, F.col("_c"))), F.lit(0)) / F.sum("_c")).alias(f"below_{round(t * 100)}") for t in thresholds]
    return ranked.groupBy(*keys).agg(F.sum("_c").alias("n"), *quantile, *below)


def ocr_filter(df: DataFrame, score: str = "score", like: str = "word_like", least: float = 0.75, least_like: float = 0.70) -> DataFrame:
    ok = lambda c, t: ~F.isnan(c) & (F.col(c) >= t)
    return df.where(ok(score, least) & ok(like, least_like))

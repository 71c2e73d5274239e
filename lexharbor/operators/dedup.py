"""Near-duplicates by word 5-grams, and exclusions by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .saved import saved

SHINGLE, SIMILAR, BANDS, ROWS, FINER = 5, 0.8, 16, 3, 8
_WORDS = r"[^\x20\x09-\x0D]+"


def with_shingles(df: DataFrame, text: str, to: str = "s", n: int = SHINGLE) -> DataFrame:
    """Adds distinct 64-bit hashes of the word n-grams; a shorter text is one gram, a text without words none.  The
    words are a column of their own, so that they are cut once and not once per use."""
    w = df.withColumn("_w", F.regexp_extract_all(F.col(text), F.lit(_WORDS), 0))
    grams = F.when(F.size("_w") >= n, T.shingles(F.col("_w"), n)).when(F.size("_w") > 0, F.array(F.array_join("_w", " "))).otherwise(F.array().cast("array<string>"))
    return T.once(w, df.columns, F.array_distinct(F.transform(grams, lambda g: F.xxhash64(g))).alias(to))


def signature(hashes: Column, n: int = BANDS * ROWS) -> Column:
    """MinHash: for each seed the smallest rehash."""
    seeds = F.array(*[F.lit(i) for i in range(n)])
    return F.transform(seeds, lambda s: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, s))))


def minima(df: DataFrame, keys: list[str], hashes: str, n: int) -> DataFrame:
    """keys, m: the signature as minima by key of rows of one hash, for rows with hashes.  Unlike lambdas, these are
    compiled; each task keeps only the minima of its keys."""
    each = df.select(*keys, F.explode(hashes).alias("_v"))
    least = each.groupBy(*keys).agg(*[F.min(F.xxhash64("_v", F.lit(i))).alias(f"_{i}") for i in range(n)])
    return least.select(*keys, F.array(*[f"_{i}" for i in range(n)]).alias("m"))


def bands(sig: Column, n: int = BANDS, rows: int = ROWS) -> Column:
    return F.array(*[F.xxhash64(F.lit(b), F.slice(sig, b * rows + 1, rows)) for b in range(n)])


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def near_duplicate_links(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILAR) -> DataFrame:
    """(a, b, similarity): links between distinct texts.  Exact copies are folded first.  In a band's bucket each text is
    tested on whole shingle sets against the first one.  A bucket in which such a test fails is cut again, by FINER
    further minima one after another: texts that are similar are in most of the finer buckets together, and each is
    tested against the first one there, which texts that are less alike share less often.  All of it is aggregation and
    equi-joins: a bucket gives one pair per text and never all pairs."""
    first = docs.groupBy(F.xxhash64(text, F.md5(text)).alias("_h")).agg(F.min_by(text, key).alias(text), F.min(key).alias(key))
    one = saved(with_shingles(first, text).select(key, "_h", "s"))
    sig = minima(one, [key, "_h"], "s", BANDS * ROWS + FINER)
    sig = saved(sig.select(key, F.slice("m", BANDS * ROWS + 1, FINER).alias("fine"), F.explode(bands(F.slice("m", 1, BANDS * ROWS))).alias("band")))
    pairs = _with_first(sig, ["band"], key)
    links = saved(_verified(pairs.select("a", "b").distinct(), one, key, least))
    tested = pairs.join(links.select("a", "b", F.lit(True).alias("ok")), ["a", "b"], "left")
    failed = tested.where("ok is null").select("band").distinct()
    finer = sig.join(failed, "band", "left_semi").select(key, "band", F.posexplode("fine").alias("i", "v"))
    more = _with_first(finer, ["band", "i", "v"], key).select("a", "b").distinct().join(pairs.select("a", "b").distinct(), ["a", "b"], "left_anti")
    return links.unionByName(_verified(more, one, key, least))


def _with_first(rows: DataFrame, bucket: list[str], key: str) -> DataFrame:
    """bucket, a, b: the first key of each bucket with each of its others."""
    first = rows.groupBy(*bucket).agg(F.min(key).alias("a"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return rows.join(first, bucket).select(*bucket, "a", F.col(key).alias("b")).where("a < b")


def _verified(pairs: DataFrame, one: DataFrame, key: str, least: float) -> DataFrame:
    left = pairs.join(one.select(F.col(key).alias("a"), F.col("s").alias("sa")), "a")
    out = left.join(one.select(F.col(key).alias("b"), F.col("s").alias("sb")), "b")
    return out.select("a", "b", jaccard(F.col("sa"), F.col("sb")).alias("similarity")).where(F.col("similarity") >= least)


def classes(links: DataFrame) -> DataFrame:
    """(node, root): smallest reachable key.  Labels move along links to the smallest neighbour and then to that label's
    own label, so the number of rounds grows with the logarithm of a chain's length."""
    e = links.select("a", "b")
    both = saved(e.union(e.select("b", "a")).distinct())
    label = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root"))
    label = saved(label)
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        step = label.join(near, "node").select("node", F.least("root", "m").alias("root"))
        jump = step.join(step.select(F.col("node").alias("root"), F.col("root").alias("up")), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        new = saved(jump)
        if new.join(label.select("node", F.col("root").alias("old")), "node").where("root <> old").isEmpty():
            return new
        label = new


def near_duplicate_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and class_id of every document."""
    own = docs.select(key, F.xxhash64(text, F.md5(text)).alias("_h"))
    first = own.groupBy("_h").agg(F.min(key).alias("_first"))
    found = classes(near_duplicate_links(docs, key, text))
    named = first.join(found, first["_first"] == found["node"], "left").select("_h", F.coalesce("root", "_first").alias("class_id"))
    return own.join(named, "_h").select(key, "class_id")


def keep_first(classed: DataFrame, key: str = "doc_id") -> DataFrame:
    """One document of each class: the class id is its smallest key."""
    return classed.where(F.col(key) == F.col("class_id"))


def removed_rate(classed: DataFrame, by: list[str], key: str = "doc_id") -> DataFrame:
    return classed.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col(key) != F.col("class_id")).cast("double")).alias("removed_fraction"))


def minus(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without a match by the keys (null keys match nothing)."""
    return df.join(other.select(*keys).distinct(), keys, "left_anti")


def fill_title(df: DataFrame, title: str = "title", group: str = "lccn", order: str = "scan_id") -> DataFrame:
    """Empty titles from the first titled scan of the same group; joined from an aggregate, so a large group isn't
    sorted in one task."""
    known = df.where(F.coalesce(F.col(title), F.lit("")) != "").groupBy(group).agg(F.min_by(title, order).alias("_t"))
    return df.join(known, group, "left").withColumn(title, F.coalesce(F.nullif(F.coalesce(F.col(title), F.lit("")), F.lit("")), "_t", F.lit(""))).drop("_t")


def screen(docs: DataFrame, terms: list[str], text: str = "text") -> Column:
    """True where a text holds one of the terms as whole words, in any case; the list is part of the study's design,
    tens of terms, so it is one alternation in the scan's own stage."""
    from re import escape

    any_ = "|".join(escape(t).replace(r"\ ", " ") for t in sorted(terms, key=len, reverse=True))
    return F.coalesce(F.col(text), F.lit("")).rlike(rf"(?i)\b(?:{any_})\b")

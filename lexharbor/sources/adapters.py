"""Source adapters: raw rows to the article contract with a reason for every dropped row.

An adapter is a lazy DataFrame function.  Its result holds all rows; `drop_reason` is NULL for kept ones, and the first
failed check names it.  `keep` and `drop_counts` read off both halves of one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import language, text as T
from .schema import project

CUTOFF, GERMAN_LAST, BOOK_YEARS, PAGE_WINDOW = "1939-06-30", "1955-12-31", (1900, 1938), ("1930-01-01", "1939-06-30")


def reason(*checks: tuple[str, Column]) -> Column:
    """The first failing check's name, else NULL."""
    out = F.lit(None).cast("string")
    for name, failed in reversed(checks):
        out = F.when(F.coalesce(failed, F.lit(True)), F.lit(name)).otherwise(out)
    return out


def _finish(df: DataFrame, source: str, date: Column, checks, **columns: Column) -> DataFrame:
    df = df.withColumn("_text", T.strip(F.coalesce(columns.pop("text"), F.lit("")))).withColumn("_date", date)
    df = df.withColumn("drop_reason", reason(*checks(F.col("_date"), F.col("_text"))))
    return df.select(
        "drop_reason", F.lit(source).alias("source"), F.year("_date").cast("short").alias("year"), F.date_format("_date", "yyyy-MM-dd").alias("date"), F.col("_text").alias("text"),
        T.byte_length(F.col("_text")).cast("int").alias("n_bytes"), T.word_count(F.col("_text")).cast("int").alias("n_words"), *[c.alias(n) for n, c in columns.items()],
    )


def _empty(d, t):
    return ("dropped_empty", t == "")


def _dated(last: str, name: str):
    return lambda d, t: [("dropped_bad_date", d.isNull()), (name, d > F.lit(last).cast("date")), _empty(d, t)]


def _or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _id(prefix: str, *parts: Column) -> Column:
    return F.concat_ws("_", F.lit(prefix), *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])


def congressional_record(df: DataFrame, cutoff: str = CUTOFF) -> DataFrame:
    chamber = F.when(F.col("chamber") == "S", "Senate").when(F.col("chamber") == "H", "House").otherwise(_or_empty("chamber"))
    meta = T.meta_json(*[F.col(c) for c in ("chamber", "congress", "party", "source", "speaker", "speech_id", "state")])
    return _finish(df, "congressional_record", T.parse_date(F.col("date").cast("string"), "yyyyMMdd"), _dated(cutoff, "dropped_after_cutoff"), article_id=_id("cr", F.col("speech_id")), newspaper=F.format_string("Congressional Record (%s)", chamber), state=_or_empty("state"), byline=_or_empty("speaker"), text=F.col("speech_text"), meta=meta)


def hmd_newspapers(df: DataFrame, cutoff: str = CUTOFF, key: Column | None = None, ordinal: Column | None = None) -> DataFrame:
    """The id holds the file and the row's place in it, which a Parquet scan gives as metadata."""
    key = F.regexp_replace(F.col("_metadata.file_name"), r"\.parquet$", "") if key is None else key
    ordinal = F.col("_metadata.row_index") if ordinal is None else ordinal
    meta = T.meta_json(*[F.col(c) for c in ("item_type", "location", "ocr_quality_mean", "ocr_quality_sd")])
    return _finish(df, "hmd_newspapers", F.col("date").cast("date"), _dated(cutoff, "dropped_after_cutoff"), article_id=_id("hmd", key, ordinal), newspaper=_or_empty("title"), state=_or_empty("location"), byline=F.lit(""), text=F.col("text"), meta=meta)


def _german(name: str) -> Column:
    return T.parse_date(F.substring(F.col(name).cast("string"), 1, 10))


def ddb_newspapers_de(df: DataFrame, cutoff: str = CUTOFF) -> DataFrame:
    meta = T.meta_json(*[F.col(c) for c in ("issue_id", "language", "license", "page", "provider", "zdb_id")])
    return _finish(df, "ddb_newspapers_de", _german("date"), _dated(GERMAN_LAST, "dropped_after_1955"), article_id=_id("ddb", F.col("issue_id"), F.col("page")), newspaper=_or_empty("paper"), state=F.lit(""), byline=F.lit(""), text=F.col("text"), meta=meta)


def europeana_newspapers_de(df: DataFrame, cutoff: str = CUTOFF) -> DataFrame:
    meta = T.meta_json(*[F.col(c) for c in ("id", "issue_uri", "language", "mean_ocr", "multi_language", "std_ocr")])
    return _finish(df, "europeana_newspapers_de", _german("date"), _dated(GERMAN_LAST, "dropped_after_1955"), article_id=_id("eu", F.col("id")), newspaper=_or_empty("title"), state=F.lit(""), byline=F.lit(""), text=F.col("text"), meta=meta)


def voelkischer_beobachter_de(df: DataFrame, dates: DataFrame, cutoff: str = CUTOFF) -> DataFrame:
    """Dates come from a lookup table (key, date), never from the key; it is left-joined and Spark picks the strategy."""
    return _finish(df.join(dates.select("key", F.col("date").alias("_found")), "key", "left"), "voelkischer_beobachter_de", _german("_found"), _dated(GERMAN_LAST, "dropped_after_1955"), article_id=_id("vb", F.col("key")), newspaper=F.lit("Völkischer Beobachter"), state=F.lit(""), byline=F.lit(""), text=F.col("text"), meta=T.meta_json(F.col("key")))


def _books(year: Column, bad=()):
    lo, hi = BOOK_YEARS
    return lambda d, t: [*bad, (f"dropped_year_outside_{lo}_{hi}", ~year.between(lo, hi)), _empty(d, t)]


def loc_pd_books(df: DataFrame, cutoff: str = CUTOFF) -> DataFrame:
    meta = T.meta_json(F.lit("year").alias("date_precision"), F.col("filename"), F.col("lccn"), F.col("page_count"))
    y = F.col("year").cast("int")
    return _finish(df, "loc_pd_books", F.make_date(F.when(y.between(1, 9999), y), F.lit(1), F.lit(1)), _books(y), article_id=_id("loc", F.col("lccn"), F.col("filename")), newspaper=_or_empty("title"), state=F.lit(""), byline=_or_empty("author"), text=F.col("text"), meta=meta)


def pre_1929_books(df: DataFrame, cutoff: str = CUTOFF) -> DataFrame:
    """`metadata` is a dictionary in Python's notation; one that can't be read counts as empty."""
    df = df.withColumn("_m", T.literal_fields(F.col("metadata"), ("year", "title", "author", "htid", "language", "place")))
    y = T.safe_year(F.col("_m.year"))
    meta = T.meta_json(F.lit("year").alias("date_precision"), *[F.col(f"_m.{n}").alias(n) for n in ("htid", "language", "place")])
    return _finish(df, "pre_1929_books", F.make_date(F.when(y.between(1, 9999), y), F.lit(1), F.lit(1)), _books(y, [("dropped_bad_date", y.isNull())]), article_id=_id("p1929", F.col("id")), newspaper=F.coalesce("_m.title", F.lit("")), state=F.lit(""), byline=F.coalesce("_m.author", F.lit("")), text=F.col("text"), meta=meta)


def chronicling_america(df: DataFrame, cutoff: str = CUTOFF) -> DataFrame:
    """Pages (path, content [, batch]); members that are no page text are left out before anything is counted."""
    batch = F.col("batch") if "batch" in df.columns else F.lit("")
    df = df.where(F.col("path").endswith("ocr.txt")).withColumn("_p", T.page_path(F.col("path")))
    p = lambda n: F.col(f"_p.{n}")
    date = T.parse_date(F.concat_ws("-", p("year"), p("month"), p("day")))
    lo, hi = (F.lit(x).cast("date") for x in PAGE_WINDOW)
    checks = lambda d, t: [("skipped_unparsed_name", F.col("_p").isNull()), ("dropped_bad_date", d.isNull()), ("outside_window", ~d.between(lo, hi)), _empty(d, t)]
    meta = T.meta_json(batch.alias("batch"), p("edition").alias("edition"), p("lccn").alias("lccn"), p("seq").alias("seq"))
    day = F.concat_ws("-", p("year"), p("month"), p("day"))
    article = F.concat(F.lit("ca_"), p("lccn"), F.lit("_"), day, F.lit("_ed"), p("edition"), F.lit("_seq"), p("seq"))
    return _finish(df, "chronicling_america", date, checks, article_id=article, newspaper=p("lccn"), lccn=p("lccn"), page=F.concat(F.lit("p"), p("seq")), edition=p("edition"), state=F.lit(""), byline=F.lit(""), text=F.col("content"), meta=meta)


def federal_register(df: DataFrame, cutoff: str = CUTOFF) -> DataFrame:
    """Issues (key, text, n_pages) whose key is FR- and a date; the text layer is made by operators.pages.ordered_text."""
    date = T.parse_date(F.substring("key", 4, 100))
    meta = T.meta_json(F.lit("legal/regulatory").alias("genre"), F.col("key").alias("issue"), F.col("n_pages").alias("pages"))
    return _finish(df, "federal_register", date, _dated(cutoff, "dropped_after_cutoff"), article_id=_id("fr", F.col("key")), newspaper=F.lit("Federal Register"), state=F.lit(""), byline=F.lit(""), text=F.col("text"), meta=meta)


def american_stories(df: DataFrame, cutoff: str = CUTOFF) -> DataFrame:
    """Scans (member, year, lccn struct, `full articles` array): one row per article; the scan's date must fall in the
    archive's year; the title block's number falls back to the one in the name."""
    n = T.scan_name(F.col("member"))
    df = df.withColumn("_n", n).withColumn("a", F.explode_outer("full articles"))
    valid = T.valid_date(F.col("_n.date"), F.col("year"))
    checks = lambda d, t: [("bad_scan_name", F.col("_n").isNull()), ("bad_date", ~valid), ("no_articles", F.col("a").isNull()), ("empty_text", t == "")]
    scan = F.regexp_replace(T.basename(F.col("member")), r"\.json$", "")
    some = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    lccn = F.coalesce(F.nullif(some(F.col("lccn.lccn")), F.lit("")), F.col("_n.lccn"))
    languages = F.array_join(F.coalesce(F.col("lccn.language"), F.array().cast("array<string>")), ";")
    return _finish(df, "american_stories", T.parse_date(F.col("_n.date")), checks, article_id=F.concat_ws("_", some(F.col("a.full_article_id")), scan), newspaper=some(F.col("lccn.title")), lccn=lccn, state=some(F.col("lccn.state")), page=F.col("_n.page"), edition=F.col("_n.edition"), headline=some(F.col("a.headline")), byline=some(F.col("a.byline")), text=F.col("a.article"), lccn_language=languages)


ADAPTERS: dict[str, Callable[..., DataFrame]] = {f.__name__: f for f in (congressional_record, hmd_newspapers, ddb_newspapers_de, europeana_newspapers_de, voelkischer_beobachter_de, loc_pd_books, pre_1929_books, chronicling_america, federal_register, american_stories)}


def keep(rows: DataFrame, with_language: bool = True) -> DataFrame:
    """The kept rows under the contract, with the language vote."""
    kept = rows.where(F.col("drop_reason").isNull()).drop("drop_reason")
    if with_language:
        kept = language.guess(kept, kept.columns).withColumnRenamed("en_share", "lang_en_share")
    return project(kept)


def drop_counts(rows: DataFrame) -> DataFrame:
    """Rows by source and reason with totals, '' for kept rows."""
    return rows.rollup("source", F.coalesce("drop_reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n"))


def language_root(lang: Column) -> Column:
    """Output folder by the source's language: English at the top, others below one folder."""
    return F.when(lang == "en", F.lit("ingested")).otherwise(F.concat(F.lit("ingested_foreign/"), lang))

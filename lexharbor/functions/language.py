"""Language by votes of function words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

# The function-word lists; their order breaks ties.
STOPWORDS = {
    "en": "the of and to in a is that for it was on with as by at he his be from this have had not are but which or were they",
    "es": "el la de que y en los del se las por un una con para es su al lo como mas pero sus le ya o",
    "de": "der die und in den von zu das mit sich des auf fur ist im dem nicht ein eine als auch es an werden aus er hat",
    "fr": "le la les de des et en un une du est que pour dans qui au par sur pas plus ne se ce sont avec",
    "it": "il di che e la per un in del della non una sono le si al da con gli nel alla",
    "cs": "a v se na je to ze s z do jako pro by jsou ale od za po tak jeho jak",
    "pl": "i w nie na sie z do to jest ze jak co ale za od po tak przez jego",
    "nl": "de het een van en in is dat op te zijn met voor niet aan er",
    "sv": "och att det som en pa ar av for med till den har de inte om ett",
    "no_da": "og i at det som en pa er af for med til den har de ikke om et",
}
MIN_VOTES, MIN_SHARE, MIN_TITLE_SHARE = 5, 0.3, 0.5


def guess(df: DataFrame, keys: list[str], text: str = "text", most: int = 400) -> DataFrame:
    """keys, lang and en_share (float, NaN if undecidable) of every row.  The first words are cut to function words with
    their places by one set lookup each, and each language counts its own among those: all in the row, so there is no
    join and no shuffle."""
    words = T.vote_words(F.coalesce(F.col(text), F.lit("")), most)
    lists = {lang: listed.split() for lang, listed in STOPWORDS.items()}
    every = sorted({w for listed in lists.values() for w in listed})
    found = T.once(df, keys, F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(every)).alias("_hits"))
    among = lambda listed: F.filter("_hits", lambda x: x["w"].isin(listed))
    own = found.select(*keys, *[among(listed).alias(f"_{lang}") for lang, listed in lists.items()])
    first = lambda lang: F.get(f"_{lang}", F.lit(0))["i"]
    votes = F.array(*[F.struct((-F.size(f"_{lang}")).alias("v"), first(lang).alias("p"), F.lit(i).alias("i"), F.lit(lang).alias("lang")) for i, lang in enumerate(lists)])
    total = sum((F.size(f"_{lang}") for lang in list(lists)[1:]), F.size("_en"))
    out = own.select(*keys, F.array_min(votes)["lang"].alias("_best"), total.alias("_total"), F.size("_en").alias("_votes"))
    known = F.col("_total") >= MIN_VOTES
    share = F.when(known, F.col("_votes") / F.when(known, F.col("_total"))).otherwise(F.lit(float("nan"))).cast("float")
    return T.once(out, keys, F.when(known, F.col("_best")).otherwise("und").alias("lang"), share.alias("en_share"))


def is_native_english(lang: Column, share: Column, least: float = MIN_SHARE) -> Column:
    """NaN sorts above every number in Spark, so it is ruled out first."""
    return F.coalesce((lang == "en") & ~F.isnan(share) & (share >= least), F.lit(False))


def english_titles(articles: DataFrame, keys: tuple[str, ...] = ("lccn", "year"), lang: str = "lang", least: float = MIN_TITLE_SHARE) -> DataFrame:
    """The title-years with an English share of at least `least`, undecided articles counted."""
    return articles.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((F.col(lang) == "en").cast("double")).alias("en_fraction")).where(F.col("en_fraction") >= least)


def keep_english_titles(articles: DataFrame, keys: tuple[str, ...] = ("lccn", "year"), lang: str = "lang") -> DataFrame:
    return articles.join(english_titles(articles, keys, lang), list(keys), "left_semi")

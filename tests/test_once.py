"""What a row is asked once is computed once, and words aren't shuffled by document."""

import re

import __spark_entry__ as entry
from pyspark.sql import functions as F

from lexharbor.functions import text as T
from lexharbor.operators import ocr


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def physical(df):
    return df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def test_native_english_cuts_words_once(spark, sf):
    assert plan(entry.queries()["native_english"](spark, sf)).count("regexp_extract_all") == 1


def test_word_like_is_computed_once(spark, sf):
    assert plan(entry.queries()["ocr_filter"](spark, sf)).count("(?:^| )") == 1


WORDS = ["plain", "don't", "«quoted»", "a-b-c", "a--b", "x1", "--", "’t", "t’", "1939", "naïve,", "(well-known)", "a'", "'", "a-", "-a-b-", "é", "a" * 300, "a-" * 3000 + "a", "a-" * 3000 + "1"]


def test_word_like_share_of_odd_words(spark):
    gaps = [" ", "\n", "\t ", " ", "  ", "\x1c", " \r\n"]
    texts = [*WORDS, *(f"{g}".join(WORDS) for g in gaps), " ".join(WORDS) + "\n", "", "  ", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(T.word_like_share(F.col("t"))).collect()]
    mark = r"""[!"#%&'()*,\-./:;?@\[\\\]_{}«»’]"""
    for t, share in zip(texts, got):
        ws = (t or "").split()
        like = [w for w in ws if re.fullmatch(rf"{mark}*[^\W\d_]+(?:['’-][^\W\d_]+)*{mark}*", w)]
        assert share == len(like) / len(ws) if ws else share != share


def test_scores_by_both_ways(spark):
    texts = {1: "the cat the CAT ſat 12 x", 2: "", 3: None, 4: "dog" * 3 + " the", 5: " ".join(["the", "Ab", "zz"] * 20), 6: "½ İ ß"}
    docs = spark.createDataFrame([(k, "s", t) for k, t in texts.items()], "doc_id long, source string, text string")
    lex = spark.createDataFrame([("the",), ("sat",), ("ab",)], "word string")
    want = {}
    for k, t in texts.items():
        w = [x for x in (y.lower().replace("ſ", "s") for y in re.findall(r"[^\W\d_½]+|½", t or "")) if len(x) >= 2]
        want[k] = (len(w), sum(x in ("the", "sat", "ab") for x in w))
    few, many = ocr.scores(docs, lex, ["doc_id", "source"]), ocr.scores(docs, lex, ["doc_id", "source"], sent=0)
    for out in (few, many):
        assert {r.doc_id: (r.n_tokens, r.n_hits) for r in out.collect()} == want
        assert all((r.score != r.score) == (r.n_tokens < 20) for r in out.collect())
    exchanges = [line for line in physical(few).split("\n") if "Exchange hashpartitioning" in line]
    assert exchanges and not [line for line in exchanges if "word#" in line]
    exchanges = [line for line in physical(many).split("\n") if "Exchange hashpartitioning" in line]
    assert not [line for line in exchanges if "doc_id#" in line and "word#" in line]


def test_minhash_cuts_shingles_once(spark, sf):
    assert not re.search(r"lambdafunction\([^\n]*array_distinct", plan(entry.queries()["minhash"](spark, sf)))


def test_near_duplicate_signatures_are_aggregates(spark):
    from lexharbor.operators import dedup

    d = spark.createDataFrame([(1, [5, -7, 9]), (2, []), (3, [5]), (4, None)], "k long, s array<long>")
    got = {r.k: r.m for r in dedup.minima(d, ["k"], "s", 6).collect()}
    assert got == {r.k: r.m for r in d.where(F.size("s") > 0).select("k", dedup.signature(F.col("s"), 6).alias("m")).collect()}
    assert "array_min" not in plan(dedup.minima(d, ["k"], "s", 6))

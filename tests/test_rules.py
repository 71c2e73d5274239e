"""Rules by hand-made rows: adapters, languages, parsing, OCR, planning."""

import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lexharbor.functions import language, text as T
from lexharbor.operators import dedup, inventory, ocr, planning, splits
from lexharbor.operators.prefix import running_sum
from lexharbor.sources import adapters, archives, manifests


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_congressional_dates(spark):
    schema = "speech_id long, date string, chamber string, speaker string, state string, congress long, party string, source string, speech_text string"
    data = [(1, "19390630", "S", "", "", 76, "", "", "kept on the day"), (2, "19390701", "H", "", "", 76, "", "", "late"), (3, "1939xx01", "S", "", "", 76, "", "", " "), (4, "19380105", "H", "", "", 76, "", "", " kept "), (5, "19380105", "H", "", "", 76, "", "", " \x1c"), (6, None, None, None, None, None, None, None, None)]
    out = adapters.congressional_record(spark.createDataFrame(data, schema))
    assert rows(out, "article_id", "drop_reason") == [("cr_1", None), ("cr_2", "dropped_after_cutoff"), ("cr_3", "dropped_bad_date"), ("cr_4", None), ("cr_5", "dropped_empty"), ("cr_6", "dropped_bad_date")]
    kept = adapters.keep(out).orderBy("article_id").collect()
    assert [(r.date, r.newspaper, r.lccn, r.lang) for r in kept] == [("1939-06-30", "Congressional Record (Senate)", "", "und"), ("1938-01-05", "Congressional Record (House)", "", "und")]
    assert {(r.source, r.reason): r.n for r in adapters.drop_counts(out).collect()}[("congressional_record", None)] == 6


def test_german_and_books(spark):
    d = spark.createDataFrame([("A", "1938-05-01", 1), ("B", "1941-01-02", 1), ("C", "1960-01-01", 1), ("D", "not-a-date", 1)], "issue_id string, date string, page long")
    d = d.select("*", *[F.lit("x").alias(c) for c in ("paper", "language", "zdb_id", "provider", "license", "text")])
    assert [r[1] for r in rows(adapters.ddb_newspapers_de(d), "article_id", "drop_reason")] == [None, None, "dropped_after_1955", "dropped_bad_date"]
    b = spark.createDataFrame([("l", "t", "a", y, 3, str(y), "text") for y in (1899, 1925, 1941)], "lccn string, title string, author string, year long, page_count long, filename string, text string")
    out = adapters.loc_pd_books(b).where("drop_reason is null").collect()
    assert [(r.date, '"date_precision":"year"' in r.meta) for r in out] == [("1925-01-01", True)]
    p = spark.createDataFrame([("1", "{'year': '1925.0', 'title': 'T'}", "x"), ("2", "{'year': 'n'}", "x"), ("3", "{'year': '1800'}", "x")], "id string, metadata string, text string")
    assert [r[1] for r in rows(adapters.pre_1929_books(p), "article_id", "drop_reason")] == [None, "dropped_bad_date", "dropped_year_outside_1900_1938"]


def test_pages_in_archives(spark, tmp_path):
    import io
    import tarfile

    with tarfile.open(tmp_path / "b.tar.bz2", "w:bz2") as t:
        for name in ("x/data/sn86069021/1931/05/14/ed-1/seq-3/ocr.txt", "x/data/sn86069021/1941/05/14/ed-1/seq-1/ocr.txt", "x/data/sn86069021/1931/05/14/ed-1/seq-3/ocr.xml"):
            i = tarfile.TarInfo(name)
            i.size = 9
            t.addfile(i, io.BytesIO(b"some text"))
    out = adapters.chronicling_america(archives.members(spark, str(tmp_path / "*.bz2")))
    assert rows(out, "article_id", "page", "drop_reason") == [("ca_sn86069021_1931-05-14_ed1_seq3", "p3", None), ("ca_sn86069021_1941-05-14_ed1_seq1", "p1", "outside_window")]


def test_scans(spark):
    m = spark.createDataFrame([("f/1923-03-08_p1_sn92067236_00514150266_1923030801_0256.json", '{"lccn":{"title":"T","lccn":"","state":"NY","language":["eng","spa"]},"full articles":[{"article":"a b","full_article_id":"7"},{"article":" "}]}'), ("f/README.txt", "")], "path string, content string")
    out = adapters.american_stories(archives.scans(m, 1923)).orderBy("drop_reason")
    r = out.collect()
    assert (r[0].lccn, r[0].edition, r[0].lccn_language, r[0].date, r[0].n_words) == ("sn92067236", "01", "eng;spa", "1923-03-08", 2)
    assert r[1].drop_reason == "empty_text"


def test_language(spark):
    d = spark.createDataFrame([(1, "the of and to in a is that"), (2, "el la de que y en los del"), (3, "the of and was"), (4, ""), (5, None), (6, "de"), (7, "foo " * 400 + "the of and to in a is that")], "i int, text string")
    out = {r.i: (r.lang, r.en_share) for r in language.guess(d, ["i"]).collect()}
    assert out[1][0] == "en" and out[2][0] == "es" and out[3][0] == "und" and math.isnan(out[4][1]) and out[5][0] == "und" and out[7][0] == "und"
    assert out[6][0] == "es"  # one word in five lists casts five votes; the first list wins the tie
    s = spark.createDataFrame([("en", 0.6), ("en", 0.3), ("en", 0.2), ("es", 0.0), ("en", float("nan")), ("en", None)], "l string, s float")
    assert [r[0] for r in s.select(language.is_native_english(F.col("l"), F.col("s"))).collect()] == [True, True, False, False, False, False]
    t = spark.createDataFrame([("EN", 1923, "en")] * 9 + [("EN", 1923, "cs")] + [("ES", 1923, "es")] * 9 + [("ES", 1923, "en")], "lccn string, year int, lang string")
    assert rows(language.english_titles(t), "lccn") == [("EN",)]


def test_text(spark):
    d = spark.createDataFrame([("Die Uebereinſtimmung, 1938 a Thür-Schloß!",)], "t string")
    assert d.select(T.tokens(F.col("t"))).first()[0] == ["die", "uebereinstimmung", "thür", "schloß"]
    x = spark.createDataFrame([('<date type="publication"> 1873</date><text><fw>Kopf</fw> Die Ver-<lb/>fassung des Lan&amp;des',)], "x string")
    r = x.select(T.tei_year(F.col("x")), T.tokens(T.unescape(T.tei_body(F.col("x"))))).first()
    assert (r[0], r[1]) == (1873, ["die", "verfassung", "des", "lan", "des"])
    assert [r.year for r in inventory.year_list(spark, "1939, 1939,1938").orderBy("pos").collect()] == [1939, 1938]


def test_ocr(spark):
    d = spark.createDataFrame([(1, "die stadt xqzv stadt " * 10), (2, "die stadt"), (3, None)], "i int, text string")
    s = {r.i: r.score for r in ocr.scores(d, spark.createDataFrame([("die",), ("stadt",)], "word string"), ["i"]).collect()}
    assert s[1] == 0.75 and math.isnan(s[2]) and math.isnan(s[3])
    q = spark.createDataFrame([("s", i / 30) for i in range(30)], "k string, score double")
    assert ocr.quantiles(q, ["k"]).first().p10 == 3 / 30
    p = spark.createDataFrame([(f"t{i % 4}", "wald") for i in range(50)] + [(f"t{i % 9}", "haus") for i in range(49)] + [(f"t{i % 5}", "baum") for i in range(50)], "newspaper string, text string")
    assert rows(ocr.pool_words(p), "word", "df", "titles") == [("baum", 50, 5)]


def test_planning(spark, tmp_path):
    b = spark.createDataFrame([(1, 600.0, 40.0, 100.0, 300.0, "LEFT ONE"), (1, 600.0, 40.0, 400.0, 300.0, "LEFT TWO"), (1, 600.0, 340.0, 50.0, 580.0, "RIGHT ONE")], "page int, page_width double, x0 double, y0 double, x1 double, text string")
    assert planning.ordered_text(b).first().text == "LEFT ONE\nLEFT TWO\nRIGHT ONE"
    (tmp_path / "t.tsv").write_text("# c\nyear\turl\tbytes\tchecksum\n1\thttp://x/a.zip\t5\tmd5:aa\n")
    assert tuple(manifests.file_table(spark, str(tmp_path / "t.tsv")).first()) == ("1", "a.zip", 5, "md5:aa")
    m = str(tmp_path / "M.json")
    manifests.record(m, "s", "r", {"k1": {"file": "a", "bytes": 1, "sha256": "x"}})
    manifests.record(m, "s", "r", {"k2": {"file": "b", "bytes": 2, "sha256": "y"}})
    assert rows(manifests.manifest(spark, m, "r"), "key") == [("k1",), ("k2",)]
    with pytest.raises(ValueError):
        manifests.manifest(spark, m, "other")


def test_running_sum_is_exact(spark):
    d = spark.range(500).select((F.col("id") * 37 % 91).alias("o"), F.col("id"), (F.col("id") % 7).alias("v"))
    out = running_sum(d, "o", "v", "b", ("id",), buckets=16).collect()
    want, total = {}, 0
    for r in sorted(out, key=lambda r: (r.o, r.id)):
        want[r.id] = total
        total += r.v
    assert {r.id: r.b for r in out} == want


def test_split_and_merges(spark):
    d = spark.createDataFrame([("d_1", x) for x in ("1939-06-30", "1939-07-01", "1939-08-31", "1939-09-01")], "k string, date string")
    assert [r[0] for r in d.select(splits.split(F.col("date"), F.col("k"))).collect()][1:] == ["embargo", "embargo", "test"]
    assert splits.learn_merges(spark.createDataFrame([("aab aab aab abab",)], "text string"), 2) == [("a", "b"), ("a", "ab")]


def test_near_duplicates_by_hand(spark):
    w = [f"w{i}" for i in range(60)]
    d = spark.createDataFrame([Row(doc_id=3, text=" ".join(w)), Row(doc_id=1, text=" ".join(w)), Row(doc_id=2, text=" ".join([*w[:-1], "x"])), Row(doc_id=4, text="other words here"), Row(doc_id=5, text="")])
    assert rows(dedup.near_duplicate_classes(d), "doc_id", "class_id") == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)]


def test_follow_takes_each_file_once(spark, tmp_path):
    from lexharbor.streaming import ingest

    schema = "speech_id long, date string, chamber string, speaker string, state string, congress long, party string, source string, speech_text string"
    put = lambda i: spark.createDataFrame([(i, "19380105", "H", "", "", 76, "", "", "kept")], schema).write.mode("append").parquet(str(tmp_path / "raw"))
    run = lambda: ingest.follow(spark, str(tmp_path / "raw"), schema, adapters.congressional_record, str(tmp_path / "out"), str(tmp_path / "n"), str(tmp_path / "ck")).awaitTermination()
    put(1), run(), run(), put(2), run()
    assert rows(spark.read.parquet(str(tmp_path / "out")), "article_id") == [("cr_1",), ("cr_2",)]

"""Sources by hand-made files and rows: archives, registries, lexicons, and the adapters."""

import gzip
import hashlib
import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from lexharbor.functions import text as T
from lexharbor.operators import dedup, evalstats, ocr, splits
from lexharbor.operators.prefix import running_sum
from lexharbor.sources import adapters, archives, manifests


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_archives_whole_and_streamed(spark, tmp_path):
    files = {"a/x.txt": "eins".encode(), "a/y.xml": b"<x/>", "b.txt": b"\xff bad", "empty.txt": b""}
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        for n, raw in files.items():
            z.writestr(n, raw)
    for name, mode in (("t.tar", "w"), ("t.tar.gz", "w:gz"), ("t.tar.bz2", "w:bz2")):
        with tarfile.open(tmp_path / name, mode) as t:
            for n, raw in files.items():
                i = tarfile.TarInfo(n)
                i.size = len(raw)
                t.addfile(i, io.BytesIO(raw))
    want = [("a/x.txt", "eins"), ("b.txt", "� bad"), ("empty.txt", "")]
    for name, kind in (("z.zip", "zip"), ("t.tar", "tar"), ("t.tar.gz", "tar"), ("t.tar.bz2", "tar")):
        for whole in (archives.WHOLE, 0):  # read by Spark, or streamed as one over the size would be
            got = archives.members(spark, str(tmp_path / name), kind, ".txt", batch_bytes=1, whole=whole)
            assert rows(got, "path", "content") == want and got.first().archive.endswith(name)


def test_text_and_json_lines(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "VB-1931.txt").write_text("zwei\nZeilen")
    assert rows(archives.text_files(spark, str(tmp_path / "t")), "key", "text") == [("VB-1931", "zwei\nZeilen")]
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write('{"id": 1, "text": "a"}\n{"id": 2, "text": null}\n')
    assert rows(archives.json_lines(spark, str(tmp_path / "b.jsonl.gz"), "id long, text string"), "id", "text") == [(1, "a"), (2, None)]


def test_parquet_rows_have_their_places(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "p"))
    assert [r[0] for r in rows(archives.parquet_rows(spark, str(tmp_path / "p")), "_row")] == [0, 1, 2, 3, 4]


def test_yaml_registry(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "s.yaml").write_text("news:\n  revision: abc\n  approved: true\nbooks:\n  kind: url\n  lang: de\n")
    assert manifests.registry(manifests.read_yaml(str(tmp_path / "s.yaml"))) == [("news", "hub", "abc", None, "en", True, None), ("books", "url", None, None, "de", False, None)]


def test_census_of_xml(spark):
    one = "<year>1921</year><languages>eng fre</languages><languages>ger</languages><list-item>a <b>b</b></list-item>x<list-item>c</list-item>"
    data = [("j/1.xml", one), ("j/2.xml", "<languages>en de</languages><list-item>t</list-item>"), ("j/3.xml", "<languages>ger</languages>"), ("j/4.xml", "<list-item>\nn\n</list-item>"), ("j/5.txt", one)]
    out = archives.journal_pages(spark.createDataFrame(data, "path string, content string"))
    assert rows(out, "path", "year", "lang", "text") == [("j/1.xml", 1921, "en", "a  b  c"), ("j/2.xml", None, "en", "t"), ("j/3.xml", None, "other", ""), ("j/4.xml", None, "en", "\nn\n")]
    tei = [("d/goethe_werther_1774.TEI-P5.xml", "<head>h</head><text>ein <p>Wort</p></text>"), ("d/x_18501.TEI.xml", "ohne"), ("d/x.TEI.xml", "")]
    out = archives.tei_files(spark.createDataFrame(tei, "path string, content string"))
    assert rows(out, "path", "year", "text") == [("d/goethe_werther_1774.TEI-P5.xml", 1774, ">ein  Wort  "), ("d/x.TEI.xml", 9999, ""), ("d/x_18501.TEI.xml", 1850, "ohne")]


def test_books_before_1929(spark):
    data = [
        ("1", "{'year': '1923', 'title': 'A', 'author': None, 'htid': 'h.1', 'language': 'eng', 'place': None}", "t"),
        ("2", """{"year": 1901.0, 'title': "It's \\"so\\"", 'author': 'O\\'Neil', 'extra': [1, {'x': None}]}""", "t"),
        ("3", "{'year': None, 'title': 'None'}", "t"),
        ("4", "{'year': '1950'}", "t"),
        ("5", "{'year': '1910'}", " "),
        ("6", None, "t"),
        ("7", "not a dictionary", "t"),
        ("8", "[1]", "t"),
    ]
    out = adapters.pre_1929_books(spark.createDataFrame(data, "id string, metadata string, text string"))
    got = {r.article_id: r for r in out.collect()}
    assert [got[f"p1929_{i}"].drop_reason for i in range(1, 9)] == [None, None, "dropped_bad_date", "dropped_year_outside_1900_1938", "dropped_empty", "dropped_bad_date", "dropped_bad_date", "dropped_bad_date"]
    a, b = got["p1929_1"], got["p1929_2"]
    assert (a.newspaper, a.byline, json.loads(a.meta)) == ("A", "", {"date_precision": "year", "htid": "h.1", "language": "eng", "place": None})
    assert (b.newspaper, b.byline, b.date) == ('It\'s "so"', "O'Neil", "1901-01-01")


def test_other_adapters(spark):
    h = spark.createDataFrame([("1890-05-01", "T", "London", 0.9, 0.1, "Article", " text "), ("1939-07-01", None, None, None, None, None, "x"), (None, None, None, None, None, None, "x"), ("1890-05-01", "T", "", 0.9, 0.1, "A", "  ")], "date string, title string, location string, ocr_quality_mean double, ocr_quality_sd double, item_type string, text string")
    out = adapters.hmd_newspapers(h, key=F.lit("part-0"), ordinal=F.monotonically_increasing_id())
    assert sorted((r.drop_reason or "", r.newspaper, r.state, r.text) for r in out.collect()) == [("", "T", "London", "text"), ("dropped_after_cutoff", "", "", "x"), ("dropped_bad_date", "", "", "x"), ("dropped_empty", "T", "", "")]
    e = spark.createDataFrame([("1", "1936-02-30"), ("2", "1936-02-28T00:00"), ("3", "1956-01-01")], "id string, date string").select("*", *[F.lit("x").alias(c) for c in ("issue_uri", "language", "mean_ocr", "multi_language", "std_ocr", "title", "text")])
    assert rows(adapters.europeana_newspapers_de(e), "article_id", "drop_reason") == [("eu_1", "dropped_bad_date"), ("eu_2", None), ("eu_3", "dropped_after_1955")]
    v = spark.createDataFrame([("VB_1", "text"), ("VB_2", "text"), ("VB_3", "")], "key string, text string")
    d = spark.createDataFrame([("VB_1", "1933-01-31"), ("VB_3", "1933-02-01")], "key string, date string")
    assert rows(adapters.voelkischer_beobachter_de(v, d), "article_id", "date", "drop_reason") == [("vb_VB_1", "1933-01-31", None), ("vb_VB_2", None, "dropped_bad_date"), ("vb_VB_3", "1933-02-01", "dropped_empty")]
    f = spark.createDataFrame([("FR-1936-03-14", "rule", 8), ("FR-1939-07-01", "late", 1), ("FR-x", "?", 1)], "key string, text string, n_pages long")
    assert rows(adapters.federal_register(f), "article_id", "drop_reason") == [("fr_FR-1936-03-14", None), ("fr_FR-1939-07-01", "dropped_after_cutoff"), ("fr_FR-x", "dropped_bad_date")]
    assert adapters.keep(adapters.federal_register(f)).select("lang").first().lang == "und"


def test_lexicon_address_and_load(spark, tmp_path):
    words = spark.createDataFrame([("zwei",), ("Öl",), ("eins",), ("zwei",), (None,)], "word string").repartition(3)
    data = "".join(f"{w}\n" for w in sorted({"zwei", "Öl", "eins"})).encode()
    digest = manifests.write_lexicon(words, str(tmp_path / "lex"), built="today")
    assert digest == hashlib.sha256(data).hexdigest() and (tmp_path / "lex" / f"{digest[:12]}.txt").is_dir()
    assert rows(manifests.load_lexicon(spark, str(tmp_path / "lex")), "word") == [("eins",), ("zwei",), ("Öl",)]
    assert manifests.lexicon_digest(words.limit(0)).first().digest == hashlib.sha256(b"\n").hexdigest()


def test_merges_encode_like_one_at_a_time(spark):
    texts = ["aab aab aab abab banana bandana", "", None, "cabbage baa", "ab"]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    merges = splits.learn_merges(d, 6)

    def plain(word):
        parts = list(word)
        for a, b in merges:
            i = 0
            while i < len(parts) - 1:
                if (parts[i], parts[i + 1]) == (a, b):
                    parts[i : i + 2] = [a + b]
                i += 1
        return parts

    got = {r.i: r.pieces for r in splits.encode_merges(d, merges, ["i"]).collect()}
    assert got == {i: [p for w in (t or "").split() for p in plain(w)] for i, t in enumerate(texts)}


def test_running_sum_with_a_hot_value(spark):
    """Most rows have one value: it is cut again by the tie."""
    d = spark.range(2000).select(F.when(F.col("id") % 10 < 8, 5).otherwise(F.col("id") % 13).alias("o"), (F.col("id") * 7 % 2000).alias("t"), (F.col("id") % 7).alias("v"), (F.col("id") % 2).alias("k"))
    for down in (False, True):
        out = running_sum(d, "o", "v", "b", ("t",), ("k",), buckets=16, descending=down)
        want, total = {}, {0: 0, 1: 0}
        for r in sorted(d.collect(), key=lambda r: (-r.o if down else r.o, r.t)):
            want[r.t] = total[r.k]
            total[r.k] += r.v
        assert {r.t: r.b for r in out.collect()} == want


def test_quantiles_holdout_and_controls_by_definition(spark):
    d = spark.range(700).select(F.concat(F.lit("s"), F.col("id") % 3).alias("k"), (F.col("id") * 37 % 91 / 90).alias("score"), F.concat(F.lit("a"), "id").alias("key"))
    own = {}
    for r in d.collect():
        own.setdefault(r.k, []).append(r)
    for r in ocr.quantiles(d, ["k"]).collect():
        v = sorted(x.score for x in own[r.k])
        assert r.n == len(v) and r.p10 == v[int(0.1 * len(v))] and r.p90 == v[min(len(v) - 1, int(0.9 * len(v)))] and r.below_50 == sum(x < 0.5 for x in v) / len(v)
    kept = {r.key for r in splits.exact_holdout(d, ["k"], "key", 0.03).collect()}
    assert kept == {x.key for v in own.values() for x in sorted(v, key=lambda x: (hashlib.sha1(x.key.encode()).hexdigest(), x.key))[: -(-len(v) * 3 // 100)]}
    t = spark.createDataFrame([("t1", "f", 6), ("t2", "f", 6), ("t3", "f", 100), ("t4", "f", 1), ("t5", "g", 5)], "term string, field string, freq int")
    c = spark.createDataFrame([("c9", "f", 9), ("c4", "f", 4), ("b4", "f", 4), ("c50", "f", 50), ("c2", "f", 2)], "cand string, field string, cand_freq int")
    assert rows(evalstats.control_match(t, c), "term", "control") == [("t1", "b4"), ("t2", "b4"), ("t3", "c50"), ("t4", "c2")]


def test_similar_texts_behind_a_loose_first_one(spark):
    """Pairs of similarity over 0.8 whose buckets begin with a text that is only about 0.7 alike to both."""
    texts = []
    for k in range(30):
        w = [f"w{k}_{i}" for i in range(200)]
        loose = [f"e{k}_{i}" if i % 30 == 7 else x for i, x in enumerate(w)]
        texts += [loose, w, [*w[:100], "edit", *w[101:]]]
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    out = dict(rows(dedup.near_duplicate_classes(d), "doc_id", "class_id"))
    assert all(out[i + 1] == out[i + 2] for i in range(0, 90, 3))


def test_no_folder_of_its_own_on_a_cluster(spark, monkeypatch):
    from lexharbor.operators import saved

    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda s: type("S", (), {"getCheckpointDir": lambda s: type("O", (), {"isDefined": lambda s: False})()})()})()

    frame = type("D", (), {"sparkSession": type("P", (), {"sparkContext": Context(), "conf": type("C", (), {"get": lambda s, k, d: d})()})()})()
    with pytest.raises(RuntimeError):
        saved.saved(frame)

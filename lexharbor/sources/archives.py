"""Archive scans.  A tar or gzip stream can't be split, so one task decodes one archive and yields its members as rows in
bounded batches; everything after that is relational and can be repartitioned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip_tags, tei_file_year

MEMBERS = T.StructType([T.StructField("archive", T.StringType()), T.StructField("path", T.StringType()), T.StructField("content", T.StringType())])
#: Archives up to this size are read whole by Spark; larger ones (a value holds 2 GB at most) are opened as streams.
WHOLE = 256 << 20


def _members(kind: str, file, suffix: str):
    """(name, bytes) of an open archive's members, one at a time."""
    import tarfile
    import zipfile

    if kind == "zip":
        with zipfile.ZipFile(file) as z:
            for name in z.namelist():
                if name.endswith(suffix) and not name.endswith("/"):
                    yield name, z.read(name)
    else:
        with tarfile.open(fileobj=file, mode="r|*") as t:
            for m in t:
                if m.isfile() and m.name.endswith(suffix):
                    yield m.name, t.extractfile(m).read()


def _opened(path: str, kind: str):
    """A stream of a file of any file system that pyarrow knows; zip needs one that can seek."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return system.open_input_file(name) if kind == "zip" else system.open_input_stream(name, compression=None)


def members(spark: SparkSession, path: str, kind: str = "tar", suffix: str = "", batch_bytes: int = 8 << 20, whole: int = WHOLE) -> DataFrame:
    """(archive, path, content) of the members with the suffix in tar (plain, gz or bz2) or zip archives.  Invalid UTF-8
    becomes the replacement character.  Spark reads archives of up to `whole` bytes, so any file system it knows will do;
    larger ones are streamed by the tasks, so their size doesn't matter."""

    def run(batches):
        import pyarrow as pa

        def rows(archive: str, file):
            got, size = [], 0
            for name, raw in _members(kind, file, suffix):
                got.append((archive, name, raw.decode("utf-8", "replace")))
                size += len(raw)
                if size > batch_bytes:
                    yield batch(got)
                    got, size = [], 0
            if got:
                yield batch(got)

        batch = lambda got: pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*got)], names=MEMBERS.names)
        for b in batches:
            contents = b.column(1) if b.num_columns > 1 else [None] * b.num_rows
            for archive, content in zip(b.column(0).to_pylist(), contents):
                with pa.BufferReader(content.as_buffer()) if content is not None else _opened(archive, kind) as file:
                    yield from rows(archive, file)

    files = spark.read.format("binaryFile").load(path)
    small = files.where(F.col("length") <= whole).select("path", "content").mapInArrow(run, MEMBERS)
    large = files.where(F.col("length") > whole).select("path").mapInArrow(run, MEMBERS)
    return small.unionByName(large)


def journal_pages(archived: DataFrame) -> DataFrame:
    """(path, year, lang, text) of journal XML: the first year (NULL if none), English if no language is given or the
    first list of them has it, and the text of all list items without tags."""
    first = F.regexp_extract("content", r"(?s)<languages>(.*?)</languages>", 1)
    english = ~F.col("content").rlike(r"(?s)<languages>.*?</languages>") | first.contains("eng") | F.array_contains(F.split(F.trim(first), r"\s+"), "en")
    pages = F.array_join(F.regexp_extract_all("content", F.lit(r"(?s)<list-item>(.*?)</list-item>"), 1), " ")
    return archived.where(F.col("path").endswith(".xml")).select("path", F.regexp_extract("content", r"<year>(\d{4})", 1).try_cast("int").alias("year"), F.when(english, "en").otherwise("other").alias("lang"), strip_tags(pages).alias("text"))


def tei_files(archived: DataFrame) -> DataFrame:
    """(path, year, text) of TEI files: the year in the file's name (9999 if none), and what follows the first <text
    without tags."""
    at = F.locate("<text", F.col("content"))
    body = F.when(at > 0, F.substring("content", at + 5, F.length("content"))).otherwise(F.col("content"))
    return archived.where(F.col("path").endswith(".xml")).select("path", tei_file_year(F.col("path")).alias("year"), strip_tags(body).alias("text"))


SCAN = "lccn struct<title:string,lccn:string,state:string,language:array<string>>, `full articles` array<struct<article:string,headline:string,byline:string,full_article_id:string>>"


def scans(archived: DataFrame, year: int) -> DataFrame:
    """Members of scan archives parsed for adapters.american_stories; decoding is spread out before the parse."""
    parsed = F.from_json("content", SCAN)
    return archived.where(F.col("path").endswith(".json")).select(F.col("path").alias("member"), F.lit(year).alias("year"), parsed.alias("j")).select("member", "year", "j.lccn", "j.`full articles`")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Gzipped or plain JSON lines with a given schema, never inferred."""
    return spark.read.schema(schema).json(path)


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(key, text) of whole text files; the key is the file's name without its suffix."""
    df = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("f"), F.col("value").alias("text"))
    return df.select(F.regexp_replace("f", r"\.[^.]*$", "").alias("key"), "text")


def parquet_rows(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet scan with each row's file and place in it."""
    return spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))

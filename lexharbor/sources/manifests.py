"""File tables, manifests, registries and sinks."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import basename


def file_table(spark: SparkSession, path: str) -> DataFrame:
    """(key, file, bytes, checksum) of a tab-separated table with comment lines.  The first column may have any name; a
    `url` column gives the file by its last part; a bare digest counts as SHA-256."""
    raw = spark.read.option("sep", "\t").option("header", True).option("comment", "#").option("inferSchema", False).csv(path)
    c = raw.columns
    file = F.col("file") if "file" in c else basename(F.col("url"))
    want = F.col("checksum") if "checksum" in c else F.concat(F.lit("sha256:"), F.col("sha256")) if "sha256" in c else F.lit("-")
    return raw.select(F.col(c[0]).alias("key"), file.alias("file"), F.col("bytes").cast("long").alias("bytes"), want.alias("checksum"))


def registry(config: dict) -> list[tuple]:
    """Rows of a source registry: name, kind, revision, dest, lang, approved, role."""
    return [(n, s.get("kind", "hub"), s.get("revision"), s.get("dest"), s.get("lang", "en"), bool(s.get("approved", False)), s.get("role")) for n, s in config.items()]


def read_yaml(path: str) -> dict:
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs the yaml package") from e
    return yaml.safe_load(Path(path).read_text(encoding="utf-8"))


ENTRY = T.StructType([T.StructField("file", T.StringType()), T.StructField("bytes", T.LongType()), T.StructField("sha256", T.StringType())])
MANIFEST = T.StructType([T.StructField("source", T.StringType()), T.StructField("revision", T.StringType()), T.StructField("files", T.MapType(T.StringType(), ENTRY))])


def manifest(spark: SparkSession, path: str, revision: str | None = None) -> DataFrame:
    """One row per key.  A manifest of another revision is refused."""
    df = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    if revision is not None and (found := [r.revision for r in df.where(F.col("revision") != revision).select("revision").collect()]):
        raise ValueError(f"manifest of revision {found[0]}, not {revision}")
    return df.select("source", "revision", F.explode("files").alias("key", "f")).select("source", "revision", "key", "f.*")


def record(path: str, source: str, revision: str, entries: dict[str, dict]) -> None:
    """Adds entries to a manifest under a lock: the file is read again inside it, so two writers' keys are both kept."""
    import fcntl
    import os

    with open(f"{path}.lock", "w") as lock:
        fcntl.flock(lock, fcntl.LOCK_EX)
        old = json.loads(Path(path).read_text()) if Path(path).exists() else {"source": source, "revision": revision, "files": {}}
        old["files"] |= entries
        Path(f"{path}.tmp").write_text(json.dumps(old, indent=1, sort_keys=True))
        os.replace(f"{path}.tmp", path)


def batches(spark: SparkSession, path: str) -> DataFrame:
    """A batch survey (a JSON array) with one row per batch and title number."""
    s = "batch string, ingested string, issues long, window_issues long, est_window_pages long, lccns array<string>"
    return spark.read.schema(s).option("multiLine", True).json(path).select("batch", "issues", "window_issues", "est_window_pages", F.explode_outer("lccns").alias("lccn"))


def write_articles(df: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet by source and year; the committer publishes whole tasks only.  Rows are dealt by the folders with a salt
    of their hash, so a large year is written by several tasks and a small one makes few files."""
    salted = df.repartition(F.col("source"), F.col("year"), F.pmod(F.xxhash64("article_id"), F.lit(16)))
    salted.write.mode(mode).option("compression", "zstd").option("maxRecordsPerFile", 2_000_000).partitionBy("source", "year").parquet(path)


def lexicon_digest(words: DataFrame) -> DataFrame:
    """(n, digest): the content address of a word list, SHA-256 over its sorted lines.  The sort is distributed; one task
    passes the lines of all ranges in order through the hash and keeps none."""

    def run(batches):
        import hashlib

        import pyarrow as pa

        n, h = 0, hashlib.sha256()
        for b in batches:
            lines = b.column(0).to_pylist()
            n += len(lines)
            h.update("".join(f"{w}\n" for w in lines).encode())
        yield pa.RecordBatch.from_pydict({"n": [n], "digest": [h.hexdigest()]})

    lines = words.select("word").where("word is not null").distinct().orderBy("word")
    found = lines.coalesce(1).mapInArrow(run, "n long, digest string").where("n > 0")
    empty = F.sha2(F.lit("\n").cast("binary"), 256)
    return found.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.coalesce(F.max("digest"), empty).alias("digest"))


def write_lexicon(words: DataFrame, folder: str, **about: str) -> str:
    """Sorted lines in a folder named by the first 12 digits of their digest, and a MANIFEST.json that names it; returns
    the digest.  The part files in order are the list."""
    found = lexicon_digest(words).first()
    words.select("word").where("word is not null").distinct().orderBy("word").write.mode("overwrite").text(f"{folder}/{found.digest[:12]}.txt")
    info = json.dumps({**about, "file": f"{found.digest[:12]}.txt", "n": found.n, "sha256": found.digest}, sort_keys=True)
    words.sparkSession.createDataFrame([(info,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/MANIFEST.json")
    return found.digest


def load_lexicon(spark: SparkSession, folder: str) -> DataFrame:
    """(word): the list that the folder's manifest names."""
    name = spark.read.schema("file string").json(f"{folder}/MANIFEST.json").first().file
    return spark.read.text(f"{folder}/{name}").withColumnRenamed("value", "word")


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A report table of an aggregated result; refuses larger ones."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows")
    show = lambda v: "" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *["| " + " | ".join(map(show, r)) + " |" for r in rows]]) + "\n"


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)

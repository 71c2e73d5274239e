"""Plans over manifests: what to fetch, what may be pruned, whether files are what they should be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MB_PER_S = 15


def download_plan(files: DataFrame, manifest: DataFrame, key: str = "key") -> DataFrame:
    """Files not in the manifest yet."""
    return files.join(manifest.select(key), key, "left_anti")


def eta(todo: DataFrame, size: str = "bytes", rate: float = MB_PER_S) -> DataFrame:
    return todo.agg(F.count("*").alias("files"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).withColumn("seconds", F.col("bytes") / (rate * 1e6))


def prune_plan(raw: DataFrame, ingested: DataFrame) -> DataFrame:
    """raw (key, file, bytes, present, pruned) with ingested (key, file, sha256, found_sha256, rows): the first reason why
    a raw file must stay, or NULL if it may go.  Files already pruned or absent aren't listed."""
    i = ingested.select("key", F.col("file").alias("out"), "sha256", "found_sha256", "rows", F.lit(True).alias("_in"))
    why = (
        F.when(F.col("_in").isNull() | F.col("out").isNull(), "not ingested")
        .when(F.col("found_sha256").isNull(), "missing")
        .when(F.col("found_sha256") != F.col("sha256"), "sha256 mismatch")
        .when(F.coalesce("rows", F.lit(0)) < 1, "no rows")
    )
    return raw.where("present and not pruned").join(i, "key", "left").select("key", raw["file"], "bytes", why.alias("problem"))


def freed(plan: DataFrame) -> DataFrame:
    return plan.agg(F.count_if(F.col("problem").isNull()).alias("deletable"), F.coalesce(F.sum(F.when(F.col("problem").isNull(), F.col("bytes"))), F.lit(0)).alias("freed_bytes"), F.count("problem").alias("problems"))


def checksum(content: Column, wanted: Column, size: Column) -> Column:
    """verdict of a checksum 'algorithm:hex' ('-': only the size counts)."""
    kind, want = F.substring_index(wanted, ":", 1), F.lower(F.substring_index(wanted, ":", -1))
    got = F.when(kind == "md5", F.md5(content)).when(kind == "sha1", F.sha1(content)).when(kind == "sha256", F.sha2(content, 256))
    return F.when(F.octet_length(content) != size, "size mismatch").when(wanted == "-", "size only").when(got.isNull(), "unknown algorithm").when(got == want, "ok").otherwise("digest mismatch")


def fingerprint(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows and an order-free digest of their content: the sum and the exclusive or of 32-bit hashes from MD5, so that
    any engine can repeat it.  Stands where a byte digest of a file would; Spark's files aren't byte-stable."""
    cols = columns or df.columns
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols])
    h = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    return df.select(h.alias("h")).agg(F.count("*").alias("n_rows"), F.coalesce(F.sum("h"), F.lit(0)).alias("hash_sum"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("hash_xor"))


def unknown_keys(asked: DataFrame, known: DataFrame, key: str = "key") -> DataFrame:
    """Asked keys that no known row has, once each."""
    return asked.select(key).distinct().join(known.select(key), key, "left_anti")


def size_rung(tokens: DataFrame, rungs: DataFrame) -> DataFrame:
    """The first rung (name, max_tokens) that holds the token count: the smallest capacity not below it."""
    met = tokens.join(F.broadcast(rungs), F.col("n_tokens") <= F.col("max_tokens"))
    return met.groupBy("n_tokens").agg(F.min_by("name", "max_tokens").alias("rung"))


def column_order(blocks: DataFrame) -> DataFrame:
    """Reading order of a page's text blocks (page, page_width, x0, y0, x1, text): (page, pos, text).  Blocks wholly in
    the left 55 % are the left column, those from 45 % on the right one, others full; if most are full, top to bottom,
    else by column (full blocks go with the left one)."""
    from pyspark.sql.window import Window

    own = blocks.where(F.trim("text") != "")
    side = F.when(F.col("x1") <= 0.55 * F.col("page_width"), 0).when(F.col("x0") >= 0.45 * F.col("page_width"), 1).otherwise(-1)
    page = Window.partitionBy("page")
    own = own.withColumn("_s", side).withColumn("_full", F.count_if(F.col("_s") == -1).over(page) * 2 > F.count("*").over(page))
    col = F.when(F.col("_full"), 0).otherwise(F.greatest("_s", F.lit(0)))
    return own.withColumn("_c", col).withColumn("pos", F.row_number().over(page.orderBy("_c", "y0", "x0", "text"))).select("page", "pos", "text")


def ordered_text(blocks: DataFrame) -> DataFrame:
    """One text per page; a page's blocks are few."""
    rows = column_order(blocks).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("b"))
    return rows.select("page", F.array_join(F.transform("b", lambda x: F.trim(x["text"])), "\n").alias("text"))

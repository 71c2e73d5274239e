"""Operator 9: sharding by extendible hashing, with DataFrame functions only.

A row's directory bits are the leading bits of the MD5 of its key.  The directory starts as one bucket; a bucket over
the byte limit splits on its next bit, any other stays as it is, so shards have different depths.  The splits are found
from sums of bytes: the rows are summed by a prefix of `step` bits, the sums are rolled up to all shorter prefixes, and
the buckets still over the limit at that depth are summed again by `step` more bits.  A row belongs to the shortest
prefix whose bytes fit.

Defined cases.  Null key: hashed as the text 'null'.  Null text: 0 bytes.  Empty table: no rows.  Rows that share all
60 bits (repeated keys) can't be split by hash: they get an overflow page, dealt by running bytes so that every page
fits too.  A single row longer than the limit has a page of its own and oversize = true.  Only the key and text columns
are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read, stored

#: Bytes of text in a shard, and the bits of hash that a row has.
LIMIT, BITS, STEP = 1 << 20, 60, 12


def _hash(key: str):
    return F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("null")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def extendible_shards(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, step: int = STEP) -> DataFrame:
    """One row per input row: key, n_bytes, shard (the prefix's bits as text, '' for the whole table, with '+page' after
    it for overflow pages), depth, shard_bytes, shard_rows, oversize."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"), _hash(key).alias("h"))
    rows = stored(rows, spark)
    found, live, depth = None, rows.groupBy(F.lit(0).cast("long").alias("top")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("n")), 0
    whole = live.first()
    if whole is None:
        return rows.select("key", "n_bytes", F.lit("").alias("shard"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("shard_bytes"), F.lit(0).cast("long").alias("shard_rows"), F.lit(False).alias("oversize"))
    if whole.bytes <= limit:
        found = [(0, 0, whole.bytes, whole.n)]
        directory = spark.createDataFrame(found, "depth int, prefix long, bytes long, n long")
    else:
        directory, over = None, None
        while depth < BITS:
            deep = min(BITS, depth + step)
            here = rows if over is None else rows.join(over, F.shiftright("h", BITS - depth) == F.col("at"), "left_semi")
            cells = here.groupBy(F.shiftright("h", BITS - deep).alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("n"))
            levels = cells.select("bytes", "n", F.explode(F.sequence(F.lit(depth + 1), F.lit(deep))).alias("depth"), "cell")
            sums = levels.groupBy("depth", F.expr(f"shiftright(cell, {deep} - depth)").alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
            up = sums.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"), (F.col("bytes") > limit).alias("split"))
            sums = stored(sums.withColumn("parent", F.shiftright("prefix", 1)).join(up, ["depth", "parent"], "left").where(F.coalesce("split", F.lit(True))).select("depth", "prefix", "bytes", "n"), spark)
            done = sums.where((F.col("bytes") <= limit) | (F.col("depth") == BITS))
            directory = done if directory is None else directory.unionByName(done)
            over = sums.where((F.col("depth") == deep) & (F.col("bytes") > limit)).select(F.col("prefix").alias("at"))
            depth = deep
            if over.isEmpty():
                break
    directory = stored(directory, spark)
    depths = [r.depth for r in directory.select("depth").distinct().collect()]  # 61 at most
    probe = rows.withColumn("p", F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.shiftright("h", BITS - d).alias("prefix")) for d in depths])))
    placed = probe.select("key", "n_bytes", "h", "p.depth", "p.prefix").join(directory, ["depth", "prefix"])
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0")))
    out = placed.withColumn("shard", bits)
    fits = out.where(F.col("bytes") <= limit).select("key", "n_bytes", "shard", "depth", F.col("bytes").alias("shard_bytes"), F.col("n").alias("shard_rows"), F.lit(False).alias("oversize"))
    same = out.where(F.col("bytes") > limit)
    if BITS not in depths:
        return fits
    # Overflow pages of one full hash: equal rows are counted first, so a page is arithmetic on counts and sizes.
    size = same.groupBy("h", "shard", "depth", "key", "n_bytes").agg(F.count("*").alias("copies"))
    size = size.withColumn("per", F.greatest(F.lit(1).cast("long"), F.floor(F.lit(limit) / F.greatest("n_bytes", F.lit(1)))))
    first = size.withColumn("before", F.coalesce(F.sum(F.ceil(F.col("copies") / F.col("per"))).over(Window.partitionBy("h").orderBy("key", "n_bytes").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    pages = first.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("copies") / F.col("per")) - 1)).alias("page")).withColumn("here", F.least("per", F.col("copies") - F.col("page") * F.col("per")))
    paged = pages.select("key", "n_bytes", F.concat("shard", F.lit("+"), (F.col("before") + F.col("page")).cast("string")).alias("shard"), "depth", (F.col("here") * F.col("n_bytes")).alias("shard_bytes"), F.col("here").alias("shard_rows"), (F.col("n_bytes") > limit).alias("oversize"), F.explode(F.sequence(F.lit(1).cast("long"), "here")).alias("copy"))
    return fits.unionByName(paged.drop("copy"))


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", limit: int = LIMIT) -> None:
    """Writes whole rows into one folder per shard, named by SHARD=.  Rows meet their shard by key; rows of one key that
    overflow pages hold together go to the first page of the key."""
    own, name = "_key", "shard"
    while own in docs.columns:
        own += "_"
    while name in docs.columns:
        name += "_"
    where = extendible_shards(docs, key, limit=limit).groupBy(F.col("key").alias(own)).agg(F.min("shard").alias(name))
    docs.join(where, docs[key].eqNullSafe(where[own])).drop(where[own]).repartition(name).write.partitionBy(name).mode("overwrite").parquet(path)


def op9_extendible_sharding(spark, sf_dir: str) -> DataFrame:
    out = extendible_shards(read(spark, sf_dir, "documents"))
    return out.select(F.col("key").alias("doc_id"), "n_bytes", "shard", F.col("depth").cast("int").alias("depth"), "shard_bytes", "shard_rows", "oversize")


SQL = f"""
with d as (select doc_id, coalesce(strlen(text), 0)::bigint n_bytes, ('0x' || substr(md5(coalesce(doc_id::varchar, 'null')), 1, {BITS // 4}))::bigint h from documents),
g as (select h, sum(n_bytes)::bigint bytes, count(*) n from d group by h),
p as (select h, bytes, n, k.depth, h >> ({BITS} - k.depth) prefix from g, (select unnest(range(0, {BITS + 1}))::int depth) k),
s as (select depth, prefix, sum(bytes)::bigint shard_bytes, sum(n)::bigint shard_rows from p group by all),
f as (select h, coalesce(min(depth) filter (where shard_bytes <= {LIMIT}), {BITS}) depth from p join s using (depth, prefix) group by h),
w as (select h, depth, case when depth = 0 then '' else lpad(format('{{:b}}', prefix), depth, '0') end shard, shard_bytes, shard_rows from f join p using (h, depth) join s using (depth, prefix)),
z as (select h, doc_id, n_bytes, count(*) copies, greatest(1, {LIMIT} // greatest(n_bytes, 1)) per from d join w using (h) where shard_bytes > {LIMIT} group by all),
o as (select *, coalesce(sum(ceil(copies / per)) over (partition by h order by doc_id, n_bytes rows between unbounded preceding and 1 preceding), 0)::bigint earlier from z),
q as (select *, unnest(range(0, ceil(copies / per)::bigint)) page from o),
r as (select *, least(per, copies - page * per)::bigint here, unnest(range(0, least(per, copies - page * per)::bigint)) from q)
select doc_id, n_bytes, shard, depth, shard_bytes, shard_rows, false oversize from d join w using (h) where shard_bytes <= {LIMIT}
union all
select doc_id, n_bytes, shard || '+' || (earlier + page), depth, (here * n_bytes)::bigint, here, n_bytes > {LIMIT} from r join w using (h)"""

"""Shared parts of the training-data operators.

Texts are handled as flat byte arrays: one numpy buffer per chunk of documents, with word starts, word ends and a
64-bit hash of every word found by array arithmetic.  No Python object is made per word.

Every function treats a null text as the empty text.  Words are runs of bytes other than space and \\x09-\\x0D, which
are never part of a longer UTF-8 sequence, so byte runs and code point runs agree.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

U64 = np.uint64
#: Bytes of text that one chunk holds at most, unless a single document is longer.
CHUNK_BYTES = 4 << 20
#: Symbols that one pass of the span hash takes at once, unless a single span is longer.
HASH_BYTES = 1 << 20
_SALT = U64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def spans_hash(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of disjoint spans with rising starts; equal symbols (under 2^24) give equal hashes wherever they
    stand.  A symbol is mixed with its place in its span and the mixed values are added up, so, other than for
    polynomials modulo 2^64, no regular pair of spans has equal hashes.  Block by block, so that the sums stay small
    beside the text."""
    out, i = np.empty(len(starts), U64), 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, lo + HASH_BYTES)))
        hi = int(ends[j - 1])
        place = np.arange(hi - lo) - np.repeat(starts[i:j] - lo, np.diff(np.append(starts[i:j], hi)))
        total = np.zeros(hi - lo + 1, U64)
        np.cumsum(mix((place.astype(U64) << U64(24)) + symbols[lo:hi].astype(U64) + _SALT), out=total[1:])
        out[i:j] = mix(total[ends[i:j] - lo] - total[starts[i:j] - lo])
        i = j
    return out


class Chunk:
    """Some whole documents: their rows in the batch, one byte buffer and the documents' offsets in it."""

    def __init__(self, lo: int, hi: int, buf: np.ndarray, offs: np.ndarray):
        self.lo, self.hi, self.buf, self.offs = lo, hi, buf, offs

    def __len__(self) -> int:
        return self.hi - self.lo

    def bytes_of(self, i: int) -> bytes:
        return self.buf[self.offs[i] : self.offs[i + 1]].tobytes()

    def words(self, lower: bool = False, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and document numbers of all words.  lower: the buffer's A-Z become a-z first."""
        if lower:
            self.buf = LOWER[self.buf]
        n = len(self.buf)
        if not n:
            z = np.zeros(0, np.int64)
            return z, z, z
        inside = ~space[self.buf]
        cut = np.zeros(n + 1, bool)
        cut[self.offs] = True
        start = inside.copy()
        start[1:] &= ~inside[:-1] | cut[1:n]
        end = inside.copy()
        end[:-1] &= ~inside[1:] | cut[1:n]
        s = np.flatnonzero(start)
        return s, np.flatnonzero(end) + 1, np.searchsorted(self.offs, s, "right") - 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return spans_hash(self.buf, starts, ends)


def chunks(col: pa.Array, limit: int = CHUNK_BYTES):
    """Cuts a string column into chunks of at most limit bytes (one longer document stands alone)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()) if col.type != pa.large_string() else col
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if not n:
        return
    offs = np.frombuffer(col.buffers()[1], np.int64, n + 1, col.offset * 8)
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield Chunk(lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi


def per_doc(values: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
    """Sums of the values by document number."""
    return np.bincount(docs, values, n).astype(np.int64)


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The concatenated ranges [start, start + len)."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = lens > 0
    starts, lens = starts[keep], lens[keep]
    step = np.ones(total, np.int64)
    step[0] = starts[0]
    step[np.cumsum(lens)[:-1]] = starts[1:] - starts[:-1] - lens[:-1] + 1
    return np.cumsum(step)


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def read_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents.  A small table may be one row group, which Spark reads in one task whatever the cores; its rows are
    dealt to all of them, as what follows costs far more than the read.  A table with a split for each core is left as it
    is."""
    docs, cores = read(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and the text, with null texts made empty; all other columns are pruned from the scan."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Lowers the session's bytes per Arrow batch: a batch exists in the JVM, on the wire and in Python at once, so its
    size, not the number of rows, must be bounded where texts are long."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(spark.conf.get(key)).rstrip("b")) > most:
        spark.conf.set(key, str(most))


def scratch(spark: SparkSession) -> str:
    """A new folder name below the shared folder of the session.  Only a local session without one, as in tests, gets its
    own; a cluster's machines would not share it."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        top = jdir.get() if jdir.isDefined() else None
    if not top:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        top = "file://" + tempfile.mkdtemp(prefix="lexharbor-")
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/lexharbor-{uuid.uuid4().hex}"


_written: list[str] = []


_kept: set[str] = set()


def stored(df: DataFrame, spark: SparkSession | None = None, codec: str = "zstd", keep: bool = False, by: str | None = None) -> DataFrame:
    """Writes the rows as a table in the shared folder and reads them back: lineage ends there, so a lost executor
    costs only the tasks that read it.  keep: scratch_tables leaves it.  by: a column that cuts the table into parts."""
    spark = spark or df.sparkSession
    path = scratch(spark)
    df.write.option("compression", codec).parquet(path, partitionBy=by)
    _written.append(path)
    if keep:
        _kept.add(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Deletes the shuffle files of each query that is run within it as soon as the query ends: for results that are
    stored, and not computed again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, old)


def released(run):
    """The task function, with freed memory given back to the system: workers stay alive between tasks, and what one
    operator's peak leaves in an idle worker would count against the next one's."""

    def wrapped(batches):
        import ctypes

        libc = ctypes.CDLL(None)
        if hasattr(libc, "mallopt"):
            libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD: larger arrays are mapped, and unmapped when freed
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(libc, "malloc_trim"):
                libc.malloc_trim(0)

    return wrapped


def drop(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the scratch tables that df reads, once no lazy result reads them."""
    files = df.inputFiles()
    _delete(spark, [p for p in _written if any(p.split("lexharbor-")[-1] in f for f in files)])


def drop_part(spark: SparkSession, df: DataFrame, *parts: str) -> None:
    """Deletes parts (column=value) of the scratch table that df reads, once only other parts are read."""
    files = df.inputFiles()
    for p in _written:
        if any(p.split("lexharbor-")[-1] in f for f in files):
            for x in parts:
                path = spark._jvm.org.apache.hadoop.fs.Path(f"{p}/{x}")
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch_tables(spark: SparkSession):
    """Deletes the scratch tables that were written within it, but for those to keep: for steps whose result is written
    in the end."""
    before = set(_written)
    try:
        yield
    finally:
        _delete(spark, [p for p in _written if p not in before and p not in _kept])


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _written.remove(p)
        _kept.discard(p)


def table(schema: T.StructType, **columns) -> pa.RecordBatch:
    """A record batch in the schema's order and types."""
    from pyspark.sql.pandas.types import to_arrow_schema

    want = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in want], schema=want)


def schema(ddl: str) -> T.StructType:
    """A schema from name:type pairs; made without a session so that modules can hold it as a constant."""
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "float": T.FloatType(), "string": T.StringType(), "binary": T.BinaryType(), "boolean": T.BooleanType(), "longs": T.ArrayType(T.LongType()), "doubles": T.ArrayType(T.DoubleType())}
    return T.StructType([T.StructField(*(lambda n, k: (n, kinds[k]))(*x.strip().split(":"))) for x in ddl.split(",")])


def tokenizer_file(name: str, path: str | None = None) -> str:
    """The place of a public tokenizer file: the path given, or the one of the installed collection."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(name)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays with their types, each in the smallest unsigned type that holds it, compressed."""
    out = []
    for a in arrays:
        a = np.asarray(a)
        if a.dtype.kind in "iu" and a.dtype != np.uint64 and (not len(a) or a.min() >= 0):
            a = a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))
        kind = a.dtype.str.encode().ljust(4)
        a = np.ascontiguousarray(a)
        wide = a.dtype.itemsize in (4, 8)
        data = a.view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes() if wide else a.tobytes()  # like bytes together
        out.append(kind + len(a).to_bytes(8, "little") + data)
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(data: bytes, narrow: bool = False) -> list[np.ndarray]:
    """The arrays of pack; narrow: integers in the types that they were sent in, else as 64 bits."""
    raw, at, out = memoryview(zstandard.ZstdDecompressor().decompress(data)), 0, []
    while at < len(raw):
        kind, n = np.dtype(bytes(raw[at : at + 4]).decode().strip()), int.from_bytes(raw[at + 4 : at + 12], "little")
        at += 12
        a = np.frombuffer(raw[at : at + n * kind.itemsize], kind)
        if kind.itemsize in (4, 8):
            a = np.ascontiguousarray(a.view(np.uint8).reshape(kind.itemsize, -1).T).reshape(-1).view(kind)
        at += n * kind.itemsize
        out.append(a if narrow or kind.kind == "f" or kind == np.uint64 else a.astype(np.int64))
    return out


def has_repeats(docs: DataFrame, key: str = "doc_id") -> bool:
    """Whether a key that isn't null occurs twice; reads the keys alone."""
    return not docs.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").isEmpty()


def one_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each key: if keys repeat, the row with the smallest hash of the text.  Rows without a key all stay.
    Without repeats, which is the rule, this is the table itself."""
    if not has_repeats(docs, key):
        return docs
    return docs.where(F.col(key).isNull()).unionByName(docs.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(text)).alias("x")).select("x.*"))


def by_key(batches, keys: list[str]):
    """From batches sorted by the keys: one (key tuple, table) per run of equal keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(b.schema.get_field_index(k)) for k in keys]
        change = np.zeros(b.num_rows, bool)
        for c in cols:
            v = c.to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            k = tuple(c[i].as_py() for c in cols)
            if held and k != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(b.slice(i, j - i))
            last = k
    if held:
        yield last, pa.Table.from_batches(held)


def by_bucket(batches):
    """From the rows (bucket, gid, kind, payload) of a partition, unsorted: one list of (gid, kind, payload, bucket) per
    bucket, in order of gid.  A partition holds the compressed payloads of few buckets, so they are kept here instead of
    being sorted in the JVM."""
    held: dict[int, list[tuple]] = {}
    for b in batches:
        c = {n: b.column(b.schema.get_field_index(n)) for n in ("bucket", "gid", "kind", "payload")}
        for k, g, kind, data in zip(*(c[n].to_pylist() for n in ("bucket", "gid", "kind", "payload"))):
            held.setdefault(k, []).append((g, kind, data, k))
    for k in sorted(held):
        yield sorted(held.pop(k), key=lambda x: x[:2])


def components(edges: DataFrame, spark: SparkSession) -> DataFrame:
    """Connected components of an undirected edge table (a long, b long): (node, root), root the smallest node of the
    component.  Alternates large-star and small-star rounds: each groups by node with map-side minima, so a hub costs
    one row per task, and the joins are plain equi-joins that adaptive execution splits when a hub is hot.  Each round
    is written to the shared folder, and the loop ends when no edge changes."""
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), spark)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = stored(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), spark)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = stored(small.where("u <> v").distinct(), spark)
        signature = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop(spark, large)
        if signature(new) == signature(e):
            drop(spark, new)
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        drop(spark, e)
        e = new


os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

"""Near copies of whole documents for filtering: SimHash and BK-trees as in operator 7, with 5-word shingles and an exact
similarity (Jaccard, of the sets of shingles) of 0.8 or more.

At that similarity fingerprints differ in up to REACH of 64 bits, too many for blocks of equal bits.  So the shards are
keyed by shingle minima: a text is in one shard for each of KEYS orders, the one of its smallest shingle, and two texts
of similarity s share a shard but for (1 - s)^KEYS of pairs (0.8: one in 400,000).  In a shard a BK-tree over the
fingerprints is searched within REACH; a neighbour of another component is compared by a sketch (the SKETCH smallest
distinct hashes, leading 32 bits) and, if that passes LIKELY, on the two whole texts, which the shard holds.  Only a pair that passes there is
linked and joins components, so the links form a forest per shard, never all pairs.  REACH itself misses 0.15 to 0.19 %
of pairs of similarity 0.8 (simulated: random sets of 50 to 2,000 shingles), unless other copies join them.

Exact copies are folded first: only one text of each is searched.  Defined cases: see simhash; texts without words are
copies of each other.
"""

from __future__ import annotations

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Chunk, U64, chunks, components, has_repeats, mix, released, schema, stored, table, texts
from .passages import rolled
from .simhash import TREE, BKTree

SHINGLE, SIMILAR, REACH, KEYS, SKETCH, LIKELY = 5, 0.8, 18, 8, 64, 0.6
DIGESTS = schema("doc_id:long,th:long,fp:long,keys:longs,sketch:binary,size:long")
#: Bytes of text that a shard keeps, on average.
SHARD_BYTES = 16 << 20
_SEEDS = mix(np.arange(1, KEYS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))


def digests(docs: DataFrame) -> DataFrame:
    """Per document: the hash of its words, its fingerprint, its KEYS minima and its sketch."""

    def run(batches):
        for b in batches:
            for c in chunks(b.column(1)):
                s, e, d = c.words(lower=True)
                h = c.hashes(s, e)
                lo, hi = np.searchsorted(d, np.arange(len(c))), np.searchsorted(d, np.arange(len(c)), "right")
                th, fp = np.zeros(len(c), np.int64), np.zeros(len(c), U64)
                keys, sketch = [], []
                for i, (x, y) in enumerate(zip(lo.tolist(), hi.tolist())):
                    own = rolled(h[x:y], min(SHINGLE, y - x)) if y > x else np.zeros(1, U64)
                    th[i] = xxhash.xxh3_64_intdigest(h[x:y].tobytes()) - (1 << 63)
                    ones = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
                    fp[i] = np.packbits(2 * ones > len(own), bitorder="little").view(U64)[0]
                    keys.append([int(mix(own ^ k).min() >> U64(1)) for k in _SEEDS])
                    sketch.append(np.unique((own >> U64(32)).astype(np.uint32))[:SKETCH].tobytes())
                yield table(DIGESTS, doc_id=b.column(0).slice(c.lo, len(c)), th=th, fp=fp.view(np.int64), keys=keys, sketch=sketch, size=np.diff(c.offs))

    return texts(docs).mapInArrow(released(run), DIGESTS)


def _like(a: bytes, b: bytes) -> float:
    """Similarity by the smallest hashes of the union."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    both = np.sort(np.concatenate([x, y]))
    again = both[1:] == both[:-1]
    rank, most = np.arange(1, len(both)) + 1 - np.cumsum(again), min(SKETCH, max(len(x), len(y)))
    return float((again & (rank <= most)).sum() / max(1, most))


PACKED = schema("doc_id:long,packed:binary")


def packed(docs: DataFrame) -> DataFrame:
    """The key and the compressed text: a text is sent to a shard for each of its keys, and few are ever compared."""

    def run(batches):
        frame = zstandard.ZstdCompressor(level=3)
        for b in batches:
            for c in chunks(b.column(1)):
                yield table(PACKED, doc_id=b.column(0).slice(c.lo, len(c)), packed=[frame.compress(c.bytes_of(i)) for i in range(len(c))])

    return texts(docs).where("doc_id is not null").mapInArrow(released(run), PACKED)


def shingle_set(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    c = Chunk(0, 1, raw, np.array([0, len(raw)]))
    s, e, _ = c.words(lower=True)
    return np.unique(rolled(c.hashes(s, e), max(1, min(SHINGLE, len(s)))))


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= SIMILAR * (len(x) + len(y) - both)


class Shard:
    """The rows that a shard keeps.  Its components are joined by links that hold on the whole texts and by no others, so
    a row that is only loosely similar stands in nobody's way."""

    def __init__(self):
        self.tree, self.rows, self.sets = BKTree(), [], {}

    def links(self, doc: int, fp: int, sketch: bytes, text: bytes, keep: bool) -> list[tuple[int, int]]:
        """From this row to one similar row of every component that has one."""
        x, own = fp & (1 << 64) - 1, []

        def accept(n: int) -> bool:
            if _like(sketch, self.rows[n][1]) < LIKELY:
                return False
            if not own:
                own.append(shingle_set(text))
            if n not in self.sets:
                self.sets[n] = shingle_set(self.rows[n][2])
            return similar(own[0], self.sets[n])

        near = self.tree.search(x, REACH, accept)
        out = [(doc, self.rows[n][0]) for n in near]
        if keep:
            n = self.tree.add(x, near)
            self.rows.append((doc, sketch, text))
            if own:
                self.sets[n] = own[0]
        return out


LINKS = schema("a:long,b:long")


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) of every document; component_id is the smallest doc_id of its near copies."""
    spark = docs.sparkSession
    all_ = stored(digests(docs.where("doc_id is not null")), spark)
    one = stored(all_.groupBy("th").agg(F.min(F.struct("doc_id", "fp", "keys", "sketch", "size")).alias("x")).select("th", "x.*"), spark)
    rows = one.select("doc_id", "size", F.posexplode("keys").alias("k", "key"))
    sizes = rows.groupBy("k", "key").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).where("n > 1")
    met = rows.join(sizes, ["k", "key"]).withColumn("s", F.greatest(F.ceil(F.col("n") / TREE), F.ceil(F.col("bytes") / SHARD_BYTES)).cast("int"))
    met = met.withColumn("home", F.pmod(F.xxhash64("doc_id"), F.col("s")).cast("int")).select("doc_id", "k", "key", "home", "s")
    met = met.join(one.select("doc_id", "fp", "sketch"), "doc_id").hint("shuffle_hash").join(packed(docs), "doc_id")
    met = met.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("s") - 1))).withColumn("asks", F.col("home") != F.col("shard"))
    # the rows that a shard keeps come first; those that only ask pass by and aren't held
    met = met.repartition("k", "key", "shard").sortWithinPartitions("k", "key", "shard", "asks", "doc_id")

    def run(batches):
        last, shard = None, Shard()
        for b in batches:
            got: list[tuple[int, int]] = []
            for k, key, s, asks, doc, fp, sketch, data in zip(*(c.to_pylist() for c in b.columns)):
                if (k, key, s) != last:
                    last, shard = (k, key, s), Shard()
                got += shard.links(doc, fp, sketch, data, not asks)
            if got:
                yield table(LINKS, a=[min(x) for x in got], b=[max(x) for x in got])

    edges = stored(met.select("k", "key", "shard", "asks", "doc_id", "fp", "sketch", "packed").mapInArrow(released(run), LINKS).distinct(), spark)
    roots = components(edges, spark)
    member = one.select("th", "doc_id").join(roots, one["doc_id"] == roots["node"], "left").select("th", F.coalesce("root", "doc_id").alias("component_id"))
    return all_.select("doc_id", "th").join(member, "th").select("doc_id", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without all but the first (smallest doc_id) of each group of near copies.  Rows with one key are one
    document: of those with the same text one stays, and those with other texts stay or go together.  Rows with a null key
    stay."""
    gone = near_copies(docs).where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)
    if not has_repeats(docs):
        return kept
    one = kept.where("doc_id is not null").groupBy("doc_id", F.xxhash64("text"), F.md5("text")).agg(F.first(F.struct(*docs.columns)).alias("x")).select("x.*")
    return kept.where("doc_id is null").unionByName(one)

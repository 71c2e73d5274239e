"""Operator 7: near-duplicates by 64-bit SimHash, searched with BK-trees.

A fingerprint is made of the XXH64 hashes of all word shingles.  Fingerprints, not rows, are linked, so exact copies
cost nothing.  The 64 bits are cut into blocks such that two fingerprints within the radius agree on all bits of at
least (blocks - radius) of them (pigeonhole); every choice of that many blocks is one table, and the fingerprints that
share a table's bits are a group.  The number of blocks follows the number of distinct fingerprints, so a group stays
small, and each choice finds all pairs.

In a group, a BK-tree holds the fingerprints seen so far: children are keyed by their Hamming distance to the parent,
and a search follows only the edges within the radius of its own distance.  A group over TREE rows is dealt into shard
trees of at most TREE fingerprints on average; each fingerprint is kept in one shard and sought in all of them.  A
search joins components of the tree's own union-find, and a shard emits one link per fingerprint (to its root), never all pairs.

Defined cases.  Null text: empty, fingerprint zero, linked like any other.  Empty table: no rows.  Repeated rows share
a fingerprint.  Ties of a bit (exactly half) give 0.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_key, chunks, components, read_texts, released, schema, stored, table, texts

SHINGLE, RADIUS, SEED, TREE = 4, 4, 42, 4000
PRINTS = schema("doc_id:long,fp:long")
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number."""

    def run(batches):
        digest = xxhash.xxh64_intdigest
        for b in batches:
            for c in chunks(b.column(1)):
                low = c.buf.tobytes().lower()
                offs, out = c.offs.tolist(), np.zeros(len(c), np.uint64)
                for i, (lo, hi) in enumerate(zip(offs, offs[1:])):
                    words = low[lo:hi].split()
                    if not words:
                        continue
                    line = b" ".join(words)
                    n = max(1, len(words) - shingle + 1)
                    ends = np.cumsum([len(w) + 1 for w in words])
                    starts = [0, *ends[: n - 1].tolist()]
                    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
                    h = np.array([digest(line[x:y], SEED) for x, y in zip(starts, stops)], np.uint64)
                    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
                    out[i] = np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0]
                yield table(PRINTS, doc_id=b.column(0).slice(c.lo, len(c)), fp=out.view(np.int64))

    return texts(docs).mapInArrow(released(run), PRINTS)


class BKTree:
    """Nodes in lists; children of a node keyed by distance.  Nodes also form components (`up`, a union-find), and a
    node knows if its whole subtree is of one component: a search that has met that component skips the subtree, so a
    dense group of near copies costs a path and not all its pairs."""

    def __init__(self):
        self.value, self.child, self.up, self.mono = [], [], [], []

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def search(self, x: int, radius: int, accept=None) -> list[int]:
        """One node within the radius (and accepted) of every component that has one."""
        found, seen, todo, value, child, mono, find = [], set(), [0] if self.value else [], self.value, self.child, self.mono, self.find
        while todo:
            at = todo.pop()
            if seen and mono[at] >= 0 and find(mono[at]) in seen:
                continue
            d = (value[at] ^ x).bit_count()
            if d <= radius:
                r = find(at)
                if r not in seen and (accept is None or accept(at)):
                    seen.add(r)
                    found.append(at)
            below = child[at]
            if below:
                lo, hi = d - radius, d + radius
                todo += [v for k, v in below.items() if lo <= k <= hi]
        return found

    def add(self, x: int, linked: list[int]) -> int:
        """A new node, in one component with the linked ones."""
        i = len(self.value)
        self.value.append(x)
        self.child.append({})
        self.up.append(i)
        self.mono.append(i)
        for n in linked:
            self.up[self.find(n)] = i
        at = 0
        while at != i:
            if self.mono[at] >= 0 and self.find(self.mono[at]) != i:
                self.mono[at] = -1
            d = (self.value[at] ^ x).bit_count()
            at = self.child[at].setdefault(d, i)
        return i


def link_group(own: np.ndarray, asking: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (to the root) among the distinct own fingerprints and of the asking ones to them."""
    tree, signed, full = BKTree(), own.tolist(), (1 << 64) - 1
    for x in signed:
        tree.add(x & full, tree.search(x & full, radius))
    out = [(x, signed[tree.find(i)]) for i, x in enumerate(signed) if tree.find(i) != i]
    for x in asking.tolist():
        out += [(x, signed[n]) for n in tree.search(x & full, radius)]
    return out


def plan(n: int, radius: int = RADIUS, group: int = 64) -> tuple[list[tuple[int, int]], int]:
    """Blocks (low bit, width) and how many of them a table joins: the fewest tables whose groups hold about `group`
    of n evenly spread fingerprints."""
    for blocks in range(radius + 1, radius + 5):
        k = blocks - radius
        edges = [64 * i // blocks for i in range(blocks + 1)]
        cut = [(a, b - a) for a, b in zip(edges, edges[1:])]
        if n <= group << (k * (64 // blocks)):
            break
    return cut, k


def links(prints: DataFrame, radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """Links (a, b) between distinct fingerprints fp within the radius; enough of them for all components."""
    n = prints.count()
    blocks, k = plan(n, radius)
    tables = [sum(((1 << w) - 1) << lo for lo, w in c) for c in combinations(blocks, k)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    rows = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")) for m in tables])).alias("t", "bits"))
    sizes = rows.groupBy("t", "bits").agg(F.count("*").alias("n")).where("n > 1")
    # A group over the tree size: kept in one of s shards, sought in all.
    dealt = rows.join(sizes, ["t", "bits"]).withColumn("s", F.ceil(F.col("n") / tree).cast("int"))
    home = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("s")).cast("int")
    dealt = dealt.withColumn("home", home).select("fp", "t", "bits", "home", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("shard"))
    # The prefix of the sort key is the shuffle key, so a task meets its groups one after another.
    dealt = dealt.repartition("t", "bits", "shard").sortWithinPartitions("t", "bits", "shard", "fp")
    out = schema("a:long,b:long")

    def run(batches):
        got: list[tuple[int, int]] = []
        for (_, _, shard), rows in by_key(batches, ["t", "bits", "shard"]):
            fp, home = rows["fp"].to_numpy(), rows["home"].to_numpy()
            got += link_group(fp[home == shard], fp[home != shard], radius)
            if len(got) > 50_000:
                yield table(out, a=[x for x, _ in got], b=[x for _, x in got])
                got = []
        yield table(out, a=[x for x, _ in got], b=[x for _, x in got])

    return dealt.mapInArrow(released(run), out).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id reachable over links of fingerprints."""
    spark = docs.sparkSession
    prints = stored(fingerprints(docs, shingle), spark)
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), spark)
    edges = stored(links(distinct.select("fp"), radius), spark)
    roots = components(edges, spark)
    member = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    low = member.groupBy("root").agg(F.min("low").alias("component_id"))
    named = member.join(low, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def op7_simhash_bktree(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(read_texts(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

"""Operator 6: best-fit packing into bins of several permitted lengths.

Rows are dealt to shards of about SHARD rows by a hash of their key and place (so repeated rows are spread), and each shard is packed alone, so bins never cross
tasks and the work is linear in the rows.  In a shard the pieces go in order of falling length (ties: key, piece).  A
piece goes to the open bin that it fills best.  If none has room, a bin is opened at the size with the least cost per
token that it can expect to hold: a bin of length C costs C + C^2 / BEND (linear layers and attention), and its gap is
filled by as many of the tokens still to come as are in pieces that fit the gap.  At the end every bin is downsized to
the smallest permitted length that holds its contents.

Documents over the largest length are cut into pieces of that length, so no token is lost.  A document's length is its
words and an end token.

Defined cases.  Null or empty text: one piece of one token.  Null key: sorts first.  Repeated rows are packed one by one.
Empty table: no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_key, chunks, per_doc, read_texts, released, schema, table, texts

LENGTHS, BEND, SHARD = (512, 1024, 2048, 4096, 8192), 16384, 20_000
LENS = schema("doc_id:long,n_tokens:long")
PLACED = schema("doc_id:long,piece:int,n_tokens:long,bin_id:long,bin_capacity:int,bin_offset:int,bin_used:int")


def token_lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens): words and the end token."""

    def run(batches):
        for b in batches:
            for c in chunks(b.column(1)):
                _, _, d = c.words()
                yield table(LENS, doc_id=b.column(0).slice(c.lo, len(c)), n_tokens=per_doc(np.ones(len(d)), d, len(c)) + 1)

    return texts(docs).mapInArrow(released(run), LENS)


def cost(c: int, bend: float = BEND) -> float:
    return c + c * c / bend


def pack(lens: np.ndarray, lengths: tuple[int, ...] = LENGTHS, bend: float = BEND) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin number, offset and final bin length of each piece; lens falls and is at most the largest length."""
    most = max(lengths)
    waiting = np.bincount(lens, minlength=most + 1) * np.arange(most + 1)
    to_come = np.concatenate([[0], np.cumsum(waiting)])  # tokens of pieces shorter than i
    bin_of, offset = np.zeros(len(lens), np.int64), np.zeros(len(lens), np.int64)
    room: list[list[int]] = [[] for _ in range(most + 1)]
    used: list[int] = []
    open_ = 0  # bit r: some bin has r tokens of room
    placed = 0
    total = int(lens.sum())
    for i, n in enumerate(lens.tolist()):
        fits = open_ >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_ ^= 1 << r
        else:
            b = len(used)
            used.append(0)
            left = total - placed - n
            best = None
            for c in lengths:
                if c >= n:
                    gap = c - n
                    expect = n + min(gap, left, int(to_come[min(gap, n) + 1]))
                    best = min(best or (float("inf"), 0), (cost(c, bend) / expect, c))
            r = best[1]
        bin_of[i], offset[i] = b, used[b]
        used[b] += n
        placed += n
        if r > n:
            room[r - n].append(b)
            open_ |= 1 << (r - n)
    sizes = np.array(sorted(lengths))
    final = sizes[np.searchsorted(sizes, np.array(used, np.int64))] if used else np.zeros(0, np.int64)
    return bin_of, offset, final


def pack_documents(lens: DataFrame, lengths: tuple[int, ...] = LENGTHS, bend: float = BEND, shard: int = SHARD) -> DataFrame:
    """One row per piece of (doc_id, n_tokens): its bin, the bin's final length, the piece's place, the bin's contents."""
    most = max(lengths)
    shards = max(1, -(-lens.count() // shard))
    rows = lens.withColumn("shard", F.pmod(F.xxhash64("doc_id", "n_tokens", F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
    rows = rows.repartition("shard").sortWithinPartitions("shard", F.desc("n_tokens"), "doc_id")

    def run(batches):
        for (s,), t in by_key(batches, ["shard"]):
            n = t["n_tokens"].to_numpy()
            pieces = np.maximum(1, -(-n // most))
            doc = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            size = np.minimum(most, n[doc] - piece * most)
            order = np.argsort(-size, kind="stable")
            bins, at, final = pack(size[order], lengths, bend)
            used = np.bincount(bins, size[order], len(final)).astype(np.int64)
            ids = t["doc_id"].combine_chunks().take(doc[order])
            yield table(PLACED, doc_id=ids, piece=piece[order], n_tokens=size[order], bin_id=(np.int64(s) << 32) + bins, bin_capacity=final[bins], bin_offset=at, bin_used=used[bins])

    return rows.mapInArrow(released(run), PLACED)


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    from .common import stored

    return pack_documents(stored(token_lengths(read_texts(spark, sf_dir)), spark))

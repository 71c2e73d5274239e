"""Operator 5: token ids in sorted-string-table shards.

Rows are range-partitioned and sorted by key, encoded, and written as sorted string tables:

    data blocks   entries [shared key bytes u8][other key bytes u8][value bytes u32][other key bytes][value]; the first
                  entry of a block shares nothing, so a block can be read alone
    index         per block: first key (9 bytes), offset u64, length u32
    Bloom filter  HASHES bits per key in a bit array of BITS_PER_KEY bits per key
    footer        index offset u64, blocks u32, filter offset u64, filter bytes u32, entries u64, ids u64, order u64,
                  id bytes u32, magic (8 bytes)

A key is a null flag and the big-endian doc_id with its sign bit flipped, so bytes sort as numbers, nulls first.  A
value is the document's ids, little-endian, two bytes each if the vocabulary fits, else four.  The magic is the
line separator of Spark's own text writer, so the files go through Spark's committer to any file system Spark knows;
nothing is written by path from an executor.  `lookup` finds a key by filter, binary search in the index, one block.

Encoding: the library encodes each distinct unit of a chunk once.  Units are cut where the tokenizer's own pre-tokenizer
must cut (white space; between ASCII letters, digits and marks other than the apostrophe), so the ids of a text are the
ids of its units in order.  Texts that hold a special token's string are encoded whole.

Defined cases.  Null text: empty, so only the end id.  Null key: sorts first.  Repeated keys: adjacent entries.  Empty
table: no files, no rows.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Chunk, LOWER, U64, chunks, ragged, read_texts, released, schema, scratch, stored, table, texts, tokenizer_file, _written

MODEL, END = "word_bpe_49k.json", 1
BLOCK, SHARD, BITS_PER_KEY, HASHES = 64 << 10, 8 << 20, 10, 7
MAGIC = b"LXSSTBL1"
_FOOTER = struct.Struct("<QIQIQQQI8s")
_INDEX = struct.Struct("<9sQI")
#: Most distinct units that a worker remembers between chunks.
MEMO = 1_500_000


# --- encoding ---------------------------------------------------------------------------------------------------------
_CLASS = np.zeros(256, np.uint8)  # 0 space, 1 letter, 2 digit, 3 mark, 4 other: never cut beside it
_CLASS[33:127] = 3
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[ord("'")] = 4
_CLASS[:32] = _CLASS[127:] = 4
_CLASS[[9, 10, 11, 12, 13, 32]] = 0


def _units(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and kinds (the class, or 4 if mixed) of the units."""
    k = _CLASS[buf].copy()
    lead = np.flatnonzero(buf == 0xC3)  # Latin-1 letters but for the two signs among them
    lead = lead[lead + 1 < len(buf)]
    lead = lead[(buf[lead + 1] != 0x97) & (buf[lead + 1] != 0xB7)]
    k[lead] = k[lead + 1] = 1
    n = len(buf)
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    cut[1:n] |= (k[1:] != k[:-1]) & (((k[1:] != 4) & (k[:-1] != 4)) | (k[1:] == 0) | (k[:-1] == 0))
    at = np.flatnonzero(cut[:n])
    ends = np.append(at[1:], n)
    other = np.concatenate([[0], np.cumsum(k == 4)])
    kind = np.where(other[ends] > other[at], 4, k[at])
    keep = k[at] != 0
    return at[keep], ends[keep], kind[keep]


class Encoder:
    """Ids of whole texts by the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        added = self.model.get_added_tokens_decoder().values()
        self.special = [t.content.encode() for t in added]
        vocab = self.model.get_vocab()
        self.n = self.model.get_vocab_size()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.keys, self.at, self.len, self.ids = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _alone(self, units: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(units, add_special_tokens=False)]

    def _distinct(self, units: list[str], kinds: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token counts and flat ids of distinct units.  Plain units are encoded many to a text: the number of their
        words is known, and the end-of-word mark closes each."""
        n = np.zeros(len(units), np.int32)
        out: list = [None] * len(units)
        plain = np.flatnonzero(kinds != 4)
        step = 64
        for lo in range(0, len(plain), 4096):
            part = plain[lo : lo + 4096]
            groups = [part[i : i + step] for i in range(0, len(part), step)]
            for g, ids in zip(groups, self._alone([" ".join([units[i] for i in g]) for g in groups])):
                ids = np.array(ids, np.int32)
                ends = np.flatnonzero(self.last[ids]) + 1
                words = np.where(kinds[g] == 2, lens[g], 1)
                if len(ends) == words.sum():
                    cuts = ends[np.cumsum(words) - 1]
                    for i, a, b in zip(g.tolist(), [0, *cuts[:-1].tolist()], cuts.tolist()):
                        out[i] = ids[a:b]
                else:
                    for i, x in zip(g.tolist(), self._alone([units[i] for i in g])):
                        out[i] = np.array(x, np.int32)
        rest = np.flatnonzero(kinds == 4)
        for i, x in zip(rest.tolist(), self._alone([units[i] for i in rest])):
            out[i] = np.array(x, np.int32)
        n[:] = [len(x) for x in out]
        return n, np.concatenate(out) if out else np.zeros(0, np.int32)

    def encode(self, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Tokens per document and all ids, without end ids."""
        raw = c.buf.tobytes()
        if any(s in raw for s in self.special):
            got = [np.array(x, np.int64) for x in self._alone([c.bytes_of(i).decode("utf-8", "replace") for i in range(len(c))])]
            return np.array([len(x) for x in got], np.int64), np.concatenate(got) if got else np.zeros(0, np.int64)
        if not len(c.buf):
            return np.zeros(len(c), np.int64), np.zeros(0, np.int64)
        s, e, kind = _units(c.buf, c.offs)
        # plain units are lowered here, so that a word has one entry; others are left to the library, which composes
        # marks before it lowers
        odd = np.zeros(len(c.buf) + 1, np.int8)
        odd[s[kind == 4]] = 1
        odd[e[kind == 4]] -= 1
        c = Chunk(c.lo, c.hi, np.where(np.cumsum(odd[:-1], dtype=np.int8) > 0, c.buf, LOWER[c.buf]), c.offs)
        h, first, which = np.unique(c.hashes(s, e), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, h)
        at[at == len(self.keys)] = 0
        known = self.keys[at] == h if len(self.keys) else np.zeros(len(h), bool)
        new = np.flatnonzero(~known)
        low = c.buf.tobytes()
        f = first[new]
        n, ids = self._distinct([low[a:b].decode("utf-8", "replace") for a, b in zip(s[f].tolist(), e[f].tolist())], kind[f], (e - s)[f])
        base = len(self.ids)
        pos = np.cumsum(n, dtype=np.int64) - n + base
        where, size = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        where[known], size[known] = self.at[at[known]], self.len[at[known]]
        where[new], size[new] = pos, n
        flat = np.concatenate([self.ids, ids.astype(np.int32)])
        if len(self.keys) + len(new) <= MEMO:
            self.ids = flat
            keys = np.concatenate([self.keys, h[new]])
            order = np.argsort(keys, kind="stable")
            self.keys, self.at, self.len = keys[order], np.concatenate([self.at, pos])[order], np.concatenate([self.len, n])[order]
        docs = np.searchsorted(c.offs, s, "right") - 1
        per = np.bincount(docs, size[which], len(c)).astype(np.int64)
        return per, flat[ragged(where[which], size[which])]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


# --- file format ------------------------------------------------------------------------------------------------------
def key_bytes(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + ((doc_id + (1 << 63)) & (1 << 64) - 1).to_bytes(8, "big")


def key_value(key: bytes) -> int | None:
    return int.from_bytes(key[1:], "big") - (1 << 63) if key[0] else None


def _bits(key: bytes, size: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x5BD1E995) | 1
    return [(a + i * b) % size for i in range(HASHES)]


class Writer:
    """One shard; add() in ascending key order, then close()."""

    def __init__(self, width: int, order: int):
        self.width, self.order = width, order
        self.out, self.index, self.keys, self.n_ids = bytearray(), [], [], 0
        self.block, self.start, self.before = 0, b"", b""

    def add(self, key: bytes, value: bytes) -> None:
        if not self.keys or len(self.out) - self.block >= BLOCK:
            self._end()
            self.block, self.start, self.before = len(self.out), key, b""
        same = 0
        while same < len(self.before) and self.before[same] == key[same]:
            same += 1
        self.out += struct.pack("<BBI", same, len(key) - same, len(value)) + key[same:] + value
        self.before = key
        self.keys.append(key)
        self.n_ids += len(value) // self.width

    def _end(self) -> None:
        if len(self.out) > self.block:
            self.index.append(_INDEX.pack(self.start, self.block, len(self.out) - self.block))

    def close(self) -> bytes:
        self._end()
        at = len(self.out)
        self.out += b"".join(self.index)
        size = max(64, -(-len(self.keys) * BITS_PER_KEY // 8) * 8)
        bloom = bytearray(size // 8)
        for k in self.keys:
            for i in _bits(k, size):
                bloom[i >> 3] |= 1 << (i & 7)
        where = len(self.out)
        self.out += bloom
        self.out += _FOOTER.pack(at, len(self.index), where, len(bloom), len(self.keys), self.n_ids, self.order, self.width, MAGIC)
        return bytes(self.out)


class Reader:
    """Reads one shard's bytes."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        self.at, self.blocks, self.bloom, self.bloom_bytes, self.entries, self.n_ids, self.order, self.width, magic = _FOOTER.unpack(self.data[-_FOOTER.size :])
        if magic != MAGIC:
            raise ValueError("not a token table")

    def _entry(self, i: int) -> tuple[bytes, int, int]:
        return _INDEX.unpack_from(self.data, self.at + i * _INDEX.size)

    def _block(self, i: int):
        _, at, size = self._entry(i)
        end, key = at + size, b""
        while at < end:
            same, more, n = struct.unpack_from("<BBI", self.data, at)
            at += 6
            key = key[:same] + bytes(self.data[at : at + more])
            at += more
            yield key, self.data[at : at + n]
            at += n

    def scan(self):
        for i in range(self.blocks):
            yield from self._block(i)

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every entry with this key."""
        key, size = key_bytes(doc_id), self.bloom_bytes * 8
        if not all(self.data[self.bloom + (i >> 3)] >> (i & 7) & 1 for i in _bits(key, size)):
            return []
        lo, hi = 0, self.blocks
        while lo < hi:  # first block whose first key is not below the key
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self._entry(mid)[0] < key else (lo, mid)
        found = []
        for i in range(max(0, lo - 1), self.blocks):
            if self._entry(i)[0] > key:
                break
            found += [self.ids(v) for k, v in self._block(i) if k == key]
        return found

    def ids(self, value) -> np.ndarray:
        return np.frombuffer(value, "<u2" if self.width == 2 else "<u4").astype(np.uint32)


# --- operators --------------------------------------------------------------------------------------------------------
def write_tables(docs: DataFrame, path: str, model: str | None = None, end: int | None = END) -> None:
    """Writes the shards of (doc_id, text) below path, in ascending key order of their `order` numbers."""
    file = tokenizer_file(MODEL, model)

    def run(batches):
        enc = encoder(file)
        width = 2 if enc.n <= 1 << 16 else 4
        kind = "<u2" if width == 2 else "<u4"
        tail = b"" if end is None else np.array([end], kind).tobytes()
        part, seq, w, out = TaskContext.get().partitionId(), 0, None, schema("content:binary")
        for b in batches:
            keys = b.column(0)
            for c in chunks(b.column(1)):
                per, ids = enc.encode(c)
                flat, at = ids.astype(kind), np.concatenate([[0], np.cumsum(per)])
                for i, k in enumerate(keys.slice(c.lo, len(c)).to_pylist()):
                    w = w or Writer(width, (part << 24) + seq)
                    w.add(key_bytes(k), flat[at[i] : at[i + 1]].tobytes() + tail)
                    if len(w.out) >= SHARD:
                        yield table(out, content=[w.close()])
                        w, seq = None, seq + 1
        if w:
            yield table(out, content=[w.close()])

    rows = texts(docs).repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    # The text writer ends a row with the separator: the last 8 bytes of a file, its magic.
    shards = rows.mapInArrow(released(run), schema("content:binary")).select(F.expr("substring(content, 1, length(content) - 8)").cast("string").alias("value"))
    shards.write.option("lineSep", MAGIC.decode()).option("maxRecordsPerFile", 1).mode("overwrite").text(path)


ENTRIES = T.StructType([*schema("path:string,order:long,doc_id:long,before:long,n_tokens:long,ids_crc32:long")])


def read_tables(spark, path: str, with_ids: bool = False) -> DataFrame:
    """The entries of all shards: file, its order, doc_id, ids before the entry in its file, n_tokens, CRC-32 of the
    ids as unsigned 32-bit integers and, if asked, the ids."""
    out = T.StructType([*ENTRIES, T.StructField("ids", T.ArrayType(T.LongType()))]) if with_ids else ENTRIES

    def run(batches):
        for b in batches:
            for p, content in zip(b.column(0), b.column(1)):
                r = Reader(memoryview(content.as_buffer()))
                before, cols = 0, {n: [] for n in out.names}
                for key, value in r.scan():
                    ids = r.ids(value)
                    for n, v in (("path", p.as_py()), ("order", r.order), ("doc_id", key_value(key)), ("before", before), ("n_tokens", len(ids)), ("ids_crc32", zlib.crc32(ids.astype("<u4").tobytes()))):
                        cols[n].append(v)
                    if with_ids:
                        cols["ids"].append(ids.tolist())
                    before += len(ids)
                yield table(out, **cols)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(released(run), out)


def lookup(spark, path: str, doc_ids: list[int]) -> DataFrame:
    """Point reads: only files whose filter admits a key have a block read."""
    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType()))])

    def run(batches):
        for b in batches:
            for content in b.column(0):
                r = Reader(memoryview(content.as_buffer()))
                got = [(k, x.tolist()) for k in doc_ids for x in r.lookup(k)]
                yield table(out, doc_id=[k for k, _ in got], ids=[x for _, x in got])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(released(run), out)


def token_offsets(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all entries before it, over all files in order), n_tokens and ids_crc32."""
    rows = stored(read_tables(spark, path), spark)
    files = rows.groupBy("path", "order").agg(F.sum("n_tokens").alias("n"))  # a row per file
    base = files.select("path", F.coalesce(F.sum("n").over(Window.orderBy("order").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return rows.join(base, "path").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op5_token_tables(spark, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    _written.append(path)
    write_tables(read_texts(spark, sf_dir), path)
    return token_offsets(spark, path)

"""Operator 2: language-model scoring with a hierarchical Pitman-Yor model.

The model.  A token follows a context, the token before it (or a document's start).  Every context is a restaurant of its
own, known by its word's 64-bit hash; none are merged.  Its parent is the context shortened by that token, the empty one:
the root, a restaurant over the vocabulary.  The base measure is even over the V known words and one class of all words
that training never held, so the probabilities of the known words and that class sum to one in every context.

Inference is Gibbs sampling of seats, discounts and strengths (module seating).  A sweep seats all customers of all contexts
given the root's measure, then all customers of the root given the tables of the contexts, draws the root's measure
from its seats, and draws both levels' discount and strength from their posterior over a grid.  All totals are those of
the present state.  Contexts are independent given the root's measure, so a sweep on many machines is the same as on one.
One step is not exact: the mass that the root's measure leaves to its base is spread as the base is, which is its mean.
After BURN_IN sweeps from one table a dish, SAMPLES states are kept, one a sweep.  A token's probability is the mean of
its predictive probabilities under the kept states, each with its own seats, totals and parameters, so they are
normalised.  Draws are made from hashes of word, context and sweep: the result depends neither on buckets nor on
partitions.

Distribution.  Documents are read once, in groups of some megabytes: a group keeps the documents of its tokens, and sends
each bucket of contexts its distinct (context, word) pairs with their counts.  A bucket holds whole contexts.  It adds the
counts up and keeps what every group asks for.  Only pairs that occur more than once have seats to draw, so sweeps read
these alone.  Group parts name most words by their places in a list of words frequent in a sample of the texts, the
others by their whole hashes; the list shortens parts, and no result depends on it.  The root is dealt in slices by word: a slice adds up the tables of all buckets and answers each bucket with
its words' part.  Sums over everything, a few hundred numbers, pass through the driver.  In the end a bucket answers
each group with the probabilities of its pairs.  Empty parts aren't sent, so parts are as many as a group's pairs at most.
A bucket holds all pairs of its contexts, so the most frequent word makes the largest task.

Words are known by 64-bit hashes: with V distinct words two share one with probability V^2 / 2^65 (a billion: 3 %).

Defined cases.  Null text: empty, its only token is the end.  Null key: a training document (its text form is empty).
Empty table: no rows.  No training document: N = V = 0; the base score is that of the formula, log10(0.5 / 0.5) = 0 a
token, and the model gives the unseen class all mass, 0 a token too.  Repeated rows are separate documents.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import seating
from .common import U64, by_bucket, by_key, chunks, drop, drop_part, pack, per_doc, read_texts, released, schema, shuffles_dropped, stored, table, texts, unpack

SAMPLES, BURN_IN = 3, 3
GROUP_BYTES, BUCKET_BYTES, REQUESTS = 9 << 20, 12 << 20, 4 << 20
#: Bytes of text whose words stand in one slice of the root.
SLICE_BYTES = 128 << 20
#: Words of the list by which group parts name words (2 bytes each), and bytes of text of the sample it is made from.
LISTED, LIST_BYTES = (1 << 16) - 1, 32 << 20
END, BEGIN = U64(0x0123456789ABCDEF), U64(0x13198A2E03707344)
LOW = (1 << 32) - 1
PIECES = T.ArrayType(T.StructType([T.StructField("to", T.IntegerType()), T.StructField("payload", T.BinaryType())]))
DOCS, PARTS, COUNTS, BUSY, REQUESTED, WORDS = range(6)
GROUPS = schema("bucket:int,gid:long,kind:int,payload:binary")
FOUND = schema("word:long,n:long")
ROOT = schema("slice:int,bucket:int,drawn:binary,seats:binary,sums:binary")
STATE = T.StructType([*schema("bucket:int,seats:binary").fields, T.StructField("rise", PIECES), T.StructField("sums", T.BinaryType())])
SUMS = schema("sums:binary")
ANSWERS = schema("gid:long,bucket:int,payload:binary")
SCORES = schema("doc_id:long,held_out:boolean,n_tokens:long,n_known:long,train_tokens:long,base_score:double,score:double")


def held_out(doc_ids) -> np.ndarray:
    return np.array([x is not None and zlib.crc32(str(x).encode()) % 5 == 1 for x in doc_ids], bool)


def tokens(c) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names (hashes of words, the end and the start, sorted), and for every token of a chunk the places of its word and of
    its context among them, and its document."""
    s, e, d = c.words(lower=True)
    n = len(c)
    words = np.bincount(d, minlength=n)
    at = np.arange(len(s)) + d  # every earlier document has an end token
    ends = np.cumsum(words) + np.arange(n)
    h = np.empty(len(s) + n + 1, U64)
    h[at], h[ends], h[-1] = c.hashes(s, e), END, BEGIN
    doc = np.empty(len(h) - 1, np.int64)
    doc[at], doc[ends] = d, np.arange(n)
    names, code = np.unique(h, return_inverse=True)
    ctx = np.empty(len(doc), np.int64)
    ctx[1:] = code[:-2]
    ctx[np.append(0, ends[:-1] + 1)] = code[-1]
    return names, code[:-1], ctx, doc


def _dealt(names: np.ndarray, n: int) -> np.ndarray:
    """The places of hashes among n equal ranges; it rises with the hash."""
    return (((names >> U64(32)) * U64(n)) >> U64(32)).astype(np.int64)


def _ranges(place: np.ndarray):
    """Runs of equal places: (place, start, end)."""
    where, at = np.unique(place, return_index=True)
    return zip(where.tolist(), at.tolist(), [*at[1:].tolist(), len(place)])


def _gaps(sorted_names: np.ndarray) -> np.ndarray:
    """Sorted hashes as differences: their high bytes are zeros."""
    return np.diff(sorted_names, prepend=U64(0))


def _bytes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of mostly two bytes as high and low ones, which compress better apart."""
    return x >> 8, x & 255


def listed(docs: DataFrame, size: int) -> np.ndarray:
    """The words that stand in most contexts of a sample of the texts, most first."""

    def run(batches):
        for b in batches:
            for c in chunks(b.column(1)):
                names, code, ctx, _ = tokens(c)
                n = np.bincount(np.unique(ctx << 32 | code) & LOW, minlength=len(names))
                yield table(FOUND, word=names[n > 0].view(np.int64), n=n[n > 0])

    some = docs.sample(min(1.0, LIST_BYTES / max(size, 1)), seed=0)
    top = texts(some).mapInArrow(released(run), FOUND).groupBy("word").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "word").limit(LISTED)
    return np.array([r.word for r in top.collect()], np.int64).view(U64)


def _places(names: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The places of hashes in the list, from one; 0: not listed."""
    if not len(known):
        return np.zeros(len(names), np.int64)
    order = np.argsort(known)
    at = order[np.minimum(np.searchsorted(known, names, sorter=order), len(known) - 1)]
    return np.where(known[at] == names, at + 1, 0)


def _part(data: bytes, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, words, and the places of both and the count of every pair of a group's part."""
    ctx, per, high, low, rest, count = unpack(data)
    at = high << 8 | low
    word = np.empty(len(at), U64)
    word[at > 0], word[at == 0] = known[at[at > 0] - 1], rest
    names, place = np.unique(word, return_inverse=True)
    return np.cumsum(ctx, dtype=U64), names, np.repeat(np.arange(len(per)), per), place, count


def groups(docs: DataFrame, buckets: int, known: np.ndarray) -> DataFrame:
    def run(batches):
        seq, part = 0, TaskContext.get().partitionId()
        for b in batches:
            for c in chunks(b.column(1), GROUP_BYTES):
                ids = b.column(0).slice(c.lo, len(c)).to_pylist()
                out = held_out(ids)
                names, code, ctx, doc = tokens(c)
                pair, code = np.unique(ctx << 32 | code, return_inverse=True)
                count = np.bincount(code[~out[doc]], minlength=len(pair))
                owner, word = pair >> 32, pair & LOW
                rows, at = [], _places(names, known)[word]
                for k, i, j in _ranges(_dealt(names, buckets)[owner]):
                    own, per = np.unique(owner[i:j], return_counts=True)
                    rows.append((k, PARTS, pack(_gaps(names[own]), per, *_bytes(at[i:j]), names[word[i:j][at[i:j] == 0]], count[i:j])))
                null = np.array([x is None for x in ids])
                # scores are sums, so a document's tokens need no order: the documents of each pair's tokens are kept
                blob = pack(np.array([0 if x is None else x for x in ids], np.int64).view(U64), null, *_bytes(doc[np.argsort(code, kind="stable")]), np.bincount(code, minlength=len(pair)))
                rows.append(((part + seq) % buckets, DOCS, blob))
                bucket, kind, payload = zip(*rows)
                yield table(GROUPS, bucket=bucket, gid=[(part << 32) + seq] * len(rows), kind=kind, payload=payload)
                seq += 1

    return texts(docs).mapInArrow(released(run), GROUPS)


def _added(held: tuple, more: list[tuple]) -> tuple:
    """Contexts, words, keys of pairs (places of context and word) and counts, with some parts added."""
    ctx, old = np.unique(np.concatenate([held[0], *(x[0] for x in more)]), return_inverse=True)
    word, old_word = np.unique(np.concatenate([held[1], *(x[1] for x in more)]), return_inverse=True)
    keys, i, j = [old[held[2] >> 32] << 32 | old_word[held[2] & LOW]], len(held[0]), len(held[1])
    for x in more:
        keys.append(old[i + x[2]] << 32 | old_word[j + x[3]])
        i, j = i + len(x[0]), j + len(x[1])
    key, which = np.unique(np.concatenate(keys), return_inverse=True)
    return ctx, word, key, np.bincount(which, np.concatenate([held[3], *(x[4] for x in more)]), len(key)).astype(np.int64)


def bucket_counts(grouped: DataFrame, buckets: int, slices: int, known: np.ndarray) -> DataFrame:
    """Per bucket its pairs' places and counts, those with seats to draw, its words for each slice of the root, and for each
    group the places of the group's pairs; the groups' documents pass through."""

    def row(bucket, gid, kind, payload):
        return table(GROUPS, bucket=[bucket], gid=[gid], kind=[kind], payload=[payload])

    def run(batches):
        for all_ in by_bucket(batches):
            for x in all_:
                if x[1] == DOCS:
                    yield row(x[3], x[0], DOCS, x[2])
            own = [x for x in all_ if x[1] == PARTS]
            if not own:
                continue
            held = np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            for i in range(0, len(own), 16):
                held = _added(held, [_part(x[2], known) for x in own[i : i + 16]])
            names, words, key, count = held
            ctx, word = key >> 32, key & LOW
            many = count > 1
            yield row(own[0][3], 0, COUNTS, pack(np.bincount(ctx, minlength=len(names)), word, count))
            # a context without pairs to draw has a table a customer; how many there are of each size is enough
            single, per = np.bincount(ctx, count == 1, len(names)).astype(np.int64), np.bincount(ctx[many], minlength=len(names))
            idle, times = np.unique(single[per == 0], return_counts=True)
            drawn, place = np.unique(word[many], return_inverse=True)
            yield row(own[0][3], 0, BUSY, pack(_gaps(names[per > 0]), single[per > 0], per[per > 0], _gaps(words[drawn]), place, count[many], idle, times))
            asks = np.zeros(len(words), bool)
            asks[drawn] = True
            rise, raw = np.bincount(word, count > 0, len(words)).astype(np.int64), np.bincount(word, count, len(words)).astype(np.int64)
            for k, i, j in _ranges(_dealt(words, slices)):
                yield row(k, own[0][3], WORDS, pack(_gaps(words[i:j]), rise[i:j], raw[i:j], asks[i:j]))
            gids, sizes, asked, n = [], [], [], 0
            for i, x in enumerate(own):
                own_ctx, own_word, a, z, _ = _part(x[2], known)
                p = np.searchsorted(key, np.searchsorted(names, own_ctx)[a] << 32 | np.searchsorted(words, own_word)[z])
                gids.append(x[0]), sizes.append(len(p)), asked.append(np.diff(p, prepend=-1))
                n += len(p)
                if n >= REQUESTS or i == len(own) - 1:
                    requests = pack(np.array(gids, np.int64).view(U64), np.array(sizes), np.concatenate(asked))
                    yield row(x[3], i, REQUESTED, requests)
                    gids, sizes, asked, n = [], [], [], 0

    return grouped.repartition(buckets, "bucket").mapInArrow(released(run), GROUPS)


class _Root:
    """What all tasks know of the root: its totals, its drawn measure's parts, and the parameters of both levels."""

    def __init__(self, sums: np.ndarray, level0: tuple[float, float], level1: tuple[float, float], number: int):
        self.weights, (self.c0, self.t0, self.words, self.n) = float(sums[0]), (int(x) for x in sums[1:5])
        self.level0, self.level1, self.number = level0, level1, number
        discount, strength = level0
        self.rest = float(seating.gammas(np.array([strength + discount * self.t0]), np.full(1, number << 8 | 5, U64))[0])

    def measure(self, drawn: np.ndarray) -> np.ndarray:
        """The words' probabilities in the drawn measure."""
        return (drawn + self.rest / (self.words + 1)) / (self.weights + self.rest)

    def mass(self, number: int) -> float:
        """The gamma variable of the root's restaurant for its next seats."""
        discount, strength = self.level0
        return float(seating.gammas(np.array([strength / discount + self.t0]), np.full(1, number << 8 | 6, U64))[0])

    def predict(self, c0: np.ndarray, t0: np.ndarray) -> np.ndarray:
        """Predictive probabilities of the root's words."""
        discount, strength = self.level0
        return (c0 - discount * t0 + (strength + discount * self.t0) / (self.words + 1)) / (strength + self.c0)


def _summed(df: DataFrame) -> np.ndarray:
    """The sum of vectors: by partition, then of the partitions."""

    def run(batches):
        v = [unpack(x.as_py())[0] for b in batches for x in b.column(0)]
        if v:
            yield table(SUMS, sums=[pack(np.sum(v, 0))])

    rows = df.where("sums is not null").select("sums").mapInArrow(released(run), SUMS).collect()
    return np.sum([unpack(bytes(r.sums))[0] for r in rows], 0) if rows else np.zeros(5 + len(seating.DISCOUNTS))


def root_seats(words: DataFrame, rise: DataFrame | None, slices: int, last: _Root | None, number: int) -> DataFrame:
    """The root's seats and drawn measure for the words of each bucket, and sums.  words: the buckets' words with the
    contexts they occur in; rise: the tables that dishes have beyond their first; last: the root's state before."""
    rows = words if rise is None else words.unionByName(rise)
    level = last.level0 if last else seating.START
    mass, known = (last.mass(number), last.words) if last else (0.0, 0)

    def run(batches):
        for own in by_bucket(batches):
            gids, names, c, raw, asks = [], [], [], [], []
            for gid, kind, data, _ in own:
                x = unpack(data)
                if kind == 0:
                    gids.append(gid), names.append(np.cumsum(x[0], dtype=U64)), c.append(x[1]), raw.append(x[2]), asks.append(x[3] > 0)
                else:
                    c[-1][asks[-1]] += x[0]
            ends = np.cumsum([0, *map(len, names)]).tolist()
            name, at = np.unique(np.concatenate(names), return_inverse=True)
            c, raw = (np.bincount(at, np.concatenate(x), len(name)).astype(np.int64) for x in (c, raw))
            t = seating.root_tables(name, c, mass, known, *level, number) if last else np.minimum(c, 1)
            drawn = seating.root_weights(name, c, t, level[0], number)
            for gid, i, j, a in zip(gids, ends, ends[1:], asks):
                w = at[i:j]
                yield table(ROOT, slice=[own[0][3]], bucket=[gid], drawn=[pack(drawn[w[a]])], seats=[pack(c[w], t[w], raw[w])], sums=[None])
            sums = np.concatenate([[drawn.sum(), c.sum(), t.sum(), (raw > 0).sum(), raw.sum()], seating.dish_logs(c, t)])
            yield table(ROOT, slice=[own[0][3]], bucket=[None], drawn=[None], seats=[None], sums=[pack(sums)])

    return rows.repartition(slices, "bucket").mapInArrow(released(run), ROOT)


def _row(df: DataFrame, kind: int, payload: str, gid=None) -> DataFrame:
    return df.select(F.col("bucket").cast("int").alias("bucket"), (F.lit(0) if gid is None else gid).cast("long").alias("gid"), F.lit(kind).alias("kind"), F.col(payload).alias("payload"))


def swept(held: DataFrame, root: DataFrame, known: _Root, state: DataFrame | None, buckets: int, slices: int) -> DataFrame:
    """One sweep over all contexts: their seats, the tables beyond the first by word for the root, and sums."""
    rows = _row(held.where(F.col("kind") == BUSY), 0, "payload").unionByName(_row(root.where("bucket is not null"), 1, "drawn", F.col("slice")))
    if state is not None:
        rows = rows.unionByName(_row(state, 2, "seats"))

    def run(batches):
        for own in by_bucket(batches):
            by = {k: [x[2] for x in own if x[1] == k] for k in (0, 1, 2)}
            names, single, per, words, place, c, idle, times = unpack(by[0][0])
            words = np.cumsum(words, dtype=U64)
            x = seating.Contexts(np.cumsum(names, dtype=U64), single, np.repeat(np.arange(len(per)), per), words[place], c)
            if by[2]:
                x.t = unpack(by[2][0])[0]
            drawn = np.concatenate([unpack(d)[0] for d in by[1]])
            x.sweep(known.measure(drawn)[place], *known.level1, known.number)
            rise = np.bincount(place, x.t - 1, len(words)).astype(np.int64)
            to = [{"to": k, "payload": pack(rise[i:j])} for k, i, j in _ranges(_dealt(words, slices))]
            customers, tables = np.concatenate([x.customers(), idle]), np.concatenate([x.tables(), idle])
            logs = seating.restaurant_logs(customers, tables, np.concatenate([np.ones(len(names)), times]))
            yield table(STATE, bucket=[own[0][3]], seats=[pack(x.t)], rise=[to], sums=[pack(np.concatenate([seating.dish_logs(x.c, x.t), logs.ravel()]))])

    return rows.repartition(buckets, "bucket").mapInArrow(released(run), STATE)


def answers(held: DataFrame, kept: list[tuple[DataFrame, DataFrame, _Root]], buckets: int) -> DataFrame:
    """For each group and bucket the logarithms of the group's pairs under the kept states and their words' counts."""
    rows = _row(held.where(F.col("kind") == COUNTS), 0, "payload").unionByName(_row(held.where(F.col("kind") == REQUESTED), 1, "payload", F.col("gid")))
    for s, (state, root, _) in enumerate(kept):
        rows = rows.unionByName(_row(state, 2, "seats", F.lit(s))).unionByName(_row(root.where("bucket is not null"), 3, "seats", F.col("slice") + F.lit(s << 32)))
    known = [x for _, _, x in kept]

    def run(batches):
        for own in by_bucket(batches):
            by = {k: [(x[0], x[2]) for x in own if x[1] == k] for k in range(4)}
            per, word, count = unpack(by[0][0][1])
            ctx, many, p = np.repeat(np.arange(len(per)), per), count > 1, 0.0
            c1 = np.bincount(ctx, count, len(per))
            for s, state in by[2]:
                c0, t0, raw = (np.concatenate(x) for x in zip(*(unpack(d) for g, d in by[3] if g >> 32 == s)))
                t = np.minimum(count, 1)
                t[many] = unpack(state)[0]
                discount, strength = known[s].level1
                back = (strength + discount * np.bincount(ctx, t, len(per))) / (strength + c1)
                p = p + (count - discount * t) / (strength + c1)[ctx] + back[ctx] * known[s].predict(c0, t0)[word]
            logs, raw = np.log10(p / len(known)).astype(np.float32), raw[word]
            for _, data in by[1]:
                gids, sizes, q = unpack(data)
                ends = np.cumsum(sizes).tolist()
                for g, i, j in zip(gids.view(np.int64).tolist(), [0, *ends], ends):
                    at = np.cumsum(q[i:j]) - 1
                    yield table(ANSWERS, gid=[g], bucket=[own[0][3]], payload=[pack(logs[at], raw[at])])

    return rows.repartition(buckets, "bucket").mapInArrow(released(run), ANSWERS)


def sampled(held: DataFrame, buckets: int, slices: int, samples: int, burn_in: int) -> list[tuple[DataFrame, DataFrame, _Root]]:
    """The kept states: the contexts' seats, the root's, and what all tasks know."""
    spark, kept = held.sparkSession, []
    rise = lambda df: df.select("bucket", F.explode("rise").alias("x")).select(F.col("x.to").alias("bucket"), F.col("bucket").cast("long").alias("gid"), F.lit(1).alias("kind"), F.col("x.payload").alias("payload"))
    words = _row(held.where(F.col("kind") == WORDS), 0, "payload", F.col("gid"))
    root, state, grid = stored(root_seats(words, None, slices, None, 0), spark), None, len(seating.DISCOUNTS)
    known = _Root(_summed(root)[:5], seating.START, seating.START, 0)
    for i in range(1, burn_in + samples + 1):
        old = [x for x in (root, state) if x is not None and not any(x is y for k in kept for y in k)]
        state = stored(swept(held, root, known, state, buckets, slices), spark)
        root = stored(root_seats(words, rise(state), slices, known, i), spark)
        up, own = _summed(state), _summed(root)
        level1 = seating.drawn_parameters(up[:grid], up[grid:].reshape(grid, -1), i << 8 | 7) if len(up) > grid + 5 else seating.START
        level0 = seating.drawn_parameters(own[5:], seating.restaurant_logs(own[1:2].astype(np.int64), own[2:3].astype(np.int64), np.ones(1)), i << 8 | 8)
        known = _Root(own[:5], level0, level1, i)
        for x in old:
            drop(spark, x)
        if i > burn_in:
            kept.append((state, root, known))
    return kept


def score_texts(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, samples: int = SAMPLES, burn_in: int = BURN_IN) -> DataFrame:
    """The fixed base score and the model's score of every whole text; see the module."""
    spark = docs.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(4, min(cores, size >> 20), -(-size // bucket_bytes))
    slices = max(1, min(cores, size >> 20), -(-size // SLICE_BYTES))
    with shuffles_dropped(spark):
        known = listed(docs, size)
        held = stored(bucket_counts(groups(docs, buckets, known), buckets, slices, known), spark, "uncompressed", by="kind")
        kept = sampled(held, buckets, slices, samples, burn_in)
        drop_part(spark, held, f"kind={BUSY}", f"kind={WORDS}")
        replies = stored(answers(held, kept, buckets), spark, "uncompressed")
        drop_part(spark, held, f"kind={COUNTS}", f"kind={REQUESTED}")
        for state, root, _ in kept:
            drop(spark, state)
            drop(spark, root)
    n, words = kept[-1][2].n, kept[-1][2].words

    def finish(rows: list[bytes]) -> dict:
        """The documents of one group from its own row and the answers of the buckets, in order."""
        ids, null, high, low, times = unpack(rows[0])
        logs, raw = (np.concatenate(x) for x in zip(*(unpack(x) for x in rows[1:])))
        ids = [None if z else int(i) for i, z in zip(ids.view(np.int64), null)]
        doc, m, base = high << 8 | low, len(ids), np.log10((raw + 0.5) / (n + 0.5 * (words + 1)))
        sums = lambda x: np.bincount(doc, np.repeat(x.astype(float), times), m)
        return dict(doc_id=ids, held_out=held_out(ids), n_tokens=np.bincount(doc, minlength=m), n_known=per_doc(np.repeat(raw > 0, times), doc, m), train_tokens=np.full(m, n), base_score=sums(base), score=sums(logs))

    def run(batches):
        for _, t in by_key(batches, ["gid"]):
            order = np.argsort(t["bucket"].to_numpy(), kind="stable")
            yield table(SCORES, **finish([t["payload"][int(i)].as_py() for i in order]))

    own = held.where(F.col("kind") == DOCS).select("gid", F.lit(-1).alias("bucket"), "payload")
    both = own.unionByName(replies)
    return both.repartition(max(1, -(-size // (4 * GROUP_BYTES)), cores), "gid").sortWithinPartitions("gid").mapInArrow(released(run), SCORES)


def op2_pitman_yor(spark, sf_dir: str) -> DataFrame:
    return score_texts(read_texts(spark, sf_dir))

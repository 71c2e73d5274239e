"""Operator 4: exact top-k inner products by dual-tree search over cover trees.

The top level of both trees is shared: pivots, chosen farthest-first from a bounded sample (POOL rows), and every row in
the cell of its nearest pivot; for queries, of the first few pivots, so that their cells are as large as a block.  A cell
has an exact covering radius for its candidates and one for its queries.  Below
it, a task holds one pair of cells (or of parts of them, dealt by hash, where a cell is large) and builds a tree over
each side: a node's children are centres chosen farthest-first, every point goes to its nearest centre, and a node keeps
its exact covering radius.  A pair of cells or nodes is dropped when

    <cq, cr> + Rq |cr| + Rr |cq| + Rq Rr

is below the worst kth score of the queries there.  That score is known across tasks: first each query cell is searched
in the candidate cell with the best bound, and the kth scores found there go with the queries to the pairs of cells that
they don't rule out; to the others no row is sent.  Leaf pairs are scored as integer products.  Each task emits its k
best rows per query that reach the query's kth score, and the k best of all are kept: ties go to the smaller id.

Defined cases.  Vectors that are null, empty or hold a null or non-finite component, and rows with a null id, take no
part.  Vectors of different lengths are compared over their common components (the rest count as zero).  Rows with a
repeated id are rows like others: each is a query if its id is one, and a candidate of its twins.  Fewer than k
candidates: all of them.  Empty table: no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_key, read, released, schema, stored, table

K, SCALE, EVERY, BLOCK, QUERIES, LEAF, FAN = 5, 256, 50, 16384, 8192, 128, 16
#: Most cells, and the rows that the pivots are chosen from.
CELLS, POOL = 1024, 4096
FOUND = schema("query:long,query_id:long,vec_id:long,score:long")
PLACED = schema("rid:long,vec_id:long,v:doubles,cell:int,dist:double")
_LOW = np.int64(-(1 << 62))


class CoverTree:
    """Nodes in lists: centre, radius, children; leaves hold rows of x."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF, fan: int = FAN):
        self.x, self.leaf, self.fan = x, leaf, fan
        self.centre, self.norm, self.radius, self.child, self.rows = [], [], [], [], []
        if len(x):
            self._grow(np.arange(len(x)), x[0])

    def _grow(self, rows: np.ndarray, centre: np.ndarray) -> int:
        at = len(self.centre)
        p = self.x[rows]
        d = ((p - centre) ** 2).sum(1)
        radius = math.sqrt(d.max())
        self.centre.append(centre), self.norm.append(float(np.linalg.norm(centre))), self.radius.append(radius * (1 + 1e-9)), self.child.append([]), self.rows.append(rows)
        if len(rows) <= self.leaf or radius == 0:
            return at
        near, best, centres = np.zeros(len(rows), np.int32), d, [centre]
        while len(centres) < self.fan and best.max() > d.max() / 16:
            c = p[int(best.argmax())]
            e = ((p - c) ** 2).sum(1)
            closer = e < best
            near[closer] = len(centres)
            best = np.where(closer, e, best)
            centres.append(c)
        for i, c in enumerate(centres):
            own = rows[near == i]
            if len(own):
                self.child[at].append(self._grow(own, c))
        self.rows[at] = None
        return at


def dual_search(qid: np.ndarray, q: np.ndarray, crow: np.ndarray, cid: np.ndarray, c: np.ndarray, floor: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, candidate id, score) of each query's k best candidates other than its own row.  qid and crow
    are numbers of rows, cid ids; integer-valued arrays.  Nothing below a query's floor is sought."""
    order = np.argsort(cid, kind="stable")
    crow, cid, c = crow[order], cid[order], c[order]
    reach = max(1.0, float(np.sqrt((q**2).sum(1).max() * (c**2).sum(1).max())) if len(q) and len(c) else 1.0)
    shift = max(1, int(len(cid)).bit_length())
    if not reach * 2.0**shift < 2.0**52:  # too large for exact doubles with the position beside the score
        return _plain(qid, q, crow, cid, c, k)
    a, b = CoverTree(q), CoverTree(c)
    best = np.full((len(q), k), _LOW, np.int64)  # score * 2^shift + (2^shift - 1 - position): ties to the smaller id
    top_score = int(reach) + 1
    least = np.where(floor < -top_score, _LOW, np.clip(floor, -top_score, top_score) << shift)  # the smallest key of interest
    top = (1 << shift) - 1

    def leaves(i: int, j: int) -> None:
        r, s = a.rows[i], b.rows[j]
        key = (q[r] @ c[s].T).astype(np.int64) * (1 << shift) + (top - s)
        key[qid[r][:, None] == crow[s][None, :]] = _LOW
        better = np.flatnonzero(key.max(1) >= np.maximum(best[r, -1] + 1, least[r]))
        if len(better):
            both = np.concatenate([best[r[better]], key[better]], 1)
            both.partition(both.shape[1] - k, axis=1)
            best[r[better]] = -np.sort(-both[:, -k:], axis=1)

    def worst(i: int) -> float:
        w = worst_of[i]
        if w is None:  # what the queries bring along
            w = worst_of[i] = whole(int(least[a.rows[i]].min())) if a.rows[i] is not None else min(worst(x) for x in a.child[i])
        return w

    worst_of: list[float | None] = [None] * len(a.centre)
    whole = lambda key: -math.inf if key == _LOW else float(key >> shift)

    def bounds(i: int, js: list[int]) -> np.ndarray:
        dots = np.stack([b.centre[j] for j in js]) @ a.centre[i]
        rr, nn = np.array([b.radius[j] for j in js]), np.array([b.norm[j] for j in js])
        return dots + a.radius[i] * nn + rr * a.norm[i] + a.radius[i] * rr + 1e-6 * reach

    def visit(i: int, j: int, bound: float) -> None:
        if bound < worst(i):
            return
        if a.child[i]:
            for x in a.child[i]:
                visit(x, j, float(bounds(x, [j])[0]))
            ws = [worst(x) for x in a.child[i]]
            worst_of[i] = min(ws)
        elif b.child[j]:
            bs = bounds(i, b.child[j])
            for n in np.argsort(-bs, kind="stable").tolist():
                visit(i, b.child[j][n], float(bs[n]))
        else:
            leaves(i, j)
            worst_of[i] = whole(int(np.maximum(best[a.rows[i], -1], least[a.rows[i]]).min()))

    if len(q) and len(c):
        visit(0, 0, math.inf)
    r, col = np.nonzero((best > _LOW) & (best >= least[:, None]))
    key = best[r, col]
    return r, cid[top - (key & top)], key >> shift


def _plain(qid, q, crow, cid, c, k):
    """Every score as a Python integer, for values whose products exceed exact doubles; scores saturate at 64 bits."""
    out, cs = [], [[int(x) for x in v] for v in c]
    for i, (row, v) in enumerate(zip(qid.tolist(), q)):
        v = [int(x) for x in v]
        got = sorted((-sum(map(int.__mul__, v, w)), j) for own, j, w in zip(crow.tolist(), cid.tolist(), cs) if own != row)[:k]
        out += [(i, j, max(-(1 << 63), min((1 << 63) - 1, -s))) for s, j in got]
    a = np.array(out, dtype=np.int64).reshape(-1, 3)
    return a[:, 0], a[:, 1], a[:, 2]


def _matrix(col, width: int | None = None) -> np.ndarray:
    """An Arrow column of lists as a matrix, short rows filled with zeros."""
    v = col.combine_chunks() if hasattr(col, "combine_chunks") else col
    flat, n = v.flatten().to_numpy(), np.diff(v.offsets.to_numpy())
    x = np.zeros((len(n), width or int(n.max(initial=1))))
    x[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return x


def _pivots(vectors: DataFrame, n: int, width: int, most: int) -> np.ndarray:
    """Up to `most` centres, farthest-first, from a sample of about POOL of the n rows by their hashes."""
    share = min(1.0, POOL / max(1, n))
    rows = vectors.where(F.pmod(F.xxhash64("rid", F.lit(3)), F.lit(1 << 32)) < int(share * (1 << 32))).select("v").limit(2 * POOL).collect()
    x = np.zeros((max(1, len(rows)), width))
    for i, r in enumerate(rows):
        x[i, : len(r.v)] = r.v
    with np.errstate(over="ignore", invalid="ignore"):
        chosen, best = [0], ((x - x[0]) ** 2).sum(1)
        while len(chosen) < min(most, len(rows)) and best.max() > 0:
            chosen.append(int(best.argmax()))
            best = np.minimum(best, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def _placed(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """The rows with the cell of their nearest pivot and the distance to it."""
    width, norm = pivots.shape[1], (pivots**2).sum(1)

    def run(batches):
        for b in batches:
            x = _matrix(b.column(2), width)
            with np.errstate(over="ignore", invalid="ignore"):
                cell = np.argmin(norm[None, :] - 2 * (x @ pivots.T), 1).astype(np.int32)
                dist = np.sqrt(((x - pivots[cell]) ** 2).sum(1)) * (1 + 1e-9)
            yield table(PLACED, rid=b.column(0), vec_id=b.column(1), v=b.column(2), cell=cell, dist=np.nan_to_num(dist, nan=np.inf, posinf=np.inf))

    return vectors.select("rid", "vec_id", "v").mapInArrow(released(run), PLACED)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK, query_block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id and score; both tables hold (rid long, vec_id long, v array<double> of whole numbers).
    rid numbers rows: a query is no candidate of its own row."""
    spark = vectors.sparkSession
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    pivots = _pivots(vectors, size.n, size.width or 1, min(CELLS, max(1, math.ceil(size.n / block))))
    asked = pivots[: max(1, math.ceil(queries.count() / query_block))]  # a candidate is sent once to each cell of queries
    vectors, queries = stored(_placed(vectors, pivots), spark), stored(_placed(queries, asked), spark)
    # per cell (CELLS at most): rows and covering radius
    cells = lambda df: {r.cell: (r.n, r.radius) for r in df.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("radius")).collect()}
    cand, ask = cells(vectors), cells(queries)
    qs, cs = np.array(sorted(ask), np.int64), np.array(sorted(cand), np.int64)
    rq, rc = np.array([ask[x][1] for x in qs.tolist()]), np.array([cand[x][1] for x in cs.tolist()])
    with np.errstate(over="ignore", invalid="ignore"):
        norm = np.sqrt((pivots**2).sum(1))
        bound = pivots[qs] @ pivots[cs].T + rq[:, None] * norm[cs] + rc * norm[qs][:, None] + rq[:, None] * rc
        bound = np.nan_to_num(bound + 1e-6 * (1 + np.abs(bound)), nan=np.inf, posinf=np.inf)
    first = cs[bound.argmax(1)] if len(cs) and len(qs) else np.zeros(0, np.int64)
    best = dict(zip(qs.tolist(), first.tolist()))
    split = lambda n, most: max(1, math.ceil(n / most))
    home = lambda col, salt: F.pmod(F.xxhash64("rid", F.lit(salt)), F.col(col)).cast("int")
    every = lambda col: F.explode(F.sequence(F.lit(0), F.col(col) - 1))

    def tiles(asking: DataFrame, pairs: list[tuple[int, int]], begin: bool) -> DataFrame:
        rows = [(x, y, split(ask[x][0], query_block), split(cand[y][0], block), best[x] == y) for x, y in pairs]
        near = spark.createDataFrame(rows, "qc int, cc int, qn int, cn int, first boolean")
        left = vectors.join(near, vectors["cell"] == near["cc"]).withColumn("cb", home("cn", 1)).withColumn("qb", every("qn")).withColumn("asks", F.lit(False)).withColumn("floor", F.lit(None).cast("long"))
        right = asking.join(near, asking["cell"] == near["qc"]).withColumn("qb", home("qn", 2)).withColumn("cb", every("cn")).withColumn("asks", F.lit(True))
        own = ["qc", "cc", "cb", "qb"]
        cols = [*own, "rid", "vec_id", "v", "asks", "floor"]
        done = F.col("first") & (F.col("cb") == 0)
        met = left.where(done if begin else ~done).select(*cols).unionByName(right.where(done if begin else ~done).select(*cols))

        def run(batches):
            for _, t in by_key(batches, own):
                t = t.combine_chunks()
                rid, ids, asks = t["rid"].to_numpy(), t["vec_id"].to_numpy(), t["asks"].to_numpy(zero_copy_only=False)
                if asks.all() or not asks.any():
                    continue
                x, floor = _matrix(t["v"]), t["floor"].fill_null(_LOW).to_numpy()
                r, b, s = dual_search(rid[asks], x[asks], rid[~asks], ids[~asks], x[~asks], floor[asks], k)
                yield table(FOUND, query=rid[asks][r], query_id=ids[asks][r], vec_id=b, score=s)

        return met.repartition(*own).sortWithinPartitions(*own).mapInArrow(released(run), FOUND)

    if not best:
        found = spark.createDataFrame([], FOUND)
    else:
        start = stored(tiles(queries.withColumn("floor", F.lit(None).cast("long")), list(best.items()), True), spark)
        kth = start.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
        asking = stored(queries.join(kth, queries["rid"] == kth["query"], "left").drop("query"), spark)
        worst = {r.cell: r.w for r in asking.groupBy("cell").agg(F.when(F.count("floor") == F.count("*"), F.min("floor")).alias("w")).collect()}
        more = [(x, y) for i, x in enumerate(qs.tolist()) for j, y in enumerate(cs.tolist()) if worst[x] is None or not bound[i, j] < worst[x]]
        found = start.unionByName(tiles(asking, more, False))
    top = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).drop("query")


def whole_vectors(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """(rid, vec_id, v): floor(scale * component) of the vectors that take part, and a number for each row."""
    ok = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    # floor() of a double is a long in Spark; for large values the double itself is whole.
    part = lambda x: F.when(F.abs(scale * x.cast("double")) < 2.0**53, F.floor(scale * x.cast("double")).cast("double")).otherwise(scale * x.cast("double"))
    v = df.where(F.col("vec_id").isNotNull() & F.coalesce(ok, F.lit(False)))
    return stored(v.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", part).alias("v")), df.sparkSession)


def op4_dual_tree_topk(spark, sf_dir: str) -> DataFrame:
    v = whole_vectors(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    out = top_k(v, v.where(F.col("vec_id") % EVERY == 0))
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = f"""
with v as (select row_number() over () rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)) v from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.rid query, q.vec_id query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint score from v q, v c where q.vec_id % {EVERY} = 0 and q.rid <> c.rid),
r as (select *, row_number() over (partition by query order by score desc, vec_id)::int "rank" from s)
select query_id, "rank", vec_id, score from r where "rank" <= {K}"""

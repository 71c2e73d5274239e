"""Operator 3: quality rules with an isolation forest on rule statistics.

Each whole text gives fixed counts; their ratios are the forest's features.  The trees are grown on the driver from a
bounded sample (about POOL rows by their hashes, 2 POOL at most; PSI rows to a tree), as the method has it; every row gets its
path length.  The threshold is calibrated on all labelled rows: from a histogram of scores by label, the score with
the largest gap between the shares of bad and of good rows rejected, among those that reject at most MAX_GOOD of the
good ones (labels are noisy, so a share of them sits on the wrong side wherever the threshold is).

Defined cases.  Null text: no words, so the fixed rule rejects it.  Empty table: no rows.  No labelled rows: only the
fixed rule rejects.  Repeated rows are scored alike.  Equal features give equal paths.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _SPACE, U64, chunks, mix, per_doc, read, read_texts, released, schema, small_batches, stored, table, texts

TREES, PSI, POOL, BINS, MAX_GOOD, SEED = 100, 256, 8192, 2000, 0.03, 17
WINDOW = 8
COUNTS = schema("doc_id:long,n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,n_lines:long,n_upper:long,n_digits:long,n_kinds:long")
_SYMBOL, _UPPER, _DIGITS = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[65:91] = True
_DIGITS[48:58] = True
_CHAR = ~_SPACE & ((np.arange(256) & 0xC0) != 0x80)


def _again(h: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For hashes in order of position: whether each occurs twice or more in its document, and whether it did earlier."""
    key = mix(h ^ mix(docs.astype(U64) + U64(1)))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key), bool)
    k = key[order]
    same[1:] = k[1:] == k[:-1]
    later = np.empty(len(key), bool)
    later[order] = same
    both = same.copy()
    both[:-1] |= same[1:]
    twice = np.empty(len(key), bool)
    twice[order] = both
    return twice, later


def counts(chunk) -> dict[str, np.ndarray]:
    """The rule counts of every document of a chunk."""
    n, buf = len(chunk), chunk.buf
    s, e, d = chunk.words()
    edges = np.zeros(n, np.int64)
    total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[chunk.offs]) if len(buf) else edges
    h = chunk.hashes(s, e)
    words = per_doc(np.ones(len(d)), d, n)
    out = {"n_words": words, "word_chars": total(_CHAR[buf]), "n_symbols": total(_SYMBOL[buf]), "n_upper": total(_UPPER[buf]), "n_digits": total(_DIGITS[buf])}
    # lines
    cut = np.zeros(len(buf) + 1, bool)
    cut[1:] = buf == 10
    cut[chunk.offs[:-1]] = True
    ls = np.flatnonzero(cut[: len(buf)])
    le = np.append(ls[1:], len(buf)) if len(ls) else ls
    ld = np.searchsorted(chunk.offs, ls, "right") - 1
    le = le - ((le > ls) & (buf[np.maximum(le - 1, 0)] == 10) if len(ls) else 0)
    filled = np.searchsorted(s, le) > np.searchsorted(s, ls)
    _, later = _again(chunk.hashes(ls[filled], le[filled]), ld[filled])
    out |= {"n_lines": per_doc(filled, ld, n), "n_dup_lines": per_doc(later, ld[filled], n)}
    # windows of 8 words
    repeated = np.zeros(len(h) + 1, np.int32)
    m = len(h) - WINDOW + 1
    if m > 0:
        w = np.zeros(m, U64)
        for i in range(WINDOW):
            w = w * U64(0xD6E8FEB86659FD93) + h[i : i + m]
        at = np.flatnonzero(d[:m] == d[WINDOW - 1 :])
        twice, _ = _again(w[at], d[at])
        hit = at[twice]
        np.add.at(repeated, hit, 1)
        np.add.at(repeated, hit + WINDOW, -1)
    out["n_repeat_words"] = per_doc(np.cumsum(repeated[:-1]) > 0, d, n)
    out["n_kinds"] = words - per_doc(_again(h, d)[1], d, n)
    return out


def rule_counts(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            for c in chunks(b.column(1)):
                yield table(COUNTS, doc_id=b.column(0).slice(c.lo, len(c)), **counts(c))

    return texts(docs).mapInArrow(released(run), COUNTS)


def features(get) -> np.ndarray:
    """Ratios of the counts, none of which depends on the length of an ordinary text."""
    f = {k: np.asarray(get(k), float) for k in COUNTS.names[1:]}
    w, c, l = np.maximum(f["n_words"], 1), np.maximum(f["word_chars"], 1), np.maximum(f["n_lines"], 1)
    return np.stack([f["word_chars"] / w, f["n_symbols"] / c, f["n_dup_lines"] / l, f["n_repeat_words"] / w, f["n_upper"] / c, f["n_digits"] / c], 1)


def _average(n: float) -> float:
    """Mean path length of an unsuccessful search among n points."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


class Forest:
    """Random splits over bounded samples; nodes of all trees in flat arrays."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, psi: int = PSI, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.psi = min(psi, len(rows))
        self.deep = max(1, int(np.ceil(np.log2(max(2, self.psi)))))
        feature, cut, left, size, self.roots = [], [], [], [], []

        def grow(x: np.ndarray, depth: int) -> int:
            at = len(feature)
            feature.append(-1), cut.append(0.0), left.append((0, 0)), size.append(depth + _average(len(x)))
            lo, hi = x.min(0), x.max(0)
            wide = np.flatnonzero(hi > lo)
            if depth < self.deep and len(x) > 1 and len(wide):
                f = int(rng.choice(wide))
                v = rng.uniform(lo[f], hi[f])
                go = x[:, f] < v
                if go.any() and not go.all():
                    feature[at], cut[at] = f, v
                    left[at] = grow(x[go], depth + 1), grow(x[~go], depth + 1)
            return at

        for _ in range(trees if len(rows) else 0):
            self.roots.append(grow(rows[rng.choice(len(rows), self.psi, replace=False)], 0))
        self.feature, self.cut, self.next, self.path = np.array(feature, np.int32), np.array(cut), np.array(left, np.int32).reshape(-1, 2), np.array(size)

    def score(self, x: np.ndarray) -> np.ndarray:
        """2^(-mean path / average path): near 1 for rows that few random splits isolate."""
        if not self.roots or not len(x):
            return np.zeros(len(x))
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for r in self.roots:
            at = np.full(len(x), r, np.int32)
            for _ in range(self.deep):
                f = self.feature[at]
                at = np.where(f < 0, at, self.next[at, (x[rows, np.maximum(f, 0)] >= self.cut[at]).astype(np.int8)])
            total += self.path[at]
        return 2.0 ** (-total / len(self.roots) / max(_average(self.psi), 1e-9))


FAILED = "n_words < 20 or 100 * n_repeat_words > 30 * n_words"


def fit(stats: DataFrame, labels: DataFrame) -> tuple[Forest, float]:
    """The forest and its threshold from the counts of all rows and the labelled rows (doc_id, quality)."""
    long = stats.where("n_words >= 20")
    share = POOL / max(1, long.count())  # of the hashes: about POOL rows come to the driver, however many tasks there are
    pool = long.where(F.pmod(F.xxhash64(*stats.columns), F.lit(1 << 32)) < int(min(1.0, share) * (1 << 32))).limit(2 * POOL).toPandas()
    forest = Forest(features(pool.__getitem__)) if len(pool) else Forest(np.zeros((0, 6)))
    known = stats.where(f"not ({FAILED})").join(labels.where("quality is not null").select("doc_id", "quality"), "doc_id").withColumn("score", scorer(forest)(*COUNTS.names[1:]))
    bins = known.groupBy(F.least(F.lit(BINS - 1), F.floor(F.col("score") * BINS)).alias("bin"), (F.col("quality") > 0).alias("good")).count().collect()
    good, bad = np.zeros(BINS), np.zeros(BINS)
    for r in bins:
        (good if r.good else bad)[r.bin] += r["count"]
    threshold = 2.0
    if good.sum() and bad.sum():
        lost, caught = (np.cumsum(x[::-1])[::-1] / x.sum() for x in (good, bad))  # by the first bin rejected
        threshold = float(np.argmax(np.where(lost <= MAX_GOOD, caught - lost, -1.0)) / BINS)
    return forest, threshold


def scorer(forest: Forest):
    """A column function of the counts."""
    names = COUNTS.names[1:]

    @F.pandas_udf("double")
    def score(*cols):
        import pandas as pd

        return pd.Series(forest.score(features(dict(zip(names, cols)).__getitem__)))

    return score


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, score and kept."""
    stats = stored(rule_counts(docs), docs.sparkSession)
    forest, threshold = fit(stats, labels)
    scored = stats.withColumn("base_failed", F.expr(FAILED)).withColumn("score", scorer(forest)(*COUNTS.names[1:]))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") < threshold))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that the rules and the forest keep, with their columns.  The rows are read and counted once: the counts
    go along with them in a scratch table, so no text is counted again or shuffled."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    import pyarrow as pa

    at, own = docs.columns.index("text"), "_counts"
    while own in docs.columns:
        own += "_"
    out = T.StructType([*docs.schema.fields, T.StructField(own, T.StructType(COUNTS.fields[1:]))])
    kinds = to_arrow_schema(out)
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            for c in chunks(b.column(at)):
                n = counts(c)
                fields = [pa.array(n[f.name], f.type) for f in kinds.field(own).type]
                yield pa.RecordBatch.from_arrays([*b.slice(c.lo, len(c)).columns, pa.StructArray.from_arrays(fields, fields=list(kinds.field(own).type))], schema=kinds)

    counted = stored(docs.mapInArrow(released(run), out), docs.sparkSession)
    key = F.col("doc_id").cast("long").alias("doc_id") if "doc_id" in docs.columns else F.lit(None).cast("long").alias("doc_id")
    forest, threshold = fit(counted.select(key, f"{own}.*"), labels)
    parts = [F.col(f"{own}.{n}") for n in COUNTS.names[1:]]
    failed = (F.col(f"{own}.n_words") < 20) | (100 * F.col(f"{own}.n_repeat_words") > 30 * F.col(f"{own}.n_words"))
    return counted.where(~failed).where(scorer(forest)(*parts) < threshold).select(*docs.columns)


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = judge(read_texts(spark, sf_dir), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")

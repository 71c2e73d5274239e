"""Statistics over tables of model scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .prefix import running_sum


def bits_per_byte(df: DataFrame, keys: list[str], nll: str = "nll", size: str = "n_bytes") -> DataFrame:
    return df.groupBy(*keys).agg((F.sum(nll) / (math.log(2) * F.sum(size))).alias("bpb"), F.sum(size).alias("n_bytes"))


def class_gap(scores: DataFrame, terms: DataFrame) -> DataFrame:
    """By class: mean surprisal of the terms less that of their controls (terms: term, class, control_term)."""
    per = scores.groupBy("term").agg(F.avg("surprisal").alias("s"))
    met = terms.join(per, "term").join(per.select(F.col("term").alias("control_term"), F.col("s").alias("c")), "control_term")
    return met.groupBy("class").agg(F.avg("s").alias("terms"), F.avg("c").alias("controls"), (F.avg("s") - F.avg("c")).alias("gap"), F.count("*").alias("n"))


def control_match(terms: DataFrame, candidates: DataFrame, field: str = "field") -> DataFrame:
    """For each term the candidate of the same field with the nearest log frequency; ties to the smaller word.  Candidates
    and terms are reduced to one row for each frequency; a frequency's nearest ones are then the last candidate before it
    and the first one after it, found by a window over the field's distinct frequencies, never by all pairs."""
    best = candidates.groupBy(field, F.col("cand_freq").alias("f")).agg(F.min("cand").alias("c"))
    asked = terms.select(field, F.col("freq").alias("f")).distinct()
    line = best.withColumn("asks", F.lit(0)).unionByName(asked.withColumn("asks", F.lit(1)), allowMissingColumns=True)
    one = F.when(F.col("asks") == 0, F.struct("f", "c"))
    w = Window.partitionBy(field)
    near = line.withColumn("low", F.last(one, True).over(w.orderBy("f", "asks"))).withColumn("high", F.last(one, True).over(w.orderBy(F.desc("f"), "asks"))).where("asks = 1")
    gap = lambda x: F.round(F.abs(F.log("f") - F.log(x["f"])), 12)
    pair = lambda x: F.when(x.isNotNull(), F.struct(gap(x).alias("gap"), x["c"].alias("cand")))
    found = near.select(field, F.col("f").alias("freq"), F.least(pair(F.col("low")), pair(F.col("high"))).alias("m")).where("m is not null")
    return terms.join(found, [field, "freq"]).select("term", field, F.col("m.cand").alias("control"), F.col("m.gap").alias("gap"))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def brier(df: DataFrame, keys: list[str], p: str = "p", y: str = "y") -> DataFrame:
    true = F.when(F.col(y) == 1, F.col(p)).otherwise(1 - F.col(p))
    return df.groupBy(*keys).agg(F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("brier"), F.avg(-F.log(true)).alias("log_score"), F.count("*").alias("n"))


def auc(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Area under the ROC curve by mid-ranks.  Rows are summed by score first; the running count over scores is in
    ranges, so no task sorts all rows."""
    per = df.groupBy(score).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    at = running_sum(per, score, "n", "below")
    mid = F.col("below") + (F.col("n") + 1) / 2
    s = at.agg(F.sum(mid * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    neg = F.col("n") - F.col("p")
    return s.select(((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / F.nullif(F.col("p") * neg, F.lit(0))).alias("auc"), F.col("p").alias("positives"), neg.alias("negatives"))


def _poisson(u: Column, most: int = 8) -> Column:
    total, out, p = 0.0, F.lit(most), math.exp(-1)
    cuts = []
    for k in range(most):
        total += p / math.factorial(k)
        cuts.append((k, total))
    for k, t in reversed(cuts):
        out = F.when(u < t, k).otherwise(out)
    return out


def bootstrap_means(df: DataFrame, key: str, value: str, replicates: int = 200) -> DataFrame:
    """(replicate, mean): Poisson(1) weights from a hash of item and replicate, so the draws don't depend on
    partitioning.  A task sums its rows into one row per replicate before the shuffle."""
    each = df.select(key, value, F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col("replicate").cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    w = each.withColumn("w", _poisson(u))
    return w.groupBy("replicate").agg((F.sum(F.col("w") * F.col(value)) / F.nullif(F.sum("w"), F.lit(0))).alias("mean"))


def interval(means: DataFrame, level: float = 0.95) -> DataFrame:
    """Lower and upper bound from the replicates at places floor(q * n)."""
    w = Window.orderBy("mean", "replicate")  # a few hundred rows
    r = means.select("mean", (F.row_number().over(w) - 1).alias("r"), F.count("*").over(Window.partitionBy()).alias("n"))
    place = lambda q: F.least(F.col("n") - 1, F.floor(F.lit(q) * F.col("n")))
    lo, hi = (1 - level) / 2, (1 + level) / 2
    return r.agg(F.max(F.when(F.col("r") == place(lo), F.col("mean"))).alias("lo"), F.max(F.when(F.col("r") == place(hi), F.col("mean"))).alias("hi"), F.avg("mean").alias("mean"), F.stddev_samp("mean").alias("sd"))


def detect_limit(per_epsilon: DataFrame, sigmas: float = 3.0) -> DataFrame:
    """(epsilon, mean, sd): the smallest share whose mean is `sigmas` deviations of the zero share above it."""
    zero = per_epsilon.where("epsilon = 0").select(F.col("mean").alias("m0"), F.col("sd").alias("s0"))
    met = per_epsilon.where("epsilon > 0").crossJoin(F.broadcast(zero)).where(F.col("mean") - F.col("m0") >= sigmas * F.col("s0"))  # one row
    return met.agg(F.min("epsilon").alias("epsilon"))


def regression(df: DataFrame, keys: list[str], y: str, x: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.count("*").alias("n"))


def residuals(df: DataFrame, y: str, x: str) -> DataFrame:
    fit = df.agg(F.regr_slope(y, x).alias("_a"), F.regr_intercept(y, x).alias("_b"))
    return df.crossJoin(F.broadcast(fit)).withColumn("residual", F.col(y) - F.col("_a") * F.col(x) - F.col("_b")).drop("_a", "_b")  # one row


def high_surprisal(df: DataFrame, keys: list[str], threshold: float, value: str = "surprisal") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg((F.col(value) > threshold).cast("double")).alias("high_share"), F.avg(value).alias("mean"), F.count("*").alias("n"))


def isotonic(df: DataFrame, x: str = "score", y: str = "label"):
    """A monotone calibration model (pyspark.ml)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    rows = VectorAssembler(inputCols=[x], outputCol="_x").transform(df.select(F.col(x).cast("double"), F.col(y).cast("double")))
    return IsotonicRegression(featuresCol="_x", labelCol=y).fit(rows)

"""Queries of evaluation statistics, over scores derived from documents and labels."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import evalstats as E
from ..streaming.ingest import hourly as hourly_windows
from .registry import ART, articles, docs, query, table

_NLL = "(n_words * (2 + (doc_id % 97) / 50.0::double))"


def _nll():
    return F.col("n_words") * (2 + (F.col("doc_id") % 97) / F.lit(50.0))


@query(f"with {ART} select year(day)::int as year, round(sum({_NLL}) / ({math.log(2)!r}::double * sum(n_bytes)), 9) bpb, sum(n_bytes)::bigint n_bytes from art group by 1")
def bpb_by_year(spark, sf):
    a = articles(spark, sf).select(F.year("day").alias("year"), _nll().alias("nll"), "n_bytes")
    return E.bits_per_byte(a, ["year"]).withColumn("bpb", F.round("bpb", 9))


@query("""with s as (select 't' || doc_id % 12 term, (doc_id * 31 % 211) / 10.0::double surprisal from documents), p as (select term, avg(surprisal) s from s group by 1),
t as (select 't' || i term, case when i % 2 = 0 then 'C1' else 'C2' end "class", 't' || (i + 6) control_term from range(0, 6) r(i))
select "class", round(avg(p.s), 9) terms, round(avg(c.s), 9) controls, round(avg(p.s) - avg(c.s), 9) gap, count(*) n from t join p using (term) join p c on c.term = t.control_term group by 1""")
def surprisal_gap(spark, sf):
    s = docs(spark, sf, "doc_id").select(F.concat(F.lit("t"), F.col("doc_id") % 12).alias("term"), (F.col("doc_id") * 31 % 211 / F.lit(10.0)).alias("surprisal"))
    t = spark.range(6).select(F.concat(F.lit("t"), "id").alias("term"), F.when(F.col("id") % 2 == 0, "C1").otherwise("C2").alias("class"), F.concat(F.lit("t"), F.col("id") + 6).alias("control_term"))
    out = E.class_gap(s, t)
    return out.select("class", *[F.round(c, 9).alias(c) for c in ("terms", "controls", "gap")], "n")


@query("""with c as (select p_brand field, p_partkey cand, p_size + 1 f from part where p_partkey % 2 = 0), t as (select p_brand field, p_partkey term, p_size + 1 f from part where p_partkey % 20 = 1),
r as (select t.term, t.field, c.cand, abs(ln(t.f) - ln(c.f)) gap, row_number() over (partition by t.term, t.field order by round(abs(ln(t.f) - ln(c.f)), 12), c.cand) k from t join c using (field))
select term, field, cand control, round(gap, 9) gap from r where k = 1""")
def control_match(spark, sf):
    p = table(spark, sf, "part", "p_partkey", "p_brand", "p_size")
    t = p.where("p_partkey % 20 = 1").select(F.col("p_partkey").alias("term"), F.col("p_brand").alias("field"), (F.col("p_size") + 1).alias("freq"))
    c = p.where("p_partkey % 2 = 0").select(F.col("p_brand").alias("field"), F.col("p_partkey").alias("cand"), (F.col("p_size") + 1).alias("cand_freq"))
    return E.control_match(t, c).withColumn("gap", F.round("gap", 9))


_P = "1 / (1 + exp(-((doc_id * 37 % 1009) / 504.5::double - 1)))"


def _labelled(spark, sf):
    raw = F.col("doc_id") * 37 % 1009 / F.lit(504.5) - 1
    return table(spark, sf, "labels", "doc_id", "quality").select("doc_id", E.logistic(raw).alias("p"), F.col("quality").alias("y"), (F.col("doc_id") * 37 % 101).cast("double").alias("score"))


@query(f"with l as (select doc_id % 4 as grp, {_P} p, quality y from labels) select grp, round(avg((p - y) ** 2), 9) brier, round(avg(-ln(case when y = 1 then p else 1 - p end)), 9) log_score, count(*) n from l group by 1")
def brier_score(spark, sf):
    out = E.brier(_labelled(spark, sf).withColumn("grp", F.col("doc_id") % 4), ["grp"])
    return out.select("grp", F.round("brier", 9).alias("brier"), F.round("log_score", 9).alias("log_score"), "n")


@query("""with l as (select (doc_id * 37 % 101)::double score, quality y from labels), g as (select score, count(*) n, sum(y) pos from l group by 1),
c as (select *, coalesce(sum(n) over (order by score rows between unbounded preceding and 1 preceding), 0) below from g), s as (select sum((below + (n + 1) / 2) * pos) r, sum(pos) p, sum(n) n from c)
select round((r - p * (p + 1) / 2) / (p * (n - p)), 9) auc, p::bigint positives, (n - p)::bigint negatives from s""")
def auc(spark, sf):
    return E.auc(_labelled(spark, sf), "score", "y").withColumn("auc", F.round("auc", 9))


REPLICATES = 60
_U = "('0x' || substr(md5(doc_id || ':' || r), 1, 8))::bigint / 4294967296.0::double"
_CUTS = []
_t = 0.0
for _k in range(8):
    _t += math.exp(-1) / math.factorial(_k)
    _CUTS.append(f"when u < {_t!r}::double then {_k}")
_BOOT = f"""b as (select r, doc_id, quality v, {_U} u from labels, range(0, {REPLICATES}) t(r)), w as (select *, case {' '.join(_CUTS)} else 8 end k from b),
m as (select r replicate, sum(k * v) / sum(k) mean from w group by 1)"""


@query(f"with {_BOOT} select replicate, round(mean, 9) mean from m")
def bootstrap_means(spark, sf):
    return _means(spark, sf).select("replicate", F.round("mean", 9).alias("mean"))


def _means(spark, sf):
    l = table(spark, sf, "labels", "doc_id", "quality").withColumn("quality", F.col("quality").cast("double"))
    return E.bootstrap_means(l, "doc_id", "quality", REPLICATES).withColumn("replicate", F.col("replicate").cast("long"))


@query(f"with {_BOOT}, k as (select mean, row_number() over (order by mean, replicate) - 1 r, count(*) over () n from m) select round(max(mean) filter (where r = floor(0.025::double * n)), 9) lo, round(max(mean) filter (where r = floor(0.975::double * n)), 9) hi, round(avg(mean), 9) mean, round(stddev_samp(mean), 9) sd from k")
def bootstrap_ci(spark, sf):
    out = E.interval(_means(spark, sf))
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query("select min(epsilon) epsilon from (select * from (values (0.001, 0.5), (0.005, 0.52), (0.02, 0.66), (0.1, 0.8)) t(epsilon, mean)) where mean - 0.5 >= 3 * 0.05")
def detect_limit(spark, sf):
    rows = [(0.0, 0.5, 0.05), (0.001, 0.5, 0.05), (0.005, 0.52, 0.05), (0.02, 0.66, 0.05), (0.1, 0.8, 0.05)]
    t = spark.createDataFrame(rows, "epsilon double, mean double, sd double")
    return E.detect_limit(t).select(F.col("epsilon").cast("decimal(4,3)").alias("epsilon"))


_Y = "n_words::double", "((doc_id * 13) % 101)::double"


@query(f"with {ART} select source, round(regr_slope({_Y[0]}, {_Y[1]}), 6) slope, round(regr_intercept({_Y[0]}, {_Y[1]}), 6) intercept, count(*) n from art group by 1")
def ocr_regression(spark, sf):
    a = articles(spark, sf).select("source", F.col("n_words").cast("double").alias("y"), (F.col("doc_id") * 13 % 101).cast("double").alias("x"))
    out = E.regression(a, ["source"], "y", "x")
    return out.select("source", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"), "n")


@query(f"with {ART}, f as (select regr_slope({_Y[0]}, {_Y[1]}) a, regr_intercept({_Y[0]}, {_Y[1]}) b from art) select doc_id, round({_Y[0]} - a * {_Y[1]} - b, 6) residual from art, f")
def ocr_residuals(spark, sf):
    a = articles(spark, sf).select("doc_id", F.col("n_words").cast("double").alias("y"), (F.col("doc_id") * 13 % 101).cast("double").alias("x"))
    return E.residuals(a, "y", "x").select("doc_id", F.round("residual", 6).alias("residual"))


@query("select source, round(avg(((doc_id * 31 % 211) / 10.0::double > 15)::int), 9) high_share, round(avg((doc_id * 31 % 211) / 10.0::double), 9) mean, count(*) n from documents group by 1")
def surprisal_features(spark, sf):
    s = docs(spark, sf, "doc_id", "source").select("source", (F.col("doc_id") * 31 % 211 / F.lit(10.0)).alias("surprisal"))
    out = E.high_surprisal(s, ["source"], 15.0)
    return out.select("source", F.round("high_share", 9).alias("high_share"), F.round("mean", 9).alias("mean"), "n")


@query()
def isotonic_calibration(spark, sf):
    l = _labelled(spark, sf).select("score", F.col("y").alias("label"))
    m = E.isotonic(l)
    return spark.createDataFrame([(float(a), float(b)) for a, b in zip(m.boundaries, m.predictions)], "boundary double, prediction double")  # the model's knots


@query("select date_trunc('hour', ts) as start, event_type, count(*) n, round(sum(value), 4) total from events group by all")
def hourly_events(spark, sf):
    w = hourly_windows(table(spark, sf, "events", "ts", "event_type", "value"))
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))

"""Metrics and ensembles over field tables: ``lineitem`` as a weighted field, ``events`` as ensemble samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluxmesh.model import TISSUES, FieldSpec, clean, tissue_table
from fluxmesh.operators import ensemble, metrics
from fluxmesh.plans.registry import query

LINEITEM = FieldSpec("l_extendedprice", "l_quantity", ("l_linenumber",), ("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate"), ("l_partkey", "l_suppkey", "l_orderkey"))
COLUMNS = ["l_linenumber", "l_extendedprice", "l_quantity", "l_orderkey", "l_partkey", "l_suppkey", "l_shipdate"]
#: Value buckets of the running sums: each region is cumulated in so many tasks.
BUCKETS = 8


def lineitem(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(COLUMNS)


def events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value").where("value > 0")


def rounded(df, keys, digits=6):
    """``df`` with every other column rounded as a double."""
    return df.select(*keys, *[clean(F.col(c).cast("double"), digits).alias(c) for c in df.columns if c not in keys])


ORDERED = """
 WITH o AS (SELECT l_linenumber g, l_extendedprice::DOUBLE v, l_quantity::DOUBLE w, l_orderkey, l_partkey, l_suppkey, l_shipdate,
   sum(l_quantity::DOUBLE) OVER (PARTITION BY l_linenumber ORDER BY l_extendedprice, l_orderkey, l_partkey, l_suppkey, l_shipdate ROWS UNBOUNDED PRECEDING) cw,
   sum(l_quantity::DOUBLE) OVER (PARTITION BY l_linenumber) tw FROM lineitem),
 p AS (SELECT *, (cw - w/2e0)/tw pos FROM o),
 n AS (SELECT *, lead(pos) OVER s npos, lead(v) OVER s nv, row_number() OVER s rn FROM p WINDOW s AS (PARTITION BY g ORDER BY pos, cw)),
 qs AS (SELECT unnest([{qs}]) q),
 quant AS (SELECT g, q, max(CASE WHEN rn = 1 AND q < pos THEN v WHEN npos IS NULL AND q >= pos THEN v
   WHEN q >= pos AND q < npos THEN v + (nv - v)*((q - pos)/(npos - pos)) END) x FROM n, qs GROUP BY g, q)"""


def _pick(q: float) -> str:
    return f"max(CASE WHEN q = {q} THEN x END)"


SUMMARY_SQL = (
    ORDERED.format(qs="0.5e0, 0.95e0, 0.99e0, 0.999e0")
    + f""",
 qq AS (SELECT g, {_pick(0.5)} p50, {_pick(0.95)} p95, {_pick(0.99)} p99, {_pick(0.999)} p99_9 FROM quant GROUP BY g),
 first AS (SELECT g, l_partkey, l_suppkey, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY v DESC, l_orderkey, l_partkey, l_suppkey, l_shipdate) k FROM o) WHERE k = 1),
 m AS (SELECT g, max(v) peak, sum(w*v*l_partkey)/sum(w*v) c1, sum(w*v*l_suppkey)/sum(w*v) c2, sum(w*v*l_orderkey)/sum(w*v) c3, sum(w) volume, sum(w*v)/sum(w) mean FROM o GROUP BY g),
 s AS (SELECT o.g, sqrt(sum(w*(v-mean)*(v-mean))/sum(w)) std, coalesce(sum(CASE WHEN v >= 0.5e0*p99_9 THEN w END), 0e0) f1, coalesce(sum(CASE WHEN v >= 0.75e0*p99_9 THEN w END), 0e0) f2
   FROM o JOIN m ON o.g = m.g JOIN qq ON o.g = qq.g GROUP BY o.g)
 SELECT m.g AS l_linenumber, round(peak,6)+0e0 AS peak, round(first.l_partkey::DOUBLE,6)+0e0 AS peak_l_partkey, round(first.l_suppkey::DOUBLE,6)+0e0 AS peak_l_suppkey, round(first.l_orderkey::DOUBLE,6)+0e0 AS peak_l_orderkey,
   round(c1,6)+0e0 AS cog_l_partkey, round(c2,6)+0e0 AS cog_l_suppkey, round(c3,6)+0e0 AS cog_l_orderkey, round(volume,6)+0e0 AS volume, round(mean,6)+0e0 AS mean, round(std,6)+0e0 AS std,
   round(p50,6)+0e0 AS p50, round(p95,6)+0e0 AS p95, round(p99,6)+0e0 AS p99, round(p99_9,6)+0e0 AS p99_9, round(f1,6)+0e0 AS focality_0_5, round(f2,6)+0e0 AS focality_0_75
 FROM m JOIN first ON m.g = first.g JOIN qq ON m.g = qq.g JOIN s ON m.g = s.g"""
)


@query(SUMMARY_SQL)
def region_summary(spark, sf_dir):
    return rounded(metrics.region_summary(lineitem(spark, sf_dir), LINEITEM, buckets=BUCKETS), ["l_linenumber"])


@query(ORDERED.format(qs="0.1e0, 0.25e0, 0.5e0, 0.9e0") + f" SELECT g AS l_linenumber, round({_pick(0.1)},6)+0e0 AS p10, round({_pick(0.25)},6)+0e0 AS p25, round({_pick(0.5)},6)+0e0 AS p50, round({_pick(0.9)},6)+0e0 AS p90 FROM quant GROUP BY g")
def weighted_quantiles(spark, sf_dir):
    return rounded(metrics.weighted_quantiles(lineitem(spark, sf_dir), LINEITEM, [10, 25, 50, 90], BUCKETS), ["l_linenumber"])


@query(ORDERED.format(qs="0.999e0") + f" SELECT g AS l_linenumber, round({_pick(0.999)},6)+0e0 AS p99_9 FROM quant GROUP BY g")
def percentile_magnitude(spark, sf_dir):
    return rounded(metrics.weighted_quantiles(lineitem(spark, sf_dir), LINEITEM, [99.9], BUCKETS), ["l_linenumber"])


@query(
    ORDERED.format(qs="0.999e0")
    + """, a AS (SELECT g, max(x) anchor FROM quant GROUP BY g)
 SELECT o.g AS l_linenumber, round(max(anchor),6)+0e0 AS anchor, round(sum(CASE WHEN v >= 0.25e0*anchor THEN w ELSE 0e0 END),6)+0e0 AS focality_0_25, round(sum(CASE WHEN v >= 0.5e0*anchor THEN w ELSE 0e0 END),6)+0e0 AS focality_0_5,
 round(sum(CASE WHEN v >= 0.9e0*anchor THEN w ELSE 0e0 END),6)+0e0 AS focality_0_9 FROM o JOIN a ON o.g = a.g GROUP BY o.g"""
)
def focality_fracs(spark, sf_dir):
    return rounded(metrics.focality(lineitem(spark, sf_dir), LINEITEM, (0.25, 0.5, 0.9), buckets=BUCKETS), ["l_linenumber"])


@query(
    """WITH a AS (SELECT l_linenumber g, max(l_extendedprice::DOUBLE) anchor FROM lineitem GROUP BY 1)
 SELECT l_linenumber, round(max(anchor),6)+0e0 AS anchor, round(sum(CASE WHEN l_extendedprice >= 0.5e0*anchor THEN l_quantity::DOUBLE ELSE 0e0 END),6)+0e0 AS focality_0_5 FROM lineitem JOIN a ON l_linenumber = g GROUP BY l_linenumber"""
)
def focality_anchor_max(spark, sf_dir):
    return rounded(metrics.focality(lineitem(spark, sf_dir), LINEITEM, (0.5,), anchor=100), ["l_linenumber"])


@query("SELECT l_linenumber, round(coalesce(sum(CASE WHEN l_extendedprice >= 50000e0 THEN l_quantity::DOUBLE END),0e0),6)+0e0 AS volume FROM lineitem GROUP BY 1")
def stimulated_volume(spark, sf_dir):
    return rounded(lineitem(spark, sf_dir).groupBy("l_linenumber").agg(metrics.stimulated_volume(LINEITEM, F.lit(50000.0)).alias("volume")), ["l_linenumber"])


@query(
    """SELECT l_linenumber, l_extendedprice::DOUBLE AS peak, l_partkey, l_suppkey, l_orderkey FROM
 (SELECT *, row_number() OVER (PARTITION BY l_linenumber ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_suppkey, l_shipdate) k FROM lineitem) WHERE k = 1"""
)
def peak_location_first_argmax(spark, sf_dir):
    best = lineitem(spark, sf_dir).groupBy("l_linenumber").agg(metrics.peak(LINEITEM).alias("peak"), metrics.first_argmax(LINEITEM, list(LINEITEM.position)).alias("at"))
    return best.select("l_linenumber", "peak", *[F.col("at")[p].alias(p) for p in LINEITEM.position])


@query("SELECT l_linenumber, " + ", ".join(f"round(sum(l_quantity*l_extendedprice*{c})/sum(l_quantity*l_extendedprice),6)+0e0 AS cog_{c}" for c in ("l_partkey", "l_suppkey", "l_orderkey")) + " FROM lineitem GROUP BY 1")
def center_of_gravity(spark, sf_dir):
    return rounded(lineitem(spark, sf_dir).groupBy("l_linenumber").agg(*metrics.centre_of_gravity(LINEITEM)), ["l_linenumber"])


@query(
    """WITH m AS (SELECT l_linenumber g, sum(l_quantity*l_extendedprice)/sum(l_quantity) mean FROM lineitem GROUP BY 1)
 SELECT l_linenumber, round(max(mean),6)+0e0 AS mean, round(sqrt(sum(l_quantity*(l_extendedprice-mean)*(l_extendedprice-mean))/sum(l_quantity)),6)+0e0 AS std FROM lineitem JOIN m ON l_linenumber = g GROUP BY 1"""
)
def weighted_distribution(spark, sf_dir):
    return rounded(metrics.distribution(lineitem(spark, sf_dir), LINEITEM), ["l_linenumber"])


# ---- ensembles --------------------------------------------------------------------------------------------------

MOMENTS = """WITH m AS (SELECT user_id, event_type, count(value) n, sum(value) s, sum(value*value) q, sum(value)/count(value) mean FROM events WHERE value > 0 GROUP BY 1, 2),
 d AS (SELECT *, sqrt(greatest(q - n*mean*mean, 0e0)/greatest(n-1, 1)) std FROM m), t AS (SELECT max(mean) top FROM m),
 c AS (SELECT user_id, event_type, n, mean, std, CASE WHEN mean <= 1e-12*top THEN 0e0 ELSE std/mean END cov FROM d, t)"""


@query(MOMENTS + " SELECT user_id, event_type, n, round(mean,6)+0e0 AS mean, round(std,5)+0e0 AS std, round(cov,6)+0e0 AS cov FROM c")
def ensemble_moments(spark, sf_dir):
    m = ensemble.moments(events(spark, sf_dir), ["user_id", "event_type"], "value")
    return m.select("user_id", "event_type", "n", clean(F.col("mean"), 6).alias("mean"), clean(F.col("std"), 5).alias("std"), clean(F.col("cov"), 6).alias("cov"))


@query(MOMENTS + " SELECT event_type, round(max(cov),6)+0e0 AS max_cov FROM c GROUP BY 1")
def local_cov_masked(spark, sf_dir):
    return ensemble.moments(events(spark, sf_dir), ["user_id", "event_type"], "value").groupBy("event_type").agg(clean(F.max("cov"), 6).alias("max_cov"))


EVENT_FIELD = FieldSpec("value", "weight", ("user_id",), ("event_id",), ("event_id",))


def _draw_field(spark, sf_dir):
    return events(spark, sf_dir).select("user_id", "event_id", "value", (F.col("event_id") % 7 + 1).cast("double").alias("weight"))


@query("SELECT user_id, value AS peak, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) k FROM events WHERE value > 0) WHERE k = 1")
def draw_peaks(spark, sf_dir):
    best = _draw_field(spark, sf_dir).groupBy("user_id").agg(metrics.peak(EVENT_FIELD).alias("peak"), metrics.first_argmax(EVENT_FIELD, ["event_id"]).alias("at"))
    return best.select("user_id", "peak", F.col("at.event_id").alias("event_id"))


@query(
    """WITH o AS (SELECT user_id g, event_id, value v, (event_id % 7 + 1)::DOUBLE w FROM events WHERE value > 0),
 c AS (SELECT *, sum(w) OVER (PARTITION BY g ORDER BY v, event_id ROWS UNBOUNDED PRECEDING) cw, sum(w) OVER (PARTITION BY g) tw FROM o),
 p AS (SELECT *, (cw - w/2e0)/tw pos FROM c), n AS (SELECT *, lead(pos) OVER s np, lead(v) OVER s nv, row_number() OVER s rn FROM p WINDOW s AS (PARTITION BY g ORDER BY v, event_id)),
 a AS (SELECT g, max(CASE WHEN rn = 1 AND 0.999e0 < pos THEN v WHEN np IS NULL AND 0.999e0 >= pos THEN v WHEN 0.999e0 >= pos AND 0.999e0 < np THEN v + (nv-v)*((0.999e0-pos)/(np-pos)) END) anchor FROM n GROUP BY g)
 SELECT o.g AS user_id, round(max(anchor),6)+0e0 AS anchor, round(sum(CASE WHEN v >= 0.5e0*anchor THEN w ELSE 0e0 END),6)+0e0 AS focality_0_5 FROM o JOIN a ON o.g = a.g GROUP BY o.g"""
)
def draw_focality(spark, sf_dir):
    return rounded(metrics.focality(_draw_field(spark, sf_dir), EVENT_FIELD, (0.5,)), ["user_id"])


@query(
    """WITH f AS (SELECT event_type, covar_pop(ln(value), ln(1e0+event_id%97)) c, var_pop(ln(1e0+event_id%97)) vx, var_pop(ln(value)) vy FROM events WHERE value > 0 GROUP BY 1)
 SELECT event_type, round(CASE WHEN vy > 0 THEN (c/vx)*(c/vx)*vx/vy ELSE 0e0 END,9)+0e0 AS share FROM f"""
)
def tissue_sensitivity_single(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("sigma", 1.0 + F.col("event_id") % 97)
    return rounded(ensemble.sensitivity_one(rows, ["event_type"], "value", "sigma"), ["event_type"], 9)


@query(
    """WITH e AS (SELECT ln(value) y, ln(1e0+event_id%97) a, ln(1e0+event_id%89) b FROM events WHERE value > 0),
 s AS (SELECT var_pop(y) vy, covar_pop(a,y) ca, covar_pop(b,y) cb, var_pop(a) va, var_pop(b) vb, covar_pop(a,b) ab FROM e),
 t AS (SELECT *, (ca*vb - cb*ab)/(va*vb - ab*ab) ba, (cb*va - ca*ab)/(va*vb - ab*ab) bb FROM s)
 SELECT 's1' AS tissue, round(ba*ba*va/vy,9)+0e0 AS share FROM t UNION ALL SELECT 's2', round(bb*bb*vb/vy,9)+0e0 FROM t"""
)
def tissue_sensitivity_multi(spark, sf_dir):
    rows = events(spark, sf_dir).select("value", (1.0 + F.col("event_id") % 97).alias("s1"), (1.0 + F.col("event_id") % 89).alias("s2"))
    found = ensemble.sensitivity(rows, "value", ["s1", "s2"])
    return rounded(spark.createDataFrame(sorted(found.items()), "tissue string, share double"), ["tissue"], 9)


NORMAL = "tissue(tag, s0, cov) AS (VALUES " + ",".join(f"({tag},{sigma}e0,{cov}e0)" for tag, _, sigma, cov in TISSUES) + """),
 ks AS (SELECT (row_number() OVER (ORDER BY c_custkey) - 1)::INT k FROM customer),
 u AS (SELECT k, tag, s0, cov, (('0x'||substr(md5('5|'||k||'|'||tag||'|a'),1,8))::BIGINT + 0.5e0)/4294967296e0 u1, (('0x'||substr(md5('5|'||k||'|'||tag||'|b'),1,8))::BIGINT + 0.5e0)/4294967296e0 u2 FROM ks, tissue),
 z AS (SELECT *, sqrt(-2e0*ln(u1))*cos(2e0*pi()*u2) z FROM u)"""


def _customers(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").count()


@query("WITH " + NORMAL + " SELECT k, tag, round(s0*exp(sqrt(ln(1e0+cov*cov))*z - ln(1e0+cov*cov)/2e0),9)+0e0 AS sigma FROM z")
def lognormal_draws(spark, sf_dir):
    """A draw for each customer."""
    return rounded(ensemble.draws(tissue_table(spark), _customers(spark, sf_dir), seed=5), ["k", "tag"], 9)


@query("WITH " + NORMAL + " SELECT k, tag, round(greatest(s0*(1e0+cov*z), s0*1e-6),9)+0e0 AS sigma FROM z")
def normal_draws_clamped(spark, sf_dir):
    return rounded(ensemble.draws(tissue_table(spark), _customers(spark, sf_dir), seed=5, kind="normal"), ["k", "tag"], 9)

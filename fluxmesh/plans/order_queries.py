"""Queries of several regions in one ordering, of the stored index of cumulated weights, and of ensembles' results."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluxmesh.model import FieldSpec, clean
from fluxmesh.operators import ordering
from fluxmesh.plans.field_queries import COLUMNS, LINEITEM, rounded
from fluxmesh.plans.registry import query
from fluxmesh.results import EnsembleResult
from fluxmesh.sources.scratch import scratch
from fluxmesh.streaming import moments

REGIONS = ["A", "N", "R", "all"]
_KEY = "l_orderkey, l_partkey, l_suppkey, l_shipdate"


def _rows(spark, sf_dir):
    """Line items as a field: a region for each return flag, and the whole."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*COLUMNS, F.array("l_returnflag", F.lit("all")).alias("regions"))


def _index(spark, sf_dir):
    return ordering.write_index(_rows(spark, sf_dir), LINEITEM, REGIONS, scratch(spark, "index"))


#: The midpoint rule by group and region, whose rows are f: (g, r, v, w, order key).
_POS = """o AS (SELECT *, sum(w) OVER (PARTITION BY g, r ORDER BY v, {key} ROWS UNBOUNDED PRECEDING) cw, sum(w) OVER (PARTITION BY g, r) tw FROM f),
 p AS (SELECT *, (cw - w/2e0)/tw pos FROM o),
 n AS (SELECT *, lead(pos) OVER s npos, lead(v) OVER s nv, row_number() OVER s rn FROM p WINDOW s AS (PARTITION BY g, r ORDER BY pos, cw))"""
_AT = "max(CASE WHEN rn = 1 AND {q} < pos THEN v WHEN npos IS NULL AND {q} >= pos THEN v WHEN {q} >= pos AND {q} < npos THEN v + (nv - v)*(({q} - pos)/(npos - pos)) END)"
_FIELD = (
    "f AS (SELECT l_linenumber g, unnest([l_returnflag, 'all']) r, l_extendedprice::DOUBLE v, l_quantity::DOUBLE w, " + _KEY + " FROM lineitem), " + _POS.format(key=_KEY)
)


def _targets(spark, sf_dir, index, value):
    """A target for each nation in each region of each line number."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(value)
    return index.heads.select(*index.keys).distinct().crossJoin(F.broadcast(nations))


@query(
    "WITH " + _FIELD + ", t AS (SELECT (n_nationkey*4e0 + 1e0)/100e0 q FROM nation)"
    + f" SELECT g AS l_linenumber, r AS region, q, round({_AT.format(q='q')},6)+0e0 AS value FROM n, t GROUP BY g, r, q"
)
def index_quantiles(spark, sf_dir):
    """A percentile for each nation, each from the bucket it falls into."""
    index = _index(spark, sf_dir)
    return rounded(index.quantiles(_targets(spark, sf_dir, index, ((F.col("n_nationkey") * 4.0 + 1.0) / 100.0).alias("q"))), ["l_linenumber", "region", "q"])


@query(
    "WITH " + _FIELD + ", a AS (SELECT g, r, " + _AT.format(q="0.999e0") + " anchor FROM n GROUP BY g, r), t AS (SELECT (n_nationkey + 1e0)/25e0 fraction FROM nation)"
    + " SELECT f.g AS l_linenumber, f.r AS region, fraction, round(max(anchor),6)+0e0 AS anchor, round(sum(CASE WHEN v >= fraction*anchor THEN w ELSE 0e0 END),6)+0e0 AS volume FROM f JOIN a ON f.g = a.g AND f.r = a.r, t GROUP BY f.g, f.r, fraction"
)
def index_focality(spark, sf_dir):
    """The weight above each nation's fraction of the anchor."""
    index = _index(spark, sf_dir)
    return rounded(index.focality(_targets(spark, sf_dir, index, ((F.col("n_nationkey") + 1.0) / 25.0).alias("fraction"))), ["l_linenumber", "region", "fraction"])


_QS = {"p50": "0.5e0", "p95": "0.95e0", "p99": "0.99e0", "p99_9": "0.999e0"}
_SUMMARY = (
    "qq AS (SELECT g, r, " + ", ".join(f"{_AT.format(q=q)} {name}" for name, q in _QS.items()) + " FROM n GROUP BY g, r),\n"
    " m AS (SELECT g, r, max(v) peak, sum(w) volume, sum(w*v)/sum(w) mean, {cogs} FROM f GROUP BY g, r),\n"
    " top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g, r ORDER BY v DESC, {key}) k FROM f) WHERE k = 1),\n"
    " s AS (SELECT f.g, f.r, sqrt(sum(w*(v-mean)*(v-mean))/sum(w)) std, coalesce(sum(CASE WHEN v >= 0.5e0*p99_9 THEN w END), 0e0) f1, coalesce(sum(CASE WHEN v >= 0.75e0*p99_9 THEN w END), 0e0) f2\n"
    "   FROM f JOIN m ON f.g = m.g AND f.r = m.r JOIN qq ON f.g = qq.g AND f.r = qq.r GROUP BY f.g, f.r),\n"
    " z AS (SELECT m.*, top.* EXCLUDE (g, r, v, w, k), qq.* EXCLUDE (g, r), std, f1, f2 FROM m JOIN top ON m.g = top.g AND m.r = top.r JOIN qq ON m.g = qq.g AND m.r = qq.r JOIN s ON m.g = s.g AND m.r = s.r)"
)
_VALUES = ", ".join(f"round({c},5)+0e0 AS {n}" for c, n in {"peak": "peak", "volume": "volume", "mean": "mean", "std": "std", **{n: n for n in _QS}, "f1": "focality_0_5", "f2": "focality_0_75"}.items())


def _places(names):
    return ", ".join(f"round({c}::DOUBLE,5)+0e0 AS peak_{c}, round(cog_{c},5)+0e0 AS cog_{c}" for c in names)


def _cogs(names):
    return ", ".join(f"sum(w*v*{c})/sum(w*v) cog_{c}" for c in names)


@query("WITH " + _FIELD + ", " + _SUMMARY.format(cogs=_cogs(LINEITEM.position), key=_KEY) + f" SELECT g AS l_linenumber, r AS region, {_VALUES}, {_places(LINEITEM.position)} FROM z")
def regional_summaries(spark, sf_dir):
    """All metrics of every line number in each return flag and as a whole, from one sort."""
    return rounded(ordering.regional_summaries(_rows(spark, sf_dir), LINEITEM, REGIONS), ["l_linenumber", "region"], 5)


# ---- results of an ensemble -------------------------------------------------------------------------------------

#: Events as draws: the kind is the placement, a user the element (of weight, place and tissue by its number).
ENSEMBLE = FieldSpec("magn", "vol", ("p",), ("e",), ("bx", "by", "bz"))
_TISSUES = ["t0", "t1", "t2", "all"]
_SAMPLES = "ev AS (SELECT event_type p, event_id k, user_id e, value magn FROM events WHERE value > 0)"


def _ensemble(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").where("value > 0")
    samples = ev.select(F.col("event_type").alias("p"), F.col("event_id").alias("k"), F.col("user_id").alias("e"), F.col("value").alias("magn"))
    e = F.col("user_id")
    elements = ev.select("user_id").distinct().select(e.alias("e"), (e % 7 + 1).cast("double").alias("vol"), F.array(F.concat(F.lit("t"), e % 3), F.lit("all")).alias("regions"), (e % 11).cast("double").alias("bx"), (e % 13).cast("double").alias("by"), e.cast("double").alias("bz"))
    sigmas = ev.select(F.col("event_id").alias("k")).select("k", F.explode(F.array(*[F.struct(F.lit(t).alias("tag"), (1.0 + F.col("k") % m).alias("sigma")) for t, m in ((1, 97), (2, 89))])).alias("s")).select("k", "s.tag", "s.sigma")
    return EnsembleResult(samples, elements, sigmas, ENSEMBLE, _TISSUES)


_MEANS = (
    _SAMPLES
    + """, mo AS (SELECT p, e, sum(magn)/count(*) mean, sqrt(greatest(sum(magn*magn) - count(*)*(sum(magn)/count(*))*(sum(magn)/count(*)), 0e0)/greatest(count(*)-1, 1)) std FROM ev GROUP BY p, e),
 f AS (SELECT p g, unnest(['t'||(e%3), 'all']) r, mean v, (e%7+1)::DOUBLE w, e, std/mean cov, (e%11)::DOUBLE bx, (e%13)::DOUBLE by_, e::DOUBLE bz FROM mo), """
    + _POS.format(key="e")
)
_UQ_PLACES = ", ".join(f"round({c},5)+0e0 AS peak_{n}, round(cog_{c},5)+0e0 AS cog_{n}" for c, n in (("bx", "bx"), ("by_", "by"), ("bz", "bz")))


@query(
    "WITH " + _MEANS + ", " + _SUMMARY.format(cogs=_cogs(["bx", "by_", "bz"]), key="e").replace("EXCLUDE (g, r, v, w, k)", "EXCLUDE (g, r, v, w, k, e, cov)")
    + f", c AS (SELECT g, r, max(cov) top FROM f GROUP BY g, r) SELECT z.g AS p, z.r AS region, {_VALUES}, {_UQ_PLACES}, round(top,5)+0e0 AS max_local_cov FROM z JOIN c ON z.g = c.g AND z.r = c.r"
)
def ensemble_summaries(spark, sf_dir):
    """Metrics of the mean field and the largest local variation, every region."""
    return rounded(_ensemble(spark, sf_dir).summaries(), ["p", "region"], 5)


@query(
    "WITH " + _SAMPLES + """, l AS (SELECT p, k, ln(max(magn)) y, ln(1e0+k%97) a, ln(1e0+k%89) b FROM ev WHERE e % 3 = 1 GROUP BY p, k),
 s AS (SELECT p, var_pop(y) vy, covar_pop(a,y) ca, covar_pop(b,y) cb, var_pop(a) va, var_pop(b) vb, covar_pop(a,b) ab FROM l GROUP BY p),
 t AS (SELECT *, (ca*vb - cb*ab)/(va*vb - ab*ab) ba, (cb*va - ca*ab)/(va*vb - ab*ab) bb FROM s)
 SELECT p, 1 AS tag, round(ba*ba*va/vy,7)+0e0 AS share FROM t UNION ALL SELECT p, 2, round(bb*bb*vb/vy,7)+0e0 FROM t"""
)
def ensemble_sensitivity(spark, sf_dir):
    """The share of each tissue in the variance of a region's peak, by placement."""
    return rounded(_ensemble(spark, sf_dir).tissue_sensitivity("peak", "t1"), ["p", "tag"], 7)


@query(
    "WITH " + _SAMPLES + """, m AS (SELECT p, e, count(*) n, sum(magn)/count(*) mean, sqrt(greatest(sum(magn*magn) - count(*)*(sum(magn)/count(*))*(sum(magn)/count(*)), 0e0)/greatest(count(*)-1, 1)) std FROM ev GROUP BY p, e)
 SELECT p, e, n, round(mean,6)+0e0 AS mean, round(std,5)+0e0 AS std, round(std/mean,6)+0e0 AS cov FROM m"""
)
def streamed_moments(spark, sf_dir):
    """The events as a stream of draws; each user's draws of a kind are as many as the table holds."""
    pick = lambda df: df.where("value > 0").select(F.col("event_type").alias("p"), F.col("user_id").alias("e"), F.col("value").alias("magn"))
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    elements = pick(table).groupBy("p", "e").agg(F.count("*").alias("due"))
    stream = spark.readStream.schema(table.schema).parquet(f"{sf_dir}/events*.parquet")
    path = scratch(spark, "moments")
    moments.stream_moments(pick(stream), elements, f"{path}/table", f"{path}/state").awaitTermination()
    done = moments.finished(spark.read.parquet(f"{path}/table"), elements)
    return done.select("p", "e", "n", clean(F.col("mean"), 6).alias("mean"), clean(F.col("std"), 5).alias("std"), clean(F.col("cov"), 6).alias("cov"))

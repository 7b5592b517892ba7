"""Queries over aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalframe.operators import aggregates as A
from vitalframe.operators import segments as S
from vitalframe.operators.ordering import exact_quantiles
from vitalframe.plans.catalog import register
from vitalframe.plans.roles import FS, MODALITY_SAMPLES_SQL, SAMPLES_SQL, modality_samples, samples, table


def _round(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


register("aggregate_per_file", lambda s, d: _round(A.one_vector_per(
    table(s, d, "lineitem").withColumn("ord", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")), ["l_orderkey"], ["l_quantity", "l_extendedprice", "l_discount"], ["l_shipdate"], "ord"),
    "l_quantity", "l_extendedprice", "l_discount").withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd")), """
SELECT l_orderkey, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_extendedprice), 6) AS l_extendedprice, round(avg(l_discount), 6) AS l_discount,
       strftime(arg_min(l_shipdate, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)), '%Y-%m-%d') AS l_shipdate FROM lineitem GROUP BY 1""")

register("aggregate_per_measurement", lambda s, d: _round(A.one_vector_per(
    table(s, d, "lineitem").withColumn("g", F.year("l_shipdate")), ["l_suppkey", "g", "l_returnflag"], ["l_quantity", "l_tax"]), "l_quantity", "l_tax"), """
SELECT l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS g, l_returnflag, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_tax), 6) AS l_tax FROM lineitem GROUP BY 1, 2, 3""")

register("aggregate_per_participant", lambda s, d: _round(A.one_vector_per(table(s, d, "orders"), ["o_custkey"], ["o_totalprice"]), "o_totalprice"), """
SELECT o_custkey, round(avg(o_totalprice), 6) AS o_totalprice FROM orders GROUP BY 1""")

register("conflicting_targets", lambda s, d: A.conflicting_targets(table(s, d, "orders").withColumn("g", F.year("o_orderdate")), ["o_custkey", "g"], "o_orderstatus"), """
SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS g, CAST(count(DISTINCT o_orderstatus) + max(CASE WHEN o_orderstatus IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_targets
FROM orders GROUP BY 1, 2 HAVING n_targets > 1""")

_SEG_SQL = f"""WITH {MODALITY_SAMPLES_SQL},
r AS (SELECT file_id, modality, count(*) AS duration FROM (SELECT *, i - row_number() OVER (PARTITION BY file_id, modality ORDER BY i) AS g FROM s WHERE q >= 0.5) GROUP BY file_id, modality, g),
f AS (SELECT file_id, modality, sum(duration) / 2.0::DOUBLE AS sec FROM r GROUP BY 1, 2)"""


def _seconds(s, d, mode):
    runs = S.threshold_runs(modality_samples(s, d), 0.5, FS, keys=("file_id", "modality"))
    return _round(A.seconds_per_participant(runs, 2.0, mode, "file_id", "modality"), "seconds")


register("segment_seconds_total", lambda s, d: _seconds(s, d, "total"), _SEG_SQL + " SELECT file_id, round(sum(sec), 6) AS seconds, count(*) AS n_files FROM f GROUP BY 1")
register("segment_seconds_average", lambda s, d: _seconds(s, d, "average"), _SEG_SQL + " SELECT file_id, round(avg(sec), 6) AS seconds, count(*) AS n_files FROM f GROUP BY 1")

_STATS = [c for c in ("mean", "std", "median", "min", "max", *[f"p{int(p * 100):02d}" for p in A.PERCENTILES], "share_50", "share_80")]
_STATS_SQL = "count(q) AS n, round(avg(q), 6) AS mean, round(stddev_pop(q), 6) AS std, round(median(q), 6) AS median, round(min(q), 6) AS min, round(max(q), 6) AS max, " + ", ".join(
    f"round(quantile_cont(q, {p}), 6) AS p{int(p * 100):02d}" for p in A.PERCENTILES) + ", round(avg((q >= 0.5)::INT), 6) AS share_50, round(avg((q >= 0.8)::INT), 6) AS share_80"
register("sqi_stats", lambda s, d: _round(A.value_stats(samples(s, d), ["modality"], "q"), *_STATS), f"WITH {SAMPLES_SQL} SELECT modality, {_STATS_SQL} FROM s GROUP BY 1")
register("sqi_rollup", lambda s, d: _round(A.rolled_up(samples(s, d), ["modality", "file_id"], "q"), *_STATS).fillna({"file_id": -1}), f"WITH {SAMPLES_SQL} SELECT modality, coalesce(file_id, -1) AS file_id, {_STATS_SQL} FROM s GROUP BY ROLLUP(modality, file_id)")

register("sqi_histogram", lambda s, d: _round(A.histogram(samples(s, d), "q", 0.0, 1.0, 20), "edge", "cdf"), f"""
WITH {SAMPLES_SQL}, c AS (SELECT least(floor(q / 0.05)::INT, 19) AS bin, count(*) AS n FROM s WHERE q BETWEEN 0 AND 1 GROUP BY 1),
f AS (SELECT b.bin::INT AS bin, coalesce(c.n, 0) AS n FROM (SELECT unnest(range(20)) AS bin) b LEFT JOIN c ON c.bin = b.bin)
SELECT bin, round(bin * 0.05::DOUBLE, 6) AS edge, n::BIGINT AS n, round(sum(n) OVER (ORDER BY bin) / sum(n) OVER (), 6) AS cdf FROM f""")
register("duration_cdf", lambda s, d: _round(A.step_cdf(S.threshold_runs(samples(s, d), 0.5), "duration"), "cdf"), f"""
WITH {SAMPLES_SQL}, r AS (SELECT count(*) AS duration FROM (SELECT *, i - row_number() OVER (PARTITION BY file_id ORDER BY i) AS g FROM s WHERE q >= 0.5) GROUP BY file_id, g)
SELECT DISTINCT duration, round(cume_dist() OVER (ORDER BY duration), 6) AS cdf FROM r""")

_MODS = ["click", "view", "error"]
_PIVOT = [f"sqi_{m}_{k}" for m in _MODS for k in ("mean", "std")]


def _pivot(s, d):
    stats = A.pivoted_stats(samples(s, d), "file_id", "modality", "q", _MODS)
    ranked = A.combined_rank(_round(stats, *_PIVOT), [f"sqi_{m}_mean" for m in _MODS])
    return _round(ranked, "sqi_combined")


register("sqi_participant_pivot", _pivot, f"""
WITH {SAMPLES_SQL}, p AS (SELECT file_id, {", ".join(f"round(avg(q) FILTER (modality = '{m}'), 6) AS sqi_{m}_mean, round(stddev_pop(q) FILTER (modality = '{m}'), 6) AS sqi_{m}_std" for m in _MODS)}, count(q) AS n_segments FROM s GROUP BY 1),
c AS (SELECT *, (0.0::DOUBLE + coalesce(sqi_click_mean, 0) + coalesce(sqi_view_mean, 0) + coalesce(sqi_error_mean, 0)) /
      nullif((sqi_click_mean IS NOT NULL)::INT + (sqi_view_mean IS NOT NULL)::INT + (sqi_error_mean IS NOT NULL)::INT, 0) AS x FROM p)
SELECT * EXCLUDE (x), round(x, 6) AS sqi_combined, CASE WHEN x IS NOT NULL THEN dense_rank() OVER (ORDER BY x DESC NULLS LAST) END::INT AS sqi_rank FROM c""")

register("target_stats", lambda s, d: _round(A.target_stats(table(s, d, "orders"), ["o_custkey", "o_orderstatus", "o_totalprice"], "o_custkey", "o_totalprice"), "target_mean", "target_std"), """
SELECT o_custkey, round(avg(o_totalprice), 6) AS target_mean, round(stddev_pop(o_totalprice), 6) AS target_std
FROM (SELECT DISTINCT o_custkey, o_orderstatus, o_totalprice FROM orders) GROUP BY 1""")


def _full_stats(s, d):
    glc = A.target_stats(table(s, d, "orders"), ["o_custkey", "o_orderkey"], "o_custkey", "o_totalprice").withColumnRenamed("o_custkey", "id")
    sqi = A.pivoted_stats(samples(s, d), "file_id", "modality", "q", ["view"]).withColumnRenamed("file_id", "id")
    return _round(glc.join(sqi, "id", "full"), "target_mean", "target_std", "sqi_view_mean", "sqi_view_std").fillna({"n_segments": 0})


register("target_and_quality", _full_stats, f"""
WITH {SAMPLES_SQL}, g AS (SELECT o_custkey AS id, round(avg(o_totalprice), 6) AS target_mean, round(stddev_pop(o_totalprice), 6) AS target_std FROM orders GROUP BY 1),
p AS (SELECT file_id AS id, round(avg(q) FILTER (modality = 'view'), 6) AS sqi_view_mean, round(stddev_pop(q) FILTER (modality = 'view'), 6) AS sqi_view_std, count(q) AS n_segments FROM s GROUP BY 1)
SELECT id, target_mean, target_std, sqi_view_mean, sqi_view_std, coalesce(n_segments, 0) AS n_segments FROM g FULL JOIN p USING (id)""")

register("dataset_overview", lambda s, d: A.overview(table(s, d, "events").withColumn("g", F.dayofmonth("ts")), ["user_id", "g"], "event_type", ["click", "view"], "event_type"), """
SELECT user_id, CAST(day(ts) AS INTEGER) AS g, count(*) AS n_files, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'view') AS n_view, count(DISTINCT event_type) <= 1 AS consistent FROM events GROUP BY 1, 2""")


def _picked(s, d):
    return table(s, d, "part").select(F.concat_ws("_", F.lower("p_type"), F.regexp_replace("p_name", " ", "_")).alias("feature"), F.col("p_brand").alias("source"))


_PICKED_SQL = "f AS (SELECT lower(p_type) || '_' || replace(p_name, ' ', '_') AS feature, p_brand AS source FROM part)"
register("feature_popularity", lambda s, d: A.popularity(_picked(s, d), "feature", "source"), f"""
WITH {_PICKED_SQL} SELECT feature, count(DISTINCT source) AS n_sources, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM f GROUP BY 1""")
register("feature_family", lambda s, d: _picked(s, d).groupBy(A.family("feature").alias("family")).agg(F.count(F.lit(1)).alias("n")), f"""
WITH {_PICKED_SQL} SELECT split_part(feature, '_', 1) || '_' || split_part(feature, '_', 2) AS family, count(*) AS n FROM f GROUP BY 1""")
register("stable_features", lambda s, d: _round(A.stable_features(_picked(s, d), "feature", "source", 0.3), "share"), f"""
WITH {_PICKED_SQL} SELECT feature, round(count(DISTINCT source) / (SELECT count(DISTINCT source) FROM f), 6) AS share FROM f GROUP BY 1 HAVING count(DISTINCT source) / (SELECT count(DISTINCT source) FROM f) >= 0.3""")

register("amplitude_levels", lambda s, d: _round(A.amplitude_levels(table(s, d, "lineitem"), "l_quantity"), "min_step"), """
WITH v AS (SELECT DISTINCT l_quantity AS v FROM lineitem), t AS (SELECT v, v - lag(v) OVER (ORDER BY v) AS step FROM v)
SELECT count(*) AS n_levels, ceil(log2(count(*)))::BIGINT AS bits, round(min(step), 6) AS min_step, max(step) - min(step) <= 1e-9 AS uniform, min(v) AS min, max(v) AS max FROM t""")
register("column_sum", lambda s, d: table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.round(F.sum(A.summed(["l_discount", "l_tax"])), 6).alias("total")), """
SELECT l_orderkey, l_linenumber, round(sum(coalesce(l_discount, 0) + coalesce(l_tax, 0)), 6) AS total FROM lineitem GROUP BY 1, 2""")
register("mean_per_pair", lambda s, d: table(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.avg("l_discount"), 6).alias("mse")), """
SELECT l_returnflag, l_linestatus, round(avg(l_discount), 6) AS mse FROM lineitem GROUP BY 1, 2""")
register("regression_metrics", lambda s, d: _round(table(s, d, "lineitem").groupBy("l_returnflag").agg(*A.regression_errors("l_extendedprice", F.col("l_quantity") * 1500)), "rmse", "mae", "bias", "r2", digits=4), """
WITH e AS (SELECT l_returnflag, l_extendedprice AS y, l_quantity * 1500 - l_extendedprice AS e FROM lineitem)
SELECT l_returnflag, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(abs(e)), 4) AS mae, round(1 - sum(e * e) / (var_pop(y) * count(*)), 4) AS r2, round(avg(e), 4) AS bias FROM e GROUP BY 1""")
register("target_thresholds", lambda s, d: exact_quantiles(table(s, d, "orders"), "o_totalprice", [0.33, 0.66]).agg(F.round(F.min("quantile"), 4).alias("low"), F.round(F.max("quantile"), 4).alias("high")), """
SELECT round(quantile_cont(o_totalprice, 0.33), 4) AS low, round(quantile_cont(o_totalprice, 0.66), 4) AS high FROM orders""")

"""Queries over waveforms, arrays and scalars."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from vitalframe.functions import scalars as X
from vitalframe.kernels import features, registry, spectrum
from vitalframe.operators import joins as J
from vitalframe.operators import signals as G
from vitalframe.plans.catalog import register
from vitalframe.plans.roles import SAMPLES_SQL, samples, table


def _round(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


_CENTRED = SAMPLES_SQL + ", z AS (SELECT file_id, i, x - 50 AS x FROM s)"


def _centred(s, d):
    return samples(s, d).select("file_id", "i", (F.col("x") - 50).alias("x"))


register("gradient_features", lambda s, d: samples(s, d).withColumn("g", G.gradient()).groupBy("file_id").agg(F.round(F.avg(F.abs("g")), 6).alias("d1"), F.round(F.max("g"), 6).alias("top")), f"""
WITH {SAMPLES_SQL}, g AS (SELECT file_id, CASE WHEN lag(x) OVER w IS NULL THEN lead(x) OVER w - x WHEN lead(x) OVER w IS NULL THEN x - lag(x) OVER w ELSE (lead(x) OVER w - lag(x) OVER w) / 2 END AS g FROM s WINDOW w AS (PARTITION BY file_id ORDER BY i))
SELECT file_id, round(avg(abs(g)), 6) AS d1, round(max(g), 6) AS top FROM g GROUP BY 1""")
register("zero_crossing", lambda s, d: _round(G.sign_steps(_centred(s, d)), "zcr"), f"""
WITH {_CENTRED}, c AS (SELECT file_id, sign(x) AS s, lag(sign(x)) OVER (PARTITION BY file_id ORDER BY i) AS p FROM z)
SELECT file_id, round(sum((s <> p)::INT) / count(*), 6) AS zcr FROM c GROUP BY 1""")
register("extrema_count", lambda s, d: G.extrema(samples(s, d)), f"""
WITH {SAMPLES_SQL}, l AS (SELECT * FROM (SELECT *, lag(x) OVER (PARTITION BY file_id ORDER BY i) AS p FROM s) WHERE p IS NULL OR p <> x),
t AS (SELECT file_id, x, lag(x) OVER w AS b, lead(x) OVER w AS a FROM l WINDOW w AS (PARTITION BY file_id ORDER BY i))
SELECT file_id, count(*) FILTER (x > b AND x > a) AS n_maxima, count(*) FILTER (x < b AND x < a) AS n_minima FROM t GROUP BY 1""")
register("hampel_filter", lambda s, d: _round(G.hampel(samples(s, d), 3, 3.0).select("file_id", "i", "outlier", "fixed"), "fixed"), f"""
WITH {SAMPLES_SQL}, c AS (SELECT file_id, i, x, x - avg(x) OVER (PARTITION BY file_id) AS c FROM s),
m AS (SELECT *, list(c) OVER w AS l FROM c WINDOW w AS (PARTITION BY file_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
r AS (SELECT file_id, i, x, abs(c - list_sort(list_concat(l, [0.0::DOUBLE for _ in range(7 - len(l))]))[4]) AS r FROM m),
n AS (SELECT *, list(r) OVER w AS l FROM r WINDOW w AS (PARTITION BY file_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
o AS (SELECT file_id, i, x, r > 3.0 * (1.4826 * list_sort(list_concat(l, [0.0::DOUBLE for _ in range(7 - len(l))]))[4] + 1e-12) AS outlier FROM n),
f AS (SELECT *, last_value(CASE WHEN NOT outlier THEN x END IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN NOT outlier THEN i END IGNORE NULLS) OVER b AS i0,
        first_value(CASE WHEN NOT outlier THEN x END IGNORE NULLS) OVER a AS v1, first_value(CASE WHEN NOT outlier THEN i END IGNORE NULLS) OVER a AS i1 FROM o
      WINDOW b AS (PARTITION BY file_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY file_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT file_id, i, outlier, round(CASE WHEN NOT outlier THEN x ELSE coalesce(v0 + (v1 - v0) * (i - i0) / (i1 - i0), v0, v1) END, 6) AS fixed FROM f""")
register("moving_average", lambda s, d: _round(G.moving_average(samples(s, d), 2).select("file_id", "i", "smooth"), "smooth"), f"""
WITH {SAMPLES_SQL} SELECT file_id, i, round(sum(x) OVER (PARTITION BY file_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS smooth FROM s""")


def _scores(s, d):
    return samples(s, d).where("i % 4 = 0").groupBy("file_id", F.col("i").alias("start_sample")).agg(F.max("q").alias("score"))


register("overlap_add", lambda s, d: _round(G.overlap_add(_scores(s, d), 7, samples(s, d)), "score"), f"""
WITH {SAMPLES_SQL}, k AS (SELECT file_id, i + k AS i, q AS score, exp(-3.0 * (k * (2.0 / 6) - 1) * (k * (2.0 / 6) - 1)) AS w FROM s, (SELECT unnest(range(7)) AS k) WHERE i % 4 = 0),
a AS (SELECT file_id, i, sum(w * score) / sum(w) AS score FROM k GROUP BY 1, 2) SELECT s.file_id, s.i, round(a.score, 6) AS score FROM s JOIN a ON a.file_id = s.file_id AND a.i = s.i""")
register("pulses_to_samples", lambda s, d: _round(G.pulses_to_samples(samples(s, d).where("i % 9 = 0").select("file_id", F.col("i").alias("on"), (F.col("i") + 5).alias("off"), F.col("q").alias("score")), samples(s, d)), "score"), f"""
WITH {SAMPLES_SQL}, p AS (SELECT file_id, i + k AS i, q FROM s, (SELECT unnest(range(6)) AS k) WHERE i % 9 = 0), a AS (SELECT file_id, i, avg(q) AS score FROM p GROUP BY 1, 2)
SELECT s.file_id, s.i, round(coalesce(a.score, -0.15), 6) AS score FROM s LEFT JOIN a ON a.file_id = s.file_id AND a.i = s.i""")
_HRV = ("mean_nn", "sdnn", "rmssd", "median_nn", "pnn50", "min_nn", "max_nn")
register("ibi_hrv_time", lambda s, d: _round(G.interval_variability(samples(s, d).where("modality = 'click'"), 10.0), *_HRV), f"""
WITH {SAMPLES_SQL}, n AS (SELECT * FROM (SELECT file_id, i, (i - lag(i) OVER (PARTITION BY file_id ORDER BY i)) / 10.0::DOUBLE * 1000 AS nn FROM s WHERE modality = 'click') WHERE nn IS NOT NULL),
e AS (SELECT *, nn - lag(nn) OVER (PARTITION BY file_id ORDER BY i) AS e FROM n)
SELECT file_id, round(avg(nn), 6) AS mean_nn, round(stddev_samp(nn), 6) AS sdnn, round(sqrt(avg(e * e)), 6) AS rmssd, round(median(nn), 6) AS median_nn, round(100.0 * avg((abs(e) > 50)::INT), 6) AS pnn50, round(min(nn), 6) AS min_nn, round(max(nn), 6) AS max_nn, count(*) AS n FROM e GROUP BY 1""")


def _beats(s, d):
    marks = lambda m: samples(s, d).where(F.col("modality") == m).select("file_id", "i")
    return J.last_before_first_after(marks("click"), marks("view"), "file_id", "i")


_BEATS_SQL = SAMPLES_SQL + """, p AS (SELECT file_id, i FROM s WHERE modality = 'click'), o AS (SELECT file_id, i FROM s WHERE modality = 'view'),
b AS (SELECT p.file_id, a.i AS onset, p.i AS peak, c.i AS next_onset FROM p ASOF JOIN o a ON a.file_id = p.file_id AND a.i < p.i ASOF JOIN o c ON c.file_id = p.file_id AND c.i > p.i),
h AS (SELECT b.*, s.i, s.x, lead(s.x) OVER (PARTITION BY b.file_id, onset, peak ORDER BY s.i) AS nx FROM b JOIN s ON s.file_id = b.file_id AND s.i >= onset AND s.i < next_onset),
t AS (SELECT file_id, onset, peak, max(x) FILTER (i = peak) - min(x) AS amplitude, (coalesce(sum((x + nx) / 2), 0) - min(x) * (count(*) - 1)) / 2.0::DOUBLE AS auc, (next_onset - onset) / 2.0::DOUBLE AS t, (peak - onset) / 2.0::DOUBLE AS tr
      FROM h GROUP BY file_id, onset, peak, next_onset HAVING count(*) >= 3)"""
_METRICS = ["amplitude", "auc", "t", "tr"]
register("beat_metrics", lambda s, d: _round(G.beat_table(samples(s, d), _beats(s, d), 2.0), *_METRICS), f"WITH {_BEATS_SQL} SELECT file_id, onset, peak, " + ", ".join(f"round({m}, 6) AS {m}" for m in _METRICS) + " FROM t")
register("beat_aggregation", lambda s, d: _round(G.beat_summary(G.beat_table(samples(s, d), _beats(s, d), 2.0), _METRICS), *[f"{m}_{k}" for m in _METRICS for k in ("median", "cv")]), f"WITH {_BEATS_SQL} SELECT file_id, count(*) AS n_beats, " + ", ".join(
    f"round(CASE WHEN count(*) >= 5 THEN median({m}) END, 6) AS {m}_median, round(CASE WHEN count(*) >= 5 THEN stddev_samp({m}) / (abs(avg({m})) + 1e-8) END, 6) AS {m}_cv" for m in _METRICS) + " FROM t GROUP BY 1")
register("morphology_statistics", lambda s, d: _round(G.morphology(samples(s, d), _beats(s, d)), "mean", "std"), f"WITH {_BEATS_SQL} SELECT file_id, i - onset AS phase, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, count(*) AS n FROM h GROUP BY 1, 2")


def _lines(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("file_id"), F.posexplode("embedding").alias("f", "p")).select("file_id", F.col("f").cast("double").alias("f"), F.abs(F.col("p").cast("double")).alias("p"))


_LINES_SQL = "l AS (SELECT vec_id AS file_id, (unnest(range(64)))::DOUBLE AS f, abs(unnest(embedding)::DOUBLE) AS p FROM embeddings)"
register("energy_in_band", lambda s, d: _round(G.band_energy(_lines(s, d), 10.0, 30.0), "energy"), f"""
WITH {_LINES_SQL}, e AS (SELECT file_id, (lead(f) OVER w - f) * (lead(p) OVER w + p) / 2 AS e FROM l WHERE f BETWEEN 10 AND 30 WINDOW w AS (PARTITION BY file_id ORDER BY f)) SELECT file_id, round(sum(e), 6) AS energy FROM e GROUP BY 1""")
register("phase_unwrap", lambda s, d: _round(G.unwrapped(samples(s, d), "x", "i", "file_id", 90.0).select("file_id", "i", "unwrapped"), "unwrapped"), f"""
WITH {SAMPLES_SQL}, c AS (SELECT file_id, i, x, coalesce(-90 * round((x - lag(x) OVER (PARTITION BY file_id ORDER BY i)) / 90), 0) AS c FROM s) SELECT file_id, i, round(x + sum(c) OVER (PARTITION BY file_id ORDER BY i), 6) AS unwrapped FROM c""")
_PARTS = {"real": "re", "imag": "im", "mag": "m", "phase": "p", "log_mag": "ln(m + 1e-12)", "mag_db": "20 * log10(m + 1e-12)"}
register("bioimp_features", lambda s, d: (lambda df: _round(df, *[c for c in df.columns if c.startswith("bioimp_") and c not in ("bioimp_valid", "bioimp_n_points")]))(
    G.sweep_features(table(s, d, "lineitem").withColumn("re", F.col("l_quantity") - 25).withColumn("im", F.col("l_tax") * 500 - 20), "l_suppkey", "re", "im", ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"])), """
WITH z AS (SELECT *, l_quantity - 25 AS re, l_tax * 500 - 20 AS im FROM lineitem), t AS (SELECT *, atan2(im, re) AS t, sqrt(re * re + im * im) AS m FROM z),
u AS (SELECT *, coalesce(-2 * pi() * round((t - lag(t) OVER w) / (2 * pi())), 0) AS c FROM t WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice)),
x AS (SELECT *, t + sum(c) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS p FROM u)
SELECT l_suppkey, """ + ", ".join(f"round({f}({c}), 6) AS bioimp_{n}_{k}" for n, c in _PARTS.items() for k, f in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"))) + """,
round(sqrt(var_pop(re) + var_pop(im)), 6) AS bioimp_std, round(max(m) - min(m), 6) AS bioimp_peak_to_peak_mag, round(avg(re), 6) AS bioimp_mean_real, round(avg(im), 6) AS bioimp_mean_imag, count(*) AS bioimp_n_points, true AS bioimp_valid FROM x GROUP BY 1""")
register("line_features", lambda s, d: _round(G.line_features(table(s, d, "lineitem"), "l_suppkey", "l_extendedprice", "l_quantity"), "slope", "intercept", digits=4), """
SELECT l_suppkey, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem GROUP BY 1""")

register("array_stats", lambda s, d: _round(table(s, d, "embeddings").select("vec_id", *X.array_stats("embedding")), "mean", "std", "min", "max"), """
SELECT vec_id, round(list_avg(e), 6) AS mean, round(list_stddev_pop(e), 6) AS std, round(list_min(e), 6) AS min, round(list_max(e), 6) AS max FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)""")
register("array_invert_reverse", lambda s, d: table(s, d, "embeddings").select("vec_id", F.round(F.reverse(X.inverted("embedding"))[0].cast("double"), 6).alias("first"), F.round(F.element_at(F.reverse(X.inverted("embedding")), -1).cast("double"), 6).alias("last")), """
SELECT vec_id, round(-embedding[64]::DOUBLE, 6) AS first, round(-embedding[1]::DOUBLE, 6) AS last FROM embeddings""")
register("array_minmax", lambda s, d: table(s, d, "embeddings").select("vec_id", F.posexplode(X.scaled_array(F.col("embedding").cast("array<double>"))).alias("k", "v")).withColumn("v", F.round("v", 5)), """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT vec_id, unnest(range(64))::INT AS k, round(unnest([(x - list_min(e)) / (list_max(e) - list_min(e)) for x in e]), 5) AS v FROM e""")
register("array_fitted", lambda s, d: table(s, d, "embeddings").select("vec_id", F.size(X.fitted_length("embedding", 80)).alias("n"), F.round(F.element_at(X.fitted_length("embedding", 80), -1).cast("double"), 6).alias("last"), F.size(X.fitted_length("embedding", 10)).alias("short")), """
SELECT vec_id, 80 AS n, round(embedding[64]::DOUBLE, 6) AS last, 10 AS short FROM embeddings""")


def _consecutive(s, d):
    w = Window.partitionBy("label").orderBy("vec_id")
    rows = table(s, d, "embeddings").withColumn("next", F.lead("embedding").over(w)).where("next IS NOT NULL")
    return rows.select("vec_id", F.round(X.cosine("embedding", "next"), 6).alias("c")).withColumn("sqi", F.round(X.similarity_quality("c"), 5))


register("cosine_consecutive", _consecutive, """
WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS a, lead(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings),
c AS (SELECT vec_id, round(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 6) AS c FROM n WHERE b IS NOT NULL)
SELECT vec_id, c, round(exp(8.0 * 50.0 * (c + 1) / 99.0) / exp(8.0), 5) AS sqi FROM c""")

register("twos_complement", lambda s, d: table(s, d, "part").select("p_partkey", X.twos_complement(F.pmod("p_partkey", F.lit(256)), 8).alias("v")), "SELECT p_partkey, CASE WHEN p_partkey % 256 < 128 THEN p_partkey % 256 ELSE p_partkey % 256 - 256 END AS v FROM part")
register("id_normalise", lambda s, d: table(s, d, "customer").select("c_custkey", X.participant_name(F.concat(F.lit("#"), F.lpad(F.col("c_custkey").cast("string"), F.greatest(F.lit(4), F.length(F.col("c_custkey").cast("string"))), F.lit("0")))).alias("name"), X.numeric_id(F.concat(F.lit("#"), F.col("c_custkey").cast("string"))).alias("number"),
         X.normalised_name(F.concat(F.col("c_mktsegment"), F.lit(" a-B"))).alias("column"), X.padded_number(F.concat(F.lit("file_id"), (F.col("c_custkey") % 100).cast("string")), "file_id").alias("padded")), """
SELECT c_custkey, 'hu_' || lpad(CASE WHEN c_custkey = 0 THEN '' ELSE c_custkey::VARCHAR END, greatest(2, length(c_custkey::VARCHAR))::INT, '0') AS name, c_custkey AS number,
lower(c_mktsegment) || '_a_b' AS "column", lpad((c_custkey % 100)::VARCHAR, 3, '0') AS padded FROM customer""")
register("plain_filenames", lambda s, d: table(s, d, "pages").select("page_id", X.is_plain_filename("url").alias("plain"), X.truthy(F.when(F.col("page_id") % 3 == 0, " Yes ").otherwise("no")).alias("flag")), "SELECT page_id, NOT contains(url, '/') AS plain, page_id % 3 = 0 AS flag FROM pages")
register("stratified_class", lambda s, d: table(s, d, "orders").groupBy("o_custkey").agg(F.median("o_totalprice").alias("m")).select("o_custkey", X.stratum("m", 200000.0, 300000.0).alias("class")), """
SELECT o_custkey, CASE WHEN median(o_totalprice) < 200000 THEN 'low' WHEN median(o_totalprice) <= 300000 THEN 'normal' ELSE 'high' END AS class FROM orders GROUP BY 1""")
register("natural_order", lambda s, d: table(s, d, "customer").select("c_custkey", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.regexp_extract("c_name", "^(.*?)[0-9]*$", 1), F.regexp_extract("c_name", "([0-9]+)$", 1).cast("long"))).alias("place")), """
SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY regexp_extract(c_name, '^(.*?)[0-9]*$', 1), regexp_extract(c_name, '([0-9]+)$', 1)::BIGINT)::INT AS place FROM customer""")
register("top_pairs", lambda s, d: table(s, d, "lineitem").where("abs(l_discount - l_tax) >= 0.05").orderBy(F.abs(F.col("l_discount") - F.col("l_tax")).desc(), F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber", "l_partkey").limit(50).select("l_orderkey", "l_linenumber", "l_partkey"), """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE abs(l_discount - l_tax) >= 0.05 ORDER BY abs(l_discount - l_tax) DESC, l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 50""")


def _waves(s, d):
    """embeddings as waveforms of 64 samples, repeated to 512, with a slow pulse added so that beats exist."""
    pulse = [float(v) for v in np.sin(2 * np.pi * 1.2 * np.arange(512) / 60.0)]
    long = F.flatten(F.array_repeat(F.col("embedding").cast("array<double>"), 8))
    rows = registry.dealt(table(s, d, "embeddings").select("vec_id", "embedding"))
    return rows.select(F.col("vec_id").alias("file_id"), F.zip_with(long, F.array(*[F.lit(v) for v in pulse]), lambda a, b: a + b).alias("samples"))


def _spread(df):
    return df.select("file_id", "status", F.size("samples").alias("n"), *[F.round(c, 5) for c in X.array_stats("samples")])


for _kind, _name in list(registry.PIPELINES):
    register(f"wave_{_name}", lambda s, d, k=_kind, n=_name: _spread(registry.process(_waves(s, d), k, n, 60.0)))
register("spectral_features", lambda s, d: registry.extract(_waves(s, d), 60.0, spectrum.spectral_features, list(spectrum.SPECTRAL), "file_id"))
register("ppg_features", lambda s, d: registry.ppg_table(_waves(s, d), 60.0, key="file_id"))
register("ecg_features", lambda s, d: registry.ecg_table(_waves(s, d), 60.0, "file_id"))
register("imf_features", lambda s, d: registry.extract(_waves(s, d), 60.0, features.emd_features, [f"IMF_1_{k}" for k in features.IMF], "file_id"))
register("fiducial_points", lambda s, d: registry.fiducial_table(_waves(s, d), 60.0))


def _weights(window: int, degree: int) -> list[list[Fraction]]:
    """Exact least squares weights of a window's places, by the normal equations in fractions."""
    at = range(-(window // 2), window // 2 + 1)
    a = [[Fraction(sum(t ** (i + j) for t in at)) for j in range(degree + 1)] + [Fraction(int(i == k)) for k in range(degree + 1)] for i in range(degree + 1)]
    for i in range(degree + 1):
        top = next(r for r in range(i, degree + 1) if a[r][i])
        a[i], a[top] = a[top], a[i]
        a[i] = [v / a[i][i] for v in a[i]]
        for r in range(degree + 1):
            if r != i:
                a[r] = [v - a[r][i] * w for v, w in zip(a[r], a[i])]
    inverse = [row[degree + 1 :] for row in a]
    return [[sum(t**i * inverse[i][j] * u**j for i in range(degree + 1) for j in range(degree + 1)) for u in at] for t in at]


def _smoothed_sql() -> str:
    """Each sample of a file meets the samples of its window by position, with the place's weight."""
    rows = ", ".join(f"({s}, {p}, {j}, {float(w)!r}::DOUBLE)" for s in (11, 9, 7, 5) for p, row in enumerate(_weights(s, 3)) for j, w in enumerate(row))
    return f"""
{SAMPLES_SQL}, n AS (SELECT file_id, count(*) AS n, CASE WHEN count(*) >= 11 THEN 11 WHEN count(*) >= 9 THEN 9 WHEN count(*) >= 7 THEN 7 WHEN count(*) >= 5 THEN 5 END AS w FROM s GROUP BY 1),
h(w, p, j, c) AS (VALUES {rows}), place AS (SELECT s.file_id, i, w, CASE WHEN i < w // 2 THEN 0 WHEN i >= n - w // 2 THEN n - w ELSE i - w // 2 END AS first FROM s JOIN n USING (file_id) WHERE w IS NOT NULL),
smooth AS (SELECT p.file_id, p.i, sum(c * x) AS smooth FROM place p JOIN h ON h.w = p.w AND h.p = p.i - p.first JOIN s ON s.file_id = p.file_id AND s.i = p.first + h.j GROUP BY 1, 2),
done AS (SELECT s.file_id, s.i, s.x, coalesce(smooth, s.x) AS smooth FROM s LEFT JOIN smooth USING (file_id, i))"""


register("sweep_smoothed", lambda s, d: G.polynomial_smoothed(samples(s, d), "file_id", "i", "x").select("file_id", "i", F.round("smooth", 5).alias("smooth")),
         f"WITH {_smoothed_sql()} SELECT file_id, i, round(smooth, 5) AS smooth FROM done")
register("sweep_quality", lambda s, d: G.sweep_quality(samples(s, d).withColumn("x", F.col("i") + F.col("x") / 25), "file_id", "i", "x").select("file_id", "n", F.round("quality", 6).alias("quality")),
         f"WITH {_smoothed_sql().replace('value AS x', '(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) + value / 25 AS x')} SELECT file_id, count(*) AS n, round(greatest(0, least(1, (0.004 - CASE WHEN max(x) > min(x) THEN avg((x - smooth) ** 2) / (max(x) - min(x)) ** 2 ELSE 0 END - 2e-6) / (2 * (0.002 - 2e-6)))), 6) AS quality FROM done GROUP BY 1")
register("quadratic_features", lambda s, d: _round(G.quadratic_features(table(s, d, "lineitem"), "l_suppkey", "l_extendedprice", "l_quantity"), "quadratic", digits=4), """
WITH c AS (SELECT l_suppkey, l_extendedprice::DOUBLE AS y, l_quantity::DOUBLE - avg(l_quantity::DOUBLE) OVER (PARTITION BY l_suppkey) AS t, l_quantity FROM lineitem),
g AS (SELECT l_suppkey, count(*)::DOUBLE AS n, count(DISTINCT l_quantity) AS k, sum(t * t) AS s2, sum(t * t * t) AS s3, sum(t * t * t * t) AS s4, sum(y) AS y0, sum(t * y) AS y1, sum(t * t * y) AS y2 FROM c GROUP BY 1)
SELECT l_suppkey, CASE WHEN k >= 3 THEN round((n * (s2 * y2 - s3 * y1) - s2 * s2 * y0) / (n * (s2 * s4 - s3 * s3) - s2 * s2 * s2), 4) END AS quadratic FROM g""")
register("array_between", lambda s, d: table(s, d, "embeddings").select("vec_id", F.posexplode(X.scaled_between(F.col("embedding").cast("array<double>"), 0.1, 0.9)).alias("k", "v")).withColumn("v", F.round("v", 5)), """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT vec_id, unnest(range(64))::INT AS k, round(unnest([0.1 + 0.8 * (x - list_min(e)) / (list_max(e) - list_min(e)) for x in e]), 5) AS v FROM e""")

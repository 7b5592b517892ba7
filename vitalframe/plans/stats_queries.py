"""Queries over statistics of feature tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalframe.functions.nulls import safe_corr
from vitalframe.operators import stats as T
from vitalframe.operators.ordering import rank_correlations
from vitalframe.plans.catalog import register
from vitalframe.plans.roles import table

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _dirty(s, d):
    return table(s, d, "lineitem").select(
        "l_orderkey", F.when(F.col("l_partkey") % 50 == 0, F.lit("abc")).otherwise(F.col("l_quantity").cast("string")).alias("a"),
        F.when(F.col("l_partkey") % 40 == 1, F.lit(float("nan"))).when(F.col("l_partkey") % 40 == 2, F.lit(float("inf"))).when(F.col("l_partkey") % 40 == 3, F.lit(float("-inf"))).otherwise(F.col("l_tax")).alias("b"),
        F.when(F.col("l_partkey") % 5 != 0, F.col("l_discount")).alias("c"), F.lit(7.0).alias("e"))


_DIRTY_SQL = """
x AS (SELECT l_orderkey, CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE l_quantity END AS a,
  CASE WHEN l_partkey % 40 = 1 THEN 'nan'::DOUBLE WHEN l_partkey % 40 = 2 THEN 'inf'::DOUBLE WHEN l_partkey % 40 = 3 THEN '-inf'::DOUBLE ELSE l_tax END AS b,
  CASE WHEN l_partkey % 5 <> 0 THEN l_discount END AS c, 7.0::DOUBLE AS e FROM lineitem)"""

register("problem_report", lambda s, d: T.problem_report(_dirty(s, d), ["a", "b", "c", "e"]).withColumn("share_bad", F.round("share_bad", 6)), f"""
WITH {_DIRTY_SQL}, u AS (SELECT 'a' AS feature, a AS v FROM x UNION ALL SELECT 'b', b FROM x UNION ALL SELECT 'c', c FROM x UNION ALL SELECT 'e', e FROM x),
c AS (SELECT feature, count(*) AS n, count(*) FILTER (v IS NULL OR isnan(v)) AS n_nan, count(*) FILTER (v = 'inf'::DOUBLE) AS n_pos_inf, count(*) FILTER (v = '-inf'::DOUBLE) AS n_neg_inf FROM u GROUP BY 1)
SELECT *, n_nan + n_pos_inf + n_neg_inf AS n_bad, round((n_nan + n_pos_inf + n_neg_inf) / n, 6) AS share_bad, n - (n_nan + n_pos_inf + n_neg_inf) AS n_valid FROM c""")
register("impute_median", lambda s, d: T.clean_and_impute(_dirty(s, d), ["a", "b", "c", "e"]), f"""
WITH {_DIRTY_SQL} SELECT l_orderkey, coalesce(a, (SELECT median(a) FROM x)) AS a, CASE WHEN isnan(b) OR isinf(b) THEN (SELECT median(b) FROM x WHERE NOT isnan(b) AND NOT isinf(b)) ELSE b END AS b FROM x""")
register("zscore", lambda s, d: T.scaled(table(s, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice"), ["p_size", "p_retailprice"]).withColumns({c: F.round(c, 6) for c in ("p_size", "p_retailprice")}), """
SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 6) AS p_size, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 6) AS p_retailprice FROM part""")
register("minmax", lambda s, d: T.scaled(table(s, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size")), ["p_size"], how="minmax").withColumn("p_size", F.round("p_size", 6)), """
SELECT p_partkey, round((p_size - min(p_size) OVER ()) / (max(p_size) OVER () - min(p_size) OVER ())::DOUBLE, 6) AS p_size FROM part""")
register("scaled_by_reference", lambda s, d: T.scaled(table(s, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("v")), ["v"], fit_on=table(s, d, "customer").select(F.col("c_acctbal").alias("v"))).withColumn("v", F.round("v", 6)), """
SELECT s_suppkey, round((s_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_pop(c_acctbal) FROM customer), 6) AS v FROM supplier""")


def _related(s, d):
    return table(s, d, "lineitem").select(*FEATURES, (F.col("l_quantity") * 2 + 1).alias("line"), (-F.col("l_tax")).alias("negated"))


_NAMES = [*FEATURES, "line", "negated"]
_PAIRS_SQL = "x AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_quantity * 2 + 1 AS line, -l_tax AS negated FROM lineitem), p AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, {a} AS x, {b} AS y FROM x" for i, a in enumerate(_NAMES) for b in _NAMES[i + 1 :]) + ")"
register("corr_pairs", lambda s, d: T.feature_pairs(_related(s, d), _NAMES).select("feature_1", "feature_2", F.round("r", 6).alias("r"), F.round("share_equal", 6).alias("share_equal"), F.round("share_negated", 6).alias("share_negated"), "n"), f"""
WITH {_PAIRS_SQL} SELECT feature_1, feature_2, round(covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)), 6) AS r, round(avg((x = y)::INT), 6) AS share_equal, round(avg((x = -y)::INT), 6) AS share_negated, count(*) AS n FROM p GROUP BY 1, 2""")
register("near_duplicate_pairs", lambda s, d: T.near_duplicate_pairs(T.feature_pairs(_related(s, d), _NAMES)).select("feature_1", "feature_2", F.round("r", 6).alias("r")), f"""
WITH {_PAIRS_SQL} SELECT feature_1, feature_2, round(corr(x, y), 6) AS r FROM p GROUP BY 1, 2 HAVING abs(corr(x, y)) >= 0.95""")
register("affine_pairs", lambda s, d: T.affine_pairs(_related(s, d), T.feature_pairs(_related(s, d), _NAMES), _NAMES).where("max_residual < 1e-6").select("feature_1", "feature_2"), f"""
WITH {_PAIRS_SQL}, l AS (SELECT feature_1, feature_2, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM p GROUP BY 1, 2)
SELECT feature_1, feature_2 FROM p JOIN l USING (feature_1, feature_2) GROUP BY 1, 2 HAVING max(abs(y - a * x - b)) < 1e-6""")
register("icc", lambda s, d: T.variance_components(table(s, d, "orders"), "o_custkey", "o_totalprice").select("k", "total", F.round("icc", 6).alias("icc"), F.round("within_pct", 4).alias("within_pct"), F.round(F.col("msw") / 1e6, 4).alias("msw")), """
WITH g AS (SELECT count(*) AS n, avg(o_totalprice) AS m, var_pop(o_totalprice) AS v FROM orders GROUP BY o_custkey),
t AS (SELECT count(*) AS k, sum(n) AS total, sum(n * v) AS ssw, avg(n) AS size, sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n) AS ssb FROM g),
m AS (SELECT *, ssb / (k - 1) AS msb, ssw / (total - k) AS msw FROM t), b AS (SELECT *, greatest((msb - msw) / size, 0) AS sb FROM m)
SELECT k, total::BIGINT AS total, round(sb / (sb + msw), 6) AS icc, round(msw / (sb + msw) * 100, 4) AS within_pct, round(msw / 1e6, 4) AS msw FROM b""")
register("centered_corr", lambda s, d: T.centered(table(s, d, "lineitem"), "l_orderkey", ["l_quantity", "l_extendedprice"]).agg(F.round(safe_corr("l_quantity", "l_extendedprice"), 6).alias("r")), """
WITH c AS (SELECT l_quantity - avg(l_quantity) OVER (PARTITION BY l_orderkey) AS x, l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_orderkey) AS y FROM lineitem) SELECT round(corr(x, y), 6) AS r FROM c""")
register("spearman", lambda s, d: rank_correlations(table(s, d, "lineitem"), "l_extendedprice", ["l_quantity"]).agg(F.round(F.first("spearman"), 6).alias("rho")), """
WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0::DOUBLE AS b FROM lineitem)
SELECT round(corr(a, b), 6) AS rho FROM r""")
register("unique_values", lambda s, d: T.long_form(table(s, d, "lineitem"), [], FEATURES).groupBy("feature").agg(F.count_distinct("value").alias("n_unique"), F.round(F.log2(F.count_distinct("value")), 6).alias("bits")), "WITH " + "u AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, {f} AS v FROM lineitem" for f in FEATURES) + ") SELECT feature, count(DISTINCT v) AS n_unique, round(log2(count(DISTINCT v)), 6) AS bits FROM u GROUP BY 1")

_CHAR = ["pearson", "spearman", "centered", "mean", "std", "skew", "kurt", "missing_pct", "rm_corr", "cv", "icc", "within_pct"]


def _char_sql(source: str, subject: str, target: str, features: dict[str, str]) -> str:
    """Common tables up to f, one row per feature; source is a table, features are names with expressions."""
    union = " UNION ALL ".join(f"SELECT {subject} AS k, {target} AS y, '{n}' AS feature, ({e})::DOUBLE AS x FROM {source}" for n, e in features.items())
    return f"""u AS ({union}),
c AS (SELECT *, x - avg(x) OVER (PARTITION BY feature, k) AS dx, y - avg(y) OVER (PARTITION BY feature, k) AS dy,
      rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0::DOUBLE AS ry FROM u WHERE x IS NOT NULL),
g AS (SELECT feature, k, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM c GROUP BY 1, 2),
t AS (SELECT feature, count(*) AS k, sum(n) AS total, sum(n * v) / (sum(n) - count(*)) AS msw, avg(n) AS size, (sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n)) / (count(*) - 1) AS msb FROM g GROUP BY 1),
i AS (SELECT feature, greatest((msb - msw) / size, 0) AS sb, msw FROM t),
f AS (SELECT feature, corr(x, y) AS pearson, corr(rx, ry) AS spearman, corr(dx, dy) AS centered, avg(x) AS mean, stddev_samp(x) AS std, skewness(x) AS skew, kurtosis(x) AS kurt, count(DISTINCT x) AS n_unique, corr(dx, dy) AS rm_corr,
      stddev_samp(x) / abs(avg(x)) AS cv, any_value(sb / (sb + msw)) AS icc, any_value(msw / (sb + msw) * 100) AS within_pct, any_value(missing) AS missing_pct
      FROM c JOIN i USING (feature) JOIN (SELECT feature, avg((x IS NULL)::INT) * 100 AS missing FROM u GROUP BY 1) USING (feature) GROUP BY 1)"""


def _characterised(s, d):
    rows = table(s, d, "lineitem").select("l_suppkey", "l_extendedprice", "l_quantity", F.when(F.col("l_partkey") % 5 > 0, F.col("l_discount")).alias("l_discount"), "l_tax")
    return T.characterised(rows, "l_suppkey", "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])


register("characterised_features", lambda s, d: _characterised(s, d).select("feature", "n_unique", *[F.round(c, 5).alias(c) for c in _CHAR]), "WITH " + _char_sql(
    "lineitem", "l_suppkey", "l_extendedprice", {"l_quantity": "l_quantity", "l_discount": "CASE WHEN l_partkey % 5 > 0 THEN l_discount END", "l_tax": "l_tax"}) + " SELECT feature, n_unique, " + ", ".join(f"round({c}, 5) AS {c}" for c in _CHAR) + " FROM f")

#: Features of the parts table, whose size lets SQL compare every pair of rows.
_PART = {"size": "p_size", "retail": "p_retailprice * 2", "shift": "p_partkey % 97", "half": "CASE WHEN p_partkey % 2 = 0 THEN p_size END", "flag": "p_partkey % 2", "line": "p_size * 3 + 1"}


def _parts_table(s, d):
    return table(s, d, "part").select(F.col("p_brand"), (F.col("p_retailprice") + F.col("p_size") * 9).alias("y"), *[F.expr(e).cast("double").alias(n) for n, e in _PART.items()])


#: Mutual information by the third nearest neighbour: p has i and n by (feature), d the reach, m the counts within it.
_NEAR_SQL = """
v AS (SELECT feature, x, y, row_number() OVER (PARTITION BY feature ORDER BY y, x) - 1 AS i, count(*) OVER (PARTITION BY feature) AS n, avg(x) OVER w AS mx, stddev_pop(x) OVER w AS sx, avg(y) OVER w AS my, stddev_pop(y) OVER w AS sy
      FROM q WINDOW w AS (PARTITION BY feature)),
p AS (SELECT feature, i, n, (x - mx) / sx + 1e-10::DOUBLE * ((i * i)::DOUBLE * 0.6180339887498949::DOUBLE % 1) AS x, (y - my) / sy + 1e-10::DOUBLE * ((i * i)::DOUBLE * 0.7548776662466927::DOUBLE % 1) AS y FROM v),
d AS (SELECT a.feature, a.i, any_value(a.n) AS n, any_value(a.x) AS x, any_value(a.y) AS y, list_sort(min(greatest(abs(a.x - b.x), abs(a.y - b.y)), 3))[3] AS reach FROM p a JOIN p b ON a.feature = b.feature AND a.i <> b.i GROUP BY 1, 2),
m AS (SELECT d.feature, d.i, any_value(d.n) AS n, count(*) FILTER (abs(d.x - p.x) < d.reach) AS nx, count(*) FILTER (abs(d.y - p.y) < d.reach) AS ny FROM d JOIN p ON d.feature = p.feature GROUP BY 1, 2),
h AS (SELECT r AS at, sum(1.0::DOUBLE / greatest(r - 1, 1)) OVER (ORDER BY r) - 1 - 0.5772156649015329::DOUBLE AS psi FROM (SELECT unnest(range(1, (SELECT max(n) + 2 FROM m))) AS r)),
mi AS (SELECT m.feature, greatest(0, any_value(k.psi) + any_value(t.psi) - avg(a.psi + b.psi)) AS mi FROM m JOIN h a ON a.at = m.nx JOIN h b ON b.at = m.ny JOIN h t ON t.at = m.n JOIN h k ON k.at = 3 GROUP BY 1)"""
_PART_SQL = "part_y AS (SELECT *, p_retailprice + p_size * 9 AS y FROM part), " + _char_sql("part_y", "p_brand", "y", _PART) + ", q AS (SELECT feature, x, y FROM c)," + _NEAR_SQL
_SCORED = """, s AS (SELECT *, 0.3 * abs(coalesce(rm_corr, 0)) + 0.25 * abs(coalesce(centered, 0)) + 0.2 * abs(coalesce(pearson, 0)) + 0.15 * abs(coalesce(spearman, 0)) + 0.1 * (mi - min(mi) OVER ()) / (max(mi) OVER () - min(mi) OVER ()) AS score FROM f JOIN mi USING (feature))"""
register("composite_score", lambda s, d: T.judged_features(_parts_table(s, d), "p_brand", "y", list(_PART)).select("feature", F.round("mi", 6).alias("mi"), F.round("composite_score", 6).alias("score")), f"""
WITH {_PART_SQL}{_SCORED} SELECT feature, round(mi, 6) AS mi, round(score, 6) AS score FROM s""")
register("interpretation", lambda s, d: T.judged_features(_parts_table(s, d), "p_brand", "y", list(_PART)).select("feature", F.col("interpretation").alias("label")), f"""
WITH {_PART_SQL} SELECT feature, CASE WHEN missing_pct >= 40 THEN 'High missingness' WHEN n_unique <= 3 THEN 'Low-resolution / near-constant feature'
WHEN icc >= 0.75 AND abs(coalesce(rm_corr, 0)) < 0.2 AND abs(coalesce(centered, 0)) < 0.2 THEN 'Mostly subject-specific' WHEN abs(coalesce(rm_corr, 0)) >= 0.3 AND within_pct >= 50 THEN 'Dynamic biomarker'
WHEN abs(coalesce(rm_corr, 0)) >= 0.3 AND icc >= 0.5 THEN 'Dynamic with strong subject baseline' WHEN abs(coalesce(pearson, 0)) >= 0.3 AND abs(coalesce(centered, 0)) < 0.15 AND icc >= 0.6 THEN 'Mostly between-subject association' ELSE 'Mixed behavior' END AS label FROM f""")
register("target_relevance", lambda s, d: T.relevance_report(_parts_table(s, d), "y", list(_PART)).select("feature", F.round("r", 6).alias("r"), F.round("mi", 6).alias("mi")), f"""
WITH {_PART_SQL} SELECT feature, round(pearson, 6) AS r, round(mi, 6) AS mi FROM f JOIN mi USING (feature)""")
register("information_matrix", lambda s, d: T.information_matrix(_parts_table(s, d), ["size", "retail", "shift"]).withColumn("mi", F.round("mi", 6)), f"""
WITH q AS (SELECT 'size|retail' AS feature, p_size::DOUBLE AS x, p_retailprice * 2::DOUBLE AS y FROM part UNION ALL SELECT 'size|shift', p_size, p_partkey % 97 FROM part UNION ALL SELECT 'retail|shift', p_retailprice * 2, p_partkey % 97 FROM part),{_NEAR_SQL}
SELECT split_part(feature, '|', 1) AS feature_1, split_part(feature, '|', 2) AS feature_2, round(mi, 6) AS mi FROM mi""")
register("reduced_features", lambda s, d: T.reduced_features(_parts_table(s, d), list(_PART))[1].select("feature_1", "feature_2", F.round("r", 6).alias("r"), "affine"), "WITH x AS (SELECT " + ", ".join(f"({e})::DOUBLE AS {n}" for n, e in _PART.items()) + " FROM part), p AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, {a} AS x, {b} AS y FROM x" for i, a in enumerate(_PART) for b in list(_PART)[i + 1 :]) + """), l AS (SELECT feature_1, feature_2, corr(x, y) AS r, regr_slope(y, x) AS a, regr_intercept(y, x) AS b, stddev_pop(y) AS sy FROM p WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2 HAVING stddev_pop(x) > 0 AND stddev_pop(y) > 0 AND abs(corr(x, y)) >= 0.95)
SELECT feature_1, feature_2, round(any_value(r), 6) AS r, max(abs(y - a * x - b) / sy) < 1e-10 AS affine FROM p JOIN l USING (feature_1, feature_2) WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2""")


def _bucketed(s, d):
    rows = table(s, d, "lineitem")
    edges = {c: T.equal_frequency_edges(rows, c, 10) for c in ("l_quantity", "l_extendedprice")}
    return rows.select(*[T.bucketed(c, e).alias(c) for c, e in edges.items()], "l_returnflag")


_BUCKET_SQL = "b AS (SELECT " + ", ".join(
    "(" + " + ".join(f"({c} >= (SELECT quantile_cont({c}, {k / 10}) FROM lineitem))::INT" for k in range(1, 10)) + f") AS {c}" for c in ("l_quantity", "l_extendedprice")) + ", l_returnflag FROM lineitem)"
register("equal_frequency_bins", lambda s, d: _bucketed(s, d).groupBy("l_quantity").agg(F.count(F.lit(1)).alias("n")), f"WITH {_BUCKET_SQL} SELECT l_quantity, count(*) AS n FROM b GROUP BY 1")
register("conditional_mi", lambda s, d: T.conditional_information(_bucketed(s, d), "l_quantity", "l_extendedprice", "l_returnflag").select(F.round("cmi", 6).alias("cmi")), f"""
WITH {_BUCKET_SQL}, j AS (SELECT l_quantity AS x, l_extendedprice AS y, l_returnflag AS z, count(*)::DOUBLE AS n FROM b GROUP BY 1, 2, 3),
t AS (SELECT n / sum(n) OVER () AS p, n * sum(n) OVER (PARTITION BY z) / (sum(n) OVER (PARTITION BY x, z) * sum(n) OVER (PARTITION BY y, z)) AS r FROM j) SELECT round(sum(p * ln(r + 1e-12)), 6) AS cmi FROM t""")


def _residual(s, d):
    rows = table(s, d, "lineitem").select(F.col("l_quantity").alias("z"), F.col("l_extendedprice").alias("y"), F.col("l_tax").alias("x"))
    line = rows.agg(F.regr_slope("y", "z").alias("sy"), F.regr_intercept("y", "z").alias("iy"), F.regr_slope("x", "z").alias("sx"), F.regr_intercept("x", "z").alias("ix"))
    made = rows.crossJoin(F.broadcast(line)).select((F.col("y") - F.col("sy") * F.col("z") - F.col("iy")).alias("ry"), (F.col("x") - F.col("sx") * F.col("z") - F.col("ix")).alias("rx"))
    return made.agg(F.round(safe_corr("ry", "rx"), 6).alias("partial"))


register("partial_correlation", _residual, """
WITH l AS (SELECT regr_slope(l_extendedprice, l_quantity) AS sy, regr_intercept(l_extendedprice, l_quantity) AS iy, regr_slope(l_tax, l_quantity) AS sx, regr_intercept(l_tax, l_quantity) AS ix FROM lineitem)
SELECT round(corr(l_extendedprice - sy * l_quantity - iy, l_tax - sx * l_quantity - ix), 6) AS partial FROM lineitem, l""")
_MRMR = ["l_quantity", "l_discount", "l_tax", "line", "negated"]
register("mrmr_selection", lambda s, d: s.createDataFrame([(i, f) for i, f in enumerate(T.mrmr(_related(s, d), "l_extendedprice", _MRMR, 3))], "place int, feature string"), f"""
WITH {_PAIRS_SQL}, c AS (SELECT feature_1, feature_2, abs(corr(x, y)) AS r FROM p GROUP BY 1, 2), b AS (SELECT feature_1, feature_2, r FROM c UNION ALL SELECT feature_2, feature_1, r FROM c),
v AS (SELECT feature_2 AS f, r * r / greatest(1e-12, 1 - r * r) * (SELECT count(*) - 2 FROM x) AS v FROM b WHERE feature_1 = 'l_extendedprice'),
one AS (SELECT arg_max(f, (v, f)) AS f FROM v),
two AS (SELECT arg_max(v.f, (v / greatest(r, 1e-3), v.f)) AS f FROM v JOIN one ON v.f <> one.f JOIN b ON feature_1 = v.f AND feature_2 = one.f),
three AS (SELECT arg_max(f, (s, f)) AS f FROM (SELECT v.f, any_value(v) / greatest(avg(r), 1e-3) AS s FROM v JOIN b ON feature_1 = v.f AND feature_2 IN (SELECT f FROM one UNION ALL SELECT f FROM two) WHERE v.f NOT IN (SELECT f FROM one UNION ALL SELECT f FROM two) GROUP BY 1))
SELECT 0 AS place, f AS feature FROM one UNION ALL SELECT 1, f FROM two UNION ALL SELECT 2, f FROM three""")

#: Features of which some are equal to, the negation of, or close to another one.
_TWINS = {"qty": "l_quantity", "same": "l_quantity * 1", "minus": "-l_quantity", "near": "l_quantity + CASE WHEN l_linenumber = 1 THEN 0.5 ELSE 0 END", "tax": "l_tax"}


def _twins(s, d):
    return table(s, d, "lineitem").select("l_suppkey", "l_extendedprice", *[F.expr(e).cast("double").alias(n) for n, e in _TWINS.items()])


register("identical_pairs", lambda s, d: T.identical_pairs(_twins(s, d), list(_TWINS)).select("feature_1", "feature_2", "equal", "close", "negated", *[F.round(c, 5).alias(c) for c in ("mean_difference", "max_difference", "std_difference", "equal_pct")]), " UNION ALL ".join(
    f"""SELECT '{a}' AS feature_1, '{b}' AS feature_2, bool_and(x = y) AS equal, bool_and(abs(x - y) <= 1e-9 * greatest(abs(x), abs(y), 1)) AS close, bool_and(x = -y) AS negated, round(avg(abs(x - y)), 5) AS mean_difference,
    round(max(abs(x - y)), 5) AS max_difference, round(stddev_pop(abs(x - y)), 5) AS std_difference, round(avg((x = y)::INT) * 100, 5) AS equal_pct FROM (SELECT ({_TWINS[a]})::DOUBLE AS x, ({_TWINS[b]})::DOUBLE AS y FROM lineitem)"""
    for i, a in enumerate(_TWINS) for b in list(_TWINS)[i + 1 :]))
register("selected_variance", lambda s, d: T.chosen_variance(_twins(s, d), ["qty", "near", "tax"], "l_suppkey").select("feature", F.round("icc", 6).alias("icc"), F.round("within_pct", 4).alias("within_pct")), "WITH " + _char_sql(
    "lineitem", "l_suppkey", "l_extendedprice", {n: _TWINS[n] for n in ("qty", "near", "tax")}) + " SELECT feature, round(icc, 6) AS icc, round(within_pct, 4) AS within_pct FROM f")

"""Queries over splits, models and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalframe.kernels.regressors import MODEL_SETS
from vitalframe.operators import models as M
from vitalframe.operators import neighbours as N
from vitalframe.operators import splits as S
from vitalframe.operators import stats as T
from vitalframe.plans.catalog import register
from vitalframe.plans.roles import table
from vitalframe.session import cut_lineage

SHARES = {"train": 0.7, "validation": 0.15, "test": 0.15}

register("hash_split", lambda s, d: S.hash_split(table(s, d, "orders"), "o_custkey", SHARES), """
WITH p AS (SELECT DISTINCT o_custkey FROM orders), u AS (SELECT o_custkey, (row_number() OVER (ORDER BY md5(o_custkey || '|42'), o_custkey) - 0.5::DOUBLE) / count(*) OVER () AS u FROM p)
SELECT o_custkey, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'validation' ELSE 'test' END AS part FROM u""")
register("stratified_split", lambda s, d: S.stratified_split(table(s, d, "orders"), "o_custkey", "o_totalprice", SHARES, 200000.0, 300000.0), """
WITH p AS (SELECT o_custkey, CASE WHEN median(o_totalprice) < 200000 THEN 'low' WHEN median(o_totalprice) <= 300000 THEN 'normal' ELSE 'high' END AS class FROM orders GROUP BY 1),
u AS (SELECT *, (row_number() OVER (PARTITION BY class ORDER BY md5(o_custkey || '|42'), o_custkey) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY class) AS u FROM p)
SELECT o_custkey, class, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'validation' ELSE 'test' END AS part FROM u""")
register("loso_dummy", lambda s, d: M.leave_one_out_mean(table(s, d, "orders"), "o_custkey", "o_totalprice").withColumn("predicted", F.round("predicted", 3)), """
WITH o AS (SELECT o_custkey, sum(o_totalprice) AS s, count(*) AS n FROM orders GROUP BY 1) SELECT o_custkey, round((sum(s) OVER () - s) / (sum(n) OVER () - n), 3) AS predicted FROM o""")


def _whole(s, d):
    """All orders with the means of their lines as features."""
    li = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.avg("l_quantity").alias("f1"), F.avg("l_discount").alias("f2"), F.sum("l_extendedprice").alias("f3"))
    return table(s, d, "orders").join(li, "o_orderkey").select("o_custkey", "o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("glc"), "f1", "f2", "f3")


register("group_kfold", lambda s, d: S.group_folds(table(s, d, "orders"), "o_custkey", 5), """
WITH RECURSIVE g AS (SELECT o_custkey, n, row_number() OVER (ORDER BY n DESC, o_custkey) AS r FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)),
w AS (SELECT 0::BIGINT AS r, [0, 0, 0, 0, 0]::BIGINT[] AS load, NULL::BIGINT AS o_custkey, 0::INT AS fold UNION ALL
  SELECT g.r, [load[i] + CASE WHEN i = list_position(load, list_min(load)) THEN g.n ELSE 0 END for i in [1, 2, 3, 4, 5]]::BIGINT[], g.o_custkey, (list_position(load, list_min(load)) - 1)::INT FROM w JOIN g ON g.r = w.r + 1)
SELECT o_custkey, fold FROM w WHERE r > 0""")


def _nested(s, d, folds, models, fold_rows):
    """Orders are read often to deal participants to folds, so their lines are added up once."""
    rows = cut_lineage(_whole(s, d))
    return M.nested_cv(rows, S.group_folds(rows, "o_custkey", folds), "o_custkey", "glc", ["f1", "f2", "f3"], models, fold_rows=fold_rows)


register("nested_cv", lambda s, d: _nested(s, d, 5, ["dummy", "lasso", "knn", "gpr"], None))
register("nested_cv_summary", lambda s, d: M.summary(_nested(s, d, 3, list(MODEL_SETS["low_overfit"]), M.FOLD_ROWS)))

register("fold_metrics", lambda s, d: table(s, d, "lineitem").groupBy("l_returnflag", (F.col("l_orderkey") % 5).alias("fold")).agg(F.sqrt(F.avg(F.pow(F.col("l_extendedprice") - F.col("l_quantity") * 1500, F.lit(2.0)))).alias("rmse"))
         .groupBy("l_returnflag").agg(F.round(F.avg("rmse"), 4).alias("rmse_mean"), F.round(F.stddev_pop("rmse"), 4).alias("rmse_std")), """
WITH f AS (SELECT l_returnflag, l_orderkey % 5 AS fold, sqrt(avg((l_extendedprice - l_quantity * 1500) ** 2)) AS rmse FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, round(avg(rmse), 4) AS rmse_mean, round(stddev_pop(rmse), 4) AS rmse_std FROM f GROUP BY 1""")
register("loso_summary", lambda s, d: table(s, d, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.avg(F.abs(F.col("l_extendedprice") - F.col("l_quantity") * 1500)).alias("mae"))
         .groupBy("l_returnflag").agg(F.count_distinct("l_suppkey").alias("n"), F.round(F.avg("mae"), 4).alias("mae_mean"), F.round(F.stddev_samp("mae"), 4).alias("mae_std")).orderBy("mae_mean"), """
WITH f AS (SELECT l_returnflag, l_suppkey, avg(abs(l_extendedprice - l_quantity * 1500)) AS mae FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, count(DISTINCT l_suppkey) AS n, round(avg(mae), 4) AS mae_mean, round(stddev_samp(mae), 4) AS mae_std FROM f GROUP BY 1""")
register("knn_regress", lambda s, d: N.nearest_neighbours(table(s, d, "embeddings"), table(s, d, "embeddings"), "vec_id", "embedding", "label", 5).withColumn("predicted", F.round("predicted", 6)), """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings), p AS (SELECT a.vec_id, b.vec_id AS o, b.label, round(sqrt(greatest(list_dot_product(a.e, a.e) - 2 * list_dot_product(a.e, b.e) + list_dot_product(b.e, b.e), 0)), 6) AS g FROM e a JOIN e b ON a.vec_id <> b.vec_id)
SELECT vec_id, round(avg(label), 6) AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY g, o) AS r FROM p) WHERE r <= 5 GROUP BY 1""")


def _parts(s, d):
    rows = _whole(s, d)
    return rows.where("o_custkey % 4 <> 0"), rows.where("o_custkey % 4 = 0")


register("refit_and_test", lambda s, d: M.evaluated(*_parts(s, d), "o_custkey", "glc", ["f1", "f2", "f3"], ["dummy", "ridge", "elasticnet", "huber", "quantile", "ransac", "ard"], model_set="complex"))
register("modality_ablation", lambda s, d: M.ablation(*_parts(s, d), "o_custkey", "glc", {"ppg": ["f1"], "ecg": ["f2"], "bio": ["f3"]}, ["ridge"], "stable"))
register("neighbour_information", lambda s, d: T.neighbour_relevance(_whole(s, d), "glc", ["f1", "f2", "f3"]))
register("principal_components", lambda s, d: T.principal_components(_whole(s, d), "o_orderkey", ["f1", "f2", "f3"]).select("o_orderkey", F.round(F.abs("pc1"), 6).alias("pc1"), F.round(F.abs("pc2"), 6).alias("pc2")))

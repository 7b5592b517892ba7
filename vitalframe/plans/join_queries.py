"""Queries over joins, set operations and reshapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalframe.operators import joins as J
from vitalframe.plans.catalog import register
from vitalframe.plans.roles import SAMPLES_SQL, samples, table

register("left_join_metadata", lambda s, d: J.with_metadata(
    table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_extendedprice"),
    table(s, d, "orders"), "o_orderkey", ["o_custkey", "o_orderstatus"]).fillna({"o_custkey": -1}), """
SELECT l_orderkey AS o_orderkey, l_linenumber, l_partkey, l_extendedprice, coalesce(o_custkey, -1) AS o_custkey, o_orderstatus
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey""")

register("unmatched_files", lambda s, d: J.unmatched(table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey"), table(s, d, "customer").where("c_acctbal > 0"), "c_custkey"), """
SELECT o_custkey AS c_custkey, o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_acctbal > 0 AND c_custkey = o_custkey)""")


def _fusion(s, d):
    li = table(s, d, "lineitem")
    ppg = li.where("l_returnflag = 'A'").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("o"), F.col("l_quantity").alias("f"), F.col("l_discount").alias("quality_indicator"))
    ecg = li.where("l_returnflag = 'N'").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("o"), F.col("l_extendedprice").alias("f"), F.col("l_tax").alias("quality_indicator"))
    fused = J.fused_quality(J.fuse({"ppg": ppg, "ecg": ecg}, ["l_orderkey"], "o"))
    return fused.select("l_orderkey", "repetition", "ppg_f", "ecg_f", F.round("quality_indicator", 6).alias("quality_indicator"))


register("cyclic_fusion", _fusion, """
WITH a AS (SELECT l_orderkey, l_quantity AS f, l_discount AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem WHERE l_returnflag = 'A'),
b AS (SELECT l_orderkey, l_extendedprice AS f, l_tax AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem WHERE l_returnflag = 'N'),
k AS (SELECT l_orderkey, an, bn, unnest(range(greatest(an, bn))) AS r FROM (SELECT l_orderkey, max(n) AS an FROM a GROUP BY 1) JOIN (SELECT l_orderkey, max(n) AS bn FROM b GROUP BY 1) USING (l_orderkey))
SELECT k.l_orderkey, k.r AS repetition, a.f AS ppg_f, b.f AS ecg_f, round((a.q + b.q) / 2, 6) AS quality_indicator
FROM k JOIN a ON a.l_orderkey = k.l_orderkey AND a.i = k.r % an JOIN b ON b.l_orderkey = k.l_orderkey AND b.i = k.r % bn""")


def _train(s, d):
    return table(s, d, "customer").where("c_mktsegment IN ('BUILDING', 'MACHINERY')").select(F.col("c_custkey").alias("o_custkey"))


register("semi_split_train", lambda s, d: table(s, d, "orders").join(_train(s, d), "o_custkey", "left_semi").select("o_orderkey", "o_custkey"), """
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))""")
register("anti_split_test", lambda s, d: table(s, d, "orders").join(_train(s, d), "o_custkey", "left_anti").select("o_orderkey", "o_custkey"), """
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))""")


def _marks(s, d, what):
    return samples(s, d).where(F.col("modality") == what).select("file_id", "i")


register("asof_onsets", lambda s, d: J.last_before_first_after(_marks(s, d, "click"), _marks(s, d, "view"), "file_id", "i"), f"""
WITH {SAMPLES_SQL}, p AS (SELECT file_id, i FROM s WHERE modality = 'click'), o AS (SELECT file_id, i FROM s WHERE modality = 'view')
SELECT p.file_id, a.i AS onset, p.i AS peak, b.i AS next_onset FROM p ASOF JOIN o a ON a.file_id = p.file_id AND a.i < p.i ASOF JOIN o b ON b.file_id = p.file_id AND b.i > p.i""")
register("next_peak", lambda s, d: J.next_after(_marks(s, d, "click"), _marks(s, d, "error"), "file_id", "i").fillna({"next_at": -1}), f"""
WITH {SAMPLES_SQL}, o AS (SELECT file_id, i FROM s WHERE modality = 'error')
SELECT p.file_id, p.i, coalesce(b.i, -1) AS next_at FROM (SELECT * FROM s WHERE modality = 'click') p ASOF LEFT JOIN o b ON b.file_id = p.file_id AND b.i > p.i""")
register("ptt_pairs", lambda s, d: J.paired_by_position(_marks(s, d, "click"), _marks(s, d, "view"), "file_id", "i").groupBy("file_id").agg(
    F.round(F.avg(F.col("b") - F.col("a")), 6).alias("ptt_mean"), F.round(F.stddev_pop(F.col("b") - F.col("a")), 6).alias("ptt_std")), f"""
WITH {SAMPLES_SQL}, p AS (SELECT file_id, i, row_number() OVER (PARTITION BY file_id ORDER BY i) AS n FROM s WHERE modality = 'click'), o AS (SELECT file_id, i, row_number() OVER (PARTITION BY file_id ORDER BY i) AS n FROM s WHERE modality = 'view')
SELECT p.file_id, round(avg(o.i - p.i), 6) AS ptt_mean, round(stddev_pop(o.i - p.i), 6) AS ptt_std FROM p JOIN o ON p.file_id = o.file_id AND p.n = o.n GROUP BY 1""")

register("peaks_in_windows", lambda s, d: _marks(s, d, "click").groupBy("file_id", F.floor(F.col("i") / 10).alias("w")).agg(F.count(F.lit(1)).alias("n_peaks")), f"""
WITH {SAMPLES_SQL} SELECT file_id, i // 10 AS w, count(*) AS n_peaks FROM s WHERE modality = 'click' GROUP BY 1, 2""")


def _difference(s, d):
    a = table(s, d, "part").select("p_partkey", "p_retailprice", F.col("p_size").cast("double").alias("p_size"))
    b = a.select("p_partkey", F.when(F.col("p_partkey") % 11 == 0, F.col("p_retailprice") + 1).otherwise(F.col("p_retailprice")).alias("p_retailprice"), F.when(F.col("p_partkey") % 13 != 0, F.col("p_size")).alias("p_size"))
    return J.table_difference(a, b, "p_partkey", ["p_retailprice", "p_size"]).withColumns({c: F.round(c, 6) for c in ("max_difference", "mean_difference")})


register("table_difference", _difference, """
WITH x AS (SELECT p_partkey, p_retailprice AS a, CASE WHEN p_partkey % 11 = 0 THEN p_retailprice + 1 ELSE p_retailprice END AS b, p_size::DOUBLE AS c, CASE WHEN p_partkey % 13 <> 0 THEN p_size::DOUBLE END AS e FROM part)
SELECT 'p_retailprice' AS "column", count(*) AS n, count(*) FILTER (NOT coalesce(abs(a - b) <= 1e-8 + 1e-5 * abs(b), false)) AS n_different, round(max(abs(a - b)), 6) AS max_difference, round(avg(abs(a - b)), 6) AS mean_difference FROM x
UNION ALL SELECT 'p_size', count(*), count(*) FILTER (NOT coalesce(abs(c - e) <= 1e-8 + 1e-5 * abs(e), false)), round(max(abs(c - e)), 6), round(avg(abs(c - e)), 6) FROM x""")


def _repeat(s, d):
    o = table(s, d, "orders")
    return J.repeated_to(o.where("o_orderstatus = 'F'").select("o_custkey", "o_orderkey", "o_totalprice"), o.where("o_orderstatus = 'O'").select("o_custkey", F.col("o_orderkey").alias("target")), "o_custkey", "o_orderkey", "target", "o_totalprice").select("o_custkey", "target", "o_totalprice")


register("repeat_first_session", _repeat, """
WITH a AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WHERE o_orderstatus = 'F'),
b AS (SELECT o_custkey, o_orderkey AS target, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS t FROM orders WHERE o_orderstatus = 'O')
SELECT b.o_custkey, target, o_totalprice FROM b JOIN a ON a.o_custkey = b.o_custkey AND a.i = b.t % a.n""")


def _merge(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.lower("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    v = table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lower("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return J.merged_and_numbered([("a", c), ("b", v)], ["id", "name", "nation"], "id", (F.col("dataset") == "b") & (F.col("id") == 7))


register("merge_renumber", _merge, """
WITH u AS (SELECT c_custkey AS id, lower(c_name) AS name, c_nationkey AS nation, 'a' AS dataset FROM customer UNION ALL SELECT s_suppkey, lower(s_name), s_nationkey, 'b' FROM supplier),
n AS (SELECT *, row_number() OVER (ORDER BY dataset, id) AS number FROM u)
SELECT *, 'file_id' || number AS file_id FROM n WHERE NOT (dataset = 'b' AND id = 7)""")

register("missing_ids", lambda s, d: J.missing_numbers(table(s, d, "orders").where("o_orderpriority = '2-HIGH' AND o_orderstatus = 'F'"), "o_custkey", 1), """
WITH o AS (SELECT o_custkey FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderstatus = 'F')
SELECT m AS missing FROM (SELECT unnest(range(1, (SELECT max(o_custkey) + 1 FROM o))) AS m) WHERE m NOT IN (SELECT o_custkey FROM o)""")

register("group_key_union", lambda s, d: table(s, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(s, d, "supplier").select("s_nationkey")).distinct(), """
SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier""")
register("train_validation_union", lambda s, d: table(s, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey").unionByName(table(s, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey")), """
SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'""")
register("features_in_all", lambda s, d: table(s, d, "part").where("p_size < 10").select("p_name").intersect(table(s, d, "part").where("p_size > 40").select("p_name")), """
SELECT p_name FROM part WHERE p_size < 10 INTERSECT SELECT p_name FROM part WHERE p_size > 40""")
register("features_only_in_one", lambda s, d: table(s, d, "part").where("p_size < 45").select("p_brand", "p_type", "p_name").distinct().exceptAll(table(s, d, "part").where("p_size >= 45").select("p_brand", "p_type", "p_name").distinct()), """
SELECT p_brand, p_type, p_name FROM part WHERE p_size < 45 EXCEPT SELECT p_brand, p_type, p_name FROM part WHERE p_size >= 45""")
register("dedup_by_columns", lambda s, d: table(s, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey")), """
SELECT o_custkey, o_orderstatus, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1, 2""")
register("pivot_modalities", lambda s, d: table(s, d, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)).alias("n"), F.round(F.max("o_totalprice"), 2).alias("top")).fillna(0), """
SELECT o_custkey, """ + ", ".join(f"count(*) FILTER (o_orderstatus = '{x}') AS \"{x}_n\", coalesce(round(max(o_totalprice) FILTER (o_orderstatus = '{x}'), 2), 0) AS \"{x}_top\"" for x in "FOP") + " FROM orders GROUP BY 1")
register("unpivot_features", lambda s, d: table(s, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice").unpivot("p_partkey", ["p_size", "p_retailprice"], "feature", "value"), """
SELECT p_partkey, 'p_size' AS feature, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part""")

"""Queries over segments and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalframe.operators import segments as S
from vitalframe.plans.catalog import register
from vitalframe.plans.roles import FS, MODALITY_SAMPLES_SQL, SAMPLES_SQL, modality_samples, samples, table

RUNS_SQL = """
r AS (SELECT file_id, min(i) AS start_sample, count(*) AS duration, median(q) AS med, avg(q) AS mean
      FROM (SELECT *, i - row_number() OVER (PARTITION BY file_id ORDER BY i) AS g FROM s WHERE q >= {thr}) GROUP BY file_id, g)"""


def _runs(spark, d, threshold=0.5, seconds=0.0, use_median=True):
    return S.threshold_runs(samples(spark, d), threshold, FS, seconds, use_median)


def _rounded(df):
    return df.withColumn("quality_indicator", F.round("quality_indicator", 6))


register("segments_above_threshold", lambda s, d: _rounded(_runs(s, d, use_median=False)), f"""
WITH {SAMPLES_SQL}, {RUNS_SQL.format(thr=0.5)}
SELECT file_id, start_sample, duration, round(mean, 6) AS quality_indicator FROM r""")

register("segments_min_duration_median", lambda s, d: _rounded(_runs(s, d, seconds=3.0)), f"""
WITH {SAMPLES_SQL}, {RUNS_SQL.format(thr=0.5)}
SELECT file_id, start_sample, duration, round(med, 6) AS quality_indicator FROM r WHERE duration >= 3""")

register("whole_file_segments", lambda s, d: _rounded(S.whole_file_segment(samples(s, d))), f"""
WITH {SAMPLES_SQL} SELECT file_id, min(i) AS start_sample, count(*) AS duration, round(median(q), 6) AS quality_indicator FROM s GROUP BY 1""")

register("sliding_windows", lambda s, d: S.sliding_windows(_runs(s, d, 0.4), 5, 2).select("file_id", "start_sample", "duration"), f"""
WITH {SAMPLES_SQL}, {RUNS_SQL.format(thr=0.4)}
SELECT file_id, start_sample + 2 * w AS start_sample, 5::BIGINT AS duration
FROM (SELECT *, unnest(range(0, ((duration - 5) // 2 + 1)::BIGINT)) AS w FROM r WHERE duration >= 5)""")

register("window_quality_median", lambda s, d: _rounded(S.window_quality(S.sliding_windows(_runs(s, d, 0.4), 5, 2), samples(s, d))), f"""
WITH {SAMPLES_SQL}, {RUNS_SQL.format(thr=0.4)},
w AS (SELECT file_id, start_sample + 2 * w AS start_sample, 5::BIGINT AS duration
      FROM (SELECT *, unnest(range(0, ((duration - 5) // 2 + 1)::BIGINT)) AS w FROM r WHERE duration >= 5))
SELECT w.file_id, w.start_sample, w.duration, round(median(s.q), 6) AS quality_indicator
FROM w JOIN s ON s.file_id = w.file_id AND s.i >= w.start_sample AND s.i < w.start_sample + w.duration GROUP BY 1, 2, 3""")

register("best_segment_per_file", lambda s, d: _rounded(S.best_per(_runs(s, d, seconds=2.0), order=(F.col("duration").desc(), "start_sample"))), f"""
WITH {SAMPLES_SQL}, {RUNS_SQL.format(thr=0.5)}
SELECT file_id, start_sample, duration, round(med, 6) AS quality_indicator FROM r WHERE duration >= 2
QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY med DESC, duration DESC, start_sample) = 1""")

register("first_best_segment", lambda s, d: _rounded(S.best_per(_runs(s, d, seconds=2.0))), f"""
WITH {SAMPLES_SQL}, {RUNS_SQL.format(thr=0.5)}
SELECT file_id, start_sample, duration, round(med, 6) AS quality_indicator FROM r WHERE duration >= 2
QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY med DESC, start_sample) = 1""")

register("global_segment_numbers", lambda s, d: S.numbered(_runs(s, d, seconds=2.0)).select("file_id", "start_sample", "segment_id"), f"""
WITH {SAMPLES_SQL}, {RUNS_SQL.format(thr=0.5)}
SELECT file_id, start_sample, 'seg_id' || (row_number() OVER (ORDER BY file_id, start_sample) - 1) AS segment_id FROM r WHERE duration >= 2""")


def _best_per_modality(s, d):
    runs = S.threshold_runs(modality_samples(s, d), 0.5, FS, 2.0, keys=("file_id", "modality"))
    best = S.best_per(runs, ("file_id", "modality"))
    return _rounded(S.complete_groups(best, ("file_id",), ["click", "view", "error"]).where(F.col("modality").isin("click", "view", "error")))


register("best_segment_per_modality", _best_per_modality, f"""
WITH {MODALITY_SAMPLES_SQL},
r AS (SELECT file_id, modality, min(i) AS start_sample, count(*) AS duration, median(q) AS med
      FROM (SELECT *, i - row_number() OVER (PARTITION BY file_id, modality ORDER BY i) AS g FROM s WHERE q >= 0.5) GROUP BY file_id, modality, g HAVING count(*) >= 2),
b AS (SELECT * FROM r WHERE modality IN ('click', 'view', 'error')
      QUALIFY row_number() OVER (PARTITION BY file_id, modality ORDER BY med DESC, start_sample) = 1)
SELECT file_id, modality, start_sample, duration, round(med, 6) AS quality_indicator FROM b
WHERE file_id IN (SELECT file_id FROM b GROUP BY file_id HAVING count(*) = 3)""")

register("balanced_participants", lambda s, d: S.balanced(
    samples(s, d).select("file_id", "i", "q"), "file_id", "q", "i").select("file_id", "i"), f"""
WITH {SAMPLES_SQL}, n AS (SELECT min(c) AS least FROM (SELECT count(*) AS c FROM s GROUP BY file_id))
SELECT file_id, i FROM s, n QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY q DESC, i) <= max(least) OVER (PARTITION BY file_id)""")

MODALITIES = ["click", "view", "purchase"]


def _files(s, d):
    """Events as a session's files: a session is a user's day, every fifth file has no quality."""
    return table(s, d, "events").select("user_id", F.to_date("ts").alias("day"), "event_type", "event_id", "value", F.when(F.col("event_id") % 5 > 0, F.lit(50.0) / (F.lit(50.0) + F.col("value"))).alias("q"))


def _session_sql(best: bool) -> str:
    top = f"SELECT *, row_number() OVER (PARTITION BY user_id, day, event_type ORDER BY {'q IS NOT NULL DESC, coalesce(q, 0) DESC, CASE WHEN q IS NULL THEN -event_id ELSE event_id END' if best else 'event_id DESC'}) AS r FROM f"
    cols = ", ".join(f"(count(*) FILTER (event_type = '{m}') > 0)::INT AS has_{m}, max(event_id) FILTER (event_type = '{m}') AS {m}_event_id, max(value) FILTER (event_type = '{m}') AS {m}_value" for m in MODALITIES)
    return f"""
WITH f AS (SELECT user_id, ts::DATE AS day, event_type, event_id, value, CASE WHEN event_id % 5 > 0 THEN 50.0::DOUBLE / (50.0::DOUBLE + value) END AS q FROM events)
SELECT user_id, day, {cols} FROM ({top}) WHERE r = 1 GROUP BY 1, 2"""


register("session_best_files", lambda s, d: S.session_vectors(_files(s, d), ["user_id", "day"], "event_type", MODALITIES, ["event_id", "value"], "event_id", "q"), _session_sql(True))
register("session_last_files", lambda s, d: S.session_vectors(_files(s, d), ["user_id", "day"], "event_type", MODALITIES, ["event_id", "value"], "event_id"), _session_sql(False))

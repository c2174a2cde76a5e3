"""Registered queries over time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsgraph.operators import series as op
from newsgraph.plans import model
from newsgraph.registry import query

_NOW = "n AS (SELECT max(ingested) AS now FROM f)"
_WEEKLY = f"""{model.DATED}, {model.SUPPLIER_MENTIONS}, {_NOW},
w AS (SELECT entity_id AS entity, date_trunc('week', ingested)::DATE AS week, count(*) AS mentions, avg(importance) AS importance, count(DISTINCT kind) AS kinds
  FROM f JOIN m ON f.id = m.fact_id JOIN supplier ON s_suppkey = entity_id, n WHERE ingested >= now - INTERVAL 180 DAY GROUP BY 1, 2 HAVING count(*) >= 2)"""
_EPOCH = "(week - DATE '1970-01-01')::DOUBLE"
_CORR = lambda x, y: f"CASE WHEN stddev_pop({x}) * stddev_pop({y}) > 0 THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END"


def _inputs(spark, sf_dir):
    return model.mentions(spark, sf_dir, "l_suppkey"), model.supplier_entities(spark, sf_dir), model.dated_facts(spark, sf_dir)


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(f"WITH {_WEEKLY} SELECT entity, week, mentions, round(importance, 6) AS importance, kinds FROM w")
def weekly_series(spark, sf_dir):
    return _rounded(op.weekly(*_inputs(spark, sf_dir)), "importance")


_PATTERNS = f"""p AS (SELECT entity, count(*) AS weeks, sum(mentions)::BIGINT AS total, avg(mentions) AS mean, stddev_samp(mentions) AS deviation, max(mentions) AS peak, min(mentions) AS trough,
  {_CORR(_EPOCH, 'mentions')} AS trend, CASE WHEN avg(mentions) > 0 THEN stddev_samp(mentions) / avg(mentions) ELSE 0 END AS variation,
  CASE WHEN avg(mentions) >= 10 THEN 'muy_activa' WHEN avg(mentions) >= 5 THEN 'activa' WHEN avg(mentions) >= 2 THEN 'moderada' ELSE 'baja' END AS level FROM w GROUP BY 1)"""


@query(f"WITH {_WEEKLY}, {_PATTERNS} SELECT entity, weeks, total, round(mean, 6) AS mean, round(deviation, 6) AS deviation, peak, trough, round(trend, 5) AS trend, round(variation, 6) AS variation, level FROM p")
def entity_patterns(spark, sf_dir):
    return _rounded(_rounded(op.patterns(op.weekly(*_inputs(spark, sf_dir))), "mean", "deviation", "variation"), "trend", digits=5)


_PAIRS = f"""c AS (SELECT x.entity AS a, y.entity AS b, count(*) AS weeks, avg(x.mentions) AS mean_a, avg(y.mentions) AS mean_b,
  CASE WHEN stddev_samp(x.mentions) > 0 AND stddev_samp(y.mentions) > 0 THEN round(covar_pop(x.mentions, y.mentions) / (stddev_samp(x.mentions) * stddev_samp(y.mentions)), 9) ELSE 0 END AS coefficient,
  {_CORR(_EPOCH.replace("week", "x.week"), 'x.mentions')} AS trend_a, {_CORR(_EPOCH.replace("week", "x.week"), 'y.mentions')} AS trend_b,
  min(x.week) AS first_week, max(x.week) AS last_week FROM w x JOIN w y ON x.week = y.week AND x.entity < y.entity GROUP BY 1, 2 HAVING count(*) >= 4),
k AS (SELECT *, abs(coefficient) AS size FROM c WHERE abs(coefficient) >= 0.2),
q AS (SELECT *, CASE WHEN size >= 0.8 THEN 'muy_fuerte' WHEN size >= 0.6 THEN 'fuerte' WHEN size >= 0.4 THEN 'moderada' WHEN size >= 0.2 THEN 'debil' ELSE 'muy_debil' END AS strength,
  CASE WHEN coefficient > 0 THEN 'positiva' WHEN coefficient < 0 THEN 'negativa' ELSE 'neutral' END AS sign,
  CASE WHEN trend_a > 0.3 AND trend_b > 0.3 THEN 'ambas_crecientes' WHEN trend_a < -0.3 AND trend_b < -0.3 THEN 'ambas_decrecientes'
    WHEN trend_a > 0.3 AND trend_b < -0.3 THEN 'opuestas_a_crece' WHEN trend_a < -0.3 AND trend_b > 0.3 THEN 'opuestas_b_crece' ELSE 'tendencias_mixtas' END AS trend FROM k)"""


@query(f"""WITH {_WEEKLY}, {_PATTERNS}, {_PAIRS}
SELECT q.a, q.b, q.weeks, round(coefficient, 5) AS coefficient, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, first_week, last_week, strength, sign, q.trend,
  pa.level AS level_a, pb.level AS level_b, round(pa.variation, 6) AS variation_a, round(pb.variation, 6) AS variation_b,
  CASE WHEN strength IN ('muy_fuerte', 'fuerte') AND q.weeks >= 8 AND pa.level IN ('muy_activa', 'activa') AND pb.level IN ('muy_activa', 'activa') THEN 'alta_relevancia'
    WHEN strength IN ('fuerte', 'moderada') AND q.weeks >= 6 THEN 'relevancia_media' ELSE 'relevancia_baja' END AS relevance
FROM q LEFT JOIN p pa ON pa.entity = q.a LEFT JOIN p pb ON pb.entity = q.b""")
def temporal_correlation(spark, sf_dir):
    df = op.enriched_correlations(op.weekly(*_inputs(spark, sf_dir))).drop("trend_a", "trend_b")
    return _rounded(_rounded(df, "mean_a", "mean_b", "variation_a", "variation_b"), "coefficient", digits=5)


_DAILY = """d AS (SELECT ingested::DATE AS day, count(*) AS facts, avg(importance) AS importance, count(DISTINCT kind) AS kinds, count(*) FILTER (importance >= 8) AS important
  FROM f, n WHERE ingested >= now - INTERVAL 90 DAY GROUP BY 1),
z AS (SELECT *, avg(facts) OVER w7 AS mean_7,
  CASE WHEN stddev_samp(facts) OVER w7 > 0 THEN (facts - avg(facts) OVER w7) / stddev_samp(facts) OVER w7 ELSE 0 END AS z_volume,
  CASE WHEN stddev_samp(importance) OVER w7 > 0 THEN (importance - avg(importance) OVER w7) / stddev_samp(importance) OVER w7 ELSE 0 END AS z_importance
  FROM d WINDOW w7 AS (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))"""


@query(f"""WITH {model.DATED}, {_NOW}, {_DAILY}
SELECT day, facts, round(importance, 6) AS importance, kinds, important, round(mean_7, 6) AS mean_7, round(z_volume, 4) AS z_volume, round(z_importance, 4) AS z_importance FROM z""")
def daily_zscore(spark, sf_dir):
    df = op.rolling(op.daily(model.dated_facts(spark, sf_dir)))
    return _rounded(_rounded(df, "importance", "mean_7"), "z_volume", "z_importance", digits=4)


_SPIKES = """g AS (SELECT kind, date_trunc('week', ingested)::DATE AS week, count(*) AS facts FROM f, n WHERE ingested >= now - INTERVAL 90 DAY GROUP BY 1, 2),
l AS (SELECT *, lag(facts) OVER (PARTITION BY kind ORDER BY week) AS before FROM g), r AS (SELECT *, facts::DOUBLE / before AS ratio FROM l),
h AS (SELECT *, CASE WHEN ratio IS NULL THEN NULL WHEN ratio >= 3.0 THEN 'spike_extremo' WHEN ratio >= 2.0 THEN 'spike_alto' WHEN ratio >= 1.5 THEN 'crecimiento_notable'
  WHEN ratio <= 0.3 THEN 'caida_extrema' WHEN ratio <= 0.5 THEN 'caida_alta' WHEN ratio <= 0.7 THEN 'decrecimiento_notable' ELSE 'normal' END AS pattern FROM r)"""


@query(f"WITH {model.DATED}, {_NOW}, {_SPIKES} SELECT kind, week, facts, before, round(ratio, 6) AS ratio, pattern FROM h")
def type_spikes(spark, sf_dir):
    return _rounded(op.kind_growth(model.dated_facts(spark, sf_dir)), "ratio")


_CHANGES = """x AS (SELECT entity_id AS entity, count(*) AS all_, count(*) FILTER (ingested >= now - INTERVAL 28 DAY) AS recent, avg(importance) FILTER (ingested >= now - INTERVAL 28 DAY) AS importance
  FROM f JOIN m ON f.id = m.fact_id, n WHERE ingested >= now - INTERVAL 84 DAY GROUP BY 1 HAVING count(*) >= 3),
y AS (SELECT entity, s_name AS name, recent, all_ - recent AS before, importance, CASE WHEN all_ > recent THEN recent::DOUBLE / (all_ - recent) WHEN recent > 0 THEN 10.0 ELSE 0.0 END AS ratio
  FROM x JOIN supplier ON s_suppkey = entity),
v AS (SELECT *, CASE WHEN before > 0 THEN least(100.0, abs(ratio - 1) * 50 + abs(coalesce(importance, 5.0) - 5) * 10) WHEN recent >= 5 THEN 75.0 WHEN recent >= 3 THEN 50.0 ELSE 25.0 END AS score FROM y)"""


@query(f"WITH {model.DATED}, {model.SUPPLIER_MENTIONS}, {_NOW}, {_CHANGES} SELECT entity, name, recent, before, round(importance, 6) AS importance, round(ratio, 6) AS ratio, round(score, 6) AS score FROM v")
def entity_anomaly(spark, sf_dir):
    return _rounded(op.entity_changes(*_inputs(spark, sf_dir)), "importance", "ratio", "score")


@query(f"""WITH {model.DATED}, {model.SUPPLIER_MENTIONS}, {_NOW}, {_DAILY}, {_SPIKES}, {_CHANGES},
b AS (SELECT day, greatest(abs(z_volume), abs(z_importance)) AS z FROM z)
SELECT 'anomalia_temporal' AS feed, NULL::BIGINT AS entity, NULL AS kind, day AS found_on, round_even(z * 25, 0)::INTEGER AS score,
  CASE WHEN z >= 3 THEN 'muy_alta' WHEN z >= 2.5 THEN 'alta' WHEN z >= 2 THEN 'media' ELSE 'baja' END AS confidence, round(z, 4) AS measure FROM b WHERE z >= 1.5
UNION ALL SELECT 'anomalia_entidad', entity, NULL, now::DATE, round(round(score, 6)::DECIMAL(20, 6), 0)::INTEGER,
  CASE WHEN score >= 80 THEN 'muy_alta' WHEN score >= 60 THEN 'alta' WHEN score >= 40 THEN 'media' ELSE 'baja' END, round(ratio, 4) FROM v, n WHERE score >= 30
UNION ALL SELECT 'patron_emergente', NULL, kind, week, CASE WHEN pattern IN ('spike_extremo', 'caida_extrema') THEN 90 WHEN pattern IN ('spike_alto', 'caida_alta') THEN 70 ELSE 50 END,
  CASE WHEN pattern IN ('spike_extremo', 'caida_extrema') THEN 'muy_alta' WHEN pattern IN ('spike_alto', 'caida_alta') THEN 'alta' ELSE 'media' END, round(ratio, 4) FROM h WHERE pattern <> 'normal'""")
def anomaly_feed(spark, sf_dir):
    return _rounded(op.anomaly_feed(*_inputs(spark, sf_dir)), "measure", digits=4)

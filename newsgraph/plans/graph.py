"""Registered queries over the entity graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsgraph.operators import graph as op
from newsgraph.plans import model
from newsgraph.registry import query

_EDGES = f"""{model.DATED}, {model.PART_MENTIONS},
e AS (SELECT x.entity_id AS a, y.entity_id AS b, count(*) AS meetings, avg(importance) AS importance, max(ingested) AS latest
  FROM m x JOIN m y ON x.fact_id = y.fact_id AND x.entity_id < y.entity_id JOIN f ON f.id = x.fact_id GROUP BY 1, 2 HAVING count(*) >= 2),
t AS (SELECT a AS entity, b AS partner, meetings, latest FROM e UNION ALL SELECT b, a, meetings, latest FROM e)"""


def _parts(spark, sf_dir):
    return op.parts(model.table(spark, sf_dir, "lineitem"))  # whose rows its footers tell


def _edges(spark, sf_dir):
    return op.edges(model.mentions(spark, sf_dir), model.dated_facts(spark, sf_dir), n=_parts(spark, sf_dir))


@query(f"WITH {_EDGES} SELECT a, b, meetings, round(importance, 6) AS importance, latest::DATE AS latest FROM e")
def cooccurrence_edges(spark, sf_dir):
    return _edges(spark, sf_dir).withColumn("importance", F.round("importance", 6)).withColumn("latest", F.to_date("latest"))


_CENTRALITY = """g AS (SELECT entity, count(*) AS degree, count(*) FILTER (meetings >= 5) AS strong_degree, sum(meetings)::BIGINT AS weight, avg(meetings) AS strength FROM t GROUP BY 1),
c AS (SELECT p_partkey AS id, p_name AS name, p_type AS kind, 1 + p_size % 10 AS relevance, coalesce(degree, 0) AS degree, coalesce(strong_degree, 0) AS strong_degree,
  coalesce(weight, 0) AS weight, coalesce(strength, 0.0) AS strength FROM part LEFT JOIN g ON p_partkey = entity),
s AS (SELECT *, round(least(100, greatest(0, degree * 10 + strong_degree * 20 + strength * 5 + relevance * 3))::DECIMAL(20, 6), 0)::INTEGER AS score FROM c)"""


@query(f"""WITH {_EDGES}, {_CENTRALITY}
SELECT id, name, kind, relevance, degree, strong_degree, weight, round(strength, 6) AS strength, score,
  CASE WHEN score >= 80 THEN 'muy_central' WHEN score >= 60 THEN 'central' WHEN score >= 40 THEN 'moderada' WHEN score >= 20 THEN 'periferica' ELSE 'aislada' END AS class
FROM s WHERE degree > 0 OR relevance >= 7""")
def entity_centrality(spark, sf_dir):
    return op.centrality(_edges(spark, sf_dir), model.part_entities(spark, sf_dir)).withColumn("strength", F.round("strength", 6))


@query(f"""WITH {_EDGES}
SELECT * FROM (SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY meetings DESC, partner)::INTEGER AS rank, partner, meetings, latest::DATE AS latest FROM t) WHERE rank <= 5""")
def top_partners(spark, sf_dir):
    return op.top_partners(_edges(spark, sf_dir), n=_parts(spark, sf_dir)).withColumn("latest", F.to_date("latest"))


@query(f"""WITH {_EDGES},
r AS (SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY meetings DESC, partner) AS rank, partner, meetings FROM t)
SELECT entity, string_agg(p_name || ':' || meetings, '|' ORDER BY rank) AS partners FROM r JOIN part ON partner = p_partkey WHERE rank <= 5 GROUP BY entity""")
def partner_lists(spark, sf_dir):
    lists = op.partner_lists(_edges(spark, sf_dir), model.part_entities(spark, sf_dir), n=_parts(spark, sf_dir))
    text = F.transform("partners", lambda p: F.concat_ws(":", p["name"], p["meetings"].cast("string")))
    return lists.select("entity", F.array_join(text, "|").alias("partners"))

"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed per cell (source, language, topic) where they are read; raking then works
on the cells alone: in turn each cell's probability is scaled by wanted over expected tokens
of its source, its language and its topic, and held at 1, since nothing is sampled twice.
A document is sampled if a number that its id gives lies below its cell's probability.
Everything is DataFrame functions: no Python runs on the executors. A hot source is one row
a task after the first sum.

Targets: the share of each value of a marginal, by default its own share of the tokens to
the power `temper` (1: as it is; 0: all alike). `budget` is the part of all tokens to keep
at most. Targets hold: a value that has too few tokens for its share of the budget can't be
sampled twice, so the budget is lowered. Its bound is the least of each value's tokens over
its share; raking is done for `steps` budgets up to that at once (a row per cell and step),
and the largest counts whose marginals are all met within `tolerance` (or, if none is, the
one that misses them least). `marginals` gives the residual of every value.

Defined results: a null source, language or topic is a value of its own; null and empty
texts have no tokens and take their cell's probability; words of texts of any length are
counted whole; a null id is drawn as the text 'null'; rows of one id are drawn alike; values
without a target have weight 0, and shares are those among values that have tokens; an empty
table gives an empty table. Other columns are kept (sample) or not looked at (weigh).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BUDGET, TEMPER, ROUNDS = 0.7, 0.5, 8
#: Budgets that are tried, and how far from its share a value's expected tokens may be.
STEPS, TOLERANCE = 16, 0.01
MARGINALS = ("source", "lang", "topic")


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def draw_of(doc_id: Column) -> Column:
    """A number in [0, 1) that depends on the id alone."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)


def rake(cells: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, temper: float = TEMPER, rounds: int = ROUNDS, steps: int = STEPS, tolerance: float = TOLERANCE, marginals=MARGINALS) -> DataFrame:
    """cells (marginals.., n_tokens) to themselves with probability and the budget that is met. targets: marginal to (value, share)."""
    now = cells.crossJoin(F.broadcast(cells.agg(F.sum("n_tokens").alias("_all"))))  # one row
    bound = F.lit(float(budget))
    for m in marginals:
        own = cells.groupBy(m).agg(F.sum("n_tokens").cast("double").alias("_n"))
        if targets and m in targets:
            given = targets[m].groupBy(F.col("value").alias("_value")).agg(F.sum("share").cast("double").alias("_w"))
            own = own.join(given, F.col(m).eqNullSafe(F.col("_value")), "left").withColumn("_w", F.when(F.col("_n") > 0, F.coalesce("_w", F.lit(0.0))).otherwise(F.lit(0.0))).drop("_value")
        else:
            own = own.withColumn("_w", F.when(F.col("_n") > 0, F.pow("_n", F.lit(float(temper)))).otherwise(F.lit(0.0)))
        own = own.crossJoin(F.broadcast(own.agg(F.sum("_w").alias("_whole"))))  # one row
        own = own.select(F.col(m).alias("_value"), F.coalesce(F.try_divide("_w", "_whole"), F.lit(0.0)).alias(f"_want_{m}"), F.col("_n").alias(f"_n_{m}"))
        now = now.join(own, F.col(m).eqNullSafe(F.col("_value"))).drop("_value")
        bound = F.least(bound, F.when(F.col(f"_want_{m}") > 0, F.try_divide(f"_n_{m}", F.col(f"_want_{m}") * F.col("_all"))))  # nulls are passed over
    now = common.settle(now.withColumn("_bound", bound))
    least = now.agg(F.min("_bound").alias("_least"))
    now = now.crossJoin(F.broadcast(least)).withColumn("_step", F.explode(F.sequence(F.lit(1), F.lit(steps))))  # one row, and steps
    now = now.withColumn("budget", F.col("_least") * F.col("_step") / F.lit(float(steps))).withColumn("probability", F.col("budget"))
    expected = lambda m: F.sum(F.col("n_tokens") * F.col("probability")).over(Window.partitionBy("_step", m))
    for _ in range(rounds):
        for m in marginals:
            factor = F.col(f"_want_{m}") * F.col("_all") * F.col("budget") / expected(m)
            now = now.withColumn("probability", F.when(expected(m) > 0, F.least(F.lit(1.0), F.col("probability") * factor)).otherwise(F.col("probability")))
        now = common.settle(now)
    missed = [F.coalesce(F.abs(F.try_divide(expected(m), F.col(f"_want_{m}") * F.col("_all") * F.col("budget")) - 1), F.lit(0.0)) for m in marginals]
    now = common.settle(now.withColumn("_missed", F.greatest(F.lit(0.0), *missed)))
    met = F.max("_missed") <= tolerance
    steps_met = now.groupBy("_step").agg(met.alias("_met"), F.max("_missed").alias("_missed")).select(F.struct("_met", F.when(F.col("_met"), F.col("_step")).alias("s"), (-F.col("_missed")).alias("m"), F.col("_step").alias("_best")).alias("o"))
    best = steps_met.agg(F.max("o").alias("o")).select(F.col("o._best").alias("_best"))
    return now.join(F.broadcast(best), F.col("_step") == F.col("_best")).select(*marginals, "n_tokens", "probability", "budget")  # one row


def marginals_of(raked: DataFrame, targets: dict[str, DataFrame] | None = None, temper: float = TEMPER, marginals=MARGINALS) -> DataFrame:
    """For each value of each marginal of raked cells: marginal, value, wanted and expected share of the sample, residual (their relative difference)."""
    out = []
    for m in marginals:
        own = raked.groupBy(F.col(m).cast("string").alias("value")).agg(F.sum("n_tokens").cast("double").alias("n"), F.sum(F.col("n_tokens") * F.col("probability")).alias("e"))
        weight = F.when(F.col("n") > 0, F.pow("n", F.lit(float(temper)))).otherwise(F.lit(0.0))
        if targets and m in targets:
            given = targets[m].groupBy(F.col("value").cast("string").alias("_value")).agg(F.sum("share").cast("double").alias("_w"))
            own = own.join(given, F.col("value").eqNullSafe(F.col("_value")), "left")
            weight = F.when(F.col("n") > 0, F.coalesce("_w", F.lit(0.0))).otherwise(F.lit(0.0))
        own = own.withColumn("w", weight)
        sums = own.agg(F.sum("w").alias("sw"), F.sum("e").alias("se"))
        share = own.crossJoin(F.broadcast(sums)).select(F.lit(m).alias("marginal"), "value", F.try_divide("w", "sw").alias("wanted"), F.try_divide("e", "se").alias("expected"))  # one row
        out.append(share.withColumn("residual", F.try_divide("expected", "wanted") - 1))
    return reduce(DataFrame.unionByName, out)


def weigh(docs: DataFrame, topics: DataFrame | None = None, targets=None, budget: float = BUDGET, temper: float = TEMPER, rounds: int = ROUNDS, steps: int = STEPS, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """For each row: doc_id, source, lang, topic, n_tokens, probability, budget, draw, sampled. topics: (doc_id, topic), ids once each."""
    picked = common.take(docs, doc_id=id_col, text=text_col, source=source_col, lang=lang_col)
    rows = picked.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", tokens_of(F.col("text")).alias("n_tokens"))
    if topics is None:
        rows = rows.withColumn("topic", F.lit(None).cast("string"))
    else:
        own = topics.select(F.col("doc_id").alias("_id"), F.col("topic").cast("string").alias("topic"))
        rows = rows.join(own, F.col("doc_id") == F.col("_id"), "left").drop("_id")
    rows = common.settle(rows)
    cells = rake(rows.groupBy(*MARGINALS).agg(F.sum("n_tokens").alias("n_tokens")), targets, budget, temper, rounds, steps, tolerance)
    by = cells.select(*[F.col(m).alias(f"_{m}") for m in MARGINALS], "probability", "budget")
    found = rows.join(by, [F.col(m).eqNullSafe(F.col(f"_{m}")) for m in MARGINALS]).drop(*[f"_{m}" for m in MARGINALS])
    return found.withColumn("draw", draw_of(F.col("doc_id"))).withColumn("sampled", F.col("draw") < F.col("probability"))


def sample(docs: DataFrame, topics: DataFrame | None = None, targets=None, budget: float = BUDGET, temper: float = TEMPER, rounds: int = ROUNDS, steps: int = STEPS, tolerance: float = TOLERANCE, id_col: str = "doc_id", **columns: str) -> DataFrame:
    """The sampled rows with all their columns. Their ids are broadcast if they are counted to be few, so that texts stay where they are read; else they are joined by a shuffle."""
    chosen = weigh(docs, topics, targets, budget, temper, rounds, steps, tolerance, id_col, **columns).where("sampled").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_chosen")).distinct()
    flat = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    key = F.coalesce(F.col(f"_c{docs.columns.index(id_col)}").cast("long").cast("string"), F.lit("null"))
    return flat.join(common.short(common.settle(chosen)), key == F.col("_chosen"), "left_semi").toDF(*docs.columns)


def embedding_topics(embeddings: DataFrame) -> DataFrame:
    """The label of the vector that has a document's id, as its topic (the least of several)."""
    own = common.take(embeddings, doc_id="vec_id", topic="label")
    return own.where("doc_id is not null").groupBy("doc_id").agg(F.min("topic").cast("string").alias("topic"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighed = weigh(common.table(spark, sf_dir, "documents"), embedding_topics(common.table(spark, sf_dir, "embeddings")))
    return weighed.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 6).alias("probability"), F.round("budget", 6).alias("budget"), "sampled")


def _oracle() -> str:
    rounds, last = [], "t0"
    for r in range(ROUNDS):
        for m in MARGINALS:
            name = f"s{r}_{m}"
            expected = f"sum(n_tokens * p) OVER (PARTITION BY step, {m})"
            rounds.append(f"{name} AS MATERIALIZED (SELECT * EXCLUDE (p), CASE WHEN {expected} > 0 THEN least(1.0::DOUBLE, p * (w_{m} * total * budget / {expected})) ELSE p END AS p FROM {last})")
            last = name
    wants = ", ".join(f"sum(n_tokens) OVER (PARTITION BY {m}) AS n_{m}" for m in MARGINALS)
    shares = ", ".join(f"CASE WHEN n_{m} > 0 THEN pow(n_{m}, {TEMPER}) / (SELECT sum(pow(n, {TEMPER})) FROM (SELECT sum(n_tokens)::DOUBLE AS n FROM c GROUP BY {m}) WHERE n > 0) ELSE 0 END AS w_{m}" for m in MARGINALS)
    bounds = ", ".join(f"CASE WHEN w_{m} > 0 THEN n_{m} / (w_{m} * total) END" for m in MARGINALS)
    missed = ", ".join(f"coalesce(abs(sum(n_tokens * p) OVER (PARTITION BY step, {m}) / nullif(w_{m} * total * budget, 0) - 1), 0)" for m in MARGINALS)
    return rf"""
WITH e AS (SELECT vec_id, min(label)::VARCHAR AS topic FROM embeddings GROUP BY vec_id),
d AS (SELECT doc_id, source, lang, topic, len(regexp_extract_all(coalesce(text, ''), '{common.WORD}'))::BIGINT AS n_tokens FROM documents LEFT JOIN e ON vec_id = doc_id),
c AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS n_tokens FROM d GROUP BY ALL),
t AS (SELECT *, {wants}, sum(n_tokens) OVER () AS total FROM c),
u AS MATERIALIZED (SELECT *, {shares} FROM t),
b AS (SELECT least({BUDGET}::DOUBLE, min(least({bounds}))) AS bound FROM u),
t0 AS MATERIALIZED (SELECT u.*, step, bound * step / {STEPS}::DOUBLE AS budget, bound * step / {STEPS}::DOUBLE AS p FROM u, b, range(1, {STEPS + 1}) r(step)),
{", ".join(rounds)},
m AS (SELECT step, greatest(0.0, {missed}) AS missed FROM {last}),
g AS (SELECT step FROM (SELECT step, max(missed) AS missed FROM m GROUP BY step) ORDER BY missed <= {TOLERANCE} DESC, CASE WHEN missed <= {TOLERANCE} THEN step END DESC, missed, step DESC LIMIT 1)
SELECT d.doc_id, d.source, d.lang, d.topic, d.n_tokens, round(p, 6) AS probability, round(budget, 6) AS budget,
  ('0x' || substr(md5(d.doc_id::VARCHAR), 1, 12))::BIGINT / {float(1 << 48)} < p AS sampled
FROM d JOIN {last} s ON d.source IS NOT DISTINCT FROM s.source AND d.lang IS NOT DISTINCT FROM s.lang AND d.topic IS NOT DISTINCT FROM s.topic
WHERE s.step = (SELECT step FROM g)
"""


ORACLE_SQL = _oracle()

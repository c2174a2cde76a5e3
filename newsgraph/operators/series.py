"""Time series of entities and facts: activity, correlation, anomalies, spikes and their feed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsgraph.plans.model import as_of
from newsgraph.session import settle


def _since(df: DataFrame, column: str, days: int) -> DataFrame:
    """Rows of the last `days` days before the table's latest moment; keeps the column now."""
    return df.crossJoin(as_of(df, column)).where(F.col(column) >= F.col("now") - F.expr(f"INTERVAL {days} DAYS"))


def weekly(mentions: DataFrame, entities: DataFrame, facts: DataFrame, days: int = 180, least: int = 2) -> DataFrame:
    """(entity, week, mentions, importance, kinds): weeks in which an unmerged entity has at least `least` mentions."""
    known = entities.where("merged_into IS NULL").select(F.col("id").alias("entity_id"))
    rows = _since(facts, "ingested", days).join(mentions, F.col("id") == F.col("fact_id")).join(known, "entity_id", "left_semi")
    grouped = rows.groupBy(F.col("entity_id").alias("entity"), F.to_date(F.date_trunc("week", "ingested")).alias("week"))
    return grouped.agg(F.count("*").alias("mentions"), F.avg("importance").alias("importance"), F.countDistinct("kind").alias("kinds")).where(F.col("mentions") >= least)


def guarded_corr(x: Column, y: Column) -> Column:
    """Pearson correlation; null where one side doesn't vary."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > 0, F.try_divide(F.covar_pop(x, y), spread))


def level(mean: Column) -> Column:
    return F.when(mean >= 10, "muy_activa").when(mean >= 5, "activa").when(mean >= 2, "moderada").otherwise("baja")


def _day(week: Column) -> Column:
    return F.unix_date(week).cast("double")


def patterns(series: DataFrame) -> DataFrame:
    """(entity, weeks, total, mean, deviation, peak, trough, variation, trend, level)."""
    m = F.col("mentions").cast("double")
    grouped = series.groupBy("entity").agg(
        F.count("*").alias("weeks"), F.sum("mentions").alias("total"), F.avg(m).alias("mean"), F.stddev_samp(m).alias("deviation"), F.max("mentions").alias("peak"), F.min("mentions").alias("trough"),
        guarded_corr(_day(F.col("week")), m).alias("trend"),
    )
    variation = F.when(F.col("mean") > 0, F.try_divide("deviation", "mean")).otherwise(0.0)
    return grouped.withColumn("variation", variation).withColumn("level", level(F.col("mean")))


#: Entities of a block whose pairs are judged together.
ROWS = 1024


def _matrix(side, days: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, and per entity and day whether and how often it was mentioned, of packed rows (entity, points)."""
    points = side["points"].combine_chunks()
    flat, sizes = points.flatten(), points.value_lengths().to_numpy()
    row, column = np.repeat(np.arange(len(sizes)), sizes), np.searchsorted(days, flat.field("day").to_numpy())
    mask, x = np.zeros((len(sizes), len(days))), np.zeros((len(sizes), len(days)))
    mask[row, column], x[row, column] = 1, flat.field("mentions").to_numpy()
    return side["entity"].to_numpy(), mask, x


def pair_figures(ma, xa, mb, xb, days: np.ndarray) -> dict[str, np.ndarray]:
    """For all pairs of two blocks, over the days that both have: weeks, covariance, spreads and trends, from sums of whole numbers, which are exact."""
    n = ma @ mb.T
    sa, sb, saa, sbb, sab = xa @ mb.T, ma @ xb.T, xa**2 @ mb.T, ma @ (xb**2).T, xa @ xb.T
    sd, sdd, sda, sdb = (ma * days) @ mb.T, (ma * days**2) @ mb.T, (xa * days) @ mb.T, (ma * days) @ xb.T
    va, vb, vd = n * saa - sa**2, n * sbb - sb**2, n * sdd - sd**2  # n squared times a population variance
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.where((va > 0) & (vb > 0), (n * sab - sa * sb) / n**2 / np.sqrt(va / n / (n - 1) * vb / n / (n - 1)), 0.0)
        trend = lambda v, c, s: np.where((vd > 0) & (v > 0), (n * c - sd * s) / np.sqrt(np.maximum(vd, 1e-300) * np.maximum(v, 1e-300)), np.nan)
        return {"weeks": n, "r": r, "mean_a": sa / n, "mean_b": sb / n, "trend_a": trend(va, sda, sa), "trend_b": trend(vb, sdb, sb)}


def correlations(series: DataFrame, least_weeks: int = 4, least: float = 0.2, rows: int = ROWS) -> DataFrame:
    """Pairs a < b that share at least `least_weeks` weeks and correlate by at least `least` either way.

    The coefficient divides a population covariance by sample deviations, as the model defines it. An entity is one row with
    its weeks; blocks of about `rows` entities meet as matrices, so no week gathers its pairs, and only pairs that count leave a task.
    """
    packed = series.groupBy("entity").agg(F.collect_list(F.struct(F.unix_date("week").alias("day"), F.col("mentions").cast("double").alias("mentions"))).alias("points"))  # an entity's weeks
    packed = settle(packed.where(F.size("points") >= least_weeks))
    blocks = max(1, -(-packed.count() // rows))
    dealt = packed.withColumn("block", F.pmod(F.xxhash64("entity"), F.lit(blocks)).cast("int"))
    left = dealt.select(F.col("block").alias("i"), F.explode(F.sequence("block", F.lit(blocks - 1))).alias("j"), F.col("entity").alias("entity"), F.col("points").alias("points"))
    right = dealt.select(F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i"), F.col("block").alias("j"), F.col("entity").alias("entity"), F.col("points").alias("points"))
    names = ("a", "b", "weeks", "coefficient", "mean_a", "mean_b", "trend_a", "trend_b", "first_day", "last_day")

    def judge(key, a, b):
        import pyarrow as pa

        kinds = (pa.int64(), pa.int64(), pa.int64(), *[pa.float64()] * 5, pa.int32(), pa.int32())
        if not a.num_rows or not b.num_rows:
            return pa.table({n: pa.array([], k) for n, k in zip(names, kinds, strict=True)})
        days = np.unique(np.concatenate([x["points"].combine_chunks().flatten().field("day").to_numpy() for x in (a, b)]))
        (ia, ma, xa), (ib, mb, xb) = _matrix(a, days), _matrix(b, days)
        f = pair_figures(ma, xa, mb, xb, days.astype(float))
        kept = (f["weeks"] >= least_weeks) & (np.abs(f["r"]) >= least - 1e-6) & ((ia[:, None] < ib[None, :]) if key[0].as_py() == key[1].as_py() else True)
        i, j = np.nonzero(kept)
        both = (ma[i] > 0) & (mb[j] > 0)
        first, last = days[both.argmax(axis=1)], days[both.shape[1] - 1 - both[:, ::-1].argmax(axis=1)]
        turned = ia[i] > ib[j]
        pick = lambda x, y: np.where(turned, f[y][i, j], f[x][i, j])
        values = (np.minimum(ia[i], ib[j]), np.maximum(ia[i], ib[j]), f["weeks"][i, j].astype(np.int64), f["r"][i, j], pick("mean_a", "mean_b"), pick("mean_b", "mean_a"), pick("trend_a", "trend_b"), pick("trend_b", "trend_a"), first, last)
        return pa.table({n: pa.array(v, k, from_pandas=True) for n, v, k in zip(names, values, kinds, strict=True)})

    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(judge, "a long, b long, weeks long, coefficient double, mean_a double, mean_b double, trend_a double, trend_b double, first_day int, last_day int")
    kept = found.withColumn("coefficient", F.round("coefficient", 9)).where(F.abs("coefficient") >= least)  # rounded: classes don't hang on a last bit
    kept = kept.select("a", "b", "weeks", "mean_a", "mean_b", "trend_a", "trend_b", F.date_from_unix_date("first_day").alias("first_week"), F.date_from_unix_date("last_day").alias("last_week"), "coefficient")
    size = F.abs("coefficient")
    strength = F.when(size >= 0.8, "muy_fuerte").when(size >= 0.6, "fuerte").when(size >= 0.4, "moderada").when(size >= 0.2, "debil").otherwise("muy_debil")
    sign = F.when(F.col("coefficient") > 0, "positiva").when(F.col("coefficient") < 0, "negativa").otherwise("neutral")
    up_a, down_a, up_b, down_b = F.col("trend_a") > 0.3, F.col("trend_a") < -0.3, F.col("trend_b") > 0.3, F.col("trend_b") < -0.3
    trend = F.when(up_a & up_b, "ambas_crecientes").when(down_a & down_b, "ambas_decrecientes").when(up_a & down_b, "opuestas_a_crece").when(down_a & up_b, "opuestas_b_crece").otherwise("tendencias_mixtas")
    return kept.withColumn("strength", strength).withColumn("sign", sign).withColumn("trend", trend)


def enriched_correlations(series: DataFrame) -> DataFrame:
    """Correlations with both entities' activity level and variation, and how much the pair matters."""
    own = patterns(series)
    side = lambda s: own.select(F.col("entity").alias(s), F.col("level").alias(f"level_{s}"), F.col("variation").alias(f"variation_{s}"))
    both = correlations(series).join(side("a"), "a", "left").join(side("b"), "b", "left")
    busy = F.col("level_a").isin("muy_activa", "activa") & F.col("level_b").isin("muy_activa", "activa")
    matters = F.when(F.col("strength").isin("muy_fuerte", "fuerte") & (F.col("weeks") >= 8) & busy, "alta_relevancia")
    matters = matters.when(F.col("strength").isin("fuerte", "moderada") & (F.col("weeks") >= 6), "relevancia_media").otherwise("relevancia_baja")
    return both.withColumn("relevance", matters)


def daily(facts: DataFrame, days: int = 90) -> DataFrame:
    """(day, facts, importance, kinds, important) of the last days."""
    grouped = _since(facts, "ingested", days).groupBy(F.to_date("ingested").alias("day"))
    return grouped.agg(F.count("*").alias("facts"), F.avg("importance").alias("importance"), F.countDistinct("kind").alias("kinds"), F.count_if(F.col("importance") >= 8).alias("important"))


def _z(x: Column, window) -> Column:
    deviation = F.stddev_samp(x).over(window)
    return F.when(deviation > 0, F.try_divide(x - F.avg(x).over(window), deviation)).otherwise(0.0)


def rolling(days: DataFrame, rows: int = 7) -> DataFrame:
    """days with mean_7, z_volume and z_importance over the last rows, the current one included. A row a day: small."""
    last = Window.orderBy("day").rowsBetween(1 - rows, 0)
    volume = F.col("facts").cast("double")
    return days.withColumns({"mean_7": F.avg(volume).over(last), "z_volume": _z(volume, last), "z_importance": _z(F.col("importance"), last)})


def spike_class(ratio: Column) -> Column:
    rising = F.when(ratio >= 3.0, "spike_extremo").when(ratio >= 2.0, "spike_alto").when(ratio >= 1.5, "crecimiento_notable")
    return rising.when(ratio <= 0.3, "caida_extrema").when(ratio <= 0.5, "caida_alta").when(ratio <= 0.7, "decrecimiento_notable").otherwise("normal")


def kind_growth(facts: DataFrame, days: int = 90) -> DataFrame:
    """(kind, week, facts, before, ratio, pattern): change from a kind's last week with facts; null before the first."""
    weeks = _since(facts, "ingested", days).groupBy("kind", F.to_date(F.date_trunc("week", "ingested")).alias("week")).agg(F.count("*").alias("facts"))
    before = F.lag("facts").over(Window.partitionBy("kind").orderBy("week"))
    grown = weeks.withColumn("before", before).withColumn("ratio", F.try_divide(F.col("facts").cast("double"), F.col("before")))
    return grown.withColumn("pattern", F.when(F.col("ratio").isNotNull(), spike_class(F.col("ratio"))))


def entity_changes(mentions: DataFrame, entities: DataFrame, facts: DataFrame, recent: int = 28, span: int = 84, least: int = 3) -> DataFrame:
    """(entity, name, recent, before, importance, ratio, score): mentions of the last days against those before."""
    rows = _since(facts, "ingested", span).join(mentions, F.col("id") == F.col("fact_id"))
    late = F.col("ingested") >= F.col("now") - F.expr(f"INTERVAL {recent} DAYS")
    grouped = rows.groupBy(F.col("entity_id").alias("entity")).agg(F.count("*").alias("_all"), F.count_if(late).alias("recent"), F.avg(F.when(late, F.col("importance"))).alias("importance"))
    counted = grouped.where(F.col("_all") >= least).withColumn("before", F.col("_all") - F.col("recent")).drop("_all")
    known = entities.where("merged_into IS NULL").select(F.col("id").alias("entity"), "name")
    some = F.col("before") > 0
    ratio = F.when(some, F.try_divide(F.col("recent").cast("double"), F.col("before"))).when(F.col("recent") > 0, 10.0).otherwise(0.0)
    score = F.when(some, F.least(F.lit(100.0), F.abs(F.col("ratio") - 1) * 50 + F.abs(F.coalesce("importance", F.lit(5.0)) - 5) * 10))
    score = score.when(F.col("recent") >= 5, 75.0).when(F.col("recent") >= 3, 50.0).otherwise(25.0)
    return counted.join(known, "entity").withColumn("ratio", ratio).withColumn("score", score)


def anomaly_feed(mentions: DataFrame, entities: DataFrame, facts: DataFrame) -> DataFrame:
    """Days, entities and kinds that stand out, in one schema: feed, entity, kind, found_on, score, confidence, measure."""
    z = F.greatest(F.abs("z_volume"), F.abs("z_importance"))
    days = rolling(daily(facts)).where(z >= 1.5).select(
        F.lit("anomalia_temporal").alias("feed"), F.lit(None).cast("long").alias("entity"), F.lit(None).cast("string").alias("kind"), F.col("day").alias("found_on"),
        F.bround(z * 25).cast("int").alias("score"), F.when(z >= 3, "muy_alta").when(z >= 2.5, "alta").when(z >= 2, "media").otherwise("baja").alias("confidence"), z.alias("measure"),
    )
    now = as_of(facts, "ingested").select(F.to_date("now").alias("found_on"))
    s = F.col("score")
    changed = entity_changes(mentions, entities, facts).where(s >= 30).crossJoin(now).select(
        F.lit("anomalia_entidad").alias("feed"), "entity", F.lit(None).cast("string").alias("kind"), "found_on",
        F.round(F.round(s, 6).cast("decimal(20,6)"), 0).cast("int").alias("score"), F.when(s >= 80, "muy_alta").when(s >= 60, "alta").when(s >= 40, "media").otherwise("baja").alias("confidence"), F.col("ratio").alias("measure"),
    )
    p = F.col("pattern")
    extreme, high, notable = p.isin("spike_extremo", "caida_extrema"), p.isin("spike_alto", "caida_alta"), p.isin("crecimiento_notable", "decrecimiento_notable")
    kinds = kind_growth(facts).where(p.isNotNull() & (p != "normal")).select(
        F.lit("patron_emergente").alias("feed"), F.lit(None).cast("long").alias("entity"), "kind", F.col("week").alias("found_on"),
        F.when(extreme, 90).when(high, 70).when(notable, 50).otherwise(30).alias("score"), F.when(extreme, "muy_alta").when(high, "alta").otherwise("media").alias("confidence"), F.col("ratio").alias("measure"),
    )
    return days.unionByName(changed).unionByName(kinds)

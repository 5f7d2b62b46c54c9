"""Choosing diverse samples and judging how much of a source they cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pick_diverse(reserve: DataFrame, shape: str, order: str, size: int, seen: DataFrame | None = None, from_tail: bool = False) -> DataFrame:
    """``size`` rows, each time of the shape represented least (picked or in ``seen``: shape, count), then by ``order``.

    The n-th row of a shape is picked when its shape stands at prior count + n - 1, so the greedy order is one sort.
    A shape can't give more than ``size`` rows.
    """
    by = F.desc(order) if from_tail else F.asc(order)
    nth = reserve.withColumn("__nth", F.row_number().over(Window.partitionBy(shape).orderBy(by))).where(F.col("__nth") <= size)
    if seen is not None:
        nth = nth.join(seen.select(F.col(shape), F.col("count").alias("__prior")), shape, "left")
    else:
        nth = nth.withColumn("__prior", F.lit(0))
    level = F.coalesce("__prior", F.lit(0)) + F.col("__nth") - 1
    return nth.withColumn("__level", level).orderBy("__level", by).limit(size).drop("__nth", "__prior", "__level")


def coverage(counts: DataFrame, min_examples: int, count: str = "count") -> Column:
    """Aggregate over type counts: 1 - share of examples of rare types; 0 without examples."""
    rare = F.sum(F.when(F.col(count) < min_examples, F.col(count)).otherwise(0))
    return F.when(F.coalesce(F.sum(count), F.lit(0)) == 0, F.lit(0.0)).otherwise(1.0 - rare / F.sum(count))


def unseen_risk(classified: Column, fetched: Column, min_confidence: Column) -> Column:
    """Share that may be of unseen types: finite share or the miss rate of draws, whichever is less."""
    draws = 1.0 - F.pow(1.0 - min_confidence, 1.0 / classified)
    return F.when((classified == 0) | (fetched == 0), 1.0).when(classified >= fetched, 0.0).otherwise(F.least((fetched - classified) / fetched, draws))


def confidence(samples: DataFrame, by: list[str], min_examples: int, unclassified: Column, min_confidence: float, min_types: int, unsampled: Column | None = None) -> DataFrame:
    """Per group (columns material_type, confidence): how sure the sample makes one of the source's types."""
    types = samples.groupBy(*by, "material_type").agg(F.count(F.lit(1)).alias("count"), F.sum("confidence").alias("total"))
    stats = types.groupBy(*by).agg(coverage(types, min_examples).alias("coverage"), F.sum("count").alias("n"), F.count(F.lit(1)).alias("types"), (F.sum("total") / F.sum("count")).alias("mean"))
    level = 1.0 - (1.0 - min_confidence) / F.greatest(F.lit(1), min_types - F.col("types") + 1)
    risk = unseen_risk(F.col("n"), F.col("n") + unclassified, level)
    never = (unsampled if unsampled is not None else F.lit(0)) / (F.col("n") + unclassified)
    return stats.withColumn("confidence", (1.0 - F.greatest(1.0 - F.col("coverage"), risk, never)) * F.col("mean"))

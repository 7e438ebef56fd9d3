"""Mapper evaluation: expected against predicted labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def label_metrics(cases: DataFrame) -> DataFrame:
    """Per label TP, FP, FN, TN, precision, recall, F1 and support of ``cases`` (expected, predicted: arrays)."""
    n = cases.agg(F.count("*").alias("n"))
    sides = F.explode(F.array_union("expected", "predicted"))
    one = cases.select("expected", "predicted", sides.alias("label"))
    hit, want = F.array_contains("predicted", F.col("label")), F.array_contains("expected", F.col("label"))
    by = one.groupBy("label").agg(F.count_if(hit & want).alias("tp"), F.count_if(hit & ~want).alias("fp"), F.count_if(~hit & want).alias("fn"))
    by = by.join(F.broadcast(n)).withColumn("tn", F.col("n") - F.col("tp") - F.col("fp") - F.col("fn"))
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    by = by.withColumn("precision", p).withColumn("recall", r)
    return by.select("label", "tp", "fp", "fn", "tn", "precision", "recall", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), (F.col("tp") + F.col("fn")).alias("support"))


def summary(cases: DataFrame) -> DataFrame:
    """One row: cases, exact matches, micro and macro averages."""
    by = label_metrics(cases)
    m = by.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"))
    m = m.withColumn("micro_precision", _ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("micro_recall", _ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    m = m.withColumn("micro_f1", _ratio(2 * F.col("micro_precision") * F.col("micro_recall"), F.col("micro_precision") + F.col("micro_recall")))
    exact = cases.agg(F.count("*").alias("cases"), F.count_if(F.array_sort("expected") == F.array_sort("predicted")).alias("exact"))
    return exact.join(m.select(*(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("micro_precision", "micro_recall", "micro_f1", "macro_precision", "macro_recall", "macro_f1"))))

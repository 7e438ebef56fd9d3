"""Sizes, arcs and viewpoints of a map, as columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The region arcs lead to.
HOME = (24.4, 54.4)
STEPS = 28


def marker_geometry(points: DataFrame) -> DataFrame:
    size = F.least(F.lit(28.0), 6 + 2.4 * F.sqrt(F.greatest("events", F.lit(1))))
    width = F.least(F.lit(4.5), 1.1 + 0.68 * F.log1p("events"))
    return points.select("source", "country", "protocol", F.round(size, 6).alias("marker_size"), F.round(width, 6).alias("line_width"))


def great_circles(points: DataFrame, home: tuple[float, float] = HOME) -> DataFrame:
    """28 steps from each point to home; a point at home has two: its own place and home."""
    a1, o1, a2, o2 = F.radians("latitude"), F.radians("longitude"), F.radians(F.lit(home[0])), F.radians(F.lit(home[1]))
    w = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(a1) * F.sin(a2) + F.cos(a1) * F.cos(a2) * F.cos(o1 - o2))))
    p = points.select("source", "country", "protocol", F.col("latitude").alias("own_lat"), F.col("longitude").alias("own_lon"), a1.alias("a1"), o1.alias("o1"), w.alias("w")).withColumn("far", F.col("w") > 1e-6)
    p = p.where("own_lat is not null and own_lon is not null").withColumn("step", F.explode(F.sequence(F.lit(0), F.when(F.col("far"), STEPS - 1).otherwise(1))))
    share = F.col("step") / F.lit(STEPS - 1.0)
    fa, fb = F.try_divide(F.sin((1 - share) * F.col("w")), F.sin("w")), F.try_divide(F.sin(share * F.col("w")), F.sin("w"))
    x = fa * F.cos("a1") * F.cos("o1") + fb * F.cos(a2) * F.cos(o2)
    y = fa * F.cos("a1") * F.sin("o1") + fb * F.cos(a2) * F.sin(o2)
    z = fa * F.sin("a1") + fb * F.sin(a2)
    near = lambda own, there: F.when(F.col("step") == 0, F.col(own)).otherwise(F.lit(there))
    p = p.select("source", "country", "protocol", "step", "far", near("own_lat", home[0]).alias("near_lat"), near("own_lon", home[1]).alias("near_lon"), F.when(F.col("far"), x).alias("x"), F.when(F.col("far"), y).alias("y"), F.when(F.col("far"), z).alias("z"))
    latitude, longitude = F.degrees(F.atan2("z", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")))), F.degrees(F.atan2("y", "x"))
    return p.select("source", "country", "protocol", "step", F.round(F.when(F.col("far"), latitude).otherwise(F.col("near_lat")), 5).alias("latitude"), F.round(F.when(F.col("far"), longitude).otherwise(F.col("near_lon")), 5).alias("longitude"))


def viewpoint(points: DataFrame, home: tuple[float, float] = HOME) -> DataFrame:
    """Centre and zoom over all points; home at zoom 3.25 without points."""
    span = F.greatest(F.max("latitude") - F.min("latitude"), F.max("longitude") - F.min("longitude"), F.lit(20.0))
    one = points.agg(F.median("latitude").alias("lat"), F.median("longitude").alias("lon"), span.alias("span"), F.count("*").alias("n"))
    zoom = F.least(F.lit(2.8), F.greatest(F.lit(0.75), 2.8 - F.log2(F.col("span") / 20)))
    some = F.col("n") > 0
    return one.select(*(F.round(F.when(some, v).otherwise(d), 6).alias(n) for n, v, d in (("latitude", F.col("lat"), home[0]), ("longitude", F.col("lon"), home[1]), ("zoom", zoom, 3.25))))

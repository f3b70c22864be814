"""Ranking and choosing the views of a group: group_id, view_id, ts, x, y, sharpness, confidence, area."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def view_stats(views: DataFrame, group: str) -> DataFrame:
    """Greatest and median positive area, greatest sharpness, first and last time of each group."""
    return views.groupBy(group).agg(
        F.max(F.when(F.col("area") > 0, F.col("area"))).alias("max_area"),
        F.median(F.when(F.col("area") > 0, F.col("area"))).alias("median_area"),
        F.max("sharpness").alias("max_sharpness"),
        F.min("ts").alias("min_ts"),
        F.max("ts").alias("max_ts"),
    )


def view_score(confidence: Column, sharpness: Column, area: Column, at_edge: Column, timed: Column) -> Column:
    """Fixed weights: 2 x confidence, 1.5 x sharpness share, 1.2 x area share, 0.2 for a box or time, and penalties for
    small boxes (0.8 under a quarter of the greatest, else 0.4 under half the median) and for the edge (0.25).

    Shares are of the group's columns max_sharpness, max_area and median_area."""
    share = lambda v, top: F.coalesce(F.when(top > 0, v / top), F.lit(0.0))
    small = F.when(area < 0.25 * F.col("max_area"), 0.8).when(area < 0.5 * F.col("median_area"), 0.4).otherwise(0.0)
    trust = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(confidence, F.lit(0.5))))
    score = 2.0 * trust + 1.5 * share(sharpness, F.col("max_sharpness")) + 1.2 * share(area, F.col("max_area"))
    return F.round(score + F.when(timed, 0.2).otherwise(0.0) - small - F.when(at_edge, 0.25).otherwise(0.0), 4)


def rounds(ranked: DataFrame, group: str, first: int = 7, more: int = 5, order: list | None = None) -> DataFrame:
    """Round 1 for the first views by rank, then `more` views in each next round."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*(order or [F.desc("score"), F.asc("view_id")])))
    return ranked.withColumn("place", place).withColumn(
        "round", F.when(place <= first, 1).otherwise(1 + F.ceil((place - first) / more)).cast("int")
    )


def initial_views(views: DataFrame, group: str, limit: int = 7) -> DataFrame:
    """group, view_id, pos (from 0), chosen (from 1, in which turn): the three best by score, the two largest of all if they
    aren't among these, then the farthest from all chosen until the limit; ordered by score.

    Distance of two views: their share of the group's time span (0 where a time is unknown) and their distance in pixels
    over 1000 (0 where a place is); the greatest least distance wins, then the better score, then the first by ord. Rows
    with the same view_id are one view, the best by score. Each turn is a window over the group, sorted once: a view
    keeps one distance, so a group of any size spills and is never held in an array.

    views: group, view_id, ord, score, area, t (0 to 1), x, y; unknown areas count as 0."""
    own, c = Window.partitionBy(group), F.col
    first = Window.partitionBy(group, "view_id").orderBy(F.desc("score"), "ord")
    rows = views.select(group, "view_id", "ord", "score", F.coalesce("area", F.lit(0)).alias("area"), "t", "x", "y")
    rows = rows.repartition(group).withColumn("_copy", F.row_number().over(first)).where("_copy = 1").drop("_copy")
    by_score = F.row_number().over(own.orderBy(F.desc("score"), "ord"))
    by_area = F.row_number().over(own.orderBy(F.desc("area"), "ord"))
    rows = rows.withColumns({"_score": by_score, "_area": by_area})
    large = (c("_area") <= 2) & (c("_score") > 3)
    # the largest views follow the three best, which are fewer in small groups
    before = F.least(F.lit(3), F.count(F.lit(1)).over(own)) + F.sum(large.cast("int")).over(own.orderBy("_area"))
    rows = rows.withColumn("chosen", F.when(c("_score") <= 3, c("_score")).when(large, before)).drop("_score", "_area")
    rows = rows.withColumns({"chosen": F.when(c("chosen") <= limit, c("chosen")).cast("int"), "_d": F.lit(float("inf"))})
    for turn in range(1, limit + 1):
        if turn > 3:
            best = F.max(F.when(c("chosen").isNull(), F.struct("_d", "score", -c("ord")))).over(own)
            taken = F.max((c("chosen") == turn).cast("int")).over(own)
            rows = rows.withColumns({"_best": best, "_taken": F.coalesce(taken, F.lit(0))})
            mine = c("chosen").isNull() & (c("_taken") == 0) & (F.struct("_d", "score", -c("ord")) == c("_best"))
            rows = rows.withColumn("chosen", F.when(mine, turn).otherwise(c("chosen"))).drop("_best", "_taken")
        if turn < limit:
            rows = rows.withColumn("_new", F.max(F.when(c("chosen") == turn, F.struct("t", "x", "y"))).over(own))
            apart = F.coalesce(F.abs(c("t") - c("_new.t")), F.lit(0.0))
            apart = apart + F.coalesce(F.sqrt(F.pow(c("x") - c("_new.x"), 2) + F.pow(c("y") - c("_new.y"), 2)) / 1000, F.lit(0.0))
            rows = rows.withColumn("_d", F.when(c("_new").isNotNull(), F.least("_d", apart)).otherwise(c("_d"))).drop("_new")
    order = own.orderBy(F.desc("score"), "chosen")
    return rows.where("chosen IS NOT NULL").select(group, "view_id", (F.row_number().over(order) - 1).alias("pos"), "chosen")

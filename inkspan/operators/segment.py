"""Thresholds from histograms of values by page; kernels over whole pictures are in ``raster``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TILE, SHARE = 64, 0.95


def otsu(pixels: DataFrame, page: list[str], *, value: str = "gray") -> DataFrame:
    """page, threshold: the first value of the largest variance between the two sides; 0 where one side is always empty."""
    hist = pixels.groupBy(*page, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*page)
    upto = w.orderBy("v")
    run = hist.select(
        *page, "v", F.sum("n").over(upto).alias("wb"), F.sum(F.col("n") * F.col("v")).over(upto).alias("sb"), F.sum("n").over(w).alias("all"), F.sum(F.col("n") * F.col("v")).over(w).alias("total")
    ).withColumn("wf", F.col("all") - F.col("wb"))
    d = F.col("sb") / F.col("wb") - (F.col("total") - F.col("sb")) / F.col("wf")
    var = F.when(F.col("wf") > 0, F.col("wb").cast("double") * F.col("wf") * d * d).otherwise(0.0)
    first = run.withColumn("var", var).withColumn("r", F.row_number().over(w.orderBy(F.desc("var"), "v"))).where("r = 1")
    return first.select(*page, F.when(F.col("var") > 0, F.col("v")).otherwise(0).cast("int").alias("threshold"))

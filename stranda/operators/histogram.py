"""Weighted histograms as tables (bin, count). Statistics come out as one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def running() -> Window:
    """Over bins in order, in one task: a histogram has one row for each bin, so it is small."""
    return Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)


def build(df: DataFrame, value: Column, weight: Column | None = None) -> DataFrame:
    return df.groupBy(value.cast("double").alias("bin")).agg(F.sum(F.lit(1.0) if weight is None else weight.cast("double")).alias("count"))


def prefill(hist: DataFrame, bins: DataFrame) -> DataFrame:
    """With the bins of another table, at 0 where they are missing."""
    return add(hist, bins.select(F.col("bin").cast("double"), F.lit(0.0).alias("count")))


def add(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("bin").agg(F.sum("count").alias("count"))


def divide(a: DataFrame, b: DataFrame) -> DataFrame:
    """Bin by bin; fails unless both have the same bins."""
    both = a.withColumnRenamed("count", "x").join(b.withColumnRenamed("count", "y"), "bin", "full")
    bad = F.col("x").isNull() | F.col("y").isNull()
    return both.select("bin", F.when(bad, F.raise_error(F.lit("the bins differ")).cast("double")).otherwise(F.col("x") / F.col("y")).alias("count"))


def moments(hist: DataFrame) -> DataFrame:
    """total, sum, mean, sd (over total - 1), geometric mean, smallest and largest bin, mean count of a bin."""
    n, x = F.col("count"), F.col("bin")
    one = hist.agg(F.sum(n).alias("total"), F.sum(x * n).alias("sum"), F.sum(x * x * n).alias("sq"), F.sum(n * F.ln(x)).alias("logs"), F.min(x).alias("min"), F.max(x).alias("max"), F.count("*").alias("bins"))
    mean = F.col("sum") / F.col("total")
    return one.select("total", "sum", mean.alias("mean"), F.sqrt((F.col("sq") - F.col("total") * mean * mean) / (F.col("total") - 1)).alias("sd"), F.exp(F.col("logs") / F.col("total")).alias("geometric_mean"), "min", "max", (F.col("total") / F.col("bins")).alias("mean_bin_size"))


def _cumulated(hist: DataFrame) -> DataFrame:
    total = F.sum("count").over(Window.partitionBy())
    return hist.withColumns({"__cum": F.sum("count").over(running()), "__total": total})


def median(hist: DataFrame) -> DataFrame:
    """Of weighted values: for an even total the mean of the two middle ones; 0 for none."""
    c = _cumulated(hist)
    low = F.when(F.col("__total") % 2 == 0, F.col("__total") / 2).otherwise(F.ceil(F.col("__total") / 2))
    high = F.when(F.col("__total") % 2 == 0, F.col("__total") / 2 + 1).otherwise(F.ceil(F.col("__total") / 2))
    out = c.agg(F.min(F.when(F.col("__cum") >= low, F.col("bin"))).alias("a"), F.min(F.when(F.col("__cum") >= high, F.col("bin"))).alias("b"))
    return out.select(F.coalesce((F.col("a") + F.col("b")) / 2, F.lit(0.0)).alias("median"))


def mad(hist: DataFrame) -> DataFrame:
    """Median absolute deviation, and the standard deviation estimated from it."""
    shifted = hist.crossJoin(F.broadcast(median(hist))).groupBy(F.abs(F.col("bin") - F.col("median")).alias("bin")).agg(F.sum("count").alias("count"))
    return median(shifted).select(F.col("median").alias("mad"), (F.col("median") * 1.4826).alias("sd_by_mad"))


def percentile(hist: DataFrame, p: float) -> DataFrame:
    """The smallest bin at which the cumulated share reaches p, 0 < p < 1."""
    if not 0 < p < 1:
        raise ValueError("a percentile lies between 0 and 1")
    return _cumulated(hist).filter(F.col("__cum") / F.col("__total") >= p).agg(F.min("bin").alias("percentile"))


def cdf(hist: DataFrame) -> DataFrame:
    return _cumulated(hist).select("bin", (F.col("__cum") / F.col("__total")).alias("cdf"))


def mode(hist: DataFrame) -> DataFrame:
    """The bin with the largest count, the smallest of several."""
    best = hist.agg(F.max(F.struct("count", (-F.col("bin")).alias("minus"))).alias("m"))
    return best.select((-F.col("m.minus")).alias("mode"), F.col("m.count").alias("mode_count"))


def bin_size_stats(hist: DataFrame) -> DataFrame:
    """Median and standard deviation (over bins - 1) of the counts."""
    return hist.agg(F.percentile("count", 0.5).alias("median_bin_size"), F.sqrt((F.sum(F.col("count") ** 2) - F.sum("count") ** 2 / F.count("*")) / F.greatest(F.lit(1), F.count("*") - 1)).alias("sd_bin_size"))


def trim_tail(hist: DataFrame, limit: float) -> DataFrame:
    """Bins up to the mode, and on from it until the first gap or the first count under mode's count / limit."""
    top = F.broadcast(mode(hist))
    marked = hist.crossJoin(top).withColumn("__prev", F.lag("bin").over(Window.orderBy("bin")))
    bad = (F.col("bin") > F.col("mode")) & ((F.col("bin") != F.col("__prev") + 1) | (F.col("count") < F.col("mode_count") / limit))
    return marked.withColumn("__bad", F.sum(bad.cast("int")).over(running())).filter("__bad = 0").select("bin", "count")


def trim_width(hist: DataFrame, width: float) -> DataFrame:
    return hist.filter(F.col("bin") <= width)


def running_statistics(df: DataFrame, value: Column) -> DataFrame:
    return df.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("variance"), F.stddev_samp(value).alias("sd"))


def joined(histograms: dict[str, DataFrame]) -> DataFrame:
    """Several histograms side by side, outer-joined by bin, 0 where one lacks a bin."""
    parts = [h.select("bin", F.lit(k).alias("__k"), "count") for k, h in histograms.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("bin").agg(*[F.sum(F.when(F.col("__k") == k, F.col("count")).otherwise(0.0)).alias(k) for k in histograms])

"""Windows, scaling, blocks and intervals of series; every row has its id and its place in time."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tumbling(rows: DataFrame, key: str, index: str, width: int) -> DataFrame:
    """(key, window, n, first, last): samples by whole windows of their index; the last may be short."""
    window = F.floor(F.col(index) / width)
    return rows.groupBy(key, window.alias("window")).agg(F.count(F.lit(1)).alias("n"), F.min(index).alias("first"), F.max(index).alias("last"))


def window_mean(rows: DataFrame, key: str, t: str, value: str, width: float, counts: DataFrame) -> DataFrame:
    """Mean of the frames of each window, times beyond the ends counted to the end windows, 0 without frames.

    counts: (key, windows), the number of windows of each key.
    """
    at = F.least(F.greatest(F.floor(F.col(t) / F.lit(width)), F.lit(0)), F.col("windows") - 1).cast("int")
    found = rows.join(counts, key).groupBy(key, at.alias("window")).agg(F.avg(value).alias("mean"), F.count(value).alias("frames"))
    dense = counts.select(key, F.explode(F.sequence(F.lit(0), (F.col("windows") - 1).cast("int"))).alias("window"))
    out = dense.join(found, [key, "window"], "left")
    return out.select(key, "window", F.coalesce("mean", F.lit(0.0)).alias("mean"), (F.coalesce("frames", F.lit(0)) / F.lit(width)).alias("density"))


def robust_scale(rows: DataFrame, key: str, value: str, name: str = "scaled") -> DataFrame:
    """Adds the value between its key's 10th and 90th percentile, clipped to 0..1; a flat series is 0."""
    ends = rows.groupBy(key).agg(F.percentile(value, F.array(F.lit(0.1), F.lit(0.9))).alias("__p"))
    low, high = F.col("__p")[0], F.col("__p")[1]
    scaled = F.when(high - low > 1e-12, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(value) - low) / (high - low)))).otherwise(F.lit(0.0))
    return rows.join(ends, key).withColumn(name, scaled).drop("__p")


def activity(rms: Column, onset: Column, density: Column) -> Column:
    return F.lit(0.50) * rms + F.lit(0.30) * onset + F.lit(0.20) * density


def central(n: Column, fraction: float = 0.30) -> Column:
    """Struct (start, end) of the middle of n windows, one window at least."""
    low, high = round((1 - fraction) / 2, 12), round((1 + fraction) / 2, 12)
    start = F.least(F.floor(n * F.lit(low)), n - 1)
    return F.struct(start.alias("start"), F.least(n, F.greatest(start + 1, F.ceil(n * F.lit(high)))).alias("end"))


def block_width(seconds: float, window_seconds: float) -> int:
    """Windows of a block, half to even, one at least."""
    return max(1, round(seconds / window_seconds))


def best_block(rows: DataFrame, key: str, index: str, value: str, width: int, tolerance: float = 0.01) -> DataFrame:
    """(key, start, end, mean): the block of the highest mean; of those within the tolerance the one nearest the middle, then the first.

    A series shorter than the width is one block.
    """
    ordered = Window.partitionBy(key).orderBy(index)
    every = Window.partitionBy(key)
    ahead = ordered.rowsBetween(0, width - 1)
    moved = rows.withColumn("i", F.row_number().over(ordered) - 1).withColumn("n", F.count(F.lit(1)).over(every))
    moved = moved.withColumn("w", F.least("n", F.lit(width))).withColumn("mean", F.bround(F.avg(value).over(ahead), 9)).where(F.col("i") + F.col("w") <= F.col("n"))
    best = F.max("mean").over(every)
    close = moved.withColumn("best", best).where(F.col("mean") >= F.col("best") - F.greatest(F.lit(1e-9), F.abs("best") * tolerance))
    off = F.abs(F.col("i") + F.col("w") / 2 - F.col("n") / 2)
    first = F.row_number().over(Window.partitionBy(key).orderBy(off, "i"))
    return close.withColumn("place", first).where("place = 1").select(key, F.col("i").alias("start"), (F.col("i") + F.col("w")).alias("end"), "mean")


def intervals(rows: DataFrame, key: str, t: str, order: list) -> DataFrame:
    """Adds the time to the key's next row."""
    return rows.withColumn("interval", F.lead(t).over(Window.partitionBy(key).orderBy(*order)) - F.col(t))


def stability(mean: Column, std: Column) -> Column:
    """exp(-coefficient of variation); 0 where the mean is not positive."""
    return F.when(mean > 1e-12, F.exp(-std / mean)).otherwise(F.lit(0.0))


def folded_tempo(bpm: Column, low: float = 60.0) -> Column:
    """A tempo moved by powers of two into [low, 2 low]; 0 for none."""
    bad = bpm.isNull() | F.isnan(bpm) | (bpm <= 0) | (bpm == float("inf"))
    up = F.ceil(F.log2(F.lit(low) / bpm) - F.lit(1e-12))
    down = F.ceil(F.log2(bpm / F.lit(2 * low)) - F.lit(1e-12))
    return F.when(bad, F.lit(0.0)).when(bpm < low, bpm * F.pow(F.lit(2.0), up)).when(bpm > 2 * low, bpm / F.pow(F.lit(2.0), down)).otherwise(bpm)


def tempo_bins(n: int = 24, low: float = 60.0, high: float = 220.0) -> list[float]:
    """Bins at equal ratios."""
    return [low * math.exp(i * math.log(high / low) / (n - 1)) for i in range(n)]


def sampled_at_bins(rows: DataFrame, key: str, frequency: str, power: str, bins: list[float]) -> DataFrame:
    """(key, bin, share): the power of the frequency nearest each bin, the first among equals, divided by the key's sum."""
    each = F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(b).alias("bpm")) for i, b in enumerate(bins)])
    near = rows.withColumn("b", F.explode(each))
    found = near.groupBy(key, "b.bin").agg(F.min_by(power, F.struct(F.abs(F.col(frequency) - F.col("b.bpm")), F.col(frequency))).alias("power"))
    total = F.sum("power").over(Window.partitionBy(key))
    return found.withColumn("share", F.when(total > 0, F.col("power") / total).otherwise(F.lit(0.0))).drop("power")


def slice_means(rows: DataFrame, bounds: DataFrame, key: str, index: str, value: str) -> DataFrame:
    """(key, slice_mean, whole_mean) of the windows within [start, end) and of all."""
    inside = (F.col(index) >= F.col("start")) & (F.col(index) < F.col("end"))
    return rows.join(bounds.select(key, "start", "end"), key).groupBy(key).agg(F.avg(F.when(inside, F.col(value))).alias("slice_mean"), F.avg(value).alias("whole_mean"))


def stats(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, mean, population std, percentiles 10, 50, 90 by linear interpolation)."""
    p = F.percentile(value, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return rows.groupBy(key).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), p.alias("p")).select(key, "mean", "std", F.col("p")[0].alias("p10"), F.col("p")[1].alias("p50"), F.col("p")[2].alias("p90"))

"""Ranking, selection under quotas, and latest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[Column], usable: Column | None = None, *, filter_first: bool = False) -> DataFrame:
    """The last row of each key by a total ascending order; `usable` filters before or after the choice, which differ where the newest row is unusable."""
    if usable is not None and filter_first:
        rows = rows.where(usable)
    names = [f"__o{i}" for i in range(len(order))]
    # An aggregate combines before its shuffle, where a window would move every row.
    best = rows.groupBy(*keys).agg(F.max(F.struct(*[o.alias(n) for o, n in zip(order, names, strict=True)], F.struct(*rows.columns).alias("__row"))).alias("best"))
    out = best.select("best.__row.*")
    return out.where(usable) if usable is not None and not filter_first else out


def first_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by a total ascending order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def diverse(rows: DataFrame, genre: str, artist: str, own_order: list[Column], best: Column, tie: list, quota: int, most: int, seen: Column) -> DataFrame:
    """Up to `quota` rows of each genre, artists in turn.

    An artist's rows stand in their own order; the artists' first rows come before their second ones and so on, up to `most` of each.  Within a
    turn unseen artists come first, then those whose first row has the smaller best rank, then by artist and tie.
    """
    within = Window.partitionBy(genre, artist).orderBy(*own_order)
    turn = rows.withColumn("layer", F.row_number().over(within)).withColumn("top_rank", F.first(best).over(within)).withColumn("seen", seen)
    order = Window.partitionBy(genre).orderBy("layer", "seen", "top_rank", artist, *tie)
    return turn.where(F.col("layer") <= most).withColumn("place", F.row_number().over(order)).where(F.col("place") <= quota)


def top_tags(tags: Column, n: int) -> Column:
    """Up to n of an array of (name, count), highest counts first, equal ones in the order given; bad counts are 0."""
    numbered = F.transform(tags, lambda x, i: F.struct((-F.coalesce(x["count"].try_cast("int"), F.lit(0))).alias("down"), i.alias("i"), x["name"].alias("name")))
    return F.transform(F.slice(F.array_sort(numbered), 1, n), lambda x: F.struct(x["name"].alias("name"), (-x["down"]).alias("count")))


def absolute_rank(page: Column, limit: int, offset: Column) -> Column:
    return (page - 1) * limit + offset


def best_rank(ranks: Column) -> Column:
    return F.coalesce(F.array_min(ranks), F.lit(1_000_000_000))


def with_margin(rows: DataFrame, group: str, score: str, order: list[Column]) -> DataFrame:
    """Adds place, the next row's score (0 behind the last) and the margin above it."""
    w = Window.partitionBy(group).orderBy(F.desc(score), *order)
    out = rows.withColumn("place", F.row_number().over(w)).withColumn("second_score", F.coalesce(F.lead(score).over(w), F.lit(0.0)))
    return out.withColumn("margin", F.col(score) - F.col("second_score"))


def early_stop(rows: DataFrame, run: list[str], epoch: str, metric: str, patience: int, least: float = 1e-6) -> DataFrame:
    """(run, best_epoch, best, stopped_at): improvements exceed the best so far by more than `least`; after `patience` epochs without one the run ends.

    The best so far depends on which epochs count as improvements, so a run's few epochs fold in order in one array.
    """
    folded = F.aggregate(
        F.array_sort(F.collect_list(F.struct(F.col(epoch).cast("long").alias("e"), F.col(metric).cast("double").alias("m")))),
        F.struct(F.lit(None).cast("long").alias("best_epoch"), F.lit(None).cast("double").alias("best"), F.lit(0).alias("stale"), F.lit(None).cast("long").alias("stopped_at")),
        lambda s, x: F.when(s["stopped_at"].isNotNull(), s).when(
            s["best"].isNull() | (x["m"] > s["best"] + least), F.struct(x["e"].alias("best_epoch"), x["m"].alias("best"), F.lit(0).alias("stale"), F.lit(None).cast("long").alias("stopped_at"))
        ).otherwise(F.struct(s["best_epoch"].alias("best_epoch"), s["best"].alias("best"), (s["stale"] + 1).alias("stale"), F.when(s["stale"] + 1 >= patience, x["e"]).alias("stopped_at"))),
    )
    return rows.groupBy(*run).agg(folded.alias("f")).select(*run, "f.best_epoch", "f.best", "f.stopped_at")

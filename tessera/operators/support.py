"""Support, deficits, plans and coverage of labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def support(rows: DataFrame, label: str, artist: str, track: str | None = None) -> DataFrame:
    """(label, tracks, artists, top_artist_tracks, top_artist_share): distinct artists exactly, in two combining aggregates."""
    each = rows.groupBy(label, artist).agg((F.countDistinct(track) if track else F.count(F.lit(1))).alias("n"))
    out = each.groupBy(label).agg(F.sum("n").alias("tracks"), F.count(artist).alias("artists"), F.max(F.when(F.col(artist).isNotNull(), F.col("n"))).alias("top_artist_tracks"))
    return out.withColumn("top_artist_tracks", F.coalesce("top_artist_tracks", F.lit(0))).withColumn("top_artist_share", F.col("top_artist_tracks") / F.col("tracks"))


def check_targets(**targets: float) -> None:
    for name, value in targets.items():
        if name == "expected_yield" and not 0 < value <= 1 or name != "expected_yield" and value < 1:
            raise ValueError(f"{name} is {value}")


def deficits(counted: DataFrame, target_tracks: int, target_artists: int, least_new: int, expected_yield: float, most: int) -> DataFrame:
    """Adds what each label lacks and the requests to make for it, never more than `most`."""
    check_targets(target_tracks=target_tracks, target_artists=target_artists, least_new=least_new, expected_yield=expected_yield, most=most)
    zero = F.lit(0).cast("long")
    tracks, artists = F.greatest(zero, F.lit(target_tracks) - F.col("tracks")), F.greatest(zero, F.lit(target_artists) - F.col("artists"))
    wanted = counted.withColumn("track_deficit", tracks).withColumn("artist_deficit", artists)
    wanted = wanted.withColumn("desired", F.greatest(F.lit(least_new).cast("long"), "track_deficit", "artist_deficit"))
    return wanted.withColumn("planned", F.least(F.lit(most).cast("long"), F.ceil(F.col("desired") / F.lit(float(expected_yield)))))


def priority(target_tracks: int, target_artists: int, f1: Column) -> Column:
    """.45 track deficit + .45 artist deficit + .10 of how far F1 lies below one half; a missing F1 counts as none."""
    gap = F.when(f1.isNull() | F.isnan(f1), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.lit(0.5) - f1) / F.lit(0.5))
    return F.lit(0.45) * (F.col("track_deficit") / F.lit(float(target_tracks))) + F.lit(0.45) * (F.col("artist_deficit") / F.lit(float(target_artists))) + F.lit(0.10) * gap


def plan(rows: DataFrame, performance: DataFrame | None, label: str, artist: str, *, target_tracks: int, target_artists: int, least_new: int, expected_yield: float, most: int) -> DataFrame:
    """The collection plan of labels, highest priority first: rank, support, deficits, requests, priority."""
    out = deficits(support(rows, label, artist), target_tracks, target_artists, least_new, expected_yield, most)
    out = out.join(performance.select(label, F.col("f1").cast("double").alias("f1")), label, "left") if performance is not None else out.withColumn("f1", F.lit(None).cast("double"))
    out = out.withColumn("priority", F.bround(priority(target_tracks, target_artists, F.col("f1")), 6))
    order = Window.orderBy(F.desc("priority"), F.desc("planned"), "tracks", label)
    return out.withColumn("rank", F.row_number().over(order))


def summary(rows: DataFrame, value: str) -> DataFrame:
    """One row: least, median, largest, total and how many are positive; an empty relation gives zeros."""
    agg = rows.agg(F.min(value).alias("least"), F.median(value).alias("median"), F.max(value).alias("most"), F.sum(value).alias("total"), F.count_if(F.col(value) > 0).alias("positive"))
    return agg.select(*[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in agg.columns])


def by_origin(rows: DataFrame, label: str, artist: str, origin: str, origins: tuple[str, str]) -> DataFrame:
    """Tracks and artists of each label by origin and together; an artist of both counts once together."""
    aggs = [F.count(F.lit(1)).alias("combined_tracks"), F.countDistinct(artist).alias("combined_artists")]
    for o in origins:
        aggs += [F.count_if(F.col(origin) == o).alias(f"{o}_tracks"), F.countDistinct(F.when(F.col(origin) == o, F.col(artist))).alias(f"{o}_artists")]
    return rows.groupBy(label).agg(*aggs)


def viability(tracks: Column, artists: Column, is_root: Column, is_leaf: Column) -> Column:
    """Whether a class stays: roots and inner nodes do, leaves by tracks and artists."""
    strong, viable = (tracks >= 100) & (artists >= 50), (tracks >= 50) & (artists >= 30)
    return F.when(is_root, "parent_kept").when(~is_leaf, "internal_parent_kept").when(strong, "strong_leaf").when(viable, "viable_leaf").otherwise("drop_leaf")


def health(n: Column) -> Column:
    return F.when(n >= 100, "healthy").when(n >= 50, "borderline").otherwise("at_risk")


def viability_order(rows: DataFrame, n: str, id_col: str = "id") -> DataFrame:
    """Adds health and sorts by it, the worst first, then by n and id."""
    rank = F.when(F.col("health") == "at_risk", 0).when(F.col("health") == "borderline", 1).otherwise(2)
    return rows.withColumn("health", health(F.col(n))).orderBy(rank, n, id_col)


def strength_counts(evidence: DataFrame, candidate: str, genre: str, strength: str) -> DataFrame:
    """(genre, strong, medium, weak): distinct candidates' evidence of each strength; an unknown strength is weak."""
    known = F.lower(F.col(strength))
    level = F.when(known.isin("strong", "medium"), known).otherwise("weak")
    each = evidence.select(candidate, genre, level.alias("level")).distinct()
    return each.groupBy(genre).agg(*[F.count_if(F.col("level") == x).alias(x) for x in ("strong", "medium", "weak")])


def evidence_profile(strengths: Column) -> Column:
    has = lambda x: F.exists(strengths, lambda s: s == x)
    return F.when(has("strong"), "has_strong").when(has("medium"), "medium_only").otherwise("weak_only")


def class_weights(rows: DataFrame, label: str, how: str = "sqrt", classes: DataFrame | None = None) -> DataFrame:
    """(label, n, weight): 1, n / (k c) or its square root, divided by the mean over classes; with `classes` (label), one without rows raises."""
    counted = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    if classes is not None and (empty := [r[0] for r in classes.select(label).join(counted, label, "left_anti").orderBy(label).limit(5).collect()]):
        raise ValueError(f"classes without rows: {empty}")
    every = Window.partitionBy()
    balanced = F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.col("n"))
    raw = {"none": F.lit(1.0), "balanced": balanced, "sqrt": F.sqrt(balanced)}[how]
    return counted.withColumn("raw", raw).withColumn("weight", F.col("raw") / F.avg("raw").over(every)).drop("raw")


def distribution(rows: DataFrame, classes: DataFrame, splits: DataFrame, label: str, by: list[str]) -> DataFrame:
    """Support and share of every class in every split, zeros included; classes and splits are small."""
    counted = rows.groupBy(*by, label).agg(F.count(F.lit(1)).alias("support"))
    dense = splits.crossJoin(F.broadcast(classes)).join(counted, [*by, label], "left").withColumn("support", F.coalesce("support", F.lit(0)))
    total = F.sum("support").over(Window.partitionBy(*by))
    return dense.withColumn("total", total).withColumn("fraction", F.when(total > 0, F.col("support") / total).otherwise(F.lit(0.0)))

"""Pools, rescue tiers, label jobs and pruning of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.storage import written


def pool(responses: DataFrame, genre: str, page: str, query: str, key: str, target: int) -> DataFrame:
    """Recorded responses up to the block (page, query) with which a genre's distinct keys reach the target."""
    first = responses.groupBy(genre, key).agg(F.min(F.struct(page, query)).alias("b")).groupBy(genre, "b").agg(F.count(F.lit(1)).alias("new"))
    blocks = responses.select(genre, F.struct(page, query).alias("b")).distinct().join(first, [genre, "b"], "left").fillna(0, ["new"])
    before = F.sum("new").over(Window.partitionBy(genre).orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    open_ = blocks.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < target).select(genre, F.col(f"b.{page}").alias(page), F.col(f"b.{query}").alias(query))
    return responses.join(open_, [genre, page, query], "left_semi")


#: What each tier of a rescue searched by, and how strong that evidence is.
TIERS = ((1, "artist_top_track", "medium"), (2, "similar_tag", "weak"), (3, "parent_tag", "weak"))


def rescue(candidates: DataFrame, excluded: DataFrame, genre: str, key: str, artist: str, order: list[Column], needed: DataFrame, most: int, tier: str | None = None) -> DataFrame:
    """Up to `needed` (genre, needed, place) new rows of each genre: keys not excluded, up to `most` of an artist, artists in turn.

    Genres are served in their place; a key taken for a genre is gone for later ones.  Each key goes to the first genre that
    still has room for it: a round gives every key to its first genre with room, and rounds end when no genre gains.
    With a tier, a tier's turns all come before the next tier's, and an artist's rows of all tiers count towards `most`.
    """
    step = [F.col(tier)] if tier else []
    rest = candidates.join(excluded.select(key), key, "left_anti").join(needed, genre)
    if tier:  # a key that several tiers found is the first one's
        rest = rest.withColumn("__k", F.row_number().over(Window.partitionBy(genre, key).orderBy(*step, *order))).where("__k = 1").drop("__k")
    left = rest
    while True:
        w = Window.partitionBy(genre, artist).orderBy(*step, *order)
        turn = left.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= most)
        if tier:
            turn = turn.withColumn("turn", F.row_number().over(Window.partitionBy(genre, artist, tier).orderBy(*order)))
        mine = turn.withColumn("n", F.row_number().over(Window.partitionBy(genre).orderBy(*step, "turn", *order))).where(F.col("n") <= F.col("needed"))
        mine = written(mine, "rescue")
        won = mine.join(mine.groupBy(key).agg(F.min("place").alias("owner")), key)
        lost = written(won.where(F.col("place") > F.col("owner")).select(genre, key), "lost")
        if not lost.limit(1).count():
            return won.where(F.col("place") == F.col("owner")).drop("n", "owner", "turn")
        # A genre that lost a key to an earlier one chooses again without it.
        left = written(left.join(lost, [genre, key], "left_anti"), "left")


def rescued(tiers: DataFrame, excluded: DataFrame, genre: str, key: str, artist: str, known_artists: DataFrame, order: list[Column], needed: DataFrame, most: int) -> DataFrame:
    """A rescue in three tiers (column tier, as TIERS), new artists first within each, with the evidence that a row came by."""
    new = tiers.join(known_artists.select(artist).distinct().withColumn("__known", F.lit(True)), artist, "left").withColumn("__known", F.coalesce("__known", F.lit(False)))
    out = rescue(new, excluded, genre, key, artist, [F.col("__known"), *order], needed, most, "tier")
    kind = strength = None
    for n, k, s in TIERS:
        kind, strength = (F.when(F.col("tier") == n, F.lit(v)) if c is None else c.when(F.col("tier") == n, F.lit(v)) for c, v in ((kind, k), (strength, s)))
    return out.drop("__known").withColumn("evidence", F.struct(F.col(genre).alias("genre_id"), kind.alias("type"), strength.alias("strength")))


def evidence(candidates: DataFrame, found: str = "retrieval_evidence", genres: str = "discovered_for") -> Column:
    """For each genre a candidate was found for: its evidence, or a default of medium strength."""
    own = lambda g: F.filter(F.col(found), lambda e: e["genre_id"] == g)
    plain = lambda g: F.array(F.struct(g.alias("genre_id"), F.lit("genre_tag").alias("type"), F.lit("medium").alias("strength")))
    return F.flatten(F.transform(F.col(genres), lambda g: F.when(F.size(own(g)) > 0, F.transform(own(g), lambda e: F.struct(e["genre_id"].alias("genre_id"), e["type"].alias("type"), e["strength"].alias("strength")))).otherwise(plain(g))))


def pruned(rows: DataFrame, elements: str, keep: Column, key: str) -> DataFrame:
    """Rows whose array keeps an element, with how many went; `keep` reads the array's allowed values."""
    left = F.filter(F.col(elements), lambda x: F.array_contains(keep, x))
    return rows.select(key, left.alias(elements), (F.size(elements) - F.size(left)).alias("removed")).where(F.size(elements) > 0)


def pool_target(quota: Column, multiplier: float) -> Column:
    return F.greatest(quota, F.bround(quota * multiplier).cast("long"))

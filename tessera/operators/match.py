"""Scoring, ranking and accepting of recorded search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.plans.storage import written

#: Least score, title score, artist score and margin by kind of result.
LEAST = {"song": (0.78, 0.78, 0.55, 0.025), "video": (0.80, 0.83, 0.55, 0.03)}
TITLE_WEIGHT = {"song": 0.70, "video": 0.76}
CLEAR = 0.94
#: Score, title score and artist score with which a result of the first query is taken without the second one.
EARLY = {"song": (0.97, 0.96, 0.90), "video": (0.96, 0.95, 0.85)}


def query_variants(artist: Column, title: Column) -> Column:
    """`artist title` and `title artist`, one of them if they normalise alike."""
    a, b = F.concat_ws(" ", F.trim(artist), F.trim(title)), F.concat_ws(" ", F.trim(title), F.trim(artist))
    return F.when(X.normalize(a) == X.normalize(b), F.array(a)).otherwise(F.array(a, b))


def scored(pairs: DataFrame, source_type: str) -> DataFrame:
    """Adds title_score, artist_score, version, bad_video and score to rows (artist, title, result_title, result_artists array).

    The result's title counts as an artist too: uploads often carry the artist there alone.
    """
    # Each distinct title is taken apart once, and each distinct pair of normal forms compared once.
    rows = written(pairs.withColumn("__row", F.monotonically_increasing_id()).withColumn("__t", F.coalesce("result_title", F.lit(""))), "pairs")
    titles = rows.select(F.col("title").alias("t")).union(rows.select("__t")).where("t is not null").distinct()
    apart = written(titles.select("t", X.bare_title(F.col("t")).alias("bare"), X.unversioned(F.col("t")).alias("base"), X.remix_name(F.col("t")).alias("remix")), "titles")
    plain = written(apart.select("t", *[X.normalize(F.col(c)).alias(c) for c in ("bare", "base", "remix")], X.normalize(F.col("t")).alias("plain")), "titles")
    parts = plain.select("t", "base", "plain", X.version_of(F.col("bare"), F.col("remix")).alias("v"))
    one, two = (parts.select(F.col("t").alias(t), F.col("base").alias(f"__{k}"), F.col("v").alias(f"__v{k}"), F.col("plain").alias(f"__p{k}")) for t, k in (("title", "a"), ("__t", "b")))
    rows = written(rows.join(one, "title", "left").join(two, "__t"), "versions")
    names = X.artists_parts(F.coalesce("result_artists", F.array().cast("array<string>")))
    each = rows.select("__row", X.artist_parts(F.col("artist")).alias("as"), F.concat(names, F.array("__pb")).alias("t")).select("__row", F.explode("as").alias("a"), "t").select("__row", "a", F.explode("t").alias("b"))
    each = written(each, "artists")
    compared = rows.select(F.col("__a").alias("a"), F.col("__b").alias("b")).union(each.select("a", "b")).union(rows.select(F.col("__va.remix_name"), F.col("__vb.remix_name"))).where("a is not null and b is not null").distinct()
    like = written(compared.withColumn("like", X.flexible_similarity(F.col("a"), F.col("b"))), "similarities")
    artists = each.join(like, ["a", "b"]).groupBy("__row").agg(F.max("like").alias("artist_score"))
    title = like.select(F.col("a").alias("__a"), F.col("b").alias("__b"), F.col("like").alias("title_score"))
    remix = like.select(F.col("a").alias("__ra"), F.col("b").alias("__rb"), F.col("like").alias("__remix_like"))
    out = rows.withColumn("__ra", F.col("__va.remix_name")).withColumn("__rb", F.col("__vb.remix_name")).join(title, ["__a", "__b"], "left").join(remix, ["__ra", "__rb"], "left").join(artists, "__row", "left")
    out = out.fillna(0.0, ["title_score", "artist_score"]).withColumn("version", X.compatibility(F.col("__va"), F.col("__vb"), F.col("__remix_like")))
    bad = X.bad_video(F.coalesce("__pa", F.lit("")), F.col("__pb"), F.col("result_title").isNull()) if source_type == "video" else F.lit(None).cast("string")
    # The rules are long expressions: their results are read several times below, so they are computed once.
    out = written(out.withColumn("bad_video", bad).select(*pairs.columns, "title_score", "artist_score", "version", "bad_video"), "scored")
    w = TITLE_WEIGHT[source_type]
    combined = F.lit(w) * F.col("title_score") + F.lit(1 - w) * F.col("artist_score") - F.col("version.penalty")
    return out.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), combined)))


def ranked(rows: DataFrame, key: str, video: str = "video_id", seq: str = "seq") -> DataFrame:
    """Compatible results, one a video (the highest score, the first among equals), by score, title score, artist score and id; with margin to the next."""
    good = rows.where(F.col("version.ok") & F.col("bad_video").isNull() & F.col(video).isNotNull() & (F.col(video) != ""))
    once = good.withColumn("__n", F.row_number().over(Window.partitionBy(key, video).orderBy(F.desc("score"), seq))).where("__n = 1").drop("__n")
    w = Window.partitionBy(key).orderBy(F.desc("score"), F.desc("title_score"), F.desc("artist_score"), video)
    return once.withColumn("place", F.row_number().over(w)).withColumn("second_score", F.coalesce(F.lead("score").over(w), F.lit(0.0))).withColumn("margin", F.col("score") - F.col("second_score"))


def verdict(source_type: str) -> Column:
    """Why a best result isn't taken, the first reason; null if it is."""
    least, title, artist, margin = LEAST[source_type]
    return (
        F.when(F.col("title_score") < title, f"{source_type}_title_below_threshold")
        .when(F.col("artist_score") < artist, f"{source_type}_artist_below_threshold")
        .when(F.col("score") < least, f"{source_type}_combined_below_threshold")
        .when((F.col("score") < CLEAR) & (F.col("margin") < margin), f"{source_type}_ambiguous")
    )


def best(tracks: DataFrame, results: DataFrame, kind: str, key: str) -> DataFrame:
    """The best result of each track, with verdict: of the first query's results if that one is clear enough to be taken at once, else of all.

    results may have `query_no`, from 0: which of the track's queries gave a result.
    """
    rows = written(scored(tracks.join(results, key), kind), "results")
    columns = [key, F.col("video_id").alias(f"{kind}_id"), *[F.bround(c, 6).alias(f"{kind}_{c}") for c in ("score", "title_score", "artist_score", "margin")], verdict(kind).alias(f"{kind}_reason")]
    whole = ranked(rows, key).where("place = 1").select(*columns)
    if "query_no" not in results.columns:
        return whole
    score, title, artist = EARLY[kind]
    early = ranked(rows.where("query_no = 0"), key).where((F.col("place") == 1) & verdict(kind).isNull() & (F.col("score") >= score) & (F.col("title_score") >= title) & (F.col("artist_score") >= artist)).select(*columns)
    return early.union(whole.join(early.select(key), key, "left_anti"))


def resolved(tracks: DataFrame, songs: DataFrame, videos: DataFrame, key: str = "candidate_id") -> DataFrame:
    """(key, status, video_id, source, reason, score): the best song if it is taken, else the best video, else unresolved with both reasons.

    A track without artist or title is unresolved for that reason; scores are rounded to six digits, half to even.
    """
    both = tracks.join(best(tracks, songs, "song", key), key, "left").join(best(tracks, videos, "video", key), key, "left")
    named = F.col("artist").isNotNull() & F.col("title").isNotNull()
    song, video = (named & F.col(f"{k}_id").isNotNull() & F.col(f"{k}_reason").isNull() for k in ("song", "video"))
    none = lambda k: F.coalesce(f"{k}_reason", F.lit(f"no_{k}_candidates"))
    return both.select(
        key,
        F.when(song | video, "resolved").otherwise("unresolved").alias("status"),
        F.when(song, F.col("song_id")).when(video, F.col("video_id")).alias("video_id"),
        F.when(song, "song").when(video, "video").alias("source"),
        F.when(~named, "missing_artist_or_title").when(~(song | video), F.concat_ws(",", none("song"), none("video"))).alias("reason"),
        F.when(song, F.col("song_score")).when(video, F.col("video_score")).alias("score"),
    )


def priority(labels: Column, active: Column, roots: Column) -> Column:
    """0: a label is an active leaf; 1: all are roots; 2: otherwise."""
    return F.when(F.exists(labels, lambda x: F.array_contains(active, x)), 0).when(F.forall(labels, lambda x: F.array_contains(roots, x)), 1).otherwise(2)


#: The support that counts where a label has none.
NO_SUPPORT = 10**9


def queue(rows: DataFrame, nodes: DataFrame, ancestors: DataFrame, support: DataFrame, failed: DataFrame, key: str = "candidate_id", labels: str = "labels") -> DataFrame:
    """(key, retry, tier, first, second): the places' keys of a work queue, sorted by all of them, then by key.

    Rows that failed before come first.  Tier 0: an active leaf is a label; 1: none is, no label is a leaf that was
    dropped, and an active parent is a label or above one; 2: the rest.  first and second: the least support of the
    tier's active leaves and parents.  nodes: (id, is_leaf, active); ancestors: (id, ancestor) without the id itself;
    support: (id, n).  Labels that the taxonomy lacks say nothing.
    """
    known = nodes.join(support.select("id", "n"), "id", "left").withColumn("n", F.coalesce("n", F.lit(NO_SUPPORT)))
    above = ancestors.join(known.where("active").select(F.col("id").alias("ancestor"), "n"), "ancestor").groupBy("id").agg(F.min("n").alias("above"))
    facts = known.join(above, "id", "left").select(F.col("id").alias("label"), "is_leaf", "active", "n", "above")
    each = rows.select(key, F.explode_outer(labels).alias("label")).join(facts, "label", "left")
    leaf, parent = F.when(F.col("active") & F.col("is_leaf"), F.col("n")), F.when(F.col("active") & ~F.col("is_leaf"), F.col("n"))
    by = each.groupBy(key).agg(F.min(leaf).alias("leaf"), F.least(F.min(parent), F.min("above")).alias("parent"), F.coalesce(F.bool_or(F.col("is_leaf") & ~F.col("active")), F.lit(False)).alias("dropped"))
    parent = F.coalesce("parent", F.lit(NO_SUPPORT))
    tier = F.when(F.col("leaf").isNotNull(), 0).when(~F.col("dropped") & F.col("parent").isNotNull(), 1).otherwise(2)
    retried = by.join(failed.select(key).distinct().withColumn("retry", F.lit(0)), key, "left").withColumn("retry", F.coalesce("retry", F.lit(1)))
    out = retried.select(key, "retry", tier.alias("tier"), F.when(F.col("leaf").isNotNull(), F.col("leaf")).otherwise(parent).cast("long").alias("first"), F.when(F.col("leaf").isNotNull(), parent).otherwise(NO_SUPPORT).cast("long").alias("second"))
    return out.orderBy("retry", "tier", "first", "second", key)

"""Unions and filters of labelled rows, and the validation of a whole labelling round."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions import values
from tessera.operators import identity, support, taxonomy, validate
from tessera.plans.storage import written


def bag_union(*parts: DataFrame) -> DataFrame:
    """All rows by column name; columns that a part lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def only_new(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The distinct keys of rows that known lacks."""
    return rows.select(key).distinct().join(known.select(key), key, "left_anti")


def allowed(kept_leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id) that labels may have: kept leaves, roots, and parents that the taxonomy knows."""
    parents = nodes.select(F.col("parent").alias("id")).join(nodes.select("id"), "id", "left_semi")
    return kept_leaves.select("id").union(nodes.where("parent is null").select("id")).union(parents).distinct()


def wanted(quotas: DataFrame, nodes: DataFrame, quota: str) -> DataFrame:
    """Rows (id) with a quota whose id the taxonomy knows."""
    return quotas.where(F.col(quota) > 0).join(nodes.select("id"), "id", "left_semi")


def short(coverage: DataFrame, shortfall: str, place: str) -> DataFrame:
    """Rows that lack something, in the coverage's own order."""
    return coverage.where(F.col(shortfall) > 0).orderBy(place)


def is_text(json: Column) -> Column:
    """The text of a JSON value; null where it is of another type or blank."""
    return F.nullif(values.text(F.try_parse_json(json)), F.lit(""))


def by_status(rows: DataFrame, status: str = "status") -> tuple[DataFrame, DataFrame]:
    """Labelled rows and all others, null statuses among the others."""
    yes = F.coalesce(F.col(status) == "labeled", F.lit(False))
    return rows.where(yes), rows.where(~yes)


def training_rows(rows: DataFrame, track: str, label: str, confidence: str, least: float, tracks: int) -> DataFrame:
    """(track, label) of confidence `least` or more, of labels that so many distinct tracks have then."""
    sure = rows.where(F.col(confidence) >= least).select(track, label).distinct()
    often = sure.groupBy(label).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= tracks).select(label)
    return sure.join(often, label, "left_semi").select(track, label)


@dataclass
class Validated:
    issues: DataFrame  # seq, candidate_id, issue, detail
    joined: DataFrame  # rows of the output that the input knows, with metadata, keys and label ids
    duplicates: DataFrame  # seq, candidate_id, duplicate_type, matched
    accepted: DataFrame
    others: DataFrame
    classes: DataFrame  # support of each class, old and new, and whether it stays
    summary: DataFrame  # one row


def validated(output: DataFrame, label_input: DataFrame, candidates: DataFrame, samples: DataFrame, old_candidates: DataFrame, nodes: DataFrame) -> Validated:
    """Validates a round of labelling against its input and an earlier round.

    output: (seq, candidate_id, status, labels as JSON, reason).  label_input, candidates: (seq, candidate_id, artist, title,
    mbid, artists), the last row of an id counts; where candidates lack an id the input's row stands in.  samples (usable
    rows of the earlier round, with labels as JSON) and old_candidates: (artist, title, mbid, artists).  nodes: a taxonomy.

    Labelled rows that share a key with the earlier round, or with an accepted row before them, are duplicates.
    """
    meta = ("artist", "title", "mbid", "artists")
    last = lambda rows: rows.where("candidate_id is not null").groupBy("candidate_id").agg(F.max_by(F.struct(*meta), "seq").alias("m"))
    known = written(last(label_input), "input")
    above = taxonomy.closure(nodes, "raise").where("depth > 0").select("id", "ancestor")
    issues = written(validate.issues(output, known.select("candidate_id"), nodes.select("id"), above), "issues")
    found = output.join(known, "candidate_id").join(last(candidates).withColumnRenamed("m", "c"), "candidate_id", "left")
    rows = found.withColumn("fallback", F.col("c").isNull()).withColumn("m", F.coalesce("c", "m")).select("seq", "candidate_id", "status", "labels", "reason", "fallback", "m.*")
    keyed = lambda df: df.withColumn("keys", X.identity_keys(F.col("artist"), F.col("title"), F.col("mbid")))
    joined = written(keyed(rows).withColumn("artist_keys", X.union_keys(F.col("artists"), F.array("artist"))).withColumn("ids", values.label_set(F.col("labels"))), "joined")
    labelled, others = by_status(joined)
    old = keyed(bag_union(samples.select("artist", "title", "mbid"), old_candidates.select("artist", "title", "mbid")))
    old = written(old.select(F.explode("keys").alias("key")).distinct(), "old")
    crossed = written(identity.overlap(labelled, F.col("keys"), old, "seq"), "crossed")
    fresh = written(labelled.join(crossed.select("seq"), "seq", "left_anti"), "fresh")
    folded = written(identity.greedy(fresh, "keys", "seq"), "folded")
    accepted = fresh.join(folded.where("accepted").select("seq"), "seq", "left_semi")
    clash = folded.where("not accepted").select("seq", F.lit("within").alias("duplicate_type"), F.array(F.col("clash").cast("string")).alias("matched"))
    duplicates = crossed.select("seq", F.lit("earlier").alias("duplicate_type"), "matched").union(clash).join(joined.select("seq", "candidate_id"), "seq")
    marked = samples.withColumn("artist_keys", X.union_keys(F.col("artists"), F.array("artist"))).withColumn("ids", values.label_set(F.col("labels")))
    each = marked.select("ids", "artist_keys", F.lit("old").alias("origin")).union(accepted.select("ids", "artist_keys", F.lit("new").alias("origin")))
    each = each.select(F.explode("ids").alias("id"), "artist_keys", "origin")
    tracks = each.groupBy("id").agg(*[F.count_if(F.col("origin") == o).alias(f"{o}_tracks") for o in ("old", "new")])
    names = each.select("id", F.explode("artist_keys").alias("name"), "origin").groupBy("id", "name").agg(*[F.bool_or(F.col("origin") == o).alias(o) for o in ("old", "new")])
    artists = names.groupBy("id").agg(*[F.count_if(F.col(o)).alias(f"{o}_artists") for o in ("old", "new")], F.count(F.lit(1)).alias("artists"))
    leaf = taxonomy.leaves(nodes).select("id", F.lit(True).alias("leaf"))
    classes = nodes.join(tracks, "id", "left").join(artists, "id", "left").join(leaf, "id", "left").fillna(0, ["old_tracks", "new_tracks", "old_artists", "new_artists", "artists"]).fillna(False, ["leaf"])
    classes = classes.withColumn("tracks", F.col("old_tracks") + F.col("new_tracks")).withColumn("status", support.viability(F.col("tracks"), F.col("artists"), F.col("parent").isNull(), F.col("leaf")))
    classes = classes.withColumn("active", F.col("status") != "drop_leaf").select("id", "parent", "position", "old_tracks", "new_tracks", "tracks", "old_artists", "new_artists", "artists", "status", "active")
    sizes = [(output, "outputs"), (issues, "issues"), (joined, "joined"), (joined.where("fallback"), "fallbacks"), (crossed, "earlier"), (folded.where("not accepted"), "within"), (folded.where("accepted"), "accepted"), (others, "others")]
    summary = sizes[0][0].agg(F.count(F.lit(1)).alias(sizes[0][1]))
    for df, name in sizes[1:]:
        summary = summary.crossJoin(df.agg(F.count(F.lit(1)).alias(name)))  # rows of one each
    return Validated(issues, joined, duplicates, accepted, others, classes, summary)

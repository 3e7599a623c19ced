"""Values of loose types: JSON texts whose members may be strings, objects or neither, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def items(json: Column) -> Column:
    """The members of a JSON list as variants; none for anything else, broken JSON and null."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(json), "$", "array<variant>"), F.array().cast("array<variant>"))


def text(v: Column) -> Column:
    """A variant's text; null for other types."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def field(v: Column, name: str) -> Column:
    """The text of an object's field; null for other types."""
    return text(F.try_variant_get(v, f"$.{name}", "variant"))


def number(v: Column, name: str) -> Column:
    """The number in an object's field; null for other types."""
    inner = F.try_variant_get(v, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(inner).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(inner, "$", "double"))


def known(values: Column) -> Column:
    return F.filter(values, lambda x: x.isNotNull())


def string_labels(json: Column) -> Column:
    """The set of labels that are strings, empty ones left out, sorted."""
    return F.array_sort(F.array_distinct(F.filter(known(F.transform(items(json), text)), lambda x: x != "")))


def label_list(json: Column) -> Column:
    """Labels that are strings or objects with an id that is one, in order, repeated ones and empty ones too."""
    return known(F.transform(items(json), lambda v: F.coalesce(text(v), field(v, "id"))))


def label_set(json: Column) -> Column:
    """The set of label_list(), sorted."""
    return F.array_sort(F.array_distinct(label_list(json)))


def as_strings(json: Column) -> Column:
    """A string as a list of one, or a list's strings; trimmed, blank ones left out."""
    one = text(F.try_parse_json(json))
    return F.filter(F.transform(F.when(one.isNotNull(), F.array(one)).otherwise(known(F.transform(items(json), text))), lambda x: F.trim(x)), lambda x: x != "")


def compact_tags(json: Column, most: int = 12) -> Column:
    """Up to `most` (name, count) of tags that are strings or objects with a name; count is null where it is no number."""
    tags = F.transform(items(json), lambda v: F.struct(F.coalesce(text(v), field(v, "name")).alias("name"), number(v, "count").alias("count")))
    return F.slice(F.filter(tags, lambda x: x["name"].isNotNull()), 1, most)


def names(json: Column, member: str = "name") -> Column:
    """One field of a list of objects, where it is a string."""
    return known(F.transform(items(json), lambda v: field(v, member)))


def album(json: Column) -> Column:
    """(name, id) of an object; null for anything else."""
    v = F.try_parse_json(json)
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), F.struct(field(v, "name").alias("name"), field(v, "id").alias("id")))


def payload(source: Column, scores: dict[str, Column], artists: Column, album_: Column) -> Column:
    """What a resolved track keeps of its result: the reason by kind of source, scores of six digits, artists' names and ids, the album."""
    reason = F.when(source == "song", "matched_song").otherwise("matched_video_fallback")
    return F.struct(reason.alias("reason"), *[F.bround(c, 6).alias(n) for n, c in scores.items()], names(artists).alias("artists"), names(artists, "id").alias("artist_ids"), album(album_).alias("album"))


def padded(values: Column, size: Column, fill: float = 0.0) -> Column:
    """(values, mask): the array filled up to a size, and which places it had itself."""
    n = F.size(values)
    rest = F.greatest(size - n, F.lit(0))
    return F.struct(F.concat(values, F.array_repeat(F.lit(fill), rest)).alias("values"), F.concat(F.array_repeat(F.lit(True), n), F.array_repeat(F.lit(False), rest)).alias("mask"))


def holds(labels: Column, genre: Column) -> Column:
    """Whether a list has a genre; false for null."""
    return F.coalesce(F.array_contains(labels, genre), F.lit(False))


def run_name(encoder: str, split: str, model: str, view: str, rhythm: str) -> str:
    return "_".join([encoder, split, model, view, *(["rhythm"] if rhythm == "global" else [])])

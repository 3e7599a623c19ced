"""Exclusion, merging and deduplication of rows with several keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.storage import written


def exclude(rows: DataFrame, keys: Column, known: DataFrame, row_id: str) -> DataFrame:
    """Rows none of whose keys is in known (key)."""
    hit = rows.select(row_id, F.explode(keys).alias("key")).join(known.select("key"), "key", "left_semi").select(row_id).distinct()
    return rows.join(hit, row_id, "left_anti")


def overlap(rows: DataFrame, keys: Column, known: DataFrame, row_id: str) -> DataFrame:
    """(row_id, matched): the sorted keys that a row shares with known (key)."""
    return rows.select(row_id, F.explode(keys).alias("key")).join(known.select("key").distinct(), "key").groupBy(row_id).agg(F.array_sort(F.collect_set("key")).alias("matched"))


def merge(rows: DataFrame, key: str, lists: list[str], first: list[str], seq: str) -> DataFrame:
    """One row a key: sorted distinct members of the lists, the first row's other values, how many rows it stands for."""
    unions = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in lists]
    return rows.groupBy(key).agg(*unions, *[F.min_by(c, seq).alias(c) for c in first], F.count(F.lit(1)).alias("n_rows"))


def labels_with_confidence(rows: DataFrame, key: str, label: str, confidence: str, seq: str) -> DataFrame:
    """(key, label, confidence): the highest confidence of each label, nulls below all."""
    return rows.groupBy(key, label).agg(F.max_by(confidence, F.struct(F.coalesce(confidence, F.lit(float("-inf"))), -F.col(seq))).alias("confidence"))


def ordered_distinct(values: Column, key: Callable[[Column], Column]) -> Column:
    """Members of an array without those whose key came before, in order."""
    keys = F.transform(values, key)
    return F.filter(values, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label): the least node that edges reach, by stars of larger and smaller neighbours in turn."""
    e = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    nodes = edges.select(F.col(a).alias("node")).union(edges.select(F.col(b))).distinct()
    mark = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        e = written(large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", "m")).where("u <> v").distinct(), "edges")
        before, mark = mark, tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before:
            up = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label"))
            return nodes.join(up, "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def greedy(rows: DataFrame, keys: str, seq: str) -> DataFrame:
    """(seq, accepted, clash): in order of seq a row is rejected if an accepted row has any of its keys; rejected rows' keys count for nothing.

    Rows that share no key, directly or through others, don't depend on each other, so each component folds by itself.  Two
    rows with their keys as nodes make a component; rows whose keys nobody else has are accepted without a fold.
    """
    pairs = rows.select(F.col(seq).alias("s"), F.explode(keys).alias("key"))
    shared = pairs.groupBy("key").agg(F.min("s").alias("a"), F.max("s").alias("b")).where("a <> b").select("key")
    busy = written(pairs.join(shared, "key"), "pairs")
    ends = busy.groupBy("key").agg(F.min("s").alias("first"))
    group = components(busy.join(ends, "key"), "s", "first")
    folded = busy.groupBy("s").agg(F.collect_set("key").alias("keys")).join(group, F.col("s") == F.col("node")).select("label", "s", "keys")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, {}
        for pdf in batches:
            out = []
            for label, s, found in zip(pdf["label"], pdf["s"], pdf["keys"], strict=True):
                if label != now:
                    now, held = label, {}
                clash = min((held[k] for k in found if k in held), default=None)
                if clash is None:
                    held.update(dict.fromkeys(found, s))
                out.append((s, clash is None, clash))
            yield pd.DataFrame(out, columns=[seq, "accepted", "clash"]).astype({"clash": "Int64"})

    # Sorted by component and place, a task folds one component after another as rows stream by.
    kind = rows.schema[seq].dataType.simpleString()
    done = folded.repartition("label").sortWithinPartitions("label", "s").mapInPandas(fold, f"{seq} {kind}, accepted boolean, clash long")
    free = rows.select(seq).join(busy.select(F.col("s").alias(seq)).distinct(), seq, "left_anti").select(seq, F.lit(True).alias("accepted"), F.lit(None).cast("long").alias("clash"))
    return done.union(free)


def pooled(rows: DataFrame, genre: str, primary: str, text: str, seq: str) -> DataFrame:
    """(genre, row, merged_into): each row's pool entry, its own if it makes one.

    In order of seq, a row joins the entry under its primary key, else the one under its text key, else makes one under
    its primary key.  So only rows whose primary key is the text key make entries under a text, the first of each; a row
    with another primary key makes an entry unless its text had one before.  Null genres and keys are values like others.
    """
    cols = rows.select(F.col(genre).alias("g"), F.col(primary).alias("p"), F.col(text).alias("t"), F.col(seq).alias("s"))
    plain = F.col("p").eqNullSafe(F.col("t"))
    texts = written(cols.where(plain).groupBy(F.col("g").alias("tg"), F.col("t").alias("tt")).agg(F.min("s").alias("text_first")), "texts")
    joined = cols.join(texts, F.col("g").eqNullSafe(F.col("tg")) & F.col("t").eqNullSafe(F.col("tt")), "left").drop("tg", "tt")
    makes = joined.where(~plain & (F.col("text_first").isNull() | (F.col("text_first") > F.col("s"))))
    own = written(makes.groupBy(F.col("g").alias("og"), F.col("p").alias("op")).agg(F.min("s").alias("own_first")), "own")
    joined = joined.join(own, F.col("g").eqNullSafe(F.col("og")) & F.col("p").eqNullSafe(F.col("op")), "left")
    into = F.when(plain, F.col("text_first")).when(F.col("own_first") < F.col("s"), F.col("own_first")).when(F.col("text_first") < F.col("s"), F.col("text_first")).otherwise(F.col("s"))
    return joined.select(F.col("g").alias(genre), F.col("s").alias("row"), into.alias("merged_into"))

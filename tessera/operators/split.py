"""Single-label datasets, splits and learning curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.identity import components


def single_label(rows: DataFrame, targets: str, kept: Column, *, zero: str = "drop", several: str = "drop", excluded: str = "drop", other: str | None = None) -> DataFrame:
    """Adds reason and target to rows with an array of root targets; each policy drops such rows or calls them `other`."""
    if other is None and "other" in (zero, several, excluded):
        raise ValueError("a policy needs the class for other rows")
    n, only = F.size(targets), F.get(targets, F.lit(0))
    name = lambda base, policy: F.lit(f"{base}_to_other" if policy == "other" else f"{base}_dropped")
    is_kept = F.array_contains(kept, only)
    reason = F.when(n == 0, name("zero_parent", zero)).when(n > 1, name("ambiguous", several)).when(is_kept, F.lit("single_parent")).otherwise(name("excluded_parent", excluded))
    target = F.when((n == 1) & is_kept, only).when(F.col("reason").endswith("_to_other"), F.lit(other))
    return rows.withColumn("reason", reason).withColumn("target", target)


def share(key: Column, seed: str) -> Column:
    """A number from 0 to 1 that depends on the seed and the key alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.lit("|"), key.cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def assigned(unit: Column, first: float, second: float) -> Column:
    return F.when(unit < first, "train").when(unit < second, "validation").otherwise("test")


def disjoint_split(edges: DataFrame, row: str, artist: str, seed: str, first: float = 0.7, second: float = 0.85) -> DataFrame:
    """(row, component, split): rows that share artists, directly or through others, stay together; a null artist is shared by none."""
    named = edges.where(F.col(artist).isNotNull())
    ends = named.groupBy(artist).agg(F.min(row).alias("__first"))
    group = components(named.join(ends, artist).select(row, "__first"), row, "__first")
    alone = edges.select(row).distinct().join(named.select(row), row, "left_anti")
    group = group.union(alone.select(F.col(row).alias("node"), F.col(row).alias("label")))
    return group.select(F.col("node").alias(row), F.col("label").alias("component"), assigned(share(F.col("label"), seed), first, second).alias("split"))


def shared_artists(rows: DataFrame, artist: str, split: str = "split") -> DataFrame:
    """(one, two, shared) artists of each pair of splits that share any."""
    each = rows.select(artist, split).distinct().groupBy(artist).agg(F.array_sort(F.collect_set(split)).alias("s"))
    pairs = F.flatten(F.transform("s", lambda x, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda y: F.struct(x.alias("one"), y.alias("two")))))
    return each.where(F.size("s") > 1).select(F.explode(pairs).alias("p")).groupBy("p.one", "p.two").agg(F.count(F.lit(1)).alias("shared"))


def nested_subset(rows: DataFrame, key: str, signature: str, seed: str, fractions: list[float]) -> DataFrame:
    """(key, fraction): the first rows of each signature, up to the fraction rounded up; smaller subsets lie within larger ones."""
    place = F.row_number().over(Window.partitionBy(signature).orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key))
    n = F.count(F.lit(1)).over(Window.partitionBy(signature))
    steps = F.array(*[F.lit(float(f)) for f in fractions])
    return rows.withColumn("__p", place).withColumn("__n", n).withColumn("fraction", F.explode(steps)).where(F.col("__p") <= F.ceil(F.bround(F.col("__n") * F.col("fraction"), 9))).select(key, "fraction")


def active_classes(counts: DataFrame, key: str, least: int, *columns: str) -> DataFrame:
    """Adds the smallest of the columns and whether it reaches the least support."""
    low = F.least(*columns) if len(columns) > 1 else F.col(columns[0])
    return counts.withColumn("smallest", low).withColumn("active", low >= least)

"""Mixing sources to target weights by a time-varying curriculum.

Every source has a weight, which sets its target of words, and a schedule, which sets when they come: a
piecewise linear weight over training time 0 to 1.  A source's documents stand in an order of their own
(md5 of the id as text); a document's place among the source's cumulative words, divided by the target, is
a share of demand, and the schedule's integral, inverted at that share, is the training position.  Documents
are range-sorted by it.  A source whose target exceeds its size is passed through again.

The running sums are made in two levels, so that a source of any size spreads over all tasks: sums per
(source, bucket of the order), running sums over buckets, running sums within a bucket.

Defined results: null texts and texts without words have size 0 and take nothing; null is a source of its
own, after all others; a null id counts as the empty text for the order; rows that repeat are documents of
their own, and which of several equal rows gets which share makes no difference; an empty table gives no
rows; other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, written

#: Knots (time, weight) of the schedules, dealt to the sources in turn: even, falling, rising.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 2.0), (0.5, 1.0), (1.0, 0.5)), ((0.0, 0.5), (0.5, 1.0), (1.0, 2.0)))
#: Documents of a bucket, about.
BUCKET = 512


def integral(knots: tuple) -> list[float]:
    """The schedule's integral at each knot."""
    out = [0.0]
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        out.append(out[-1] + (w0 + w1) / 2 * (t1 - t0))
    return out


def inverted(share: Column, knots: tuple) -> Column:
    """The time by which a share (0 to 1) of the schedule's whole integral has passed."""
    sums = integral(knots)
    want, out = share * F.lit(sums[-1]), F.lit(1.0)
    for (t0, w0), (t1, w1), before, after in reversed(list(zip(knots, knots[1:], sums, sums[1:], strict=False))):
        rest, slope = want - F.lit(before), (w1 - w0) / (t1 - t0)
        time = F.lit(t0) + F.lit(2.0) * rest / (F.lit(w0) + F.sqrt(F.lit(w0 * w0) + F.lit(2.0 * slope) * rest))
        out = F.when(want <= F.lit(after), time).otherwise(out)
    return out


def targets(sources: DataFrame, share: Fraction, weights: tuple[int, ...], repeats: int) -> DataFrame:
    """Adds nth, weight and target to (key, source, source_size): shares of the whole by weight, none above `repeats` times its size, the excess reshared by weight.

    One small aggregate a round; the rounds end when no further source reaches its bound.
    """
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    ranked = written(sources.withColumn("nth", nth).withColumn("weight", pick.cast("long")), "sources")
    capped, found = F.lit(False), None
    while True:
        total, full, rest, n = ranked.agg(F.sum("source_size"), F.sum(F.when(capped, F.col("source_size"))), F.sum(F.when(~capped, F.col("weight"))), F.count(F.when(capped, 1))).first()
        num = share.numerator * (total or 0) - share.denominator * repeats * (full or 0)
        den = share.denominator * (rest or 0)
        if n == found or not den:
            break
        found = n
        capped = F.lit(num) * F.col("weight") > F.lit(repeats * den) * F.col("source_size")
    bound = (F.lit(repeats) * F.col("source_size")).cast("double")
    even = (F.lit(num) * F.col("weight")).cast("double") / F.lit(float(den)) if den else bound
    return ranked.withColumn("target", F.when(capped, bound).otherwise(even))


def text_order(id_col: str, text_col: str | None = None) -> Column:
    """A document's place in its source: md5 of the id as text, with the text's hash where ids may repeat."""
    parts = [F.coalesce(F.col(id_col).cast("string"), F.lit(""))]
    if text_col:
        parts += [F.lit(":"), F.xxhash64(F.col(text_col)).cast("string")]
    return F.md5(F.concat(*parts).cast("binary"))


def source_key(source_col: str) -> Column:
    return F.when(F.col(source_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(source_col).cast("string")))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, order: Column | None = None, share: Fraction = Fraction(3, 2), weights: tuple[int, ...] = (3, 1, 2), repeats: int = 2, schedules: tuple = SCHEDULES) -> DataFrame:
    """Each row's (id, source, size, source_size, target, taken, positions, key, place, words), in no order.

    taken: words the mix takes of the document, over all passes; the last document a source gives is taken in part, so
    that a source's words are its target's whole part.  positions: the training position of each pass that takes words.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    place = text_order(id_col) if order is None else order
    sizes = written(df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), source_key(source_col).alias("key"), size.alias("size"), place.alias("place")), "sizes")
    bits = min(28, max(0, math.ceil(math.log2(max(1, sizes.count()) / BUCKET))))
    sizes = sizes.withColumn("bucket", F.shiftright(F.conv(F.substring("place", 1, 7), 16, 10).cast("long"), 28 - bits))
    sums = sizes.groupBy("key", "bucket").agg(F.first("source").alias("source"), F.sum("size").alias("words"))
    wanted = targets(sums.groupBy("key").agg(F.first("source").alias("source"), F.sum("words").alias("source_size")), share, weights, repeats)
    running = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("key", "bucket", F.coalesce(F.sum("words").over(running), F.lit(0)).alias("before")).join(wanted.drop("source", "weight"), "key")
    within = Window.partitionBy("key", "bucket").orderBy("place", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.join(starts, ["key", "bucket"]).withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    whole = F.floor("target").cast("long")

    def passed(k: int) -> tuple[Column, Column]:
        at = F.col("start") + F.lit(k) * F.col("source_size")
        words = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), whole - at))
        part = (at.cast("double") + words.cast("double") / 2) / F.col("target")
        position = inverted(part, schedules[-1])
        for i, knots in enumerate(schedules[:-1]):
            position = F.when(F.col("nth") % len(schedules) == i, inverted(part, knots)).otherwise(position)
        return words, F.when(words > 0, position)

    passes = [passed(k) for k in range(repeats)]
    taken = passes[0][0]
    for words, _ in passes[1:]:
        taken = taken + words
    positions = F.filter(F.array(*[p for _, p in passes]), lambda x: x.isNotNull())
    return placed.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", taken.alias("taken"), positions.alias("positions"), "key", "place", F.array(*[w for w, _ in passes]).alias("words"))


def with_file_place(df: DataFrame, name: str) -> DataFrame:
    """Adds (file, row): where a row stands in the files it is read from; other rows are written first."""
    place = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")).alias(name)
    try:
        return df.select("*", place)
    except AnalysisException:  # not read from files
        return written(df, "rows").select("*", place)


def repeated(df: DataFrame, order: Column, text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """All columns of the rows, once for each pass that takes words of them, range-sorted by the pass's training position."""
    row, place, position = "__mixing_row", "__mixing_place", "__mixing_position"
    placed = with_file_place(df, row).withColumn(place, order)
    mixed = mix(placed, row, text_col, source_col, order=F.col(place), **options)
    copies = written(mixed.select(row, F.explode("positions").alias(position)), "positions")
    return placed.join(copies, row).orderBy(position, place, row).select(*df.columns)


def in_training_order(mixed: DataFrame) -> DataFrame:
    """The mix's rows range-sorted by their first position; what the mix leaves out comes last, by its place, so that ranges part it too."""
    return mixed.orderBy(F.get("positions", F.lit(0)).asc_nulls_last(), "place")

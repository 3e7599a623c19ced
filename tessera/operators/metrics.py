"""Confusion, class and threshold metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.taxonomy import closure


def confusion(rows: DataFrame, true: str, predicted: str, classes: DataFrame) -> DataFrame:
    """(true_class, predicted_class, n) of every pair of classes, zeros included; `classes` has one column, class."""
    counted = rows.groupBy(F.col(true).alias("true_class"), F.col(predicted).alias("predicted_class")).agg(F.count(F.lit(1)).alias("n"))
    dense = classes.select(F.col("class").alias("true_class")).crossJoin(F.broadcast(classes.select(F.col("class").alias("predicted_class"))))
    return dense.join(counted, ["true_class", "predicted_class"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    """a / b, or `empty` where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(empty))


def f1(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def per_class(matrix: DataFrame) -> DataFrame:
    """(class, support, predicted, correct, precision, recall, f1)."""
    truth = matrix.groupBy(F.col("true_class").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("true_class") == F.col("predicted_class"), F.col("n"))).alias("correct"))
    said = matrix.groupBy(F.col("predicted_class").alias("class")).agg(F.sum("n").alias("predicted"))
    out = truth.join(said, "class").withColumn("precision", ratio(F.col("correct"), F.col("predicted"))).withColumn("recall", ratio(F.col("correct"), F.col("support")))
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def overall(metrics: DataFrame, other: Column | None = None) -> DataFrame:
    """One row: samples, accuracy, macro F1 over supported classes, the same without `other`, weighted F1."""
    supported = F.col("support") > 0
    kept = supported & ~(other if other is not None else F.lit(False))
    total = F.sum("support")
    return metrics.agg(
        total.alias("samples"),
        ratio(F.sum("correct"), total).alias("accuracy"),
        F.coalesce(F.avg(F.when(supported, F.col("f1"))), F.lit(0.0)).alias("macro_f1"),
        F.coalesce(F.avg(F.when(kept, F.col("f1"))), F.lit(0.0)).alias("macro_f1_kept"),
        ratio(F.sum(F.col("f1") * F.col("support")), total).alias("weighted_f1"),
    )


def row_normalized(matrix: DataFrame, empty: float = 0.0) -> DataFrame:
    """Adds each class's shares; `empty` is the share where a class has no rows."""
    return matrix.withColumn("share", ratio(F.col("n"), F.sum("n").over(Window.partitionBy("true_class")), empty))


def top_confusions(matrix: DataFrame, k: int, itself: bool = False, empty: float = 0.0) -> DataFrame:
    """The k classes each class is most taken for, zeros included, equal ones by class; `empty` is the fraction of a class without rows.

    With `itself` a class comes after all others that it is taken for, and pairs with the class null come last.
    """
    support, same = F.sum("n").over(Window.partitionBy("true_class")), F.col("true_class") == F.col("predicted_class")
    shared = matrix.withColumn("support", support).where(F.lit(True) if itself else ~same)
    place = F.row_number().over(Window.partitionBy("true_class").orderBy(same.asc_nulls_last(), F.desc("n"), F.col("predicted_class").asc_nulls_last()))
    return shared.withColumn("rank", place).where(F.col("rank") <= k).withColumn("fraction", ratio(F.col("n"), F.col("support"), empty))


def confidence(rows: DataFrame, probability: str, correct: Column) -> DataFrame:
    """Mean and median of the largest probability, and its mean where right and where wrong; 0 for none."""
    p = F.col(probability)
    found = rows.agg(F.avg(p).alias("mean"), F.median(p).alias("median"), F.avg(F.when(correct, p)).alias("mean_correct"), F.avg(F.when(~correct, p)).alias("mean_incorrect"))
    return found.select(*[F.coalesce(c, F.lit(0.0)).alias(c) for c in found.columns])


def thresholds(scored: DataFrame, label: str, truth: str, score: str, first: int = 10, last: int = 90) -> DataFrame:
    """(threshold, macro_f1 over supported labels, micro_f1) at each hundredth.

    Scores are counted by hundredth first; what a threshold accepts are running sums over those few counts.
    """
    step = F.least(F.greatest(F.floor(F.col(score) * 100 + F.lit(1e-9)), F.lit(first - 1)), F.lit(last)).cast("int")
    counted = scored.groupBy(label, step.alias("step")).agg(F.sum(F.col(truth).cast("long")).alias("yes"), F.count(F.lit(1)).alias("n"))
    steps = scored.sparkSession.range(first - 1, last + 1).select(F.col("id").cast("int").alias("step"))
    dense = counted.select(label).distinct().crossJoin(F.broadcast(steps)).join(counted, [label, "step"], "left").fillna(0, ["yes", "n"])
    above = Window.partitionBy(label).orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(label)
    run = dense.select(label, "step", F.sum("yes").over(above).alias("tp"), F.sum("n").over(above).alias("said"), F.sum("yes").over(every).alias("support")).where(F.col("step") >= first)
    run = run.withColumn("f1", ratio(2 * F.col("tp"), F.col("said") + F.col("support")))
    out = run.groupBy("step").agg(F.coalesce(F.avg(F.when(F.col("support") > 0, F.col("f1"))), F.lit(0.0)).alias("macro_f1"), ratio(2 * F.sum("tp"), F.sum("said") + F.sum("support")).alias("micro_f1"))
    return out.select((F.col("step") / 100).alias("threshold"), "macro_f1", "micro_f1")


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The threshold of the highest macro F1, the lowest among equals."""
    return sweep.agg(F.max_by("threshold", F.struct(F.bround("macro_f1", 12), -F.col("threshold"))).alias("threshold"), F.max("macro_f1").alias("macro_f1"))


def multilabel(said: DataFrame, label: str, truth: str, predicted: str) -> DataFrame:
    """(label, tp, fp, fn, tn, precision, recall, f1) of 0/1 columns."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    c = said.groupBy(label).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    c = c.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return c.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def multilabel_overall(counts: DataFrame) -> DataFrame:
    """One row: macro F1 over all and over supported labels, micro F1, Hamming loss, labels without support."""
    supported = F.col("tp") + F.col("fn") > 0
    wrong, cells = F.sum(F.col("fp") + F.col("fn")), F.sum(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    return counts.agg(F.avg("f1").alias("macro_all"), F.coalesce(F.avg(F.when(supported, F.col("f1"))), F.lit(0.0)).alias("macro_supported"), ratio(2 * F.sum("tp"), 2 * F.sum("tp") + wrong).alias("micro"), ratio(wrong, cells).alias("hamming_loss"), F.count_if(~supported).alias("zero_support"))


def subset_accuracy(said: DataFrame, sample: str, truth: str, predicted: str) -> DataFrame:
    each = said.groupBy(sample).agg(F.min((F.col(truth) == F.col(predicted)).cast("int")).alias("all_right"))
    return each.agg(F.avg("all_right").alias("subset_accuracy"))


def deltas(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Two runs side by side: both values, the difference and it in percent of the first."""
    both = a.select(*keys, F.col(value).alias("before")).join(b.select(*keys, F.col(value).alias("after")), keys, "full")
    return both.withColumn("delta", F.col("after") - F.col("before")).withColumn("percent", F.when(F.col("before") != 0, 100 * F.col("delta") / F.col("before")))


def violations(scores: DataFrame, nodes: DataFrame, sample: str, label: str, score: str) -> DataFrame:
    """One row: pairs of child and parent, how many children score above their parent, and their share."""
    parent = scores.select(sample, F.col(label).alias("parent"), F.col(score).alias("parent_score"))
    pairs = scores.join(F.broadcast(nodes.where("parent is not null").select(F.col("id").alias(label), "parent")), label).join(parent, [sample, "parent"])
    bad = F.count_if(F.col(score) > F.col("parent_score"))
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), bad.alias("violations"), ratio(bad, F.count(F.lit(1))).alias("rate"))


def projected(scores: DataFrame, nodes: DataFrame, sample: str, label: str, score: str) -> DataFrame:
    """Scores with each label raised to the highest of all labels below it."""
    above = closure(nodes).where("depth > 0").select(F.col("id").alias(label), "ancestor")
    up = scores.join(F.broadcast(above), label).select(sample, F.col("ancestor").alias(label), F.col(score))
    return scores.select(sample, label, score).union(up).groupBy(sample, label).agg(F.max(score).alias(score))


def single_parent_confusion(rows: DataFrame, roots: str, predicted: str, classes: DataFrame) -> DataFrame:
    """The confusion of rows with exactly one root; rows of several roots say nothing."""
    one = rows.where(F.size(roots) == 1).select(F.get(F.col(roots), F.lit(0)).alias("truth"), F.col(predicted).alias("predicted"))
    return confusion(one, "truth", "predicted", classes)

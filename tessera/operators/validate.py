"""Validation of labelled rows as rows of issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("labeled", "uncertain", "reject")
LOW = 0.60


def issues(output: DataFrame, known: DataFrame, labels: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(seq, candidate_id, issue, detail) of an output (seq, candidate_id, status, labels as JSON text of an array).

    known: (candidate_id) of the input.  labels: (id) of the taxonomy.  ancestors: (id, ancestor) without the id itself.
    Rows without an id, or with one that the input lacks, have that issue alone.
    """
    blank = F.col("candidate_id").isNull() | (F.trim("candidate_id") == "")
    nth = F.row_number().over(Window.partitionBy("candidate_id").orderBy("seq"))
    rows = output.join(known.select("candidate_id").distinct().withColumn("known", F.lit(True)), "candidate_id", "left").withColumn("nth", nth)
    parsed = F.try_parse_json("labels").cast("array<variant>")
    rows = rows.withColumn("found", F.coalesce(parsed, F.array().cast("array<variant>")))
    alive = ~blank & F.col("known").isNotNull()

    def issue(test: Column, name: str, detail: Column | None = None) -> Column:
        return F.when(test, F.struct(F.lit(name).alias("issue"), (detail if detail is not None else F.lit(None)).cast("string").alias("detail")))

    whole = F.array_compact(
        F.array(
            issue(blank, "missing_candidate_id"),
            issue(~blank & (F.col("nth") > 1), "duplicate_output_candidate_id"),
            issue(~blank & F.col("known").isNull(), "candidate_id_not_in_label_input"),
            issue(alive & ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "invalid_status", F.col("status")),
            issue(alive & (F.size("found") > 2), "too_many_labels", F.size("found")),
            issue(alive & (F.col("status") == "labeled") & (F.size("found") == 0), "labeled_without_labels"),
        )
    )
    first = rows.select("seq", "candidate_id", F.explode(whole).alias("i")).select("seq", "candidate_id", "i.*")
    each = rows.where(alive).select("seq", "candidate_id", F.posexplode("found").alias("at", "v")).withColumn("kind", F.expr("schema_of_variant(v)"))
    each = each.withColumn("id", F.expr("try_variant_get(v, '$.id', 'string')")).withColumn("conf", F.expr("try_variant_get(v, '$.confidence', 'double')")).withColumn("conf_kind", F.expr("schema_of_variant(try_variant_get(v, '$.confidence', 'variant'))"))
    each = each.join(F.broadcast(labels.select(F.col("id"), F.lit(True).alias("listed"))), "id", "left")
    object_ = F.col("kind").startswith("OBJECT")
    number = F.coalesce(F.col("conf_kind").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT)"), F.lit(False)) & F.coalesce(F.col("conf").between(0, 1), F.lit(False))
    parts = F.array_compact(F.array(issue(~object_, "label_not_object"), issue(object_ & F.col("listed").isNull(), "invalid_label_id", F.col("id")), issue(object_ & ~number, "invalid_confidence", F.col("conf_kind"))))
    second = each.select("seq", "candidate_id", F.explode(parts).alias("i")).select("seq", "candidate_id", "i.*")
    ids = each.where(object_ & F.col("id").isNotNull()).select("seq", "candidate_id", "id").distinct()
    above = ids.join(F.broadcast(ancestors), "id").select("seq", F.col("ancestor").alias("id")).distinct()
    third = ids.join(above, ["seq", "id"]).select("seq", "candidate_id", F.lit("redundant_parent_child").alias("issue"), F.col("id").alias("detail"))
    return first.union(second).union(third)


def low_confidence(rows: DataFrame, confidences: str) -> DataFrame:
    """How many rows' highest confidence (0 without any) lies below LOW."""
    return rows.agg(F.count_if(F.coalesce(F.array_max(confidences), F.lit(0.0)) < LOW).alias("low_confidence"))


def equal_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: how many ids only one side has, counting repeats."""
    both = a.groupBy(key).agg(F.count(F.lit(1)).alias("n")).join(b.groupBy(key).agg(F.count(F.lit(1)).alias("m")), key, "full")
    n, m = F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0))
    return both.agg(F.coalesce(F.sum(F.greatest(n - m, F.lit(0))), F.lit(0)).alias("only_a"), F.coalesce(F.sum(F.greatest(m - n, F.lit(0))), F.lit(0)).alias("only_b"))

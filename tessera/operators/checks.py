"""Checks of inputs before training: what is missing, out of range or made by another configuration raises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Encoders whose embeddings are windows of five seconds.
WINDOWED = ("mert", "muq")


class BadInput(ValueError):
    """Names up to five offending rows."""


def none_of(rows: DataFrame, key: str, what: str) -> None:
    """Raises if there are rows."""
    if found := [r[0] for r in rows.select(key).orderBy(key).limit(5).collect()]:
        raise BadInput(f"{what}: {', '.join(map(str, found))}")


def required(rows: DataFrame, others: DataFrame, key: str, what: str = "missing input") -> DataFrame:
    """The inner join, where every row must have a partner."""
    none_of(rows.join(others.select(key), key, "left_anti"), key, what)
    return rows.join(others, key)


def check_classes(classes: DataFrame, index: str = "index", id_col: str = "id") -> int:
    """The number of classes; their indices must be 0, 1, 2 and so on, each with an id."""
    low, high, n, several, ids = classes.agg(F.min(index), F.max(index), F.count(F.lit(1)), F.countDistinct(index), F.count(id_col)).first()
    if not n or (low, high, several, ids) != (0, n - 1, n, n):
        raise BadInput(f"{n} classes, {ids} of them with ids, with {several} indices from {low} to {high}")
    return n


def check_targets(rows: DataFrame, key: str, target: str, classes: int) -> DataFrame:
    """The rows; each target must be a whole number of a class."""
    kind = rows.schema[target].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long"):
        raise BadInput(f"targets are {kind}, not whole numbers")
    none_of(rows.where(F.col(target).isNull() | ~F.col(target).between(0, classes - 1)), key, "target out of range")
    return rows


def check_sections(rows: DataFrame, key: str, start: str, end: str, windows: str, counted: str) -> DataFrame:
    """The rows; a section must lie within its windows, of which there must be as many as its metadata say."""
    good = (F.col(start) >= 0) & (F.col(start) < F.col(end)) & (F.col(end) <= F.col(windows)) & (F.col(windows) == F.col(counted))
    none_of(rows.where(~F.coalesce(good, F.lit(False))), key, "section does not fit")
    return rows


def complete(windows_shape: Column, pooled_ok: Column, metadata: Column, fingerprint: str) -> Column:
    """Whether an extraction is done: valid windows and mean, metadata of this configuration that agree with their shape."""
    agree = (metadata["fingerprint"] == fingerprint) & (metadata["status"] == "embedded") & (metadata["windows_shape"] == windows_shape) & (F.size(metadata["valid_samples"]) == F.get(windows_shape, F.lit(0)))
    return F.coalesce((F.size(windows_shape) == 2) & pooled_ok & agree, F.lit(False))


def one_configuration(rows: DataFrame, fingerprint: str, wanted: str) -> DataFrame:
    """The rows; none may come from another configuration."""
    none_of(rows.where(F.col(fingerprint).isNotNull() & (F.col(fingerprint) != wanted)).select(fingerprint).distinct(), fingerprint, "made by another configuration")
    return rows


def check_request(saved: dict, asked: dict) -> None:
    """Raises if a saved model differs from what is asked of it in anything that is asked."""
    if wrong := sorted(k for k, v in asked.items() if saved.get(k) != v):
        raise BadInput("the model differs in " + ", ".join(f"{k} ({saved.get(k)!r}, not {asked[k]!r})" for k in wrong))


def representation_plan(encoder: str, model: str, view: str) -> tuple[str, str]:
    """What is read and what the model sees, pooled or sequence; parts of a track need an encoder of windows."""
    if view != "whole" and encoder not in WINDOWED:
        raise BadInput(f"the view {view} needs windows, which {encoder} has none of")
    seen = "sequence" if model == "attention" else "pooled"
    return ("sequence" if encoder in WINDOWED else seen), seen


def alike(a: Column, b: Column, absolute: float = 1e-5, relative: float = 1e-6) -> Column:
    """Whether two vectors agree within tolerances, as a second run must with the first."""
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= F.lit(absolute) + F.lit(relative) * F.abs(y)), lambda ok: F.coalesce(ok, F.lit(False)))


def log_loss(rows: DataFrame, logits: str, target: str) -> DataFrame:
    """One row: the mean cross entropy of logits, 0 without rows, and the number of rows."""
    top = F.array_max(logits)
    total = F.aggregate(F.col(logits), F.lit(0.0), lambda a, x: a + F.exp(x.cast("double") - top))
    loss = F.log(total) + top - F.get(F.col(logits), F.col(target).cast("int"))
    return rows.agg((F.coalesce(F.sum(loss), F.lit(0.0)) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("loss"), F.count(F.lit(1)).alias("n"))

"""Trees of labels: (id, parent, position) rows; roots have a null parent."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.storage import written


class BrokenTaxonomy(ValueError):
    """Repeated ids, unknown parents or cycles."""


def check(nodes: DataFrame) -> None:
    """Raises BrokenTaxonomy, naming up to five offending ids."""
    repeated = nodes.groupBy("id").count().where("count > 1").select("id")
    orphans = nodes.where("parent is not null").join(nodes.select(F.col("id").alias("parent")), "parent", "left_anti").select("id")
    blank = nodes.where("id is null or trim(id) = ''").select(F.coalesce("id", F.lit("(null)")).alias("id"))
    for what, rows in (("blank ids", blank), ("repeated ids", repeated), ("unknown parents of", orphans)):
        if found := [r.id for r in rows.limit(5).collect()]:
            raise BrokenTaxonomy(f"{what}: {found}")


def closure(nodes: DataFrame, on_cycle: str = "raise") -> DataFrame:
    """(id, ancestor, depth) of every node and ancestor, the node itself at depth 0.

    One join a level, each level written, until no node has a further ancestor, however deep the tree is.  A cycle raises,
    or with on_cycle="stop" ends where it closes.
    """
    parents = nodes.select(F.col("id").alias("ancestor"), "parent")
    levels = [nodes.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("depth"), F.array("id").alias("path"))]
    while True:
        up = levels[-1].join(parents, "ancestor").where("parent is not null")
        level = written(up.select("id", F.col("parent").alias("ancestor"), F.lit(len(levels)).alias("depth"), F.concat("path", F.array("parent")).alias("path"), F.array_contains("path", F.col("parent")).alias("closed")), "level")
        n, closed = level.agg(F.count_if(~F.col("closed")), F.count_if("closed")).first()
        if closed and on_cycle == "raise":
            raise BrokenTaxonomy("the parents form a cycle")
        if not n:
            out = levels[0]
            for further in levels[1:]:
                out = out.union(further)
            return out.drop("path")
        levels.append(level.where("not closed").drop("closed"))


def roots(nodes: DataFrame) -> DataFrame:
    """(id, root) of every node."""
    top = nodes.where("parent is null").select(F.col("id").alias("root"))
    return closure(nodes).join(F.broadcast(top), F.col("ancestor") == F.col("root")).select("id", "root")


def leaves(nodes: DataFrame) -> DataFrame:
    return nodes.join(nodes.select(F.col("parent").alias("id")).where("id is not null"), "id", "left_anti")


def family(nodes: DataFrame) -> DataFrame:
    """(id, member, position): for each node its parent and all of the parent's children; for a root itself and its children."""
    head = nodes.select("id", F.coalesce("parent", "id").alias("head"))
    members = nodes.select(F.col("id").alias("member"), F.coalesce("parent", "id").alias("head"), "position")
    return head.join(members, "head").select("id", "member", "position")


def expanded(rows: DataFrame, nodes: DataFrame, key: str, label: str = "label") -> DataFrame:
    """(key, label) with all ancestors of each label, distinct."""
    up = closure(nodes).select(F.col("id").alias(label), "ancestor")
    return rows.join(F.broadcast(up), label).select(key, F.col("ancestor").alias(label)).distinct()


def in_order(rows: DataFrame, by: list, name: str = "position") -> DataFrame:
    """Adds the place of each row of a small relation in a total order."""
    return rows.withColumn(name, F.row_number().over(Window.orderBy(*by)) - 1)

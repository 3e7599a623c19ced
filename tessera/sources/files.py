"""Readers and sinks: JSON lines by dialect, taxonomies, coerced CSV, documents, vectors, state logs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.storage import exists, written

DIALECTS = ("strict", "strict_optional", "skip_non_objects", "tolerant_last_line")


class BadLine(ValueError):
    """A line that the dialect doesn't allow, with its number."""


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str, dialect: str = "strict") -> DataFrame:
    """Rows of JSON-lines files with `seq`, the line's number in its file from 1.

    strict: any line that isn't an object raises; strict_optional: so, but a missing file is empty; skip_non_objects: only
    lines that aren't JSON raise; tolerant_last_line: objects count, and only a file's last line may be cut off.

    A large file is read in parts by many tasks: a line's number is its place in the part and the lines of the parts before.
    """
    if dialect not in DIALECTS:
        raise ValueError(dialect)
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    fields = T.StructType([*schema.fields, T.StructField("seq", T.LongType())])
    if dialect == "strict_optional" and not exists(spark, path):
        return spark.createDataFrame([], fields)
    read = spark.read.option("lineSep", "\n").text(path)
    read = written(read.select(F.regexp_replace("value", r"\r\z", "").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("at")), "lines")
    parts = read.groupBy("file", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = read.join(parts.withColumn("before", before), ["file", "part"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("seq"), "line").where(F.trim("line") != "")
    lines = written(lines.withColumn("kind", F.expr("schema_of_variant(try_parse_json(line))")), "lines")
    is_object = F.coalesce(F.col("kind").startswith("OBJECT"), F.lit(False))
    bad = lines.where(F.col("kind").isNull() if dialect in ("skip_non_objects", "tolerant_last_line") else ~is_object)
    if dialect == "tolerant_last_line":
        bad = bad.join(lines.groupBy("file").agg(F.max("seq").alias("last")), "file").where("seq < last")
    if wrong := bad.orderBy("file", "seq").limit(1).collect():
        raise BadLine(f"{wrong[0].file}: line {wrong[0].seq}")
    return lines.where(is_object).select(F.from_json("line", schema).alias("row"), "seq").select("row.*", "seq")


def taxonomy(spark: SparkSession, text: str, loose: bool = False) -> DataFrame:
    """(id, label, parent, aliases, position) of a YAML taxonomy's nodes; loose: nodes without a text as id are left out, and the last node of an id counts, at the first one's place."""
    import yaml

    nodes = yaml.safe_load(text).get("nodes") or []
    if loose:
        kept: dict[str, dict] = {}
        for n in nodes:
            if isinstance(n, dict) and isinstance(n.get("id"), str):
                kept[n["id"]] = n
        nodes = list(kept.values())
    rows = [(n.get("id"), n.get("label"), n.get("parent"), [str(a) for a in n.get("aliases") or []], i) for i, n in enumerate(nodes)]
    return spark.createDataFrame(rows, "id string, label string, parent string, aliases array<string>, position int")


def taxonomy_file(spark: SparkSession, path: str, loose: bool = False) -> DataFrame:
    """The same from a file in any store that Spark reads; a taxonomy is a small file."""
    return taxonomy(spark, spark.read.text(path, wholetext=True).first()[0], loose)


def performance(spark: SparkSession, path: str) -> DataFrame:
    """(id, f1, support) of a CSV; an unreadable f1 is NaN, an unreadable support 0; rows without an id are left out."""
    rows = spark.read.option("header", True).csv(path)
    return rows.where(F.trim("id") != "").select(F.trim("id").alias("id"), F.coalesce(F.col("f1").try_cast("double"), F.lit(float("nan"))).alias("f1"), F.coalesce(F.col("support").try_cast("long"), F.lit(0)).alias("support"))


def json_map(spark: SparkSession, path: str, field: str, value: str) -> DataFrame:
    """(key, value fields) of an object-valued field of a JSON document."""
    doc = spark.read.text(path, wholetext=True)
    return doc.select(F.explode(F.from_json("value", f"{field} map<string, struct<{value}>>")[field]).alias("key", "v")).select("key", "v.*")


def arrays(spark: SparkSession, path: str) -> DataFrame:
    """(path, shape, vector) of NPY files: float32 or float64, flattened in C order."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        for batch in batches:
            found = [np.load(io.BytesIO(c), allow_pickle=False) for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([list(a.shape) for a in found], pa.list_(pa.int32())), pa.array([a.astype(np.float64).ravel().tolist() for a in found], pa.list_(pa.float64()))], ["path", "shape", "vector"])

    return files.mapInArrow(run, "path string, shape array<int>, vector array<double>")


def usable_file(listing: DataFrame, key: str, path: str, size: str) -> DataFrame:
    """(key, path) of the largest file that isn't partial, the last name among equals."""
    partial = F.lower(F.col(path)).rlike(r"\.(part|ytdl|tmp|temp)$")
    return listing.where(~partial).groupBy(key).agg(F.max_by(path, F.struct(F.col(size), F.col(path))).alias(path))


def first_by_extension(listing: DataFrame, key: str, path: str, order: list[str]) -> DataFrame:
    """(key, path) of the file whose extension comes first, by name among equals and unknown ones."""
    extension = F.lower(F.regexp_extract(F.col(path), r"(\.[^./]+)$", 1))
    rank = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in order]), extension), F.lit(0))
    return listing.groupBy(key).agg(F.min_by(path, F.struct(F.when(rank == 0, 1_000_000).otherwise(rank), F.col(path))).alias(path))


def embedding_path(row: str = "row", representation: str = "pooled") -> Column:
    """An embedding's place: given directly, by encoder, by encoder and representation (pooled or sequence), in the old field, else by default."""
    r = F.col(row)
    return F.coalesce(r["direct"], r["embedding_paths"][r["encoder"]], r[f"{representation}_paths"][r["encoder"]], r["legacy_path"], F.concat(F.lit("embeddings/"), r["encoder"], F.lit("/"), r["video_id"], F.lit(".npy")))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Spark's committer publishes a write as a whole."""
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def report(**parts: Column) -> Column:
    """A report's JSON from aggregates."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in parts.items()]))

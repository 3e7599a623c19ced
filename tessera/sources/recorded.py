"""Recorded responses in place of live services: a Python data source, cache keys and projections of their JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def cache_key(**parts: Column) -> Column:
    """SHA-256 of the parts as JSON with sorted names."""
    return F.sha2(F.to_json(F.struct(*[parts[k].alias(k) for k in sorted(parts)])), 256)


def children(document: Column, path: str, schema: str) -> Column:
    """An array of a JSON field that may be an array, a single object, or missing."""
    found = F.get_json_object(document, path)
    whole = F.when(F.substring(F.trim(found), 1, 1) == "[", found).when(found.isNotNull(), F.concat(F.lit("["), found, F.lit("]")))
    return F.coalesce(F.from_json(whole, f"array<{schema}>"), F.from_json(F.lit("[]"), f"array<{schema}>"))


def lookup(requests: DataFrame, recorded: DataFrame, key: str = "key") -> DataFrame:
    """Requests with their recorded response (null: none) and whether there was one."""
    return requests.join(recorded.select(key, "response"), key, "left").withColumn("hit", F.col("response").isNotNull())


class RecordedSource(DataSource):
    """spark.read.format("recorded").option("responses", JSON array of {endpoint, key, response}): a partition for each endpoint."""

    @classmethod
    def name(cls) -> str:
        return "recorded"

    def schema(self) -> str:
        return "endpoint string, key string, response string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(json.loads(self.options.get("responses", "[]")))


class _Reader(DataSourceReader):
    def __init__(self, rows: list[dict]):
        self.rows = rows

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(e) for e in sorted({r["endpoint"] for r in self.rows})] or [InputPartition("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for r in self.rows:
            if r["endpoint"] == partition.value:
                yield r["endpoint"], r["key"], r["response"] if isinstance(r["response"], str) else json.dumps(r["response"])

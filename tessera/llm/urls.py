"""URL filters by Bloom filter cascades: exact membership over the corpus's complete key universe, without joins.

Level 0 encodes the listed keys.  Level 1 encodes those other keys of the universe that level 0 holds by
mistake, level 2 those listed keys that level 1 holds by mistake, and so on until a level makes no mistake.
A key of the universe is listed if the first level that lacks it has an odd number.  Universe and levels
are made by shuffles whose map sides combine; only finished bit arrays, of a checked size, are broadcast.

Defined results: a null url, or one without "://", has an empty host and path, fits no rule and is
allowed; repeated rows give repeated results; an empty table gives no rows; other columns of the input
are not read, whatever their names; null keys are no keys.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import written

#: Largest share of mistakes a level is sized for, and the bits of all cascades together up to which they are broadcast (64 MiB).
MISTAKES, BROADCAST_BITS = 2.0**-8, 1 << 29
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class TooManyKeys(ValueError):
    """The cascade would be too large to broadcast; callers join instead."""


def hashes(key: Column) -> list[Column]:
    """The two 64-bit hashes that stand for a key."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(key, F.lit(1)).alias("h2")]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads each bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Level:
    number: int
    bits: int
    hashed: int
    words: np.ndarray | None = None

    @staticmethod
    def sized(keys: int, others: int, number: int) -> Level:
        """A level for so many keys that makes about as many mistakes among the others as it has keys, so that the next level is no larger, however large the universe."""
        hashed = max(1, round(-math.log2(min(MISTAKES, keys / max(1, others)))))
        return Level(number, max(512, -(-int(keys * hashed / math.log(2) + 1) // 64) * 64), hashed)

    def positions(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The bits of each key, a column for each hash; other ones at each level."""
        salt = np.array([self.number + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        a, b = mixed(h1.view(np.uint64) ^ salt), mixed(h2.view(np.uint64) ^ salt) | np.uint64(1)
        return (a[:, None] + np.arange(self.hashed, dtype=np.uint64) * b[:, None]) % np.uint64(self.bits)

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        at = self.positions(h1, h2)
        return ((self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1).all(axis=1)


@dataclass
class Cascade:
    levels: list[Level]

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """For keys of the universe: whether each is listed."""
        out, open_ = np.zeros(len(h1), bool), np.arange(len(h1))
        for number, level in enumerate(self.levels):
            held = level.holds(h1[open_], h2[open_])
            out[open_[held]] = number % 2 == 0
            open_ = open_[held]
        return out

    @property
    def bits(self) -> int:
        return sum(level.bits for level in self.levels)


def made_level(keys: DataFrame, n: int, others: int, number: int) -> Level:
    """The filter of n keys (h1, h2); its words are or-ed where they are made, then between tasks."""
    level = Level.sized(n, others, number)
    if level.bits > BROADCAST_BITS:
        raise TooManyKeys(f"{n} keys need {level.bits} bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(level.positions(*(np.ascontiguousarray(c.to_numpy(zero_copy_only=False)) for c in batch.columns)))
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            if len(word):
                filled = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(filled.view(np.int64))], ["word", "filled"])

    found = keys.mapInArrow(run, "word long, filled long").groupBy("word").agg(F.bit_or("filled").alias("filled")).toArrow()
    words = np.zeros(level.bits // 64, np.uint64)
    words[found["word"].to_numpy()] = found["filled"].to_numpy().view(np.uint64)
    return Level(level.number, level.bits, level.hashed, words)


def held_by(keys: DataFrame, level: Level) -> DataFrame:
    """Those of the keys (h1, h2) that a level holds."""
    shared = keys.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = shared.value.holds(*(np.ascontiguousarray(c.to_numpy(zero_copy_only=False)) for c in batch.columns))
            yield batch.filter(pa.array(held))

    return keys.mapInArrow(run, "h1 long, h2 long")


def cascade(universe: DataFrame, listed: DataFrame) -> Cascade:
    """universe, listed: keys as (h1, h2), repeated ones allowed.  The listed keys count as part of the universe."""
    both = universe.select("h1", "h2", F.lit(0).alias("in_list")).union(listed.select("h1", "h2", F.lit(1).alias("in_list")))
    keys = written(both.groupBy("h1", "h2").agg(F.max("in_list").alias("in_list")), "keys")
    include, exclude = (keys.where(F.col("in_list") == flag).select("h1", "h2") for flag in (1, 0))
    levels: list[Level] = []
    n, others = include.count(), exclude.count()
    while n:
        levels.append(made_level(include, n, others, len(levels)))
        wrong = written(held_by(exclude, levels[-1]), "mistakes")
        include, exclude, n, others = wrong, include, wrong.count(), n
    return Cascade(levels)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path, as the contract defines them."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(host: Column, labels: list[int]) -> Column:
    """The host's last so many labels, joined, for each count that rules have; counts the host lacks give none."""
    parts = F.split(host, r"\.", -1)
    return F.filter(F.array(*[F.when(F.size(parts) >= n, F.substring_index(host, ".", -n)) for n in labels]), lambda x: x.isNotNull())


def prefixes(path: Column, lengths: list[int]) -> Column:
    return F.filter(F.array(*[F.when(F.length(path) >= n, F.substr(path, F.lit(1), F.lit(n))) for n in lengths]), lambda x: x.isNotNull())


def judge(df: DataFrame, rules: list[tuple[str, str, str]], blocked_hosts: list[str], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) of each row.

    rules: (verdict, host, path); of the rules whose host is the url's or a parent of it and whose path starts the
    url's, the longest decides, the one of the longer host among equally long ones.  Where none fits, a url whose host
    is one of blocked_hosts, or below one, is blocked and any other allowed, with a null rule.  Both memberships come
    from cascades over all keys of the corpus; lists too long for a broadcast are joined instead.
    """
    spark = df.sparkSession
    keys = {host + path: verdict for verdict, host, path in rules}
    labels = sorted({host.count(".") + 1 for _, host, _ in rules}) or [1]
    lengths = sorted({len(path) for _, _, path in rules}) or [0]
    host, path = split_url(F.col(url_col))
    urls = df.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    probes = F.flatten(F.transform(suffixes(F.col("host"), labels), lambda h: F.transform(prefixes(F.col("path"), lengths), lambda p: F.concat(h, p))))
    above = suffixes(F.col("host"), sorted({h.count(".") + 1 for h in blocked_hosts}) or [1])
    probed = urls.withColumn("probes", probes).withColumn("above", above)

    def listed(values: list[str]) -> DataFrame:
        return spark.createDataFrame([(v,) for v in values], "key string").select(*hashes(F.col("key")))

    def universe(column: str) -> DataFrame:
        return probed.select(F.explode(column).alias("key")).distinct().select(*hashes(F.col("key")))

    try:
        fits = cascade(universe("probes"), listed(list(keys)))
        blocks = cascade(listed(list(keys)), listed([k for k, v in keys.items() if v == "block"]))
        hosts = cascade(universe("above"), listed(blocked_hosts))
        if fits.bits + blocks.bits + hosts.bits > BROADCAST_BITS:
            raise TooManyKeys("the cascades together are too large")
    except TooManyKeys:
        return joined(probed, keys, blocked_hosts, id_col)
    shared = spark.sparkContext.broadcast((fits, blocks, hosts))

    def of(name: str, seed: list[Column]) -> Column:
        return F.transform(name, lambda x: F.xxhash64(x, *seed))

    hashed = probed.select("id", "host", "path", "probes", *[of(c, seed).alias(f"{c}{n}") for c in ("probes", "above") for n, seed in ((1, []), (2, [F.lit(1)]))])
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *T._parse_datatype_string("host string, path string, rule string, verdict string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits, blocks, hosts = shared.value
        flat = lambda column: column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        for batch in batches:
            column = dict(zip(batch.schema.names, batch.columns, strict=True))
            found, h1, h2 = fits.contains(flat(column["probes1"]), flat(column["probes2"])), flat(column["probes1"]), flat(column["probes2"])
            stops = blocks.contains(np.where(found, h1, 0), np.where(found, h2, 0))
            bad = hosts.contains(flat(column["above1"]), flat(column["above2"]))
            out, at, up = [], 0, 0
            for texts, n in zip(column["probes"].to_pylist(), column["above1"].value_lengths().to_pylist(), strict=True):
                mine = [(len(t), t.index("/") if "/" in t else len(t), t, stops[at + i]) for i, t in enumerate(texts) if found[at + i]]
                best = max(mine, default=None)
                stop = best[3] if best else bad[up : up + n].any()
                out.append((best[2] if best else None, "block" if stop else "allow"))
                at, up = at + len(texts), up + n
            yield pa.RecordBatch.from_arrays([column["id"], column["host"], column["path"], pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string())], schema.names)

    return hashed.mapInArrow(run, schema)


def joined(probed: DataFrame, keys: dict[str, str], blocked_hosts: list[str], id_col: str) -> DataFrame:
    """The same verdicts by joins, for lists beyond the bound of a broadcast."""
    spark = probed.sparkSession
    rows = probed.withColumn("row", F.monotonically_increasing_id())
    rules = spark.createDataFrame(list(keys.items()), "key string, rule_verdict string")
    best = rows.select("row", F.explode("probes").alias("key")).join(rules, "key").groupBy("row").agg(F.max(F.struct(F.length("key"), F.instr("key", "/"), F.col("key").alias("key"), F.col("rule_verdict").alias("v"))).alias("best"))
    bad = rows.select("row", F.explode("above").alias("key")).join(spark.createDataFrame([(h,) for h in blocked_hosts], "key string"), "key", "left_semi").select("row").distinct().withColumn("bad", F.lit(True))
    verdict = F.coalesce(F.col("best.v"), F.when(F.col("bad"), "block").otherwise("allow"))
    return rows.join(best, "row", "left").join(bad, "row", "left").select(F.col("id").alias(id_col), "host", "path", F.col("best.key").alias("rule"), verdict.alias("verdict"))

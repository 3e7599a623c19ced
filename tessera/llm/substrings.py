"""Removal of byte strings that occur more than once in the corpus, by buckets of suffixes with synchronised samples.

A byte goes if a string of `length` bytes that covers it also starts anywhere else, in the same document or
another.  A difference-cover suffix array orders every suffix, bucket by bucket, and lets ranks of a sample
of positions decide long ties.  Here, too, windows (the suffixes' first `length` bytes) are dealt to buckets
and names of sampled positions decide ties, but the sample is chosen by content instead of by position: the
anchor of a window is its gram of ANCHOR bytes with the least hash.  Equal windows have equal anchors at equal
places, so a window is compared within its anchor's bucket alone, and all windows that share an anchor's
occurrence, a run, are compared at once.  (Why not the cover itself: see the README, with figures.)

1. Anchors are counted.  Runs whose anchor occurs once are unique: most of the corpus ends here.
2. A bucket whose runs all have one context (the bytes that the run's windows cover) repeats as a whole.
3. Buckets of several contexts part into blocks of BLOCK windows at equal distances from the anchor.  A
   block whose core (the bytes that all its windows share) occurs once is unique; one whose core always has
   the same surroundings repeats as a whole.
4. What is left is compared window by window.

No group is ever gathered: every step is an aggregate whose map sides combine, and a join back.  Names are
64-bit hashes of bytes.  Spans hang on a text's digest, not on a row, so equal texts have equal spans.

Defined results: null and empty texts have no bytes; texts shorter than `length` lose nothing; equal texts of
`length` bytes or more lose all of their bytes; repeated rows are such; an empty table gives no rows; other
columns of the input are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import lean, lots, written

#: Bytes of an anchor (a power of two) and windows of a block.
ANCHOR, BLOCK = 64, 8
#: Bits of a broadcast bitmap of anchors or digests, 16 MiB; it only saves rows, joins decide.
BITMAP = 1 << 27
ROWS = 256

_BYTES = np.random.default_rng(7).integers(0, 2**64, 256, dtype=np.uint64)


def runs(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """The anchors' hashes and places, and their runs' first and last windows; None for texts without a window."""
    if len(data) < length:
        return None
    h, step, power = _BYTES[np.frombuffer(data, np.uint8)], 1, 0x9E3779B97F4A7C15
    while step < ANCHOR:  # a polynomial of 2 * step bytes from two of step bytes
        h = h[:-step] * np.uint64(power) + h[step:]
        step, power = 2 * step, power * power % 2**64
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    key = h & np.uint64(0xFFFFFFFF00000000) | np.arange(len(h), dtype=np.uint64)  # ties: the first
    width, step = length - ANCHOR + 1, 1
    while 2 * step <= width:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    if width > step:
        key = np.minimum(key[: step - width], key[width - step :])
    at = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return h[at[first]].view(np.int64), at[first], first, np.r_[first[1:], len(at)] - 1


def digest(data: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(data)
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def name(data: bytes, seed: int = 0) -> int:
    """A signed 64-bit name of bytes."""
    h = xxhash.xxh3_64_intdigest(data, seed)
    return h - (1 << 64) if h >> 63 else h


def texts_of(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in lots(batches, column, ROWS):
        yield batch, [x or b"" for x in batch.column(column).to_pylist()]


def emitted(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if len(c) else np.empty(0, np.int64)) for c in columns], names)


def bitmap(values: DataFrame, column: str) -> np.ndarray:
    """Bits for a column of 64-bit values: a value's bit is set if it occurs, and perhaps if it doesn't."""
    at = F.pmod(F.col(column), F.lit(BITMAP))
    words = values.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("set")).toArrow()
    out = np.zeros(BITMAP // 64, np.uint64)
    out[words["word"].to_numpy()] = words["set"].to_numpy().view(np.uint64)
    return out


def within(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = np.mod(values, BITMAP)
    return (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


def named_runs(docs: DataFrame, length: int) -> DataFrame:
    """(anchor, context) of each run of the documents (bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in texts_of(batches, 0):
            anchors, contexts = [], []
            for data in texts:
                if found := runs(data, length):
                    h, _, first, last = found
                    anchors.append(h)
                    contexts.append(np.array([name(data[a : b + length]) for a, b in zip(first.tolist(), last.tolist(), strict=True)], np.int64))
            yield emitted([anchors, contexts], ["anchor", "context"])

    return docs.mapInArrow(lean(run), "anchor long, context long")


def parted(rows: DataFrame, keys: list[str], content: str, weight: str | None = None) -> DataFrame:
    """The groups of rows that hold more than one: keys, and whether their contents differ."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    return rows.groupBy(*keys).agg(n.alias("n"), F.min(content).alias("lo"), F.max(content).alias("hi")).where("n > 1").select(*keys, (F.col("lo") != F.col("hi")).alias("differ"))


def found_spans(docs: DataFrame, length: int) -> DataFrame:
    """(d1, d2, start, end) of repeated byte ranges of the documents (bytes), by digest; they may overlap."""
    anchors = written(parted(named_runs(docs, length), ["anchor"], "context"), "anchors")
    shared = docs.sparkSession.sparkContext.broadcast((bitmap(anchors, "anchor"), bitmap(anchors.where("differ"), "anchor")))

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each run whose anchor may repeat, and the blocks of those whose bucket may have several contexts, once a task for each context."""
        repeats, differ = shared.value
        names = ["kind", "d1", "d2", "anchor", "context", "first", "last", "at", "core", "content", "n"]
        seen: dict[tuple[int, int], list] = {}
        met: set[int] = set()

        def blocks() -> Iterator[pa.RecordBatch]:
            rows = [(1, 0, 0, anchor, context, q, r1, r2, core, content, count[0]) for (anchor, context), (count, inside) in seen.items() for q, r1, r2, core, content in inside]
            seen.clear()
            for i in range(0, len(rows), 50_000):
                part = np.array(rows[i : i + 50_000], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in part.T], names)

        for _, texts in texts_of(batches, 0):
            out: list[list] = [[] for _ in names]
            for data in texts:
                if not (found := runs(data, length)):
                    continue
                keep = within(repeats, found[0])
                if not keep.any():
                    continue
                h, at, first, last = (x[keep] for x in found)
                d1, d2 = digest(data)
                several = within(differ, h)
                contexts = [name(data[a : b + length]) if s else 0 for a, b, s in zip(first.tolist(), last.tolist(), several.tolist(), strict=True)]
                if d1 not in met:
                    met.add(d1)
                    zero = np.zeros(len(h), np.int64)
                    for column, values in zip(out, (zero, zero + d1, zero + d2, h, np.array(contexts, np.int64), first, last, at, zero, zero, zero), strict=True):
                        column.append(values)
                for i in np.flatnonzero(several).tolist():
                    key = (int(h[i]), contexts[i])
                    if key in seen:
                        seen[key][0][0] += 1
                        continue
                    p, a, b, inside = int(at[i]), int(first[i]), int(last[i]), []
                    for q in range((p - b) // BLOCK, (p - a) // BLOCK + 1):
                        r1, r2 = max(p - b, q * BLOCK), min(p - a, q * BLOCK + BLOCK - 1)
                        inside.append((q, r1, r2, name(data[p - q * BLOCK : p - q * BLOCK - BLOCK + 1 + length]), name(data[p - r2 : p - r1 + length], r1 << 16 | r2)))
                    seen[key] = [[1], inside]
            yield emitted(out, names)
            if len(met) > 500_000:
                met.clear()
            if len(seen) > 50_000:
                yield from blocks()
        yield from blocks()

    schema = "kind long, d1 long, d2 long, anchor long, context long, first long, last long, at long, core long, content long, n long"
    # kind 0: runs; kind 1: blocks, whose first, last and at are the block's number and its windows' least and greatest distance.
    rows = written(docs.mapInArrow(lean(located), schema).join(anchors, "anchor"), "runs")
    placed = rows.where("kind = 0").select("d1", "d2", "anchor", "context", "first", "last", "at", "differ")
    whole = placed.where(~F.col("differ")).select("d1", "d2", "first", "last")
    block = rows.where("kind = 1 and differ").select("anchor", "context", F.col("first").alias("q"), F.col("last").alias("r1"), F.col("at").alias("r2"), "core", "content", "n")
    cores = written(block.join(parted(block, ["anchor", "q", "core"], "content", "n"), ["anchor", "q", "core"]), "cores")
    same = cores.where(~F.col("differ")).select("anchor", "context", "r1", "r2")
    rest = cores.where("differ").groupBy("anchor", "context").agg(F.collect_set(F.struct("r1", "r2")).alias("blocks"), F.sum("n").alias("n"))  # at most a run's blocks
    # Each task counts a context once for each of its blocks.
    rest = written(rest.withColumn("n", F.expr("n div size(blocks)")), "blocks")
    several = placed.where("differ")
    holders = several.groupBy("anchor", "context").agg(F.min("d1").alias("d1")).join(rest.select("anchor", "context"), ["anchor", "context"])
    single = windows(docs, rest, holders, length)
    # A run is shorter than a window, so all windows of a run overlap and the outermost bound what goes.
    bounds = written(same.union(single).groupBy("anchor", "context").agg(F.min("r1").alias("r1"), F.max("r2").alias("r2")), "bounds")  # written, so that a context of many texts can be split
    inside = several.join(bounds, ["anchor", "context"])
    return whole.union(inside.select("d1", "d2", F.col("at") - F.col("r2"), F.col("at") - F.col("r1"))).select("d1", "d2", F.col("first").alias("start"), (F.col("last") + length).alias("end"))


def windows(docs: DataFrame, rest: DataFrame, holders: DataFrame, length: int) -> DataFrame:
    """(anchor, context, r1, r2), r1 = r2, of the windows that repeat among the blocks left over; holders: a text (d1) that has each context."""
    shared = docs.sparkSession.sparkContext.broadcast((bitmap(holders, "d1"), bitmap(rest, "context")))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for _, texts in texts_of(batches, 0):
            rows = []
            held = within(shared.value[0], np.array([digest(x)[0] for x in texts], np.int64))
            for data, wanted in zip(texts, held.tolist(), strict=True):
                if not wanted or not (found := runs(data, length)):
                    continue
                lot = [(h, name(piece := data[a : b + length]), p - a, piece) for h, p, a, b in zip(*(x.tolist() for x in found), strict=True)]
                for row, open_ in zip(lot, within(shared.value[1], np.array([r[1] for r in lot], np.int64)).tolist(), strict=True):
                    if open_ and row[:2] not in seen:
                        seen.add(row[:2])
                        rows.append(row)
            if len(seen) > 500_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["anchor", "context", "off", "piece"])

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for h, context, n, blocks, off, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for block in blocks:
                    rows += [(h, context, r, name(piece[off - r : off - r + length]), n) for r in range(block["r1"], block["r2"] + 1)]
            part = np.array(rows, np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in part.T], ["anchor", "context", "r", "window", "n"])

    pieces = docs.mapInArrow(lean(contexts), "anchor long, context long, off long, piece binary")
    with_bytes = rest.join(pieces, ["anchor", "context"]).dropDuplicates(["anchor", "context"]).select("anchor", "context", "n", "blocks", "off", "piece")
    each = written(with_bytes.mapInArrow(lean(single), "anchor long, context long, r long, window long, n long"), "windows")
    repeated = each.groupBy("anchor", "r", "window").agg(F.sum("n").alias("total")).where("total > 1").select("anchor", "r", "window")
    return each.join(repeated, ["anchor", "r", "window"]).select("anchor", "context", F.col("r").alias("r1"), F.col("r").alias("r2"))


SPANS = "array<struct<start:bigint,end:bigint>>"


def merged_lists(lists: pa.ListArray) -> pa.ListArray:
    """For each list of (start, end) the maximal runs of ranges that overlap or touch; all lists at once."""
    n = lists.value_lengths().to_numpy(zero_copy_only=False)
    row, (start, end) = np.repeat(np.arange(len(lists)), n), (c.to_numpy() for c in lists.flatten().flatten())
    order = np.lexsort((start, row))
    start, end = start[order], end[order]
    far = row * (int(end.max(initial=0)) + 1)  # rows lie apart, so one running maximum serves all
    reach = np.maximum.accumulate(far + end)
    first = np.flatnonzero(np.r_[True, far[1:] + start[1:] > reach[:-1]]) if len(row) else np.empty(0, np.int64)
    last = np.r_[first[1:], len(row)] - 1 if len(row) else first
    ends = np.r_[0, np.cumsum(np.bincount(row[first], minlength=len(lists)))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(start[first]), pa.array((reach - far)[last])], ["start", "end"]))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = 200) -> DataFrame:
    """(id, n_bytes, n_removed, spans, kept) of each row: byte ranges removed, and the bytes that stay."""
    docs = df.select(F.col(text_col).cast("binary").alias("bytes"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], merged_lists(batch.column(2))], ["d1", "d2", "spans"])

    each = found_spans(docs, length).groupBy("d1", "d2").agg(F.collect_set(F.struct("start", "end")).alias("spans"))  # at most a text's runs
    spans = written(each.mapInArrow(lean(joined), f"d1 long, d2 long, spans {SPANS}"), "spans")
    shared = df.sparkSession.sparkContext.broadcast(bitmap(spans, "d1"))
    id_type = df.schema[id_col].dataType.simpleString()
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())

    def chosen_rows(batches: Iterator[pa.RecordBatch], hit: bool) -> Iterator[tuple[pa.Array, list[bytes], list[tuple[int, int]]]]:
        """Ids, texts and digests of the rows that may lose bytes, or of those that surely don't."""
        for batch, texts in texts_of(batches, 1):
            d = [digest(x) for x in texts]
            chosen = within(shared.value, np.array([x[0] for x in d], np.int64)) == hit
            at = np.flatnonzero(chosen)
            yield batch.column(0).take(pa.array(at)), [texts[i] for i in at], [d[i] for i in at]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, _ in chosen_rows(batches, False):
            n = len(texts)
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(x) for x in texts], pa.int64()), pa.array([0] * n, pa.int64()), pa.array([[]] * n, kinds[2]), pa.array(texts, pa.binary())], ["id", "n_bytes", "n_removed", "spans", "kept"])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, d in chosen_rows(batches, True):
            yield pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.binary()), *(pa.array([x[i] for x in d], pa.int64()) for i in (0, 1))], ["id", "bytes", "d1", "d2"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lots(batches, 1, ROWS):
            rows = []
            for data, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                gone = [(s["start"], s["end"]) for s in found or []]
                edges = [0, *(x for span in gone for x in span), len(data)]
                rows.append((len(data), sum(b - a for a, b in gone), gone, b"".join([data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])))
            columns = [[r[0] for r in rows], [r[1] for r in rows], [[{"start": a, "end": b} for a, b in r[2]] for r in rows], [r[3] for r in rows]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["id", "n_bytes", "n_removed", "spans", "kept"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("bytes"))
    hit = rows.mapInArrow(lean(keyed), f"id {id_type}, bytes binary, d1 long, d2 long").join(spans, ["d1", "d2"], "left").select("id", "bytes", "spans")
    out = f"id {id_type}, n_bytes long, n_removed long, spans {SPANS}, kept binary"
    return rows.mapInArrow(lean(whole), out).union(hit.mapInArrow(lean(cut), out)).withColumnRenamed("id", id_col)


def digests(removed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return removed.select(id_col, "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Two documents link if their sets of word shingles have a Jaccard similarity of NUM/DEN or more; the result
is each document's connected component.  Shingles stand as 64-bit hashes of their words.

1. Documents with equal sets are one node (an aggregate on the set's 128-bit digest).
2. Shingles are ordered rare first: frequent ones, found by counting within tasks and summing the counts,
   come last.  The table of frequent shingles has a bounded size and only sets the order; any order that all
   tasks share gives the same links.
3. Each node gives the prefix of its ordered set that any partner must share a shingle with.  Prefix
   shingles that one node alone has drop out (an aggregate); how many of them stand before a shared one
   is known from then on, and no partner can have them.
4. Rounds of stars: within each prefix shingle every node is paired with one centre, so pairs grow with the
   rows, never with a group's square.  The first round's centre is the most typical node, the one with the
   least share of shingles of its own, as near copies link with it if they link with any.  Length and
   positional filters leave pairs out; each other pair is verified once.  Linked nodes join components, and
   shingles whose nodes all are in one component are done.
5. What is left joins on prefix shingles between components: length and positional filters, one row a pair,
   the suffix filter, one verification a pair.  A node whose own shingles already rule every partner out
   meets none here.

Nodes are named by 64 bits of their digest; names that two digests share are found and replaced by the other
64 bits, so different sets never are one node.

Components come from repeated least-label steps, in tables, not on the driver.  Whatever is joined back by a
hub, a label or a shingle is written first, so that the join's large keys can be split.

Defined results: null texts and texts without words have the empty set, link with nothing and are their own
component; fewer words than a shingle has are one shingle; documents with equal texts, and repeated rows,
share a component; the component of documents whose ids are all null is null; an empty table gives no rows;
other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import SPACES, dropped, lean, lots, written, written_bytes

#: Frequent shingles that a task notes at least this often are reported; the table keeps at most this many, 16 bytes each.
OFTEN, FREQUENT = 3, 1 << 20
#: Shingles that a task counts before it lets go of those seen once: this bounds its memory.
COUNTED = 1 << 20
#: Wanted documents, and bytes of their ids, up to which they are broadcast; beyond, the texts are joined.
FEW_DOCS, FEW_BYTES = 1 << 20, 1 << 24
#: Rounds of stars, and the part of a smaller set, one in so many, that a star's pair must share within prefixes.
STARS, STAR_SHARE = 2, 20
#: Bits of a broadcast bitmap of shingles, 16 MiB; it only saves rows, a join decides.
BITMAP = 1 << 27
ROWS = 256
#: Bytes of texts whose words are hashed at once.
PART = 1 << 18
#: Shingles of sets that a task keeps while it verifies pairs, 8 bytes each.
SETS = 1 << 21


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random number for each byte at each of 64 places of a word; a word's hash is the exclusive or of its bytes' numbers.
_PLACES = 64
_NUMBERS = np.random.default_rng(11).integers(0, 2**64, (_PLACES, 256), dtype=np.uint64)
for _upper in range(65, 91):
    _NUMBERS[:, _upper] = _NUMBERS[:, _upper + 32]  # A-Z count as a-z
_NUMBERS = _NUMBERS.ravel()
_IN_WORD = np.ones(256, bool)
_IN_WORD[[ord(c) for c in SPACES]] = False


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that stand one behind the other in a byte array, and the first word of each text and of the end."""
    inside = _IN_WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    some = bounds[:-1][bounds[:-1] < len(data)]
    begins[some] = inside[some]  # words don't cross texts
    first = np.flatnonzero(begins)
    if not len(first):
        return np.empty(0, np.uint64), np.zeros(len(bounds), np.int64)
    letters = data[inside]
    start = (np.cumsum(inside, dtype=np.int32 if len(data) < 1 << 31 else np.int64)[first] - 1).astype(np.int64)  # each word's first byte among those in words
    out = np.empty(len(first), np.uint64)
    word = 0
    while word < len(first):  # some million bytes at once, but for longer words
        to = max(word + 1, int(np.searchsorted(start, start[word] + PART)))
        low, high = int(start[word]), int(start[to]) if to < len(start) else len(letters)
        mine = start[word:to] - low
        place = np.arange(high - low) - np.repeat(mine, np.diff(np.r_[mine, high - low]))
        values = _NUMBERS[(place & (_PLACES - 1)) << 8 | letters[low:high]]
        if place.max() >= _PLACES:
            values *= (2 * (place // _PLACES) + 1).astype(np.uint64)
        out[word:to] = np.bitwise_xor.reduceat(values, mine)
        word = to
    return out, np.searchsorted(first, bounds)


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """The hashes of all runs of `size` words."""
    n = len(words) - size + 1
    out = np.full(n, np.uint64(size))
    for k in range(size):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n])
    return out


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each of the texts, given as UTF-8 bytes; null is the empty text."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    words, ends = word_hashes(data, bounds - bounds[0])
    every = grams(words, size) if len(words) >= size else words
    return [distinct(every[a : b - size + 1]) if b - a >= size else grams(words[a:b], b - a) if b > a else words[:0] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def shingles(text: bytes | None, size: int) -> np.ndarray:
    return shingle_sets(pa.array([text], pa.large_binary()), size)[0]


def digest(found: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit numbers that stand for the set; 0, 0 for the empty one."""
    if not len(found):
        return 0, 0
    d = xxhash.xxh3_128_digest(found.tobytes())
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def prefix_length(n: int, num: int, den: int) -> int:
    """A partner shares one of so many first shingles: n - ceil(n * num / den) + 1."""
    return n - -(-n * num // den) + 1


def ordered(found: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A set's shingles, those outside the table first, then by the table's counts; ties by hash."""
    keys, rank = frequent
    if not len(keys):
        return found
    at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
    often = keys[at] == found
    return np.concatenate([found[~often], found[often][np.argsort(rank[at[often]], kind="stable")]])


def signatures(df: DataFrame, size: int) -> DataFrame:
    """From (id, bytes): a row (0, id, n, d1, d2) for each document, and rows (1, shingle, count) for shingles frequent in a task."""
    id_field = df.schema[0]
    schema = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("id", id_field.dataType), *T._parse_datatype_string("n long, d1 long, d2 long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size_held = [], 0
        often_keys, often_counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        kind = None

        def merged() -> None:
            nonlocal often_keys, often_counts, held, size_held
            if held:
                keys, counts = np.unique(np.concatenate(held), return_counts=True)
                every, place = np.unique(np.concatenate([often_keys, keys]), return_inverse=True)
                total = np.bincount(place, np.concatenate([often_counts, counts]), len(every)).astype(np.int64)
                often_keys, often_counts = every[total > 1], total[total > 1]
                if len(often_keys) > COUNTED:
                    top = np.sort(np.argsort(-often_counts, kind="stable")[: COUNTED // 2])
                    often_keys, often_counts = often_keys[top], often_counts[top]
                held, size_held = [], 0

        for batch in lots(batches, 1, ROWS):
            kind = batch.column(0).type
            sets = shingle_sets(batch.column(1), size)
            d = [digest(s) for s in sets]
            held += sets
            size_held += sum(map(len, sets))
            if size_held > COUNTED:
                merged()
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(sets), pa.int32()), batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([x[0] for x in d], pa.int64()), pa.array([x[1] for x in d], pa.int64())], schema.names)
        merged()
        keep = often_counts >= OFTEN
        if keep.any():
            n = int(keep.sum())
            yield pa.RecordBatch.from_arrays([pa.array([1] * n, pa.int32()), pa.nulls(n, kind), pa.array(often_counts[keep]), pa.array(often_keys[keep].view(np.int64)), pa.array([0] * n, pa.int64())], schema.names)

    return df.mapInArrow(lean(run), schema)


def frequent_table(signed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted, and a rank that grows with their counts."""
    rows = signed.where("kind = 1").groupBy("d1").agg(F.sum("n").alias("c")).orderBy(F.desc("c"), "d1").limit(FREQUENT).toArrow()
    keys, counts = rows["d1"].to_numpy().view(np.uint64), rows["c"].to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order].astype(np.int32)


def node_name(found: np.ndarray, doubled: frozenset[int]) -> int:
    """A set's node: the first half of its digest, or the other one where two digests share the first."""
    first, second = digest(found)
    return second if first in doubled else first


def prefixes(df: DataFrame, frequent, doubled: frozenset[int], size: int, num: int, den: int) -> DataFrame:
    """From (bytes): rows (shingle, node, n, at) of the texts' prefixes; texts that a task has met already give none again."""
    shared = df.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = set()
        for batch in lots(batches, 0, ROWS):
            lot, node, n, at = [], [], [], []
            for found in shingle_sets(batch.column(0), size):
                name = node_name(found, doubled)
                if not len(found) or name in met:
                    continue
                if len(met) > 500_000:
                    met.clear()
                met.add(name)
                part = ordered(found, shared.value)[: prefix_length(len(found), num, den)]
                lot.append(part)
                node.append(np.full(len(part), name))
                n.append(np.full(len(part), len(found), np.int32))
                at.append(np.arange(len(part), dtype=np.int32))
            if lot:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lot).view(np.int64)), *(pa.array(np.concatenate(x)) for x in (node, n, at))], ["shingle", "node", "n", "at"])

    return df.mapInArrow(lean(run), "shingle long, node long, n int, at int")


def shared_shingles(first: DataFrame, shared: DataFrame) -> DataFrame:
    """The prefix rows whose shingle several nodes have: a bitmap leaves out most others before the join decides.

    Adds `held`, a row's place among its node's shared ones, and `last`, how many those are.
    """
    at = F.pmod(F.col("shingle"), F.lit(BITMAP))
    words = shared.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("set")).toArrow()
    bits = np.zeros(BITMAP // 64, np.uint64)
    bits[words["word"].to_numpy()] = words["set"].to_numpy().view(np.uint64)
    known = first.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.mod(batch.column(0).to_numpy(), BITMAP)
            yield batch.filter(pa.array((known.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1))

    # A node's rows are its text's prefix, so none of these windows is larger than a text.
    mine = Window.partitionBy("node")
    rows = first.mapInArrow(lean(run), first.schema).join(shared, "shingle").distinct()
    return rows.withColumns({"held": (F.row_number().over(mine.orderBy("at")) - 1).cast("int"), "last": F.count(F.lit(1)).over(mine).cast("int")})


def wanted_texts(docs: DataFrame, wanted: DataFrame, doubled: frozenset[int], size: int) -> DataFrame:
    """(node, bytes) of the wanted (node, id) from documents (id, bytes)."""
    ids = written(wanted.select(F.col("id").alias("wanted_id")).distinct(), "wanted")
    few = ids.count() <= FEW_DOCS and written_bytes(ids) <= FEW_BYTES
    texts = docs.join(F.broadcast(ids) if few else ids, F.col("id").eqNullSafe(F.col("wanted_id")), "left_semi").select("bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lots(batches, 0, ROWS):
            names = [node_name(found, doubled) for found in shingle_sets(batch.column(0), size)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), batch.column(0)], ["node", "bytes"])

    return texts.mapInArrow(lean(run), "node long, bytes binary").dropDuplicates(["node"])


def least_overlap(na, nb, num: int, den: int):
    """The smallest intersection with which sets of these sizes link: ceil(num * (na + nb) / (num + den))."""
    return -(-num * (na + nb) // (num + den))


def suffix_allows(a: np.ndarray, b: np.ndarray, least: int, depth: int = 2) -> bool:
    """False if parting both sorted sets at middle elements already shows fewer than `least` common ones."""
    return suffix_bound(a, b, depth) >= least


def suffix_bound(a: np.ndarray, b: np.ndarray, depth: int) -> int:
    if depth == 0 or not len(a) or not len(b):
        return min(len(a), len(b))
    mid = a[len(a) // 2]
    i, j = len(a) // 2, int(np.searchsorted(b, mid))
    here = int(j < len(b) and b[j] == mid)
    return suffix_bound(a[:i], b[:j], depth - 1) + here + suffix_bound(a[i + 1 :], b[j + here :], depth - 1)


def verified(pairs: DataFrame, texts: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) that link; texts compress where sets of hashes don't, so texts travel and sets are made again."""
    one = texts.select(F.col("node").alias("a"), F.col("bytes").alias("ta"))
    two = texts.select(F.col("node").alias("b"), F.col("bytes").alias("tb"))
    both = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, held = {}, 0

        def of(node: int, text: bytes) -> np.ndarray:
            nonlocal held
            if node not in sets:
                if held > SETS:
                    sets.clear()
                    held = 0
                sets[node] = shingles(text, size)
                held += len(sets[node])
            return sets[node]

        for batch in lots(batches, 2, ROWS):
            keep = []
            for x, y, s, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = of(x, s), of(y, t)
                least = least_overlap(len(a), len(b), num, den)
                if len(a) > len(b):
                    a, b = b, a
                if not suffix_allows(a, b, least):
                    keep.append(False)
                    continue
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                keep.append(int(np.count_nonzero(b[at] == a)) >= least)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(lean(run), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, label) of all linked nodes: the least node that links reach.

    Alternating stars: each round hooks every node's larger neighbours, then its smaller ones, to the least of
    them, until nothing changes.  A round's links never outnumber the one before's by more than its nodes.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    mark = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        down = written(large.groupBy("u").agg(F.min("v").alias("m")), "down")
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, edges = edges, written(small.union(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "links")
        for done in (old, least, large, down):
            dropped(done)
        before, mark = mark, edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label"))


def labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Adds each row's component: its node's label, or the node."""
    if labels is None:
        return rows.withColumn("label", F.col("node"))
    return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def relabelled(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, label) after further links: only components that links join are worked on, each as one node."""
    if labels is None:
        return components(links)
    ends = labelled(labelled(links.withColumnRenamed("a", "node"), labels).select(F.col("label").alias("a"), F.col("b").alias("node")), labels).select("a", F.col("label").alias("b"))
    joined = written(components(ends.where("a <> b").distinct()), "joined")
    up = joined.select(F.col("node").alias("label"), F.col("label").alias("up"))
    return labels.join(up, "label", "left").select("node", F.coalesce("up", "label").alias("label")).union(joined)


def link_components(docs: DataFrame, size: int, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """From (id, bytes): the signed documents (id, n, d1, d2), their nodes (node, d1, d2, id) with the least id each, and the labels of linked nodes (None if nothing links)."""
    signed = written(signatures(docs, size), "signatures")
    frequent = frequent_table(signed)
    rows = written(signed.where("kind = 0").select("id", "n", "d1", "d2"), "documents")
    sets = written(rows.where("n > 0").groupBy("d1", "d2").agg(F.min("id").alias("id")), "sets")
    # Some n * n / 2**65 of n sets: few enough for the driver whatever the corpus.
    doubled = frozenset(r["d1"] for r in sets.groupBy("d1").agg(F.count(F.lit(1)).alias("c")).where("c > 1").collect())
    nodes = sets.select((F.when(F.col("d1").isin(*doubled), F.col("d2")).otherwise(F.col("d1")) if doubled else F.col("d1")).alias("node"), "d1", "d2", "id")
    first = written(prefixes(docs.select("bytes"), frequent, doubled, size, num, den), "prefixes")
    shared = written(first.groupBy("shingle").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("shingle"), "shared")
    left = written(shared_shingles(first, shared), "left")
    for done in (signed, first, shared):
        dropped(done)
    tried = labels = None

    def least_common(na: str, nb: str) -> Column:
        return F.ceil(F.lit(num) * (F.col(na).cast("long") + F.col(nb)) / F.lit(num + den)).cast("long")

    def could() -> Column:
        """The length filter, and the positional one: no more can be common than the shared shingles before this one and all from it on, in either set."""
        common = F.least(F.col("held"), F.col("hb")) + F.least(F.col("n") - F.col("at"), F.col("nb") - F.col("pb"))
        return (F.least("n", "nb").cast("long") * den >= F.greatest("n", "nb").cast("long") * num) & (common >= least_common("n", "nb"))

    def found(pairs: DataFrame) -> int:
        nonlocal tried, labels
        pairs = written(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        n = pairs.count()
        if n:
            tried = pairs if tried is None else tried.union(pairs)
            ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
            texts = written(wanted_texts(docs, ends.join(nodes, "node"), doubled, size), "texts")
            new = written(verified(pairs, texts, size, num, den), "verified")
            dropped(texts)
            if new.limit(1).count():
                labels = written(relabelled(labels, new), "labels")
        return n

    def counted(met: DataFrame) -> DataFrame:
        """(a, b) with the number of shared prefix shingles, sizes and the last shared places."""
        return met.groupBy(F.col("node").alias("a"), "b").agg(F.count(F.lit(1)).alias("c"), F.max("at").alias("pa"), F.max("pb").alias("pb"), F.first("n").alias("na"), F.first("nb").alias("nb"))

    partner = F.col("node").alias("b"), F.col("n").alias("nb"), F.col("at").alias("pb"), F.col("held").alias("hb"), F.col("label").alias("lb")
    ordered_pair = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    # The share of a prefix that its node alone has.
    own = F.lit(1.0) - F.col("last") / (F.col("n") - F.ceil(F.col("n").cast("long") * num / F.lit(den)) + 1)
    for turn in range(STARS):
        here = written(labelled(left, labels), "here")
        # The star's centre: the most typical node, later ones in another order each turn, the same for all shingles.
        order = F.struct(own if turn == 0 else F.lit(0.0), F.xxhash64("node", F.lit(turn)))
        centre = here.groupBy("shingle").agg(F.min(F.struct(order.alias("o"), *partner)).alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("shingle", "c.*")
        centre = written(centre, "centres")
        votes = counted(here.join(centre, "shingle").where((F.col("label") != F.col("lb")) & could()))
        # Stars only save work, so each node tries one centre, the one of most shingles, if they are a share that links have.
        best = votes.where(F.col("c") * STAR_SHARE >= F.least("na", "nb")).groupBy("a").agg(F.max_by("b", F.struct("c", "b")).alias("b"))
        n = found(best.select(*ordered_pair).distinct())
        for done in (here, centre):
            dropped(done)
        if not n:
            break
    here = written(labelled(left, labels), "here")
    open_ = written(here.groupBy("shingle").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("shingle"), "open")
    here = written(here.join(open_, "shingle"), "open_rows")
    met = here.join(here.select("shingle", *partner), "shingle").where((F.col("node") > F.col("b")) & (F.col("label") != F.col("lb")) & could())
    # All of a pair's shared prefix shingles are here, so they and what stands behind the last of them bound the intersection.
    found(counted(met).where(F.col("c") + F.least(F.col("na") - F.col("pa") - 1, F.col("nb") - F.col("pb") - 1) >= least_common("na", "nb")).select("a", "b"))
    return rows, nodes, labels


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """Each row's (id, n_shingles, component_id): the least id, by its type's order, among the documents that links reach."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("bytes"))
    rows, nodes, labels = link_components(docs, size, num, den)
    named = nodes.select("d1", "d2", F.col("id").alias("least"))
    if labels is not None:
        # Linked nodes alone have a label that others share; the least id of each label goes back to its nodes.
        members = labels.union(labels.select(F.col("label").alias("node"), "label").distinct())  # a label is its least node, which links hold as a label alone
        least = written(members.join(nodes, "node").groupBy("label").agg(F.min("id").alias("low")), "least")
        up = members.join(least, "label").select("node", F.lit(True).alias("linked"), "low")
        named = nodes.join(up, "node", "left").select("d1", "d2", F.when(F.col("linked"), F.col("low")).otherwise(F.col("id")).alias("least"))
    named = written(named, "named")
    joined = rows.join(named, ["d1", "d2"], "left")
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("least")).alias("component_id"))

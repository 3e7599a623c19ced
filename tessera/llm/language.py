"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point.  An n-gram's vector binds its
letters' vectors, each rotated by its place, by multiplication; a document's vector bundles (adds) its
n-grams' vectors; a language's prototype bundles its training documents' vectors, each scaled to length 1.
A document gets the language whose prototype has the largest cosine with its vector.

Letters are what Unicode calls letters, lower-cased; whatever stands between them is one blank.  A
prototype is L x D numbers, whatever the corpus: training sums them over the tasks.

Defined results: null texts and texts without a letter get `und` and score 0; without any training row all
do; equal cosines go to the language first by code point; rows with null language train nothing; a null id
counts as the empty text for the split; repeated rows count as often as they stand there; other columns of
the input are not read, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import lean, lots

#: Dimensions, letters of an n-gram, n-grams whose vectors a worker keeps.
DIMENSIONS, GRAM, KEPT = 512, 3, 1 << 15
#: Most languages that are learned: prototypes go to the driver and to all tasks, 2 KB each.
LANGUAGES = 4096
#: Rows, and n-grams, that are worked on together.
ROWS, BLOCK = 128, 8192


def letter(code: int) -> np.ndarray:
    """A code point's vector: always the same."""
    return (np.random.default_rng(0x1D0C0DE + code).integers(0, 2, DIMENSIONS, np.int8) * 2 - 1).astype(np.int8)


@functools.cache
def _rotated(code: int, by: int) -> np.ndarray:
    return np.roll(letter(code), by)


def bound(gram: int) -> np.ndarray:
    """The vector of an n-gram, given as its code points at 21 bits each, the first highest."""
    out = np.ones(DIMENSIONS, np.int8)
    for place in range(GRAM):
        out = out * _rotated(gram >> 21 * place & 0x1FFFFF, place)
    return out


_vectors: dict[int, np.ndarray] = {}


def vectors(grams: np.ndarray) -> np.ndarray:
    if len(_vectors) + len(grams) > KEPT:
        _vectors.clear()
        _rotated.cache_clear()
    out = np.empty((len(grams), DIMENSIONS), np.float32)
    for i, g in enumerate(grams.tolist()):
        v = _vectors.get(g)
        if v is None:
            v = _vectors[g] = bound(g)
        out[i] = v
    return out


@functools.cache
def _letters() -> np.ndarray:
    """For each code point its lower-cased letter, or a blank."""
    out = np.full(0x110000, 32, np.int64)
    for c in range(0x323B0):  # no letters are assigned beyond
        if chr(c).isalpha():
            out[c] = ord(chr(c).lower()[0])
    return out


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text's letters, words set off by one blank, and how often each occurs."""
    codes = _letters()[np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)]
    blank = codes == 32
    if blank.all():
        return np.empty(0, np.int64), np.empty(0, np.float32)
    codes = codes[~blank | np.r_[True, ~blank[:-1]]]  # the first blank of each run stays
    keys = codes[: len(codes) - GRAM + 1]
    for place in range(1, GRAM):
        keys = keys << 21 | codes[place : len(codes) - GRAM + 1 + place]
    found, n = np.unique(keys, return_counts=True)
    return found, n.astype(np.float32)


def profiles(texts: list[str | None]) -> np.ndarray:
    """The texts' vectors, scaled to length 1; zeros for texts without letters."""
    each = [grams(t or "") for t in texts]
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    if not any(len(g) for g, _ in each):
        return out
    every, inverse = np.unique(np.concatenate([g for g, _ in each]), return_inverse=True)
    row, n = np.repeat(np.arange(len(each)), [len(g) for g, _ in each]), np.concatenate([n for _, n in each])
    for first in range(0, len(every), BLOCK):
        here = (inverse >= first) & (inverse < first + BLOCK) if len(every) > BLOCK else slice(None)
        some = every[first : first + BLOCK]
        counts = np.zeros((len(texts), len(some)), np.float32)
        counts[row[here], inverse[here] - first] = n[here]
        out += counts @ vectors(some)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


@dataclass
class Prototypes:
    langs: list[str]
    matrix: np.ndarray  # languages x dimensions, rows of length 1


def train(df: DataFrame, text_col: str, lang_col: str, chosen: Column) -> Prototypes:
    """Prototypes from the chosen rows with a language.  More than LANGUAGES values raise: the column holds something else."""
    kept = df.where(chosen & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"))

    if kept.select("l").distinct().limit(LANGUAGES + 1).count() > LANGUAGES:
        raise ValueError(f"{lang_col} has more than {LANGUAGES} values")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in lots(batches, 0, ROWS):
            lang, found = np.array(batch.column(1).to_pylist(), object), profiles(batch.column(0).to_pylist())
            for name in set(lang):
                sums[name] = sums.get(name, 0) + found[lang == name].astype(np.float64).sum(axis=0)
        for name, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * DIMENSIONS), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(np.round(v * 1e6).astype(np.int64))], ["l", "d", "v"])

    # Whole millionths: their sums don't depend on the order of the tasks.
    rows = kept.mapInArrow(lean(run), "l string, d int, v long").groupBy("l", "d").agg(F.sum("v").alias("v")).toArrow()
    langs = sorted(set(rows["l"].to_pylist()))
    matrix = np.zeros((len(langs), DIMENSIONS))
    place = {name: i for i, name in enumerate(langs)}
    matrix[[place[x] for x in rows["l"].to_pylist()], rows["d"].to_numpy()] = rows["v"].to_numpy()
    return Prototypes(langs, (matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)).astype(np.float32))


def identify(df: DataFrame, prototypes: Prototypes, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """(id, the extra columns, lang_pred, score) of each row; score is the cosine, or 0 if that is below."""
    kept = df.select(id_col, *[c.alias(n) for n, c in (extra or {}).items()], F.col(text_col).alias("__text"))
    schema = T.StructType([*kept.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared, text_at = df.sparkSession.sparkContext.broadcast(prototypes), len(kept.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in lots(batches, text_at, ROWS):
            found = profiles(batch.column(batch.num_columns - 1).to_pylist())
            some = found.any(axis=1) & (len(model.langs) > 0)
            best, score = np.zeros(len(found), int), np.zeros(len(found))
            if model.langs:
                cosine = (found @ model.matrix.T).astype(np.float64)
                best = cosine.argmax(axis=1)
                score = np.where(some, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0.0)
            names = [model.langs[b] if s else "und" for b, s in zip(best, some, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(score)], schema.names)

    return kept.mapInArrow(lean(run), schema)

"""Toxicity by a support vector machine over a subsequence string kernel with Nystroem landmarks.

Strings are words, lower-cased and reduced to letters (look-alike digits and signs between letters are read
as letters, letters spelt one by one are one word).  The kernel of two strings sums, over all subsequences
of three letters, the products of their weights, where an occurrence that spans s letters weighs DECAY**s:
gaps and inserted letters lower a likeness a little instead of ending it.  It is scaled to 1 for equal
strings.  Landmark words map each string to K(s, landmarks) K(landmarks, landmarks)^-1/2, where a linear
support vector machine is trained.

Labels say that a document is toxic, not where.  The training sentences of a toxic document are a bag that
holds one toxic word at least: training alternates between fitting the machine and choosing each bag's
witness, its highest word (the sentence's value is its highest word's; a document's its highest sentence's).
Then a logistic curve over the documents' highest values gives scores from 0 to 1.

Because the machine is linear over the landmarks, it folds into one weight for each subsequence of three
letters, and a word costs a sum over its own subsequences, whatever the number of landmarks.

Defined results: texts without words of three letters, empty and null ones get the curve's value for no
word; without toxic or without clean labels every score is 0; several labels of a document count as toxic if
one is; labels that are null are no labels; a null id counts as the empty text for the split and has no
label; repeated rows give repeated results; other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import lean, lots, released

#: Decay of the kernel by letter spanned, classes of letters, longest string; longer words are read in windows of this that overlap by half.
DECAY, LETTERS, LONGEST = 0.6, 64, 24
#: Labelled documents of each kind that training uses at most, the ones with the lowest md5 of their ids.
TOXIC_ROWS, CLEAN_ROWS = 1500, 3000
#: Landmarks, half of them words that speak for toxicity; rounds of choosing witnesses; penalty of the machine.
LANDMARKS, ROUNDS, PENALTY = 160, 4, 1.0
#: A word tells by its frequency if its share among toxic documents lies so many standard deviations above chance and is so many times that among clean ones.
TELLING, RATIO = 4.0, 10.0
#: Words mapped at once, and words of clean documents that training uses for their likeness to landmarks.
LOT, HARD = 8_192, 60_000
#: Rows that are worked on together, and words whose values a task keeps.
ROWS, KNOWN = 128, 300_000

_LOOKS = str.maketrans("013457@$", "oieastas")  # fixed: which letters these are drawn for
_LOOK = re.compile(r"(?<=[^\W\d_])[013457@$]+(?=[^\W\d_])")
_NOT_LETTER = re.compile(r"[\W\d_]+")
_MARKS = ".,;:!?\"'()[]{}-"


def plain(token: str) -> str:
    """A token's letters, lower-cased."""
    low = token.lower()
    if low.isalpha():
        return low
    inner = low.strip(_MARKS)
    if inner.isalpha():
        return inner
    return _NOT_LETTER.sub("", _LOOK.sub(lambda m: m[0].translate(_LOOKS), low))


class Plain(dict):
    """Letters of tokens, kept up to a bound."""

    def __missing__(self, token: str) -> str:
        if len(self) > 200_000:
            self.clear()
        word = self[token] = plain(token)
        return word


def strings(text: str, known: Plain | None = None) -> set[str]:
    """The distinct strings of a text, of three letters at least; single letters in a row are joined."""
    known = Plain() if known is None else known
    out, spelt = set(), []
    for token in text.split():
        word = known[token]
        if len(word) == 1:
            spelt.append(word)
            continue
        if spelt:
            if word:
                if len(spelt) > 2:
                    out.add("".join(spelt))
                spelt = []
        if word:
            out.add(word)
    if len(spelt) > 2:
        out.add("".join(spelt))
    long = [w for w in out if len(w) > LONGEST]
    for w in long:
        out.discard(w)
        out.update(w[i : i + LONGEST] for i in range(0, len(w) - LONGEST // 2, LONGEST // 2))
    return {w for w in out if len(w) > 2}


def classes(words: list[str]) -> np.ndarray:
    """Words of equal length as rows of letter classes: a to z, and the others by code point; 0 before and behind each word."""
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64).reshape(len(words), -1)
    return np.pad(np.where((codes >= 97) & (codes <= 122), codes - 96, 27 + codes % (LETTERS - 27)), ((0, 0), (1, 1)))


@functools.cache
def places(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of all subsequences of three letters among n, and their weights."""
    at = np.array(list(combinations(range(n), 3)), np.int64)
    return at, DECAY ** (at[:, 2] - at[:, 0] + 1).astype(np.float64)


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For words of equal length: each row's subsequences as numbers, and the weights of their places."""
    letters = classes(words)
    at, weight = places(letters.shape[1])
    return (letters[:, at[:, 0]] * LETTERS + letters[:, at[:, 1]]) * LETTERS + letters[:, at[:, 2]], weight


def norms(keys: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The square root of each row's kernel with itself: equal subsequences add up first."""
    order = np.argsort(keys, axis=1, kind="stable")
    ranked, w = np.take_along_axis(keys, order, 1), weight[order]
    sums = np.cumsum(w, axis=1)
    last = np.ones(ranked.shape, bool)
    last[:, :-1] = ranked[:, 1:] != ranked[:, :-1]
    ends = np.where(last, sums, 0.0)
    before = np.maximum.accumulate(np.concatenate([np.zeros((len(ends), 1)), ends[:, :-1]], axis=1), axis=1)
    return np.sqrt((np.where(last, sums - before, 0.0) ** 2).sum(axis=1))


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """The words' places and the words, in lots of equal length and bounded size."""
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        lot = max(16, 400_000 // len(places(int(n) + 2)[1]))
        for i in range(0, len(at), lot):
            yield at[i : i + lot], [words[j] for j in at[i : i + lot]]


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """The scaled kernel of each word with each landmark."""
    rows = []
    for i, w in enumerate(landmarks):
        keys, weight = subsequences([w])
        scale = norms(keys, weight)[0]
        rows += [(k, i, x / scale) for k, x in zip(keys[0].tolist(), weight.tolist(), strict=True)]
    known, place = np.unique(np.array([r[0] for r in rows]), return_inverse=True)
    table = np.zeros((len(known) + 1, len(landmarks)))
    np.add.at(table, (place, [r[1] for r in rows]), [r[2] for r in rows])
    index = np.full(LETTERS**3, len(known))
    index[known] = np.arange(len(known))
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for at, lot in by_length(words):
        keys, weight = subsequences(lot)
        scale = norms(keys, weight)
        step = max(1, 2_000_000 // (len(weight) * len(landmarks)))  # 16 MB
        for i in range(0, len(lot), step):
            out[at[i : i + step]] = np.einsum("wsl,s->wl", table[index[keys[i : i + step]]], weight, optimize=True)
        out[at] /= scale[:, None]
    return out


def machine(x: np.ndarray, rows: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A linear support vector machine with squared hinge loss on some rows of x, by Newton's method; the last weight is the bias."""
    size = x.shape[1] + 1
    w, ridge = np.zeros(size), np.eye(size) * PENALTY
    ridge[-1, -1] = 1e-6
    before = None
    for _ in range(30):
        now, left, right = [], ridge.copy(), np.zeros(size)
        for i in range(0, len(rows), LOT):
            part = np.pad(x[rows[i : i + LOT]].astype(np.float64), ((0, 0), (0, 1)), constant_values=1.0)
            yes = y[i : i + LOT] * (part @ w) < 1
            part, c = part[yes], weight[i : i + LOT][yes]
            left += (part * c[:, None]).T @ part
            right += part.T @ (c * y[i : i + LOT][yes])
            now.append(yes)
        active = np.concatenate(now)
        if before is not None and (active == before).all():
            break
        before, w = active, np.linalg.solve(left, right)
    return w


@dataclass
class Model:
    weights: np.ndarray  # a weight for each subsequence of three letters
    bias: float
    slope: float
    shift: float
    empty: bool = False

    def values(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words))
        for at, lot in by_length(words):
            keys, weight = subsequences(lot)
            out[at] = (self.weights[keys] @ weight) / norms(keys, weight) + self.bias
        return out

    def bounds(self, words: list[str]) -> np.ndarray:
        """What the words' values can't exceed, without their norms: a norm lies between those of all-different and all-equal subsequences."""
        out = np.zeros(len(words))
        for at, lot in by_length(words):
            keys, weight = subsequences(lot)
            product = self.weights[keys] @ weight
            out[at] = product / np.where(product > 0, np.sqrt((weight**2).sum()), weight.sum()) + self.bias + 1e-9
        return out

    def highest(self, bags: list[set[str]], bound: dict[str, float], value: dict[str, float]) -> np.ndarray:
        """The highest value of each bag's words, -1 without any.  Only words whose bound lies above that of the best-looking word need a norm."""
        new = sorted(set().union(*bags).difference(bound))
        if len(bound) + len(new) > KNOWN:
            bound.clear()
            value.clear()
            new = sorted(set().union(*bags))
        bound.update(zip(new, self.bounds(new).tolist() if new else [], strict=True))

        def known(words: set[str]) -> None:
            missing = sorted(w for w in words if w not in value)
            value.update(zip(missing, self.values(missing).tolist() if missing else [], strict=True))

        lists = [list(bag) for bag in bags]
        limits = [[bound[w] for w in words] for words in lists]
        top = [words[limit.index(max(limit))] if words else None for words, limit in zip(lists, limits, strict=True)]
        known({w for w in top if w is not None})
        able = []
        for words, limit, w in zip(lists, limits, top, strict=True):
            least = value[w] if words else 0.0
            able.append([x for x, most in zip(words, limit, strict=True) if most >= least])
        known(set().union(*able))
        return np.array([max([value[x] for x in words], default=-1.0) for words in able])

    def scores(self, highest: np.ndarray) -> np.ndarray:
        if self.empty:
            return np.zeros(len(highest))
        return 1 / (1 + np.exp(-np.clip(self.slope * highest + self.shift, -30, 30)))


def curve(values: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve over the documents' highest values."""
    x = np.stack([values, np.ones(len(values))], axis=1)
    weight = np.full(len(values), 1 / len(values))
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - toxic)) + 1e-4 * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2), gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit(bags: list[set[str]], toxic: np.ndarray) -> Model:
    """A model from the strings of documents and whether each document is toxic."""
    words = sorted(set().union(*bags)) if bags else []
    place = {w: i for i, w in enumerate(words)}
    inside = [np.array(sorted(place[w] for w in bag), np.int32) for bag in bags]
    return fit_places(words, inside, toxic)


def fit_places(words: list[str], inside: list[np.ndarray], toxic: np.ndarray) -> Model:
    """The same from the sorted words and each document's places among them."""
    toxic = np.asarray(toxic, bool)
    if not toxic.any() or toxic.all():
        return Model(np.zeros(1), 0.0, 0.0, 0.0, empty=True)
    flat, row = np.concatenate(inside), np.repeat(np.arange(len(inside)), [len(b) for b in inside])
    bad = np.bincount(flat[toxic[row]], minlength=len(words))
    good = np.bincount(flat[~toxic[row]], minlength=len(words))
    bad_share, good_share = bad / toxic.sum(), good / (~toxic).sum()
    # How far a word's share among toxic documents lies above chance, in standard deviations.
    chance = (bad + good + 1) / (len(inside) + 2)
    lift = (bad_share - good_share) / np.sqrt(chance * (1 - chance) * (1 / toxic.sum() + 1 / (~toxic).sum()))
    telling = (lift >= TELLING) & (bad_share > RATIO * good_share)
    top = np.argsort(-lift, kind="stable")[: LANDMARKS // 2]
    like = np.concatenate([kernel(words[i : i + LOT], [words[j] for j in top]).max(axis=1) for i in range(0, len(words), LOT)]) * np.log1p(good) * ~telling
    hard = np.argsort(-like, kind="stable")
    chosen = [words[i] for i in dict.fromkeys([*top.tolist(), *hard[: LANDMARKS // 2].tolist()])]
    # Of the words that one clean document has, those least like the landmarks teach nothing.
    used = np.unique(np.concatenate([np.flatnonzero((bad > 0) | (good > 1)), hard[:HARD]]))
    renamed = np.full(len(words), -1)
    renamed[used] = np.arange(len(used))
    inside = [n[n >= 0] for n in (renamed[b] for b in inside)]
    words, bad, good, lift, telling = [words[i] for i in used], bad[used], good[used], lift[used], telling[used]
    values, vectors = np.linalg.eigh(kernel(chosen, chosen))
    root = (vectors / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    mapped = np.empty((len(words), len(chosen)), np.float32)
    for i in range(0, len(words), LOT):
        mapped[i : i + LOT] = kernel(words[i : i + LOT], chosen) @ root
    seen_good = np.flatnonzero((good > 0) & ~telling)
    value, counts = np.where(telling, 1.0, -1.0), bad
    w = np.zeros(mapped.shape[1] + 1)
    for _ in range(ROUNDS):
        # Witnesses count if they tell by their own frequency, or if no clean document has them and they are like those that do.
        yes = np.flatnonzero((counts > 0) & (telling | (good == 0) & (value > 0.5)))
        if not len(yes):
            break
        y = np.concatenate([np.ones(len(yes)), -np.ones(len(seen_good))])
        share = np.concatenate([counts[yes] / counts[yes].sum(), good[seen_good] / good[seen_good].sum()])
        w = machine(mapped, np.concatenate([yes, seen_good]), y, share * len(y) * 0.5)
        value = np.concatenate([mapped[i : i + LOT] @ w[:-1] for i in range(0, len(words), LOT)]) + w[-1]  # whole, numpy would copy it as doubles
        witness = [b[np.argmax(value[b])] for b, t in zip(inside, toxic, strict=True) if t and len(b)]
        counts = np.bincount(witness, minlength=len(words))
    highest = np.array([value[b].max() if len(b) else -1.0 for b in inside])
    slope, shift = curve(highest, toxic)
    # Folded: one weight for each subsequence that a landmark has.
    beta = root @ w[:-1]
    folded = np.zeros(LETTERS**3)
    for b, word in zip(beta, chosen, strict=True):
        keys, weight = subsequences([word])
        np.add.at(folded, keys[0], weight * (b / norms(keys, weight)[0]))
    return Model(folded.astype(np.float32), float(w[-1]), slope, shift)


def train(docs: DataFrame, labels: DataFrame, chosen: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from the chosen labels; `chosen` reads the id column of the labels."""
    known = labels.where(chosen & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("toxic"))
    halves = [known.where((F.col("toxic") == 1) == flag).orderBy(F.md5(F.col(id_col).cast("string").cast("binary")), id_col).limit(n) for flag, n in ((True, TOXIC_ROWS), (False, CLEAN_ROWS))]
    used = halves[0].union(halves[1])
    texts = docs.select(F.col(id_col), F.col(text_col).alias("__text")).join(F.broadcast(used), id_col)  # at most TOXIC_ROWS + CLEAN_ROWS ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Plain()
        for batch in lots(batches, 1, ROWS):
            found = [sorted(strings(t or "", known)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], ["toxic", "strings"])

    rows = texts.select(F.col("toxic").cast("int"), "__text").mapInArrow(lean(run), "toxic int, strings array<string>").toArrow()
    # Words as places in the sorted list of distinct words; documents in an order that the tasks' order doesn't change.
    strings_ = rows["strings"].combine_chunks()
    coded = strings_.flatten().dictionary_encode()
    names = np.array(coded.dictionary.to_pylist(), object)
    order = np.argsort(names)
    rank = np.empty(len(names), np.int32)
    rank[order] = np.arange(len(names))
    codes, ends = rank[coded.indices.to_numpy()], np.cumsum(np.r_[0, strings_.value_lengths().to_numpy(zero_copy_only=False)])
    toxic = rows["toxic"].to_numpy() == 1
    inside = [np.sort(codes[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    turn = sorted(range(len(inside)), key=lambda i: (inside[i].tobytes(), toxic[i]))
    words, bags = names[order].tolist(), [inside[i] for i in turn]
    del rows, strings_, coded, names, codes, rank, inside
    model = fit_places(words, bags, toxic[turn])
    del words, bags
    released()
    return model


RESULT = "score double, predicted int"


def classify(df: DataFrame, model: Model, keep: list[str], text_col: str = "text", only: int | None = None) -> DataFrame:
    """The columns to keep, score and predicted of each row; with `only`, the kept columns of the rows predicted so."""
    kept = df.select(*keep, F.col(text_col).alias("__toxicity_text"))
    fields = kept.schema.fields[:-1]
    schema = T.StructType(fields if only is not None else [*fields, *T._parse_datatype_string(RESULT).fields])
    shared, text_at = df.sparkSession.sparkContext.broadcast(model), len(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, bound, value, known = shared.value, {}, {}, Plain()
        for batch in lots(batches, text_at, ROWS):
            bags = [strings(t or "", known) for t in batch.column(text_at).to_pylist()]
            score = model.scores(np.full(len(bags), -1.0) if model.empty else model.highest(bags, bound, value))
            said = (score >= 0.5).astype(np.int32)
            if only is None:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score), pa.array(said)], schema.names)
            else:
                yield pa.RecordBatch.from_arrays(batch.columns[:-1], schema.names).filter(pa.array(said == only))

    return kept.mapInArrow(lean(run), schema)
